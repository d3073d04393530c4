"""Column helpers: one for each textual rule of a post."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits that decide results (fixed values). White space is Unicode's: no-break and ideographic spaces part words too.
WHITE, SOLID = r"[\s\x1c-\x1f\x85\p{Z}]", r"[^\s\x1c-\x1f\x85\p{Z}]"
URL = rf"https?://{SOLID}+"
CUT_OFF = r"\s*(?:…|\.\.\.)\s*$"
MIN_COPY, MIN_STEM = 100, 20
X_LINK = rf"(?i)(?:https?://(?:[\w-]+\.)*(?:x|twitter)\.com|\bpic\.(?:x|twitter)\.com)/{SOLID}*"
SHORT_LINK = rf"(?i)https?://t\.co/{SOLID}*"
#: Words a story is never told by (fixed values).
STORY_STOP = (
    "that this with your have from they them what when will about more just like only been "
    "were would could should there their than then into over some very much also even"
).split()
WORD_START = r"(?<![0-9A-Za-zÀ-ɏ])"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{WHITE}+", " "))


#: What numbers of the C1 range mean in pages: Windows-1252, or themselves where it has no character.
_C1 = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def _character(n: Column) -> Column:
    """The character of a number, as HTML reads it; null where the number is too large to be read."""
    c1 = F.from_json(F.lit(json.dumps(_C1)), "map<string,string>")[n.cast("string")]
    wrong = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    # controls and noncharacters are no text
    none = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 65536 >= 65534)
    said = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(wrong, "\ufffd").when(n.between(0x80, 0x9F), c1).when(none, "").otherwise(said)


def _entity(part: Column) -> Column:
    """What follows an ampersand, its entity decoded if it begins with one."""
    named = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    found = lambda pattern, group=0: F.regexp_extract(part, pattern, group)
    rest = lambda head: F.substring(part, F.length(head) + 1, F.length(part))
    number, hexed, whole, bare = found(r"^#[0-9]+;?"), found(r"^#[xX][0-9a-fA-F]+;?"), found(r"^[A-Za-z][A-Za-z0-9]{0,31};"), found(f"^(?:{_BARE})")
    decimal = F.regexp_extract(number, "[0-9]+", 0).try_cast("bigint")
    digits = F.regexp_extract(hexed, "[xX]0*([0-9a-fA-F]*)", 1)
    value = F.when(F.length(digits) <= 8, F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("bigint"))
    return (
        F.when(number != "", F.concat(_character(decimal), rest(number))).when(hexed != "", F.concat(_character(value), rest(hexed)))
        .when((whole != "") & named[whole].isNotNull(), F.concat(named[whole], rest(whole))).when(bare != "", F.concat(named[bare], rest(bare)))
        .otherwise(F.concat(F.lit("&"), part))
    )


def unescape(c: Column) -> Column:
    """Every entity that HTML has, once: numbers, names, and the old names that need no semicolon."""
    return F.array_join(F.transform(F.split(c, "&", -1), lambda part, i: F.when(i == 0, part).otherwise(_entity(part))), "")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.transform(F.array(c), f)[0]


#: Letters whose upper case is one letter or, in Spark, two: sharp s and Greek ones with an iota below.
_GREEK = [(a, a + 8) for b in (0x1F80, 0x1F90, 0x1FA0) for a in range(b, b + 8)] + [(a, a + 9) for a in (0x1FB3, 0x1FC3, 0x1FF3)]
_TWO, _ONE = ("".join(map(chr, x)) for x in zip((0xDF, 0x1E9E), *_GREEK))


def capital(letter: Column) -> Column:
    """A letter's upper case as one letter (Unicode's simple mapping); a letter that has none stays: sharp s gives the capital one, a ligature itself."""
    upper = F.upper(letter)
    return F.when(F.length(upper) > F.length(letter), F.translate(letter, _TWO, _ONE)).otherwise(upper)


def without_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, " ")


def comparable(c: Column) -> Column:
    """Entities decoded, links out, lower case, single spaces."""
    return collapse(F.lower(without_urls(unescape(c))))


def echoes(a: Column, b: Column) -> Column:
    """Of two comparable texts: one only repeats the other's post: equal, a long opening, or cut off by an ellipsis."""

    def opens(short: Column, long: Column) -> Column:
        stem = F.regexp_replace(short, CUT_OFF, "")
        return (stem != short) & (F.length(stem) >= MIN_STEM) & F.startswith(long, stem)

    same = (a == b) | ((F.length(a) >= MIN_COPY) & F.startswith(b, a)) | opens(a, b) | opens(b, a)
    return F.coalesce((a != "") & (b != "") & same, F.lit(False))


def is_echo(comment: Column, original: Column) -> Column:
    """The comment only repeats the post it sits on."""
    return echoes(comparable(comment), comparable(original))


def body() -> Column:
    return F.coalesce(F.nullif(F.col("full_text"), F.lit("")), F.col("text"), F.lit(""))


def shares() -> Column:
    return F.coalesce(F.col("retweet_of_author"), F.lit("")) != ""


def own_comment() -> Column:
    """What the poster wrote: the body, unless it echoes the post it shares."""
    return F.when(shares() & is_echo(body(), F.col("retweet_of_text")), "").otherwise(body())


def is_pure_retweet(own: Column) -> Column:
    return (F.coalesce(F.col("retweet_of_author"), F.lit("")) != "") & (F.trim(F.regexp_replace(own, URL, "")) == "")


def display_body(own: Column) -> Column:
    quoted = F.concat(F.lit("🔁 Retweeted @"), F.col("retweet_of_author"), F.lit(": "), F.col("retweet_of_text"))
    shown = F.when(own == "", quoted).otherwise(F.concat(own, F.lit("\n\n"), quoted))
    return F.when(F.coalesce(F.col("retweet_of_author"), F.lit("")) == "", own).otherwise(shown)


def word_count(c: Column) -> Column:
    return F.regexp_count(without_urls(unescape(c)), F.lit(f"{SOLID}+")).cast("bigint")


def status_of(url: Column) -> Column:
    """The id in a post's address, or the address."""
    found = F.regexp_extract(url, r"/status/(\d+)", 1)
    return F.when(found == "", url).otherwise(found)


def content_key(own: Column) -> Column:
    """What two posts must share to be the same post: own words, and who wrote the post shared and what it says; no words give the title.

    Entities are decoded, links to X left out, short links only where there are
    pictures, which are compared too.
    """

    # The pattern is dear and links are rare, so texts without any are told first.
    unlinked = lambda text: F.when(F.contains(F.lower(text), F.lit(".com/")), F.regexp_replace(text, X_LINK, " ")).otherwise(text)
    unshort = lambda text: F.when(F.size("images") > 0, F.regexp_replace(text, SHORT_LINK, " ")).otherwise(text)
    plain = lambda c: collapse(F.lower(bound(bound(unescape(c), unlinked), unshort)))
    shared = F.concat(F.lit("\n@"), F.lower("retweet_of_author"), F.lit(": "), plain(F.col("retweet_of_text")))
    return bound(plain(own), lambda words: F.when(F.col("retweet_of_author") != "", F.concat(words, shared)).when(words != "", words).otherwise(plain(F.col("title"))))


def story_text(own: Column) -> Column:
    both = (F.col("retweet_of_author") != "") & (F.col("retweet_of_text") != "")
    return F.when(both, F.col("retweet_of_text")).otherwise(own)


def story_tokens(c: Column) -> Column:
    """Distinct words of letters and digits, four characters or more, that aren't common ones."""
    words = F.regexp_extract_all(without_urls(F.lower(c)), F.lit(r"[\p{L}\p{N}]{4,}"), 0)
    return F.filter(F.array_distinct(words), lambda w: ~w.isin(STORY_STOP))


def cut_at_word(line: Column, limit: Column) -> Column:
    """``line``, cut at a word with an ellipsis where it is longer."""
    head = F.substring(line, F.lit(1), limit)
    whole_words = F.when(F.instr(head, " ") > 0, F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)).otherwise(head)
    kept = F.when(whole_words == "", head).otherwise(whole_words)
    return F.when(F.length(line) > limit, F.concat(F.regexp_replace(kept, r"[ ,;:\-–—]+$", ""), F.lit("…"))).otherwise(line)


def flat(own: Column, pure: Column, limit: Column) -> Column:
    """One line, cut at a word with an ellipsis."""
    shared = F.concat(own, F.lit(" ⟪"), F.col("retweet_of_text"), F.lit("⟫"))
    text = F.when(pure, F.col("retweet_of_text")).when(F.col("retweet_of_author") != "", shared).otherwise(own)
    return cut_at_word(collapse(without_urls(unescape(text))), limit)


def section_key(source_type: Column, grp: Column) -> Column:
    return F.when(grp == "", source_type).otherwise(F.concat(source_type, F.lit("/"), grp))


def section_label(key: Column) -> Column:
    platform, group = F.split_part(key, F.lit("/"), F.lit(1)), F.split_part(key, F.lit("/"), F.lit(2))
    label = F.when(platform == "x", "X").otherwise(F.upper(platform))
    group = F.trim(F.regexp_replace(group, r"\s*&\s*", " and "))
    return F.when(group == "", label).otherwise(F.concat(label, F.lit(" / "), group))


def mentions(c: Column, keyword: str) -> Column:
    """The keyword from the start of a word on, in any case."""
    return c.rlike(f"(?i){WORD_START}\\Q{keyword}\\E")


CODE = r"(?m)^[ \t]*(?:```|~~~)[\s\S]*?^[ \t]*(?:```|~~~)[ \t]*$|`[^`\n]+`"


def clean_page(c: Column) -> Column:
    """Main text of a page: blocks of code and style, tags, pictures and link targets out, one blank line at most."""
    return F.btrim(F.regexp_replace(_tidied(c), r" ?\n(?: ?\n)+ ?", "\n\n"), F.lit(" \n\r\t"))


def _tidied(c: Column) -> Column:
    for pattern, to in (
        (r"(?is)<(script|style|svg)\b.*?</(?:script|style|svg)>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]+>", " "),
        (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    ):
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(c, r"[ \t]+", " ")


def clean_markdown(c: Column) -> Column:
    """The same of a page's markdown, in which code, fenced or in a line, stays as it is."""
    parts = F.regexp_extract_all(c, F.lit(rf"{CODE}|(?:(?!{CODE})[\s\S])+"), 0)
    tidy = F.transform(parts, lambda p: F.when(p.rlike(f"^(?:{CODE})"), p).otherwise(F.regexp_replace(_tidied(p), r"(?<=\n) | (?=\n)", "")))
    return F.btrim(F.regexp_replace(F.array_join(tidy, ""), r"\n{3,}", "\n\n"), F.lit(" \n\r\t"))

