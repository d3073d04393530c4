"""What a model wrote, held against the posts it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.topics import END

#: Letters a capitalized word is compared by, and the marks that may stand around a word (fixed values).
STEM, MARKS = 4, r""".,;:!?()\[\]"'“”‘’"""

REPLY = "struct<items:array<struct<headline:string,detail:string,ids:array<bigint>>>>"


def parse_reply(raw: Column) -> Column:
    """Thoughts and code fences off, then JSON; null where it is none."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.from_json(bare, REPLY)


def reply_items(replies: DataFrame) -> DataFrame:
    """``chunk``, ``item``, ``headline``, ``detail``, ``ids`` of raw replies (``chunk``, ``raw``).

    A reply that was cut off mid-JSON is read as far as it goes: headlines,
    details and closed id lists in order, whichever of them an item still has.
    """
    string = r'"\s*:\s*"((?:[^"\\]|\\.)*)"'
    take = lambda pattern: F.regexp_extract_all("raw", F.lit(pattern), 1)
    numbers = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"\d+"), 0), lambda d: d.cast("bigint"))
    lists = F.transform(take(r'"ids"\s*:\s*\[([^\]]*)\]'), numbers)
    zipped = F.arrays_zip(take('"headline' + string).alias("headline"), take('"detail' + string).alias("detail"), lists.alias("ids"))
    parsed = parse_reply(F.col("raw"))["items"]
    whole = F.transform(parsed, lambda i: F.struct(i["headline"].alias("headline"), i["detail"].alias("detail"), i["ids"].alias("ids")))
    read = replies.select("chunk", F.coalesce(whole, zipped).alias("items"))
    return read.select("chunk", F.posexplode("items").alias("item", "i")).select("chunk", "item", "i.headline", "i.detail", "i.ids")


def chunk_stats(items: DataFrame, posts: DataFrame) -> DataFrame:
    """Per chunk: items, cited numbers (all, distinct, an item, at most), those in the chunk, share of the chunk's posts covered.

    ``items``: ``chunk``, ``item``, ``headline``, ``detail``, ``ids``; ``posts``: ``chunk``, ``n``.
    """
    sizes = posts.groupBy("chunk").agg(F.countDistinct("n").alias("posts"))
    heads = items.groupBy("chunk").agg(F.count("*").alias("items"), (F.count("*") - F.countDistinct(F.lower(F.trim("headline")))).alias("duplicate_headlines"), F.avg(F.regexp_count("detail", F.lit(r"\S+")).cast("double")).alias("detail_words"), F.avg(F.size("ids").cast("double")).alias("ids_per_item"), F.max(F.size("ids")).alias("max_ids"))
    cited = items.select("chunk", F.explode("ids").alias("n")).join(posts.select("chunk", "n").distinct().withColumn("_in", F.lit(1)), ["chunk", "n"], "left")
    ids = cited.groupBy("chunk").agg(F.count("*").alias("ids"), F.count("_in").alias("valid"), F.countDistinct("n").alias("cited"), F.countDistinct(F.when(F.col("_in") == 1, F.col("n"))).alias("covered"))
    found = sizes.join(heads, "chunk", "left").join(ids, "chunk", "left")
    return found.select(
        "chunk", "posts", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "duplicate_headlines", "ids", "valid")],
        F.round(F.coalesce(F.col("covered").cast("double") / F.col("posts"), F.lit(0.0)), 6).alias("coverage"),
        F.round(F.coalesce("detail_words", F.lit(0.0)), 6).alias("detail_words"),
        F.round(F.coalesce("ids_per_item", F.lit(0.0)), 6).alias("ids_per_item"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("max_ids", "cited")],
    )


def _mid_sentence(part: Column) -> Column:
    """Capitalized words that don't open the part or a sentence, without the marks around them."""
    words = F.filter(F.split(part, r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(w, f"^[{MARKS}]+|[{MARKS}]+$", "")
    inner = F.transform(words, lambda w, i: F.when((i > 0) & ~F.get(words, i - 1).rlike(r"[.!?]$"), bare(w)).otherwise(""))
    return F.filter(inner, lambda w: w.rlike("^[A-Z][a-z]{3,}$"))


def support(items: DataFrame, posts: DataFrame) -> DataFrame:
    """Per item: facts (numbers, handles, tickers), names (acronyms, capitalized words), and how many of each no cited post has.

    ``items``: ``item``, ``headline``, ``detail``, ``ids``; ``posts``: ``n``, ``text``.  Numbers are
    compared without thousands commas and whole; handles, tickers and acronyms
    as parts of the text in any case; capitalized words by their first STEM letters.
    """
    evidence = items.select("item", F.explode("ids").alias("n")).join(posts.select("n", F.col("text").alias("post")), "n").groupBy("item").agg(F.array_join(F.array_sort(F.collect_list("post")), " ").alias("cited"))
    checked = items.withColumn("text", F.concat("headline", F.lit(" "), "detail")).join(evidence, "item", "left").withColumn("cited", F.coalesce("cited", F.lit("")))
    low, plain = F.lower("cited"), F.replace(F.col("cited"), F.lit(","), F.lit(""))
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"\d[\d,]*(?:\.\d+)?"), 0), lambda m: F.replace(m, F.lit(","), F.lit("")))
    known = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?<![\d.])\d+(?:\.\d+)?"), 0))
    # a number with decimals is supported whole, and by its integer part where no digit follows
    has = lambda x: F.exists("_known", lambda k: (k == x) | F.startswith(k, F.concat(x, F.lit("."))))
    marks = F.concat(F.regexp_extract_all("text", F.lit(r"@\w{2,}"), 0), F.regexp_extract_all("text", F.lit(r"\$[A-Za-z]{1,6}" + END), 0))
    acronyms = F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])[A-Z]{2,}" + END), 0)
    capitals = F.concat(_mid_sentence(F.col("headline")), _mid_sentence(F.col("detail")))
    made = checked.withColumns({"_low": low, "_known": known, "_numbers": numbers, "_marks": marks, "_acronyms": acronyms, "_capitals": capitals})
    absent = lambda x: ~F.contains(F.col("_low"), F.lower(x))
    many = lambda *lists: sum(map(F.size, lists[1:]), F.size(lists[0])).cast("bigint")
    return made.select(
        "item", many("_numbers", "_marks").alias("facts"), many(F.filter("_numbers", lambda x: ~has(x)), F.filter("_marks", absent)).alias("unsupported_facts"),
        many("_acronyms", "_capitals").alias("names"), many(F.filter("_acronyms", absent), F.filter("_capitals", lambda x: absent(F.substring(x, 1, STEM)))).alias("unsupported_names"),
        (F.col("cited") == "").alias("uncited"),
    )


def truncation_suspects(runs: DataFrame, ratio: float = 1.3, least: int = 3, big: float = 0.6) -> DataFrame:
    """Big runs whose characters a token are over ``ratio`` times the median of the big ones.

    Big are those of at least ``big`` of the most characters; with fewer than
    ``least`` of them nothing is told.
    """
    counted = runs.where("tokens > 0")
    most = counted.agg(F.max("chars").alias("_most"))
    rated = counted.crossJoin(F.broadcast(most)).where(F.col("chars") >= F.col("_most") * big).drop("_most").withColumn("ratio", F.col("chars").cast("double") / F.col("tokens"))
    middle = rated.agg(F.median("ratio").alias("median"), F.count("*").alias("runs"))
    return rated.crossJoin(F.broadcast(middle)).where((F.col("runs") >= least) & (F.col("ratio") > F.col("median") * ratio)).drop("median", "runs")
