"""Main text of web pages: a page's tree by text and link density, its best node and the neighbours that read like it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What elements are, and how much of a block may be links.
NODES = {"body", "div", "article", "main", "section", "td", "table", "ul", "ol", "dl", "nav", "header", "footer", "aside", "form", "blockquote"}
BREAKS = NODES | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "th", "dt", "dd", "pre", "hr", "figure", "figcaption"}
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "button", "select", "textarea"}
BESIDE = {"nav", "footer", "aside", "form"}
BESIDE_NAMES = re.compile(r"(?i)\b(?:ads?|advert\w*|promo|sponsor\w*|sidebar|comments?|share|social|cookies?|newsletter|related|breadcrumbs?|menu|footer)\b")
DATED = {"article:published_time", "datepublished", "date", "dc.date", "pubdate"}
LEAST_BLOCK, MOST_LINKS, LIKE_BEST = 25, 0.5, 0.2

#: A reference without its semicolon, which HTML decodes all the same: a title that was cut after it was escaped ends so.
BARE = re.compile(r"&(?=(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+)(?![A-Za-z0-9;]))")

FIELDS = "title string, author string, site string, published string, text string, blocks int"


class Page(HTMLParser):
    """One page's blocks: text between breaks, the node it stands in, how much of it is links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.nodes: list[tuple[int, bool]] = []  # parent, beside the main text
        self.inside: list[int] = []
        self.blocks: list[tuple[int, str, int]] = []
        self.said: list[str] = []
        self.linked = 0
        self.titles: list[str] = []
        self.meta: dict[str, str] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault((own.get("property") or own.get("name") or own.get("itemprop") or "").lower(), own.get("content", ""))
        elif tag == "time" and own.get("datetime"):
            self.meta.setdefault("time", own["datetime"])
        elif tag == "br":
            self.said.append(" ")
        if tag in BREAKS:
            self.block()
        if tag == "p" and "p" in self.open:  # a paragraph ends where the next one begins
            self.handle_endtag("p")
        if tag in ("meta", "br", "hr", "img", "input", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"):
            return
        self.open.append(tag)
        if tag in NODES:
            above = self.inside[-1] if self.inside else -1
            off = tag in BESIDE or bool(BESIDE_NAMES.search(f"{own.get('class', '')} {own.get('id', '')}".replace("_", " ").replace("-", " ")))
            self.nodes.append((above, off or (above >= 0 and self.nodes[above][1])))
            self.inside.append(len(self.nodes) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        if tag in BREAKS:
            self.block()
        while self.open:
            ended = self.open.pop()
            if ended in NODES:
                self.inside.pop()
            if ended == tag:
                break

    def handle_data(self, data: str) -> None:
        if "title" in self.open and "svg" not in self.open:
            self.titles.append(data)
        elif not SILENT.intersection(self.open) and "head" not in self.open:
            self.said.append(data)
            if "a" in self.open:
                self.linked += len(" ".join(data.split()))

    def block(self) -> None:
        text, links = " ".join("".join(self.said).split()), self.linked
        self.said, self.linked = [], 0
        if text:
            self.blocks.append((self.inside[-1] if self.inside else -1, text, links))

    def main(self) -> list[str]:
        """Blocks of the best node and of those beside it that score a share of it, in order.

        A block scores its letters less twice those of links, if it is long
        enough and mostly text, for the node it stands in, and half for the
        one above.
        """
        scores: dict[int, float] = {}
        for node, text, links in self.blocks:
            if node >= 0 and not self.nodes[node][1] and len(text) >= LEAST_BLOCK and links <= MOST_LINKS * len(text):
                scores[node] = scores.get(node, 0) + len(text) - 2 * links
                above = self.nodes[node][0]
                if above >= 0:
                    scores[above] = scores.get(above, 0) + (len(text) - 2 * links) / 2
        fine = [(node, text) for node, text, links in self.blocks if (node < 0 or not self.nodes[node][1]) and links <= MOST_LINKS * len(text)]
        if not scores:
            return [text for _, text in fine]
        best = max(scores, key=lambda n: (scores[n], -n))
        like = {n for n, s in scores.items() if n == best or (self.nodes[n][0] == self.nodes[best][0] and s >= LIKE_BEST * scores[best])}
        within = {n: n in like for n in range(len(self.nodes))}
        for n, (above, _) in enumerate(self.nodes):  # parents come first
            within[n] = within[n] or within.get(above, False)
        return [text for node, text in fine if within.get(node, False)]


def _read(html: str, bare: bool = True) -> dict:
    page = Page()
    page.feed(html if bare else BARE.sub("&amp;", html))
    page.close()
    page.block()
    flat = lambda x: " ".join(x.split())
    first = lambda names: next((flat(page.meta[n]) for n in names if flat(page.meta.get(n, ""))), "")
    text = page.main()
    return {
        "title": first(["og:title"]) or flat("".join(page.titles)), "author": first(["author", "article:author"]), "site": first(["og:site_name", "application-name"]),
        "published": first([*sorted(DATED), "time"]), "text": "\n\n".join(text), "blocks": len(text),
    }


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", bare: bool = True) -> DataFrame:
    """``key``, ``title``, ``author``, ``site`` (else the host), ``published`` (YYYY-MM-DD), ``text`` and its ``blocks`` of every page.

    Each page is read by itself where it lies, so nothing is shuffled.  A null
    or empty page has an empty title and text; pages are read whole; broken
    markup is read as far as it makes sense; other columns don't matter.
    References without a semicolon are decoded, as HTML has it; without ``bare`` they stay as they are.
    """
    kind = dict(pages.dtypes)[key]
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32() if n == "blocks" else pa.string() for n in names]
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = [_read(h or "", bare) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("url"), *(pa.array([f[n] for f in found], t) for n, t in zip(names, types))], ["key", "url", *names])

    read = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, f"key {kind}, url string, {FIELDS}")
    day = F.regexp_extract("published", r"^\d{4}-\d\d-\d\d", 0)
    return read.select(F.col("key").alias(key), "title", "author", F.when(F.col("site") != "", F.col("site")).otherwise(host(F.col("url"))).alias("site"), F.nullif(day, F.lit("")).alias("published"), "text", "blocks")


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:www\.)?([^/:?#]+)", 1)), F.lit(""))
