"""The numbered window for a model: order, lines, chunks, and media by weight."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.functions import text as X
from feedloom.plans.numbering import numbered_along

LIMITS = {"regular": 400, "retweet": 220, "recap": 220}
BAND_ORDER = {"regular": 1, "retweet": 2, "recap": 3}
SHARES = {"regular": 0.25, "retweet": 0.04, "recap": 0.16}
LEVEL_FACTORS = {"high": 1.5, "normal": 1.0, "low": 0.5}
WORDS_PER_ITEM = {"regular": 30, "retweet": 30, "recap": 40}
MAX_THEMES = {"retweet": 8, "recap": 20}
MIN_SHARES = {"regular": 0.25, "retweet": 0.25, "recap": 0.5}
CHUNK_CHARS, MIN_TARGET_WORDS = 13_500, 20


def lookup(table: dict, key: Column, default=None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def numbered(items: DataFrame, priority: Column) -> DataFrame:
    """Export posts with their number ``n`` in reading order; needs ``tier``, ``section``.

    Undated posts come first of their source.  Posts are numbered along ranges of
    the order, so no section is sorted in one task.
    """
    shown = items.where(F.col("tier").isin(*LIMITS))
    order = [F.col("section"), lookup(BAND_ORDER, F.col("tier")).alias("band"), (~priority).alias("later"), F.lower("source").alias("low"), F.col("source"), F.col("published"), F.col("id")]
    return numbered_along(shown, order)


def line(limit: Column) -> Column:
    tag = F.when(F.col("retweet_of_author") == "", "").when(F.col("pure"), F.concat(F.lit("RT@"), "retweet_of_author", F.lit(" "))).otherwise(F.concat(F.lit("QT@"), "retweet_of_author", F.lit(" ")))
    return F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "source", F.lit(" "), tag, X.flat(F.col("own"), F.col("pure"), limit))


def pack(posts: DataFrame, stream: list[str], budget: int = CHUNK_CHARS) -> DataFrame:
    """Consecutive posts of a stream in as few parts as fit the budget; adds ``part`` (1..).

    A post costs its line and a newline, and its section's heading where it opens
    one.  Each part's start depends on the part before: one stream is one task's.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        part, used, section, out = 1, 0, None, []
        for size, name in zip(rows["line"].str.len(), rows["section"]):
            cost = size + 1 + (len(name) + 5 if name != section else 0)
            if used and used + cost > budget:
                part, used = part + 1, 0
                cost = size + 1 + len(name) + 5
            out.append(part)
            used += cost
            section = name
        return pd.DataFrame({"n": rows["n"].to_numpy(), "part": out})

    packed = posts.select(*stream, "n", "line", "section").groupBy(*[F.col(c).alias(f"_{c}") for c in stream]).applyInPandas(run, "n bigint, part bigint")
    return posts.join(packed, "n")


def item_limits(tier: Column, words: Column, posts: Column) -> dict[str, Column]:
    """``max_items``, ``min_items``, ``max_ids`` of a chunk with this allowance of words."""
    items = F.bround(words.cast("double") / lookup(WORDS_PER_ITEM, tier)).cast("bigint")
    items = F.least(items, lookup(MAX_THEMES, tier).cast("bigint"))
    most = F.greatest(F.lit(1).cast("bigint"), F.least(items, posts))
    return {"max_items": most, "min_items": F.greatest(F.lit(1).cast("bigint"), F.ceil(most * lookup(MIN_SHARES, tier)).cast("bigint")), "max_ids": F.when(tier == "recap", F.lit(5).cast("bigint"))}


def target_words(tier: Column, level: Column, words: Column, share: Column | None = None) -> Column:
    """Words a chunk's summary may have; ``share`` of its words in place of its tier's."""
    share = (lookup(SHARES, tier) if share is None else share) * lookup(LEVEL_FACTORS, level, 1.0)
    return F.greatest(F.lit(MIN_TARGET_WORDS).cast("bigint"), F.bround(share.cast("double") * words).cast("bigint"))


def rank_media(items: DataFrame, level: Column) -> DataFrame:
    """Picture posts in the order they get room (``rank``): sections in turn by weight, sources in turn, newest first.

    A section's turns are pos / weight, which grows with pos, so taking the least
    again and again is one sort.
    """
    newest = [F.desc_nulls_last("published"), F.col("id")]
    own = Window.partitionBy("section", "source").orderBy(*newest)
    turn = items.withColumn("_turn", F.row_number().over(own)).withColumn("_newest", F.max("published").over(Window.partitionBy("section", "source"))).withColumn("_level", level)
    inside = Window.partitionBy("section").orderBy("_turn", F.desc_nulls_last("_newest"), "source", "id")
    placed = turn.withColumn("_pos", F.row_number().over(inside)).withColumn("_count", F.count("*").over(Window.partitionBy("section")))
    weight = lookup(LEVEL_FACTORS, F.col("_level"), 1.0) * F.col("_count")
    return numbered_along(placed, [(F.col("_pos") / weight).alias("at"), F.col("section")], "rank").drop("_turn", "_newest", "_pos", "_count", "_level")
