"""Names mentioned far above their usual number of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.functions.text import collapse, unescape, without_urls
from feedloom.plans.lineage import checkpointed

MIN_SOURCES, MIN_POSTS, MIN_SCORE, TOP, MIN_DAY_POSTS = 3, 6, 2.5, 8, 100
#: Words that are never a name (fixed values).
STOP = """
the and for with that this from have has are was were will would could should about into over after before just what when
where which while their there they them then than been being also more most some such only very much many other another
because between during through against without within upon your you our out get got new now today via per its here these
those one two how why who not but yes not all any can did does done off own say says said see seen use used way too
monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october
november december http https www com retweeted breaking news thread update alert live watch exclusive
""".split()

EDGE, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def cleaned(text):
    return collapse(without_urls(unescape(text)))


def candidates(posts: DataFrame) -> DataFrame:
    """``post``, ``key``, ``raw``, ``sure``: a name once a post, surely one if any spelling of it is.

    ``posts`` has ``post``, ``text`` (cleaned) and whatever else should stay.  The
    spelling is the first sure one, else the first.
    """
    tag = F.transform(F.regexp_extract_all("text", F.lit(r"\$[A-Za-z][A-Za-z0-9]{1,9}" + END), 0), lambda m: F.struct(F.substring(m, F.lit(2), F.length(m)).alias("raw"), F.lit(True).alias("sure")))
    name = F.transform(F.regexp_extract_all("text", F.lit(EDGE + r"[A-Z][A-Za-z0-9]{2,}" + END), 0), lambda m: F.struct(m.alias("raw"), (F.upper(m) == m).alias("sure")))
    others = [c for c in posts.columns if c != "text"]
    found = posts.select(*others, F.posexplode(F.concat(tag, name)).alias("at", "m")).select(*others, "at", F.lower("m.raw").alias("key"), "m.raw", "m.sure").where(~F.col("key").isin(STOP))
    first = F.struct((~F.col("sure")).alias("unsure"), "at", "raw")
    return found.groupBy(*others, "key").agg(F.min(first).alias("f")).select(*others, "key", F.col("f.raw").alias("raw"), (~F.col("f.unsure")).alias("sure"))


def names(posts: DataFrame, within: list[str] | None = None) -> DataFrame:
    """The candidates that are names: sure ones, and words hardly ever written in lower case in the same window.

    ``within`` names columns that divide the posts into windows (a day, say).
    """
    within = within or []
    lower = posts.select(*within, F.explode(F.regexp_extract_all("text", F.lit(EDGE + r"[a-z][a-z0-9]{2,}" + END), 0)).alias("key")).groupBy(*within, "key").agg(F.count("*").alias("low"))
    found = checkpointed(candidates(posts))
    weak = found.groupBy(*within, "key").agg(F.sum(F.when(~F.col("sure"), 1).otherwise(0)).alias("weak"))
    kept = weak.join(lower, [*within, "key"], "left").select(*within, "key", "weak", F.coalesce("low", F.lit(0)).alias("low"))
    return found.join(kept, [*within, "key"]).where(F.col("sure") | (F.col("low") * 4 <= F.col("weak"))).drop("weak", "low")


def usage_baseline(posts: DataFrame) -> DataFrame:
    """``key``, ``usual``: posts an ordinary day, over the days with enough posts; needs ``day``."""
    days = posts.groupBy("day").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DAY_POSTS)
    counted = names(posts.join(days.select("day"), "day"), ["day"]).groupBy("key").agg(F.count("*").alias("total"))
    return counted.crossJoin(F.broadcast(days.agg(F.count("*").alias("days")))).select("key", (F.col("total").cast("double") / F.col("days")).alias("usual"))


def hot_topics(found: DataFrame, usual: DataFrame, min_sources: int = MIN_SOURCES, min_posts: int = MIN_POSTS, min_score: float = MIN_SCORE, top: int = TOP) -> DataFrame:
    """The ``top`` names furthest above what is usual; ``found`` has ``account``, ``section``, ``key``, ``raw``."""
    counts = found.groupBy("key").agg(F.count("*").alias("posts"), F.countDistinct("account").alias("sources"))
    scored = counts.join(usual, "key", "left").withColumn("usual", F.coalesce("usual", F.lit(0.0))).withColumn("score", F.col("posts") / (1 + F.col("usual")))
    hot = scored.where((F.col("sources") >= min_sources) & (F.col("posts") >= min_posts) & (F.col("score") >= min_score))
    return hot.orderBy(F.desc("score"), F.desc("posts"), "key").limit(top)


def most_common(found: DataFrame, value: str, first: str | None = None) -> DataFrame:
    """Each name's most used ``value``; of equals the first in order, or the one seen first along the column ``first``."""
    counts = found.groupBy("key", value).agg(F.count("*").alias("n"), *([F.min(first).alias("_seen")] if first else []))
    w = Window.partitionBy("key").orderBy(F.desc("n"), "_seen" if first else value, value)
    return counts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_seen")
