"""Rules over posts: tiers, filters in their order, duplicates, threads, silence, windows of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.functions import text as X
from feedloom.plans.lineage import checkpointed


def with_words(items: DataFrame) -> DataFrame:
    """Adds ``own``, ``pure`` and ``words``, computed once for whatever follows.

    The two texts that an echo is told by are columns of their own first: a
    projection that is used more than once isn't folded into the next, so each
    is made once a row, and only for rows that share a post.
    """
    compared = items.withColumns({"_a": F.when(X.shares(), X.comparable(X.body())), "_b": F.when(X.shares(), X.comparable(F.col("retweet_of_text")))})
    own = compared.withColumn("own", F.when(X.shares() & X.echoes(F.col("_a"), F.col("_b")), "").otherwise(X.body())).drop("_a", "_b")
    return own.withColumn("pure", X.is_pure_retweet(F.col("own"))).withColumn("words", X.word_count(X.display_body(F.col("own"))))


def tier_of(priority: Column, recap: Column) -> Column:
    """First rule that holds: priority, media, recap, retweet, regular."""
    back = F.coalesce(F.col("after_silence"), F.lit(False)) & ~F.col("pure")
    return F.when(priority | back, "priority").when(F.size("images") > 0, "media").when(recap, "recap").when(F.col("pure"), "retweet").otherwise("regular")


def silence(posts: DataFrame, source: str, ts: str, gap: str, history_start: Column | None = None) -> DataFrame:
    """Adds ``after_silence``: the source's last earlier post (equal times don't count) is over ``gap`` before.

    The frame ends a microsecond before the row, which makes it a strict as-of
    join with the source's own past in one shuffle.
    """
    earlier = F.expr(f"max({ts}) over (partition by {source} order by {ts} range between unbounded preceding and interval '0.000001' second preceding)")
    previous = F.coalesce(earlier, history_start) if history_start is not None else earlier
    return posts.withColumn("previous", earlier).withColumn("after_silence", F.coalesce(F.col(ts) > previous + F.expr(f"interval {gap}"), F.lit(False)))


def window_since(items: DataFrame, since: str) -> DataFrame:
    return items.where(F.coalesce("published", "fetched_at") >= F.lit(since).cast("timestamp_ntz"))


def window_between(items: DataFrame, since: str, until: str, fetched_by: str | None = None) -> DataFrame:
    at = F.coalesce("published", "fetched_at")
    found = items.where((at >= F.lit(since).cast("timestamp_ntz")) & (at < F.lit(until).cast("timestamp_ntz")))
    return found.where(F.col("fetched_at") <= F.lit(fetched_by).cast("timestamp_ntz")) if fetched_by else found


def window_since_run(items: DataFrame, since: str) -> DataFrame:
    return items.where(F.col("fetched_at") >= F.lit(since).cast("timestamp_ntz"))


def post_times(items: DataFrame, since: str) -> DataFrame:
    """Per source its times from ``since`` on, and the last one before, ascending."""
    bound = F.lit(since).cast("timestamp_ntz")
    dated = items.where(F.col("published").isNotNull()).select("source", "published")
    last = dated.where(F.col("published") < bound).groupBy("source").agg(F.max("published").alias("published"))
    return dated.where(F.col("published") >= bound).unionByName(last).groupBy("source").agg(F.sort_array(F.collect_list("published")).alias("times"))


def take_while(rows: DataFrame, source: str, pos: Column, old: Column) -> DataFrame:
    """Rows of a source before its first old one in reading order; newer ones after it are lost too."""
    w = Window.partitionBy(source).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_ended", F.max(F.coalesce(old, F.lit(False))).over(w)).where(~F.col("_ended")).drop("_ended")


def with_fallback(kept: DataFrame, everything: DataFrame, source: str, order: list[Column]) -> DataFrame:
    """``kept``, and the first row of every source that has none in it."""
    first = everything.withColumn("_rn", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where("_rn = 1").drop("_rn")
    return kept.unionByName(first.join(kept.select(source).distinct(), source, "left_anti"))


def drop_reason(hide: list[str], only_sources: Column, only: list[str]) -> Column:
    """Why a post is dropped, the first rule that holds; null if it stays."""
    parts = [F.col("title"), F.col("full_text"), F.col("retweet_of_text")]
    said = lambda words: F.lit(False) if not words else _any([X.mentions(F.coalesce(p, F.lit("")), w) for w in words for p in parts])
    retweet = F.startswith(F.col("title"), F.lit("RT by @")) | F.startswith(F.col("title"), F.lit("RT @"))
    target = F.lower(F.regexp_extract("title", r"^R to @([^:\s]+)", 1))
    to_self = (target == F.lower("author")) | (F.concat(F.lit("@"), target) == F.lower("source"))
    reply = F.startswith(F.col("title"), F.lit("R to @")) & ~to_self
    return (
        F.when(F.coalesce(F.col("thread_reply"), F.lit(False)), "thread replies")
        .when(retweet & ~F.coalesce(F.col("reposts"), F.lit(True)), "retweets").when(reply, "replies")
        .when(said(hide), "hidden keywords").when(only_sources & ~said(only), "outside only:")
    )


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def thread_replies(posts: DataFrame, stored_ids: DataFrame | None = None) -> DataFrame:
    """Adds ``thread_reply``: the root is in the batch or stored, or an older reply to the same root is.

    Needs ``status``, ``thread_root`` ('' for none), ``published`` and ``pos``.
    """
    shown = posts.select(F.col("status").alias("thread_root"))
    if stored_ids is not None:
        shown = shown.unionByName(stored_ids.select(F.col("status").alias("thread_root")))
    shown = shown.distinct().withColumn("_shown", F.lit(True))
    oldest = Window.partitionBy("thread_root").orderBy(F.asc_nulls_first("published"), "pos")
    replies = posts.where("thread_root <> ''").join(shown, "thread_root", "left").withColumn("_rn", F.row_number().over(oldest))
    replies = replies.withColumn("thread_reply", F.coalesce("_shown", F.lit(False)) | (F.col("_rn") > 1)).drop("_shown", "_rn")
    return posts.where("thread_root = ''").withColumn("thread_reply", F.lit(False)).unionByName(replies.select(*posts.columns, "thread_reply"))


def duplicates(posts: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``outcome``: kept, duplicates (of a kept row before it) or repeats (of a stored row with another status).

    Needs ``key`` (null exempts a row), ``status``, ``pos``; ``stored`` has ``key`` and
    ``status``.  The stored side is reduced to the least and greatest status of a
    key first, so no key brings more than one row: another status exists unless
    both are the row's own.
    """
    posts = checkpointed(posts)  # keys are read three times, and dear to make
    known = stored.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("status").alias("_low"), F.max("status").alias("_high"))
    rows = posts.join(known, "key", "left")
    keepable = F.col("_low").isNull() | ((F.col("_low") == F.col("status")) & (F.col("_high") == F.col("status")))
    rows = rows.withColumn("_keepable", keepable)
    first = rows.where("_keepable and key is not null").groupBy("key").agg(F.min("pos").alias("_first"))
    outcome = (
        F.when(F.col("key").isNull(), "kept").when(F.col("_first").isNull() | (F.col("pos") < F.col("_first")), "repeats")
        .when(F.col("pos") == F.col("_first"), "kept").otherwise("duplicates")
    )
    return rows.join(first, "key", "left").withColumn("outcome", outcome).drop("_low", "_high", "_keepable", "_first")


def filtered(items: DataFrame, reason: Column, key: Column, stored: DataFrame) -> DataFrame:
    """``items`` (status, pos) with ``reason``: the first rule that drops a post, then duplicates and repeats among what is left; null: kept.

    ``reason`` is what ``drop_reason`` gives, ``key`` what ``duplicates`` tells posts alike by.
    """
    rows = checkpointed(items.withColumns({"reason": reason, "key": key}))
    left = duplicates(rows.where("reason is null").select("pos", "status", "key"), stored).where("outcome <> 'kept'")
    found = rows.join(left.select("pos", "outcome"), "pos", "left")
    return found.withColumn("reason", F.coalesce("reason", "outcome")).drop("outcome", "key")


def insert_or_ignore(batch: DataFrame, table: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """Rows of ``batch`` that an insert adds: the first of each key, unless stored."""
    first = batch.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rn = 1").drop("_rn")
    return first.join(table.select(key), key, "left_anti")


def forget(items: DataFrame, before: str) -> DataFrame:
    return items.where(F.col("fetched_at") >= F.lit(before).cast("timestamp_ntz"))


def within_horizon(items: DataFrame, horizon: str) -> DataFrame:
    """Undated rows always stay."""
    return items.where(F.col("published").isNull() | (F.col("published") >= F.lit(horizon).cast("timestamp_ntz")))


def upsert(state: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Latest version of every key; of equal versions the change wins."""
    both = state.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")
