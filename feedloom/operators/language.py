"""Texts for a model, in batches: which are worth asking about, what is known already, what ads and translations come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.functions import text as X
from feedloom.plans.numbering import numbered_along

# What a call holds, and what is too little or too much to ask about.
ADS_BATCH, ADS_CHARS = 20, 600
DETECT_BATCH, DETECT_CHARS = 25, 300
MAX_TRANSLATE_CHARS, MIN_LETTERS = 3000, 4


def worth_checking(text: Column) -> Column:
    """Letters enough once links, handles, tags and tickers are out."""
    words = F.regexp_replace(X.without_urls(text), r"[@#$][\p{L}\p{N}_]+", " ")
    return F.length(F.regexp_replace(words, r"[^\p{L}]", "")) >= MIN_LETTERS


def language_code(tag: Column) -> Column:
    """"zh-CN" is zh; null for what is no language code."""
    code = F.regexp_extract(F.lower(F.trim(tag)), r"^([^-_]*)", 1)
    return F.when(code.rlike("^[a-z]{2,3}$"), code)


def cache_key(system: str, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(system), F.lit("\0"), text), 256), 1, 16)


def split_by_cache(texts: DataFrame, cache: DataFrame, system: str, text: str = "text") -> DataFrame:
    """``texts`` with ``key`` and ``answer`` (null: to be asked); ``cache``: key, answer.

    Only hashes meet; equal texts are one question however often they are there.
    """
    return texts.withColumn("key", cache_key(system, F.col(text))).join(cache.select("key", "answer"), "key", "left")


def batches(texts: DataFrame, order: list[Column], size: int, chars: int, text: str = "text") -> DataFrame:
    """``batch``, ``k`` (1.. in it) and ``line`` of each text, in order."""
    at = numbered_along(texts, order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).withColumn("k", ((F.col("_n") - 1) % size + 1).cast("int"))
    line = F.concat(F.lit("["), F.col("k").cast("string"), F.lit("] "), X.collapse(F.substring(F.col(text), 1, chars)))
    return at.withColumn("line", line).drop("_n")


def judged(batch: DataFrame, replies: DataFrame) -> DataFrame:
    """``batch`` rows with ``ad``: what the reply says of them the first time, null where it doesn't.

    ``replies``: batch, at (place in the reply), n (what it numbers), ad.  A number out of the batch is nobody's; a
    call that failed has no rows, and its posts stay.
    """
    first = Window.partitionBy("batch", "n").orderBy("at")
    said = replies.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("batch", F.col("n").alias("k"), "ad")
    return batch.join(said, ["batch", "k"], "left")


def foreign(texts: DataFrame, accepted: list[str], lang: str = "lang", text: str = "text") -> DataFrame:
    """Texts in a language that isn't read, and whether they are short enough to be translated."""
    return texts.where(F.col(lang).isNotNull() & ~F.col(lang).isin(accepted)).withColumn("too_long", F.length(text) > MAX_TRANSLATE_CHARS)


def translations_by_language(found: DataFrame, lang: str = "lang") -> DataFrame:
    """``lang``, ``n``, ``place``: most common first, of equals by code."""
    counts = found.groupBy(lang).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), lang)))


def ads_by_account(ads: DataFrame) -> DataFrame:
    """``source``, ``n``, ``urls`` oldest first (undated first of all), ``first``: the account's place by its oldest ad."""
    order = F.struct(F.coalesce("published", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("at"), "id", "url")
    found = ads.groupBy("source").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(order)).alias("all"))
    return found.select("source", "n", F.transform("all", lambda x: x["url"]).alias("urls"), F.col("all")[0]["at"].alias("first"))


def block_list(lines: DataFrame, line: str = "value") -> DataFrame:
    """``handle`` of a plain list, a name a line."""
    name = F.lower(F.ltrim(F.trim(line), F.lit("@")))
    return lines.select(name.alias("handle")).where("handle <> ''").distinct()


def blocked(handles: DataFrame, listed: DataFrame, handle: str = "handle") -> DataFrame:
    """The handles that are on the list, case aside."""
    return handles.withColumn("_h", F.lower(handle)).join(listed.select(F.col("handle").alias("_h")), "_h", "left_semi").drop("_h")
