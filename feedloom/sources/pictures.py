"""Fingerprints of pictures, and posts told alike by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``digest`` (32 hex digits) of every file: equal bytes, equal digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.substring(F.sha2("content", 256), 1, 32).alias("digest"))


def by_digests(posts: DataFrame, known: DataFrame) -> DataFrame:
    """``posts`` (pos, images) with ``pictures``: the digests of its images in order, null if one isn't known, '' without any.

    ``known``: url, digest.  Posts whose pictures aren't known are never taken for others.
    """
    rows = posts.select("pos", F.posexplode("images").alias("at", "url")).join(known.select("url", "digest").dropDuplicates(["url"]), "url", "left")
    digests = rows.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("all"), F.count_if(F.col("digest").isNull()).alias("lost"))
    told = digests.select("pos", F.when(F.col("lost") == 0, F.array_join(F.transform("all", lambda x: x["digest"]), " ")).alias("_told"))
    return posts.join(told, "pos", "left").withColumn("pictures", F.when(F.size("images") == 0, "").otherwise(F.col("_told"))).drop("_told")


def told_apart(posts: DataFrame, stored: DataFrame, look_up: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``posts`` and ``stored`` (words, images and more) with ``key``: null without words and pictures, else what says and shows the same.

    Pictures are the same by address or by digest.  Digests are asked for in a
    second step, ``look_up`` of distinct ``url``s giving ``url`` and ``digest``, and only
    of posts whose words another post has with other pictures; a post with
    a picture that has no digest is told by its addresses alone.
    """
    shown = F.sha2(F.to_json("images"), 256)
    both = posts.select("words", "images").union(stored.select("words", "images")).where("words is not null and size(images) > 0")
    met = both.groupBy("words").agg(F.min(shown).alias("lo"), F.max(shown).alias("hi")).where("lo <> hi").select("words")
    asked = both.join(met, "words", "left_semi").select("images").distinct()
    urls = asked.select(F.explode("images").alias("url")).distinct()
    known = asked.withColumn("pos", shown).transform(lambda rows: by_digests(rows, look_up(urls))).where("pictures is not null").select(F.col("pos").alias("_shown"), "pictures")
    words = F.coalesce("words", F.lit(""))

    def keyed(rows: DataFrame) -> DataFrame:
        found = rows.withColumn("_shown", shown).join(known, "_shown", "left")
        seen = F.when(F.size("images") == 0, "").otherwise(F.coalesce(F.concat(F.lit("d "), "pictures"), F.concat(F.lit("u "), "_shown")))
        return found.withColumn("key", F.when((words != "") | (F.size("images") > 0), F.sha2(F.concat_ws("|", words, seen), 256))).drop("_shown", "pictures")

    return keyed(posts), keyed(stored)
