"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import join_split, stored

#: Characters of a text that the second level hashes.
PREFIX_CHARS = 64

#: Bits of the map that marks surviving groups, in blocks of BLOCK: 4 MB at most, whatever the input.
BITS, BLOCK = 1 << 25, 1 << 15


def _marks(keys: DataFrame) -> DataFrame:
    """Which values of ``h`` occur twice or more, as a bit map of fixed size: (block, bits)."""
    at = F.pmod(F.col("h"), F.lit(BITS))
    return (
        keys.where(F.col("h").isNotNull()).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
        .groupBy(F.floor(at / F.lit(BLOCK)).cast("int").alias("block"))
        .agg(F.bitmap_construct_agg(F.pmod(at, F.lit(BLOCK))).alias("bits"))
    )


def _survives(docs: DataFrame, marks: DataFrame, h: Column, flag: str) -> DataFrame:
    """``docs`` with ``flag``: its group under ``h`` may hold another row.  A false alarm costs one more hash."""
    wide = docs.withColumn("_h", h).withColumn("_block", F.floor(F.pmod(F.col("_h"), F.lit(BITS)) / F.lit(BLOCK)).cast("int"))
    found = wide.join(F.broadcast(marks.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))), "_block", "left")
    test = F.expr(
        f"_bits is not null and (shiftright(cast(conv(hex(substring(_bits, cast(pmod(_h, {BLOCK}) div 8 as int) + 1, 1)), 16, 10) as int), cast(pmod(_h, 8) as int)) & 1) = 1"
    )
    return found.withColumn(flag, test).drop("_h", "_block", "_bits")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Groups of equal texts; the row with the largest ``key`` of each stays.

    Returns one row per row of ``docs``: ``key``, ``keep_id``, ``group_size``,
    ``kept`` and ``full_hash`` (SHA-256; null where the row was alone after the
    length or prefix level and its whole text was never hashed).  With
    ``digest`` a column ``text_sha256`` of every text is added.

    Each level reads the groups the one before left over; what survives is told
    by a bit map of fixed size, so no text is shuffled.  A null text counts as
    empty; empty texts equal each other; texts of any length are hashed whole;
    rows that repeat a key and text stand or fall together; an empty table gives
    an empty table; other columns of ``docs`` don't matter, and ``key`` may have the
    name of a column that is returned.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("_key"), body.alias("_text"))
    length = F.xxhash64(F.octet_length("_text"))
    prefix = F.xxhash64(F.octet_length("_text"), F.substring("_text", 1, PREFIX_CHARS))

    by_length = _marks(base.select(length.alias("h")))
    level2 = _survives(base, by_length, length, "_same_length")
    by_prefix = _marks(level2.select(F.when(F.col("_same_length"), prefix).alias("h")))
    level3 = _survives(base, by_prefix, prefix, "_same_prefix")
    sha = F.sha2(F.col("_text"), 256)
    columns = [F.col("_key"), F.when(F.col("_same_prefix"), sha).alias("full_hash")]
    if digest:
        columns.append(sha.alias("text_sha256"))
    rows = stored(level3.select(*columns), "exact")

    groups = (
        rows.where(F.col("full_hash").isNotNull()).groupBy("full_hash")
        .agg(F.max("_key").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    )
    keyed = rows.withColumn("_join", F.coalesce("full_hash", F.concat(F.lit("row "), F.col("_key").cast("string")), F.lit("row")))
    joined = join_split(keyed, groups.withColumnRenamed("full_hash", "_join"), "_join")
    keep = F.coalesce("keep_id", F.col("_key"))
    return joined.select(
        F.col("_key").alias(key), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("_key").eqNullSafe(keep).alias("kept"), "full_hash", *(["text_sha256"] if digest else []),
    )
