"""Sharding by weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts of a shard that are numbered apart; shards x parts is all that is broadcast.
PARTS = 1024


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of ``key``: the one whose exponential draw, at its weight's rate, is first.

    The draw of a shard depends on the key and the shard's number alone, so a
    further shard can only take keys for itself.  A weight that isn't above 0 is an error.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a weight above 0")
    draws = []
    for shard, weight in enumerate(weights):
        h = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f"#{shard}"))), 11)
        u = (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("at"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*draws))["shard"] if len(draws) > 1 else F.lit(0)


def shard(docs: DataFrame, weights: Sequence[float], grown: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row of ``docs`` in one of ``len(weights)`` shards.

    Returns ``key``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``shard``,
    ``slot`` (0.. without gaps in each shard) and, with the weight ``grown`` of
    one more shard, ``grown_shard``.

    A null text counts as empty (size 1, checksum 0); texts of any length count
    whole; a null key is a key like any other; rows that repeat a key share a
    shard and get a slot each; an empty table gives an empty table; other columns
    of ``docs`` don't matter.  Slots are given inside (shard, part)
    groups, a part being a hash of the key, and shifted by the counts of the
    parts before, so no shard is sorted in one task.
    """
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    body = F.coalesce(F.col(text), F.lit(""))
    part = F.pmod(F.xxhash64(k, F.lit("part")), F.lit(PARTS)).cast("int")
    wide = [*weights, grown] if grown is not None else None
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(k, weights).alias("shard"),
        (rendezvous(k, wide) if wide else F.lit(None).cast("int")).alias("grown_shard"),
        part.alias("_part"),
    )
    counts = docs.select(rendezvous(k, weights).alias("shard"), part.alias("_part")).groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_part").orderBy(key, "text_crc32", "size")
    numbered = rows.withColumn("_at", F.row_number().over(inside))
    return numbered.join(F.broadcast(offsets), ["shard", "_part"]).select(
        key, "size", "text_crc32", "shard", (F.col("_before") + F.col("_at") - 1).cast("bigint").alias("slot"), "grown_shard"
    )
