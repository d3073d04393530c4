"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.common import WORD, join_small, stored, unit

#: Parts of the order of a source that are summed before any row is looked at: so many at least, and the root of all
#: rows.  One task sees a source's parts, one the rows of the part where it is cut, so neither grows faster than the root.
PARTS = 1024

#: Passes over the order: later ones fill what the first left with texts that still fit.
PASSES = 4


def targets(sizes: DataFrame, weights: Sequence[float], total: float, cap: float) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row a source.

    Sources by code point, null last, weigh ``weights`` in turn.  They share
    ``total`` times all sizes; none gets over ``cap`` times its own, the excess
    being shared by weight among the rest until none is above: the level at which
    that ends is found from running sums in the order of cap over weight.  From the
    first source that stays below its cap on the levels only fall, so the highest
    counts; sources that tie in cap over weight share it.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.array(*[F.lit(float(w)) for w in weights])
    all_rows = Window.partitionBy()
    before = Window.orderBy("fill", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    w = (
        sizes.withColumn("weight", F.element_at(pick, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("fill", F.col("most") / F.col("weight"))
    )
    w = (
        w.withColumn("pool", F.lit(float(total)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.when(F.col("fill") > F.col("pool") / F.col("rest"), F.col("pool") / F.col("rest")))
        .withColumn("level", F.max("level").over(all_rows))
    )
    return w.select("source", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float], total: float = 1.5, cap: float = 2.0, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source", importance: str | None = None) -> DataFrame:
    """How many copies of every row the mix takes.

    Returns ``key``, ``source``, ``size`` (words), ``source_size``, ``target`` and
    ``copies``.  A row's expected copies are target over source size (times its
    ``importance`` relative to the size-weighted mean of its source, at most
    ``cap``).  Whole copies are certain; the rest is its inclusion probability
    p.  Rows are ranked by (u / (1 - u)) / (p / (1 - p)), u being a uniform
    number of the key alone, and taken in this order up to the words that the
    source still needs; PASSES - 1 further passes fill the gap before a text too
    long with later ones that fit.

    Null text: size 0, taken or not without effect; texts of any length are counted
    whole.  A null source is a source, listed last.  Ties of u break by key; rows
    that repeat a key share its draw and are ranked side by side; an empty table
    gives an empty table; other columns of ``docs`` don't matter.  Without
    ``importance`` all rows of a source have equal odds.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    level = F.col(importance).cast("double") if importance else F.lit(1.0)
    base = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), level.alias("_importance")), "mix")
    # A null source gets a key of its own for joins; no code point sorts before it or equals it.
    named = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    sums = base.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"), F.sum(F.col("size") * F.col("_importance")).alias("_mass"))
    plan = targets(sums.select("source", "source_size"), weights, total, cap).join(
        sums.select(F.col("source").alias("_s"), "_mass"), F.col("source").eqNullSafe(F.col("_s"))
    ).drop("_s").withColumn("sid", named).drop("source")
    plan = stored(plan, "mix-plan")

    rows = join_small(base.withColumn("sid", named), plan, "sid")
    expected = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size") * F.col("_importance") * F.col("source_size") / F.col("_mass") if importance else F.col("target") / F.col("source_size"))).otherwise(0.0)
    u = unit(F.lit(seed), F.col("key").cast("string"))
    rows = rows.withColumn("_e", expected).withColumn("certain", F.floor("_e").cast("bigint")).withColumn("_p", F.col("_e") - F.col("certain"))
    odds = (u / (F.lit(1.0) - u)) / (F.col("_p") / (F.lit(1.0) - F.col("_p")))
    rows = rows.withColumn("q", F.when((F.col("_p") > 0) & (F.col("size") > 0), odds))
    parts = max(PARTS, isqrt(base.count()))
    rows = stored(rows.withColumn("part", F.floor(F.col("q") / (F.lit(1.0) + F.col("q")) * parts).cast("int")).withColumn("more", F.lit(0)).drop("_e", "_p", "_mass", "_importance"), "mix-rows")

    for _ in range(PASSES):
        rows = _fill(rows)
    return rows.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", (F.col("certain") + F.col("more")).alias("copies"))


def _fill(rows: DataFrame) -> DataFrame:
    """One pass: of the rows not taken that still fit, the first in order whose words sum to the need at most."""
    need = rows.groupBy("sid").agg((F.max("target") - F.sum(F.col("size") * (F.col("certain") + F.col("more")))).alias("need"))
    need = stored(need, "mix-need")
    open_rows = join_small(rows, need, "sid").withColumn("open", F.col("q").isNotNull() & (F.col("more") == 0) & (F.col("size") <= F.col("need")))
    parts = open_rows.where("open").groupBy("sid", "part").agg(F.sum("size").alias("words"), F.max("need").alias("need"))
    upto = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        parts.withColumn("upto", F.sum("words").over(upto)).where("upto > need").groupBy("sid")
        .agg(F.min("part").alias("cut"), F.min_by(F.col("need") - (F.col("upto") - F.col("words")), "part").alias("left"))
    )
    cut = stored(cut, "mix-cut")
    cuts = join_small(open_rows, cut, "sid")
    here = F.coalesce(F.col("open") & (F.col("part") == F.col("cut")), F.lit(False))
    run = Window.partitionBy("sid").orderBy("q", "key").rowsBetween(Window.unboundedPreceding, 0)
    edge = cuts.where(here).withColumn("more", F.when(F.sum("size").over(run) <= F.col("left"), 1).otherwise(0))
    taken = F.when(F.col("more") == 1, 1).when(F.col("open") & (F.col("cut").isNull() | (F.col("part") < F.col("cut"))), 1).otherwise(0)
    rest = cuts.where(~here).withColumn("more", taken)
    columns = ["key", "source", "size", "sid", "source_size", "target", "certain", "q", "part", "more"]
    return stored(rest.select(columns).unionByName(edge.select(columns)), "mix-rows")
