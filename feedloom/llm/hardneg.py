"""Hard negatives by a two-dimensional block matrix multiply: partial score tiles, added in a shuffle, cut to windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.common import join_small, join_split, small_batches, stored

#: Anchors and rows of a tile, and dimensions that are multiplied at once.
TILE = (256, 2048, 32)

#: Sums below this are exact in float64, whose products are much faster than those of int64.
EXACT = 1 << 53

#: Stands for a null key inside tiles.
NULL = -(1 << 63)


def usable(vectors: DataFrame, anchors: Column, key: str, vector: str, label: str, scale: float) -> DataFrame:
    """Rows that take part: ``row``, ``id``, ``label``, whole components floor(scale x), ``anchor``; stored, so a row keeps its number."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    code = F.col(label).cast("bigint") if dict(vectors.dtypes)[label] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(label)
    some = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    return stored(some.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), code.alias("label"), whole.alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor")), "vectors")


def _packed(rows: DataFrame, group: Column, size: int, dims: int, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks of about ``size`` rows of a group: one row a block and chunk of dimensions; and the number of blocks of each group.

    ``x`` is the block's matrix of int64, ``rows``, ``ids``, ``labels`` and ``extra`` say whose rows they are, in order of id.
    """
    grouped = rows.withColumn("g", group)
    blocks = grouped.groupBy("g").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("blocks"))
    dealt = join_small(grouped, blocks, "g", "inner").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    last = F.greatest(F.floor((F.size("x") - 1) / F.lit(dims)).cast("int"), F.lit(0))
    cut = dealt.select("g", "block", "row", "id", "label", *extra, "x", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    cut = cut.withColumn("x", F.slice("x", F.col("chunk") * dims + 1, dims))

    def pack(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("row").to_numpy(), table.column("id").fill_null(NULL).to_numpy()))
        table = table.take(pa.array(order))
        lists = table.column("x").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        matrix = np.zeros((len(table), dims), np.int64)
        matrix[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        same = {c: table.column(c).slice(0, 1) for c in ("g", "block", "chunk")}
        own = {f"{c}s": pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("row", "id", "label", *extra)}
        return pa.table({**same, **own, "x": pa.array([matrix.tobytes()], pa.binary())})

    kinds = dict(cut.dtypes)
    schema = ", ".join(["g bigint, block int, chunk int", *(f"{c}s array<{kinds[c]}>" for c in ("row", "id", "label", *extra)), "x binary"])
    return cut.groupBy("g", "block", "chunk").applyInArrow(pack, schema), blocks


def _partial(a: bytes, b: bytes, dims: int, chunks: int) -> np.ndarray:
    """int64 scores of one chunk of dimensions for every anchor and row of a tile."""
    left, right = (np.frombuffer(x, np.int64).reshape(-1, dims) for x in (a, b))
    most = max(int(np.abs(left).max(initial=0)), 1) * max(int(np.abs(right).max(initial=0)), 1) * dims
    if most * chunks >= 1 << 63:
        raise OverflowError("scores don't fit 64 bits")
    return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64) if most < EXACT else left @ right.T


def tiles(anchors: DataFrame, rows: DataFrame, group: Column, extra: list[str], tile: tuple[int, int, int] = TILE) -> DataFrame:
    """Partial tiles of anchors x rows of one group: a row for each tile, chunk and anchor, and one (``a_row`` null) that says whose scores they are.

    Both sides are cut in blocks of rows and chunks of dimensions; each block
    goes along its row or column of the grid, so a task holds two blocks.  A
    chunk that only one of two vectors reaches adds nothing.
    """
    n_anchors, n_rows, dims = tile
    a, a_blocks = _packed(anchors, group, n_anchors, dims, extra)
    b, b_blocks = _packed(rows, group, n_rows, dims, [])
    along = lambda side, blocks, mine, other: join_split(side, blocks, "g", "inner").withColumnRenamed("block", mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    a = along(a, b_blocks, "i", "j").withColumnsRenamed({"x": "ax", "rows": "a_rows", "labels": "a_labels"}).drop("ids")
    b = along(b, a_blocks, "j", "i").withColumnRenamed("x", "bx")
    met = small_batches(a.join(b, ["g", "i", "j", "chunk"]))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k] for c in batch.schema.names}
                chunk = r["chunk"].as_py()
                scores = _partial(r["ax"].as_py(), r["bx"].as_py(), dims, chunk + 1)
                # every row has a first chunk; a further one may lack some
                whose = [np.array(r[c].values.fill_null(NULL).to_numpy(zero_copy_only=False), np.int64) for c in ("rows", "ids", "labels")[: 1 if chunk else 3]]
                lists = {c: [None, *r[c].as_py()] for c in ("a_rows", "a_labels", *(f"{x}s" for x in extra))}
                payload = [np.concatenate(whose).tobytes(), *(x.tobytes() for x in scores)]
                same = {c: pa.array([r[c].as_py()] * len(payload), batch.schema.field(c).type) for c in ("g", "i", "j", "chunk")}
                own = {c.removesuffix("s"): pa.array(x, batch.schema.field(c).type.value_type) for c, x in lists.items()}
                yield pa.RecordBatch.from_pydict({**same, **own, "scores": pa.array(payload, pa.binary())})

    kinds = dict(anchors.dtypes)
    own = ", ".join(["a_row bigint, a_label bigint", *(f"{c} {kinds[c]}" for c in extra)])
    return met.mapInArrow(multiply, f"g bigint, i int, j int, chunk int, {own}, scores binary")


Pick = Callable[[np.ndarray, np.ndarray, np.ndarray, dict], Iterator[tuple[int, np.ndarray]]]


def reduced(partial: DataFrame, pick: Pick) -> DataFrame:
    """Partial tiles added up; ``a_row``, ``nth``, ``id`` and ``score`` of what ``pick`` takes of a tile for an anchor's window ``nth``.

    Rows come sorted by tile and anchor, so one anchor's scores are in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"anchor": None}

        def out() -> pa.RecordBatch | None:
            if state["anchor"] is None:
                return None
            found = [(state["anchor"]["a_row"], nth, state["ids"][hit], state["sum"][hit]) for nth, hit in pick(state["sum"], state["rows"], state["labels"], state["anchor"])]
            state["anchor"] = None
            found = [x for x in found if len(x[2])]
            if not found:
                return None
            n = [len(x[2]) for x in found]
            ids = np.concatenate([x[2] for x in found])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([x[0] for x in found], n), pa.int64()), pa.array(np.repeat([x[1] for x in found], n), pa.int32()), pa.array(ids, pa.int64(), mask=ids == NULL), pa.array(np.concatenate([x[3] for x in found]), pa.int64())],
                ["a_row", "nth", "id", "score"],
            )

        for batch in batches:
            for r in batch.to_pylist():
                values, chunk = np.frombuffer(r["scores"], np.int64), r["chunk"]
                if chunk == 0:
                    done = out()
                    if done is not None:
                        yield done
                if r["a_row"] is None and chunk == 0:
                    state["rows"], state["ids"], state["labels"] = values.reshape(3, -1)
                    state["places"], order = {}, np.argsort(state["rows"])
                elif r["a_row"] is None:
                    state["places"][chunk] = order[np.searchsorted(state["rows"], values, sorter=order)]
                elif chunk == 0:
                    state["anchor"], state["sum"] = r, values.copy()
                else:
                    state["sum"][state["places"][chunk]] += values
        done = out()
        if done is not None:
            yield done

    first = F.coalesce("a_row", F.lit(-1)).alias("a")
    dealt = partial.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", first, "chunk")
    return small_batches(dealt).mapInArrow(run, "a_row bigint, nth int, id bigint, score bigint")


def _first(found: DataFrame, keys: list[str], many: int) -> DataFrame:
    """The first ``many`` of each window: higher scores first, ties by smaller id; ``rank`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= many)


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
    key: str = "vec_id", vector: str = "embedding", label: str = "label", tile: tuple[int, int, int] = TILE,
) -> DataFrame:
    """Hard negatives of the rows that ``anchors`` (a condition on key) names, held against all rows.

    A score is the integer inner product of floor(scale x).  An anchor's
    positives are its first ``positives`` other rows of the same label; for each
    the first ``negatives`` rows of another label with low * positive <= 100 *
    negative <= high * positive are returned: ``anchor_id``, ``positive_id``,
    ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Positives come from tiles of one label, negatives from tiles of all rows;
    scores leave a tile only if they are among the first of a window there, and
    windows are cut again before they are dealt by anchor.  Labels are compared
    as whole numbers or by a 64-bit hash.

    Rows with a null label, a null vector or a component that is null or not
    finite take no part.  A vector shorter than another counts as if zeros
    followed; an empty one scores 0.  A null key is a key like any other, before
    all others.  Rows that repeat a key are rows of their own, each an anchor if
    its key is one.  No anchor, no positive or an empty table give an empty
    result.  Scores past 64 bits are an error.  Other columns of ``vectors`` don't matter.
    """
    rows = usable(vectors, anchors, key, vector, label, scale)
    own = rows.where("anchor")

    def same(scores, row, labels, anchor):
        at = np.flatnonzero(row != anchor["a_row"])
        yield 0, at[np.argsort(-scores[at], kind="stable")[:positives]]

    alike = _first(reduced(tiles(own, rows, F.col("label"), [], tile), same), ["a_row"], positives)
    found = stored(alike.select("a_row", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    def window(scores, row, labels, anchor):
        at = np.flatnonzero(labels != anchor["a_label"])
        at = at[np.argsort(-scores[at], kind="stable")]
        down = -scores[at]
        for nth, most in enumerate(anchor["want"], 1):
            # 100 s <= high p is s <= floor(high p / 100); low p <= 100 s is s >= ceil(low p / 100)
            a, b = np.searchsorted(down, -(high * most // 100)), np.searchsorted(down, -low * most // 100, side="right")
            yield nth, at[a : min(b, a + negatives)]

    want = found.groupBy("a_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda x: x["positive_score"]).alias("want"))
    asked = own.join(want.withColumnRenamed("a_row", "row"), "row")
    hard = _first(reduced(tiles(asked, rows, F.lit(0).cast("bigint"), ["want"], tile), window), ["a_row", "nth"], negatives)
    named = found.join(own.select(F.col("row").alias("a_row"), F.col("id").alias("anchor_id")), "a_row")
    return hard.join(named, ["a_row", "nth"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
