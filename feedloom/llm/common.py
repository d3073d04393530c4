"""What the operators share: the shared folder, words of Arrow batches, skew-safe joins.

Words everywhere are maximal runs of ``[^\\x20\\x09-\\x0D]``, the six ASCII white
space characters being the only separators.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Raw bytes of text that are worked on at once, unless one text alone is longer.
PIECE_BYTES = 1 << 20

#: The same where distinct words are looked up: larger pieces repeat more of them.
CHUNK_BYTES = 6 << 20

#: Rows of a side that may be broadcast after they were counted.
BROADCAST_ROWS = 100_000


#: Rows of text that cross to Python at once; the default of 10,000 takes memory on both sides for nothing.
BATCH_ROWS = 512


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to cross to Python in batches of BATCH_ROWS."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; where none is named, a temporary one in local mode (tests) and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = "file://" + tempfile.mkdtemp(prefix="feedloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, once computed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/feedloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._stored_at = path
    for made in _made:
        made.append(read)
    return read


_made: list[list[DataFrame]] = []


@contextmanager
def storing() -> Iterator[list[DataFrame]]:
    """The tables that are stored inside, to be discarded when what is made of them is stored itself."""
    made: list[DataFrame] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.pop()


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for these very frames: whatever was made from them is stored itself by now."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_stored_at", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def collected(spark: SparkSession) -> None:
    """The driver's garbage goes now, and with it what past steps broadcast and shuffled.

    A stage of many small steps else fills the driver's heap with their plans and broadcasts before it is collected.
    """
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_small(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join with a side that is usually small: broadcast if it was counted to be, else shuffled.

    The shuffled way joins on an expression of the key, so both sides are
    exchanged for the join and adaptive execution can split a hot key.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    return join_split(left, right, key, how)


def join_split(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on an expression of ``key``, so adaptive execution may split hot keys of the left side.

    The expression tells keys apart: whole numbers have some bits turned, others become text.
    """
    whole = dict(left.dtypes)[key] in ("int", "bigint") and dict(right.dtypes)[key] in ("int", "bigint")
    k = F.col(key).cast("bigint").bitwiseXOR(F.lit(0x5555)) if whole else F.concat(F.lit("k"), F.col(key).cast("string"))
    return left.withColumn("_k", k).join(right.withColumn("_k", k).drop(key), "_k", how).drop("_k")


def unit(*cols: Column | str) -> Column:
    """A number in (0, 1) that depends on the columns alone: 52 bits of an MD5, plus a half.

    MD5 because DuckDB has it too, so the oracle can follow.
    """
    digits = F.substring(F.md5(F.concat_ws("|", *cols)), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker that idles through later stages should be small."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.Table]:
    """Regroup batches into tables of at most ``limit`` bytes of text (a longer text stands alone)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
                give_back()
            size += n
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
    held = []
    give_back()


def text_array(table: pa.Table, column: str) -> pa.Array:
    """The column as one array, null as empty."""
    return pc.fill_null(table.column(column).combine_chunks().cast(pa.large_string()), "")


class Words:
    """The words of an array of texts: ``codes`` in order, ``ends`` by text, distinct ``vocab``."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy()
        encoded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        vocab = encoded.dictionary
        offsets = offsets - offsets[0]
        blank = pc.index(vocab, pa.scalar("", vocab.type)).as_py()
        if blank >= 0:
            keep = codes != blank
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            codes = codes[keep]
            codes = codes - (codes > blank)
            vocab = pa.concat_arrays([vocab.slice(0, blank), vocab.slice(blank + 1)])
        self.codes = codes.astype(np.int32, copy=False)
        self.starts = offsets[:-1].astype(np.int64, copy=False)
        self.ends = offsets[1:].astype(np.int64, copy=False)
        self.vocab = vocab

    @property
    def counts(self) -> np.ndarray:
        return self.ends - self.starts

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts), dtype=np.int64), self.counts)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` (one row a word) by text; 0 for a text without words."""
        total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
        return total[self.ends] - total[self.starts]


def join_keys(docs: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Columns of ``docs`` for every row whose key is among ``keys``; null equals null.

    Both sides are dealt by key at every size, and only a partition's keys are
    held in memory: whole texts pass by unsorted.  The kept keys grow with the
    input, so they are never broadcast by a hint.
    """
    listed = keys.select(F.col(key).alias("_key")).hint("shuffle_hash")
    return docs.alias("_docs").join(listed.alias("_listed"), F.col(f"_docs.{key}").eqNullSafe(F.col("_listed._key")), how).select("_docs.*")
