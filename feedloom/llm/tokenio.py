"""Token ids in binary segments: one zstandard dictionary, one frame a document, an offset index.

A folder holds two tables: ``segments``, and ``dictionary`` with the one row
that every segment names by its SHA-256, so any later session can read it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from feedloom.llm.bpe import default_path, encoder
from feedloom.llm.common import Words, give_back, pieces, shared_folder, shuffle_partitions, small_batches, text_array

#: A segment: this header, the offset index, the frames.
MAGIC = b"FLTK0002"
#: magic, SHA-256 of the dictionary, documents, ids of the segment, ids of the range before it.
HEADER = "<8s32sQQQ"
#: A document in the index: whether it has a key, the key, where its frame ends, ids before it in the segment.
ENTRY = "<?qQQ"
HEADER_SIZE, ENTRY_SIZE = struct.calcsize(HEADER), struct.calcsize(ENTRY)

SEGMENT_BYTES = 4 << 20
#: Text that one worker encodes at once.
PIECE_BYTES = 4 << 20
DICTIONARY_BYTES = 32 << 10
#: The dictionary is trained on so many documents, those with the least hash of their key ...
SAMPLE_DOCS = 512
#: ... and of a longer one so many runs of so many ids, evenly spaced over all of it; all documents are compressed with it.
SAMPLE_RUNS, RUN_IDS = 16, 256
LEVEL = 3

SEGMENTS = "range int, segment bigint, n_ids bigint, first_key bigint, last_key bigint, blob binary"


def _encoded(table: pa.Table, path: str, end_id: int) -> Iterator[tuple[object, np.ndarray]]:
    """Key and ids (with the end id, little-endian unsigned 32 bits) of each row."""
    words = Words(text_array(table, "text"))
    taken = encoder(path).encode_all(words.vocab).take(pa.array(words.codes))
    flat, offsets = taken.values.to_numpy(), taken.offsets.to_numpy()
    begins, ends = offsets[words.starts].tolist(), offsets[words.ends].tolist()
    for key, a, b in zip(table.column("key").to_pylist(), begins, ends):
        out = np.empty(b - a + 1, "<u4")
        out[:-1] = flat[a:b]
        out[-1] = end_id
        yield key, out


def _spread(ids: np.ndarray) -> np.ndarray:
    """All ids, or of many the runs that a document gives to the dictionary."""
    if len(ids) <= SAMPLE_RUNS * RUN_IDS:
        return ids
    begins = np.linspace(0, len(ids) - RUN_IDS, SAMPLE_RUNS).astype(np.int64)
    return ids[(begins[:, None] + np.arange(RUN_IDS)).ravel()]


def train(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> bytes:
    """The shared dictionary; empty if there are too few samples to train one."""
    picked = docs.selectExpr(f"`{key}` as key").where("key is not null").groupBy("key").agg(F.lit(1)).select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE_DOCS)
    keys = sorted(r[0] for r in picked.collect())
    if not keys:
        return b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text"):
            arrays = [(k, _spread(x).tobytes()) for k, x in _encoded(table, path, end_id)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in arrays], pa.int64()), pa.array([x for _, x in arrays], pa.binary())], ["key", "ids"])

    rows = docs.where(F.col(key).isin(keys)).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    sampled = small_batches(rows).mapInArrow(run, "key bigint, ids binary").groupBy("key").agg(F.min("ids").alias("ids"))
    samples = sorted(bytes(r[1]) for r in sampled.collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


class Segment:
    """Reads one segment; any document of it alone through the index."""

    def __init__(self, blob: bytes, dictionary: bytes):
        self.blob = blob
        magic, digest, self.docs, self.ids, self.before = struct.unpack_from(HEADER, blob)
        if magic != MAGIC or digest != sha256(dictionary).digest():
            raise ValueError("not a segment of this dictionary")
        self.index = [struct.unpack_from(ENTRY, blob, HEADER_SIZE + i * ENTRY_SIZE) for i in range(self.docs)]
        self.frames = HEADER_SIZE + self.docs * ENTRY_SIZE
        shared = _codec(dictionary)
        self.zstd = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()

    def document(self, i: int) -> np.ndarray:
        begin = self.index[i - 1][2] if i else 0
        frame = self.blob[self.frames + begin : self.frames + self.index[i][2]]
        return np.frombuffer(self.zstd.decompress(frame), "<u4")

    def key(self, i: int) -> int | None:
        there, key, _, _ = self.index[i]
        return key if there else None


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 2, key: str = "doc_id", text: str = "text") -> str:
    """Encode and write all documents to ``folder`` (a new one in the shared folder, if not given), whose name is returned.

    A row of ``segments`` is a segment: ``range``, ``segment`` (number in its
    range), ``n_ids``, ``first_key``, ``last_key``, ``blob``.  Ranges follow one
    another in the order of ``key``, as do segments in a range and documents in
    a segment.  Keys are integers, any other kind is an error; null keys come
    first.  A null or empty text is the end id alone; a text of any length is
    one frame, encoded whole; rows that repeat are written each, side by side;
    an empty table gives a table without segments.  Other columns of ``docs``
    don't matter.  Frames are compressed before they are dealt to ranges.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"keys of token files are integers, {key} is {docs.schema[key].dataType.simpleString()}")
    path = path or default_path()
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/feedloom/tokens-{uuid.uuid4().hex}"
    dictionary = train(docs, path, end_id, key, text)
    n = shuffle_partitions(spark)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    bounds = sorted(set(rows.approxQuantile("key", [i / n for i in range(1, n)], 0.1 / n)))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _codec(dictionary)
        zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared) if shared else zstandard.ZstdCompressor(level=LEVEL)
        for table in pieces(batches, "text", PIECE_BYTES):
            keys, sizes, frames = [], [], []
            for k, ids in _encoded(table, path, end_id):
                keys.append(k)
                sizes.append(len(ids))
                frames.append(zstd.compress(ids.tobytes()))
            at = [0 if k is None else bisect_right(bounds, k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())], ["range", "key", "n_ids", "frame"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = sha256(dictionary).digest()
        held: list[tuple[int | None, int, bytes]] = []
        now, number, before, size = None, 0, 0, 0

        def out() -> pa.RecordBatch:
            nonlocal held, number, before, size
            index, ids, end = [], 0, 0
            for k, count, frame in held:
                end += len(frame)
                index.append(struct.pack(ENTRY, k is not None, k or 0, end, ids))
                ids += count
            blob = struct.pack(HEADER, MAGIC, digest, len(held), ids, before) + b"".join(index) + b"".join(x[2] for x in held)
            keys = [k for k, _, _ in held if k is not None]
            values = [now, number, ids, min(keys, default=None), max(keys, default=None), blob]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            row = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["range", "segment", "n_ids", "first_key", "last_key", "blob"])
            held, number, before, size = [], number + 1, before + ids, 0
            return row

        for batch in batches:
            columns = [batch.column(c) for c in ("range", "key", "n_ids", "frame")]
            for r, k, count, frame in (tuple(c[i].as_py() for c in columns) for i in range(batch.num_rows)):
                if held and (r != now or size + len(frame) > SEGMENT_BYTES):
                    yield out()
                    give_back()
                if r != now:
                    now, number, before = r, 0, 0
                held.append((k, count, frame))
                size += len(frame)
        if held:
            yield out()

    frames = small_batches(rows).mapInArrow(compress, "range int, key bigint, n_ids bigint, frame binary")
    sorted_frames = frames.repartitionById(n, "range").sortWithinPartitions("range", F.asc_nulls_first("key"), "n_ids", "frame")
    # Frames are compressed already, so the files are not.
    sorted_frames.mapInArrow(gather, SEGMENTS).write.option("compression", "none").parquet(f"{folder}/segments")
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    return folder


def opened(spark: SparkSession, folder: str) -> tuple[DataFrame, bytes]:
    """The table of segments and the dictionary of a folder that ``write`` made, in this session or another."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()[0])
    return spark.read.schema(SEGMENTS).parquet(f"{folder}/segments"), dictionary


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32`` and, if asked, ``ids``.

    Where a range begins is summed over the ranges, whose number is fixed when
    they are written; the rest is in the segments.
    """
    segments, dictionary = opened(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, one = batch.column("base")[row].as_py(), Segment(batch.column("blob")[row].as_py(), dictionary)
                sizes, sums, arrays = [], [], []
                for i in range(one.docs):
                    own = one.document(i)
                    sizes.append(len(own))
                    sums.append(zlib.crc32(own.tobytes()))
                    if ids:
                        arrays.append(own)
                columns = [
                    pa.array([one.key(i) for i in range(one.docs)], pa.int64()), pa.array([base + one.before + x[3] for x in one.index], pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.array([a.astype(np.int64) for a in arrays], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                give_back()

    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = segments.groupBy("range").agg(F.sum("n_ids").alias("n"))
    bases = sums.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if ids else "")
    return segments.join(F.broadcast(bases), "range").select("base", "blob").mapInArrow(run, schema)


def document(spark: SparkSession, folder: str, key: int) -> list[list[int]]:
    """Ids of the rows with this key (none, one, or several that repeat it): the segments that may hold it are read, and its frames alone decompressed."""
    segments, dictionary = opened(spark, folder)
    out = []
    for r in segments.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).select("blob").toLocalIterator():
        one = Segment(bytes(r[0]), dictionary)
        out += [one.document(i).tolist() for i in range(one.docs) if one.key(i) == key]
    return out
