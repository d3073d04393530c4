"""Chunks of documents with their words coded, and lookups of packed keys that come back to their chunk.

A chunk is a row: keys of its documents, words of each, codes of all words and,
by the caller's choice, something for each distinct word.  ``ask`` sends every
chunk's distinct keys to the partition of a global table that owns them, one
row for a chunk and partition, and joins the answers back to the chunk.  Row
for row that is the join of exploded keys with a table partitioned by their
hash; packed, it needs a quarter of the shuffle.

Chunks are made twice, once to ask and once to be joined to the answers, which
is less to write than keeping them.  A chunk is named by a hash of what is in
it, so both times must read the same rows in the same order.  A table of files
does (``steady``), whichever executor reads it and however often; anything else
is stored first, so a lost executor can't change it.

A row of the exchange holds one n-gram or word at least, so there are never more
rows than the join of exploded keys has; below that their number is chunks
times partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from feedloom.llm.common import CHUNK_BYTES, Words, give_back, pieces, small_batches, stored, text_array

_U64 = np.uint64

#: Text whose keys one partition of a global table holds.
PART_BYTES = 6 << 20


def squeeze(data: bytes) -> bytes:
    """Compressed, unless that is longer; the first byte tells."""
    small = zstandard.ZstdCompressor(level=1).compress(data)
    return b"\1" + small if len(small) < len(data) else b"\0" + data


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[1:]) if data[0] else data[1:]


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers, in the smallest type that holds them, squeezed."""
    top = int(values.max()) if len(values) else 0
    kind = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"
    return kind[2].encode() + squeeze(values.astype(kind).tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    return np.frombuffer(expand(data[1:]), f"<u{data[:1].decode()}")


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte planes apart so that the high ones shrink."""
    gaps = np.diff(values, prepend=_U64(0)).astype("<u8")
    return squeeze(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=_U64)


def pack_codes(codes: np.ndarray) -> bytes:
    """Word codes as byte planes: the frequent words came first, so the high planes shrink."""
    return squeeze(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_codes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def ask(
    docs: DataFrame,
    key: str,
    text: str,
    side: Callable[[pa.Array], tuple[bytes, bytes]],
    request: Callable[[dict], Iterator[tuple[int, bytes]]],
    serve: Callable[[list[bytes]], list[bytes]],
    finish: Callable[[dict, list[tuple[int, bytes]]], pd.DataFrame],
    schema: str,
    steady: bool = False,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """The documents' chunks, asked and answered.

    A chunk is a row: ``chunk``, ``ids``, ``n_words``, ``codes``, and what ``side`` makes of its distinct words, for the
    request (``ask``) and for the end (``place``).  ``request`` gives (partition, keys) of a chunk; ``serve`` answers all
    keys of a partition; ``finish`` makes rows.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.selectExpr(f"`{key}` as key", f"`{text}` as text")
    rows = small_batches(rows if steady else stored(rows, "steady"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table in pieces(batches, "text", chunk_bytes):
            words = Words(text_array(table, "text"))
            ids = table.column("key").combine_chunks()
            name = xxhash.xxh64(words.codes.tobytes())
            name.update(words.counts.tobytes())
            name.update(str(ids.to_pylist()).encode())
            name.update("\n".join(words.vocab.to_pylist()).encode())
            asked, place = side(words.vocab)
            yield {"chunk": name.intdigest() - (1 << 63), "ids": ids, "n_words": words.counts, "codes": pack_codes(words.codes), "ask": asked, "place": place}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in made(batches):
            out = list(request(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in out], pa.int32()), pa.array([row["chunk"]] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())],
                ["part", "chunk", "keys"],
            )
            give_back()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in made(batches):
            offsets = pa.array([0, len(row["ids"])], pa.int32())
            columns = [pa.array([row["chunk"]], pa.int64()), pa.ListArray.from_arrays(offsets, row["ids"]), pa.array([row["n_words"].tolist()], pa.list_(pa.int64())), *(pa.array([row[c]], pa.binary()) for c in ("codes", "place"))]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "n_words", "codes", "place"])

    def answer(table: pa.Table) -> pa.Table:
        got = serve(table.column("keys").to_pylist())
        out = pa.table({"part": table.column("part"), "chunk": table.column("chunk"), "values": pa.array(got, pa.binary())})
        give_back()
        return out

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        answers = sorted(dict(zip(right["part"].tolist(), right["values"].tolist())).items())
        out = pd.concat([finish(row, answers) for row in left.to_dict("records")])
        give_back()
        return out

    asked = rows.mapInArrow(send, "part int, chunk bigint, keys binary")
    answered = asked.groupBy("part").applyInArrow(answer, "part int, chunk bigint, values binary")
    chunks = rows.mapInArrow(keep, f"chunk bigint, ids array<{kind}>, n_words array<bigint>, codes binary, place binary")
    return chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInPandas(join, schema).withColumnRenamed("key", key)


def parts_for(text_bytes: int, at_least: int) -> int:
    """Partitions of a global table over so many bytes of text: PART_BYTES each, and as many as shuffles use at least."""
    return max(at_least, text_bytes // PART_BYTES, 8)
