"""Language-model scores by stupid backoff over n-gram counts of the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm import packed
from feedloom.llm.common import WORD, shuffle_partitions

#: Factor of a score for every order it backs off by.
BACKOFF = 0.4

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: Text of a chunk: larger ones repeat fewer n-grams.
CHUNK_BYTES = 12 << 20

#: Of so many n-grams about one may share its key with another, and the fewest bits of a key.
SPARE, MIN_BITS = 1 << 22, 40


def word_keys(vocab: pa.Array) -> np.ndarray:
    """A 64-bit key of every distinct word."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in vocab.cast(pa.large_binary()).to_pylist()), np.uint64, len(vocab))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(29))


def key_bits(grams: int) -> int:
    """Bits of a key: so many that of this many n-grams about one in SPARE shares its key with another, 64 at most."""
    return min(64, max(MIN_BITS, int(np.ceil(np.log2(max(grams, 1) * SPARE)))))


def gram_keys(words: np.ndarray, first: np.ndarray, order: int, bits: int = 64) -> np.ndarray:
    """Key of the n-gram that ends at each word; 0 where the text has fewer words before it.

    ``first`` is each word's place in its own text.
    """
    with np.errstate(over="ignore"):
        h = _mix(words + np.uint64(order))
        for back in range(1, order):
            shifted = np.zeros_like(words)
            shifted[back:] = words[:-back] if back < len(words) else words[:0]
            h = _mix(h * _M1 + shifted)
    h = (h >> np.uint64(64 - bits)) | np.uint64(1)
    h[first < order - 1] = 0
    return h


def ranked(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Each value's place among the distinct ones in order, and how many there are."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.ones(len(values), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(first) - 1
    return place, int(first.sum())


def score(docs: DataFrame, order: int = 3, key: str = "doc_id", text: str = "text", steady: bool = False) -> DataFrame:
    """Mean log10 score of each text's words under the n-grams of all other texts.

    Returns ``key``, ``n_words``, ``n_seen`` (words whose n-gram of the highest
    order occurs elsewhere), ``log_score`` (sum) and ``score`` (mean; null
    without words).

    The score of a word is count(n-gram) / count(its context) for the longest
    n-gram that occurs outside the text itself, times BACKOFF for every order
    below the one that the word's place allows; a word that no other text has
    scores BACKOFF^k / (words of the corpus + 1).  Counts are of all documents,
    less the text's own.  Count tables are partitioned by hash of the n-gram;
    the n-grams of the documents, exploded and packed by chunk, are joined to
    them, and the scores summed per document.  Null counts as empty; texts of any
    length are scored whole; rows that repeat count each; an empty table gives an
    empty table; other columns of ``docs`` don't matter.  ``steady``: ``docs`` is a
    table of files; else it is stored first.
    """
    kind = dict(docs.dtypes)[key]
    sizes = docs.agg(F.sum(F.regexp_count(F.col(text), F.lit(WORD))), F.sum(F.octet_length(text))).first()
    total = sizes[0] or 0
    parts = packed.parts_for(sizes[1] or 0, shuffle_partitions(docs.sparkSession))
    bits = key_bits(total * order)

    def side(vocab: pa.Array) -> tuple[bytes, bytes]:
        return b"", word_keys(vocab).tobytes()

    def grams(row: dict) -> tuple[list[np.ndarray], np.ndarray]:
        codes = packed.unpack_codes(row["codes"])
        words = np.frombuffer(row["place"], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
        n = np.asarray(row["n_words"], np.int64)
        starts = np.cumsum(n) - n
        first = np.arange(len(words)) - np.repeat(starts, n)
        return [gram_keys(words, first, o, bits) for o in range(1, order + 1)], n

    # Keys are hashes, so ranges of them are partitions of one size, and in order of value they are in order of partition.
    edges = np.array([(p << bits) // parts for p in range(1, parts)], np.uint64)

    def cut(values: np.ndarray) -> np.ndarray:
        """Where each partition begins among ascending keys, and where the last ends."""
        return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])

    def request(row: dict) -> Iterator[tuple[int, bytes]]:
        found = [(v, n, cut(v)) for v, n in (np.unique(k[k > 0], return_counts=True) for k in grams(row)[0])]
        filled = np.flatnonzero(np.diff(sum(cuts for _, _, cuts in found)))
        for p in filled.tolist():
            blobs = []
            for values, counts, cuts in found:
                own = slice(cuts[p], cuts[p + 1])
                blobs += [packed.pack_sorted(values[own]), packed.pack_ints(counts[own])]
            yield p, b"".join(len(b).to_bytes(4, "little") + b for b in blobs)

    def blobs_of(data: bytes) -> list[bytes]:
        out, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 4], "little")
            out.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        return out

    def serve(keys: list[bytes]) -> list[bytes]:
        split = [blobs_of(k) for k in keys]
        out: list[list[bytes]] = [[] for _ in keys]
        for o in range(order):
            values = [packed.unpack_sorted(b[2 * o]) for b in split]
            counts = [packed.unpack_ints(b[2 * o + 1]).astype(np.int64) for b in split]
            place, n = ranked(np.concatenate(values))
            found = np.bincount(place, weights=np.concatenate(counts), minlength=n).astype(np.int64)[place]
            at = 0
            for i, v in enumerate(values):
                out[i].append(packed.pack_ints(found[at : at + len(v)]))
                at += len(v)
        return [b"".join(len(b).to_bytes(4, "little") + b for b in blobs) for blobs in out]

    def finish(row: dict, answers: list[tuple[int, bytes]]) -> pd.DataFrame:
        keys, n = grams(row)
        doc = np.repeat(np.arange(len(n)), n)
        split = [blobs_of(data) for _, data in answers]
        counts = []
        for o in range(order):
            real = np.flatnonzero(keys[o] > 0)
            place, known = ranked(keys[o][real])
            of_all = np.concatenate([packed.unpack_ints(b[o]).astype(np.int64) for b in split]) if split else np.zeros(0, np.int64)
            if len(of_all) != known:
                raise RuntimeError("a chunk's n-grams did not all come back")
            own, _ = ranked(place * len(n) + doc[real])
            left = np.zeros(len(keys[o]), np.int64)
            left[real] = of_all[place] - np.bincount(own)[own] if len(real) else 0
            counts.append(left)
        size = np.repeat(n, n)
        outside = np.maximum(total - size, 0)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        most = np.minimum(first + 1, order)
        value = np.log10(1.0 / (outside + 1.0))
        used = np.zeros(len(doc), np.int64)
        for o in range(1, order + 1):
            seen = counts[o - 1] > 0
            if o == 1:
                context = outside
            else:
                context = np.concatenate([[0], counts[o - 2][:-1]])
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.log10(counts[o - 1] / np.maximum(context, counts[o - 1]))
            value = np.where(seen, ratio, value)
            used = np.where(seen, o, used)
        value = value + np.log10(BACKOFF) * (most - np.maximum(used, 1))
        seen = np.concatenate([[0], np.cumsum(used == order)])
        ends = np.cumsum(n)
        log_score = np.array([float(value[a:b].sum()) for a, b in zip((ends - n).tolist(), ends.tolist())])
        frame = pd.DataFrame({"key": list(row["ids"]), "n_words": n, "n_seen": seen[ends] - seen[ends - n], "log_score": log_score})
        frame["score"] = np.where(n > 0, log_score / np.maximum(n, 1), np.nan)
        frame["score"] = frame["score"].astype("Float64").mask(n == 0)
        return frame.astype({"key": "Int64"}) if kind in ("bigint", "int") else frame

    schema = f"key {kind}, n_words bigint, n_seen bigint, log_score double, score double"
    return packed.ask(docs, key, text, side, request, serve, finish, schema, steady, CHUNK_BYTES)
