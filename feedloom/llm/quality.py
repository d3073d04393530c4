"""Quality rules: counts over words and lines, and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Words, join_split, pieces, small_batches, stored, text_array
from feedloom.llm.exact import _marks, _survives

#: Buckets that byte n-grams of this length are hashed to.
BUCKETS, GRAM = 1 << 16, 3
#: Counts added to every bucket of either multinomial.
SMOOTH = 1.0
#: A text is rejected below this quantile of the trusted scores, less the margin (nats an n-gram).
QUANTILE, MARGIN = 0.001, 0.5
#: Rules on counts: fewest words; most repeated words, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3
SYMBOLS = b"#*$%&|<>"


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte n-gram of the texts, and where each text's n-grams end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    n = np.maximum(np.diff(offsets) - (GRAM - 1), 0)
    ends = np.cumsum(n)
    if not size or not ends[-1]:
        return np.zeros(0, np.int64), ends
    buf = np.frombuffer(texts.buffers()[2], np.uint8, base + size)[base:].astype(np.uint32)
    joined = np.zeros(size - GRAM + 1, np.uint32)
    for i in range(GRAM):
        joined = (joined << np.uint32(8)) | buf[i : size - GRAM + 1 + i]
    hashed = (joined * np.uint32(2654435761)) >> np.uint32(16)
    inside = np.ones(len(hashed), bool)
    for i in range(1, GRAM):
        crossing = offsets[1:-1] - base - i
        inside[crossing[(crossing >= 0) & (crossing < len(hashed))]] = False
    return hashed[inside].astype(np.int64), ends


class Ratio:
    """Log-likelihood ratio of a target to a raw multinomial over hashed n-grams, a mean per n-gram."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        p, q = (x + SMOOTH for x in (target, raw))
        self.weights = np.log(p / p.sum()) - np.log(q / q.sum())

    def scores(self, texts: pa.Array) -> np.ndarray:
        at, ends = buckets(texts)
        total = np.concatenate([[0.0], np.cumsum(self.weights[at])])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        n = ends - starts
        return np.where(n > 0, (total[ends] - total[starts]) / np.maximum(n, 1), 0.0)


def fit(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[Ratio, float]:
    """The ratio and its threshold, of all documents and all that are trusted; ``trusted`` holds keys.

    A bit map of fixed size lets through the texts whose keys may be trusted, so
    only those are shuffled, once.  Without trusted documents the threshold is
    minus infinity: no verdict against anything.  A trusted key that repeats counts
    once, all rows of ``docs`` with it count; null keys are never trusted.
    """
    keys = trusted.select(key).where(F.col(key).isNotNull()).distinct()
    docs = docs.select(key, text)
    hashed = keys.select(F.xxhash64(key).alias("h"))
    some = _survives(docs, _marks(hashed.union(hashed)), F.xxhash64(key), "_may").where("_may").drop("_may")
    known = stored(join_split(some, keys, key, "left_semi").select(F.col(text).alias("text")), "trusted")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for table in pieces(batches, "text"):
            seen += np.bincount(buckets(text_array(table, "text"))[0], minlength=BUCKETS)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(seen[held])], ["bucket", "n"])

    def sums(texts: DataFrame) -> np.ndarray:
        found = small_batches(texts).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
        out = np.zeros(BUCKETS)
        out[found["bucket"]] = found["n"]
        return out

    target = sums(known)
    ratio = Ratio(sums(docs.select(F.col(text).alias("text"))), target)
    if not target.sum():
        return ratio, float("-inf")
    weights = docs.sparkSession.sparkContext.broadcast(ratio)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(weights.value.scores(text_array(table, "text")))], ["score"])

    # The quantile lies between two of the least scores, a thousandth of all.
    place = QUANTILE * (known.count() - 1)
    least = [r.score for r in small_batches(known).mapInArrow(rate, "score double").orderBy("score").limit(int(place) + 2).collect()]
    low, high = least[int(place)], least[min(int(place) + 1, len(least) - 1)]
    return ratio, low + (high - low) * (place - int(place)) - MARGIN


def counts(table: pa.Table, texts: pa.Array) -> dict[str, list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    words = Words(texts)
    out = {"n_words": words.counts.tolist(), "word_chars": [], "n_symbols": [], "n_dup_lines": [], "n_repeat_words": []}
    for text, a, b in zip(texts.to_pylist(), words.starts.tolist(), words.ends.tolist()):
        raw = text.encode()
        out["word_chars"].append(len(text) - (len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))))
        out["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
        lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(repeated_words(words.codes[a:b], WINDOW))
    return out


def repeated_words(codes: np.ndarray, width: int) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first one included."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    _, key = np.unique(codes, return_inverse=True)
    base = key
    key = key[:n].astype(np.int64)
    for i in range(1, width):
        _, key = np.unique(key * len(codes) + base[i : n + i], return_inverse=True)
    often = np.bincount(key)[key] > 1
    if not often.any():
        return 0
    covered = np.zeros(len(codes), bool)
    for i in range(width):
        covered[i : n + i] |= often
    return int(covered.sum())


def rate(docs: DataFrame, ratio: Ratio, threshold: float, key: str = "doc_id", text: str = "text", others: tuple[str, ...] = (), prefix: str = "_q_") -> DataFrame:
    """Counts, ``base_failed``, ``llr`` and ``kept`` of every row, named with ``prefix``; columns ``others`` pass through.

    Null counts as an empty text: no words, base_failed.  A text without an
    n-gram has llr 0.  A row is kept if its counts pass and its llr is at least
    ``threshold``, of a tie too.  Texts of any length are read whole; rows that
    repeat get equal verdicts; an empty table gives an empty table.  None of
    ``others`` may begin with ``prefix``; no other column of ``docs`` matters.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ratio, threshold))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, least = shared.value
        for table in pieces(batches, text):
            texts = text_array(table, text)
            found = counts(table, texts)
            failed = [w < LEAST_WORDS or 100 * r > MOST_REPEATED * w for w, r in zip(found["n_words"], found["n_repeat_words"])]
            llr = model.scores(texts)
            kept = [not f and s >= least for f, s in zip(failed, llr.tolist())]
            passed = [table.column(c).combine_chunks() for c in carried]
            yield pa.RecordBatch.from_arrays([*passed, *(pa.array(found[c], pa.int64()) for c in names), pa.array(failed, pa.bool_()), pa.array(llr), pa.array(kept, pa.bool_())], [*carried, *(f"{prefix}{c}" for c in [*names, "base_failed", "llr", "kept"])])

    carried = list(dict.fromkeys([key, *others]))
    if any(c.startswith(prefix) for c in carried):
        raise ValueError(f"a column begins with {prefix}")
    read = list(dict.fromkeys([*carried, text]))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), *(f"`{prefix}{c}` bigint" for c in names), f"`{prefix}base_failed` boolean", f"`{prefix}llr` double", f"`{prefix}kept` boolean"])
    return small_batches(docs.select(*[F.col(f"`{c}`") for c in read])).mapInArrow(run, schema)
