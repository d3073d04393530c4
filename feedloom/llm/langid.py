"""Language identification: known words first, shorter and shorter character n-grams for the rest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.common import CHUNK_BYTES, Words, pieces, small_batches, stored, text_array, unit

#: The model is fitted on about so many labelled documents of each language, chosen by hash of their key.
SAMPLE_DOCS = 1000
#: The sample of a language has so many bytes of text at most.  All its words and n-grams are kept, so this bounds the model.
SAMPLE_BYTES = 16 << 20
#: Longest and shortest character n-gram.
LONGEST, SHORTEST = 5, 1
#: What a word or n-gram counts in a language that was never seen to have it.
FLOOR = 0.1
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(low: str) -> list[str]:
    """Runs of letters; number signs such as fractions are none, though a regular expression takes them for some."""
    found = _LETTERS.findall(low)
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between its bounds."""
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def longest_known(word: str, known: dict[str, int]) -> list[int]:
    """Rows of the longest known n-gram at each place of a word between its bounds; a place without any says nothing."""
    padded = f"<{word}>"
    out = []
    for i in range(len(padded)):
        for n in range(min(LONGEST, len(padded) - i), SHORTEST - 1, -1):
            row = known.get(padded[i : i + n])
            if row is not None:
                out.append(row)
                break
    return out


class Model:
    """Rows of log relative frequencies by language, less their mean over the languages."""

    def __init__(self, langs: list[str], words: pd.DataFrame, grams_: pd.DataFrame):
        self.langs = langs
        place = {x: i for i, x in enumerate(langs)}
        tables = [self._table(pairs, place) for pairs in (words, grams_)]
        self.words = {w: i for i, w in enumerate(tables[0][0])}
        self.grams = {g: i + len(self.words) for i, g in enumerate(tables[1][0])}
        self.rows = np.concatenate([t[1] for t in tables])

    def _table(self, pairs: pd.DataFrame, place: dict[str, int]) -> tuple[list[str], np.ndarray]:
        totals = pairs.groupby("lang")["n"].sum()
        share = np.array([1.0 / max(int(totals.get(x, 0)), 1) for x in self.langs])
        counts: dict[str, np.ndarray] = {}
        for lang, item, n in pairs[["lang", "item", "n"]].itertuples(index=False):
            counts.setdefault(item, np.full(len(self.langs), FLOOR))[place[lang]] += n
        logs = np.log(np.array(list(counts.values())).reshape(len(counts), len(self.langs)) * share)
        return list(counts), logs - logs.mean(axis=1, keepdims=True) if len(self.langs) else logs

    def rows_of(self, token: str) -> list[int] | None:
        """Rows that speak for a token: of its known words, and of the n-grams of unseen ones; None without a letter."""
        low = token.lower()
        found = [low] if low.isalpha() else words_of(low)
        if not found:
            return None
        out: list[int] = []
        for word in found:
            row = self.words.get(word)
            if row is not None:
                out.append(row)
            else:
                out += longest_known(word, self.grams)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        words = Words(texts)
        per = [self.rows_of(t) for t in words.vocab.to_pylist()]
        lettered = np.array([p is not None for p in per], dtype=np.int64)
        sizes = np.fromiter((len(p or ()) for p in per), np.int64, len(per))
        flat = np.fromiter((r for p in per if p for r in p), np.int64, int(sizes.sum()))
        table = np.zeros((len(per), len(self.langs)))
        if len(flat):
            some = np.flatnonzero(sizes)
            table[some] = np.add.reduceat(self.rows[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
        sums, n = words.sums(table[words.codes]), words.sums(lettered[words.codes])
        best = sums.argmax(axis=1) if self.langs else None
        langs, scores = [], []
        for i in range(len(texts)):
            if not n[i] or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            langs.append(self.langs[best[i]])
            mean = sums[i] / n[i]
            scores.append(float(1.0 / np.exp(mean - mean[best[i]]).sum()))
        return langs, scores


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of the rows with text and language (about ``sample_docs`` a language, whole texts).

    It ends before the key that would take a language over ``sample_bytes``; a key
    whose rows alone are more is passed over.

    Rows are chosen by hash of their key, so rows that repeat a key come in or
    stay out together and count each; null keys are a key like any other.  Rows
    without text or language are left out; none left gives a model that answers
    ``und``.  Every word and n-gram of the sample is kept; a language whose sample
    has no letter is not learned.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    langs = sorted(counts)
    if not langs:
        empty = pd.DataFrame({"lang": [], "item": [], "n": []})
        return Model([], empty, empty)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_docs / counts[k]))])[F.col("lang")]
    drawn = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), unit(F.lit("lang"), F.col(key).cast("string")).alias("drawn")).where(F.col("drawn") <= share)
    sizes = drawn.groupBy("lang", "drawn").agg(F.sum(F.octet_length("text")).alias("bytes")).where(F.col("bytes") <= sample_bytes)
    total = F.sum("bytes").over(Window.partitionBy("lang").orderBy("drawn").rowsBetween(Window.unboundedPreceding, 0))
    kept = sizes.withColumn("total", total).where(F.col("total") <= sample_bytes).select("lang", "drawn")
    chosen = drawn.join(F.broadcast(kept), ["lang", "drawn"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text"):
            words: Counter = Counter()
            for x, t in zip(table.column("lang").to_pylist(), table.column("text").to_pylist()):
                words.update((x, w) for w in words_of(t.lower()))
            parts: Counter = Counter()
            for (x, w), n in words.items():
                for size in range(SHORTEST, LONGEST + 1):
                    for g in grams(w, size):
                        parts[x, g] += n
            for kind, found in (("w", words), ("g", parts)):
                keys = list(found)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys)), pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], ["kind", "lang", "item", "n"])

    counted = small_batches(chosen).mapInArrow(run, "kind string, lang string, item string, n bigint").groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))
    counted = stored(counted, "langid")
    table = lambda kind: counted.where(F.col("kind") == kind).select("lang", "item", "n").orderBy("lang", "item").toPandas()
    words = table("w")
    return Model(sorted(set(words["lang"])), words, table("g"))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of every row, whole texts.

    The score is the posterior of the language under the mean log frequencies a
    word, so long texts don't all come to 1: 0.25 of four languages says nothing.

    ``und`` and 0 where the text is null or has no letter, or the model is empty.
    Ties go to the language first in code-point order; rows that repeat get equal
    answers; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value
        for table in pieces(batches, "text", CHUNK_BYTES):
            langs, scores = one.predict(text_array(table, "text"))
            yield pa.RecordBatch.from_arrays([table.column("key").combine_chunks(), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    kind = dict(docs.dtypes)[key]
    rows = docs.selectExpr(f"`{key}` as key", f"`{text}` as text")
    return small_batches(rows).mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
