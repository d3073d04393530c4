"""BPE encoding and decoding over a table of distinct words."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm import packed
from feedloom.llm.common import shuffle_partitions

#: Words of these characters alone are split and lower-cased here as the library does it.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
#: Words of one piece, with or without a full stop or comma after it.
_LETTERS_STOP = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of single words, each distinct word and each distinct piece of words being encoded once.

    White space never takes part in a token of this kind of vocabulary (it is
    dropped before merging and no special token holds any), so the ids of a text
    are those of its words, one after another.
    """

    def __init__(self, path: str, most: int = 50_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        if any("<" not in s for s in self.special):
            raise ValueError("special tokens are looked for by their <")
        self.known: dict[str, list[int]] = {}
        self.most = most
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        place = {b: b for b in keep} | {b: 256 + i for i, b in enumerate(rest)}
        self.shown = "".join(chr(place[b]) for b in range(256))

    def piece(self, piece: str) -> list[int]:
        """Ids of one lower-cased piece."""
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= self.most:
                self.known.clear()
            ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))]
            self.known[piece] = ids
        return ids

    def encode(self, word: str) -> list[int]:
        if word.isascii():
            if word.isalpha():
                return self.piece(word.lower())
            if word[-1] in ".," and word[:-1].isalpha():
                return self.piece(word[:-1].lower()) + self.piece(word[-1])
        if not _PLAIN.fullmatch(word) or ("<" in word and any(s in word for s in self.special)):
            return self.whole.encode(word, add_special_tokens=False).ids
        if word.isalpha():
            return self.piece(word.lower())
        out: list[int] = []
        for piece in _PIECES.findall(word.lower()):
            out += self.piece(piece)
        return out

    def encode_all(self, words: pa.Array) -> pa.ListArray:
        """Ids of every word of an array of distinct words.

        Words that differ in case or a closing stop alone share a piece, which is
        encoded once.
        """
        words = words.cast(pa.large_string())
        simple = pc.match_substring_regex(words, _LETTERS_STOP)
        plain = words.filter(simple)
        stems = pc.utf8_lower(pc.ascii_rtrim(plain, ".,")).dictionary_encode()
        flat: list[int] = []
        lengths: list[int] = []

        def add(ids: list[int]) -> None:
            flat.extend(ids)
            lengths.append(len(ids))

        # Pieces never hold a line feed, so all are mapped to the vocabulary's characters at once.
        shown = "\n".join(stems.dictionary.to_pylist()).encode().decode("latin-1").translate(self.shown)
        tokenize = self.model.tokenize
        for x in shown.split(self.shown[10]) if shown else ():
            add([t.id for t in tokenize(x)])
        stop, comma = len(lengths), len(lengths) + 1
        add(self.piece("."))
        add(self.piece(","))
        first = np.empty(len(words), np.int64)
        is_simple = simple.to_numpy(zero_copy_only=False)
        first[is_simple] = stems.indices.to_numpy(zero_copy_only=False)
        first[~is_simple] = np.arange(len(lengths), len(lengths) + len(words) - len(plain))
        for x in words.filter(pc.invert(simple)).to_pylist():
            add(self.encode(x))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        units = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.uint32)))
        stopped = is_simple & pc.ends_with(words, ".").to_numpy(zero_copy_only=False)
        closed = is_simple & pc.ends_with(words, ",").to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(1 + (stopped | closed))])
        order = np.empty(int(at[-1]), np.int64)
        order[at[:-1]] = first
        order[at[1:][stopped] - 1] = stop
        order[at[1:][closed] - 1] = comma
        taken = units.take(pa.array(order))
        return pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[at], pa.int32()), taken.values)

_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for a worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _parts_of(vocab: pa.Array, parts: int) -> np.ndarray:
    """Partition of each word in the table of distinct words: a hash of the word."""
    if not len(vocab):
        return np.zeros(0, np.int64)
    hashes = pd.util.hash_array(np.asarray(vocab.to_pandas(), dtype=object), categorize=False)
    return (hashes % np.uint64(parts)).astype(np.int64)


def _words_out(words: list[str]) -> bytes:
    return packed.squeeze("\n".join(words).encode())


def _words_in(data: bytes) -> list[str]:
    return packed.expand(data).decode().split("\n")


def encode_ids(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", steady: bool = False) -> DataFrame:
    """``key``, ``n_tokens`` and ``ids array<int>`` of every whole text.

    Documents are split in words chunk by chunk; the distinct words of a chunk
    go to the table of distinct words, partitioned by hash, where each is encoded
    once; ids come back and are put at the positions of their words.  Null counts
    as empty: no ids.  Texts of any length are encoded whole; rows that repeat are
    encoded each; an empty table gives an empty table; other columns of ``docs``
    don't matter.  ``steady``: ``docs`` is a table of files; else it is stored first.
    """
    path = path or default_path()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = packed.parts_for(size, shuffle_partitions(docs.sparkSession))
    kind = dict(docs.dtypes)[key]

    def side(vocab: pa.Array) -> tuple[bytes, bytes]:
        """The words by partition, and the partition of each."""
        if not len(vocab):
            return b"", packed.pack_ints(np.zeros(0, np.int64))
        return _words_out(vocab.to_pylist()), packed.pack_ints(_parts_of(vocab, parts))

    def request(row: dict) -> Iterator[tuple[int, bytes]]:
        if not row["ask"]:
            return
        part = packed.unpack_ints(row["place"]).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        ordered = pa.array(_words_in(row["ask"])).take(pa.array(order)).to_pylist()
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            yield p, _words_out(ordered[cuts[p] : cuts[p + 1]])

    def serve(keys: list[bytes]) -> list[bytes]:
        one = encoder(path)
        table: dict[str, list[int]] = {}
        out = []
        for data in keys:
            lengths, flat = [], []
            for word in _words_in(data):
                ids = table.get(word)
                if ids is None:
                    ids = table[word] = one.encode(word)
                lengths.append(len(ids))
                flat += ids
            a, b = packed.pack_ints(np.array(lengths, np.int64)), packed.pack_ints(np.array(flat, np.int64))
            out.append(len(a).to_bytes(8, "little") + a + b)
        return out

    def finish(row: dict, answers: list[tuple[int, bytes]]) -> pd.DataFrame:
        codes = packed.unpack_codes(row["codes"]).astype(np.int64)
        part = packed.unpack_ints(row["place"]).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        n_words = len(part)
        lengths, flat = [], []
        for p, data in answers:
            n = int.from_bytes(data[:8], "little")
            lengths.append(packed.unpack_ints(data[8 : 8 + n]).astype(np.int64))
            flat.append(packed.unpack_ints(data[8 + n :]).astype(np.int64))
            if len(lengths[-1]) != cuts[p + 1] - cuts[p]:
                raise RuntimeError("a chunk's words and their ids differ in number")
        counts = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        if len(counts) != n_words:
            raise RuntimeError("a chunk's words did not all come back")
        ids = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
        n_ids, begin = np.empty(n_words, np.int64), np.empty(n_words, np.int64)
        n_ids[order], begin[order] = counts, np.cumsum(counts) - counts
        at = np.concatenate([[0], np.cumsum(np.asarray(row["n_words"], np.int64))])
        own = n_ids[codes]
        total = np.concatenate([[0], np.cumsum(own)])
        placed = ids[np.repeat(begin[codes] - total[:-1], own) + np.arange(total[-1])]
        ends = total[at]
        frame = pd.DataFrame({"key": list(row["ids"]), "n_tokens": np.diff(ends), "ids": [placed[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]})
        return frame.astype({"key": "Int64"}) if kind in ("bigint", "int") else frame

    return packed.ask(docs, key, text, side, request, serve, finish, f"key {kind}, n_tokens bigint, ids array<int>", steady)


def pieces(path: str) -> list[str]:
    """Piece of every id of a vocabulary, empty where an id has none."""
    whole = encoder(path).whole
    return [whole.id_to_token(i) or "" for i in range(whole.get_vocab_size())]


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: each row's ids joined with the id-to-piece table, pieces in the ids' order.

    The table is a fixed file of known size, so it goes to every task with the
    plan as one array and the join is a look-up by id where the ids are: nothing
    is shuffled and no Python worker runs.  Pieces are joined by a space as the
    library does for a vocabulary without a decoder; ids that the table doesn't
    have are left out, as there.  Null stays null.
    """
    listed = pieces(path or default_path())
    if any("\n" in x for x in listed):
        raise ValueError("a piece holds a line feed")
    table = F.split(F.lit("\n".join(listed)), "\n", -1)
    return encoded.withColumn("decoded", F.array_join(F.transform(F.col(ids), lambda i: F.get(table, i)), " "))


def with_digests(decoded: DataFrame) -> DataFrame:
    """``decoded`` with ``ids_sha256`` (of the decimal ids, joined by a space) and ``decoded_sha256``."""
    return decoded.withColumn("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)).withColumn("decoded_sha256", F.sha2("decoded", 256))


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", steady: bool = False) -> DataFrame:
    """``key``, ``n_tokens``, ``ids``, ``decoded``, and the digests of both, of every whole text (see ``encode_ids``)."""
    return with_digests(decode(encode_ids(docs, path, key, text, steady), path))
