"""Secret scans: keyword automaton, anchored patterns near its hits, embedded checksums."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from feedloom.llm.common import pieces, small_batches

#: Kinds in the order that ties of a start are listed in.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]+")
_NPM = re.compile(rb"npm_[A-Za-z0-9]+")
_JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*")
_JWT_PART = re.compile(rb"[A-Za-z0-9_-]*")
_B62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Keyword (as the lower-cased text has it) -> kind.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt"}

_HEX_RUN = b"x" * 32
_AS_HEX = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))


def _base62(n: int, width: int) -> bytes:
    out = b""
    while n:
        n, r = divmod(n, 62)
        out = _B62[r : r + 1] + out
    return out.rjust(width, b"0")


def _checksummed(m: re.Match) -> bool:
    """36 characters after the prefix, the last 6 being the CRC-32 of the other 30 in base 62."""
    body = m.group()[4:]
    return len(body) == 36 and _base62(zlib.crc32(body[:30]), 6) == body[30:]


def _is_jwt(m: re.Match) -> bool:
    """Header and claims decode to JSON objects and the header names an algorithm."""
    try:
        head, claims = (json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))) for part in m.groups())
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head and isinstance(claims, dict)


_CHECKS = {
    "assign": (_ASSIGN, lambda m: len(m.group(2)) >= 8),
    "access": (_ACCESS, lambda m: len(m.group()) >= 16),
    "github": (_GITHUB, _checksummed),
    "npm": (_NPM, _checksummed),
    "jwt": (_JWT, _is_jwt),
}


def _code_points(raw: bytes, at: list[int]) -> dict[int, int]:
    """Code points before each of the byte places, counted in one sweep over the text."""
    heads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    out, past, seen = {}, 0, 0
    for p in sorted(set(at)):
        seen += int(np.count_nonzero(heads[past:p]))
        out[p], past = seen, p
    return out


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def scan(text: str | None, keywords=None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start, then kind as in KINDS.

    The patterns are ASCII, so they run on UTF-8 bytes; lower-casing bytes only
    touches ASCII letters and moves nothing.  A kind's pattern starts with one of
    its keywords, so trying it at the hits from left to right, past the end of
    the match before, finds what a search of the whole text would find.  Hex runs
    have no keyword: 32 marks in a row on a translated copy take its place.
    """
    if not text:
        return []
    raw = text.encode()
    starts: dict[str, list[int]] = {}
    for end, (kind, length) in (keywords or automaton()).iter(raw.lower().decode("latin-1")):
        starts.setdefault(kind, []).append(end - length + 1)
    spans = []
    for kind, at in starts.items():
        pattern, passes = _CHECKS[kind]
        past = 0
        for p in sorted(at):
            if p < past:
                continue
            if m := pattern.match(raw, p):
                past = m.end()
                if passes(m):
                    spans.append((kind, p, past))
            elif kind == "jwt" and raw.startswith(b"eyJ", p):
                past = _JWT_PART.match(raw, p).end()
    marks = raw.translate(_AS_HEX)
    p = marks.find(_HEX_RUN)
    while p >= 0:
        end = _HEX.match(raw, p).end()
        spans.append(("hex", p, end))
        p = marks.find(_HEX_RUN, end)
    if len(raw) != len(text):
        point = _code_points(raw, [p for _, s, e in spans for p in (s, e)])
        spans = [(k, point[s], point[e]) for k, s, e in spans]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = automaton()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for table in pieces(batches, "text"):
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, keywords)] for t in table.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([table.column("key").combine_chunks(), pa.array(found, kind)], ["key", "spans"])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans array<struct<kind,start,end>>`` of every row.

    A null or empty text has no spans; rows that repeat are scanned each; texts
    of any length are scanned whole, in time linear in their length; other
    columns of ``docs`` don't matter; an empty table gives an empty table.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.selectExpr(f"`{key}` as key", f"`{text}` as text")
    return small_batches(rows).mapInArrow(_scan_batches, f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("key", key)
