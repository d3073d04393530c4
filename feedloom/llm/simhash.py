"""SimHash fingerprints, links within a Hamming distance by pigeonring filtering, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import discard, join_split, pieces, small_batches, stored, text_array

SEED = 42
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))

#: Fingerprints of a bucket that are compared in one block with another.
BLOCK = 256

#: Groups up to this size are compared by shifting the sorted rows, larger ones as a matrix.
SMALL = 12


# -- XXH64 of many spans at once ------------------------------------------------------------------


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def _xxh64_equal(words: np.ndarray, buf: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """XXH64 of the spans of ``n`` bytes that begin at ``at``; ``words`` are the 8 bytes at each place."""
    s = np.uint64(seed)
    p = 0
    if n >= 32:
        v = [np.full(len(at), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
        while p + 32 <= n:
            v = [_round(v[i], words[at + (p + 8 * i)]) for i in range(4)]
            p += 32
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            h = (h ^ _round(np.uint64(0), x)) * _P1 + _P4
    else:
        h = np.full(len(at), s + _P5, np.uint64)
    h = h + np.uint64(n)
    while p + 8 <= n:
        h = _rotl(h ^ _round(np.uint64(0), words[at + p]), 27) * _P1 + _P4
        p += 8
    if p + 4 <= n:
        h = _rotl(h ^ ((words[at + p] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        p += 4
    while p < n:
        h = _rotl(h ^ (buf[at + p].astype(np.uint64) * _P5), 11) * _P1
        p += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxh64_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of ``buf[start:end]`` for every span."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    lengths = ends - starts
    order = np.argsort(np.minimum(lengths, 65535).astype(np.uint16), kind="stable")
    sizes = lengths[order]
    edges = np.flatnonzero(np.diff(sizes)) + 1
    raw = None
    with np.errstate(over="ignore"):
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(order)]):
            rows = order[a:b]
            if b - a >= 16:
                for c in range(0, b - a, 1 << 16):
                    part = rows[c : c + (1 << 16)]
                    out[part] = _xxh64_equal(words, padded, starts[part], int(sizes[a]), seed)
            else:
                raw = raw if raw is not None else memoryview(buf)
                for r in rows.tolist():
                    out[r] = xxhash.xxh64_intdigest(raw[starts[r] : ends[r]], seed)
    return out


# -- fingerprints ---------------------------------------------------------------------------------


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of an array of texts without nulls (large_string), and how many each text has."""
    low = pc.ascii_lower(texts)
    offsets = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1 + low.offset)[low.offset :]
    base, n_docs = int(offsets[0]), len(low)
    data = low.buffers()[2]
    size = int(offsets[-1]) - base
    buf = np.frombuffer(data, np.uint8, base + size)[base:].copy() if size else np.zeros(0, np.uint8)
    offsets = offsets - base
    none = np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    if not size:
        return none
    solid = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    before = np.concatenate([[False], solid[:-1]])
    before[offsets[:-1][offsets[:-1] < size]] = False
    after = np.concatenate([solid[1:], [False]])
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    w_start, w_end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after)
    if not len(w_start):
        return none
    doc = np.searchsorted(offsets, w_start, "right") - 1
    n_words = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    gaps = w_start[~first] - 1
    buf[gaps] = 32
    solid[gaps] = True
    place = np.cumsum(solid) - 1
    buf = buf[solid]
    w_start, w_end = place[w_start], place[w_end] + 1

    n_shingles = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    w_first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    s_first = np.concatenate([[0], np.cumsum(n_shingles)])
    s_doc = np.repeat(np.arange(n_docs), n_shingles)
    head = np.arange(s_first[-1]) - s_first[s_doc] + w_first[s_doc]
    tail = np.minimum(head + width, w_first[s_doc] + n_words[s_doc]) - 1
    return xxh64_spans(buf, w_start[head], w_end[tail]), n_shingles


def fingerprint_array(texts: pa.Array, width: int) -> np.ndarray:
    """64-bit fingerprints of an array of texts without nulls (large_string)."""
    return fold(*shingle_hashes(texts, width))


def fold(hashes: np.ndarray, n_shingles: np.ndarray) -> np.ndarray:
    """Fingerprints of texts from the hashes of their shingles, one after another, and how many each has."""
    n_docs = len(n_shingles)
    s_doc = np.repeat(np.arange(n_docs), n_shingles)
    ones = np.zeros((n_docs, 64), np.int64)
    for a in range(0, len(hashes), 1 << 15):
        h, d = hashes[a : a + (1 << 15)], s_doc[a : a + (1 << 15)]
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
        ones[d[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    on = ones * 2 > n_shingles[:, None]
    return np.packbits(on, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and its 64-bit fingerprint ``fp`` (as a signed bigint) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text"):
            fp = fingerprint_array(text_array(table, "text"), width)
            yield pa.RecordBatch.from_arrays([table.column("key").combine_chunks(), pa.array(fp.view(np.int64))], ["key", "fp"])

    kind = dict(docs.dtypes)[key]
    rows = docs.selectExpr(f"`{key}` as key", f"`{text}` as text")
    return small_batches(rows).mapInArrow(run, f"key {kind}, fp bigint").withColumnRenamed("key", key)


def groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows of each value of a column that they are sorted by, as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column).to_numpy()
        if not len(values):
            continue
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(column)[0].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


# -- pigeonring -----------------------------------------------------------------------------------


def segments(m: int) -> list[int]:
    """Masks of ``m`` consecutive segments of 64 bits, as even as can be."""
    cuts = [round(64 * i / m) for i in range(m + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def ring_keys(m: int, tau: int) -> list[tuple[tuple[int, ...], list[int]]]:
    """Sets of segments that are equal in some chain, each with the chain starts it serves.

    Two values within ``tau`` bits have a start from which, for every l, the
    first l segments differ in at most floor(l * tau / m) bits.  So the k-th
    segment that differs comes ceil(k * m / tau) segments after it or later;
    the others are equal.  All such choices of ``tau`` unequal segments, for
    all starts, are the keys: every link has one of them.
    """
    keys: dict[tuple[int, ...], list[int]] = {}
    for start in range(m):
        for off in combinations(range(1, m + 1), tau):
            if all(p * tau >= k * m for k, p in enumerate(off, 1)):
                equal = tuple(sorted((start + p - 1) % m for p in range(1, m + 1) if p not in off))
                keys.setdefault(equal, []).append(start)
    return sorted(keys.items())


def ring_pass(diff: np.ndarray, masks: np.ndarray, starts: list[int], tau: int) -> np.ndarray:
    """Which of the XOR values stay within the proportional budgets of a chain from one of ``starts``."""
    m = len(masks)
    ok = np.zeros(len(diff), bool)
    for start in starts:
        left = np.flatnonzero(~ok)
        total = np.zeros(len(left), np.uint8)
        for step in range(1, m + 1):
            total = total + np.bitwise_count(diff[left] & masks[(start + step - 1) % m])
            stay = total <= step * tau // m
            left, total = left[stay], total[stay]
            if not len(left):
                break
        ok[left] = True
    return ok


def near(diff: np.ndarray, masks: np.ndarray, starts: list[int], tau: int) -> np.ndarray:
    """Chains first, then the whole distance of what is left."""
    ok = ring_pass(diff, masks, starts, tau)
    at = np.flatnonzero(ok)
    ok[at] = np.bitwise_count(diff[at]) <= tau
    return ok


def choose_segments(n: int, tau: int) -> int:
    """So many segments that a key has about as many values as there are fingerprints, or more."""
    m = tau + 1
    while 64 * (m - tau) / m < np.log2(max(n, 2)) + 2 and m < tau + 7:
        m += 1
    return m


def _forest(values: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members and the least member of their component, without that member itself."""
    todo = np.ones(len(values), bool)
    members, roots = [], []
    for i in np.argsort(values, kind="stable"):
        if not todo[i]:
            continue
        todo[i] = False
        reach, edge = [], np.array([i])
        while len(edge):
            edge = np.flatnonzero(linked[edge].any(axis=0) & todo)
            todo[edge] = False
            reach.append(edge)
        got = np.concatenate(reach)
        members.append(values[got])
        roots.append(np.full(len(got), values[i]))
    return np.concatenate(members), np.concatenate(roots)


def _link_groups(fp: np.ndarray, group: np.ndarray, key: np.ndarray, keys, masks: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal ``group``: pairs of small runs, a forest of large ones."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    sizes = np.diff(cuts)
    size_of = np.repeat(sizes, sizes)
    us, vs = [], []
    small = np.flatnonzero((size_of > 1) & (size_of <= SMALL))
    for d in range(1, SMALL):
        a = small[small + d < len(fp)]
        a = a[group[a] == group[a + d]]
        if not len(a):
            break
        diff, k = fp[a] ^ fp[a + d], key[a]
        order = np.argsort(k, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(k[order])) + 1):
            hit = run[near(diff[run], masks, keys[k[run[0]]][1], tau)]
            us.append(fp[a[hit]])
            vs.append(fp[a[hit] + d])
    for i in np.flatnonzero(sizes > SMALL):
        own = fp[cuts[i] : cuts[i + 1]]
        diff = (own[:, None] ^ own[None, :]).reshape(-1)
        linked = near(diff, masks, keys[key[cuts[i]]][1], tau).reshape(len(own), -1)
        member, root = _forest(own, linked)
        us.append(member)
        vs.append(root)
    if not us:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(us), np.concatenate(vs)


def ball(mask: int, radius: int) -> np.ndarray:
    """All values of up to ``radius`` bits out of ``mask``."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return np.array([reduce(lambda x, y: x | y, some, 0) for r in range(radius + 1) for some in combinations(bits, r)], np.uint64)


def links(distinct: DataFrame, tau: int, n: int | None = None, block: int = BLOCK) -> DataFrame:
    """Edges ``u``, ``v`` over the distinct ``fp`` that connect whatever is linked within ``tau`` bits.

    Inside a block that many fingerprints share a key in, a forest stands for
    all its links: the components stay the same and no group makes all pairs.
    Buckets over ``block`` are split in blocks and every two blocks meet somewhere,
    so no link is lost and no task holds more than two blocks of a bucket.  That
    sends a fingerprint once a block, so buckets of more blocks than there are
    values within tau / 2 bits go another way: each fingerprint is sent to all
    values that near it, and those that meet at one value are within tau bits of
    each other, while every two within tau bits meet somewhere between them.
    """
    m = choose_segments(distinct.count() if n is None else n, tau)
    masks = np.array(segments(m), np.uint64)
    keys = ring_keys(m, tau)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    equal_bits = [reduce(lambda a, b: a | b, (int(masks[s]) for s in equal)) for equal, _ in keys]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(w))) for w in equal_bits])).alias("k", "v"))
    shared = stored(keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    sized = shared.select(F.struct("k", "v").cast("string").alias("_kv"), blocks.alias("blocks"))
    balls = [ball(~w & (1 << 64) - 1, tau // 2) for w in equal_bits]
    most = max(map(len, balls)) if tau % 2 == 0 else 1 << 30
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    placed = keyed.withColumn("_kv", F.struct("k", "v").cast("string"))
    met = (
        placed.join(sized.where(F.col("blocks") <= most), "_kv")
        .select("k", "v", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("k", "fp", F.xxhash64("k", "v", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table):
            g, k, fp = (table.column(c).to_numpy() for c in ("g", "k", "fp"))
            u, v = _link_groups(fp.view(np.uint64), g, k, keys, masks, tau)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))
            if cut:
                yield out(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield out(pa.Table.from_batches(held))

    grouped = met.repartition("g").sortWithinPartitions("g")
    found = grouped.mapInArrow(run, "u bigint, v bigint").where("u <> v")
    if shared.where(blocks > most).isEmpty():
        return found

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, fp in zip(batch.column("k").to_pylist(), batch.column("fp").to_numpy().view(np.uint64)):
                near_by = (fp ^ balls[k]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near_by), k, np.int32)), pa.array(near_by), pa.array(np.full(len(near_by), fp, np.uint64).view(np.int64))], ["k", "c", "fp"])

    huge = placed.join(sized.where(F.col("blocks") > most), "_kv").select(F.col("k").cast("int").alias("k"), "fp")
    spots = huge.mapInArrow(spread, "k int, c bigint, fp bigint").groupBy("k", "c").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("all"))
    return found.union(spots.select("u", F.explode("all").alias("v")).where("u <> v"))


# -- components -----------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``v`` and the least vertex ``label`` of its component, for every vertex of ``u``-``v`` edges.

    Each round takes the least label around a vertex, then the label of that
    label; labels are written to the shared folder between rounds.
    """
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("label")), "labels")
    while True:
        around = join_split(both, labels, "v", "inner").select(F.col("u").alias("v"), F.lit(None).cast("bigint").alias("old"), "label")
        own = labels.select("v", F.col("label").alias("old"), "label")
        lower = stored(own.union(around).groupBy("v").agg(F.max("old").alias("old"), F.min("label").alias("label")), "labels")
        jump = lower.select(F.col("v").alias("label"), F.col("label").alias("to"))
        after = stored(join_split(lower, jump, "label").select("v", F.coalesce("to", "label").alias("label"), "old"), "labels")
        discard(labels, lower)
        labels = after
        if after.where("label <> old").isEmpty():
            discard(both)
            return labels.select("v", "label")


def near_duplicates(docs: DataFrame, width: int = 5, tau: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp`` and ``component_id`` (least key reachable over links) of every row.

    Equal fingerprints are one vertex, so copies never make pairs.  Null and
    empty texts have fingerprint 0 and are linked like any other; texts of any
    length are read whole; rows that repeat a key or text are kept; an empty table
    gives an empty table; other columns of ``docs`` don't matter.
    """
    prints = stored(fingerprints(docs, width, key, text), "prints")
    vertices = stored(prints.groupBy("fp").agg(F.min(key).alias("least")), "vertices")
    labels = components(links(vertices.select("fp"), tau))
    of = vertices.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    placed = join_split(of, least, "label").select("fp", "component_id")
    return join_split(prints, placed, "fp").select(key, "fp", "component_id")
