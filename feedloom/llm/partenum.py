"""Jaccard join of n-gram sets by PartEnum signatures, verified shingle by shingle; components of the links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.common import discard, join_split, pieces, small_batches, stored, text_array
from feedloom.llm.exact import BITS, BLOCK, _marks, _survives
from feedloom.llm.simhash import components, groups, shingle_hashes

#: Sets of a bucket that are compared in one block with another.
GROUP = 256

#: Rounds in which a set meets the closest of another component in its FEW least buckets, before all buckets are gone through.
ROUNDS, FEW = 2, 4

#: First-level parts more than are needed, one in so many: then sets with few empty parts need no signature of those.
SPARE = 12


# -- signatures -----------------------------------------------------------------------------------


def bands(num: int, den: int) -> np.ndarray:
    """Least size of each band: sets that share num / den of their union are in one band or in neighbours."""
    starts, low = [], 1
    while low < 1 << 31:
        starts.append(low)
        low = low * den // num + 1
    return np.array(starts, np.int64)


def plan(j: int, starts: np.ndarray, num: int, den: int) -> tuple[int, int, int, int] | None:
    """First-level parts, unequal and all second-level parts, and spare first-level parts, for pairs of bands j - 1 and j.

    Such sets differ in at most k elements if they are near.  Of n1 first-level
    parts, more than the spare ones differ in ``unequal`` elements or fewer, so
    in those all but ``unequal`` of their second-level parts are equal.
    """
    most = int(starts[j]) - 1
    k = (den - num) * (most + most * den // num) // (den + num)
    if k == 0:
        return None  # only equal sets are near
    if k <= 2:
        return 1, k, k + 2, 0
    need = k // 2 + 1
    spare = need // SPARE
    return need + spare, 1, 3, spare


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted; the text of each; how many each text has."""
    doc = np.repeat(np.arange(len(counts)), counts)
    hashes, ends = hashes.copy(), np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        hashes[a:b].sort()
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[first], doc[first], np.bincount(doc[first], minlength=len(counts))


def signatures(hashes: np.ndarray, doc: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets and whose they are: near sets that aren't equal share one.

    A set takes part in the instance of its band and the one below, and in that
    of its band and the one above.  The features are dealt to parts by a hash;
    a signature is the sum of hashes over a choice of second-level parts.
    """
    starts = bands(num, den)
    band = np.searchsorted(starts, n, side="right") - 1
    out, whose = [], []
    with np.errstate(over="ignore"):
        value = _mix(hashes + np.uint64(0x9E3779B97F4A7C15))
        for step in (0, 1):
            instance = band + step
            plans = {int(j): plan(int(j), starts, num, den) for j in np.unique(instance[n > 0]) if 0 < j < len(starts)}
            for shape in {p[1:3] for p in plans.values() if p}:
                unequal, parts = shape
                own = np.array([bool((p := plans.get(int(j))) and p[1:3] == shape) for j in instance]) & (n > 0)
                n1 = np.array([plans[int(j)][0] if o else 0 for j, o in zip(instance, own)], np.int64)
                spare = np.array([plans[int(j)][3] if o else 0 for j, o in zip(instance, own)], np.int64)
                base = np.concatenate([[0], np.cumsum(n1)])
                mine = own[doc]
                d, h = doc[mine], hashes[mine]
                x = _mix(h ^ (instance[d].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                first = ((x >> np.uint64(32)) * n1[d].astype(np.uint64)) >> np.uint64(32)
                second = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(parts)) >> np.uint64(32)
                cell = (base[d] + first.astype(np.int64)) * parts + second.astype(np.int64)
                total = np.zeros(int(base[-1]) * parts, np.uint64)
                np.add.at(total, cell, value[mine])
                filled = np.bincount(cell, minlength=len(total)).reshape(-1, parts)
                total = total.reshape(-1, parts)
                owner = np.repeat(np.arange(len(n)), n1)
                salt = _mix((np.arange(len(owner)) - base[owner]).astype(np.uint64) + (instance[owner].astype(np.uint64) << np.uint64(40)))
                kept = list(combinations(range(parts), parts - unequal))
                empty = np.stack([filled[:, c].sum(axis=1) == 0 for c in map(list, kept)], axis=1)
                # more parts than the spare ones agree, so a set with no more empty ones has a full one among them
                hollow = np.bincount(owner, weights=empty.any(axis=1), minlength=len(n)) > spare
                for i, c in enumerate(map(list, kept)):
                    keep = ~empty[:, i] | hollow[owner]
                    out.append(_mix(total[:, c].sum(axis=1, dtype=np.uint64) + salt * np.uint64(2 * i + 1))[keep])
                    whose.append(owner[keep])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(whose)


# -- passes over the texts ------------------------------------------------------------------------


def _prints(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One number for each set."""
    ends = np.concatenate([[0], np.cumsum(n)])
    raw = memoryview(hashes.tobytes())
    return np.array([xxhash.xxh64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], np.uint64)


def _bitmap(keys: DataFrame, repeated: bool = False) -> np.ndarray:
    """Values of ``h`` (those that occur twice or more) as one bit each of a map of fixed size (4 MB)."""
    at = F.pmod(F.col("h"), F.lit(BITS))
    block = F.floor(at / F.lit(BLOCK)).cast("int").alias("block")
    marks = _marks(keys) if repeated else keys.groupBy(block).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(BLOCK))).alias("bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for r in marks.collect():
        bits[r["block"] * BLOCK // 8 :][: len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _among(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the values may be in the map."""
    at = h.astype(np.uint64) & np.uint64(BITS - 1)
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _keyed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(x.view(np.uint64) + _mix(y.view(np.uint64)))


def _both(rows: DataFrame, x: str, y: str) -> DataFrame:
    """``h``: one number for two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_keyed(b.column(x).to_numpy(), b.column(y).to_numpy()).view(np.int64))], ["h"])

    return rows.select(x, y).mapInArrow(run, "h bigint")


class Sets:
    """Passes over the texts of ``docs``, whose shingles are hashed anew in each: the sets themselves are too large to keep.

    ``number`` is a 64-bit value of the key.  Only one text of each set (its
    least number) gives signatures; a map of fixed size tells which.
    """

    def __init__(self, docs: DataFrame, width: int, num: int, den: int, key: str, text: str):
        number = F.coalesce(F.col(key).cast("bigint") if dict(docs.dtypes)[key] in ("int", "bigint", "smallint", "tinyint") else F.xxhash64(key), F.lit(0))
        self.rows = small_batches(docs.select(F.col(key).alias("key"), number.cast("bigint").alias("number"), F.col(text).alias("text")))
        self.kind, self.width, self.num, self.den = dict(docs.dtypes)[key], width, num, den

    def prints(self) -> DataFrame:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in pieces(batches, "text"):
                hashes, _, n = distinct(*shingle_hashes(text_array(table, "text"), width))
                fp = _prints(hashes, n)
                yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("key", "number")), pa.array(fp.view(np.int64)), pa.array(n, pa.int64())], ["key", "number", "fp", "n"])

        return self.rows.mapInArrow(run, f"key {self.kind}, number bigint, fp bigint, n bigint")

    def once(self, prints: DataFrame) -> None:
        """Which text speaks for its set, where several have it."""
        self.vertices = prints.where("n > 0").groupBy("fp").agg(F.count("*").alias("copies"), F.min("number").alias("number"))
        often = stored(self.vertices.where("copies > 1"), "copied")
        self.copied = _bitmap(often.select(F.col("fp").alias("h")))
        self.speaks = _bitmap(_both(often, "fp", "number"))
        discard(often)

    def signed(self, among: np.ndarray | None = None) -> DataFrame:
        """``sig``, ``fp``, ``n`` of every set; with ``among`` those whose signature may be in that map, without it only ``h``, 40 bits of the signature.

        Fewer bits go through the shuffle that finds what occurs twice; what they take for equal without need is told apart later.
        """
        width, num, den, copied, speaks = self.width, self.num, self.den, self.copied, self.speaks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in pieces(batches, "text"):
                hashes, doc, n = distinct(*shingle_hashes(text_array(table, "text"), width))
                fp = _prints(hashes, n)
                one = ~_among(copied, fp) | _among(speaks, _keyed(fp, table.column("number").to_numpy()))
                sig, whose = signatures(hashes[one[doc]], doc[one[doc]], np.where(one, n, 0), num, den)
                if among is None:
                    yield pa.RecordBatch.from_arrays([pa.array((sig & np.uint64((1 << 40) - 1)).view(np.int64))], ["h"])
                    continue
                met = _among(among, sig)
                sig, whose = sig[met], whose[met]
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(fp[whose].view(np.int64)), pa.array(n[whose], pa.int64())], ["sig", "fp", "n"])

        return self.rows.mapInArrow(run, "h bigint" if among is None else "sig bigint, fp bigint, n bigint")

    def whole(self, fps: DataFrame) -> DataFrame:
        """``fp``, ``marks`` and all ``shingles`` of some sets, from texts whose key's number a map of fixed size lets through.

        Marks: a bit for each hash value, one where an odd number of shingles fall;
        there are twice as many bits as shingles or more, and a power of two.
        """
        width = self.width
        some = _bitmap(join_split(self.vertices, fps, "fp", "inner").select(F.col("number").alias("h")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = (b.filter(pa.array(_among(some, b.column("number").to_numpy()))) for b in batches)
            for table in pieces((b for b in kept if b.num_rows), "text"):
                hashes, doc, n = distinct(*shingle_hashes(text_array(table, "text"), width))
                fp, ends = _prints(hashes, n), np.concatenate([[0], np.cumsum(n)])
                marks = [mark(hashes[a:b]).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(marks, pa.binary()), lists], ["fp", "marks", "shingles"])

        return self.rows.mapInArrow(run, "fp bigint, marks binary, shingles array<bigint>")


def mark(hashes: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each of 64 bits or more, as words."""
    size = 64
    while size < 2 * len(hashes):
        size *= 2
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(marks: np.ndarray, words: int) -> np.ndarray:
    """Marks of fewer words: bits that fall together are added."""
    while marks.shape[-1] > words:
        half = marks.shape[-1] // 2
        marks = marks[..., :half] ^ marks[..., half:]
    return marks


# -- links ----------------------------------------------------------------------------------------


def _only(sets: DataFrame, fps: DataFrame) -> DataFrame:
    """Sets that a map of fixed size lets through: nearly all others aren't dealt to a join."""
    keys = fps.toDF("h")
    return _survives(sets, _marks(keys.union(keys)), F.col("fp"), "_met").where("_met").drop("_met")


def _near(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``u``, ``v`` that share num / den of their union: marks first, then counted shingle by shingle."""
    pairs = stored(pairs.select("u", "v"), "pairs")
    met = pairs
    for side in ("u", "v"):
        met = join_split(met, _only(sets.select("fp", "marks", F.size("shingles").alias("n")), pairs.select(side)).toDF(side, f"m_{side}", f"n_{side}"), side, "inner")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y, n in zip(b.column("m_u").to_pylist(), b.column("m_v").to_pylist(), (b.column("n_u").to_numpy() + b.column("n_v").to_numpy()).tolist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                words = min(len(x), len(y))
                keep.append(int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) * (den + num) <= n * (den - num))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    likely = stored(met.mapInArrow(close, "u bigint, v bigint").distinct(), "likely")
    lists = sets.select("fp", "shingles")
    got = join_split(likely, _only(lists, likely.select("v")).toDF("v", "b"), "v", "inner")
    got = join_split(got, _only(lists, likely.select("u")).toDF("u", "a"), "u", "inner")
    counted = got.select("u", "v", F.size("a").alias("n"), F.size("b").alias("m"), F.size(F.array_intersect("a", "b")).alias("both"))
    near = stored(counted.where(F.col("both") * den >= (F.col("n") + F.col("m") - F.col("both")) * num).select("u", "v"), "near")
    discard(pairs, likely)
    return near


def _block_pairs(table: pa.Table, num: int, den: int, closest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks, of different labels, whose sizes and marks leave room; with ``closest`` one for each set at most."""
    fp, n, label = (table.column(c).to_numpy() for c in ("fp", "n", "label"))
    raw = [np.frombuffer(m, "<u8") for m in table.column("marks").to_pylist()]
    words = min(map(len, raw))
    marks = np.stack([folded(m, words) for m in raw])
    us, vs = [], []
    for a in range(0, len(fp), GROUP):
        own = slice(a, a + GROUP)
        may = label[own, None] != label[None, :]
        if not closest:
            may &= fp[own, None] < fp[None, :]
        may &= np.maximum(n[own, None], n[None, :]) * num <= np.minimum(n[own, None], n[None, :]) * den
        i, j = np.nonzero(may)
        for c in range(0, len(i), 1 << 14):
            x, y = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
            differ = np.bitwise_count(marks[own][x] ^ marks[y]).sum(axis=1, dtype=np.int64)
            close = differ * (den + num) <= (n[own][x] + n[y]) * (den - num)
            x, y, differ = x[close], y[close], differ[close]
            if closest:
                order = np.lexsort((fp[y], differ, x))
                x, y = x[order], y[order]
                first = np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]
                x, y = x[first], y[first]
            us.append(np.minimum(fp[own][x], fp[y]))
            vs.append(np.maximum(fp[own][x], fp[y]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def _labelled(rows: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the component ``label_x`` of each column x."""
    for c in columns:
        rows = join_split(rows, labels.select(F.col("v").alias(c), F.col("label").alias(f"label_{c}")), c).withColumn(f"label_{c}", F.coalesce(f"label_{c}", c))
    return rows


def _apart(buckets: DataFrame, cross: DataFrame) -> DataFrame:
    """Buckets in which a set and the leader are in two components; maps of fixed size may let others through."""

    def kept(rows: DataFrame, test) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(test(b)))

        return rows.mapInArrow(run, rows.schema)

    met = _bitmap(_both(cross, "u", "v"))
    hit = kept(buckets, lambda b: _among(met, _keyed(b.column("lead").to_numpy(), b.column("fp").to_numpy())))
    two = _bitmap(hit.select(F.col("sig").alias("h")))
    return kept(buckets, lambda b: _among(two, b.column("sig").to_numpy()))


def _across(rows: DataFrame, sets: DataFrame, num: int, den: int, closest: bool = False) -> DataFrame:
    """Pairs of a bucket that are in two components and may be near (or each set's closest): blocks of GROUP sets, every two of which meet once."""
    blocks = rows.groupBy("sig").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("blocks"))
    marked = join_split(rows.select("sig", "fp", "n", "label"), sets.select("fp", "marks"), "fp", "inner")
    dealt = join_split(marked, blocks, "sig", "inner").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(F.xxhash64("sig", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "fp", "n", "label", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "g"):
            u, v = _block_pairs(group, num, den, closest)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return met.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u bigint, v bigint").distinct()


def links(sets: Sets, prints: DataFrame, num: int, den: int) -> DataFrame:
    """Edges ``u``, ``v`` over the distinct sets that connect whatever is linked.

    Sets that share a signature are a bucket.  Each set is first held against
    the leader it shares most signatures with, then against the leaders of all
    its buckets that are in another component, then against the closest of
    another component in a few buckets, and what is in two components
    even then meets block by block.  A pair that is left out is in one component
    already, or not near.
    """
    sets.once(prints)
    rows = stored(sets.signed(_bitmap(sets.signed(), repeated=True)), "signed")
    leads = rows.groupBy("sig").agg(F.min(F.struct("fp", "n")).alias("lead"), F.max("fp").alias("hi")).where("lead.fp <> hi")
    buckets = stored(join_split(rows, leads.select("sig", F.col("lead.fp").alias("lead"), F.col("lead.n").alias("size")), "sig", "inner"), "buckets")
    discard(rows)
    stars = buckets.where("fp <> lead").groupBy(F.col("lead").alias("u"), F.col("fp").alias("v")).agg(F.count("*").alias("shared"), F.first("size").alias("n"), F.first("n").alias("m"))
    stars = stored(stars.withColumn("fits", F.greatest("n", "m") * num <= F.least("n", "m") * den), "stars")
    whole = stored(sets.whole(stars.select(F.col("u").alias("fp")).union(stars.select("v")).distinct()), "sets")

    best = stored(stars.where("fits").groupBy("v").agg(F.max(F.struct("shared", "u"))["u"].alias("u")), "best")
    edges = _near(best, whole, num, den)
    other = join_split(stars.where("fits").select("u", "v"), best.select("v", F.col("u").alias("first")), "v").where("u <> first")
    edges = edges.union(_near(_labelled(other, components(edges), "u", "v").where("label_u <> label_v"), whole, num, den))
    for turn in range(ROUNDS + 1):
        labels = components(edges)
        cross = stored(_labelled(stars.select("u", "v"), labels, "u", "v").where("label_u <> label_v"), "cross")
        if cross.isEmpty():
            break
        left = _apart(buckets, cross).select("sig", "fp", "n")
        if turn < ROUNDS:
            # Sets that are alike share most signatures, so they agree on which are the least.
            least = Window.partitionBy("fp").orderBy(F.xxhash64(F.lit(turn), "sig"), "sig")
            left = left.withColumn("_nth", F.row_number().over(least)).where(F.col("_nth") <= FEW).drop("_nth")
        left = stored(_labelled(left, labels, "fp").withColumnRenamed("label_fp", "label"), "apart")
        edges = edges.union(_near(_across(left, whole, num, den, closest=turn < ROUNDS), whole, num, den))
        discard(left, cross)
    edges = stored(edges, "links")
    discard(buckets, stars, whole, best)
    return edges


def similar_sets(docs: DataFrame, width: int = 4, num: int = 17, den: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp``, ``n_shingles`` and ``component_id`` (least key reachable over links) of every row.

    A row's set holds the distinct shingles of ``width`` words in a row, ASCII
    letters in lower case, told apart by XXH64; fewer words are one shingle.
    Two rows link when their sets share num / den of their union or more.  Equal
    sets are one vertex, told by 64 bits, so copies never make pairs.

    Null texts and texts without words have empty sets, linked with nothing;
    texts of any length are read whole; rows that repeat a key or text are kept;
    a null key is never the least unless all of its component are null; an empty table
    gives an empty table; other columns of ``docs`` don't matter.
    """
    sets = Sets(docs, width, num, den, key, text)
    prints = stored(sets.prints(), "prints")
    vertices = stored(prints.where("n > 0").groupBy("fp").agg(F.min("key").alias("least")), "vertices")
    labels = components(links(sets, prints, num, den))
    of = vertices.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    placed = join_split(of, least, "label").select("fp", "component_id")
    found = join_split(prints.select("key", "fp", "n"), placed, "fp")
    return found.select(F.col("key").alias(key), "fp", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))
