"""SimHash near copies held to the Jaccard similarity of their shingles, and the pairs that fingerprints can't see.

Fingerprints within a few bits, found by pigeonring filtering, give the first
candidates; each is checked shingle by shingle, which takes out texts that are
near in bits alone.  Two texts of similarity 0.8 differ in 10 of 64 bits or so,
so fingerprints alone lose most pairs near the threshold at any length.  The
rest of the candidates are the pairs of sets that share enough of their first
shingles, in an order all sets follow: none at the threshold is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import BROADCAST_ROWS, collected, discard, join_small, join_split, pieces, small_batches, stored, text_array
from feedloom.llm.exact import _marks, _survives
from feedloom.llm import simhash
from feedloom.llm.simhash import components, shingle_hashes

#: Two texts are near copies if they share NUM / DEN of their distinct shingles or more.
WIDTH, NUM, DEN = 5, 4, 5

#: Bits that fingerprints of a first candidate may differ in.
TAU = 4

#: Texts that tell which shingles are common (about so many, by hash), and common shingles that are kept.
#: They only set the order in which shingles are looked at: any order finds every pair.
ORDER_DOCS, ORDER_SHINGLES = 10_000, 100_000

#: Rounds in which a bucket's texts are held against one of them, before what is still apart meets in pairs.
ROUNDS = 2

#: Texts that meet in a shingle in pairs at once; larger buckets go through the rounds.
SMALL = 64

#: Texts that are held against one other in one group.
GROUP = 256

#: Words of 64 bits in which a set's shingles are marked by parity; where they are fewer than two bits a shingle, ``wide`` has more.
MARKS = 8


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return small_batches(docs.selectExpr(f"`{key}` as key", f"`{text}` as text"))


def common_shingles(docs: DataFrame, key: str, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles in order, and how often each was seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text"):
            hashes, _ = shingle_hashes(text_array(table, "text"), width)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["h"])

    every = max(1, docs.count() // ORDER_DOCS)
    some = _rows(docs, key, text).where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    seen = some.mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 3").orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).toPandas()
    hashes, n = seen["h"].to_numpy(np.int64).view(np.uint64), seen["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def shingle_sets(docs: DataFrame, key: str, text: str, width: int, common: tuple[np.ndarray, np.ndarray], whole: bool) -> DataFrame:
    """``key``, ``fp`` (one for each set), its size ``n``, and distinct ``shingles`` of every row.

    ``whole`` gives all of them, else ``sim`` (the SimHash fingerprint), ``head``
    (the first shingles in the common order, rare ones first) ``marks`` (a bit
    for each hash value of MARKS words, one where an odd number of shingles fall),
    ``wide`` (such marks of at least two bits a shingle: in fewer those of long sets tell nothing).
    """
    known, often = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, "text"):
            hashes, counts = shingle_hashes(text_array(table, "text"), width)
            sim = None if whole else simhash.fold(hashes, counts)
            doc, level = np.repeat(np.arange(len(counts)), counts), np.zeros(len(hashes), np.int64)
            if len(known) and len(hashes):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                level = np.where(known[at] == hashes, often[at], 0)
            order = np.lexsort((hashes, level, doc))
            hashes, doc = hashes[order], doc[order]
            first = np.ones(len(hashes), bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
            hashes, doc = hashes[first], doc[first]
            n = np.bincount(doc, minlength=len(counts))
            ends = np.concatenate([[0], np.cumsum(n)])
            raw = memoryview(hashes.tobytes())
            fp = np.array([xxhash.xxh64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], np.uint64)
            columns = [table.column("key").combine_chunks(), pa.array(fp.view(np.int64)), pa.array(n, pa.int32())]
            if whole:
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)))]
            else:
                size = np.where(n > 0, n - (n * NUM + DEN - 1) // DEN + 1, 0)
                heads = hashes[np.arange(len(hashes)) - ends[doc] < size[doc]]
                wide = 64 * MARKS
                odd = (np.bincount(doc * wide + (hashes % np.uint64(wide)).astype(np.int64), minlength=len(n) * wide) & 1).astype(np.uint8)
                marks = np.packbits(odd, bitorder="little").view("<i8")
                words = MARKS << np.ceil(np.log2(np.maximum(n / (32 * MARKS), 1))).astype(np.int64)
                begins = 64 * np.concatenate([[0], np.cumsum(words)])
                odd = (np.bincount(begins[doc] + (hashes % (64 * words[doc]).astype(np.uint64)).astype(np.int64), minlength=begins[-1]) & 1).astype(np.uint8)
                spread = np.packbits(odd, bitorder="little").view("<i8")
                starts = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = [pa.array(sim.view(np.int64)), pa.ListArray.from_arrays(starts(size), pa.array(heads.view(np.int64))), pa.ListArray.from_arrays(starts(np.full(len(n), MARKS)), pa.array(marks)), pa.ListArray.from_arrays(starts(words), pa.array(spread))]
            yield pa.RecordBatch.from_arrays(columns + lists, ["key", "fp", "n", *(["shingles"] if whole else ["sim", "head", "marks", "wide"])])

    lists = "shingles array<bigint>" if whole else "sim bigint, head array<bigint>, marks array<bigint>, wide array<bigint>"
    return _rows(docs, key, text).mapInArrow(run, f"key {dict(docs.dtypes)[key]}, fp bigint, n int, {lists}")


def _possible(a: str, b: str):
    """Whether sizes, and places of a shared shingle in both sets, leave room for NUM / DEN of the union.

    Of the first shingle two sets share, both hold the rest behind it, so a pair
    that is near passes at that one.
    """
    shared = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return shared * (NUM + DEN) >= NUM * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _may_be_near(pairs: DataFrame, sides: DataFrame, few: bool = False) -> DataFrame:
    """The pairs whose marks differ in no more bits than near sets can in shingles, (n + m) (DEN - NUM) / (DEN + NUM).

    ``few`` pairs are sent to where the sides lie, so sides of no pair aren't shuffled and each pair meets its sides in one shuffle.

    A shingle of one set alone changes one bit, so no near pair is lost.  Near sets' marks are as wide, or one twice as
    wide: its halves are laid together.
    """
    of = lambda side: sides.select(F.col("fp").alias(side), F.col("n").alias(f"n_{side}"), F.col("wide").alias(f"m_{side}"))
    if few:
        found = of("u").join(F.broadcast(pairs), "u").join(of("v").join(F.broadcast(pairs), "v"), ["u", "v"])
    else:
        found = join_split(join_split(pairs, of("u"), "u", "inner"), of("v"), "v", "inner")
    either = lambda x, y: x.bitwiseXOR(y)

    def as_wide(a: str, b: str):
        size = F.size(b)
        return F.when(F.size(a) > size, F.zip_with(F.slice(a, F.lit(1), size), F.slice(a, size + 1, size), either)).otherwise(F.col(a))

    apart = F.zip_with(as_wide("m_u", "m_v"), as_wide("m_v", "m_u"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(apart, F.lit(0), lambda total, x: total + x)
    sized = found.where(F.least("n_u", "n_v") * DEN >= F.greatest("n_u", "n_v") * NUM)
    return sized.where(differ * (NUM + DEN) <= (F.col("n_u") + F.col("n_v")) * (DEN - NUM)).select("u", "v")


def near_pairs(pairs: DataFrame, sides: DataFrame, sets_of) -> DataFrame:
    """The pairs ``u``, ``v`` whose shingles are near, counted one by one; ``sides``: fp, n, marks of every set.

    A text that meets many is dealt to groups of GROUP of them.  Few pairs pick their sides where those lie.  Where no
    pair is left there is no more to do: no text is read.
    """
    met = stored(pairs.select("u", "v").distinct(), "met")
    many = met.count()
    if not many:
        return met
    few = many <= BROADCAST_ROWS
    pairs = stored(_may_be_near(met, sides, few), "pairs")
    discard(met)
    if pairs.isEmpty():
        return pairs
    sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("fp")))
    groups = pairs.groupBy("u").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("groups"))
    one = groups.join(sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), "u")
    one = one.select("u", "groups", "a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"))
    other = join_split(pairs, groups, "u", "inner").withColumn("g", F.pmod(F.xxhash64("v"), F.col("groups")).cast("int")).drop("groups")
    other = other.join(sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b")), "v")
    both = other.join(one.drop("groups"), ["u", "g"]).select("u", "v", F.size("a").alias("n"), F.size("b").alias("m"), F.size(F.array_intersect("a", "b")).alias("both"))
    near = stored(both.where(F.col("both") * DEN >= (F.col("n") + F.col("m") - F.col("both")) * NUM).select("u", "v"), "near")
    discard(pairs, sets)
    collected(near.sparkSession)
    return near


def _met_in_bits(prints: DataFrame, tau: int) -> DataFrame:
    """First candidates: sets of one fingerprint, and of fingerprints within ``tau`` bits, by their least sets."""
    least = stored(prints.groupBy("sim").agg(F.min("fp").alias("least")), "sims")
    alike = join_split(prints.select("sim", "fp"), least, "sim", "inner").where("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    edges = simhash.links(least.select("sim").withColumnRenamed("sim", "fp"), tau)
    for side in ("u", "v"):
        edges = join_split(edges, least.select(F.col("sim").alias(side), F.col("least").alias(f"_{side}")), side, "inner")
    return alike.union(edges.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")))


def _small_buckets(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that meet in a shingle of SMALL texts at most, share enough first shingles and aren't in one component yet.

    Of two near sets, the shared ones are among both sets' first, or behind the
    last first one of one of them.  What they share in larger buckets isn't
    counted here, so it is bounded by how many first shingles either has there.
    """
    wide = placed.groupBy("fp").agg(F.count(F.when(F.col("many") > SMALL, 1)).alias("wide"))
    small = placed.where(F.col("many") <= SMALL).groupBy("h").agg(F.collect_list(F.struct("fp", "n", "pos")).alias("all"))
    pairs = small.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y")).where(F.col("x.fp") < F.col("y.fp"))
    met = pairs.groupBy(F.col("x.fp").alias("u"), F.col("y.fp").alias("v")).agg(
        F.count("*").alias("shared"), F.first("x.n").alias("n"), F.first("y.n").alias("m"), F.max(_possible("x", "y")).alias("possible"),
    )
    behind = lambda size: F.floor(size * NUM / DEN)  # noqa: E731 - of n, all but the first n - ceil(n NUM / DEN) + 1
    room = F.col("shared") + F.greatest(behind(F.col("n")), behind(F.col("m")))
    needed = lambda have: have * (NUM + DEN) >= (F.col("n") + F.col("m")) * NUM
    likely = met.where("possible")
    for side in ("u", "v"):
        likely = join_split(likely, wide.withColumnsRenamed({"fp": side, "wide": f"wide_{side}"}), side)
    likely = likely.where(needed(room + F.least("wide_u", "wide_v")))
    for side in ("u", "v"):
        likely = join_split(likely, labels.select(F.col("v").alias(side), F.col("label").alias(f"label_{side}")), side)
    return likely.where(F.coalesce("label_u", "u") != F.coalesce("label_v", "v")).select("u", "v")


def _near_in_block(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group that are in two components and may be near by size, place and marks."""
    fp, n, pos, label = (table.column(c).to_numpy() for c in ("fp", "n", "pos", "label"))
    marks = table.column("marks").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(fp), MARKS)
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    us, vs = [], []
    for a in range(0, len(fp), GROUP):
        own = slice(a, a + GROUP)
        both = n[own, None] + n[None, :]
        shared = np.minimum((n - pos)[own, None], (n - pos)[None, :])
        may = (fp[own, None] < fp[None, :]) & (label[own, None] != label[None, :]) & (shared * (NUM + DEN) >= NUM * both)
        i, j = np.nonzero(may)
        differ = np.bitwise_count(marks[own][i] ^ marks[j]).sum(axis=1, dtype=np.int64)
        close = differ * (NUM + DEN) <= both[i, j] * (DEN - NUM)
        us.append(fp[own][i[close]])
        vs.append(fp[j[close]])
    return np.concatenate(us), np.concatenate(vs)


def _across(own: DataFrame, sides: DataFrame) -> DataFrame:
    """Pairs of a large bucket's texts that may be near, bucket by ``h``; ``own``: h, fp, n, pos, label.

    A bucket is split in blocks of GROUP texts and every two blocks meet once, so
    no task holds more than two blocks and no pair is a row before it has passed.
    """
    sides = sides.select("fp", "marks")
    blocks = own.groupBy("h").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("blocks"))
    dealt = join_split(join_split(own, sides, "fp", "inner"), blocks, "h", "inner").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.xxhash64("h", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "fp", "n", "pos", "label", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in simhash.groups(batches, "g"):
            u, v = _near_in_block(group)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return met.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u bigint, v bigint")


def joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``labels`` (``v`` and the least vertex of its component; none yet: None) with more edges ``u``, ``v``; both are discarded.

    Only what the edges link anew is worked on: an edge stands between the labels of its ends.
    """
    if labels is None:
        after = components(edges)
        discard(edges)
        collected(after.sparkSession)
        return after
    if edges.isEmpty():
        discard(edges)
        return labels
    between = edges.select("u", "v")
    for side in ("u", "v"):
        between = join_split(between, labels.select(F.col("v").alias(side), F.col("label").alias(f"_{side}")), side)
    between = stored(between.select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")).where("u <> v").distinct(), "between")
    discard(edges)
    if between.isEmpty():
        return labels
    roots = components(between)
    moved = join_split(labels, roots.select(F.col("v").alias("label"), F.col("label").alias("_root")), "label").select("v", F.coalesce("_root", "label").alias("label"))
    after = stored(moved.union(roots.join(labels.select("v"), "v", "left_anti").select("v", "label")), "labels")
    discard(labels, roots, between)
    collected(after.sparkSession)
    return after


def labelled(prints: DataFrame, sets_of, tau: int = TAU) -> DataFrame:
    """``v`` and the least vertex ``label`` of its component, for every distinct ``fp`` that has a near pair.

    First pairs that fingerprints show.  Then those that shingles show: sets that
    share NUM / DEN of their union share a shingle of their first
    n - ceil(n NUM / DEN) + 1, in any order all agree on.  The texts of a small
    bucket meet in pairs.  Those of a large one are first held against one of
    them, twice; then all that are not in one component yet meet block by block,
    which gives only the pairs whose sizes, places and marks leave room.  A pair
    left out is in one component already, or not near, so the components are those
    of all near pairs.
    """
    one = F.first(F.struct("n", "marks", "wide"))  # of one row
    sides = stored(prints.groupBy("fp").agg(one.alias("one")).select("fp", "one.*"), "sides")
    labels = joined(None, near_pairs(_met_in_bits(prints, tau), sides, sets_of))
    every = prints.select("fp", "n", F.posexplode("head").alias("pos", "h"))
    flagged = _survives(every, _marks(every.select("h")), F.col("h"), "_shared").where("_shared").drop("_shared")
    rows = stored(flagged.distinct(), "heads")
    many = rows.groupBy("h").agg(F.count("*").alias("many")).where("many > 1")
    placed = stored(join_split(rows, many, "h", "inner"), "placed")
    discard(rows)
    labels = joined(labels, near_pairs(_small_buckets(placed, labels), sides, sets_of))

    large_rows, large = placed, placed.where(F.col("many") > SMALL).drop("many")
    if large.isEmpty():
        discard(large_rows, sides)
        return labels
    for turn in range(ROUNDS + 1):
        placed = join_small(large, labels.withColumnRenamed("v", "fp"), "fp").withColumn("label", F.coalesce("label", "fp"))
        apart = placed.groupBy("h").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "fp").alias("by"), "fp", "n", "pos", "label")).alias("lead"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h", "lead")
        apart = stored(apart, "leads")
        if apart.isEmpty():
            discard(apart)
            break
        mine = F.struct("fp", "n", "pos", "label").alias("x")
        if turn < ROUNDS:
            pairs = join_split(placed.select("h", mine), apart, "h", "inner").where((F.col("x.label") != F.col("lead.label")) & _possible("x", "lead")).select(F.col("lead.fp").alias("u"), F.col("x.fp").alias("v"))
        else:
            own = stored(join_split(placed.select("h", "fp", "n", "pos", "label"), apart.select("h"), "h", "inner"), "apart")
            pairs = _across(own, sides)
        labels = joined(labels, near_pairs(pairs, sides, sets_of))
        discard(apart)
        if turn == ROUNDS:
            discard(own)
    discard(large_rows, sides)
    return labels


def similar_texts(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", tau: int = TAU) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` (least key reachable over near pairs) of every row.

    Shingles are ``width`` words in a row, ASCII letters in lower case, told
    apart by XXH64; a shorter text is one shingle.  Equal sets are one vertex.
    Texts without words are one set; rows that repeat a key or text are kept; a
    text of any length is read whole; an empty table gives an empty table.
    """
    common = common_shingles(docs, key, text, width)
    prints = stored(shingle_sets(docs, key, text, width, common, whole=False), "prints")
    vertices = stored(prints.groupBy("fp").agg(F.min("key").alias("least")), "vertices")

    def sets_of(fps: DataFrame) -> DataFrame:
        """Whole sets of ``fps``, and of few others: of texts whose keys a bit map of fixed size lets through; few go by their keys' hashes."""
        if fps.count() <= 2 * BROADCAST_ROWS:
            keys = vertices.join(F.broadcast(fps), "fp", "left_semi").select(F.xxhash64("least").alias("_h"))
            some = docs.select(key, text).join(F.broadcast(keys), F.xxhash64(key) == F.col("_h"), "left_semi")
        else:
            keys = join_split(fps.distinct(), vertices, "fp", "inner").select(F.xxhash64("least").alias("h"))
            some = _survives(docs.select(key, text), _marks(keys.union(keys)), F.xxhash64(key), "_met").where("_met").drop("_met")
        found = shingle_sets(some, key, text, width, common, whole=True)
        return stored(found.groupBy("fp").agg(F.first("shingles").alias("shingles")), "sets")

    labels = labelled(prints, sets_of, tau)
    of = vertices.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    placed = join_split(of, least, "label").select("fp", "component_id")
    return join_split(prints.select("key", "fp"), placed, "fp").withColumnRenamed("key", key)
