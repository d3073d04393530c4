"""Hard negatives, conversations and n-gram joins against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from itertools import product

from pyspark.sql import functions as F

from feedloom.llm import convrepair, hardneg, partenum, queries
from tests.llm.conftest import LONG


def _mined(rows, asked, positives=5, negatives=5):
    """Plain Python: rows are (vec_id, vector, label)."""
    ok = [(k, [math.floor(256 * x) for x in v], c) for k, v, c in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    low = lambda k: -math.inf if k is None else k
    out = []
    for i, (k, v, c) in enumerate(ok):
        if not asked(k):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), low(m), m, d) for j, (m, w, d) in enumerate(ok) if j != i), key=lambda x: x[:2])
        for s, _, p, d in [x for x in scored if x[3] == c][:positives]:
            fit = [x for x in scored if x[3] != c and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(k, p, n, x[2], -s, -x[0]) for n, x in enumerate(fit, 1)]
    return sorted(map(str, out))


VECTORS = "vec_id bigint, embedding array<float>, label int, row string, id string, score int"


def test_hard_negatives_equal_brute_force(spark):
    """Tiles of a few rows, ragged and empty vectors, repeats, ties, null keys, unusable rows, clashing columns."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.1, 0.25, 0.7]) for _ in range(rng.choice([10, 10, 10, 3, 6]))], 0 if i % 3 else i % 4) for i in range(90)]
    rows += [(7, rows[7][1], rows[7][2]), (10, rows[10][1], 3), (200, [], 0), (210, None, 0), (220, [0.5, None], 0), (230, [float("nan")] * 10, 1), (240, [float("inf")], 1), (250, [0.5] * 10, None), (None, [0.7] * 10, 0), (None, [0.7] * 10, 1), (260, [0.7] * 10, 2)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], VECTORS).repartition(3)
    got = hardneg.mine(df, F.col("vec_id") % 10 == 0, tile=(3, 7, 4))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = _mined(rows, lambda k: k is not None and k % 10 == 0)
    assert sorted(str(tuple(r)) for r in got.collect()) == expected and len(expected) > 50


def test_hard_negatives_without_rows(spark):
    df = spark.createDataFrame([(1, [0.5], 1, "", "", 1)], VECTORS)
    assert hardneg.mine(df.limit(0), F.col("vec_id") == 1).count() == 0
    assert hardneg.mine(df, F.col("vec_id") == 1).count() == hardneg.mine(df, F.lit(False)).count() == 0


# -- conversations --------------------------------------------------------------------------------

ROLES = re.compile(r"(s?(ua)+)?\Z")


def _all_edits(rows):
    """Cheapest and ASCII-least of every edit sequence with at most two rows inserted at a place; rows: (role, fault)."""
    ways = [("", "", 0)]
    inserted = [("", "", 0)] + [("I" * n, "".join(x), 2 * n) for n in (1, 2) for x in product("ua", repeat=n)]
    for role, fault in rows:
        more = 1 if fault == "truncated" else 0
        edits = [("D", "", 3)] + ([] if fault in ("blank", "duplicate") else [("K", role[:1], more), ("R", "u", 2 + more), ("R", "a", 2 + more)])
        ways = [(a + i + e, r + x + y, c + p + q) for a, r, c in ways for i, x, p in inserted for e, y, q in edits]
    return min((c + p, a + i) for a, r, c in ways for i, x, p in inserted if ROLES.match(r + x))


def _fold(rows):
    """The same over (rows done, last initial), for conversations of any length."""
    follow = lambda last: "u" if last in ("", "s", "a") else "a"

    def with_inserts(best):
        for _ in range(3):
            for last, (c, a) in list(best.items()):
                way = (c + 2, a + "I")
                best[follow(last)] = min(way, best.get(follow(last), way))
        return best

    best = with_inserts({"": (0, "")})
    for role, fault in rows:
        more, after = int(fault == "truncated"), {}
        for last, (c, a) in best.items():
            ways = [(last, c + 3, "D")]
            if fault not in ("blank", "duplicate"):
                ways.append((follow(last), c + 2 + more, "R"))
                if role[:1] == follow(last) or (role[:1] == "s" and last == ""):
                    ways.append((role[:1], c + more, "K"))
            for to, cost, edit in ways:
                after[to] = min((cost, a + edit), after.get(to, (cost, a + edit)))
        best = with_inserts(after)
    return min(best[x] for x in ("", "a") if x in best)


def _faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _repaired(turned):
    """Plain Python: (turn, role, text) in order to every column of the result."""
    rows = [x[1:] for x in turned]
    faults = _faults(rows)
    cost, audit = _fold([(r, f) for (r, _), f in zip(rows, faults)])
    out, left, last = [], iter(rows), ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit != "D":
            role = role if edit == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            out.append(f"{role}:{text}")
    turns = [t for t, *_ in turned if t is not None]
    initials = [r[:1] for r, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_a_star_equals_every_edit():
    rng = random.Random(1)
    kinds = [(r, f) for r in ("system", "user", "assistant", "tool") for f in (None, "blank", "duplicate", "truncated")]
    for rows in [[], *[[x] for x in kinds], *[[rng.choice(kinds) for _ in range(2)] for _ in range(60)], *[[rng.choice(kinds) for _ in range(3)] for _ in range(6)]]:
        initials, faults = [r[:1] for r, _ in rows], [f for _, f in rows]
        ((cost, audit),) = convrepair.solve(initials, faults, convrepair.START, convrepair.ENDS).values()
        assert (cost, audit) == _all_edits(rows) == _fold(rows), rows
    for n in (5, 20, 200):
        rows = [rng.choice(kinds) for _ in range(n)]
        ((cost, audit),) = convrepair.solve([r[:1] for r, _ in rows], [f for _, f in rows], convrepair.START, convrepair.ENDS).values()
        assert (cost, audit) == _fold(rows)


def test_conversations_equal_brute_force(spark):
    """Null keys, turns, roles and texts, repeats, long texts, clashing columns; a conversation cut in many pieces and spread over ranges."""
    rng = random.Random(2)
    texts = ["Fine.", "Cut off", "", " \t", "Why?\n", "été!", None, LONG]
    rows = [(k, rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.random()}.") for k in [*range(60), None] for _ in range(rng.randrange(1, 7))]
    rows += [(1000, i, rng.choice(["user", "assistant"]), rng.choice(["A.", f"No end {i}", f"Text {i}."])) for i in range(400)]
    rows += [(2000, None, "user", "Alone."), (2000, None, "user", "Alone.")]
    df = spark.createDataFrame([(*r, False, 1, "x") for r in rows] + [(3000, 1, "user", "Gone.", True, 1, "x")], "conv_id bigint, turn bigint, role string, text string, gone boolean, key int, audit string").repartition(3)
    got = convrepair.digested(convrepair.repair(df, absent="gone", piece=(16, 1 << 20)))
    by = defaultdict(list)
    for k, t, r, x in rows:
        by[k].append((t, r or "", x or ""))
    known = lambda k, r, x: hashlib.sha256("|".join(["" if k is None else str(k), str(k is None).lower(), str(len(r)), r, x]).encode()).hexdigest()
    expected = {k: _repaired(sorted(v, key=lambda y: (y[0] is not None, y[0] or 0, y[1], known(k, y[1], y[2])))) for k, v in by.items()}
    expected[3000] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    found = {r[0]: tuple(r[1:]) for r in got.collect()}
    assert got.columns[0] == "conv_id" and got.count() == len(found) == len(expected)
    assert found == expected
    assert convrepair.digested(convrepair.repair(df.limit(0))).count() == 0


def test_op12(spark):
    """The registered query against plain Python, damage included."""
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    by = defaultdict(list)
    for r in rows:
        own = by[r.conv_id]
        damage = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if damage == 1 else re.sub("[.!?]", "", r.text) if damage == 2 else r.text
        own += [(r.turn, "user" if damage == 4 else r.role, text)] * (0 if damage == 0 else 2 if damage == 3 else 1)
    expected = {k: _repaired(sorted(v, key=lambda x: x[0])) for k, v in by.items()}
    got = queries.op12_conversations(spark, "/root/testdata/sf0.001")
    assert {r.conv_id: tuple(r)[1:] for r in got.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()} == expected


# -- n-gram sets ----------------------------------------------------------------------------------


def _sets(texts, width=4):
    out = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out[k] = {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()
    return out


def _classes(sets, num=85, den=100):
    """Least key reachable, over all pairs."""
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * den >= num * max(len(sets[a]), len(sets[b])) and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in keys}


def test_near_sets_share_a_signature():
    """Pairs as far apart as may be, of all sizes, adjacent bands and empty parts among them."""
    import numpy as np

    rng, checked = np.random.default_rng(4), 0
    for n in [*range(1, 60), 100, 150, 300, 777, 2000, 9000]:
        for _ in range(12):
            both = int(rng.integers(max(1, -(-85 * n // 100)), n + 1))
            more = min(n - both, both * 100 // 85 - n) if rng.random() < 0.5 else both * 100 // 85 - n
            pool = rng.integers(0, 1 << 63, n + max(more, 0), dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n:]]))
            inter = len(np.intersect1d(a, b))
            if 100 * inter < 85 * (len(a) + len(b) - inter) or np.array_equal(a, b):
                continue
            hashes, doc = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
            sig, whose = partenum.signatures(hashes, doc, np.array([len(a), len(b)]), 17, 20)
            assert set(sig[whose == 0].tolist()) & set(sig[whose == 1].tolist()), (len(a), len(b), inter)
            checked += 1
    assert checked > 300


def test_similar_sets_equal_brute_force(spark):
    """Copies, near copies around the threshold, families, nulls, empty and long texts, repeated rows, clashing columns."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(500)}"
    texts, k = {}, 0
    for size in [4, 5, 9, 12, 20, 40, 60, 120, 400]:
        for _ in range(4):
            base = [word() for _ in range(size)]
            for _ in range(rng.randrange(1, 9)):
                near = [w if rng.random() > rng.choice([0, 0.01, 0.02, 0.04]) else word() for w in base]
                texts[k] = " ".join(near[: rng.choice([size, size, size - 1, size * 9 // 10])])
                k += 1
    shared = " ".join(word() for _ in range(60))
    for i in range(40):
        texts[k + i] = shared + " " + " ".join(word() for _ in range(rng.randrange(2, 30)))
    texts |= {900: None, 901: "", 902: " \n", 903: "One two", 904: "one  TWO", 905: LONG, 906: LONG + "end", 907: "É x y", 908: "é x y"}
    sets = _sets(texts)
    expected = {k: (len(sets[k]), c) for k, c in _classes(sets).items()}
    df = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in texts.items()] + [(0, texts[0], 1, "x", 2)], "doc_id bigint, text string, fp int, key string, n int").repartition(3)
    rows = partenum.similar_sets(df).collect()
    assert len(rows) == len(texts) + 1 and {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert len({c for _, c in expected.values()}) < len(texts) - 60
    odd = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, "x y"), (None, None), (4, None)], "doc_id bigint, text string")
    assert sorted(map(str, [(r.doc_id, r.component_id) for r in partenum.similar_sets(odd).collect()])) == ["(3, 3)", "(4, 4)", "(None, 3)", "(None, None)", "(None, None)"]
    assert partenum.similar_sets(odd.limit(0)).count() == 0


def test_large_buckets_meet_block_by_block(spark, monkeypatch):
    """A family whose members are near a few others only, with leaders that are near none."""
    monkeypatch.setattr(partenum, "GROUP", 4)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = {}
    for i in range(60):
        own = list(base)
        for j in rng.sample(range(200), 6):
            own[j] = f"x{i}y{j}"
        texts[i] = " ".join(own)
        if i % 3 == 0:
            own[rng.randrange(200)] = f"z{i}"
            texts[100 + i] = " ".join(own)
    expected = _classes(_sets(texts))
    got = {r.doc_id: r.component_id for r in partenum.similar_sets(spark.createDataFrame([*texts.items()], "doc_id bigint, text string")).collect()}
    assert got == expected and 1 < len(set(got.values())) < len(got)


def test_op13(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sets = _sets(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op13_jaccard(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: (len(sets[k]), c) for k, c in _classes(sets).items()}
