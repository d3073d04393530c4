"""The registered queries and the pipeline on the smallest tables."""

import hashlib
import math
import os
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from feedloom.llm import bpe, queries
from tests.llm import test_operators as plain

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", ["op6_exact", "op7_mixing", "op8_lm_scores", "op11_hard_negatives"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    show = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert show(map(tuple, df.select(*columns).collect())) == show(con.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall())


def test_language_held_out(spark):
    """Every document answered; right on nearly all held out."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = queries.op2_language(spark, DATA).join(docs, "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert got and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_pipeline_is_its_stages(spark):
    """Each stage keeps what its operator says, and its rows are documents but for the last."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, DATA), name)
        seen[name] = out.count()
        if name == "exact_dedup":
            assert out.select("text").distinct().count() == seen[name] == docs.select("text").distinct().count()
        if name == "mix_sources":
            assert out.groupBy("doc_id").count().where("count > 2").count() == 0
        if name != "bpe_encode":
            assert out.columns == columns
        docs = out
    assert seen["quality_rules"] >= seen["exact_dedup"] >= seen["near_dedup"] > 0 and seen["mix_sources"] == seen["bpe_encode"]
    assert corpus_pipeline.run(spark, DATA).count() == seen["bpe_encode"]


def test_stages_on_odd_rows(spark):
    """Null and repeated ids, null and empty texts, repeated rows and clashing columns."""
    prose = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    rows = [(1, prose(1), "a"), (1, prose(1), "a"), (2, prose(1), "a"), (2, prose(2), "b"), (None, prose(3), None), (None, prose(4), "b"), (3, None, "a"), (4, "", None), (5, prose(5), "c")]
    docs = spark.createDataFrame([(*r, "x", r[0], 1) for r in rows], "doc_id bigint, text string, source string, text_ string, _key bigint, copies int")
    of = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    expected = lambda ids: sorted((str(r[0]), r[1] or "") for r in rows if r[0] in ids)

    exact = corpus_pipeline.exact_copies(spark, docs, DATA)
    assert exact.columns == docs.columns and of(exact) == expected({2, None, 4, 5})
    near = corpus_pipeline.near_copies(spark, exact, DATA)
    assert near.columns == docs.columns and of(near) == expected({2, None, 4, 5})
    mixed = corpus_pipeline.mix_sources(spark, near, DATA)
    assert mixed.columns == docs.columns
    taken = mixed.groupBy("doc_id", "text").count().collect()
    assert taken and all(r["count"] <= 2 for r in taken) and not {(str(r.doc_id), r.text or "") for r in taken} - set(of(near))
    assert corpus_pipeline.encode_bpe(spark, mixed, DATA).count() == mixed.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


def test_quality_stage_on_odd_rows(spark):
    """Null ids, null and empty texts, repeated rows, a column that looks like the operator's own."""
    prose = spark.read.parquet(f"{DATA}/documents.parquet").join(queries.trusted(spark, DATA), "doc_id", "left_semi").where("length(text) > 2000 and lang is not null").orderBy("doc_id").limit(2).collect()
    rows = [(1, prose[0].text), (1, prose[0].text), (None, prose[0].text), (2, None), (3, ""), (4, "too few words"), (5, "same " * 400), (None, None)]
    docs = spark.createDataFrame([(*r, "kept", r[0], False) for r in rows], "doc_id bigint, text string, kept string, n_words bigint, _q_kept boolean")
    got = corpus_pipeline.quality_rules(spark, docs, DATA)
    assert got.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted((k or 0, t) for k, t in rows[:3])


def test_pipeline_gives_token_ids(spark):
    docs = spark.createDataFrame([(1, "Some words, here.", "a"), (2, None, "b")], "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in corpus_pipeline.encode_bpe(spark, docs, DATA).collect()}
    ids = bpe.encoder(bpe.default_path()).whole.encode("Some words, here.", add_special_tokens=False).ids
    assert got[1].ids == ids and got[1].n_tokens == len(ids) and got[2].ids == []


# -- the registered queries against plain Python, on all 200 documents ----------------------------


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def _got(spark, name):
    rows = queries.queries()[name](spark, DATA).collect()
    return {r.doc_id: r for r in rows}, len(rows)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, documents):
    got, n = _got(spark, "op1_sharding")
    assert n == len(documents) == len(got) and {r.law for r in got.values()} == {"key"}
    slots = defaultdict(list)
    for k, r in got.items():
        text = documents[k].encode()
        assert (r["size"], r.text_crc32) == (len(text) + 1, zlib.crc32(text)) and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op3_and_op9(spark, documents):
    one = bpe.encoder(bpe.default_path()).whole
    files, n = _got(spark, "op3_token_files")
    words, m = _got(spark, "op9_bpe")
    assert n == m == len(documents)
    start = 0
    for k in sorted(documents):
        ids = one.encode(documents[k], add_special_tokens=False).ids
        r, w = files[k], words[k]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) + 1, zlib.crc32(struct.pack(f"<{len(ids) + 1}I", *ids, 2)))
        assert (w.n_tokens, w.ids_sha256, w.decoded_sha256) == (len(ids), _sha(" ".join(map(str, ids))), _sha(one.decode(ids, skip_special_tokens=False)))
        start += len(ids) + 1


def test_op4(spark, documents):
    got, n = _got(spark, "op4_simhash")
    keys = list(documents)
    prints = [plain._fingerprint(documents[k], 4) for k in keys]
    least = plain._components(keys, prints, 4)
    assert n == len(keys) and all((got[k].fingerprint, got[k].component_id) == (f"{p:016x}", c) for k, p, c in zip(keys, prints, least))


def test_op5(spark, documents, tmp_path):
    documents = documents | {10_000 + k: f"é {'0a' * (14 + k)} x Token: abcdefg{k} api_key='q{k}/+.=-_zz' AKIA{'Z' * (8 + k)} {t[:50]}" for k, t in list(documents.items())[:20]}
    spark.createDataFrame([*documents.items()], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op5_secrets(spark, str(tmp_path)).collect()}
    patterns = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m.group(2)) >= 8),
        ("access", "AKIA[A-Z0-9]+", 0, lambda m: len(m.group()) >= 16), ("hex", "[0-9a-f]+", 0, lambda m: len(m.group()) >= 32),
    ]
    found_any = 0
    for k, text in documents.items():
        spans = [(m.start(), i, kind, m.end()) for i, (kind, p, flags, ok) in enumerate(patterns) for m in re.finditer(p, text, flags) if ok(m)]
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        r = got[k]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == kind for s in spans) for kind, *_ in patterns) and r.base_sha256 == _sha(listed)
        told = [x for x in r.spans.split(",") if x]
        assert [x for x in told if x.split(":")[0] in queries.BASE_KINDS] == [x for x in listed.split(",") if x]
        assert [int(x.split(":")[1]) for x in told] == sorted(int(x.split(":")[1]) for x in told)
        found_any += bool(spans)
    assert len(got) == len(documents) and found_any >= 20


def _rated(documents, trusted):
    """Words, verdict on counts, and ratio of every text; the least ratio that stays."""
    hashed = {k: [(int.from_bytes(b[i : i + 3], "big") * 2654435761 % (1 << 32)) >> 16 for i in range(len(b) - 2)] for k, t in documents.items() for b in [t.encode()]}
    raw, target = Counter(), Counter()
    for k, h in hashed.items():
        raw.update(h)
        if k in trusted:
            target.update(h)
    n, m = sum(raw.values()) + 65536, sum(target.values()) + 65536
    weight = {b: math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in raw}
    score = {k: sum(weight[b] for b in h) / len(h) if h else 0.0 for k, h in hashed.items()}
    known = sorted(score[k] for k in trusted)
    at = 0.001 * (len(known) - 1)
    low = int(at)
    least = known[low] + (at - low) * (known[min(low + 1, len(known) - 1)] - known[low]) - 0.5
    out = {}
    for k, t in documents.items():
        w = plain.words(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if plain.words(x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        out[k] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed, not failed and score[k] >= least)
    return out


def test_op10(spark, documents):
    got, n = _got(spark, "op10_quality")
    trusted = {r.doc_id for r in queries.trusted(spark, DATA).collect()} & set(documents)
    expect = _rated(documents, trusted)
    assert n == len(documents)
    assert {k: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for k, r in got.items()} == expect
    assert {e[-1] for e in expect.values()} == {True, False}


def test_pipeline_equals_brute_force(spark, documents):
    """run() against five plain steps: counts and ratios, a dictionary of texts, all pairs of sets, the mix's SQL, the library."""
    import duckdb
    import pyarrow as pa

    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source").collect()}
    trusted = {r.doc_id for r in queries.trusted(spark, DATA).collect()} & set(documents)
    rated = _rated(documents, trusted)
    last = {}
    for k in sorted(documents):
        if rated[k][-1]:
            last[documents[k]] = k
    kept = sorted(last.values())
    sets = {}
    for k in kept:
        w = re.sub("[A-Z]", lambda m: m.group().lower(), documents[k])
        w = plain.words(w)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
    root = {k: k for k in kept}
    for a in kept:
        for b in kept:
            if a < b and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    kept = [k for k in kept if root[k] == k]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(kept, pa.int64()), "text": [documents[k] for k in kept], "source": pa.array([sources[k] for k in kept], pa.string())}))
    expect = Counter()
    one = bpe.encoder(bpe.default_path()).whole
    for k, size, taken in con.sql(f"select doc_id, size, taken from ({queries.OP7_SQL})").fetchall():
        ids = one.encode(documents[k], add_special_tokens=False).ids
        expect[k, len(ids), tuple(ids)] += taken // size
    with corpus_pipeline.storing() as made:
        got = Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect())
    assert [os.path.isdir(t._stored_at.removeprefix("file://")) for t in made].count(True) == 1
    assert got == +expect and len(kept) < len(set(documents.values()))
