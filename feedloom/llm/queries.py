"""The registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import bpe, convrepair, exact, hardneg, langid, lmscore, mixing, partenum, quality, secrets, sharding, simhash, tokenio

SHARDS = 8
MIX_WEIGHTS = (5, 2, 1)
MIX_SHARE, MIX_CAP = 1.5, 2.0
BASE_KINDS = ("assign", "access", "hex")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), [1.0] * SHARDS, grown=1.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenio.read(spark, tokenio.write(documents(spark, sf_dir), end_id=2), ids=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), width=4, tau=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir), digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), MIX_WEIGHTS, MIX_SHARE, MIX_CAP)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lmscore.score(documents(spark, sf_dir), steady=True)
    return scored.withColumns({"log_score": F.round("log_score", 4), "score": F.round("score", 6)})


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), steady=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ratio, threshold = quality.fit(docs, trusted(spark, sf_dir))
    rated = quality.rate(docs, ratio, threshold)
    return rated.select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    damage = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    text = F.when(damage == 1, "").when(damage == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(damage == 4, "user").otherwise(spaced("role"))
    times = F.when(damage == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    damaged = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (damage == 0).alias("dropped"), F.explode(times).alias("nth"))
    return convrepair.digested(convrepair.repair(damaged, absent="dropped"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.similar_sets(documents(spark, sf_dir), width=4, num=17, den=20).select("doc_id", "n_shingles", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_sharding, op2_language, op3_token_files, op4_simhash, op5_secrets, op6_exact, op7_mixing, op8_lm_scores, op9_bpe, op10_quality, op11_hard_negatives, op12_conversations, op13_jaccard]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

_PASS = """
need{n} AS (SELECT s, max(target) - sum(size * (certain + more)) AS need FROM pass{p} GROUP BY s),
open{n} AS (SELECT p.*, CASE WHEN q IS NOT NULL AND more = 0 AND size <= need THEN sum(CASE WHEN q IS NOT NULL AND more = 0 AND size <= need THEN size ELSE 0 END) OVER (PARTITION BY p.s ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) END AS upto, need FROM pass{p} p JOIN need{n} n ON p.s = n.s),
pass{n} AS (SELECT doc_id, s, size, source_size, target, certain, q, CASE WHEN more = 1 OR upto <= need THEN 1 ELSE 0 END AS more FROM open{n})"""

OP7_SQL = (
    r"""
WITH sized AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS s, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sums AS (SELECT s, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY s),
weighed AS (SELECT s, source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1] AS weight, 2.0::DOUBLE * source_size AS most FROM sums),
filled AS (SELECT *, most / weight AS fill FROM weighed),
level AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS l FROM filled
          WINDOW b AS (ORDER BY fill, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (SELECT s, source_size, CASE WHEN a.l IS NULL THEN most ELSE least(most, a.l * weight) END AS target FROM level, (SELECT max(l) AS l FROM level WHERE fill > l) a),
ratio AS (SELECT d.doc_id, d.s, d.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN least(2.0::DOUBLE, p.target / p.source_size) ELSE 0.0::DOUBLE END AS e,
          (CAST(('0x' || substr(md5('mix|' || CAST(d.doc_id AS VARCHAR)), 1, 13)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
          FROM sized d JOIN plan p ON d.s = p.s),
pass0 AS (SELECT doc_id, s, size, source_size, target, CAST(floor(e) AS BIGINT) AS certain,
          CASE WHEN e - floor(e) > 0 AND size > 0 THEN (u / (1.0::DOUBLE - u)) / ((e - floor(e)) / (1.0::DOUBLE - (e - floor(e)))) END AS q, 0 AS more FROM ratio),"""
    + ",".join(_PASS.format(n=i, p=i - 1) for i in range(1, mixing.PASSES + 1))
    + f"""
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 4) AS target, CAST(size * (certain + more) AS BIGINT) AS taken FROM pass{mixing.PASSES}
"""
)


def _lm_order(n: int) -> str:
    return f"c{n} AS (SELECT g{n} AS g, count(*) AS n FROM grams WHERE g{n} IS NOT NULL GROUP BY 1), o{n} AS (SELECT doc_id, g{n} AS g, count(*) AS n FROM grams WHERE g{n} IS NOT NULL GROUP BY 1, 2)"


OP8_SQL = rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
word AS (SELECT doc_id, len(words) AS size, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
grams AS (SELECT doc_id, size, i, w AS g1, lag(w) OVER d || ' ' || w AS g2, lag(w, 2) OVER d || ' ' || lag(w) OVER d || ' ' || w AS g3 FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
{", ".join(map(_lm_order, (1, 2, 3)))},
counted AS (SELECT g.doc_id, g.size, g.i, (SELECT count(*) FROM word) - g.size AS outside, c1.n - o1.n AS n1, c2.n - o2.n AS n2, c3.n - o3.n AS n3 FROM grams g
  JOIN c1 ON c1.g = g1 JOIN o1 ON o1.g = g1 AND o1.doc_id = g.doc_id LEFT JOIN c2 ON c2.g = g2 LEFT JOIN o2 ON o2.g = g2 AND o2.doc_id = g.doc_id LEFT JOIN c3 ON c3.g = g3 LEFT JOIN o3 ON o3.g = g3 AND o3.doc_id = g.doc_id),
before AS (SELECT *, lag(n1) OVER d AS p1, lag(n2) OVER d AS p2 FROM counted WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
valued AS (SELECT doc_id, coalesce(n3, 0) > 0 AS seen, CASE WHEN n3 > 0 THEN log10(n3::DOUBLE / p2) WHEN n2 > 0 THEN log10(n2::DOUBLE / p1) + log10(0.4) * (least(i, 3) - 2) WHEN n1 > 0 THEN log10(n1::DOUBLE / outside) + log10(0.4) * (least(i, 3) - 1) ELSE log10(1 / (outside + 1.0::DOUBLE)) + log10(0.4) * (least(i, 3) - 1) END AS v FROM before),
summed AS (SELECT doc_id, count(CASE WHEN seen THEN 1 END) AS n_seen, sum(v) AS v FROM valued GROUP BY doc_id)
SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_seen, 0) AS n_seen, round(coalesce(v, 0.0), 4) AS log_score, round(v / len(words), 6) AS score FROM split s LEFT JOIN summed m ON m.doc_id = s.doc_id
"""


OP11_SQL = """
WITH whole AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_sum([p[1] * p[2] for p in list_zip(a.v, b.v)]) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, id, score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_exact": OP6_SQL, "op7_mixing": OP7_SQL, "op8_lm_scores": OP8_SQL, "op11_hard_negatives": OP11_SQL}
