"""A training corpus from ``documents``: rules, exact and near copies, mixing, token ids.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and
returns what it keeps; ``run`` writes each result to the shared folder and reads
it as the next stage's input.

Extra columns pass through all stages but the last.  Null texts and texts without words count as empty;
an empty table stays empty.  Decisions are joined back by doc_id: rows that
repeat a doc_id (null equals null) stay if one of them is to stay, and the mix
takes each of them as often as the one it takes most often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import bpe, exact, mixing, quality, queries, similar
from feedloom.llm.common import discard, join_keys, stored, storing


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and whose likelihood ratio is not below the threshold."""
    ratio, threshold = quality.fit(docs, queries.trusted(spark, sf_dir))
    prefix = "_q_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    rated = quality.rate(docs, ratio, threshold, others=tuple(docs.columns), prefix=prefix)
    return rated.where(F.col(f"{prefix}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    found = exact.exact_duplicates(docs)
    return join_keys(docs, found.where("kept").select("doc_id"), "doc_id")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a Jaccard similarity of 0.8 or more over five words the document with the smallest doc_id.

    Links come from the SimHash operator's pigeonring first, each held to that
    similarity; pairs whose fingerprints are too far apart come from their shingles.
    """
    found = similar.similar_texts(docs)
    return join_keys(docs, found.where("doc_id <=> component_id").select("doc_id"), "doc_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is there twice."""
    mixed = mixing.mix(docs, queries.MIX_WEIGHTS, queries.MIX_SHARE, queries.MIX_CAP)
    often = mixed.groupBy("doc_id").agg(F.max("copies").cast("int").alias("often")).where("often > 0")
    copies = often.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("often"))).alias("nth"))
    return join_keys(docs, copies, "doc_id", "inner")


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row that the mix holds, their number and digests; columns but ``doc_id`` end here.

    ``docs`` is the table of files that the stage before was written to.
    """
    return bpe.encode(docs, steady=True).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode_bpe),
]

#: Likelihood ratios, similarity over all pairs and merges can't be written in SQL; tests hold each operator and the rows
#: of run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage stored on its way goes when its result is written, as does its input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with storing() as made:
            after = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs, *[table for table in made if table is not after])
        docs = after
    return docs
