"""The corpus pipeline: documents in, token ids out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import langid, mixing, ngram_join, pieces, pii
from cadenza.plans.scratch import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or of which no language has half. The model is learned from the stage's own labelled rows."""
    return langid.keep_known(docs, langid.train(docs.select("text", "lang")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, a similarity of 0.75 or more) one row stays: that with the smallest doc_id, then the smallest hash of its text. Rows without doc_id stay, and have no part in groups.

    Every row is a document of its own here, so different texts under one
    doc_id stay unless they are alike. Of rows that agree in doc_id and text,
    the one whose other columns are smallest stays. Rows without words are
    alike to nothing but their repeats.
    """
    row = F.xxhash64("doc_id", "text")
    order = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text", F.lit(1)).alias("hash"))
    nameless, docs = docs.where("doc_id IS NULL"), docs.where("doc_id IS NOT NULL")
    known = docs.select(row.alias("row"), order.alias("o")).groupBy("row").agg(F.min("o").alias("o"), F.max("o").alias("last"))
    groups = ngram_join.link(docs.select(row.alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id").distinct()
    placed = known.join(groups, "row")
    best = placed.groupBy("component_id").agg(F.min(F.struct("o", "row")).alias("b")).select("b.row")
    # Should two different rows have one hash, both stay.
    stay = best.union(known.where("o <> last").select("row")).distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = docs.withColumns({"_row": row, "_hash": F.xxhash64("text", F.lit(1))}).join(stay.withColumnRenamed("row", "_row"), "_row", "left_semi")
    one = kept.groupBy("_row", "_hash", "doc_id").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest], "text")).alias("d"))
    return one.select(*["doc_id" if c == "doc_id" else F.col(f"d.`{c}`") for c in docs.columns]).unionByName(nameless)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's target weight says; those that the mix doesn't take go."""
    return mixing.in_order(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and ids of every row."""
    return pieces.encode(docs.select("doc_id", "source", "text"), pieces.piece_model())


STAGES = [
    ("language identification", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("personal data", without_personal_data),
    ("mixing sources", mixed),
    ("sentencepiece encoding", token_ids),
]

#: SQL can express neither language identification nor encoding; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        new = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
