"""From raw documents to token ids, in five stages.

Each stage works on all that the one before kept, and all but the last return the columns of documents.
Decisions are taken and matched row by row (by a row's file and place in it), so ids may be missing or
repeat. Rows that a stage drops are matched against the documents in place (a broadcast of counted size,
a shuffle join beyond it), so that texts do not move to be filtered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdspark.llm import bpe, common, exact_dedup, language_id, minhash, mixing

KEY = common.KEY


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without these rows, and without their keys."""
    return common.matched(docs, rows.select(*KEY), "left_anti", list(KEY)).drop(*KEY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the text model learns from their lang column."""
    rows = common.keyed(docs)
    return without(rows, language_id.identify(rows, language_id.fit(docs), host_col="source", carry=KEY).where("NOT accepted"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, with the smallest id."""
    rows = common.keyed(docs)
    return without(rows, exact_dedup.exact_dedup(rows, carry=KEY).where("NOT stays"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, with the smallest id; rows without an id have no near copies."""
    rows = common.keyed(docs)
    return without(rows, minhash.near_duplicates(rows, 80, 5, carry=KEY).where("NOT stays"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says: not at all, once, or more often."""
    rows = common.keyed(docs)
    rated = mixing.mix(rows, mixing.label_domains(common.table(spark, sf_dir, "labels")), carry=KEY)
    other = rated.where("copies <> 1").select(*KEY, F.col("copies").alias("_copies"))
    joined = common.matched(rows, other, "left", list(KEY)).withColumn("_copies", F.coalesce("_copies", F.lit(1))).where("_copies > 0")
    return joined.withColumn("_copies", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of the ids and of the decoded text."""
    return bpe.bpe_encode(docs, bpe.read_spec(), ("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("minhash_near_dedup", near), ("mixing", mix), ("bpe", encode)]

#: Minima, solver steps and merges have no SQL form; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
