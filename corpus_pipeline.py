"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, secrets are masked, sources are mixed, the rest is encoded.

Stages treat each row as a document of its own, whatever its id: null and
repeated ids, null and blank texts and rows that repeat lose nothing but what
the stage is for.  Columns beyond those of ``documents`` pass through
untouched, also where their names are those of an operator's results.  Empty
tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm import bpe, dedup, mixing, secrets, toxicity
from noticelake.llm.common import guarded, scratch_dir, stored


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic; the chain learns from the labelled documents."""
    rows, back = guarded(docs, "doc_id", "text")
    chain = toxicity.train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return back(toxicity.classify(rows, chain).where("kept"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest ``doc_id``, null last, and of its rows any one.

    Groups are of rows, not of ids: rows with one id and unrelated texts all
    stay, and rows without an id take part.  Texts without words link with
    nothing and stay.
    """
    rows, back = guarded(docs, "doc_id", "text")
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()))
    groups = dedup.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    named = groups.join(rows.select("__row", "doc_id"), "__row")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("x")).select("x.__row")
    return back(rows.join(kept, "__row", "left_semi"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` counted anew where that changed the text."""
    rows, back = guarded(docs, "text", "n_chars")
    out = secrets.redact(rows.withColumn("__text", F.col("text")))
    n = F.when(F.col("__text") != F.col("text"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return back(out.withColumn("n_chars", n))


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as their quotas say; those of which nothing is taken go."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to: doc_id, source, n_tokens, ids, decoded_sha256."""
    out = bpe.round_trip(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxic_out),
    ("minhash_near_dedup", near_duplicates_out),
    ("secret_scan", secrets_masked),
    ("mixing", sources_mixed),
    ("bpe", encoded),
]

#: SQL expresses neither the trained chain nor the tokens; tests/llm hold the result of run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
