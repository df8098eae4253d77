"""Sinks written twice and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.plans.documents import _OUT, outcomes
from noticelake.plans.operations import events
from noticelake.plans.registry import register, shared_dir, table
from noticelake.sources import landed as L
from noticelake.sources import sinks as K


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@register("s11_snapshot_sink", """WITH b AS (SELECT event_id % 3 AS k, user_id, arg_max(event_type, (ts, event_id)) AS title, arg_max(event_id, (ts, event_id)) % 2 AS v FROM events GROUP BY ALL),
    c AS (SELECT *, lag(title) OVER u AS before, lag(v) OVER (PARTITION BY user_id, title ORDER BY k) AS v_before, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1 AS newest FROM b WINDOW u AS (PARTITION BY user_id ORDER BY k)),
    e AS (SELECT *, before IS NOT NULL AND (title <> before OR v IS DISTINCT FROM v_before) AS changed FROM c),
    m AS (SELECT user_id, string_agg(title || '=' || v, ',' ORDER BY title) AS metadata FROM (SELECT user_id, title, arg_max(v, k) AS v FROM b GROUP BY ALL) GROUP BY 1)
    SELECT user_id, max(CASE WHEN newest THEN title END) AS title, CASE WHEN bool_or(changed) THEN 'updated' ELSE 'new' END AS status, bool_or(newest AND changed) AS is_update, any_value(metadata) AS metadata FROM e JOIN m USING (user_id) GROUP BY 1""")
def s11_sink(spark: SparkSession, d: str) -> DataFrame:
    """Events land in three parts; after each a stream merges what is new into the snapshot, and the last batch comes a second time."""
    folder = scratch(spark)
    e = events(spark, d).select("event_id", "user_id", "ts", F.col("event_type").alias("title"), F.create_map("event_type", (F.col("event_id") % 2).cast("string")).alias("metadata"))
    snapshot = K.notice_snapshot(spark, f"{folder}/snapshot", "user_id long, title string, metadata map<string, string>", ["user_id"])
    how = K.upserting(["user_id"], ["title"], ["metadata"], ["ts", "event_id"])
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{folder}/landed")
        K.stream_into(spark.readStream.schema(e.schema).parquet(f"{folder}/landed"), snapshot, how, "notices", f"{folder}/checkpoint")
    snapshot.merge(e.where(F.col("event_id") % 3 == 2), how, "notices", 2)
    metadata = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return snapshot.read().withColumn("metadata", metadata)


@register("s12_extraction_store", f"""WITH {_OUT}, a AS (SELECT source, checksum, min(CASE WHEN status = 'extracted' THEN 0 ELSE 1 END) AS failed FROM o WHERE doc_id % 2 = 0 GROUP BY ALL), z AS (SELECT DISTINCT source, checksum FROM o WHERE doc_id % 8 = 0)
    SELECT doc_id, a.source IS NULL OR (failed = 1 AND z.source IS NULL) AS to_do FROM o LEFT JOIN a USING (source, checksum) LEFT JOIN z USING (source, checksum)""")
def s12_store(spark: SparkSession, d: str) -> DataFrame:
    """Two configurations, one of them run twice and then once more over a part that is extracted now; which documents are still to do under it."""
    store = K.extraction_store(spark, scratch(spark))
    o = outcomes(spark, d).withColumnRenamed("source", "notice_id")
    results = lambda rows, config: rows.select("notice_id", "checksum", F.lit("p1").alias("processor_version"), F.lit(config).alias("config_version"), "status")
    for rows, config in ((o, "c0"), (o.where("doc_id % 2 = 0"), "c1"), (o.where("doc_id % 2 = 0"), "c1"), (o.where("doc_id % 8 = 0").withColumn("status", F.lit("extracted")), "c1")):
        K.write_extractions(store, results(rows, config))
    left = L.reusable(o.select("notice_id", "checksum", "doc_id"), store.read(), "p1", "c1").select("doc_id", F.lit(True).alias("to_do"))
    return o.select("doc_id").join(left, "doc_id", "left").select("doc_id", F.coalesce("to_do", F.lit(False)).alias("to_do"))


@register("s13_bundle_store", """WITH b AS (SELECT doc_id // 8 AS notice_id, doc_id, CASE WHEN doc_id // 8 % 10 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents)
    SELECT notice_id, sha256('[' || string_agg('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}', ',' ORDER BY doc_id) || ']') AS bundle FROM b GROUP BY 1""")
def s13_store(spark: SparkSession, d: str) -> DataFrame:
    """All notices' bundles, then every tenth notice's anew, which comes twice."""
    store = K.bundle_store(spark, scratch(spark))
    docs = table(spark, d, "documents").withColumn("notice_id", F.floor(F.col("doc_id") / 8))
    again = docs.where("notice_id % 10 = 0").withColumn("n_chars", F.col("n_chars") + 1)
    for batch, rows in enumerate((docs, again, again)):
        K.write_bundles(store, L.bundles(rows, "notice_id", "doc_id", "n_chars"), "bundles", min(batch, 1))
    return store.read().withColumn("bundle", F.sha2("bundle", 256))
