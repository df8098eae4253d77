"""Queries of change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions.urls import derive_external_id
from noticelake.operators import changes as X
from noticelake.plans.functions import _PARTS
from noticelake.plans.registry import register, table

AS_OF = "1998-06-15 12:00:00"


FIELDS = list(X.FIELDS)


def current(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("source_id"), k.alias("external_id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("https://x.org/"), k.cast("string")).alias("url"), (F.col("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("published"),
        F.col("o_orderdate").alias("deadline"), F.lit("UTC").alias("deadline_zone"), F.concat(F.lit("R"), k.cast("string")).alias("reference"), F.when(k % 17 == 0, "v2").otherwise("").alias("addendum_marker"),
    )


def seen(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("external_id")
    c = current(spark, d).where(k % 5 != 0)
    changed = lambda n, new, field: F.when(k % n == 0, new).otherwise(F.col(field))
    return c.withColumns({
        "title": F.when(k % 11 == 0, "0-NONE").otherwise(F.concat(F.lit(" "), F.col("title"))), "url": changed(9, F.lit("https://x.org/old"), "url"), "published": changed(23, F.lit(None), "published"),
        "deadline": changed(7, F.col("deadline") + F.expr("INTERVAL 1 DAY"), "deadline"), "deadline_zone": changed(29, F.lit("WAT"), "deadline_zone"), "reference": changed(19, F.lit(None), "reference"),
        "addendum_marker": F.when(k % 34 == 0, "v1").otherwise(" "), "status": F.when(k % 13 == 0, "expired").otherwise("new"),
    })


_CASES = (("title", 11), ("url", 9), ("published", 23), ("deadline", 7), ("deadline_zone", 29), ("reference", 19), ("addendum_marker", 17))
_DIFF = f"""
diff AS (SELECT o_custkey AS source_id, o_orderkey AS external_id,
  list_filter([{", ".join(f"CASE WHEN o_orderkey % {n} = 0 THEN '{f}' END" for f, n in _CASES)}], lambda x: x IS NOT NULL AND o_orderkey % 5 <> 0) AS changed_fields,
  list_filter([CASE WHEN o_orderkey % 11 = 0 THEN 'TITLE_CHANGED' END, CASE WHEN o_orderkey % 7 = 0 THEN 'DEADLINE_CHANGED' END, CASE WHEN o_orderkey % 34 = 0 THEN 'CHANGE_MARKER_CHANGED' WHEN o_orderkey % 17 = 0 THEN 'ADDENDUM_ADDED' END], lambda x: x IS NOT NULL AND o_orderkey % 5 <> 0) AS change_types,
  CASE WHEN o_orderkey % 5 = 0 THEN 'NEW' WHEN (o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 17 = 0) AND o_orderkey % 13 <> 0 THEN 'UPDATE' ELSE 'UNCHANGED' END AS outcome FROM orders)"""


def diff(spark: SparkSession, d: str) -> DataFrame:
    return X.diff_listings(current(spark, d), seen(spark, d), ["source_id", "external_id"], FIELDS)


@register("j02_diff_listings", f"WITH {_DIFF} SELECT source_id, external_id, array_to_string(changed_fields, ',') AS changed_fields, array_to_string(change_types, ',') AS change_types, CASE WHEN external_id % 5 <> 0 AND external_id % 9 = 0 THEN 'https://x.org/old' END AS url_before, outcome FROM diff")
def j02(spark: SparkSession, d: str) -> DataFrame:
    before = F.get(F.filter("changes", lambda x: x["field"] == "url"), 0)["before"]
    return diff(spark, d).select("source_id", "external_id", F.array_join("changed_fields", ",").alias("changed_fields"), F.array_join("change_types", ",").alias("change_types"), before.alias("url_before"), "outcome")


@register("a01_dedup_summary", f"WITH {_DIFF} SELECT source_id, count_if(outcome = 'NEW') AS new_count, count_if(outcome = 'UPDATE') AS update_count, count_if(outcome = 'UNCHANGED') AS unchanged_count, count(*) AS listings_found, count_if(external_id % 21 = 0) + count_if(external_id % 31 = 0) AS duplicate_count FROM diff GROUP BY 1")
def a01(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").cast("string").alias("external_id"))
    arrived = ids.unionByName(ids.where("external_id % 21 = 0")).unionByName(ids.where("external_id % 31 = 0").withColumn("external_id", F.lit(" ")))
    return X.dedup_summary(diff(spark, d), ["source_id"], arrived)


@register("s11_upsert_notices", "SELECT o_custkey AS source_id, o_orderkey AS external_id, o_orderdate AS deadline, CASE WHEN o_orderkey % 5 = 0 THEN 'new' WHEN o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 THEN 'updated' WHEN o_orderkey % 13 = 0 THEN 'expired' ELSE 'new' END AS status, o_orderkey % 5 <> 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 3 = 0) AS is_update, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'a=1,' END || CASE WHEN o_orderkey % 3 = 0 THEN 'b=3,' ELSE 'b=2,' END || 'c=4' AS metadata FROM orders")
def s11(spark: SparkSession, d: str) -> DataFrame:
    pairs = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v if hasattr(v, "alias") else F.lit(v))])
    old = seen(spark, d).select("source_id", "external_id", "deadline", "status", pairs(a="1", b="2", c="4").alias("metadata"))
    new = current(spark, d).withColumn("metadata", pairs(b=F.when(F.col("external_id") % 3 == 0, "3").otherwise("2"), c="4"))
    out = X.upsert_notices(old, new, ["source_id", "external_id"], ["deadline"], ["metadata"])
    return out.withColumn("metadata", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda x: F.concat_ws("=", x["key"], x["value"])), ","))


@register("w01_dedupe_listings", f"WITH {_PARTS}, u AS (SELECT page_id, CASE WHEN page_id % 17 <> 0 THEN external_id END AS external_id FROM urls) SELECT external_id, CASE WHEN external_id IS NOT NULL THEN min(page_id) END AS page_id, count(*) - CASE WHEN external_id IS NULL THEN 0 ELSE 1 END AS duplicates FROM u GROUP BY 1")
def w01(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 17 == 0, " ").otherwise(derive_external_id(F.col("url"))).alias("external_id"))
    return X.dedupe_listings(p, "external_id", "page_id").select("external_id", "page_id", "duplicates")


@register("p08_validate_candidates", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'dedup_missing_identity' WHEN page_id % 5 = 0 THEN 'dedup_malformed_candidate' END AS error_code FROM pages")
def p08(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 7 == 0, " ").otherwise(derive_external_id(F.col("url"))).alias("external_id"), F.when(F.col("page_id") % 5 == 0, F.lit(None)).otherwise(F.col("url")).alias("title"))
    return X.validate_candidates(p, "external_id", ["title"]).select("page_id", "error_code")


def notices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "F", "processed").otherwise("expired").alias("status"), F.col("o_orderdate").alias("deadline"), (F.col("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("first_seen_at"))


_NEW = f"o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '{AS_OF}'"


@register("p04_unprocessed", f"SELECT o_orderkey AS id, o_orderdate AS deadline FROM orders WHERE {_NEW} ORDER BY o_orderdate, o_orderkey LIMIT 25")
def p04(spark: SparkSession, d: str) -> DataFrame:
    return X.unprocessed(notices(spark, d), F.lit(AS_OF).cast("timestamp"), 25).select("id", "deadline")


@register("p05_expired", f"SELECT o_orderkey AS id, o_orderdate AS deadline FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '{AS_OF}' AND o_custkey % 25 < 20")
def p05(spark: SparkSession, d: str) -> DataFrame:
    n = notices(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("source_id")), "id")
    sources = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("source_id"))
    return X.expired(n, F.lit(AS_OF).cast("timestamp"), sources).select("id", "deadline")


@register("t06_recover_backlog", f"WITH s AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 3), b AS (SELECT o_orderkey AS id FROM orders WHERE {_NEW} AND o_orderkey % 10 <> 3 ORDER BY o_orderdate, o_orderkey LIMIT 25) SELECT id, 'selected' AS origin FROM s UNION ALL SELECT id, 'backlog' FROM b")
def t06(spark: SparkSession, d: str) -> DataFrame:
    n = notices(spark, d)
    return X.recover_backlog(n.where("id % 10 = 3"), n, F.lit(AS_OF).cast("timestamp"), 25)


@register(
    "w04_status_history",
    """WITH e AS (SELECT *, lag(event_type) OVER w AS previous, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, previous, round(s, 3) AS seconds_in_state, CAST(sum(CASE WHEN previous IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS visit FROM e""",
)
def w04(spark: SparkSession, d: str) -> DataFrame:
    return X.status_history(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type").select("event_id", "previous", F.round("seconds_in_state", 3).alias("seconds_in_state"), "visit")


@register(
    "p07_validate_transitions",
    """WITH e AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events)
    SELECT event_id, f AS from_state, event_type FROM e WHERE f IS NOT NULL AND f <> event_type AND (f, event_type) NOT IN (('view', 'click'), ('click', 'purchase'), ('view', 'signup'), ('signup', 'view'))""",
)
def p07(spark: SparkSession, d: str) -> DataFrame:
    edges = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("view", "signup"), ("signup", "view")], "from_state string, to_state string")
    return X.validate_transitions(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type", edges).select("event_id", "from_state", "event_type")


@register("s05_union_facets", "WITH f AS (SELECT sha256(text) AS item, lang AS facet, doc_id, list_position(['fr', 'en', 'es'], lang) - 1 AS i FROM documents WHERE lang IN ('fr', 'en', 'es')) SELECT item, arg_min(facet, (i, doc_id)) AS facet, arg_min(doc_id, (i, doc_id)) AS doc_id, CAST(min(i) AS INTEGER) AS facet_index FROM f GROUP BY 1")
def s05(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("item"), F.col("lang").alias("facet"), "doc_id")
    return X.union_facets(docs, "item", "facet", "doc_id", ("fr", "en", "es"))


@register(
    "s06_crawl_stop_report",
    """WITH i AS (SELECT user_id AS crawl, CAST(ntile(6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS page, CAST(json_extract(props, '$.k') AS BIGINT) AS item FROM events),
    f AS (SELECT crawl, item, min(page) AS page FROM i GROUP BY ALL), fr AS (SELECT crawl, page, count(*) AS fresh FROM f GROUP BY ALL),
    p AS (SELECT crawl, page, count(*) AS n, coalesce(any_value(fresh), 0) AS fresh, CASE WHEN crawl % 3 = 0 THEN 35 END AS total, CASE WHEN crawl % 4 = 1 AND page = 4 THEN 'u2' ELSE 'u' || page END AS url FROM i LEFT JOIN fr USING (crawl, page) GROUP BY ALL),
    v AS (SELECT *, sum(n) OVER w AS shown, page > min(page) OVER (PARTITION BY crawl, url) AS visited FROM p WINDOW w AS (PARTITION BY crawl ORDER BY page)), x AS (SELECT *, lead(visited) OVER (PARTITION BY crawl ORDER BY page) AS visited_next FROM v),
    r AS (SELECT *, CASE WHEN page > 1 AND fresh = 0 THEN 'no_new_items' WHEN shown >= total THEN 'total_reached' WHEN n < 10 THEN 'short_page' WHEN page >= 5 THEN 'max_pages_reached' WHEN visited_next THEN 'already_visited_url' END AS reason FROM x),
    s AS (SELECT crawl, coalesce(min(CASE WHEN reason IS NOT NULL THEN page END), max(page)) AS stop_page FROM r GROUP BY 1)
    SELECT s.crawl, s.stop_page, coalesce(any_value(CASE WHEN r.page = s.stop_page THEN reason END), 'no_next_page') AS reason, CAST(sum(CASE WHEN r.page <= s.stop_page THEN fresh ELSE 0 END) AS BIGINT) AS kept_items FROM s JOIN r ON s.crawl = r.crawl GROUP BY ALL""",
)
def s06(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "events").selectExpr("user_id AS crawl", "CAST(ntile(6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS page", "CAST(get_json_object(props, '$.k') AS BIGINT) AS item")
    page, crawl = F.col("page"), F.col("crawl")
    items = items.withColumns({"total": F.when(crawl % 3 == 0, 35), "url": F.when((crawl % 4 == 1) & (page == 4), "u2").otherwise(F.concat(F.lit("u"), page.cast("string")))})
    return X.crawl_stop_report(items, 5, 10)
