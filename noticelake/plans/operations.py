"""Queries of runs, usage, routing and delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.operators import operations as O  # noqa: E741
from noticelake.plans.registry import register, table

AS_OF = "2024-01-31 00:00:00"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@register("w02_latest_per_notice", "SELECT l_orderkey, arg_max(l_linenumber, (l_shipdate, l_linenumber)) AS l_linenumber, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1")
def w02(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return O.latest(li, "l_orderkey", ["l_shipdate", "l_linenumber"])


@register("w07_assign_sequence", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS sequence FROM lineitem")
def w07(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    return O.assign_sequence(li, "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]).drop("l_shipdate")


_STAGE = "CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'view' THEN 'PARTIAL' ELSE 'COMPLETED' END"


@register("a02_run_status", f"""WITH s AS (SELECT user_id, event_id % 3 AS stage, max(CASE WHEN {_STAGE} = 'FAILED' THEN 3 WHEN {_STAGE} = 'PARTIAL' OR event_id % 7 = 0 THEN 2 ELSE 1 END) AS r FROM events GROUP BY ALL),
    t AS (SELECT user_id, CASE max(r) WHEN 3 THEN 'FAILED' WHEN 2 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status, string_agg(stage || '=' || CASE r WHEN 3 THEN 'FAILED' WHEN 2 THEN 'PARTIAL' ELSE 'COMPLETED' END, ',' ORDER BY stage) AS stages FROM s GROUP BY 1)
    SELECT user_id, status, stages, CASE WHEN user_id % 4 = 0 THEN 'RUNNING' WHEN user_id % 4 = 1 OR status = 'FAILED' THEN 'ERRORED' ELSE 'COMPLETED' END AS run_status FROM t""")
def a02(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    s = e.select("user_id", (F.col("event_id") % 3).alias("stage"), F.expr(_STAGE).alias("status"), F.when(F.col("event_id") % 7 == 0, 1).otherwise(0).alias("failed_items"))
    runs = e.groupBy("user_id").agg(F.max("ts").alias("t")).select("user_id", F.when(F.col("user_id") % 4 != 0, F.col("t")).alias("ended_at"), F.when(F.col("user_id") % 4 == 1, 2).otherwise(0).alias("error_count"))
    out = O.run_status(s, "user_id", runs)
    return out.select("user_id", "status", F.array_join(F.transform(F.map_entries("stages"), lambda x: F.concat(x["key"].cast("string"), F.lit("="), x["value"])), ",").alias("stages"), "run_status")


@register("a03_stage_funnel", "SELECT event_type AS stage, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS items, CAST(sum(event_id % 4) AS BIGINT) AS failed_items, count(*) AS attempts, round(avg(value), 4) AS seconds FROM events GROUP BY 1")
def a03(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).select(F.col("event_type").alias("stage"), F.floor("value").alias("items"), (F.col("event_id") % 4).alias("failed_items"), F.col("value").alias("seconds"))
    return O.stage_funnel(s).withColumn("seconds", F.round("seconds", 4))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("event_id").alias("run_id"), F.col("user_id").alias("source_id"), "ts", (F.col("event_type") == "error").alias("failed"), (F.floor("value") % 10).alias("new_count"))


_KINDS = "CASE event_type WHEN 'error' THEN 'run' WHEN 'view' THEN 'run' WHEN 'click' THEN 'verdict' WHEN 'purchase' THEN 'notification' ELSE CASE event_id % 40 WHEN 0 THEN 'stuck' WHEN 1 THEN 'open_alert' ELSE 'other' END END"
_FAILED = "event_type = 'error' OR event_type = 'purchase' AND event_id % 3 = 0"


def facts(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.select("event_id", F.col("user_id").alias("source_id"), "ts", F.expr(_KINDS).alias("kind"), F.expr(_FAILED).alias("failed"), (F.floor("value") % 10).alias("new_count"), F.concat(F.lit("code"), (F.col("event_id") % 5).cast("string")).alias("code"), (F.col("event_id") % 6 == 0).alias("test"))


_A4 = ", ".join(
    f"count_if({since} AND kind = 'run') AS runs_{n}, CAST(coalesce(sum(CASE WHEN {since} AND kind = 'run' AND NOT failed THEN new_count END), 0) AS BIGINT) AS new_{n}, count_if({since} AND kind = 'run' AND failed) AS failures_{n}, count_if({since} AND kind = 'verdict') AS verdicts_{n}, count_if({since} AND kind = 'notification' AND failed AND (grouping_id IS NOT NULL OR NOT test)) AS notification_failures_{n}"
    for n in (7, 30) for since in (f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL {n} DAY",)
)
_LAST = "epoch_us(max(ts) FILTER (kind = 'run' AND NOT failed)) AS last_success, epoch_us(max(ts) FILTER (kind = 'run' AND failed)) AS last_failure, arg_max(code, (ts, code)) FILTER (kind = 'run' AND failed) AS last_failure_code, count_if(kind = 'stuck') AS stuck, count_if(kind = 'open_alert') AS open_alerts, count_if(kind IN ('stuck', 'open_alert')) > 0 AS degraded"


@register(
    "a04_health_dashboard",
    f"""WITH f AS (SELECT user_id, ts, {_KINDS} AS kind, {_FAILED} AS failed, CAST(floor(value) AS BIGINT) % 10 AS new_count, 'code' || event_id % 5 AS code, event_id % 6 = 0 AS test FROM events)
    SELECT grouping_id AS source_id, {_A4}, {_LAST} FROM (SELECT *, user_id AS grouping_id FROM f UNION ALL SELECT *, NULL FROM f) GROUP BY grouping_id""",
)
def a04(spark: SparkSession, d: str) -> DataFrame:
    out = O.health_dashboard(facts(spark, d), F.lit(AS_OF).cast("timestamp"))
    return out.withColumns({c: F.unix_micros(c) for c in ("last_success", "last_failure")})


_DIGEST = "CASE event_type WHEN 'error' THEN 'run' WHEN 'view' THEN 'run' ELSE ['parser_mismatch', 'model_unreachable', 'model_unusable', 'recovered', 'alert_opened', 'mail_failed', 'mail_pending_retry'][event_id % 7 + 1] END"


@register(
    "a06_health_digest",
    f"""WITH f AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, event_type = 'error' AS failed, {_DIGEST} AS kind FROM events)
    SELECT day, count_if(kind = 'run') AS total_runs, count_if(kind = 'run' AND NOT failed) AS successful_runs, count_if(kind = 'run' AND failed) AS failed_runs, count_if(kind = 'parser_mismatch') AS parser_mismatches, count_if(kind LIKE 'model_%') AS model_failures, count_if(kind = 'recovered') AS recoveries, count_if(kind = 'alert_opened') AS new_open_alerts, count_if(kind LIKE 'mail_%') AS mail_failures,
      array_to_string(list_sort(list(event_id) FILTER (failed))[1:10], ',') AS first_failed, greatest(count_if(failed) - 10, 0) AS more_failed FROM f GROUP BY 1""",
)
def a06(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("parser_mismatch", "model_unreachable", "model_unusable", "recovered", "alert_opened", "mail_failed", "mail_pending_retry")
    kind = F.when(F.col("event_type").isin("error", "view"), "run").otherwise(F.get(F.array(*map(F.lit, kinds)), (F.col("event_id") % 7).cast("int")))
    e = events(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), kind.alias("kind"), (F.col("event_type") == "error").alias("failed"), F.col("event_id").alias("run_id"))
    return O.health_digest(e, ["day"]).withColumn("first_failed", F.array_join(F.col("first_failed").cast("array<string>"), ","))


def calls(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.date_format("ts", "yyyy-MM").alias("month"), F.weekofyear("ts").alias("week"), "ts", "event_id", F.when(F.col("event_id") % 5 != 0, (F.col("value") * 100).cast("long") / 100).alias("cost"))


_COST = "CASE WHEN event_id % 5 <> 0 THEN CAST(trunc(value * 100) AS BIGINT) / 100 END"


@register("a07_llm_usage", f"SELECT strftime(ts, '%Y-%m') AS month, count(*) AS calls, round(sum({_COST}), 2) AS known_cost, count_if(event_id % 5 = 0) AS unknown_calls, 20000.0 AS budget, coalesce(sum({_COST}), 0) < 20000.0 AS budget_open FROM events GROUP BY 1")
def a07(spark: SparkSession, d: str) -> DataFrame:
    return O.usage(calls(spark, d), "month", 20_000.0).withColumn("known_cost", F.round("known_cost", 2))


@register("a08_budget_state", f"WITH s AS (SELECT event_id, sum(coalesce({_COST}, 0.0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) SELECT event_id, round(spent, 2) AS spent, CASE WHEN spent >= 500.005 THEN 'awaiting_budget' WHEN spent >= 400.004 THEN 'warning' ELSE 'open' END AS state FROM s")
def a08(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d).join(table(spark, d, "events").select("event_id", "user_id"), "event_id")
    return O.budget_state(c, "user_id", ["ts", "event_id"], 500.005).select("event_id", F.round("spent", 2).alias("spent"), "state")


@register("a12_derive_verdict", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'DO NOT APPLY' WHEN bool_and(l_returnflag = 'N' AND l_discount < 0.05) THEN 'APPLY' ELSE 'APPLY WITH CONDITIONS' END AS recommendation FROM lineitem GROUP BY 1")
def a12(spark: SparkSession, d: str) -> DataFrame:
    flag, odd = F.col("l_returnflag"), F.col("l_linenumber") % 2 == 1
    status = F.when(flag == "R", F.when(odd, "failed").otherwise("not_met")).when(flag == "N", F.when(odd, "verified").otherwise("met")).otherwise("partially_verified")
    a = table(spark, d, "lineitem").select("l_orderkey", status.alias("status"), F.when(F.col("l_discount") >= 0.05, "gap").when(odd, "n/a").otherwise("<what is missing>").alias("gap"))
    return O.derive_verdict(a, "l_orderkey")


@register("a16_attempt_stats", """WITH a AS (SELECT user_id % 5 AS provider_id, event_type, event_id, value, lead(user_id % 5) OVER (PARTITION BY user_id // 5 ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('purchase', 'error'))
    SELECT provider_id, count_if(event_type = 'purchase') AS sent, count_if(event_type = 'error') AS failed, count_if(event_type = 'error' AND event_id % 2 = 0 AND n <> provider_id) AS failovers, count_if(event_type = 'error' AND event_id % 5 = 0) AS possible_duplicates, round(avg(CASE WHEN event_type = 'purchase' THEN value END), 4) AS latency_ms FROM a GROUP BY 1""")
def a16(spark: SparkSession, d: str) -> DataFrame:
    e, failed, k = events(spark, d).where("event_type IN ('purchase', 'error')"), F.col("event_type") == "error", F.col("event_id")
    a = e.select(F.floor(F.col("user_id") / 5).alias("notification_id"), (F.col("user_id") % 5).alias("provider_id"), k.alias("attempt_id"), "ts", F.when(failed, "failed").otherwise("sent").alias("status"), (failed & (k % 2 == 0)).alias("permanent"), (failed & (k % 5 == 0)).alias("possible_duplicate"), F.col("value").alias("latency_ms"))
    return O.attempt_stats(a).withColumn("latency_ms", F.round("latency_ms", 4))


@register("a17_distinct_count_page", "SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return O.distinct_count(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), ["status"], "o_custkey")


@register("j12_notice_only", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j12(spark: SparkSession, d: str) -> DataFrame:
    offered = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return O.notice_only(table(spark, d, "orders").select("o_orderkey"), offered, "o_orderkey")


@register("j13_notices_by_recommendation", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N')")
def j13(spark: SparkSession, d: str) -> DataFrame:
    verdicts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), "APPLY").otherwise("DO NOT APPLY").alias("recommendation"))
    return O.notices_by_recommendation(table(spark, d, "orders").select("o_orderkey"), verdicts, "o_orderkey", ["APPLY", "APPLY WITH CONDITIONS"])


@register("j14_previous_sent_asof", "SELECT u.user_id, u.event_id AS update_id, s.event_id AS previous_id FROM (SELECT * FROM events WHERE event_type = 'view') u ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') s ON u.user_id = s.user_id AND u.ts >= s.ts")
def j14(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("user_id", "ts", F.col("event_id").alias("id"), "event_type")
    return O.attach_previous_sent(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id")


_N9 = "n AS (SELECT o_orderkey AS notification_id, o_custkey % 25 AS source_id, CASE WHEN o_orderkey % 10 = 0 THEN (o_custkey + 3) % 25 END AS extra, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 'APPLY' WHEN o_orderstatus = 'F' THEN 'APPLY WITH CONDITIONS' ELSE 'DO NOT APPLY' END AS r, o_orderpriority = '1-URGENT' AS u FROM orders)"
_P9 = "p AS (SELECT s_suppkey AS id, 'mail' || (s_suppkey % 7) || '@example.com' AS email, CASE WHEN s_suppkey % 4 = 0 THEN 'cc' ELSE 'to' END AS delivery, CASE WHEN s_suppkey % 5 = 4 THEN 'dev_alert' ELSE 'business' END AS list_type, s_suppkey % 3 AS f, CASE WHEN s_suppkey % 2 = 0 THEN [] ELSE [s_nationkey, (s_nationkey + 1) % 25] END AS scope FROM supplier WHERE s_acctbal > 0)"
_ON9 = "list_type = 'dev_alert' AND r IS NULL OR list_type = 'business' AND r IS NOT NULL AND (len(scope) = 0 OR list_contains(scope, source_id) OR list_contains(scope, extra)) AND (f = 0 OR f = 1 AND r LIKE 'APPLY%' OR f = 2 AND u)"


def routing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o, k, nation = table(spark, d, "orders"), F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    said = F.when(F.col("o_orderkey") % 11 == 0, None).when(F.col("o_orderstatus") == "O", "APPLY").when(F.col("o_orderstatus") == "F", "APPLY WITH CONDITIONS").otherwise("DO NOT APPLY")
    extra = F.when(F.col("o_orderkey") % 10 == 0, F.array((F.col("o_custkey") + 3) % 25)).otherwise(F.array().cast("array<bigint>"))
    n = o.select(F.col("o_orderkey").alias("notification_id"), (F.col("o_custkey") % 25).alias("source_id"), extra.alias("source_scope"), said.alias("recommendation"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    p = table(spark, d, "supplier").select(
        k.alias("recipient_id"), F.concat(F.lit(" MAIL"), (k % 7).cast("string"), F.lit("@example.com")).alias("email"), F.when(k % 4 == 0, "cc").otherwise("to").alias("delivery"), F.when(k % 5 == 4, "dev_alert").otherwise("business").alias("list_type"),
        F.when(k % 3 == 0, "all").when(k % 3 == 1, "apply").otherwise("urgent").alias("receives"), F.when(k % 2 == 0, F.array().cast("array<bigint>")).otherwise(F.array(nation, (nation + 1) % 25)).alias("scope"), (F.col("s_acctbal") > 0).alias("active"),
    )
    return n, p


@register("j09_route_recipients", f"WITH {_N9}, {_P9} SELECT notification_id, email, delivery, min(id) AS recipient_id, min(list_type) AS list_type FROM n JOIN p ON {_ON9} GROUP BY ALL")
def j09(spark: SparkSession, d: str) -> DataFrame:
    return O.route_recipients(*routing(spark, d))


@register("j09_routing_failed", f"WITH {_N9}, {_P9} SELECT notification_id FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE id % 3 = 1 AND ({_ON9}))")
def j09_failed(spark: SparkSession, d: str) -> DataFrame:
    n, p = routing(spark, d)
    return O.routing_failed(n, p.where("recipient_id % 3 = 1")).select("notification_id")


@register("j09_test_mode", f"WITH {_N9}, {_P9} SELECT notification_id, email, delivery, min(id) AS recipient_id, 'dev_alert' AS list_type FROM n JOIN p ON list_type = 'dev_alert' GROUP BY ALL")
def j09_test(spark: SparkSession, d: str) -> DataFrame:
    return O.route_recipients(*routing(spark, d), test_mode=True)


_LINE = "lower(c_name) || '|' || CASE WHEN c_acctbal > 0 THEN 'to' ELSE 'cc' END || '|business'"


@register("k01_recipient_set_hash", f"SELECT c_mktsegment, sha256(string_agg(l, chr(10) ORDER BY l)) AS recipients_hash FROM (SELECT DISTINCT c_mktsegment, {_LINE} AS l FROM customer) GROUP BY 1")
def k01(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_mktsegment", F.col("c_name").alias("email"), F.when(F.col("c_acctbal") > 0, "to").otherwise("cc").alias("delivery"), F.lit("business").alias("list_type"))
    return O.recipient_set_hash(c, "c_mktsegment")


@register("k02_outbox_dedupe", """WITH c AS (SELECT o_orderkey AS id, sha256((o_orderkey // 2) || '|' || CASE WHEN (o_orderkey // 2) % 3 = 0 THEN 'raw-notice' ELSE CAST((o_orderkey // 2) * 10 AS VARCHAR) END || '|h') AS dedupe_key, CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 200 END AS priority FROM orders)
    SELECT dedupe_key, min(id) AS id, arg_min(priority, id) AS priority FROM c WHERE dedupe_key NOT IN (SELECT dedupe_key FROM c WHERE id % 10 = 0) GROUP BY 1""")
def k02(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor(F.col("o_orderkey") / 2)
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), n.alias("notice_id"), F.when(n % 3 != 0, n * 10).alias("verdict_id"), F.lit("h").alias("recipients_hash"), F.when(F.col("o_orderkey") % 2 == 0, "NEW").otherwise("UPDATE").alias("kind"), F.lit("info").alias("severity"))
    sent = O.outbox_dedupe(c.where("id % 10 = 0"), spark.createDataFrame([], "dedupe_key string"))
    return O.outbox_dedupe(c, sent).select("dedupe_key", "id", "priority")


@register("k05_retention_sweep", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-15 12:00:00' - INTERVAL 12 MONTH")
def k05(spark: SparkSession, d: str) -> DataFrame:
    return O.retention_sweep(table(spark, d, "orders"), "o_orderdate", F.lit("1998-06-15 12:00:00").cast("timestamp")).select("o_orderkey")


@register("p01_triage_rules", """WITH n AS (SELECT p_partkey, contains(lower(p_name || ' ' || p_type), 'ring') AS k, contains(lower(p_name || p_type || CASE WHEN p_partkey % 13 <> 0 THEN p_brand ELSE '' END), 'a') AS i, p_type IN ('ECONOMY', 'STANDARD') OR contains(lower(p_name), 'economy') OR contains(lower(p_name), 'standard') AS s,
      p_partkey % 13 <> 0 AND p_brand <> '' AND contains(p_brand, '#1') AS g, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS v FROM part)
    SELECT p_partkey, CASE WHEN k OR NOT s OR NOT g OR coalesce(v < 950, false) THEN 'discarded' ELSE 'passed' END AS status,
      CASE WHEN k THEN 'exclude_keyword' WHEN NOT s THEN 'sector_outside_target' WHEN NOT g THEN 'region_outside_target' WHEN v < 950 THEN 'contract_value_below_minimum' ELSE CASE WHEN i THEN 'include_keyword,' ELSE '' END || 'sector_target_match,region_target_match,' || CASE WHEN v IS NULL THEN 'contract_value_unavailable' ELSE 'contract_value_meets_minimum' END END AS reasons FROM n""")
def p01(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("sector"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_brand")).alias("region"), F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")).alias("value"))
    plain = n.withColumn("value", F.col("value").cast("double"))
    return O.triage_rules(plain, ["Ring "], ["a"], ["Economy", "STANDARD"], ["#1"], 950.0).select("p_partkey", "status", F.array_join("reasons", ",").alias("reasons"))


@register("p03_model_triage", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'triage_failed' WHEN toxic = 1 OR quality = 0 THEN 'discard' ELSE 'pass' END AS decision FROM labels")
def p03(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    good = F.to_json(F.struct(F.when(F.col("toxic") == 1, "discard").otherwise("pass").alias("decision"), F.when(k % 5 != 0, F.when(F.col("quality") == 0, 0.1).otherwise(0.9)).alias("score")))
    return O.model_triage_decisions(table(spark, d, "labels").select("doc_id", F.when(k % 7 == 0, "{broken").otherwise(good).alias("response")), 0.5).select("doc_id", "decision")


@register("p06_due_sources", f"""WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), s AS (SELECT s_suppkey, last, CASE WHEN s_suppkey % 4 <> 0 THEN 60 * (s_suppkey % 24) END AS f, s_acctbal > 0 AS a FROM supplier LEFT JOIN l ON user_id = s_suppkey AND s_suppkey % 3 <> 0),
    r AS (SELECT s_suppkey, CASE WHEN NOT a THEN 'inactive' WHEN last IS NULL THEN 'never_run' WHEN f IS NULL THEN 'no_frequency' WHEN TIMESTAMP '2024-01-30 12:00:00' >= last + to_minutes(f) THEN 'interval_elapsed' ELSE 'not_due' END AS reason FROM s) SELECT s_suppkey, reason, reason IN ('never_run', 'no_frequency', 'interval_elapsed') AS due FROM r""")
def p06(spark: SparkSession, d: str) -> DataFrame:
    last = events(spark, d).where("user_id % 3 <> 0").groupBy(F.col("user_id").alias("s_suppkey")).agg(F.max("ts").alias("last_run_at"))
    s = table(spark, d, "supplier").join(last, "s_suppkey", "left").select("s_suppkey", "last_run_at", F.when(F.col("s_suppkey") % 4 != 0, (60 * (F.col("s_suppkey") % 24)).cast("int")).alias("frequency_minutes"), (F.col("s_acctbal") > 0).alias("active"))
    return O.due_sources(s, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("s_suppkey", "reason", "due")


@register("p09_claimable_outbox", """WITH o AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'pending_retry' WHEN 2 THEN 'sending' ELSE 'sent' END AS status, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderdate AS c FROM orders)
    SELECT id, priority FROM o WHERE status = 'pending' AND c <= TIMESTAMP '1998-06-15 11:55:00' OR status = 'pending_retry' AND (id % 8 = 1 OR c + INTERVAL 1 DAY <= TIMESTAMP '1998-06-15 12:00:00') OR status = 'sending' AND c + INTERVAL 2 HOUR <= TIMESTAMP '1998-06-15 12:00:00' ORDER BY priority, c, id LIMIT 100""")
def p09(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    o = table(spark, d, "orders").select(k.alias("id"), F.when(k % 4 == 0, "pending").when(k % 4 == 1, "pending_retry").when(k % 4 == 2, "sending").otherwise("sent").alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), c.alias("created_at"), F.when(k % 8 != 1, c + F.expr("INTERVAL 1 DAY")).alias("next_retry_at"), (c + F.expr("INTERVAL 2 HOURS")).alias("claim_until"))
    return O.claimable_outbox(o, F.lit("1998-06-15 12:00:00").cast("timestamp"), 300, 100).select("id", "priority")


def runs(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("event_id").alias("run_id"), F.col("user_id").alias("source_id"), "ts", (F.col("event_type") == "error").alias("failed"), (F.floor("value") % 10).alias("new_count"))


@register("w05_run_gaps", """WITH r AS (SELECT event_id, user_id, ts, event_type = 'error' AS f, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS gap, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER w AS island FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id AS run_id, round(gap, 3) AS gap_seconds, CAST(sum(CAST(f AS INTEGER)) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS failures, coalesce(CASE WHEN user_id % 3 <> 0 THEN gap > 60 * 60 * (user_id % 24 + 1) END, false) AS overdue FROM r""")
def w05(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).withColumn("frequency_minutes", F.when(F.col("source_id") % 3 != 0, 60 * (F.col("source_id") % 24 + 1)))
    return O.run_gaps(r, "source_id").select("run_id", F.round("gap_seconds", 3).alias("gap_seconds"), "failures", "overdue")


@register("w06_rate_windows", """WITH c AS (SELECT event_id, count(*) OVER (PARTITION BY user_id, date_trunc('minute', ts)) AS in_minute, count(*) OVER (PARTITION BY user_id, date_trunc('day', ts)) AS in_day, count(*) OVER s AS in_60_s, count(*) OVER d AS so_far FROM events
      WINDOW s AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id, date_trunc('day', ts) ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT event_id, in_minute, in_day, in_60_s, in_60_s > 1 OR so_far > 2 AS over_limit FROM c""")
def w06(spark: SparkSession, d: str) -> DataFrame:
    return O.rate_windows(events(spark, d).select("event_id", "user_id", "ts"), "user_id", 1, 2).select("event_id", "in_minute", "in_day", "in_60_s", "over_limit")


_LIFE = """docs AS (SELECT l_orderkey AS n, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS id, l_shipdate AS c, l_shipdate + INTERVAL 1 DAY AS u, CASE l_returnflag WHEN 'A' THEN 'pending' WHEN 'N' THEN 'downloaded' ELSE 'failed' END AS dl, CASE WHEN l_returnflag <> 'N' THEN 'pending' ELSE 'extracted' END AS ex FROM lineitem),
    ev AS (SELECT user_id AS n, event_id AS id, ts, event_type AS t FROM events), tr AS (SELECT * FROM ev WHERE t = 'signup'), runs AS (SELECT * FROM ev WHERE t IN ('view', 'error')), related AS (SELECT n, id AS run_id FROM runs UNION SELECT n, id + 1 FROM tr WHERE id % 2 = 0),
    ver AS (SELECT n, id, ts, row_number() OVER (PARTITION BY n ORDER BY ts, id) AS k FROM ev WHERE t = 'click'), note AS (SELECT * FROM ev WHERE t = 'purchase')"""


@register(
    "w03_timeline",
    f"""WITH {_LIFE}, e AS (SELECT o_orderkey AS notice_id, 'discovery' AS stage, 'seen' AS status, o_orderdate AS ts, 'notice-' || o_orderkey AS event_id, 0 AS sequence FROM orders
      UNION ALL SELECT o_orderkey, 'deadline_resolution', CASE WHEN o_orderkey % 3 = 0 THEN 'unresolved' ELSE 'listing' END, o_orderdate + INTERVAL 1 HOUR, 'deadline-' || o_orderkey, 0 FROM orders WHERE o_orderkey % 4 <> 0
      UNION ALL SELECT n, 'document_discovery', 'discovered', c, 'doc-discovery-' || id, row_number() OVER (PARTITION BY n ORDER BY c, id) FROM docs
      UNION ALL SELECT n, 'document_acquisition', dl, u, 'doc-acquire-' || id, k FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY c, id) AS k FROM docs) WHERE dl <> 'pending'
      UNION ALL SELECT n, 'document_processing', ex, u, 'doc-process-' || id, k FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY c, id) AS k FROM docs) WHERE ex <> 'pending'
      UNION ALL SELECT n, 'verdict', 'completed', ts, 'verdict-' || id, 0 FROM ver WHERE k = 1
      UNION ALL SELECT n, 'triage', 'pass', ts, 'triage-' || id, row_number() OVER (PARTITION BY n ORDER BY ts, id) FROM tr
      UNION ALL SELECT n, 'notification', 'sent', ts, 'notif-' || id, row_number() OVER (PARTITION BY n ORDER BY ts, id) FROM note
      UNION ALL SELECT n, 'notification_attempt', CASE WHEN a = 0 THEN 'failed' ELSE 'sent' END, ts + to_minutes(CAST(a AS INTEGER)), 'notif-attempt-' || (id * 10 + a), a + 1 FROM note, range(2) AS r(a)
      UNION ALL SELECT related.n, 'run', 'started', ts, 'run-start-' || run_id, 0 FROM related JOIN runs ON runs.id = run_id
      UNION ALL SELECT related.n, 'run', CASE WHEN t = 'error' THEN 'errored' ELSE 'completed' END, ts + INTERVAL 5 MINUTE, 'run-end-' || run_id, 0 FROM related JOIN runs ON runs.id = run_id WHERE run_id % 9 <> 0)
    SELECT notice_id, stage, status, event_id, CAST(sequence AS INTEGER) AS sequence, row_number() OVER (PARTITION BY notice_id ORDER BY ts, event_id, sequence) AS position FROM e""",
)
def w03(spark: SparkSession, d: str) -> DataFrame:
    k, days = F.col("o_orderkey"), lambda c, text: F.col(c).cast("timestamp") + F.expr(f"INTERVAL {text}")
    notices = table(spark, d, "orders").select(k.alias("notice_id"), F.col("o_orderdate").cast("timestamp").alias("first_seen_at"), F.when(k % 4 != 0, days("o_orderdate", "1 HOUR")).alias("resolved_at"), F.when(k % 3 != 0, "listing").alias("deadline_source"))
    li, flag = O.assign_sequence(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "n"), F.col("l_returnflag")
    docs = li.select(F.col("l_orderkey").alias("notice_id"), (F.col("l_orderkey") * 100 + F.col("n")).alias("document_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"), days("l_shipdate", "1 DAY").alias("updated_at"), F.when(flag == "A", "pending").when(flag == "N", "downloaded").otherwise("failed").alias("download_status"), F.when(flag == "N", "extracted").otherwise("pending").alias("extraction_status"))
    e = lambda *kinds: events(spark, d).where(F.col("event_type").isin(*kinds))
    own, i = F.col("user_id").alias("notice_id"), F.col("event_id")
    triage = e("signup").select(own, i.alias("triage_id"), "ts", F.lit("pass").alias("status"), F.when(i % 2 == 0, i + 1).alias("run_id"))
    verdicts, notes = e("click").select(own, i.alias("verdict_id"), "ts"), e("purchase").select(own, i.alias("notification_id"), "ts", F.lit("sent").alias("status"))
    tries = notes.select("notification_id", "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("a")).select("notification_id", (F.col("notification_id") * 10 + F.col("a")).alias("attempt_id"), (F.col("ts") + F.make_interval(mins=F.col("a"))).alias("ts"), F.when(F.col("a") == 0, "failed").otherwise("sent").alias("status"))
    runs_ = e("view", "error").select(own, i.alias("run_id"), F.col("ts").alias("started_at"), F.when(i % 9 != 0, F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ended_at"), (F.col("event_type") == "error").alias("failed"))
    return O.reconstruct_timeline(notices, docs, triage, verdicts, notes, tries, runs_).drop("ts")


@register("t05_top_failures", "SELECT user_id, event_id, value FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 10")
def t05(spark: SparkSession, d: str) -> DataFrame:
    return O.top_failures(events(spark, d).withColumn("failed", F.col("event_type") == "error"), [F.desc("value"), "event_id"]).select("user_id", "event_id", "value")


@register("u01_related_runs", "SELECT user_id AS source_id, event_id AS run_id FROM events WHERE event_type = 'error' UNION SELECT user_id, event_id FROM events WHERE value > 100")
def u01(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("user_id").alias("source_id"), F.col("event_id").alias("run_id"), "event_type", "value")
    return O.related_runs(e.where("event_type = 'error'"), e.withColumn("run_id", F.when(F.col("value") > 100, F.col("run_id"))), "source_id")


@register("s14_page_result", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return O.page_result(table(spark, d, "orders").where("o_orderstatus = 'O'"), [F.desc("o_totalprice"), "o_orderkey"], 40, 20).select("o_orderkey", "o_totalprice", "total")


@register("r07_sliding_failure_rate", "WITH w AS (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS start, event_type FROM events) SELECT strftime(start, '%Y-%m-%d') AS start, count(*) AS runs, count_if(event_type = 'error') AS failures FROM w GROUP BY 1")
def r07(spark: SparkSession, d: str) -> DataFrame:
    return O.sliding_failure_rate(runs(spark, d))


@register("r08_activity_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def r08(spark: SparkSession, d: str) -> DataFrame:
    return O.activity_sessions(events(spark, d), "user_id", "6 hours").select("user_id", F.unix_micros("start").alias("start"), "n")
