"""The state machines over the event table, and passes over landed files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.plans.operations import events
from noticelake.plans.registry import register, shared_dir, table
from noticelake.streaming import durable as D
from noticelake.streaming import state as S

_ORDERED = "e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"


@register("r01_stream_dedup", """WITH e AS (SELECT *, lag(event_type) OVER w AS last, count_if(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS frozen, first_value(event_type) OVER w AS f,
      first_value(event_type) OVER (PARTITION BY user_id, event_type = 'signup' ORDER BY ts, event_id) AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, CASE WHEN last IS NULL THEN 'NEW' WHEN frozen OR last = event_type THEN 'UNCHANGED' ELSE 'UPDATE' END AS outcome, CASE WHEN last IS NULL OR event_type = CASE WHEN frozen THEN 'signup' ELSE last END THEN '' ELSE 'title' END AS changed FROM e""")
def r01(spark: SparkSession, d: str) -> DataFrame:
    listings = events(spark, d).withColumns({"title": F.concat(F.lit(" "), F.col("event_type")), "status": F.when(F.col("event_type") == "signup", "expired").otherwise("new")})
    return S.fold(listings.select("user_id", "ts", "event_id", "title", "status"), ["user_id"], S.dedup(["title"], ["title"], ["expired"]))


@register("r02_alert_manager", f"""WITH RECURSIVE {_ORDERED} WHERE event_type IN ('error', 'view', 'click')),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS event_id, '' AS action FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT f.user_id, e.n, CASE WHEN event_type = 'click' THEN since WHEN event_type = 'view' THEN NULL WHEN since IS NULL OR us - since >= 86400000000 THEN us ELSE since END, e.event_id,
        CASE WHEN event_type = 'click' THEN 'reject' WHEN event_type = 'view' THEN CASE WHEN since IS NULL THEN 'ignore' ELSE 'recover' END WHEN since IS NULL THEN 'open' WHEN us - since >= 86400000000 THEN 'remind' ELSE 'throttle' END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, event_id, action, CASE WHEN action IN ('open', 'remind') THEN 'source_failed' WHEN action = 'recover' THEN 'source_failed_recovered' END AS alert FROM f WHERE n > 0""")
def r02(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    e = events(spark, d).where(kind.isin("error", "view", "click")).select("user_id", "ts", "event_id", F.when(kind == "click", "unheard_of").otherwise("source_failed").alias("alert_type"), (kind == "view").alias("recovered"))
    return S.fold(e, ["user_id"], S.alert_manager())


@register("r03_provider_breaker", f"""WITH RECURSIVE {_ORDERED} WHERE event_type IN ('error', 'purchase')),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, 0 AS n, CAST(NULL AS BIGINT) AS until, CAST(NULL AS BIGINT) AS event_id, true AS allowed FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT f.user_id, e.n, CASE WHEN until IS NOT NULL AND us < until THEN f.n WHEN event_type = 'error' THEN f.n + 1 ELSE 0 END,
        CASE WHEN until IS NOT NULL AND us < until THEN until WHEN event_type = 'error' AND (until IS NOT NULL OR f.n + 1 >= 3) THEN us + 86400000000 END, e.event_id, until IS NULL OR us >= until FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.i + 1)
    SELECT user_id, event_id, allowed, CASE WHEN until IS NULL THEN 'closed' ELSE 'open' END AS state FROM f WHERE i > 0""")
def r03(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("event_type IN ('error', 'purchase')").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("failed"))
    return S.fold(e, ["user_id"], S.provider_breaker(cooldown=86_400))


@register("r03_leased_breaker", f"""WITH RECURSIVE {_ORDERED}),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, 'closed' AS mode, 0 AS n, CAST(-1 AS BIGINT) AS until, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS allowed FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT user_id, k, CASE WHEN start AND mode <> 'closed' AND us >= until THEN 'half_open' WHEN ok THEN 'closed' WHEN bad AND (mode = 'half_open' OR mode = 'closed' AND n + 1 >= 2) THEN 'open' ELSE mode END, CASE WHEN ok THEN 0 WHEN bad THEN n + 1 ELSE n END,
        CASE WHEN start AND mode <> 'closed' AND us >= until OR bad AND (mode = 'half_open' OR mode = 'closed' AND n + 1 >= 2) THEN us + 172800000000 WHEN ok THEN -1 ELSE until END, id, CASE WHEN start THEN mode = 'closed' OR us >= until END
      FROM (SELECT f.*, e.n AS k, e.us, e.event_id AS id, e.event_type IN ('view', 'click') AS start, e.event_type = 'purchase' AS ok, e.event_type = 'error' AS bad FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.i + 1))
    SELECT user_id, event_id, allowed, mode AS state FROM f WHERE i > 0""")
def r03_lease(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    event = F.when(kind.isin("view", "click"), "start").when(kind == "purchase", "success").when(kind == "error", "failure").otherwise("cancel")
    return S.fold(events(spark, d).select("user_id", "ts", "event_id", event.alias("event"), F.col("event_id").alias("attempt")), ["user_id"], S.leased_breaker(2, 2 * 86_400))


@register("r01_durable_dedup", """WITH e AS (SELECT *, lag(event_type) OVER w AS last, count_if(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY part, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS frozen FROM (SELECT *, event_id % 3 AS part FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY part, ts, event_id))
    SELECT user_id, event_id, CASE WHEN last IS NULL THEN 'NEW' WHEN frozen OR last = event_type THEN 'UNCHANGED' ELSE 'UPDATE' END AS outcome, CASE WHEN last IS NULL OR event_type = CASE WHEN frozen THEN 'signup' ELSE last END THEN '' ELSE 'title' END AS changed FROM e""")
def r01_durable(spark: SparkSession, d: str) -> DataFrame:
    """Events land in three parts that go back in time; after each a stream goes on from the table of states, and the last batch comes twice."""
    folder, machine = f"{shared_dir(spark)}/{uuid.uuid4().hex}", S.dedup(["title"], ["title"], ["expired"])
    e = events(spark, d).select("user_id", "ts", "event_id", F.concat(F.lit(" "), F.col("event_type")).alias("title"), F.when(F.col("event_type") == "signup", "expired").otherwise("new").alias("status"))
    store = D.state_store(spark, f"{folder}/states", "user_id long", machine)
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{folder}/landed")
        D.durable_stream(spark.readStream.schema(e.schema).parquet(f"{folder}/landed"), ["user_id"], machine, store, f"{folder}/out", f"{folder}/checkpoint", "dedup")
    D.advance(e.where(F.col("event_id") % 3 == 2), 2, ["user_id"], machine, store, f"{folder}/out", "dedup")
    return D.outputs(spark, f"{folder}/out", ["user_id"], machine)


@register("r04_quota_limiter", f"""WITH RECURSIVE {_ORDERED}),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS m, 0 AS im, CAST(-1 AS BIGINT) AS d, 0 AS id, CAST(NULL AS BIGINT) AS event_id, true AS accepted FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT f.user_id, e.n, us // 60000000, CASE WHEN m = us // 60000000 THEN im ELSE 0 END + CASE WHEN CASE WHEN m = us // 60000000 THEN im ELSE 0 END < 1 AND CASE WHEN d = us // 86400000000 THEN id ELSE 0 END < 2 THEN 1 ELSE 0 END,
        us // 86400000000, CASE WHEN d = us // 86400000000 THEN id ELSE 0 END + CASE WHEN CASE WHEN m = us // 60000000 THEN im ELSE 0 END < 1 AND CASE WHEN d = us // 86400000000 THEN id ELSE 0 END < 2 THEN 1 ELSE 0 END, e.event_id,
        CASE WHEN m = us // 60000000 THEN im ELSE 0 END < 1 AND CASE WHEN d = us // 86400000000 THEN id ELSE 0 END < 2 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id, event_id, accepted FROM f WHERE n > 0""")
def r04(spark: SparkSession, d: str) -> DataFrame:
    return S.fold(events(spark, d).select("user_id", "ts", "event_id"), ["user_id"], S.quota_limiter(1, 2))


@register("r05_outbox_lifecycle", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'fail' WHEN 'error' THEN 'sent' ELSE 'requeue' END AS ev, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 'pending' AS s, 0 AS sends, CAST(-1 AS BIGINT) AS until, CAST(NULL AS BIGINT) AS event_id FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL SELECT user_id, n, CASE WHEN ev = 'claim' AND s IN ('pending', 'pending_retry') THEN 'sending' WHEN ev = 'sent' AND s = 'sending' THEN 'sent' WHEN ev = 'fail' AND s = 'sending' THEN 'pending_retry' WHEN ev = 'requeue' AND s = 'possible_duplicate' THEN 'pending' ELSE s END,
        CASE WHEN ev = 'claim' AND s IN ('pending', 'pending_retry') THEN sends + 1 WHEN ev = 'requeue' AND s = 'possible_duplicate' THEN 0 ELSE sends END, CASE WHEN ev = 'claim' AND s IN ('pending', 'pending_retry') THEN us + 21600000000 WHEN s = 'sending' AND ev NOT IN ('sent', 'fail') THEN until ELSE -1 END, event_id
      FROM (SELECT f.user_id, e.n, e.ev, e.us, e.event_id, f.sends, f.until, CASE WHEN f.s = 'sending' AND e.us >= f.until THEN CASE WHEN f.sends >= 2 THEN 'possible_duplicate' ELSE 'pending_retry' END ELSE f.s END AS s FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
    SELECT user_id, event_id, s AS state FROM f WHERE n > 0""")
def r05(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    event = F.when(t.isin("view", "click"), "claim").when(t == "purchase", "fail").when(t == "error", "sent").otherwise("requeue")
    return S.fold(events(spark, d).select("user_id", "ts", "event_id", event.alias("event")), ["user_id"], S.outbox_lifecycle(6 * 3600))


@register("r06_digest", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total, count_if(event_type = 'error') AS failed FROM events GROUP BY 1")
def r06(spark: SparkSession, d: str) -> DataFrame:
    return S.daily_digest(events(spark, d).select("ts", (F.col("event_type") == "error").alias("failed")))


@register("r09_monitor_once", "SELECT event_type AS source, event_id, event_type = 'error' AS failed FROM events WHERE event_type IN ('error', 'view')")
def r09(spark: SparkSession, d: str) -> DataFrame:
    """Two passes over the landed events, source by source; the second finds nothing new."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    landed = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    sources = {name: landed.where(F.col("event_type") == name) for name in ("error", "view")}
    for _ in range(2):
        S.monitor_once(sources, lambda e: e.select("event_id", (F.col("event_type") == "error").alias("failed")), f"{folder}/out", f"{folder}/checkpoints")
    return spark.read.parquet(f"{folder}/out")


@register("r10_enrich", "SELECT event_id, s_name FROM events LEFT JOIN supplier ON user_id = s_suppkey")
def r10(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("user_id"), "s_name")
    return S.enriched(events(spark, d).select("user_id", "event_id"), s, "user_id").select("event_id", "s_name")
