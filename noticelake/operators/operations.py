"""Runs, usage, health, routing, delivery keys and time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.functions.text import is_placeholder

SEVERITY = {"info": 1, "warning": 2, "critical": 3}


def latest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key by the order's columns; one aggregation, no window, so hot keys combine before they are shuffled."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(key, *[F.col(f"row.{c}").alias(c) for c in rest])


def assign_sequence(df: DataFrame, key: str, order: Sequence[str], name: str = "sequence") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def run_status(stages: DataFrame, run: str, runs: DataFrame | None = None) -> DataFrame:
    """Status of a run by its stages: FAILED if one failed, else PARTIAL if one failed in part, else COMPLETED; with the map of its stages' worst statuses.

    A completed stage with ``failed_items`` is partial.  With ``runs`` (run,
    ended_at, error_count) also ``run_status``: RUNNING until a run has ended,
    then ERRORED or COMPLETED.
    """
    partial = F.col("status") == "PARTIAL"
    partial = partial | (F.col("failed_items") > 0) if "failed_items" in stages.columns else partial
    by_stage = stages.groupBy(run, "stage").agg(F.max(F.when(F.col("status") == "FAILED", 3).when(partial, 2).otherwise(1)).alias("rank"))
    name = lambda c: F.when(c == 3, "FAILED").when(c == 2, "PARTIAL").otherwise("COMPLETED")
    out = by_stage.groupBy(run).agg(name(F.max("rank")).alias("status"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", name(F.col("rank")))))).alias("stages"))
    if runs is None:
        return out
    state = F.when(F.col("ended_at").isNull(), "RUNNING").when((F.col("error_count") > 0) | (F.col("status") == "FAILED"), "ERRORED").otherwise("COMPLETED")
    return runs.select(run, "ended_at", "error_count").join(out, run, "left").withColumn("run_status", state).drop("ended_at", "error_count")


def stage_funnel(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage").agg(F.sum("items").alias("items"), F.sum("failed_items").alias("failed_items"), F.count(F.lit(1)).alias("attempts"), F.avg("seconds").alias("seconds"))


def health_dashboard(facts: DataFrame, as_of: Column, days: Sequence[int] = (7, 30)) -> DataFrame:
    """Figures per source and over all (null source), in one pass over (source_id, ts, kind, failed, new_count, code, test).

    ``kind`` is run, verdict, notification, or a state of now: stuck,
    open_alert.  In the last days: runs, notices they brought, failed runs,
    verdicts, failed notifications (over all without test ones); then the last
    success, the last failure and its code, and ``degraded`` if anything is
    stuck or an alert is open.
    """
    kind, failed, whole = F.col("kind"), F.col("failed"), F.grouping("source_id") == 1
    run = kind == "run"
    counts = []
    for n in days:
        since = F.col("ts") >= as_of - F.expr(f"INTERVAL {n} DAYS")
        note = since & (kind == "notification") & failed
        counts += [F.count_if(since & run).alias(f"runs_{n}"), F.coalesce(F.sum(F.when(since & run & ~failed, F.col("new_count"))), F.lit(0)).alias(f"new_{n}"), F.count_if(since & run & failed).alias(f"failures_{n}"), F.count_if(since & (kind == "verdict")).alias(f"verdicts_{n}"), F.when(whole, F.count_if(note & ~F.col("test"))).otherwise(F.count_if(note)).alias(f"notification_failures_{n}")]
    last = [F.max(F.when(run & ~failed, F.col("ts"))).alias("last_success"), F.max(F.when(run & failed, F.col("ts"))).alias("last_failure"), F.max_by("code", F.when(run & failed, F.struct("ts", "code"))).alias("last_failure_code")]
    now = [F.count_if(kind == "stuck").alias("stuck"), F.count_if(kind == "open_alert").alias("open_alerts")]
    out = facts.groupingSets([["source_id"], []], "source_id").agg(*counts, *last, *now)
    return out.withColumn("degraded", (F.col("stuck") > 0) | (F.col("open_alerts") > 0))


def health_digest(facts: DataFrame, by: Sequence[str], shown: int = 10) -> DataFrame:
    """(by, kind, failed, run_id) -> counts of a half-open window: runs in all, successful and failed, parser mismatches, failures of the model (unreachable, unusable), recoveries, new open alerts, failed mails; the first failed runs, and how many more there are.

    A failed mail is one that failed or waits for a retry.  Only as many failed
    runs as are shown reach a group's list.
    """
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    run, failed = F.col("kind") == "run", F.col("failed")
    counts = facts.groupBy(*by).agg(
        F.count_if(run).alias("total_runs"), F.count_if(run & ~failed).alias("successful_runs"), F.count_if(run & failed).alias("failed_runs"), n("parser_mismatch").alias("parser_mismatches"),
        n("model_unreachable", "model_unusable").alias("model_failures"), n("recovered").alias("recoveries"), n("alert_opened").alias("new_open_alerts"), n("mail_failed", "mail_pending_retry").alias("mail_failures"),
    )
    turn = F.row_number().over(Window.partitionBy(*by).orderBy("run_id"))
    first = facts.where(run & failed).withColumn("_turn", turn).where(F.col("_turn") <= shown).groupBy(*by).agg(F.array_sort(F.collect_list("run_id")).alias("first_failed"))
    out = counts.join(first, list(by), "left")
    return out.withColumn("more_failed", F.greatest(F.col("failed_runs") - shown, F.lit(0)))


def usage(calls: DataFrame, month: str, budget: float | None = None) -> DataFrame:
    """Calls, known cost and calls of unknown cost by month; with a budget also whether it is open."""
    out = calls.groupBy(month).agg(F.count(F.lit(1)).alias("calls"), F.sum("cost").alias("known_cost"), F.count_if(F.col("cost").isNull()).alias("unknown_calls"))
    return out.withColumns({"budget": F.lit(budget).cast("double"), "budget_open": F.lit(True) if budget is None else F.coalesce("known_cost", F.lit(0.0)) < budget})


def running_total(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], value: Column, name: str, block: str = "1 hour") -> DataFrame:
    """Appends ``name``, the sum of ``value`` of a key's rows up to and with each one in the order of ``ts`` and ``order``.

    In two steps, so that no task holds a key: rows are summed within blocks of
    time, and what the blocks before hold is added from their totals, a row per
    key and block.  Rows without a time come first, in a block of their own.
    """
    at = F.window(F.col(ts).cast("timestamp"), block)["start"]
    # window() leaves out rows without a time, so those are numbered apart
    timed = df.where(F.col(ts).isNotNull()).withColumn("_block", at)
    rows = timed.unionByName(df.where(F.col(ts).isNull()).withColumn("_block", F.lit(None).cast("timestamp"))).withColumn("_value", value)
    totals = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_block")).rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_block").alias("_of"), before.alias("_before"))
    within = F.sum("_value").over(Window.partitionBy(*keys, "_block").orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_block").eqNullSafe(F.col("_of"))]
    out = rows.withColumn("_within", within).join(offsets, same, "left").withColumn(name, F.col("_within") + F.coalesce("_before", F.lit(0.0)))
    return out.select(*df.columns, name)


def budget_state(calls: DataFrame, month: str, order: Sequence[str], budget: float, share: float = 0.8, block: str = "1 hour") -> DataFrame:
    """Appends ``spent`` up to and with each call of the month, in the order of a time and what breaks its ties, and the ``state`` after it: open, warning, awaiting_budget."""
    out = running_total(calls, [month], order[0], order[1:], F.coalesce("cost", F.lit(0.0)), "spent", block)
    return out.withColumn("state", F.when(F.col("spent") >= budget, "awaiting_budget").when(F.col("spent") >= share * budget, "warning").otherwise("open"))


def attempt_stats(attempts: DataFrame) -> DataFrame:
    """By provider: sent, failed, possible duplicates, mean latency of what was sent, and failovers (a permanent failure that another provider's attempt of the notification follows).

    Without ``permanent`` every failure is one; ``possible_duplicate`` and
    ``latency_ms`` count where they are given.
    """
    w = Window.partitionBy("notification_id").orderBy("ts", "attempt_id")
    over = attempts.withColumn("_next", F.lead("provider_id").over(w))
    failed, has = F.col("status") == "failed", lambda c: c in attempts.columns
    permanent = failed & F.col("permanent") if has("permanent") else failed
    figures = [F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(failed).alias("failed"), F.count_if(permanent & (F.col("_next") != F.col("provider_id"))).alias("failovers")]
    figures += [F.count_if("possible_duplicate").alias("possible_duplicates")] if has("possible_duplicate") else []
    figures += [F.avg(F.when(F.col("status") == "sent", F.col("latency_ms"))).alias("latency_ms")] if has("latency_ms") else []
    return over.groupBy("provider_id").agg(*figures)


#: Parts that what a profile gets is copied to, so that no key of the join is hot.
SALTS = 128
#: Rows of a profile that the join back carries in one.
AT_ONCE = 1_000
EVERYWHERE, DEVELOPERS = "*", "*dev"


def profiled(df: DataFrame, key: str, *wants: Column) -> DataFrame:
    """(key, profile, wants): each key once, with the distinct ``wants`` of its rows and these as a text; keys that want the same share their profile."""
    out = df.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*wants))).alias("wants"))
    return out.withColumn("profile", F.to_json("wants"))


def matched(profiles: DataFrame, keys: str, right: DataFrame, wanted: Column) -> DataFrame:
    """(profile, a row's ``wants``) beside the rows of ``right`` that share one of the keys, an equi-join over each distinct profile only."""
    a = profiles.select("profile", "wants").dropDuplicates(["profile"]).select("profile", F.explode("wants").alias("want"))
    a = a.select("profile", "want.*").withColumn("_key", F.explode(F.array_distinct(keys)))
    return a.join(right.withColumn("_key", F.explode(F.array_distinct(wanted))), "_key").drop("_key")


def dealt(profiles: DataFrame, key: str, of_profile: DataFrame) -> DataFrame:
    """What each profile gets, for every key with that profile: ``of_profile`` is copied to ``SALTS`` parts, among which the keys are dealt.

    The join carries ``AT_ONCE`` rows of a profile in one.  Both sides are dealt by
    profile and part and stay so however small they are, as their results are not:
    a broadcast of the keys would leave all pairs to the few tasks that hold
    ``of_profile``.
    """
    rest = [c for c in of_profile.columns if c != "profile"]
    chunks = of_profile.groupBy("profile").agg(F.ceil(F.count(F.lit(1)) / AT_ONCE).alias("_chunks"))
    packed = of_profile.join(chunks, "profile").groupBy("profile", F.pmod(F.xxhash64(*rest), "_chunks").alias("_chunk")).agg(F.collect_list(F.struct(*rest)).alias("_rows")).drop("_chunk")
    parts = max(SALTS, int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a = profiles.select(key, "profile", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("_salt")).repartition(parts, "profile", "_salt")
    b = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(parts, "profile", "_salt")
    return a.join(b.hint("merge"), ["profile", "_salt"]).select(key, F.inline("_rows"))


def _routes(notifications: DataFrame, recipients: DataFrame, test_mode: bool) -> tuple[DataFrame, DataFrame]:
    """The notifications with their profiles, and what each distinct profile gets.

    Notifications with the same source, scope, urgency and kind of
    recommendation have the same recipients, and of recipients who differ only
    by their ids the first one counts; so neither side meets the other row by row.
    """
    n = notifications if "source_scope" in notifications.columns else notifications.withColumn("source_scope", F.array().cast("array<string>"))
    raw = F.lit(test_mode) | F.col("recommendation").isNull()
    own = F.concat(F.array(F.lit(EVERYWHERE), F.col("source_id").cast("string")), F.coalesce(F.col("source_scope").cast("array<string>"), F.array().cast("array<string>")))
    keys = F.when(raw, F.array(F.lit(DEVELOPERS))).otherwise(F.array_sort(F.array_distinct(F.array_compact(own))))
    apply = ~raw & F.coalesce(F.col("recommendation").isin("APPLY", "APPLY WITH CONDITIONS"), F.lit(False))
    profiles = profiled(n, "notification_id", keys.alias("keys"), apply.alias("apply"), (~raw & F.coalesce("urgent", F.lit(False))).alias("urgent"))

    kind = [F.lower(F.trim("email")).alias("email"), (F.coalesce("delivery", F.lit("to")) if "delivery" in recipients.columns else F.lit("to")).alias("delivery"), "list_type", F.coalesce("receives", F.lit("all")).alias("receives")]
    wanted = F.when(F.col("list_type") == "dev_alert", F.array(F.lit(DEVELOPERS))).when(F.coalesce(F.size("scope"), F.lit(0)) > 0, F.col("scope").cast("array<string>")).otherwise(F.array(F.lit(EVERYWHERE)))
    people = recipients.where("active AND list_type IN ('business', 'dev_alert')").select("recipient_id", *kind, F.explode(F.array_distinct(wanted)).alias("scope"))
    people = people.groupBy("email", "delivery", "list_type", "receives", "scope").agg(F.min("recipient_id").alias("recipient_id"))
    takes = (F.col("list_type") == "dev_alert") | (F.col("receives") == "all") | ((F.col("receives") == "apply") & F.col("apply")) | ((F.col("receives") == "urgent") & F.col("urgent"))
    routes = matched(profiles, "keys", people, F.array("scope")).where(takes)
    return profiles, routes.groupBy("profile", "email", "delivery").agg(F.min("recipient_id").alias("recipient_id"), F.min("list_type").alias("list_type"))


def route_recipients(notifications: DataFrame, recipients: DataFrame, test_mode: bool = False) -> DataFrame:
    """(notification_id, source_id, recommendation, urgent) -> its recipients, by address and delivery the first id.

    Business recipients get a notification if they are active, their scope is
    empty or holds its source or one of its ``source_scope``, and their filter
    takes it.  In test mode, and for raw notices (without a recommendation), the
    active developers get it, whatever their scope and filter.
    """
    profiles, routes = _routes(notifications, recipients, test_mode)
    return dealt(profiles, "notification_id", routes).select("notification_id", "email", "delivery", "recipient_id", "list_type")


def routing_failed(notifications: DataFrame, recipients: DataFrame) -> DataFrame:
    """Notifications that no active recipient can receive, told by their profiles."""
    profiles, routes = _routes(notifications, recipients, False)
    failed = profiles.join(routes.select("profile").distinct(), "profile", "left_anti")
    return notifications.join(failed.select("notification_id"), "notification_id", "left_semi")


def notice_only(notices: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """Notices that offered no file."""
    return notices.join(offered.select(key).distinct(), key, "left_anti")


def notices_by_recommendation(notices: DataFrame, verdicts: DataFrame, key: str, recommendations: Sequence[str]) -> DataFrame:
    """Notices with a verdict of these recommendations, each once however many there are."""
    return notices.join(verdicts.where(F.col("recommendation").isin(*recommendations)).select(key), key, "left_semi")


def distinct_count(df: DataFrame, by: Sequence[str], key: str, approximate: bool = False) -> DataFrame:
    """Distinct keys by group: exact, or as an estimate that shuffles sketches only."""
    return df.groupBy(*by).agg((F.approx_count_distinct(key) if approximate else F.count_distinct(key)).alias("n"))


def page_result(df: DataFrame, order: Sequence[Column | str], offset: int, limit: int) -> DataFrame:
    """A page of the ordered rows, each with the ``total`` of all rows; a page beyond the end is empty.  The total is a scalar subquery of the same plan."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def top_failures(runs: DataFrame, order: Sequence[Column | str], k: int = 10) -> DataFrame:
    """The first k failed rows; the feature is the list's bound."""
    return runs.where("failed").orderBy(*order).limit(k)


def related_runs(runs: DataFrame, triage: DataFrame, key: str) -> DataFrame:
    """(key, run_id): a notice's own runs and those of its triage results, each once."""
    return runs.select(key, "run_id").union(triage.where("run_id IS NOT NULL").select(key, "run_id")).distinct()


def retention_sweep(df: DataFrame, ts: str, now: Column, months: int = 12) -> DataFrame:
    """Rows older than the retention."""
    return df.where(F.col(ts) < now - F.make_interval(months=F.lit(months)))


def sliding_failure_rate(runs: DataFrame, length: str = "7 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Runs and failures in sliding windows; a stream gets a watermark and emits closed windows."""
    runs = runs.withWatermark("ts", late) if runs.isStreaming else runs
    g = runs.groupBy(F.window("ts", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("runs"), F.count_if("failed").alias("failures"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd").alias("start"), "runs", "failures")


def activity_sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of a key's events that gaps separate; a stream gets a watermark and emits closed sessions."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def recipient_set_hash(recipients: DataFrame, by: str) -> DataFrame:
    """SHA-256 of a group's sorted recipient lines; independent of their order."""
    line = F.concat_ws("|", F.lower("email"), "delivery", "list_type")
    return recipients.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "\n"), 256).alias("recipients_hash"))


def outbox_dedupe(candidates: DataFrame, outbox: DataFrame) -> DataFrame:
    """Candidates with their ``dedupe_key`` and ``priority``, without those already in the outbox; of equal keys the first id stays."""
    key = F.sha2(F.concat_ws("|", F.col("notice_id").cast("string"), F.coalesce(F.col("verdict_id").cast("string"), F.lit("raw-notice")), "recipients_hash"), 256)
    priority = F.when(F.col("kind") == "NEW", 100).when(F.col("kind") == "UPDATE", 200).when(F.col("severity") == "critical", 10).otherwise(50)
    first = candidates.withColumns({"dedupe_key": key, "priority": priority}).withColumn("_turn", F.row_number().over(Window.partitionBy("dedupe_key").orderBy("id"))).where("_turn = 1").drop("_turn")
    return first.join(outbox.select("dedupe_key"), "dedupe_key", "left_anti")


def claimable_outbox(outbox: DataFrame, now: Column, lease_seconds: int, limit: int) -> DataFrame:
    """What a sender may claim, most urgent first: old pending rows, due retries, and sends whose claim ran out."""
    old = F.col("created_at") <= now - F.make_interval(secs=F.lit(lease_seconds))
    due = ((F.col("status") == "pending") & old) | ((F.col("status") == "pending_retry") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))) | ((F.col("status") == "sending") & (F.col("claim_until") <= now))
    return outbox.where(due).orderBy("priority", "created_at", "id").limit(limit)


def due_sources(sources: DataFrame, now: Column) -> DataFrame:
    """Appends ``next_due_at``, ``due`` and the ``reason``."""
    next_due = F.col("last_run_at") + F.make_interval(mins=F.col("frequency_minutes"))
    reason = F.when(~F.col("active"), "inactive").when(F.col("last_run_at").isNull(), "never_run").when(F.col("frequency_minutes").isNull(), "no_frequency").when(now >= next_due, "interval_elapsed").otherwise("not_due")
    return sources.withColumns({"next_due_at": next_due, "reason": reason}).withColumn("due", F.col("reason").isin("never_run", "no_frequency", "interval_elapsed"))


def attach_previous_sent(updates: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """(key, ts, id) of updates and of sent messages -> updates with ``previous_id``, the last message at or before (as-of, by a running last value)."""
    a = updates.select(key, "ts", F.col("id").alias("update_id"), F.lit(None).cast("long").alias("sent_id"), F.lit(1).alias("side"))
    b = sent.select(key, "ts", F.lit(None).cast("long").alias("update_id"), F.col("id").alias("sent_id"), F.lit(0).alias("side"))
    w = Window.partitionBy(key).orderBy("ts", "side", "sent_id").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("previous_id", F.last("sent_id", ignorenulls=True).over(w))
    return both.where("side = 1").select(key, "update_id", "previous_id")


def run_gaps(runs: DataFrame, key: str) -> DataFrame:
    """Appends ``gap_seconds`` since the run before, whether that is ``overdue`` by the source's ``frequency_minutes`` if it has one, and ``failures``, the consecutive failures up to each run."""
    w = Window.partitionBy(key).orderBy("ts", "run_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    out = runs.withColumn("gap_seconds", (t - F.lag(t).over(w)) / 1e6).withColumn("_island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w))
    if "frequency_minutes" in runs.columns:
        out = out.withColumn("overdue", F.coalesce(F.col("gap_seconds") > 60 * F.col("frequency_minutes"), F.lit(False)))
    return out.withColumn("failures", F.sum(F.col("failed").cast("int")).over(Window.partitionBy(key, "_island").orderBy("ts", "run_id"))).drop("_island")


#: Minutes of a key that are counted together; a divisor of a day's.
RATE_BLOCK = 10
_SLIDE = 60_000_000


def rate_windows(requests: DataFrame, key: str, per_minute: int, per_day: int, block: int = RATE_BLOCK) -> DataFrame:
    """Appends the requests of the minute and of the day, and of the 60 s that end with each one; ``over_limit`` by the sliding count or the day's so far.

    A task holds ``block`` minutes of a key, with the last 60 s of the block
    before it handed over, and what the day's earlier blocks hold comes from
    their totals: a key with a third of all requests is dealt by time.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    length = block * _SLIDE
    own = requests.withColumns({"_us": micros, "_block": F.floor(micros / length), "_own": F.lit(1)})
    totals = own.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_of")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_day", F.floor(F.col("_of") * block / 1440))
    of_day = Window.partitionBy("_key", "_day")
    totals = totals.select("_key", "_of", F.sum("_n").over(of_day).alias("in_day"), F.coalesce(F.sum("_n").over(of_day.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    handed = own.where(F.col("_us") >= (F.col("_block") + 1) * length - _SLIDE + 1).withColumns({"_block": F.col("_block") + 1, "_own": F.lit(0)})
    here = Window.partitionBy(key, "_block")
    rows = own.unionByName(handed).withColumns({
        "in_60_s": F.count(F.lit(1)).over(here.orderBy("_us").rangeBetween(-_SLIDE + 1, 0)), "_so_far": F.sum("_own").over(here.orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)),
        "in_minute": F.sum("_own").over(Window.partitionBy(key, "_block", F.floor(F.col("_us") / _SLIDE))),
    })
    out = rows.where("_own = 1").join(totals, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_of")), "left")
    over = (F.col("in_60_s") > per_minute) | (F.col("_before") + F.col("_so_far") > per_day)
    return out.select(*requests.columns, "in_minute", "in_day", "in_60_s", over.alias("over_limit"))


#: Other words for an assessment's status.
STATUS_ALIASES = {"verified": "met", "partial": "partially_met", "partially_verified": "partially_met", "failed": "not_met"}


def settled(assessments: DataFrame) -> DataFrame:
    """Assessments with ``status`` by its usual name, and placeholders in ``gap`` as null."""
    alias = F.create_map(*[F.lit(x) for pair in STATUS_ALIASES.items() for x in pair])
    return assessments.withColumns({"status": F.coalesce(alias[F.col("status")], F.col("status")), "gap": F.when(~is_placeholder(F.col("gap")), F.col("gap"))})


def derive_verdict(assessments: DataFrame, by: str) -> DataFrame:
    """DO NOT APPLY if one requirement isn't met, APPLY if all are met without gaps, else APPLY WITH CONDITIONS; by the settled assessments."""
    s = F.col("status")
    return settled(assessments).groupBy(by).agg(F.when(F.bool_or(s == "not_met"), "DO NOT APPLY").when(F.bool_and((s == "met") & F.col("gap").isNull()), "APPLY").otherwise("APPLY WITH CONDITIONS").alias("recommendation"))


def triage_rules(notices: DataFrame, excluded: Sequence[str] = (), included: Sequence[str] = (), sectors: Sequence[str] = (), regions: Sequence[str] = (), minimum: float | None = None) -> DataFrame:
    """(title, sector, region, value, notice_text) -> the same with ``status`` (passed, discarded) and ``reasons``.

    The first rule that discards gives the only reason: a word that excludes; a
    sector or region that is blank or holds no target, unless the text holds
    one; a value below the minimum.  Otherwise the reasons say what spoke for
    the notice, in order, or that no rule speaks against it.
    """
    has = lambda c: c in notices.columns
    fields = [F.col(c).cast("string") for c in ("title", "sector", "region", "value", "notice_text") if has(c)]
    text = F.lower(F.concat_ws(" ", *fields))
    some = lambda words, where: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(where, w)) if words else F.lit(False)
    low = lambda words: [w.strip().lower() for w in words if w.strip()]
    status, reasons = [(some(low(excluded), text), "exclude_keyword")], [(some(low(included), text), "include_keyword")]
    for name, targets in (("sector", low(sectors)), ("region", low(regions))):
        if targets:
            value = F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))
            fits = (value != "") & (some(targets, value) | some(targets, text))
            status.append((~fits, f"{name}_outside_target"))
            reasons.append((fits, f"{name}_target_match"))
    if minimum is not None:
        value = F.col("value").try_cast("double")
        status.append((F.coalesce(value < minimum, F.lit(False)), "contract_value_below_minimum"))
        reasons += [(F.coalesce(value >= minimum, F.lit(False)), "contract_value_meets_minimum"), (value.isNull(), "contract_value_unavailable")]
    against = F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in status])
    speaking = F.array_compact(F.array(*[F.when(good, F.lit(name)) for good, name in reasons]))
    why = F.when(against.isNotNull(), F.array(against)).when(F.size(speaking) == 0, F.array(F.lit("no_rule_disqualifier"))).otherwise(speaking)
    return notices.withColumns({"status": F.when(against.isNotNull(), "discarded").otherwise("passed"), "reasons": why})


def model_triage_decisions(responses: DataFrame, threshold: float | None) -> DataFrame:
    """Decision of a JSON response: pass or discard, below the threshold discard; whatever else came back is ``triage_failed``."""
    v = F.try_parse_json("response")
    decision, score = F.try_variant_get(v, "$.decision", "string"), F.try_variant_get(v, "$.score", "double")
    sound = F.coalesce(decision.isin("pass", "discard"), F.lit(False)) & (F.lit(threshold is None) | (score.isNotNull() & ~F.isnan(score)))
    low = F.coalesce(score < threshold, F.lit(False)) if threshold is not None else F.lit(False)
    return responses.withColumn("decision", F.when(~sound, "triage_failed").when((decision == "discard") | low, "discard").otherwise("pass"))


def timeline(*kinds: DataFrame) -> DataFrame:
    """(notice_id, kind, ts, event_id) of several kinds -> one timeline with a number per notice and kind, for all notices at once."""
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.withColumn("sequence", F.row_number().over(Window.partitionBy("notice_id", "kind").orderBy("ts", "event_id")))


def reconstruct_timeline(notices: DataFrame, documents: DataFrame, triage: DataFrame, verdicts: DataFrame, notifications: DataFrame, attempts: DataFrame, runs: DataFrame, first_verdict: bool = True) -> DataFrame:
    """The life of all notices: (notice_id, stage, status, ts, event_id, sequence), eleven kinds of events in one table.

    notices (notice_id, first_seen_at, resolved_at, deadline_source); documents
    (notice_id, document_id, created_at, updated_at, download_status,
    extraction_status); triage (notice_id, triage_id, ts, status, run_id);
    verdicts (notice_id, verdict_id, ts); notifications (notice_id,
    notification_id, ts, status); attempts (notification_id, attempt_id, ts,
    status); runs (notice_id, run_id, started_at, ended_at, failed).

    What is pending isn't an event; of verdicts the earliest counts, unless
    ``first_verdict`` is false.  A notice's runs are its own and those of its
    triage results.  Within a notice, events stand by time, event id as text and
    sequence; numbers count a notice's documents, triage results and
    notifications and a notification's attempts, and are 0 for the rest.

    All kinds go through one shuffle by notice: a row brings its events along,
    and every count and the final order are windows within that partitioning.
    """
    col = F.col

    def event(stage: str, status: Column | str, ts: str, prefix: str, key: str, numbered: bool = False, when: Column | None = None) -> Column:
        out = F.struct(F.lit(stage).alias("stage"), (F.lit(status) if isinstance(status, str) else status).alias("status"), col(ts).cast("timestamp").alias("ts"), F.concat(F.lit(f"{prefix}-"), col(key).cast("string")).alias("event_id"), F.lit(numbered).alias("_numbered"))
        return out if when is None else F.when(when, out)

    def rows(df: DataFrame, group: str, ts: str, key: str, *events: Column, within: Column | None = None) -> DataFrame:
        """A row per source row: what is counted together, in which order, and its events."""
        place = F.lit("") if within is None else within.cast("string")
        return df.select("notice_id", F.lit(group).alias("_group"), place.alias("_within"), col(ts).cast("timestamp").alias("_ts"), col(key).cast("string").alias("_id"), F.array_compact(F.array(*events)).alias("_events"))

    known = lambda c: col(c) != "pending"
    tries = attempts.join(notifications.select("notice_id", "notification_id"), "notification_id")
    related = related_runs(runs, triage, "notice_id").join(runs.drop("notice_id").dropDuplicates(["run_id"]), "run_id")
    kinds = [
        rows(notices, "notice", "first_seen_at", "notice_id", event("discovery", "seen", "first_seen_at", "notice", "notice_id"), event("deadline_resolution", F.coalesce("deadline_source", F.lit("unresolved")), "resolved_at", "deadline", "notice_id", when=col("resolved_at").isNotNull())),
        rows(documents, "document", "created_at", "document_id", event("document_discovery", "discovered", "created_at", "doc-discovery", "document_id", True), event("document_acquisition", col("download_status"), "updated_at", "doc-acquire", "document_id", True, known("download_status")), event("document_processing", col("extraction_status"), "updated_at", "doc-process", "document_id", True, known("extraction_status"))),
        rows(verdicts, "verdict", "ts", "verdict_id", event("verdict", "completed", "ts", "verdict", "verdict_id")),
        rows(triage, "triage", "ts", "triage_id", event("triage", col("status"), "ts", "triage", "triage_id", True)),
        rows(notifications, "notification", "ts", "notification_id", event("notification", col("status"), "ts", "notif", "notification_id", True)),
        rows(tries, "attempt", "ts", "attempt_id", event("notification_attempt", col("status"), "ts", "notif-attempt", "attempt_id", True), within=col("notification_id")),
        rows(related, "run", "started_at", "run_id", event("run", "started", "started_at", "run-start", "run_id"), event("run", F.when(col("failed"), "errored").otherwise("completed"), "ended_at", "run-end", "run_id", when=col("ended_at").isNotNull())),
    ]
    whole = kinds[0]
    for k in kinds[1:]:
        whole = whole.unionByName(k)
    counted = whole.repartition("notice_id").withColumn("_n", F.row_number().over(Window.partitionBy("notice_id", "_group", "_within").orderBy("_ts", col("_id").try_cast("long"), "_id")))
    if first_verdict:
        counted = counted.where("_group <> 'verdict' OR _n = 1")
    out = counted.select("notice_id", "_n", F.inline("_events")).select("notice_id", "stage", "status", "ts", "event_id", F.when(col("_numbered"), col("_n")).otherwise(0).alias("sequence"))
    return out.withColumn("position", F.row_number().over(Window.partitionBy("notice_id").orderBy("ts", "event_id", "sequence")))
