"""State machines over keyed events, as batch folds and as Structured Streaming operators.

A machine is one small step from a state and an event to a state and an output.
``fold`` runs it over whole tables: a key's events meet in one partition, sorted,
and only the state is carried from one to the next.  ``stream`` runs the same
step with ``applyInPandasWithState``; the state of a key expires when nothing
came for a while, and a machine's own timer may act before.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

State, Output = tuple, tuple


class Machine(NamedTuple):
    """``step`` takes a state and an event (with ``us``, its time in microseconds) and gives the next state and the event's output.

    ``due`` says when a state's timer runs out, None for never; ``expire`` then
    gives the next state and an output without an event.
    """

    start: State
    state: str
    output: str
    step: Callable[[State, Any], tuple[State, Output]]
    due: Callable[[State], int | None] = lambda s: None
    expire: Callable[[State], tuple[State, Output]] | None = None


def fold(events: DataFrame, keys: Sequence[str], machine: Machine) -> DataFrame:
    """(keys, ts, event_id, ...) -> (keys, event_id, output), by each key's events in the order of ts and event_id."""
    keys = list(keys)
    names = [c.split()[0] for c in machine.output.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, machine.start
        for frame in frames:
            rows = []
            for e in frame.itertuples(index=False):
                key = tuple(getattr(e, k) for k in keys)
                if key != last:
                    last, state = key, machine.start
                state, out = machine.step(state, e)
                rows.append((*key, e.event_id, *out))
            yield pd.DataFrame(rows, columns=[*keys, "event_id", *names])

    timed = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    kinds = ", ".join(f"{k} {timed.schema[k].dataType.simpleString()}" for k in keys)
    return timed.repartition(*keys).sortWithinPartitions(*keys, "us", "event_id").mapInPandas(run, f"{kinds}, event_id long, {machine.output}")


def stream(events: DataFrame, keys: Sequence[str], machine: Machine, late: str = "1 hour", forget_hours: int = 24 * 30) -> DataFrame:
    """``fold`` on a stream.  Events that come ``late``, beyond the watermark, are dropped; others are folded as they come, sorted within a batch.

    A key's state goes ``forget_hours`` after its last event, by event time.
    Timers fire when the watermark passes them, with a null ``event_id``.
    """
    keys = list(keys)
    names = [c.split()[0] for c in machine.output.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, newest = state.get if state.exists else (*machine.start, 0)
        held, rows = tuple(held), []
        if state.hasTimedOut:
            due = machine.due(held)
            if due is None or machine.expire is None:
                state.remove()
                return
            held, out = machine.expire(held)
            rows.append((*key, None, *out))
        else:
            for e in pd.concat(list(frames)).sort_values(["us", "event_id"]).itertuples(index=False):
                held, out = machine.step(held, e)
                newest = max(newest, int(e.us))
                rows.append((*key, e.event_id, *out))
        state.update((*held, newest))
        due = machine.due(held)
        at = newest // 1000 + forget_hours * 3_600_000 if due is None else due // 1000
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[*keys, "event_id", *names]).astype({"event_id": "Int64"})

    timed = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withWatermark("ts", late)
    kinds = ", ".join(f"{k} {timed.schema[k].dataType.simpleString()}" for k in keys)
    return timed.groupBy(*keys).applyInPandasWithState(run, f"{kinds}, event_id long, {machine.output}", f"{machine.state}, newest long", "append", GroupStateTimeout.EventTimeTimeout)


# The types of alerts.
ALERT_TYPES = ("source_failed", "parser_mismatch", "ai_failure", "invalid_ai_output", "budget_80_percent", "budget_100_percent", "email_all_providers_failed", "provider_circuit_breaker_opened", "daily_health_digest")


def alert_manager(remind_hours: int = 24, types: Sequence[str] = ALERT_TYPES) -> Machine:
    """Of events (alert_type, recovered): ``action`` open, throttle, remind, recover, ignore or reject, and the ``alert`` that is sent, if any.

    The first trigger opens an alert; while it is open others are throttled,
    but one ``remind_hours`` after the last reminder (or the opening) reminds; a
    recovery closes it and is told as ``<type>_recovered``.  Unknown types are
    rejected.
    """
    us = remind_hours * 3_600_000_000

    def step(s: State, e: Any) -> tuple[State, Output]:
        (since,) = s
        if e.alert_type not in types:
            return s, ("reject", None)
        if e.recovered:
            return (-1,), ("ignore", None) if since < 0 else ("recover", f"{e.alert_type}_recovered")
        if since < 0:
            return (int(e.us),), ("open", e.alert_type)
        if e.us - since >= us:
            return (int(e.us),), ("remind", e.alert_type)
        return s, ("throttle", None)

    return Machine((-1,), "since long", "action string, alert string", step)


def provider_breaker(failures: int = 3, cooldown: int = 300) -> Machine:
    """Of events (failed): ``allowed`` and the ``state`` after each attempt: closed, open.

    So many failures in a row open the breaker for ``cooldown`` seconds;
    attempts in that time are refused and count for nothing.  The first one
    after it is a probe, which holds the lease alone as events come one by one:
    success closes, failure opens anew.
    """

    def step(s: State, e: Any) -> tuple[State, Output]:
        n, until = s
        allowed = until < 0 or e.us >= until
        if allowed:
            n = n + 1 if e.failed else 0
            until = int(e.us) + cooldown * 1_000_000 if e.failed and (until >= 0 or n >= failures) else -1
        return (n, until), (bool(allowed), "open" if until >= 0 else "closed")

    return Machine((0, -1), "n int, until long", "allowed boolean, state string", step)


def leased_breaker(failures: int = 3, cooldown: int = 300) -> Machine:
    """Of events (event, attempt): whether a ``start`` is ``allowed`` (null for others), and the ``state`` after each one: closed, open, half_open.

    Attempts begin by ``start`` and end by ``success``, ``failure`` or
    ``cancel`` (nothing was sent).  So many failures in a row open the breaker
    for ``cooldown`` seconds.  The first start after that is a probe: it holds
    the only slot under a lease of the same length, and starts beside it are
    refused.  Its failure opens the breaker anew, a success closes it, whoever
    had it.  A probe that never ends loses the slot with its lease, which a
    stream's timer tells; a cancelled one gives it back, for the next start after the lease.
    """
    lease = cooldown * 1_000_000
    closed, open_, half = "closed", "open", "half_open"

    def lost(s: State) -> tuple[State, Output]:
        return (half, s[1], s[2], -1), (None, half)

    def step(s: State, e: Any) -> tuple[State, Output]:
        mode, n, until, probe = s
        now = int(e.us)
        if e.event == "start":
            if mode == closed:
                return s, (True, closed)
            if now < until:
                return s, (False, mode)
            return (half, n, now + lease, int(e.attempt)), (True, half)
        if e.event == "cancel":
            return (mode, n, until, -1 if mode == half and probe == int(e.attempt) else probe), (None, mode)
        if e.event == "success":
            return (closed, 0, -1, -1), (None, closed)
        n += 1
        if mode == half or (mode == closed and n >= failures):
            return (open_, n, now + lease, -1), (None, open_)
        return (mode, n, until, probe), (None, mode)

    return Machine((closed, 0, -1, -1), "mode string, n int, until long, probe long", "allowed boolean, state string", step, lambda s: s[2] if s[0] == half and s[3] >= 0 else None, lost)


def quota_limiter(per_minute: int, per_day: int) -> Machine:
    """``accepted`` while the calendar minute's and day's counts are below their limits; refused requests don't count."""

    def step(s: State, e: Any) -> tuple[State, Output]:
        minute, in_minute, day, in_day = s
        m, d = int(e.us) // 60_000_000, int(e.us) // 86_400_000_000
        in_minute, in_day = in_minute if m == minute else 0, in_day if d == day else 0
        ok = in_minute < per_minute and in_day < per_day
        return (m, in_minute + ok, d, in_day + ok), (ok,)

    return Machine((-1, 0, -1, 0), "minute long, in_minute int, day long, in_day int", "accepted boolean", step)


def outbox_lifecycle(lease_seconds: int = 300, most_sends: int = 2) -> Machine:
    """Of events (event): the ``state`` after each one.

    ``claim`` leads to sending under a lease, ``sent`` ends, ``fail`` to
    pending_retry.  A lease that runs out while sending may have sent: it leads
    to pending_retry, after ``most_sends`` sends to possible_duplicate, until an
    operator's ``requeue``.  In a stream the lease is a timer; in a batch it
    counts as run out before the next event.
    """

    def run_out(s: State) -> tuple[State, Output]:
        state = "possible_duplicate" if s[1] >= most_sends else "pending_retry"
        return (state, s[1], -1), (state,)

    def step(s: State, e: Any) -> tuple[State, Output]:
        if s[0] == "sending" and e.us >= s[2]:
            s, _ = run_out(s)
        state, sends, until = s
        if e.event == "claim" and state in ("pending", "pending_retry"):
            state, sends, until = "sending", sends + 1, int(e.us) + lease_seconds * 1_000_000
        elif e.event == "sent" and state == "sending":
            state, until = "sent", -1
        elif e.event == "fail" and state == "sending":
            state, until = "pending_retry", -1
        elif e.event == "requeue" and state == "possible_duplicate":
            state, sends = "pending", 0
        return (state, sends, until), (state,)

    return Machine(("pending", 0, -1), "state string, sends int, until long", "state string", step, lambda s: s[2] if s[0] == "sending" else None, run_out)


def dedup(fields: Sequence[str], material: Sequence[str], terminal: Sequence[str] = ()) -> Machine:
    """Of listings (fields, status): ``outcome`` NEW, UPDATE or UNCHANGED against the last one of the key, and the ``changed`` fields.

    Texts compare with white space folded.  Only material fields make an update,
    and a key whose last ``status`` is terminal is frozen, so that a replay
    changes nothing.
    """

    def plain(v: Any) -> str | None:
        return None if v is None else " ".join(str(v).split())

    def step(s: State, e: Any) -> tuple[State, Output]:
        known, status = s
        now = {f: plain(getattr(e, f)) for f in fields}
        if not known:
            return (json.dumps(now), getattr(e, "status", "") or ""), ("NEW", "")
        changed = [f for f in fields if json.loads(known)[f] != now[f]]
        if status in terminal:
            return s, ("UNCHANGED", ",".join(changed))
        return (json.dumps(now), getattr(e, "status", "") or ""), ("UPDATE" if set(changed) & set(material) else "UNCHANGED", ",".join(changed))

    return Machine(("", ""), "known string, status string", "outcome string, changed string", step)


def daily_digest(runs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Totals and failures by day; on a stream with a watermark, so that closed days are emitted once.  ``run_once`` counts the rows that came too late."""
    if runs.isStreaming:
        runs = runs.withWatermark("ts", late)
    g = runs.groupBy(F.window("ts", "1 day").alias("w"))
    return g.agg(F.count(F.lit(1)).alias("total"), F.count_if("failed").alias("failed")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "total", "failed")


def enriched(events: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Stream-static join: events with their source's settings as read when the run starts."""
    return events.join(sources, key, "left")


def enrich_each_batch(events: DataFrame, read: Callable[[SparkSession], DataFrame], key: str, path: str, checkpoint: str) -> None:
    """``enriched`` with the settings read anew for each batch, appended to ``path``; one pass over what has landed."""

    def write(batch: DataFrame, _: int) -> None:
        enriched(batch, read(batch.sparkSession), key).write.mode("append").parquet(path)

    events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Pass(NamedTuple):
    """Rows that a pass read, and rows that came beyond the watermark."""

    rows: int
    late: int


def run_once(events: DataFrame, path: str, checkpoint: str, mode: str = "append") -> Pass:
    """One incremental pass over what has landed; running it again reads only new files."""
    q = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    progress = [json.loads(p.json) for p in q.recentProgress]
    return Pass(sum(p["numInputRows"] for p in progress), sum(o.get("numRowsDroppedByWatermark", 0) for p in progress for o in p.get("stateOperators", [])))


def monitor_once(sources: dict[str, DataFrame], transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, dry: dict[str, DataFrame] | None = None) -> dict[str, tuple[int, str | None]]:
    """A pass over each source's landed files: source to (rows read, error).

    Each source has a checkpoint and a folder of its own, so that one that fails
    stops no other.  With ``dry``, the sources' files as batches, they are read
    and transformed and nothing is written.
    """
    report: dict[str, tuple[int, str | None]] = {}
    for name, events in sources.items():
        try:
            if dry is not None:
                transform(dry[name]).write.format("noop").mode("overwrite").save()
                report[name] = (dry[name].count(), None)
            else:
                report[name] = (run_once(transform(events), f"{path}/source={name}", f"{checkpoint}/{name}").rows, None)
        except Exception as error:  # noqa: BLE001  any failure of a source is its own
            report[name] = (0, type(error).__name__)
    return report
