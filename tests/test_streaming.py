"""Streams give what their batch forms give, a second run reads nothing again, timers fire and states are forgotten."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from noticelake.operators import operations as O
from noticelake.streaming import durable as D
from noticelake.streaming import state as S
from tests.oracle import DATA


def landed(spark, tmp_path, parts: int = 3):
    """The event table as files that land in the order of time."""
    e = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    t = F.col("event_type")
    e = e.withColumns({"failed": t == "error", "recovered": t == "view", "alert_type": F.when(t == "click", "unheard_of").otherwise("source_failed"), "event": F.when(t.isin("view", "click"), "claim").when(t == "purchase", "fail").when(t == "error", "sent").otherwise("requeue"), "attempt": F.col("event_id"), "title": t, "status": F.when(t == "signup", "expired").otherwise("new")})
    for k in range(parts):
        e.where(F.floor(F.col("event_id") * parts / 1000) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


MACHINES = {"alerts": S.alert_manager(), "breaker": S.provider_breaker(cooldown=86_400), "quota": S.quota_limiter(1, 2), "dedup": S.dedup(["title"], ["title"], ["expired"]), "outbox": S.outbox_lifecycle(10**7), "lease": S.leased_breaker(2, 10**7)}


@pytest.mark.parametrize("name", sorted(MACHINES))
def test_streams_are_their_folds(spark, tmp_path, name):
    batch, stream = landed(spark, tmp_path)
    for k in range(2):  # the second run finds no new files
        if name == "lease":
            stream, batch = (df.withColumn("event", F.when(F.col("event_id") % 4 == 0, "failure").when(F.col("event_id") % 7 == 0, "success").otherwise("start")) for df in (stream, batch))
        done = S.run_once(S.stream(stream, ["user_id"], MACHINES[name], late="40 days"), str(tmp_path / "out"), str(tmp_path / "check"))
        assert done.rows == (0 if k else batch.count()) and done.late == 0
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(S.fold(batch, ["user_id"], MACHINES[name]))


def write(spark, folder, *events):
    at = datetime.datetime(2024, 1, 1)
    got = [(k, at + datetime.timedelta(minutes=m), i, e) for k, m, i, e in events]
    spark.createDataFrame(got, "key long, ts timestamp, event_id long, event string").coalesce(1).write.mode("append").parquet(folder)


def test_a_lease_is_a_timer_and_states_are_forgotten(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "key long, ts timestamp, event_id long, event string"
    machine = S.outbox_lifecycle(lease_seconds=600)

    def go():
        stream = spark.readStream.schema(schema).parquet(folder)
        return S.run_once(S.stream(stream, ["key"], machine, late="1 minute", forget_hours=2), str(tmp_path / "out"), str(tmp_path / "check"))

    write(spark, folder, (1, 0, 1, "claim"), (2, 0, 2, "claim"), (2, 1, 3, "sent"))
    go()
    write(spark, folder, (9, 30, 4, "claim"))  # the watermark passes key 1's lease
    go()
    write(spark, folder, (9, 31, 5, "sent"), (1, 31, 6, "claim"))
    go()
    write(spark, folder, (9, 600, 7, "claim"))  # and key 2's two hours
    go()
    write(spark, folder, (2, 601, 8, "claim"), (1, 5, 9, "sent"))  # the last one is too late
    assert go().late == 1
    out = {(r.key, r.event_id): r.state for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.event_id is not None}
    assert out[(1, 1)] == "sending" and out[(1, 6)] == "sending" and out[(2, 3)] == "sent" and out[(2, 8)] == "sending" and (1, 9) not in out
    timers = [(r.key, r.state) for r in spark.read.parquet(str(tmp_path / "out")).where("event_id IS NULL").collect()]
    assert (1, "pending_retry") in timers and (1, "possible_duplicate") in timers


def test_digest_stream(spark, tmp_path):
    batch, stream = landed(spark, tmp_path)
    S.run_once(S.daily_digest(stream), str(tmp_path / "g"), str(tmp_path / "cg"))
    got, want = rows(spark.read.parquet(str(tmp_path / "g"))), rows(S.daily_digest(batch))
    assert got and set(got) <= set(want) and len(want) - len(got) <= 1  # the last day is still open


def test_sources_are_apart_and_a_dry_run_writes_nothing(spark, tmp_path):
    batch, stream = landed(spark, tmp_path)
    sources = {"good": stream.where("user_id % 2 = 0"), "bad": stream.where("user_id % 2 = 1").withColumn("event_id", F.raise_error(F.lit("no")).cast("long")), "other": stream}
    dry = S.monitor_once(sources, lambda e: e.select("event_id"), str(tmp_path / "out"), str(tmp_path / "c"), dry={k: batch for k in sources})
    assert not (tmp_path / "out").exists() and dry["good"] == (1000, None)
    report = S.monitor_once(sources, lambda e: e.select("event_id"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert report["bad"][1] is not None and report["good"][1] is None and report["other"] == (1000, None)
    assert spark.read.parquet(str(tmp_path / "out/source=other")).count() == 1000


def test_settings_are_read_for_each_batch(spark, tmp_path):
    _, stream = landed(spark, tmp_path)
    S.enrich_each_batch(stream.select("user_id", "event_id"), lambda s: s.createDataFrame([(1, "one")], "user_id long, name string"), "user_id", str(tmp_path / "e"), str(tmp_path / "ce"))
    out = spark.read.parquet(str(tmp_path / "e"))
    assert out.count() == 1000 and out.where("user_id = 1 AND name IS NULL").count() == 0


def test_a_probe_holds_the_only_slot_until_it_ends_or_is_lost(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    events = [(0, 1, "start"), (1, 1, "failure"), (2, 2, "start"), (3, 2, "failure"), (4, 3, "start"), (14, 4, "start"), (15, 5, "start"), (16, 4, "failure"), (17, 6, "start"), (30, 7, "start"), (31, 7, "cancel"), (32, 8, "start"), (41, 9, "start"), (55, 10, "start"), (56, 10, "success"), (57, 11, "start")]
    schema = "key long, ts timestamp, event_id long, attempt long, event string"
    df = spark.createDataFrame([(1, at + datetime.timedelta(minutes=m), k, a, e) for k, (m, a, e) in enumerate(events)], schema)
    got = [(r.allowed, r.state) for r in S.fold(df, ["key"], S.leased_breaker(2, 600)).orderBy("event_id").collect()]
    assert got == [
        (True, "closed"), (None, "closed"), (True, "closed"), (None, "open"), (False, "open"), (True, "half_open"), (False, "half_open"), (None, "open"), (False, "open"), (True, "half_open"), (None, "half_open"), (False, "half_open"),
        (True, "half_open"), (True, "half_open"), (None, "closed"), (True, "closed"),
    ]
    folder = str(tmp_path / "in")
    for part in (df.where("event_id < 6"), df.where("event_id >= 13").withColumn("key", F.lit(2).cast("long"))):  # the second moves the watermark beyond the probe's lease
        part.coalesce(1).write.mode("append").parquet(folder)
        S.run_once(S.stream(spark.readStream.schema(schema).parquet(folder), ["key"], S.leased_breaker(2, 600), late="1 minute"), str(tmp_path / "out"), str(tmp_path / "c"))
    S.run_once(S.stream(spark.readStream.schema(schema).parquet(folder), ["key"], S.leased_breaker(2, 600), late="1 minute"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert [(r.key, r.allowed, r.state) for r in spark.read.parquet(str(tmp_path / "out")).where("event_id IS NULL").collect()] == [(1, None, "half_open")]


@pytest.mark.parametrize("name", ["dedup", "lease", "quota"])
def test_durable_streams_are_their_folds(spark, tmp_path, name):
    batch, stream = landed(spark, tmp_path)
    machine, where = MACHINES[name], lambda k: str(tmp_path / k)
    store = D.state_store(spark, where("states"), "user_id long", machine, buckets=2)
    for _ in range(2):
        D.durable_stream(stream, ["user_id"], machine, store, where("out"), where("check"), "s")
    assert store.last().batches == {"s": 2}
    assert rows(D.outputs(spark, where("out"), ["user_id"], machine)) == rows(S.fold(batch, ["user_id"], machine))


def test_a_key_that_was_silent_for_months_is_known_and_a_crashed_batch_counts_once(spark, tmp_path, monkeypatch):
    machine = S.dedup(["title"], ["title"])
    store, out = D.state_store(spark, str(tmp_path / "s"), "key long", machine), str(tmp_path / "o")
    at = lambda day, i, key, title: (key, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day), i, title)
    batch = lambda *events: spark.createDataFrame(events, "key long, ts timestamp, event_id long, title string")
    D.advance(batch(at(0, 1, 1, "a"), at(0, 2, 2, "b")), 0, ["key"], machine, store, out, "s")
    with monkeypatch.context() as m:
        m.setattr(type(store), "_mark", lambda self, commit: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            D.advance(batch(at(90, 3, 1, "half")), 1, ["key"], machine, store, out, "s")
    second = batch(at(90, 3, 1, " a "), at(90, 4, 2, "c"), at(90, 5, 3, "d"))
    assert D.advance(second, 1, ["key"], machine, store, out, "s") and not D.advance(second, 1, ["key"], machine, store, out, "s")
    D.advance(batch(at(1, 6, 3, "d")), 2, ["key"], machine, store, out, "s")  # long before the others
    got = {r.event_id: r.outcome for r in D.outputs(spark, out, ["key"], machine).collect()}
    assert got == {1: "NEW", 2: "NEW", 3: "UNCHANGED", 4: "UPDATE", 5: "NEW", 6: "UNCHANGED"}


def test_windows_and_sessions_of_streams(spark, tmp_path):
    batch, stream = landed(spark, tmp_path)
    for name, of in (("rate", lambda df: O.sliding_failure_rate(df, late="2 days")), ("sessions", lambda df: O.activity_sessions(df.select("user_id", "ts"), "user_id", "6 hours", late="2 days"))):
        S.run_once(of(stream), str(tmp_path / name), str(tmp_path / f"c{name}"))
        got, want = rows(spark.read.parquet(str(tmp_path / name))), rows(of(batch))
        assert got and set(got) <= set(want) and len(got) > len(want) / 2
