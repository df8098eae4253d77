"""Sinks: replays, crashes between write and marker, other writers, and what a merge leaves alone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from noticelake.sources import sinks as K


def files(spark, table) -> dict[str, str]:
    """Data file to partition, of the newest commit."""
    rows = table.read().select(F.input_file_name().alias("f")).distinct().collect()
    return {r.f: r.f.split("place=")[1].split("/")[0] for r in rows}


def snapshot(spark, path):
    return K.notice_snapshot(spark, str(path), "id long, title string, meta map<string, string>", ["id"], buckets=4)


HOW = K.upserting(["id"], ["title"], ["meta"], ["pos"])


def changes(spark, *rows):
    return spark.createDataFrame(rows, "id long, title string, meta map<string, string>, pos int")


def rows(df):
    return sorted((r.id, r.title, tuple(sorted((r.meta or {}).items())), r.status, r.is_update) for r in df.collect())


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    t = snapshot(spark, tmp_path)
    first = changes(spark, (1, "a", {"x": "1"}, 0), (2, "b", None, 0), (2, "b2", None, 1))
    assert t.merge(first, HOW, "s", 0) and not t.merge(first, HOW, "s", 0)
    assert t.merge(changes(spark, (1, "a", {"x": "2", "y": "3"}, 0), (3, "c", None, 0)), HOW, "s", 1)
    want = [(1, "a", (("x", "2"), ("y", "3")), "updated", True), (2, "b2", (), "new", False), (3, "c", (), "new", False)]
    assert rows(t.read()) == want
    assert not t.merge(first, HOW, "s", 0) and t.last().version == 2 and rows(t.read()) == want
    assert rows(t.read(1)) == [(1, "a", (("x", "1"),), "new", False), (2, "b2", (), "new", False)]


def test_a_crash_before_the_marker_is_not_seen_and_the_next_attempt_replaces_it(spark, tmp_path, monkeypatch):
    t = snapshot(spark, tmp_path)
    t.merge(changes(spark, (1, "a", None, 0), (2, "b", None, 0)), HOW, "s", 0)
    before = rows(t.read())
    with monkeypatch.context() as m:
        m.setattr(K.KeyedTable, "_mark", lambda self, commit: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            t.merge(changes(spark, (1, "half", None, 0), (5, "lost", None, 0)), HOW, "s", 1)
    assert rows(snapshot(spark, tmp_path).read()) == before
    assert t.merge(changes(spark, (2, "whole", None, 0)), HOW, "s", 1)
    assert rows(t.read()) == [(1, "a", (), "new", False), (2, "whole", (), "updated", True)]


def test_a_faster_writer_wins(spark, tmp_path, monkeypatch):
    t, other = snapshot(spark, tmp_path), snapshot(spark, tmp_path)
    mark = K.KeyedTable._mark

    def late(self, commit):
        monkeypatch.setattr(K.KeyedTable, "_mark", mark)
        mark(other, commit._replace(partitions={}))
        mark(self, commit)

    monkeypatch.setattr(K.KeyedTable, "_mark", late)
    with pytest.raises(K.ConcurrentCommit):
        t.merge(changes(spark, (1, "a", None, 0)), HOW)
    assert t.last().version == 1 and t.read().count() == 0


def test_other_buckets_files_stay_and_old_versions_go(spark, tmp_path):
    store = K.bundle_store(spark, str(tmp_path), buckets=8)
    all_of = spark.range(200).select(F.col("id").alias("notice_id"), F.lit("[]").alias("bundle"))
    K.write_bundles(store, all_of)
    before = files(spark, store)
    K.write_bundles(store, spark.createDataFrame([(7, "[7]")], "notice_id long, bundle string"))
    after = files(spark, store)
    touched = {p for f, p in before.items() if f not in after}
    assert len(touched) == 1 and {p for f, p in after.items() if f not in before} == touched
    assert store.read().count() == 200 and store.read().where("notice_id = 7").first().bundle == "[7]"
    for k in range(3):
        K.write_bundles(store, all_of.withColumn("bundle", F.lit(str(k))))
    assert store.remove_old(1) == [1, 2, 3, 4] and {r.bundle for r in store.read().collect()} == {"2"}


def test_a_rerun_replaces_only_its_configuration(spark, tmp_path):
    store = K.extraction_store(spark, str(tmp_path), buckets=2)
    got = lambda config, *pairs: spark.createDataFrame([(n, f"h{n}", "p1", config, s) for n, s in pairs], K.ARTIFACT_SCHEMA)
    K.write_extractions(store, got("c/0=%", ("1", "extracted"), ("2", "failed"), (None, "failed")))
    old = {f for f, p in files(spark, store).items()}
    K.write_extractions(store, got("c1", ("1", "failed"), ("1", "extracted"), ("2", "failed")))
    K.write_extractions(store, got("c1", ("2", "extracted"), ("1", "extracted")))
    assert old <= set(files(spark, store))
    found = sorted(((r.config_version, r.notice_id, r.status) for r in store.read().collect()), key=str)
    assert found == [("c/0=%", "1", "extracted"), ("c/0=%", "2", "failed"), ("c/0=%", None, "failed"), ("c1", "1", "extracted"), ("c1", "2", "extracted")]


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    t = snapshot(spark, tmp_path / "t")
    for k in range(2):
        changes(spark, (1, f"v{k}", None, k), (10 + k, "n", None, k)).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, title string, meta map<string, string>, pos int").parquet(str(tmp_path / "in"))
        for _ in range(2):
            K.stream_into(stream, t, HOW, "s", str(tmp_path / "c"))
    assert t.last().version == 2 and t.last().batches == {"s": 1}
    assert rows(t.read()) == [(1, "v1", (), "updated", True), (10, "n", (), "new", False), (11, "n", (), "new", False)]


def test_empty_changes_and_empty_tables(spark, tmp_path):
    t = snapshot(spark, tmp_path)
    assert t.read().collect() == [] and t.merge(changes(spark, (1, "a", None, 0)).limit(0), HOW, "s", 0) and t.read().collect() == []
    assert not t.merge(changes(spark, (1, "a", None, 0)), HOW, "s", 0)
