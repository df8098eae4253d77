"""Sinks that can be run again: keyed tables whose buckets are replaced under a commit marker.

A table's rows lie in partitions (columns of its own, and a bucket by the hash
of its keys).  A merge reads and writes only the partitions that its rows
belong to, as new folders ``data/<version>/...``; nothing is overwritten in place.
A marker ``commits/<version>.json``, put there by one rename, then says for each
partition which folder holds it.  Readers know committed folders only, so what a
crash leaves between write and marker is never seen, and the next attempt
replaces it.  The marker also holds each stream's last batch: a batch that comes
again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noticelake.operators.changes import upsert_notices

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Commit(NamedTuple):
    """A committed state: its number, the version that holds each partition, and the last batch of each stream."""

    version: int
    partitions: dict[str, int]
    batches: dict[str, int]


class ConcurrentCommit(RuntimeError):
    """Another writer committed the same version first; the merge has to be run again on top of it."""


class KeyedTable:
    """A table of one row per key at ``path``, which the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], partition_by: Sequence[str] = (), buckets: int = 16) -> None:
        self.spark, self.path, self.schema, self.keys, self.by, self.buckets = spark, path.rstrip("/"), schema, list(keys), list(partition_by), buckets

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def last(self) -> Commit:
        """The newest commit; of an empty table version 0 without partitions."""
        folder, fs = self._file("commits")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith("_")]
        return self.at(int(names[-1][:-5])) if names else Commit(0, {}, {})

    def at(self, version: int) -> Commit:
        return Commit(**json.loads(self.spark.read.text(f"{self.path}/commits/{version:010d}.json").first().value))

    def _folders(self, commit: Commit, only: Sequence[str] | None = None) -> list[str]:
        return [f"{self.path}/data/{v:010d}/place={p}" for p, v in sorted(commit.partitions.items()) if only is None or p in only]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of the newest commit, or of an older one."""
        return self._rows(self._folders(self.last() if version is None else self.at(version)))

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Appends ``place``, the name of a row's partition, of letters that any file system takes."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("string")
        values = [F.coalesce(F.hex(F.encode(F.col(c).cast("string"), "UTF-8")), F.lit("null")) for c in self.by]
        return rows.withColumn("place", F.concat_ws("_", *values, bucket))

    def merge(self, changes: DataFrame, how: Merge, stream: str = "", batch: int | None = None) -> bool:
        """Replaces the partitions that ``changes`` touch by ``how(their rows, changes)``; False, and nothing happens, for a batch of the stream that was committed before.

        ``changes`` hold the keys and the partition columns.  The names of
        touched partitions come to the driver: so many as there are
        configured buckets and values of the partition columns.
        """
        before = self.last()
        if batch is not None and before.batches.get(stream, -1) >= batch:
            return False
        version = before.version + 1
        touched = [r["place"] for r in self._placed(changes).select("place").distinct().collect()]
        rows = how(self._rows(self._folders(before, touched)), changes).select(*self.schema.names)
        attempt = f"attempts/{uuid.uuid4().hex}"
        # rows of one partition are dealt to several tasks by their keys
        self._placed(rows).repartition("place", *self.keys).write.partitionBy("place").parquet(f"{self.path}/{attempt}")
        written = self._publish(attempt, version)
        partitions = {p: v for p, v in before.partitions.items() if p not in touched} | dict.fromkeys(written, version)
        self._mark(Commit(version, partitions, before.batches if batch is None else {**before.batches, stream: batch}))
        return True

    def _publish(self, attempt: str, version: int) -> list[str]:
        """Moves an attempt under its version, in place of what a crashed one left there; the partitions that it has."""
        target, fs = self._file(f"data/{version:010d}")
        fs.delete(target, True)
        fs.mkdirs(target.getParent())
        fs.rename(self._file(attempt)[0], target)
        return [n[len("place=") :] for n in (s.getPath().getName() for s in fs.listStatus(target)) if n.startswith("place=")]

    def _mark(self, commit: Commit) -> None:
        """The marker in one rename; fails where another writer has been faster."""
        target, fs = self._file(f"commits/{commit.version:010d}.json")
        draft, _ = self._file(f"commits/_{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(commit._asdict()).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise ConcurrentCommit(f"version {commit.version} of {self.path}")

    def remove_old(self, keep: int = 2) -> list[int]:
        """Removes folders that none of the last ``keep`` commits name; the versions that are gone."""
        last = self.last()
        kept = {v for k in range(max(1, last.version - keep + 1), last.version + 1) for v in self.at(k).partitions.values()}
        gone = []
        for v in range(1, last.version + 1):
            folder, fs = self._file(f"data/{v:010d}")
            if v not in kept and fs.exists(folder):
                fs.delete(folder, True)
                gone.append(v)
        return gone


def replacing(keys: Sequence[str]) -> Merge:
    """A merge that puts the new row of a key in place of the old one."""

    def how(old: DataFrame, new: DataFrame) -> DataFrame:
        on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
        return old.alias("old").join(new.alias("new"), on, "left_anti").unionByName(new.select(*old.columns))

    return how


def upserting(keys: Sequence[str], mutable: Sequence[str], merged: Sequence[str] = (), order: Sequence[str] = ()) -> Merge:
    """A merge by ``upsert_notices``: new notices, changed and unchanged ones; notices that aren't among the changes stay as they are.

    Of several changes of a notice the last by ``order`` counts.
    """

    def how(old: DataFrame, new: DataFrame) -> DataFrame:
        names = [*keys, *mutable, *merged]
        if order:
            rest = [c for c in names if c not in keys]
            new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, "_x.*")
        touched = new.select(*keys)
        out = upsert_notices(old.join(touched, list(keys), "left_semi"), new.select(*names), keys, mutable, merged)
        return old.join(touched, list(keys), "left_anti").unionByName(out)

    return how


def stream_into(changes: DataFrame, table: KeyedTable, how: Merge, name: str, checkpoint: str) -> None:
    """Merges what has landed, batch by batch, each under its number, so that a replay after a crash changes nothing."""
    query = changes.writeStream.foreachBatch(lambda batch, k: table.merge(batch, how, name, k) and None)
    query.option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start().awaitTermination()


SNAPSHOT_SCHEMA = "status string, is_update boolean"


def notice_snapshot(spark: SparkSession, path: str, fields: str, keys: Sequence[str], buckets: int = 16) -> KeyedTable:
    """The snapshot of known notices: keys and fields as given, ``status`` and ``is_update``."""
    return KeyedTable(spark, path, StructType.fromDDL(f"{fields}, {SNAPSHOT_SCHEMA}"), keys, buckets=buckets)


ARTIFACT_SCHEMA = "notice_id string, checksum string, processor_version string, config_version string, status string"


def extraction_store(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    """Extractions, one per notice, file and configuration, partitioned by the configuration."""
    return KeyedTable(spark, path, StructType.fromDDL(ARTIFACT_SCHEMA), ["notice_id", "checksum", "processor_version"], ["config_version"], buckets)


def write_extractions(store: KeyedTable, results: DataFrame, stream: str = "", batch: int | None = None) -> bool:
    """Writes the results of a run; of those that came before under the same keys and configuration the new ones count, failures too.  Results that repeat count once, extracted ones first."""
    keys = [*store.keys, *store.by]
    once = results.groupBy(*keys).agg(F.min(F.struct((F.col("status") != "extracted").alias("_failed"), "status")).alias("_x")).select(*keys, F.col("_x.status").alias("status"))
    return store.merge(once, replacing(keys), stream, batch)


def bundle_store(spark: SparkSession, path: str, key: str = "notice_id", buckets: int = 64) -> KeyedTable:
    """One canonical JSON bundle per notice."""
    return KeyedTable(spark, path, StructType.fromDDL(f"{key} long, bundle string"), [key], buckets=buckets)


def write_bundles(store: KeyedTable, bundles: DataFrame, stream: str = "", batch: int | None = None) -> bool:
    """Puts the notices' bundles in place of older ones; other notices' stay, and the files of buckets without one of them aren't touched."""
    return store.merge(bundles, replacing(store.keys), stream, batch)
