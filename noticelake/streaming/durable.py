"""State machines whose states lie in a table: a stream that never forgets a key.

``state.stream`` holds states in memory and drops those of keys that were
silent for long.  Here a batch's keys are looked up in a keyed table, their
events are folded on from the states that it holds, and the new states
are merged back under the batch's number.  A key that comes again after years
goes on where it was, no event is too late, and a batch that is run again after a
crash gives the same rows and changes nothing that was committed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noticelake.sources.sinks import KeyedTable, replacing
from noticelake.streaming.state import Machine


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _held(machine: Machine) -> str:
    """The machine's state under names that clash with no column of an event."""
    return ", ".join(f"held_{f}" for f in machine.state.split(", "))


def state_store(spark: SparkSession, path: str, keys: str, machine: Machine, buckets: int = 16) -> KeyedTable:
    """The table of a machine's states; ``keys`` are the key columns with their types."""
    return KeyedTable(spark, path, StructType.fromDDL(f"{keys}, {_held(machine)}"), _names(keys), buckets=buckets)


def fold_from(events: DataFrame, states: DataFrame, keys: Sequence[str], machine: Machine) -> DataFrame:
    """``fold`` from given states: the rows (keys, event_id, output) and, with ``is_state``, the last state of each key that had an event.

    A key's state goes before its events in one sort; keys without a state begin at the start.
    """
    keys, out, held = list(keys), _names(machine.output), _names(_held(machine))
    timed = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    # only the states of keys that have events
    before = states.join(events.select(*keys).distinct(), keys, "left_semi").select(*keys, *held, F.lit(-1).alias("turn"))
    rows = before.unionByName(timed.withColumn("turn", F.lit(0)), allowMissingColumns=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, moved = None, machine.start, False

        def end() -> list[tuple]:
            return [(*last, None, *[None] * len(out), True, *state)] if moved else []

        for frame in frames:
            done: list[tuple] = []
            for e in frame.itertuples(index=False):
                key = tuple(getattr(e, k) for k in keys)
                if key != last:
                    done += end()
                    last, state, moved = key, machine.start, False
                if e.turn < 0:
                    state = tuple(getattr(e, h) for h in held)
                    continue
                state, got = machine.step(state, e)
                moved = True
                done.append((*key, int(e.event_id), *got, False, *[None] * len(held)))
            yield pd.DataFrame(done, columns=columns)
        yield pd.DataFrame(end(), columns=columns)

    columns = [*keys, "event_id", *out, "is_state", *held]
    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    sorted_ = rows.repartition(*keys).sortWithinPartitions(*keys, "turn", "us", "event_id")
    return sorted_.mapInPandas(lambda frames: (f.astype({"event_id": "Int64"}) for f in run(_whole(frames, held))), f"{kinds}, event_id long, {machine.output}, is_state boolean, {_held(machine)}")


def _whole(frames: Iterator[pd.DataFrame], held: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Numbers of states and events as they were: missing ones of the union made whole columns floats."""
    for frame in frames:
        for c in (*held, "us", "event_id"):
            if pd.api.types.is_float_dtype(frame[c]):
                frame[c] = frame[c].astype("Int64")
        yield frame.astype(object)


def advance(batch: DataFrame, number: int, keys: Sequence[str], machine: Machine, store: KeyedTable, path: str, name: str) -> bool:
    """One batch: its rows go to ``path/batch=<number>``, its states to the store; False for a batch that was committed before.

    Rows are written first, over what a crashed attempt left; the states' marker
    makes both count, so reading ``path`` for batches up to ``store.last()`` gives each event once.
    """
    if store.last().batches.get(name, -1) >= number:
        return False
    both, target = fold_from(batch, store.read(), keys, machine), f"{path}/batch={number}"
    both.write.mode("overwrite").parquet(target)
    written = batch.sparkSession.read.schema(both.schema).parquet(target)
    states = written.where("is_state").select(*store.schema.names)
    return store.merge(states, replacing(store.keys), name, number)


def durable_stream(events: DataFrame, keys: Sequence[str], machine: Machine, store: KeyedTable, path: str, checkpoint: str, name: str) -> None:
    """Folds what has landed, batch by batch, from the states of the store and into it; one pass over what is new."""
    query = events.writeStream.foreachBatch(lambda batch, k: advance(batch, k, keys, machine, store, path, name) and None)
    query.option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start().awaitTermination()


def outputs(spark: SparkSession, path: str, keys: Sequence[str], machine: Machine) -> DataFrame:
    """The rows that the stream gave: (keys, event_id, output)."""
    return spark.read.parquet(path).where("NOT is_state").select(*keys, "event_id", *_names(machine.output))
