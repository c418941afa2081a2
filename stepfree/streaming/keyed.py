"""Streams with state for each key: progress along a planned route, and answers that are kept for a while.

Rows may come late and in any order. Each key holds its rows in a list of chunks until the watermark has passed them; a timer, one for the
earliest, then takes them in the order of their time and number through the key's value, as a replay of all rows in order would. Rows without
a time, and those that come after the watermark has passed theirs, are left out. So what is delivered doesn't depend on how rows are dealt to batches, and a restart with the same folder goes on
from the state that lies there.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Metres off the route that call for a new one; seconds that an answer and a failure are kept.
OFF_ROUTE_M = 30.0
ANSWER_S, FAILURE_S = 20.0, 10.0
CHUNK = 4096  # rows in an entry of a key's list, which is read and written as a whole
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@dataclass(frozen=True)
class Fold:
    """How a key's rows are taken in order. ``step(state, row)`` gives the new state and what is delivered for the row; both are
    tuples, and the first state is ``start``. Rows are (ms, number, *inputs)."""

    start: tuple
    step: Callable[[tuple, tuple], tuple[tuple, tuple]]
    inputs: str
    state: str
    output: str


def _progress(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    along, off, reroutes = state
    _, _, at, apart = row
    now = apart is not None and apart > OFF_ROUTE_M
    if not now and at is not None:
        along = max(along, at)  # walking back, or a worse fix, does not undo progress
    reroute = now and not off
    reroutes += reroute
    return (along, now, reroutes), (along, now, reroute, reroutes)


#: Along a planned route: how far a user has come, whether they are off it, and the moments that call for a new route.
PROGRESS = Fold((0.0, False, 0), _progress, "along_m double, off_m double", "along double, off boolean, reroutes bigint", "progress_m double, off boolean, reroute boolean, reroutes bigint")


def _kept(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    until, body, failed = state
    ms, _, answer, error = row
    if ms < until:
        return state, (True, body, failed)
    failed = bool(error)
    keep = FAILURE_S if failed else ANSWER_S
    state = (ms + int(keep * 1000), None if failed else answer, failed)
    return state, (False, *state[1:])


#: Questions to a service that answers or fails: an answer serves those who ask in the next ANSWER_S seconds, a failure for FAILURE_S.
ANSWERS = Fold((0, None, False), _kept, "answer string, error boolean", "until bigint, body string, failed boolean", "kept boolean, body string, failed boolean")


def replay(rows: list[tuple], fold: Fold) -> list[tuple]:
    """What is delivered for all rows of a key, in order: (ms, number, *output)."""
    state, out = fold.start, []
    for row in sorted(rows, key=lambda r: r[:2]):
        state, got = fold.step(state, row)
        out.append((*row[:2], *got))
    return out


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


class _Keyed(StatefulProcessor):
    def __init__(self, fold: Fold, key: str):
        self.fold, self.key = fold, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.fold.state)
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} array<{kind}>" for n, kind in (part.split() for part in f"ms bigint, number bigint, {self.fold.inputs}".split(", "))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, columns, first = timerValues.getCurrentWatermarkInMs(), ["ms", "number", *_names(self.fold.inputs)], None
        for batch in rows:
            own = batch.loc[batch["ms"] > passed, columns]
            for i in range(0, len(own), CHUNK):
                part = own.iloc[i : i + CHUNK]
                self.waiting.appendList([tuple(part[c].astype(object).where(part[c].notna(), None).tolist() for c in columns)])
            if len(own):
                first = int(own["ms"].min()) if first is None else min(first, int(own["ms"].min()))
        if first is not None and all(first < ms for ms in self.handle.listTimers()):
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the first timer takes all rows that the watermark has passed, so any others find none of them
        at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = sorted((r for chunk in self.waiting.get() for r in zip(*chunk, strict=True)), key=lambda r: r[:2])
        n = bisect_right(rows, at, key=lambda r: r[0])
        due, left = rows[:n], rows[n:]
        if left:
            if due:
                self.waiting.put([tuple(map(list, zip(*left[i : i + CHUNK], strict=True))) for i in range(0, len(left), CHUNK)])
            self.handle.registerTimer(left[0][0])  # the one that has expired is listed until this call ends
        elif due:
            self.waiting.clear()
        if not due:
            return iter(())
        state, out = tuple(self.value.get()) if self.value.exists() else self.fold.start, []
        for row in due:
            state, got = self.fold.step(state, row)
            out.append((key[0], *row[:2], *got))
        self.value.update(state)
        return iter([pd.DataFrame(out, columns=[self.key, "ms", "number", *_names(self.fold.output)])])

    def close(self) -> None:
        pass


def delivered(stream: DataFrame, key: str, ts: str, number: str, fold: Fold, late: str = "10 minutes") -> DataFrame:
    """The stream (key, ms, number, *output) of what the fold delivers; ts is a timestamp, number tells rows of one time apart."""
    # the worker that sets the state up runs beside the driver, where files sent to executors are not on the path
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    kind = stream.schema[key].dataType.simpleString()
    at = F.col(ts).cast("timestamp")
    rows = stream.withColumn("at", at).withWatermark("at", late)
    rows = rows.select(F.col(key).alias("key"), "at", F.unix_millis("at").alias("ms"), F.col(number).cast("bigint").alias("number"), *_names(fold.inputs))
    out = rows.groupBy("key").transformWithStateInPandas(_Keyed(fold, "key"), f"key {kind}, ms bigint, number bigint, {fold.output}", "Append", "EventTime")
    return out.withColumnRenamed("key", key)


def table(stream: DataFrame, folder: str) -> DataFrame:
    """Runs the stream to the end of its input; the table of all that it has delivered, in the folder, over all runs."""
    spark, path, schema = stream.sparkSession, f"{folder}/delivered", stream.schema
    old = _with(spark, _STORE)
    try:
        # each batch has a folder of its own, so one that is run again leaves nothing twice
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        _with(spark, old)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def _with(spark: SparkSession, settings: dict) -> dict:
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return old
