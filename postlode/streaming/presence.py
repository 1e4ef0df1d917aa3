"""Keyed state of what a stream has shown, in Spark's state store, with timers for what it no longer shows.

A key's state is first_seen, last_seen, checks (rows seen) and status. A row makes its key ACTIVE; a key without a row for
longer than the gap becomes UNCERTAIN, by an event-time timer once the watermark has passed, or by the next row if that
comes first (the timer goes off once the gap is over, the row needs to be later than that). Nothing but the changed keys is written for a batch; the state itself can be read from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from postlode.shipping import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "first_seen long, last_seen long, checks long, status string"


class Presence(StatefulProcessor):
    """gap: microseconds. Emits (key, at, status) for each change of status."""

    def __init__(self, key: str, time: str, gap: int):
        self.key, self.time, self.gap = key, time, gap

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _STATE)

    def _changes(self, key: object, found: list[tuple[int, str]]) -> pd.DataFrame:
        at = pd.to_datetime(np.array([x for x, _ in found], np.int64), unit="us")
        return pd.DataFrame({self.key: pd.Series([key] * len(found)), "at": at, "status": [s for _, s in found]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        # Only the times of a key's rows in a batch are held, eight bytes each.
        times = np.sort(np.concatenate([x[self.time].to_numpy("datetime64[us]").astype(np.int64) for x in rows]))
        # Each call of the handle is a message to Spark and back, for each key: no more of them than it takes.
        first, last, checks, status = self.seen.get() or (int(times[0]), None, 0, "")
        timer = (last + self.gap) // 1000 if status == "ACTIVE" else None
        found: list[tuple[int, str]] = []
        # Neighbouring rows within the gap change nothing, so only the ends of such runs are looked at.
        ends = np.flatnonzero(np.diff(times) > self.gap)
        for a, b in zip(times[np.append(0, ends + 1)].tolist(), times[np.append(ends, len(times) - 1)].tolist(), strict=True):
            if last is None:
                found.append((a, "ACTIVE"))
            elif a - last > self.gap or status != "ACTIVE" and a > last:
                if status == "ACTIVE":
                    found.append((last + self.gap, "UNCERTAIN"))
                found.append((a, "ACTIVE"))
            last, status = max(b, last if last is not None else b), "ACTIVE" if last is None or b > last else status
        self.seen.update((min(first, int(times[0])), last, checks + len(times), status))
        due = (last + self.gap) // 1000 if status == "ACTIVE" else None
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if found:
            yield self._changes(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, last, checks, status = self.seen.get()
        if status == "ACTIVE":
            self.seen.update((first, last, checks, "UNCERTAIN"))
            yield self._changes(key[0], [(last + self.gap, "UNCERTAIN")])

    def close(self) -> None:
        pass


def presence(stream: DataFrame, key: str, time: str, gap: str = "1 day", late: str = "0 seconds") -> DataFrame:
    """key, at, status: the changes of status of each key of a stream (rows without a key or a time take no part).

    Rows later than late behind the newest are dropped by the watermark; among the others order does not matter but
    that a row older than its key's last one brings no change back.
    """
    micros = int(pd.Timedelta(gap) / pd.Timedelta(microseconds=1))
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, F.col(time).cast("timestamp").alias(time))
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, at timestamp, status string"
    return rows.withWatermark(time, late).groupBy(key).transformWithStateInPandas(Presence(key, time, micros), schema, "append", "eventTime")


def run(spark: SparkSession, landed: str, schema: str, folder: str, key: str, time: str, gap: str = "1 day", late: str = "0 seconds") -> None:
    """Takes in what has landed since the last run with the same folder. A batch repeated after a failure writes its changes again, once."""
    ship(spark)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    try:
        stream = presence(spark.readStream.schema(schema).parquet(landed), key, time, gap, late)
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def changes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/changes").drop("batch")


def state(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """key, first_seen, last_seen, checks, status as the state store has them after the last batch."""
    rows = spark.read.format("statestore").option("stateVarName", "seen").load(f"{folder}/checkpoint")
    times = [F.timestamp_micros(f"value.{c}").alias(c) for c in ("first_seen", "last_seen")]
    return rows.select(F.col(f"key.{key}").alias(key), *times, F.col("value.checks").alias("checks"), F.col("value.status").alias("status"))
