"""Streams: presence with timers and restarts, and alerts sent once."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from postlode.operators import state
from postlode.plans.catalog import QUERIES
from postlode.staging import new_folder
from postlode.streaming import presence, streams

DAY = datetime.datetime(2024, 1, 1)


def at(days):
    return DAY + datetime.timedelta(days=days)


def test_presence_over_restarts(spark):
    folder = new_folder(spark, "test")
    parts = [
        [("a", at(0)), ("a", at(0.5)), ("b", at(0)), (None, at(0)), ("c", None)],
        [("a", at(1)), ("b", at(3)), ("d", at(3))],  # b is lost at day 1 and back at 3
        [("d", at(9))],  # all others are lost: a by a timer, b too
        [("a", at(9.5)), ("a", at(9.5)), ("a", at(8))],  # back; the late row is dropped
    ]
    for rows in parts:
        spark.createDataFrame(rows, "k string, t timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/landed")
        presence.run(spark, f"{folder}/landed", "k string, t timestamp", folder, "k", "t")
    found = sorted((r["k"], (r["at"] - DAY).total_seconds() / 86_400, r["status"]) for r in presence.changes(spark, folder).collect())
    assert found == [
        ("a", 0, "ACTIVE"),
        ("a", 2, "UNCERTAIN"),
        ("a", 9.5, "ACTIVE"),
        ("b", 0, "ACTIVE"),
        ("b", 1, "UNCERTAIN"),
        ("b", 3, "ACTIVE"),
        ("b", 4, "UNCERTAIN"),
        ("d", 3, "ACTIVE"),
        ("d", 4, "UNCERTAIN"),
        ("d", 9, "ACTIVE"),
    ]
    state = {r["k"]: (r["first_seen"], r["last_seen"], r["checks"], r["status"]) for r in presence.state(spark, folder, "k").collect()}
    assert state == {"a": (at(0), at(9.5), 5, "ACTIVE"), "b": (at(0), at(3), 2, "UNCERTAIN"), "d": (at(3), at(9), 2, "ACTIVE")}


def test_changes_of_events_without_a_time(spark, tmp_path):
    rows = [(1, at(0)), (1, at(3)), (2, None), (2, None), (3, at(2.5)), (3, None), (3, None), (4, at(3)), (4, None), (None, at(1)), (None, None)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = [(r["user_id"], r["at"] and (r["at"] / 1e6 - DAY.replace(tzinfo=datetime.UTC).timestamp()) / 86_400, r["status"]) for r in QUERIES["stream_presence_changes"](spark, str(tmp_path)).collect()]
    timed = [(1, 0, "ACTIVE"), (1, 1, "UNCERTAIN"), (1, 3, "ACTIVE"), (3, 2.5, "ACTIVE"), (4, 3, "ACTIVE")]
    assert sorted(found, key=str) == sorted([*timed, (2, None, "ACTIVE"), (2, None, "ACTIVE"), (3, None, "ACTIVE")], key=str)


class Handle:
    """Counts the messages of one key, in place of Spark's state store."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def _called(self, out=None):
        self.calls += 1
        return out

    def exists(self):
        return self._called(self.value is not None)

    def get(self):
        return self._called(self.value)

    def update(self, value):
        self.value = self._called(value)

    def listTimers(self):  # noqa: N802
        return self._called(iter(self.timers))

    def deleteTimer(self, at):  # noqa: N802
        self._called(self.timers.remove(at))

    def registerTimer(self, at):  # noqa: N802
        self._called(self.timers.add(at))


def test_messages_of_a_key(spark):
    """A key has one timer, that of its last row, and needs few messages to the state store."""
    handle, gap = Handle(), 86_400_000_000
    p = presence.Presence("k", "t", gap)
    p.init(handle)
    for days, most in ((0, 3), (0.5, 4), (0.2, 2), (5, 4)):
        handle.calls = 0
        list(p.handleInputRows(("a",), iter([pd.DataFrame({"t": [at(days)]})]), None))
        assert handle.calls <= most and handle.timers == {(handle.value[1] + gap) // 1000}
    assert handle.value[2:] == (4, "ACTIVE")


def test_alerts_are_sent_once(spark):
    folder = new_folder(spark, "test")
    for rows in ([("u1", 90), ("u1", 95), ("u2", 10)], [("u1", 99), ("u3", 80), ("", 80)], [("u3", 80), ("", 85)]):
        spark.createDataFrame(rows, "url string, score int").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("url string, score int").parquet(f"{folder}/in")
        streams.alerts(stream, F.col("score") >= 75, "url", f"{folder}/sent", f"{folder}/checkpoint").awaitTermination()
    sent = sorted(r["url"] for r in spark.read.parquet(f"{folder}/sent").collect())
    assert sent == ["", "", "u1", "u3"]


def test_stale_leases_are_recovered(spark):
    rows = [(1, at(0), None, None), (2, at(1), None, "old"), (3, at(0), at(0.1), "kept"), (4, None, None, None)]
    queue = spark.createDataFrame(rows, "id long, started_at timestamp, processed_at timestamp, error string")
    found = {r["id"]: (r["started_at"], r["error"]) for r in state.recovered(queue, F.lit(at(1)) + F.expr("INTERVAL 30 MINUTE")).collect()}
    assert found == {1: (None, state.RECOVERED), 2: (at(1), "old"), 3: (at(0), "kept"), 4: (None, None)}
