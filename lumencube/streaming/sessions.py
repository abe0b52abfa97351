"""Sessions as state machines: cursor, requirements and regions of each session in keyed state, ended by timers.

Commands (session, at in microseconds, id, kind, key, value) change a session's state: `cursor` sets the place of the
cursor, `require` the channel of an image, `region` sets a region and `remove` takes it away, leaving a tombstone so that
an older command that comes late doesn't bring it back. Of commands for one thing the latest (at, id) wins. A session
without commands for `idle` ends: its summary is emitted and all its state, tombstones included, is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SUMMARY = "session long, start long, stop long, commands long, cursor long, requirements long, regions long, removed long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionMachine(StatefulProcessor):
    """State of a session: about (start, last, commands), things (kind and key: at, id, value, whether it is there)."""

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "start long, last long, commands long")
        self.things = handle.getMapState("things", "kind string, key long", "at long, id long, value long, there boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        about = tuple(self.about.get()) if self.about.exists() else None
        before = {tuple(k): tuple(v) for k, v in self.things.iterator()} if about else {}
        things, out, timer = dict(before), [], about and about[1]
        commands = pd.concat(list(rows), ignore_index=True).sort_values(["at", "id"])  # of one session and batch
        for at, id_, kind, k, value in commands[["at", "id", "kind", "key", "value"]].itertuples(index=False):
            if about and at >= about[1] + self.idle:  # it ended before this command
                out.append(self.summary(key[0], about, things))
                about, things = None, {}
            start, last, n = about or (at, at, 0)
            about = (min(start, at), max(last, at), n + 1)
            thing = ("region", int(k)) if kind in ("region", "remove") else (kind, 0 if kind == "cursor" else int(k))
            if thing not in things or (at, id_) >= things[thing][:2]:
                things[thing] = (int(at), int(id_), int(value), kind != "remove")
        for thing in before.keys() - things.keys():
            self.things.removeKey(thing)
        for thing, state in things.items():
            if before.get(thing) != state:
                self.things.updateValue(thing, state)
        self.about.update(tuple(int(v) for v in about))
        if timer != about[1]:
            if timer is not None:
                self.handle.deleteTimer(self.due(timer))
            self.handle.registerTimer(self.due(about[1]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SUMMARY.split(", ")]).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        about = tuple(self.about.get())
        out = [self.summary(key[0], about, {tuple(k): tuple(v) for k, v in self.things.iterator()})]
        self.about.clear()
        self.things.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SUMMARY.split(", ")]).astype("int64")

    def due(self, last: int) -> int:
        """Milliseconds, as timers have them, of the first one in which a session is over."""
        return -(-(last + self.idle) // 1000)

    def summary(self, session, about: tuple, things: dict) -> tuple:
        of = lambda kind: [s for (k, _), s in things.items() if k == kind]
        cursor = of("cursor")
        there = sum(s[3] for s in of("region"))
        return int(session), int(about[0]), int(about[1]) + self.idle, int(about[2]), cursor[0][2] if cursor else -1, len(of("require")), there, len(of("region")) - there

    def close(self) -> None:
        pass


def summaries(commands: DataFrame, idle_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """SUMMARY rows of the sessions that have ended: those whose timer the watermark has passed, or that a later command shows.

    commands: a stream of session, ts (timestamp), id, kind, key, value. Rows without a session or time are left out. The
    query must be started inside keyed_state().
    """
    c = commands.where("session IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    number = lambda name, other: F.coalesce(F.col(name).cast("long"), F.lit(other)).alias(name)
    c = c.select("ts", F.col("session").cast("long").alias("session"), F.unix_micros("ts").alias("at"), number("id", 0), "kind", number("key", 0), number("value", -1))
    return c.groupBy("session").transformWithStateInPandas(SessionMachine(idle_minutes * 60_000_000), SUMMARY, "Append", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside of it keep their state in the store that maps and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
