"""State for each key of a stream, in event time, that is gone when it has nothing more to say.

Rows wait until the watermark has passed them and are then taken in order of their times, whatever order they came
in; so a stream gives what the batch form gives. A key holds the rows that still wait, and what its rule remembers.
When that no longer matters (nothing was taken within the hours, no streak is running) a timer clears it, and a key
that comes back begins as a new one, with the same result.

Rows later than the watermark are left out. Rows of one key at one time count as one: the one with the largest count.
What the watermark has not passed when a stream stops waits in its checkpoint for the next run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000_000


class InOrder(StatefulProcessor):
    """Takes each key's rows (u: micros, count, alive) in order of time, once the watermark has passed them.

    A rule says by `turn` what a row gives (or None) and by `lasts_until` how long, in micros, its memory
    matters: None is for ever, 0 is no longer.
    """

    memory = "last long, streak long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "u long, count long, alive boolean")
        self.known = handle.getValueState("known", self.memory)

    def turn(self, known: tuple | None, u: int, count: int, alive: bool) -> tuple[tuple | None, tuple | None]:
        raise NotImplementedError

    def lasts_until(self, known: tuple | None) -> int | None:
        raise NotImplementedError

    def columns(self) -> list[str]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs() * 1000
        new = [r for frame in rows for r in zip(frame["u"].tolist(), frame["count"].tolist(), frame["alive"].tolist(), strict=True) if r[0] > late]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(r[0] for r in new) // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed is taken at the first timer: no row that is still to come is earlier
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due: dict[int, tuple[int, bool]] = {}
        for u, count, alive in held:
            if u <= now and (u not in due or due[u][0] < count):
                due[u] = (count, alive)
        known = tuple(self.known.get()) if self.known.exists() else None
        before, out = known, []
        for u in sorted(due):
            known, given = self.turn(known, u, *due[u])
            if given is not None:
                out.append((*key, *given))
        if due:
            left = [r for r in held if r[0] > now]
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(-(-min(r[0] for r in left) // 1000))
            else:
                self.waiting.clear()
        until = self.lasts_until(known)
        if until is not None and until <= now:
            if before is not None:
                self.known.clear()
        else:
            if due:
                self.known.update(known)
            if until is not None:
                self.handle.registerTimer(-(-until // 1000))
        if out:
            yield pd.DataFrame(out, columns=self.columns())

    def close(self) -> None:
        pass


class Spaced(InOrder):
    """Rows that come `gap` micros or more after the last one taken."""

    def __init__(self, gap: int):
        self.gap = gap

    def turn(self, known, u, count, alive):
        if known is None or u - known[0] >= self.gap:
            return (u, 0), (u,)
        return known, None

    def lasts_until(self, known):
        return known[0] + self.gap if known else 0

    def columns(self):
        return ["key", "u"]


class Health(InOrder):
    """Runs of empty rounds, with an alert from `least` on, unless every source was empty or the last alert is less than `gap` micros old."""

    def __init__(self, least: int, gap: int):
        self.least, self.gap = least, gap

    def turn(self, known, u, count, alive):
        last, streak = known or (None, 0)
        streak = 0 if count > 0 else streak + 1
        alert = alive and streak >= self.least and (last is None or u - last >= self.gap)
        return (u if alert else last, streak), (u, count, streak, alert)

    def lasts_until(self, known):
        last, streak = known or (None, 0)
        return None if streak else 0 if last is None else last + self.gap

    def columns(self):
        return ["key", "u", "count", "streak", "alert"]


def with_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers lives in RocksDB; set for the session where it has another store."""
    if spark.conf.get(_PROVIDER, "") != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)


def _keyed(rows: DataFrame, key: str, at: str, count: Column, alive: Column, late: str, rule: InOrder, schema: str) -> DataFrame:
    with_rocksdb(rows.sparkSession)
    marked = rows.where(F.col(at).isNotNull() & F.col(key).isNotNull()).withWatermark(at, late)
    narrow = marked.select(F.col(key).alias("key"), F.col(at).alias("at"), F.unix_micros(at).alias("u"), count.cast("long").alias("count"), alive.alias("alive"))
    kind = rows.schema[key].dataType.simpleString()
    return narrow.groupBy("key").transformWithStateInPandas(rule, f"key {kind}, {schema}", "Append", "EventTime")


def spaced(rows: DataFrame, key: str, at: str = "t", hours: int = 24, late: str = "1 hour") -> DataFrame:
    """key and time of each key's rows that come at least `hours` after the last one taken; a stream. Equals `state.spaced`."""
    out = _keyed(rows, key, at, F.lit(1), F.lit(True), late, Spaced(hours * HOUR), "u long")
    return out.select(F.col("key").alias(key), F.timestamp_micros("u").alias(at))


def source_health(rounds: DataFrame, source: str = "source", at: str = "t", count: str = "count", alive: str = "alive", least: int = 6, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """source, time, count, streak and alert of each source's rounds; a stream. `alive`: whether any source of the round had rows. Equals `health.history`."""
    out = _keyed(rounds, source, at, F.coalesce(count, F.lit(0)), F.coalesce(alive, F.lit(False)), late, Health(least, hours * HOUR), "u long, count long, streak long, alert boolean")
    return out.select(F.col("key").alias(source), F.timestamp_micros("u").alias(at), F.col("count").alias(count), "streak", "alert")
