"""Rolling state as keyed tables: what was seen, what waits, what was sent. Every function takes and returns tables, and an explicit as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import stored
from ..functions.gates import has_signal
from ..functions.text import text_of


def since(as_of: Column, hours: int) -> Column:
    return F.timestamp_micros(F.unix_micros(as_of) - F.lit(hours * 3_600_000_000))


def newest(rows: DataFrame, most: int, *first: Column) -> DataFrame:
    """The `most` rows that come first, then latest; a top-k, in which each task sends on no more than that."""
    return rows.orderBy(*first, F.desc("t"), F.desc(rows.columns[0])).limit(most)


def prune_seen(seen: DataFrame, as_of: Column, most: int = 12_000, max_bytes: int = 700_000, sent_hours: int = 48, other_hours: int = 24) -> DataFrame:
    """Expired rows go; then the oldest unsent ones, to keep within the number of rows and bytes (at the rows' mean size)."""
    live = seen.where(F.col("t") >= F.when(F.col("pushed"), since(as_of, sent_hours)).otherwise(since(as_of, other_hours)))
    size = live.agg(F.avg(F.octet_length(F.to_json(F.struct(*live.columns)))).alias("b")).first()["b"]  # one number
    allowed = min(most, max(1, int(max_bytes / size))) if size else most
    return newest(live, allowed, F.desc("pushed"))


def retry_limit(text: Column) -> Column:
    return F.when(has_signal(text), 10).otherwise(3)


def settle_pending(pending: DataFrame, seen: DataFrame, as_of: Column, hours: int = 48, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """What still waits, and the rows that gave up: they are seen from now on unless they were sent."""
    spent = F.col("retry") >= retry_limit(text_of("title"))
    given_up = pending.where(spent).join(seen.where("pushed").select("fp"), "fp", "left_anti").select("fp", "t", F.lit(False).alias("pushed"), F.concat(F.substring("title", 1, 60), F.lit("[溢出放弃]")).alias("title"))
    return newest(pending.where(~spent & (F.col("t") >= since(as_of, hours))), most), given_up


def compact_events(events: DataFrame, archive: DataFrame, as_of: Column, hours: int = 48, most: int = 300, archive_most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Sent events of the window, the newest `most`; what falls out joins the archive once for each signature key."""
    kept = newest(events.where(F.col("t") >= since(as_of, hours)), most)
    out = events.join(kept.select("event_id"), "event_id", "left_anti")
    fresh = out.join(archive.select("sig_key").distinct(), "sig_key", "left_anti")
    once = fresh.join(fresh.groupBy("sig_key").agg(F.min("event_id").alias("event_id")), ["sig_key", "event_id"], "left_semi")
    return kept, newest(archive.unionByName(once), archive_most)


def compact_candidates(rows: DataFrame, as_of: Column, hours: int = 48, most: int = 300) -> DataFrame:
    """Over the limit, sent rows go first."""
    return newest(rows.where(F.col("t") >= since(as_of, hours)), most, F.asc("pushed"))


def preferred(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first in order."""
    names = [n for n in rows.columns if n not in keys]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").select(*keys, *[n for n in names if n != "_local"])


def first_of(local: DataFrame, remote: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key from both tables: the first in order, in which _local is 1 for a local row."""
    return preferred(_both(local, remote), keys, order)


def _both(local: DataFrame, remote: DataFrame) -> DataFrame:
    return local.withColumn("_local", F.lit(1)).unionByName(remote.withColumn("_local", F.lit(0)))


def merge_seen(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Sent wins over unsent, then the remote row."""
    return first_of(local, remote, ["fp"], [F.desc("pushed"), F.asc("_local")])


def merge_pending(local: DataFrame, remote: DataFrame) -> DataFrame:
    """More retries win, then the local row."""
    return first_of(local, remote, ["fp"], [F.desc("retry"), F.desc("_local")])


def merge_events(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The remote row of a signature key wins."""
    return first_of(local, remote, ["sig_key"], [F.asc("_local"), F.asc("t")])


def reinjected(pending: DataFrame, seen: DataFrame, fetched: DataFrame) -> DataFrame:
    """Waiting rows with a payload that are neither seen nor fetched again; most retries first."""
    return pending.where(F.col("payload").isNotNull()).join(seen.select("fp"), "fp", "left_anti").join(fetched.select("fp"), "fp", "left_anti").orderBy(F.desc("retry"), "fp")


def unseen(news: DataFrame, seen: DataFrame) -> DataFrame:
    return news.join(seen.select("fp"), "fp", "left_anti")


def overflow(rows: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that found no place: those that wait for another round, and those that are given up."""
    again = rows.withColumn("retry", F.coalesce("retry", F.lit(0)) + 1)
    spent = F.col("retry") >= retry_limit(text_of("title"))
    payload = F.to_json(F.struct(F.substring("title", 1, 80).alias("title"), F.substring("content", 1, 120).alias("content"), F.substring("source", 1, 30).alias("source"), F.substring("published_at", 1, 30).alias("published_at")))
    waits = again.where(~spent).select("fp", as_of.alias("t"), "retry", F.substring("title", 1, 60).alias("title"), payload.alias("payload"))
    return waits, again.where(spent).select("fp", as_of.alias("t"), F.lit(False).alias("pushed"), F.concat(F.substring("title", 1, 60), F.lit("[溢出放弃]")).alias("title"))


def recent(log: DataFrame, as_of: Column, hours: int = 24, most: int = 100) -> DataFrame:
    return newest(log.where(F.col("t") >= since(as_of, hours)), most)


def spaced(log: DataFrame, key: str, hours: int = 24) -> DataFrame:
    """Of each key's times those that are at least `hours` after the last one taken: the greedy rate limit.

    Every time has a link to the first one at least `hours` after it, and what the first time of a key reaches over
    links is taken. Times stand in slots of `hours`: a link ends in the slot it points into, or at the first time of
    the next slot that has any, so only one slot of a key is ever sorted together. Links are followed 1, 2, 4 ...
    at a time; their number is at most that of a key's slots.
    """
    gap = hours * 3_600_000_000
    times = stored(log.where(F.col(key).isNotNull() & F.col("t").isNotNull()).select(F.col(key).alias("k"), F.unix_micros("t").alias("u")).distinct())
    slot = F.floor(F.col("u") / gap)
    firsts = times.groupBy("k", slot.alias("slot")).agg(F.min("u").alias("first"))
    order = Window.partitionBy("k").orderBy("slot")  # one row for each slot
    later = firsts.select("k", (F.col("slot") + 1).alias("slot"), F.lead("first").over(order).alias("one"), F.lead("first", 2).over(order).alias("two"))
    # in each slot, the times there (own) and those whose links point into it (asks), from the last to the first
    asks = times.select("k", "u", (F.col("u") + gap).alias("at"), F.lit(0).alias("own"))
    both = asks.unionByName(times.select("k", "u", F.col("u").alias("at"), F.lit(1).alias("own"))).withColumn("slot", F.floor(F.col("at") / gap))
    back = Window.partitionBy("k", "slot").orderBy(F.desc("at"), F.desc("own")).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("to", F.last(F.when(F.col("own") == 1, F.col("at")), ignorenulls=True).over(back)).where("own = 0")
    # a link points into the slot after that of its time; where that has no time for it, to the first of a later slot
    beyond = F.when(F.floor(F.col("one") / gap) > F.col("slot"), F.col("one")).otherwise(F.col("two"))
    links = stored(inside.join(later, ["k", "slot"]).select("k", "u", F.coalesce("to", beyond).alias("to")).where("to IS NOT NULL"))
    taken = stored(times.groupBy("k").agg(F.min("u").alias("u")))
    while True:
        more = stored(taken.join(links, ["k", "u"]).select("k", F.col("to").alias("u")))
        if more.isEmpty():
            return taken.select(F.col("k").alias(key), F.timestamp_micros("u").alias("t"))
        taken = stored(taken.unionByName(more).distinct())
        links = stored(links.join(links.select("k", F.col("u").alias("to"), F.col("to").alias("end")), ["k", "to"]).select("k", "u", F.col("end").alias("to")))
