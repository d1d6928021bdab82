"""Rounds that remember: what was seen, what waits and what was sent lives in tables between batches.

The tables are Parquet under a folder that driver and executors share, one folder for each batch, which appears
by one rename when all tables of the batch are written. A batch that was committed is not run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import stored
from ..functions.judge import rule_judge
from ..functions.signatures import fingerprint, signature_key, titles_alike
from ..operators import dedup, events, history, ranking, state
from .rounds import gated, representatives

SIGNATURE = "struct<stocks:array<string>,entities:array<string>,events:array<string>,numbers:array<string>,sectors:array<string>,scope:string,title_norm:string>"
_EVENT = f"event_id long, t timestamp, dir string, title string, source string, sig {SIGNATURE}, exempt boolean, chain string, sig_key string"
#: The tables that a round leaves to the next one: what was seen and what waits; what was sent in 48 hours, and before;
#: what was judged, with its gate; and which watched announcements went out directly.
TABLES = {
    "seen": "fp string, t timestamp, pushed boolean, title string",
    "pending": "fp string, t timestamp, retry int, title string, payload string",
    "sent": _EVENT,
    "archive": _EVENT,
    "candidates": "day string, sig_key string, dir string, t timestamp, pushed boolean, score double, gate string, source string, title string",
    "watch": "key string, t timestamp",
}
OUTCOME = "seq long, fp string, title string, direction string, score double, gate string"
PAYLOAD = "struct<title:string,content:string,source:string,published_at:string>"


class StateStore:
    """Tables by batch id under a folder that one writer owns; all tables of a batch appear at once."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, str] | None = None):
        self.spark, self.folder = spark, folder
        self.tables = tables if tables is not None else TABLES | {"outcome": OUTCOME}
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []

    def batches(self) -> list[int]:
        """Committed batch ids, in order."""
        return sorted(int(n) for n in self._names() if n.isdigit())

    def read(self, name: str, batch: int | None = None) -> DataFrame:
        """A table as the batch left it (the last one, if not said); empty where there is none."""
        schema = self.tables[name]
        done = self.batches()
        at = batch if batch is not None else (done[-1] if done else None)
        if at is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{at:020d}/{name}")

    def publish(self, draft: str, batch: int) -> bool:
        """Let a draft's tables appear as the batch, by one rename; false where the batch is there."""
        return not self._fs.exists(self._path(f"{batch:020d}")) and self._fs.rename(self._path(draft), self._path(f"{batch:020d}"))

    def commit(self, batch: int, tables: dict[str, DataFrame]) -> None:
        """Write all tables and let them appear at once; what another run of the batch has committed stays. Drafts of runs that broke off are deleted."""
        left = [n for n in self._names() if n.startswith("draft-")]
        draft = f"draft-{uuid.uuid4().hex}"
        for name, df in tables.items():
            # in the columns and types that are read again
            cells = [F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(self.tables[name]).fields]
            df.select(*cells).write.parquet(f"{self.folder}/{draft}/{name}")
        for name in left if self.publish(draft, batch) else [*left, draft]:
            self._fs.delete(self._path(name), True)

    def forget(self, keep: int = 3) -> None:
        """Delete all batches but the last `keep`. A reader has as many batches of time to finish."""
        for batch in self.batches()[:-keep]:
            self._fs.delete(self._path(f"{batch:020d}"), True)


def merged(local: StateStore, remote: StateStore) -> dict[str, DataFrame]:
    """The tables of two replicas as one: a sent fingerprint wins, more retries win, an event or candidate counts once for its key (sent ones and then the remote one win), watched keys are united. What is seen does not wait."""
    both = {n: (local.read(n), remote.read(n)) for n in TABLES}
    seen = stored(state.merge_seen(*both["seen"]))
    once = lambda rows, keys, order: state.first_of(rows[0], rows[1], keys, order)
    return {
        "seen": seen,
        "pending": state.merge_pending(*both["pending"]).join(seen.select("fp"), "fp", "left_anti"),
        "sent": state.merge_events(*both["sent"]),
        "archive": state.merge_events(*both["archive"]),
        "candidates": once(both["candidates"], ["day", "sig_key"], [F.desc("pushed"), F.asc("_local")]),
        "watch": both["watch"][0].unionByName(both["watch"][1]).distinct(),
        "outcome": local.read("outcome"),
    }


def marked(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """candidates with those judged now, one for each day and signature key; one that was sent, now or before, is marked as sent."""
    both = candidates.withColumn("_new", F.lit(0)).unionByName(judged.withColumn("_new", F.lit(1)))
    sent = both.where("pushed").select("day", "sig_key", F.lit(True).alias("_sent")).distinct()
    first = state.preferred(both, ["day", "sig_key"], [F.asc("_new"), F.asc("t"), F.desc("pushed"), F.asc("title")]).drop("_new")
    return first.join(sent, ["day", "sig_key"], "left").withColumn("pushed", F.col("pushed") | F.coalesce("_sent", F.lit(False))).drop("_sent")


def waiting_rows(back: DataFrame, news: DataFrame) -> DataFrame:
    """Rows that waited, in the shape of news: from their payload, before all fetched rows, most retries first. There are no more than the pending table holds."""
    order = Window.orderBy(F.desc("retry"), "fp")
    read = back.withColumn("p", F.from_json("payload", PAYLOAD)).withColumn("seq", (F.row_number().over(order) - 2**40).cast("long"))
    known = {"seq": F.col("seq"), "fp": F.col("fp"), "retry": F.col("retry"), **{c: F.col(f"p.{c}") for c in ("title", "content", "source", "published_at")}}
    empty = {"category": F.lit("news"), "name": F.lit(""), "impact_direction": F.lit("neutral")}
    cells = [known.get(f.name, empty.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in news.schema.fields]
    return read.select(*cells)


def direct_rows(rows: DataFrame, watch: DataFrame, as_of: Column) -> DataFrame:
    """rows with direct: the first row of each watched announcement's key (`watch_key`) that did not go out in 24 hours."""
    if "watch_key" not in rows.columns:
        return rows.withColumn("direct", F.lit(False))
    free = rows.where(F.coalesce("watch_key", F.lit("")) != "").join(watch.where(F.col("t") >= state.since(as_of, 24)).select(F.col("key").alias("watch_key")).distinct(), "watch_key", "left_anti")
    first = stored(free.groupBy("watch_key").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("direct")))
    return rows.join(first, "seq", "left").withColumn("direct", F.coalesce("direct", F.lit(False)))


def stateful_round(news: DataFrame, store: StateStore, as_of: Column, batch: int, watched: tuple[str, ...] = (), judge: Callable[[DataFrame], DataFrame] = rule_judge, most: int = 40, daily_limit: int = 100) -> DataFrame:
    """One round over news and what waits; returns one row for each event with its gate, and commits the state.

    Seen rows are left out, waiting ones come back in front, rows beyond the `most` candidates wait (or are given
    up after their retries). Events that the log or the round itself tells are not sent again, a hard event passes its
    topic's limit once for each chain, and the day's limit holds; all of these see what the round has sent before.
    Watched announcements (`watch_key`) are candidates at once and pass all gates but the same event, once a day for
    each key. Judged events are kept with their gate; what leaves the log goes to the archive. A committed batch is
    read, not run again; one that was committed and forgotten is an error.
    """
    done = store.batches()
    if batch in done:
        return store.read("outcome", batch)
    if done and batch < done[-1]:
        raise ValueError(f"batch {batch} comes after batch {done[-1]}")
    seen, pending, sent, archive, candidates, watch = (store.read(n) for n in ("seen", "pending", "sent", "archive", "candidates", "watch"))
    keyed = news.withColumn("fp", fingerprint(*map(F.col, ("published_at", "title", "content", "name", "affected_stocks")))).withColumn("retry", F.lit(0))
    fresh = state.unseen(dedup.by_title(dedup.by_url(keyed)), seen)
    rows = fresh.unionByName(waiting_rows(state.reinjected(pending, seen, keyed), keyed)).dropDuplicates(["fp"])
    rows = stored(direct_rows(stored(rows), watch, as_of))
    passed = stored(ranking.passing(rows.where("NOT direct"), watched))
    ahead = ranking.passing(rows.where("direct"), watched, least_score=-1.0).withColumn("place", F.col("seq") - 2**50)
    chosen = stored(ranking.first_candidates(passed, most).unionByName(ahead))
    waits, given_up = state.overflow(passed.join(chosen.select("seq"), "seq", "left_anti"), as_of)
    signed = events.signed(judge(chosen), F.coalesce("entities", F.array().cast("array<string>")), F.col("affected_sectors"), F.col("scope"))
    told = gated(stored(representatives(signed, order="place")), sent, as_of, watched, daily_limit=daily_limit, order="place")
    watch_key = F.col("watch_key") if "watch_key" in news.columns else F.lit("")
    outcome = stored(told.select("seq", "fp", "title", "direction", "score", "source", "gate", "sig", "exempt", "chain", "direct", watch_key.alias("watch_key"), signature_key(F.col("sig")).alias("sig_key")))

    out = outcome.where("gate = 'sent'")
    head = F.substring("title", 1, 60).alias("title")
    more = out.select(F.xxhash64("fp", F.lit(batch)).alias("event_id"), as_of.alias("t"), F.col("direction").alias("dir"), head, F.substring("source", 1, 30).alias("source"), F.col("sig").cast(SIGNATURE), "exempt", "chain", "sig_key")
    kept, old = map(stored, state.compact_events(stored(sent.unionByName(more)), archive, as_of))
    judged = outcome.where("gate <> 'not judged'").select(F.date_format(as_of, "yyyy-MM-dd").alias("day"), "sig_key", F.col("direction").alias("dir"), as_of.alias("t"), (F.col("gate") == "sent").alias("pushed"), "score", "gate", F.substring("source", 1, 30).alias("source"), head)
    gone_out = out.where("direct").select(F.col("watch_key").alias("key"), as_of.alias("t"))
    again = stored(waits)
    done_rows = rows.join(again.select("fp"), "fp", "left_anti").join(out.select("fp", F.lit(True).alias("pushed")), "fp", "left")
    done_rows = done_rows.select("fp", as_of.alias("t"), F.coalesce("pushed", F.lit(False)).alias("pushed"), head)
    now = stored(state.merge_seen(state.merge_seen(seen, done_rows), given_up))
    left = state.merge_pending(again, pending).join(now.select("fp"), "fp", "left_anti")
    titles = F.broadcast(kept.select(F.col("sig.title_norm").alias("_n")).distinct())  # of 300 events at most
    left = left.join(titles, titles_alike(F.col("title"), F.col("_n")), "left_anti")
    waiting, dropped = state.settle_pending(left, now, as_of)
    tables = {
        "seen": state.prune_seen(state.merge_seen(now, dropped), as_of), "pending": waiting, "sent": kept, "archive": old, "candidates": state.compact_candidates(marked(candidates, judged), as_of),
        "watch": watch.where(F.col("t") >= state.since(as_of, 24)).unionByName(gone_out), "outcome": outcome,
    }
    store.commit(batch, tables)
    return store.read("outcome", batch)


def stream(feed: DataFrame, store: StateStore, checkpoint: str, watched: tuple[str, ...] = (), judge: Callable[[DataFrame], DataFrame] = rule_judge, keep: int = 3, **trigger):
    """stateful_round for each micro-batch, by its id; as_of is the batch's latest time. A batch that ran before is not run twice; all but the last `keep` batches are deleted."""

    def one(batch: DataFrame, number: int) -> None:
        rows = stored(batch)
        latest = rows.agg(F.max("published_at")).first()[0]
        if latest is not None:
            stateful_round(rows, store, F.lit(latest).cast("timestamp"), number, watched, judge)
            store.forget(keep)

    return feed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: Today's bars before they are final.
BARS = {"bars": "code long, date date, at timestamp, close double, high double, low double, amount double, amount_yuan double"}


def stream_bars(quotes: DataFrame, store: StateStore, checkpoint: str, late: str = "2 hours", keep: int = 3, **trigger):
    """Each code's provisional bar of a day in a store (BARS), replaced as later quotes come; quotes later than the watermark are left out. A batch that ran before is not run twice."""

    def one(batch: DataFrame, number: int) -> None:
        if number not in store.batches():
            store.commit(number, {"bars": history.newer_bars(store.read("bars"), batch)})
            store.forget(keep)

    bars = history.intraday_bars(quotes, late)
    return bars.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
