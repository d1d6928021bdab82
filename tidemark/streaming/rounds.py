"""One round over a batch of news, and the same round as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..common import stored
from ..functions import gates
from ..functions.judge import rule_judge
from ..functions.signatures import chain_key, fingerprint
from ..functions.text import text_of
from ..operators import dedup, events, ranking, state
from .folds import admitted, best_of_groups

GATES = "seq long, title string, direction string, score double, scope string, pref_score double, gate string"


def representatives(rows: DataFrame, by: tuple[str, ...] = (), order: str = "seq") -> DataFrame:
    """One row of each group that tells of the same event, groups growing as rows join them in order: the best by push, score and pref_score. For the few candidates of a round."""
    return best_of_groups(stored(rows), by, order)


def gated(
    rows: DataFrame, log: DataFrame, as_of: Column, watched: tuple[str, ...], mode: str = "strict", risk_off: bool = False, topic_limit: int = 5, theme_limit: int = 3,
    daily_limit: int | None = None, by: tuple[str, ...] = (), order: str = "seq",
) -> DataFrame:
    """rows with gate (the first reason for which a row is not sent, or sent), chain and exempt.

    Rows are admitted in order, and each sees the log and what its own round has sent before it: events told
    already, topics and themes that are full, chains that had their exemption, the day's limit.
    """
    t, c, n = F.col("title"), F.col("content"), F.col("name")
    direct = F.coalesce("direct", F.lit(False)) if "direct" in rows.columns else F.lit(False)
    leader = gates.is_watched(t, n, c, watched)
    noise = gates.noise_reason(t, n, c, F.col("score"), F.col("scope"), leader, watched)
    quiet = gates.quiet_reason(t, c, F.col("direction"), F.col("score"), direct, as_of)
    reason = (
        F.when(~F.col("judged"), "not judged").when(direct, "").when(~F.col("direction").isin("bullish", "bearish"), "direction").when(noise != "", noise)
        .when(~gates.passes_threshold(mode, F.col("score"), F.col("direction"), F.col("scope"), leader), "threshold").when(quiet != "", quiet)
        .when(F.lit(risk_off) & gates.falls_with_risk(t, c, F.col("source"), F.col("affected_sectors"), F.col("direction")), "risk").otherwise("")
    )
    chain = F.when(F.col("direction").isin("bullish", "bearish"), chain_key(F.col("sig"), t, c)).otherwise("")
    facts = {"reason": reason, "chain": chain, "market": F.col("scope") == "market", "released": gates.is_macro_release(t), "spared": gates.has_signal(text_of("title", "content")), "direct": direct}
    told = stored(events.already_sent(rows, log, as_of))  # a plan of its own: same_event is large
    known = rows.withColumns({k: F.coalesce(v, F.lit("" if k in ("reason", "chain") else False)) for k, v in facts.items()})
    known = known.join(events.topic_counts(rows, log, as_of).withColumnRenamed("n", "topics"), "seq").join(events.theme_counts(rows, log, as_of).withColumnRenamed("n", "themes"), "seq")
    known = known.join(told.withColumn("told", F.lit(True)), "seq", "left").withColumn("told", F.coalesce("told", F.lit(False)))
    if {"exempt", "chain"} <= {*log.columns}:
        known = known.join(log.where("exempt").select("chain", F.lit(True).alias("used")).distinct(), "chain", "left")
        known = known.withColumn("used", F.coalesce("used", F.lit(False)))
    else:
        known = known.withColumn("used", F.lit(False))
    day = log.where(F.to_date("t") == F.to_date(as_of)).agg(F.count(F.lit(1)).alias("day"))  # one row
    known = stored(known.crossJoin(F.broadcast(day)))
    out = admitted(known, by, order, topic_limit, theme_limit, daily_limit)
    helpers = [c for c in ("reason", "market", "released", "spared", "told", "topics", "themes", "used", "day", "direct") if c not in rows.columns]
    return out.drop(*helpers).withColumn("chain", F.when(F.col("exempt"), F.col("chain")))


def round_of(news: DataFrame, log: DataFrame, as_of: Column, watched: tuple[str, ...] = (), judge: Callable[[DataFrame], DataFrame] = rule_judge, most: int = 40, seen: DataFrame | None = None) -> DataFrame:
    """Duplicates and, where `seen` is given, rows with a seen fingerprint out, candidates chosen, judged, grouped and gated: one row for each event, with its gate."""
    fresh = dedup.by_title(dedup.by_url(news))
    if seen is not None:
        fresh = state.unseen(fresh.withColumn("fp", fingerprint(*map(F.col, ("published_at", "title", "content", "name", "affected_stocks")))), seen).drop("fp")
    chosen = stored(judge(ranking.candidates(fresh, watched, most)))
    signed = events.signed(chosen, F.coalesce("entities", F.array().cast("array<string>")), F.col("affected_sectors"), F.col("scope"))
    reps = stored(representatives(signed, order="place"))
    return gated(reps, log, as_of, watched, order="place").select("seq", "title", "direction", "score", "scope", "pref_score", "gate")


def stream_rounds(feed: DataFrame, log: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, watched: tuple[str, ...] = (), judge: Callable[[DataFrame], DataFrame] = rule_judge, **trigger) -> StreamingQuery:
    """round_of for each micro-batch of a stream of news; as_of is the batch's latest time. A batch that fails is run again whole: the sink must take a batch id once."""

    def one(batch: DataFrame, number: int) -> None:
        rows = stored(batch)
        latest = rows.agg(F.max("published_at")).first()[0]
        if latest is not None:
            sink(round_of(rows, log(), F.lit(latest).cast("timestamp"), watched, judge), number)

    return feed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events_stream: DataFrame, at: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of each key in each window of event time; rows later than the watermark are left out."""
    return events_stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
