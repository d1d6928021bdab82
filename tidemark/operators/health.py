"""Health of sources: runs of empty rounds, and alerts on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import state


def streaks(rounds: DataFrame, source: str = "source", at: str = "round", count: str = "count") -> DataFrame:
    """rounds with streak: how many rounds in a row have been empty, up to and with this one."""
    so_far = Window.partitionBy(source).orderBy(at)
    island = F.sum(F.when(F.col(count) > 0, 1).otherwise(0)).over(so_far)
    marked = rounds.withColumn("_island", island)
    return marked.withColumn("streak", F.sum(F.when(F.col(count) > 0, 0).otherwise(1)).over(Window.partitionBy(source, "_island").orderBy(at))).drop("_island")


def latest(rounds: DataFrame, source: str = "source", at: str = "round", count: str = "count") -> DataFrame:
    """Each source's last round and the streak it ends in: two aggregates, no window over a source's history."""
    last_full = F.max(F.when(F.col(count) > 0, F.col(at)))
    ends = rounds.groupBy(source).agg(F.max(at).alias(at), last_full.alias("full"), F.max_by(count, at).alias(count))
    after = rounds.join(ends.select(source, "full"), source).where(F.col("full").isNull() | (F.col(at) > F.col("full"))).groupBy(source).agg(F.count(F.lit(1)).alias("streak"))
    return ends.join(after, source, "left").select(source, at, count, F.coalesce("streak", F.lit(0)).alias("streak"))


def alerts(health: DataFrame, as_of: Column, least: int = 6, hours: int = 24) -> DataFrame:
    """Sources with so long a streak and no alert within the hours; none at all while every source is empty."""
    alive = health.agg(F.max("count").alias("any")).where(F.col("any") > 0)
    calm = F.col("last_alert").isNull() | ((F.unix_micros(as_of) - F.unix_micros("last_alert")) >= hours * 3_600_000_000)
    due = health.where((F.col("streak") >= least) & calm)
    return due.withColumn("_all", F.lit(1)).join(F.broadcast(alive.select(F.lit(1).alias("_all"))), "_all", "left_semi").drop("_all")


def history(rounds: DataFrame, source: str = "source", at: str = "t", count: str = "count", alive: str = "alive", least: int = 6, hours: int = 24) -> DataFrame:
    """rounds with streak and alert: from `least` empty rounds on, where any source is alive, and at least `hours` after the source's last alert."""
    told = streaks(rounds, source, at, count)
    due = told.where((F.col("streak") >= least) & F.col(alive)).select(source, F.col(at).alias("t"))
    sent = state.spaced(due, source, hours).select(source, F.col("t").alias(at), F.lit(True).alias("alert"))
    return told.join(sent, [source, at], "left").withColumn("alert", F.coalesce("alert", F.lit(False)))
