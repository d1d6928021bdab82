"""Read-only reports over news and sent events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gates import goes_straight
from ..functions.scoring import canonical_sector
from ..functions.text import text_of, without
from ..functions.times import FORMATS, parse_time


def morning_brief(news: DataFrame, since: Column, watched: tuple[str, ...] = (), top: int = 5, signals: int = 2) -> DataFrame:
    """The first rows by hit and score since then, few of them signals. Times that are none are kept."""
    at = parse_time(F.col("published_at"), FORMATS[:8])
    hit = goes_straight(without(text_of("title", "content"), F.col("name")), watched)
    rows = news.where(at.isNull() | (at >= since)).withColumn("hit", hit)
    order = [F.desc("hit"), F.desc("score"), F.asc("seq")]
    few = rows.where("category = 'signal'").withColumn("_i", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where(F.col("_i") <= signals).drop("_i")
    return rows.where("category <> 'signal'").unionByName(few).orderBy(*order).limit(top)


def evening_review(log: DataFrame, day: Column, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """The day's events by direction, and its sectors that were named most."""
    today = log.where(F.to_date("t") == day)
    sectors = today.select(F.explode("sig.sectors").alias("raw")).groupBy(canonical_sector(F.col("raw")).alias("sector")).agg(F.count(F.lit(1)).alias("n"))
    return today.groupBy("dir").agg(F.count(F.lit(1)).alias("n")), sectors.orderBy(F.desc("n"), "sector").limit(top)
