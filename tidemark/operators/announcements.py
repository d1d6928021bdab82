"""Announcements on their way into a round, and judgements on their way back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import announcement_type
from ..functions.text import any_of, text_of


def ingested(rows: DataFrame, log: DataFrame, as_of: Column, watched: tuple[str, ...], hours: int = 24) -> DataFrame:
    """rows of the known types with type and direct: watched ones go straight, once for each code and type in the hours; others compete as news.

    rows: seq, code, name, kind, title. log: key, t of what went straight before.
    """
    typed = rows.withColumn("type", announcement_type(F.col("kind"), F.col("title"))).where("type <> ''")
    key = F.concat_ws("|", F.when(F.coalesce("code", F.lit("")) != "", F.col("code")).otherwise(F.col("name")), "type")
    flagged = typed.withColumn("direct", any_of(text_of("title", "name"), watched)).withColumn("key", key)
    span = F.unix_micros(as_of) - F.unix_micros("t")
    recent = log.where((span <= hours * 3_600_000_000) & (span >= 0)).select("key").distinct().withColumn("direct", F.lit(True))
    return flagged.join(recent, ["key", "direct"], "left_anti").drop("key")


def with_judgements(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """rows (idx, title, published_at) with score and by: the judgement of the same idx and title, else of the title and time, else of the title.

    Where several judgements fit, the one with the least idx counts.
    """
    first = lambda keys, out: judged.groupBy(*keys).agg(F.min_by("score", "jdx").alias(out))
    by_idx = judged.groupBy(F.col("jdx").alias("idx"), "title").agg(F.min("score").alias("s1"))
    out = rows.join(by_idx, ["idx", "title"], "left").join(first(["title", "published_at"], "s2"), ["title", "published_at"], "left").join(first(["title"], "s3"), "title", "left")
    how = F.when(F.col("s1").isNotNull(), "idx").when(F.col("s2").isNotNull(), "time").when(F.col("s3").isNotNull(), "title").otherwise("none")
    return out.withColumn("score", F.coalesce("s1", "s2", "s3")).withColumn("by", how).drop("s1", "s2", "s3")


def enough_to_study(days: DataFrame, least_span: int = 20, least_days: int = 10) -> DataFrame:
    """One row: number of days with a signal, their span, and whether that is enough. days: day, net."""
    strong = days.where("net <> 0").agg(F.count(F.lit(1)).alias("days"), F.coalesce(F.datediff(F.max("day"), F.min("day")), F.lit(0)).alias("span"))
    return strong.withColumn("enough", (F.col("span") >= least_span) & (F.col("days") >= least_days))
