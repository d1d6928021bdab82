"""Feeds: files of any source in a landing folder, brought to one shape.

A source is a path and a format; a missing one is an empty table, so that one source never stops the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.lexicons import TOPIC_WORDS
from ..functions.text import any_of
from ..operators.dedup import by_title

FEED = "seq long, source string, title string, content string, url string, stamp long"


def landed(spark: SparkSession, path: str, kind: str = "json", schema: str = FEED, **options) -> DataFrame:
    """A folder of JSON, CSV, Parquet, ORC or text files under a given schema; empty where there is none."""
    try:
        return spark.read.format(kind).options(**options).schema(schema).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def stream(spark: SparkSession, path: str, kind: str = "json", schema: str = FEED, **options) -> DataFrame:
    """The same folder as a stream of the files that arrive."""
    return spark.readStream.format(kind).options(**options).schema(schema).load(path)


def epoch(stamp: Column) -> Column:
    """Seconds or milliseconds since 1970, told apart by size, as a time."""
    return F.timestamp_millis(F.when(stamp > 10**12, stamp).otherwise(stamp * 1000))


def normal(rows: DataFrame) -> DataFrame:
    """rows with an untitled row's title taken from its content, and published_at as text in UTC."""
    titled = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.concat(F.substring("content", 1, 40), F.lit("..."))).otherwise(F.col("title"))
    whole = F.col("stamp").cast("long")
    seconds = F.when(whole > 10**12, F.floor(whole / 1000)).otherwise(whole)
    # the days and seconds are put together by hand, so that the session's zone plays no part
    at = F.concat(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd"), F.format_string(" %02d:%02d:%02d", F.floor(seconds % 86400 / 3600), F.floor(seconds % 3600 / 60), seconds % 60))
    return rows.withColumn("title", titled).withColumn("published_at", at)


def unified(parts: list[DataFrame]) -> DataFrame:
    """All sources under each other, the first row of each title kept, untitled rows left out."""
    return by_title(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), drop_untitled=True)


def with_aliases(rows: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under their agreed names: the first alias that the rows have and that is not null."""
    for name, names in aliases.items():
        there = [F.col(f"`{n}`") for n in names if n in rows.columns]
        value = F.coalesce(*there) if there else F.lit(None).cast("string")
        rows = rows.withColumn("_v", value).drop(*[n for n in names if n in rows.columns]).withColumnRenamed("_v", name)
    return rows


def announcements(parts: list[DataFrame], aliases: dict[str, tuple[str, ...]], routine: tuple[str, ...] = ()) -> DataFrame:
    """Pulls of announcements under each other, one row for each code, title and date (the first), routine titles left out."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [with_aliases(p, aliases) for p in parts])
    kept = both.where(~any_of(F.col("title"), routine)) if routine else both
    firsts = kept.groupBy("code", "title", "date").agg(F.min("seq").alias("seq"))
    return kept.join(firsts.select("seq"), "seq", "left_semi")


def plain(markup: Column) -> Column:
    """Text of a piece of markup: tags out, the common entities in plain characters."""
    out = F.regexp_replace(markup, "<[^>]+>", "")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(mark))
    return F.trim(out)


def rss_items(feed: DataFrame, column: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """title (without the source at its end), source, content and published_at text of each item of RSS documents, with the columns to keep."""
    item = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "description", "pubDate", "source")])
    shape = T.StructType([T.StructField("channel", T.StructType([T.StructField("item", T.ArrayType(item))]))])
    rows = feed.select(*keep, F.explode(F.from_xml(F.col(column), shape.simpleString())["channel"]["item"]).alias("i"))
    return rows.select(*keep, F.regexp_replace(plain(F.col("i.title")), r"\s+-\s+[^-]*$", "").alias("title"), F.col("i.source").alias("source"), plain(F.col("i.description")).alias("content"), F.col("i.pubDate").alias("published_at"))


def on_topic(rows: DataFrame, words: tuple[str, ...] = TOPIC_WORDS, most: int = 30) -> DataFrame:
    """The newest rows that hold one of the words."""
    text = F.lower(F.concat_ws(" ", "title", "content"))
    return rows.where(any_of(text, [w.lower() for w in words])).orderBy(F.desc("published_at")).limit(most)


def kline(lines: DataFrame, column: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """date, close and amount of comma-separated bars of seven fields or more, with the columns to keep."""
    f = F.split(column, ",")
    return lines.where(F.size(f) >= 7).select(*keep, F.element_at(f, 1).try_cast("date").alias("date"), F.element_at(f, 3).try_cast("double").alias("close"), F.element_at(f, 7).try_cast("double").alias("amount")).where("date IS NOT NULL AND close IS NOT NULL")
