"""Tables that end a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session takes a temporary folder, and a cluster is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """df as a written table: what follows reads it instead of computing it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-stored/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with the place of each row in the order, from 1. Rows are sorted by range over all tasks; the driver sees one count for each range."""
    place = name + "_in_range"
    table = stored(df.orderBy(*order).withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(place), 33)
    counts = sorted((r["part"], r["n"]) for r in table.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for p, n in counts:
        starts.append((p, before))
        before += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _before long"))  # one row for each range
    return table.join(offsets, part == F.col("_part")).withColumn(name, F.col("_before") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(place, "_part", "_before")
