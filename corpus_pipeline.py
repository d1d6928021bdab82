"""A corpus in four stages: toxic documents go, poor ones go, one of each group of near copies stays, and what is left is packed into sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import neardup, packing, quality, queries, toxicity
from tidemark.llm.shared import IdBitmap, written

TOXIC_FROM = 0.7
GOOD_FROM = 0.3


def plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with names of the stages' own, so that no name of the caller's is in the way; and those of the id and the text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def scored(docs: DataFrame, score: Callable[[DataFrame, str], DataFrame], kept: Callable[[Column], Column]) -> DataFrame:
    """The rows of docs whose score is kept, as they were."""
    rows, _, text = plain(docs)
    return score(rows, text).where(kept(F.col("score"))).select(rows.columns).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under TOXIC_FROM.

    Null and empty texts are scored as any other, very long ones whole; equal texts and repeated rows score alike; a
    score of TOXIC_FROM goes. Other columns stay, whatever their names. No documents give none.
    """
    queries.small_batches(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), queries.table(spark, sf_dir, "labels"), queries.learnable(3, 1))
    return scored(docs, lambda rows, text: toxicity.score(rows, model, text), lambda s: s < TOXIC_FROM)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is GOOD_FROM or more.

    Null and empty texts are scored as any other, very long ones whole; equal texts and repeated rows score alike; a
    score of GOOD_FROM stays. Other columns stay, whatever their names. No documents give none.
    """
    queries.small_batches(spark)
    model = quality.fit(docs.select("doc_id", "text"), queries.table(spark, sf_dir, "labels"), queries.learnable(5, 0))
    return scored(docs, lambda rows, text: quality.score(rows, model, text), lambda s: s >= GOOD_FROM)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five-word shingles, similarity 0.8).

    Of rows that share this id one stays, with the least text. Texts without words are near nothing and stay, but
    for rows that share an id; rows with a null id all stay. Very long texts are compared whole. Other columns stay,
    whatever their names. No documents give none.
    """
    queries.small_batches(spark)
    found = neardup.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    rows, key, text = plain(docs)
    ids = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(key)).agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    special = written(ids.where("NOT kept OR n > 1").select(key, (~F.col("kept")).alias("gone"), (F.col("n") > 1).alias("many")))
    marked = IdBitmap(special, key).marked(rows, key, "maybe")
    looked_up = marked.where("maybe").join(special, key, "left").where(~F.coalesce("gone", F.lit(False)))
    order = Window.partitionBy(key).orderBy(text)
    first = looked_up.where("many").withColumn("place", F.row_number().over(order)).where("place = 1")
    alone = looked_up.where(~F.coalesce("many", F.lit(False)))
    parts = [part.select(rows.columns) for part in (marked.where("NOT maybe"), alone, first)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their ids (little-endian unsigned 32-bit), their CRC, their sequence and their place in it; a null or empty text is the end id alone, and no documents give no pieces."""
    queries.small_batches(spark)
    return packing.pack(queries.pieces_of(docs).withColumn("ids_crc32", F.crc32("ids")), queries.SEQUENCE)


STAGES = [("toxicity", drop_toxic), ("quality classifier", keep_good), ("minhash near-dedup", one_of_each), ("best-fit packing", pack)]
#: The models and the token ids can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
