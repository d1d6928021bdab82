"""Exact top-k search by inner product: branch and bound over columns.

Vectors lie dimension by dimension. A cell holds one block of queries and one block of vectors; it adds up
products one block of dimensions after another and drops the candidates whose score so far plus the most
that the remaining mass of both vectors can add (Cauchy-Schwarz) stays under the k-th best sure score.
Survivors are compacted and go on. Cells give at most k rows a query, which a ranking over all cells merges.

Defined results: vectors that are null or hold null or non-finite components take no part; only vectors of
the same length are compared, and two empty ones score 0; a query never finds its own id; ties go to the
smaller id; rows that share an id are candidates each, and the one with the smallest vector asks for the
id; fewer candidates give fewer rows; other columns are not read, whatever their names. Scores must stay under 2**53, where sums of doubles are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id long, vec_id long, score long"


def block_top_k(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best of the block, by (score desc, id). vectors: one row for each dimension."""
    dims, count = vectors.shape
    cuts = [*range(0, dims, step), dims] if dims else [0]
    # the mass that is left after each block of dimensions
    left = lambda x: np.sqrt(np.maximum(0, np.array([np.square(x[c:]).sum(0) for c in cuts])))
    left_v, left_q = left(vectors), left(queries.T)
    head = cuts[1] if dims else 0
    first = queries[:, :head] @ vectors[:head] if head else np.zeros((len(queries), count))
    for q, own in enumerate(query_ids):
        alive = np.flatnonzero(ids != own)
        score = first[q][alive]
        for b, cut in enumerate(cuts[1:], 1):
            if b > 1:
                low = cuts[b - 1]
                score = score + queries[q, low:cut] @ vectors[low:cut, alive]
            if len(alive) > k and cut < dims:
                slack = left_q[b, q] * left_v[b, alive] * (1 + 1e-9)
                sure = np.partition(score - slack, len(alive) - k)[len(alive) - k]
                keep = score + slack >= sure
                alive, score = alive[keep], score[keep]
        if len(alive) > k:
            floor = np.partition(score, len(alive) - k)[len(alive) - k]
            alive, score = alive[score >= floor], score[score >= floor]
        best = np.lexsort((ids[alive], -score))[:k]
        yield q, alive[best], score[best]


def top_k(vectors: DataFrame, id_column: str, vector_column: str, is_query: Column, k: int = 20, scale: float = 64.0, query_block: int = 1024, vector_block: int = 8192, step: int = 16) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best by inner product of floor(scale * component).

    The queries stand in blocks against all rows in blocks: each row goes to every block of queries once.
    """
    x = F.col(vector_column)
    fits = x.isNotNull() & F.col(id_column).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    clean = vectors.where(fits).select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double")).alias("v"), is_query.alias("is_query")).withColumn("dims", F.size("v"))
    counts = clean.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("long")).alias("q")).collect()
    spark = vectors.sparkSession
    plan = [(r["dims"], max(1, -(-(r["q"] or 0) // query_block)), max(1, -(-r["n"] // vector_block))) for r in counts if r["q"]]
    if not plan:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = F.broadcast(spark.createDataFrame(plan, "dims int, q_blocks long, v_blocks long"))  # one row for each length of vectors
    dealt = clean.join(blocks, "dims")
    salt = F.xxhash64("id", F.lit(7))
    asked = dealt.where("is_query").select("dims", F.pmod(salt, "q_blocks").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("v_blocks") - 1)).alias("vb"), "id", "v", F.lit(True).alias("asks"))
    offered = dealt.select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1)).alias("qb"), F.pmod(F.xxhash64("id", F.lit(11)), "v_blocks").alias("vb"), "id", "v", F.lit(False).alias("asks"))

    def search(cell: pd.DataFrame) -> pd.DataFrame:
        asks = cell["asks"].to_numpy()
        pack = lambda part: np.stack(part["v"].to_numpy()).astype(np.float64) if len(part) else np.empty((0, 0))
        q, v = cell[asks], cell[~asks]
        if q["id"].duplicated().any():
            q = q.iloc[sorted(range(len(q)), key=lambda i: tuple(q["v"].iloc[i]))].drop_duplicates("id")
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids, query_ids = v["id"].to_numpy(), q["id"].to_numpy()
        found = [(np.full(len(at), query_ids[i]), ids[at], score.astype(np.int64)) for i, at, score in block_top_k(pack(q), query_ids, np.ascontiguousarray(pack(v).T), ids, k, step)]
        return pd.DataFrame({name: np.concatenate([f[i] for f in found]) for i, name in enumerate(("query_id", "vec_id", "score"))})

    best = asked.unionByName(offered).groupBy("dims", "qb", "vb").applyInPandas(search, RESULT)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(rank).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
