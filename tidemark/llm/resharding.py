"""Resharding by minimum-cost flow.

Old shard sizes and new capacities make a transport problem: bytes that stay cost nothing, bytes that move
cost their number. Its flow says how many bytes each old shard hands to each new one. Within an old shard
the rows stand by size, largest first, and the flow cuts that order into blocks: the first block stays, each
further block goes to one new shard. A cut falls between rows, so a new shard misses its capacity by less
than a row for each cut. Only shards that lose or gain rows are rewritten.

Defined results: the size of a row is the UTF-8 length of its text (a null text has none) plus 1; a null id
or old shard is a value like another (old shards that are null or outside 0..n-1 are emptied); rows that
agree in old shard, size and id stay together; an empty table gives an empty one; other columns go along,
and columns named like a result are replaced.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ordered_prefix, shared_folder, unused

_LEAST = -(2**63)


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Ship all supply within the capacities at least cost: successive shortest paths over the transport graph."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    head: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, price = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> None:
        for x, y, z, p in ((a, b, c, w), (b, a, 0, -w)):
            head[x].append(len(to))
            to.append(y)
            room.append(z)
            price.append(p)

    for i in range(n):
        arc(source, i, supply[i], 0)
    for j in range(m):
        arc(n + j, sink, capacity[j], 0)
    first = len(to)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, supply[i], cost[i][j])
    while True:
        far: list[float] = [float("inf")] * len(head)
        far[source], via, queue, queued = 0, [-1] * len(head), deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in head[a]:
                if room[e] and far[a] + price[e] < far[to[e]]:
                    far[to[e]], via[to[e]] = far[a] + price[e], e
                    if to[e] not in queued:
                        queue.append(to[e])
                        queued.add(to[e])
        if far[sink] == float("inf"):
            break
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = to[via[at] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    return [[room[(first + 2 * (i * m + j)) ^ 1] for j in range(m)] for i in range(n)]


def capacities_for(total: int, shards: int, shares: Sequence[int] | None = None) -> list[int]:
    """Bytes for each new shard, of `total` together: by the shares, or evenly."""
    shares = [1] * shards if shares is None else list(shares)
    if len(shares) != shards or min(shares) < 0 or sum(shares) == 0:
        raise ValueError("one share for each shard, none under 0 and not all 0")
    ends = [total * x // sum(shares) for x in accumulate(shares)]
    return [b - a for a, b in zip([0, *ends], ends, strict=False)]


def even_capacities(total: int, shards: int) -> list[int]:
    return capacities_for(total, shards)


def plan_blocks(totals: dict, shards: int, shares: Sequence[int] | None = None) -> dict:
    """{old shard: [(first byte, new shard)]}: blocks of each old shard's bytes in order, what stays first."""
    olds = sorted(totals, key=lambda x: (x is None, x))
    sizes = [totals[x][1] for x in olds]
    flow = min_cost_flow(sizes, capacities_for(sum(sizes), shards, shares), [[int(old != j) for j in range(shards)] for old in olds])
    blocks: dict = {}
    for old, row in zip(olds, flow, strict=True):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != old, j)):
            if row[j]:
                blocks.setdefault(old, []).append((at, j))
                at += row[j]
    return blocks


def assign(docs: DataFrame, old: Column, shards: int, id_column: str = "doc_id", text: str = "text", shares: Sequence[int] | None = None) -> DataFrame:
    """docs with size, old_shard and new_shard. The texts are read, not shuffled: each block is known by its first row."""
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("size", "old_shard", "new_shard")], (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), old.cast("int").alias("old_shard"))
    key = F.coalesce(F.col(id_column), F.lit(_LEAST))
    narrow = rows.select("old_shard", "size", key.alias("id"))
    placed, totals = ordered_prefix(narrow, "old_shard", [F.desc("size"), F.col("id")], "size", "place", "before")
    blocks = plan_blocks(totals, shards, shares)
    new = F.lit(0)
    pieces = [(o, lo, j) for o, cuts in blocks.items() for lo, j in cuts]
    if not pieces:
        return rows.withColumn("new_shard", F.lit(0))
    # a row belongs to the block that holds its first byte
    block = F.coalesce(*[F.when(F.col("old_shard").eqNullSafe(F.lit(o)) & (F.col("before") >= lo), F.lit(i)) for i, (o, lo, _) in sorted(enumerate(pieces), key=lambda x: -x[1][1])])
    firsts = {r["block"]: r["first"] for r in placed.groupBy(block.alias("block")).agg(F.min(F.struct((-F.col("size")).alias("s"), "id")).alias("first")).collect()}
    whens = []
    for i, (o, lo, j) in sorted(enumerate(pieces), key=lambda x: -x[1][1]):
        if i in firsts:
            s, k = firsts[i]["s"], firsts[i]["id"]
            whens.append(F.when(F.col("old_shard").eqNullSafe(F.lit(o)) & ((-F.col("size") > s) | ((-F.col("size") == s) & (key >= k))), F.lit(j)))
    new = F.coalesce(*whens) if whens else new
    return rows.withColumn("new_shard", new.cast("int"))


def reshard(docs: DataFrame, old: Column, shards: int, id_column: str = "doc_id", text: str = "text", shares: Sequence[int] | None = None) -> DataFrame:
    """Rewrite the affected shards as files in the shared folder; returns all rows with size, old_shard and shard.

    `shares` are the new capacities, relative to one another; without them all shards get as many bytes.

    Rows of shards that neither lose nor gain are read where they are.
    """
    spark = docs.sparkSession
    moved = assign(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"]), old, shards, id_column, text, shares)
    traffic = moved.groupBy("old_shard", "new_shard").agg(F.count(F.lit(1)).alias("n")).collect()
    affected = {x for r in traffic if r["old_shard"] != r["new_shard"] for x in (r["old_shard"], r["new_shard"])} - {None}
    touched = F.coalesce(F.col("new_shard").isin(sorted(affected)), F.lit(False)) if affected else F.lit(False)
    path = f"{shared_folder(spark)}/tidemark-shards/{uuid.uuid4().hex}"
    moved.where(touched).withColumn("shard", F.col("new_shard")).write.partitionBy("new_shard").parquet(path)
    kept = [c for c in moved.columns if c != "new_shard"]
    schema = moved.where(touched).withColumn("shard", F.col("new_shard")).drop("new_shard").schema
    rewritten = spark.read.schema(schema).option("basePath", path).option("recursiveFileLookup", "true").parquet(path) if affected else spark.createDataFrame([], schema)
    still = moved.where(~touched).select(*kept, F.col("new_shard").alias("shard"))
    return rewritten.select(*kept, "shard").unionByName(still)


def slots(rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """rows with slot: the place of each row in its shard, gapless from 0, by id."""
    one, before = (unused(n, [*rows.columns, "slot"]) for n in ("_one", "_before"))
    numbered, _ = ordered_prefix(rows.drop("slot").withColumn(one, F.lit(1).cast("long")), "shard", [F.col(f"`{id_column}`")], one, "slot", before)
    return numbered.drop(one, before)

