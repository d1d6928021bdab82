"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct word shingles (a shorter text is one shingle; a text without words has
none and links with nothing). Equal sets are one class, named by a hash of the set. Signatures of MinHash
values are banded, and classes that share a bucket are candidates. They are verified in three steps, none of
which makes all pairs of a group:

1. Each bucket is led by the class that shares most bands with others. Every class is tested against its
   leaders, and the most famous of those that are about half like it or more is its home; the two full sets
   are compared, which gives the class's difference to its home. These are as many pairs as classes.
2. Classes of one home: |A xor B| = |A'| + |B'| - 2 |A' and B'| for the differences A', B'. Two classes that
   are linked, though not both with the home, must share so many elements of their differences that they meet
   through the rarest of them (a prefix filter); so most of a large family never meets. What meets is tested on
   the signatures, and decided exactly from the differences.
3. Classes of different homes in a bucket whose components are not the same yet are tested on the signatures
   inside the join; what survives is confirmed on the full sets.

The test is sequential: signatures are read batch by batch, and a pair is dropped as soon as the chance,
given the matches so far under a uniform prior, that its similarity reaches the threshold falls below
`miss`. Confirmation is in integers. A pair at the threshold shares no band with probability
(1 - s**rows)**bands: 3 in a million at 0.8 with 32 bands of 5 rows.

Signatures are kept as their low bytes. Equal values have equal bytes, so tests on bytes find no fewer
matches and bands of bytes no fewer candidates.

Defined results: null and empty texts have 0 shingles and are their own component; a null id is never
linked, and its row is kept with a null component; rows that share an id are one document, linked with all
that any of their texts is linked with; repeated rows give repeated rows; an empty table gives an empty one;
other columns of docs are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import IdBitmap, Tables, as_array, components, give_back, passes, shingle_sets, written

SIGNED = "doc_id long, n_shingles long, node long, sketch array<tinyint>"
COMPARED = "leader long, node long, n_leader long, n_node long, both long, diff array<long>"
#: Values of a signature that one step of the sequential test reads.
STEP = 20
#: The similarity, in percent, from which a leader can be a class's home.
HOME_PERCENT = 50
#: Members of a leader's group that one copy of the leader's text is compared with.
GROUP = 4096


def hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    factor = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factor, rng.integers(0, 2**63, count, dtype=np.uint64)


def signature(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The upper 32 bits of each function's least value over the set."""
    factor, add = functions
    least = np.full(len(factor), 2**64 - 1, np.uint64)
    for low in range(0, len(shingles), 4096):
        values = shingles[None, low : low + 4096] * factor[:, None]
        values += add[:, None]
        np.minimum(least, values.min(1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def least_matches(threshold: float, total: int, miss: float) -> dict[int, int]:
    """{values read: fewest matches with which P(similarity >= threshold) is at least miss} under a uniform prior."""
    found = {}
    for n in [*range(STEP, total, STEP), total]:
        # P(s >= t | m of n) = P(Binomial(n + 1, t) <= m)
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found[n] = m
    return found


def named(shingles: np.ndarray) -> int | None:
    """The class of a set: 64 bits of a hash of all its elements; None for the empty set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None


def sign(docs: DataFrame, words: int, count: int, id_column: str, text: str) -> DataFrame:
    """Each row's class and sketch: the low byte of each of `count` MinHash values."""
    functions = hash_functions(count)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_array(batch.column(1))
            for low, high in passes(texts):
                sets = list(shingle_sets(texts.slice(low, high - low), words))
                filled = np.array([len(s) > 0 for s in sets])
                sketch = (np.stack([signature(s, functions) for s in sets]) & 255).astype(np.uint8).view(np.int8)
                ends = np.cumsum(np.r_[0, filled * count], dtype=np.int32)
                sketches = pa.ListArray.from_arrays(pa.array(ends), pa.array(sketch[filled].reshape(-1), pa.int8()), mask=pa.array(~filled))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(named, sets), pa.int64()), sketches], names=["doc_id", "n_shingles", "node", "sketch"])
        give_back()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(signed, SIGNED)


def banded(nodes: DataFrame, rows: int, bands: int) -> DataFrame:
    """band, node: one row for each band of each node."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sketch", i * rows + 1, rows)))
    return nodes.select("node", F.explode(keys).alias("band"))


def alike(x: str, y: str, table: dict[int, int]) -> Column:
    """Whether the sequential test passes two sketches: a fold over the steps, which reads no further once one has dropped the pair."""
    ends = sorted(table)
    steps = F.array(*[F.struct(F.array(*map(F.lit, range(low, high))).alias("at"), F.lit(table[high]).alias("least")) for low, high in zip([0, *ends], ends, strict=False)])
    equal = lambda at: F.size(F.filter(at, lambda i: F.get(F.col(x), i) == F.get(F.col(y), i)))

    def step(matches: Column, s: Column) -> Column:
        more = F.element_at(F.transform(F.array(matches + equal(s["at"])), lambda m: F.when(m >= s["least"], m).otherwise(-1)), 1)
        return F.when(matches < 0, matches).otherwise(more)

    return F.aggregate(steps, F.lit(0), step) >= 0


def survivors(pairs: DataFrame, known: DataFrame, table: dict[int, int]) -> DataFrame:
    """The pairs of a leader and a node that the sequential test on their sketches does not rule out."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda column: column.flatten().to_numpy().reshape(len(column), -1)  # noqa: E731  sketches have one length
        for whole in batches:
            for low in range(0, len(whole), 4096):
                batch = whole.slice(low, 4096)
                x, y = rows(batch.column(2)), rows(batch.column(3))
                alive, matches, done = np.arange(len(batch)), np.zeros(len(batch), np.int64), 0
                for n, least in table.items():
                    matches = matches + (x[alive, done:n] == y[alive, done:n]).sum(1)
                    keep = matches >= least
                    alive, matches, done = alive[keep], matches[keep], n
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(alive)) for i in (0, 1)], names=["leader", "node"])

    of = lambda n: known.select(F.col("node").alias(n), F.col("sketch").alias(f"sketch_{n}"))
    return pairs.join(of("leader"), "leader").join(of("node"), "node").select("leader", "node", "sketch_leader", "sketch_node").mapInArrow(test, "leader long, node long")


def compared(pairs: DataFrame, known: DataFrame, docs: DataFrame, words: int, id_column: str, text: str) -> DataFrame:
    """The pairs of a leader and a node with the sizes of their full sets, of what both hold, and what one of them holds alone.

    A leader's text is sent along with every GROUP of its nodes, and comes first in its group; a task holds one
    leader's set at a time, however many nodes follow.
    """
    parts = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    first = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("node"), F.lit(0).alias("follows"))
    rest = pairs.join(parts, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", F.lit(1).alias("follows"))
    seats = written(first.unionByName(rest).join(known.select("node", "doc_id"), "node"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.empty(0, np.uint64)
        for batch in batches:
            texts = as_array(batch.column(3))
            for low, high in passes(texts):
                found: list[tuple[int, int, int, int, int]] = []
                diffs = []
                keys = zip(*(batch.column(i).slice(low, high - low).to_pylist() for i in range(3)), shingle_sets(texts.slice(low, high - low), words), strict=True)
                for group, node, follows, shingles in keys:
                    if named(shingles) != node:  # another text of an id that several rows share
                        continue
                    if not follows:
                        leader, own = group, shingles
                    elif leader == group:
                        diff = np.setxor1d(own, shingles, assume_unique=True)
                        found.append((group, node, len(own), len(shingles), (len(own) + len(shingles) - len(diff)) // 2))
                        diffs.append(diff.view(np.int64))
                columns = [pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 5)]
                ends = np.cumsum([0, *map(len, diffs)], dtype=np.int32)
                values = pa.array(np.concatenate(diffs) if diffs else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), values)], names=["leader", "node", "n_leader", "n_node", "both", "diff"])
        give_back()

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    near = IdBitmap(seats.select("doc_id").distinct(), "doc_id").matching(texts, "doc_id").join(seats, "doc_id")
    return near.repartition("leader", "part").sortWithinPartitions("leader", "part", "follows").select("leader", "node", "follows", "text").mapInArrow(compare, COMPARED)


def linked(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: the compared pairs with 100 * intersection >= percent * union."""
    return rows.where(F.expr(f"{100 + percent} * both >= {percent} * (n_leader + n_node)")).select(F.col("leader").alias("a"), F.col("node").alias("b"))


def relatives(homes: DataFrame, found: DataFrame, known: DataFrame, percent: int, table: dict[int, int]) -> DataFrame:
    """a, b: links across components among the nodes of one home.

    With d = |difference to the home| and c = (100 - percent) / (100 + percent), two nodes are linked if
    they share at least (d1 + d2 - c (n1 + n2)) / 2 elements of their differences. A node that is out (of the
    home's component) has d > c (n + n_home), and none has d - c n < -c n_home. So every node shares more than
    (d - c n + c n_home) / 2 elements with an out node that it is linked with, and an out node at least
    (d - c n - c n_home) / 2 with any: they meet through the rarest of their elements, which are all but so many.
    Elements that only one node of a home has cannot be shared, and count for nothing.
    """
    spark = homes.sparkSession
    of = lambda n: found.select(F.col("node").alias(n), F.col("component").alias(f"component_{n}"))
    placed = homes.join(of("node"), "node", "left").join(of("leader"), "leader", "left")
    placed = placed.withColumn("component", F.coalesce("component_node", "node")).withColumn("out", F.col("component") != F.coalesce("component_leader", "leader"))
    mixed_homes = placed.where("out").select("leader").distinct()
    placed = written(placed.join(mixed_homes, "leader", "left_semi").select("leader", "node", "component", "out", "n_leader", "n_node", "diff"))
    each = placed.select("leader", "node", F.explode("diff").alias("e"))
    counts = each.groupBy("leader", "e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = each.join(counts, ["leader", "e"]).groupBy("leader", "node").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("by_n"))
    q, less = 100 + percent, 100 - percent
    score, base = F.expr(f"{q}L * size(diff) - {less}L * n_node"), F.expr(f"{less}L * n_leader")
    held = placed.join(shared, ["leader", "node"]).join(known.select("node", "sketch"), "node")
    held = held.withColumn("score", score).withColumn("base", base).withColumn("m", F.size("by_n"))
    held = held.withColumn("some", F.expr(f"m - (score + base) div {2 * q}")).withColumn("most", F.expr(f"m - greatest(1L, (score - base + {2 * q - 1}) div {2 * q}) + 1"))
    rows = written(held.select("leader", "node", "component", "out", "n_node", F.size("diff").alias("d"), F.transform("by_n", lambda s: s["e"]).alias("own"), "sketch", "some", "most"))

    def keyed(side: DataFrame, length: str, n: str) -> DataFrame:
        fields = [F.col(c).alias(f"{c}_{n}") for c in ("node", "component", "n_node", "d", "own", "sketch")]
        return side.where(f"{length} > 0").select("leader", *fields, F.posexplode(F.slice("own", F.lit(1), F.col(length).cast("int"))).alias(f"at_{n}", "e"))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but many comparisons: not to be merged into few tasks
    one, two = (keyed(side, length, n).repartition(parts, "leader", "e") for side, length, n in ((rows, "some", "x"), (rows.where("out"), "most", "y")))
    excess = q * (F.col("d_x") + F.col("d_y")) - less * (F.col("n_node_x") + F.col("n_node_y"))
    # if this is the first element that both have, no more can follow
    can = excess <= 2 * q * F.least(F.size("own_x") - F.col("at_x"), F.size("own_y") - F.col("at_y"))
    exact = excess <= 2 * q * F.size(F.array_intersect("own_x", "own_y"))
    fits = F.when((F.col("component_x") != F.col("component_y")) & can, F.when(alike("sketch_x", "sketch_y", table), exact).otherwise(False)).otherwise(False)
    return one.join(two, ["leader", "e"]).where(fits).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def strangers(buckets: DataFrame, homes: DataFrame, found: DataFrame, known: DataFrame, table: dict[int, int]) -> DataFrame:
    """leader, node: pairs of different homes and components in a bucket that the sequential test passes. The test is part of the join; the nodes of a bucket's largest home are not set against each other."""
    placed = buckets.join(homes.select("node", F.col("leader").alias("home")), "node", "left").join(found, "node", "left")
    placed = written(placed.select("band", "node", F.coalesce("home", "node").alias("home"), F.coalesce("component", "node").alias("component")))
    apart = placed.groupBy("band").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select("band")
    sizes = placed.join(apart, "band", "left_semi").groupBy("band", "home").agg(F.count(F.lit(1)).alias("n"))
    tops = sizes.groupBy("band").agg(F.max(F.struct("n", "home")).alias("top"), F.count(F.lit(1)).alias("homes")).where("homes > 1").select("band", F.col("top.home").alias("top"))
    signed = placed.join(tops, "band").join(known.select("node", "sketch"), "node")
    one, two = (signed.select("band", "top", *[F.col(c).alias(f"{c}_{n}") for c in ("node", "home", "component", "sketch")]) for n in "xy")
    one, two = one.where("home_x <> top").drop("top"), two
    fits = (F.col("component_x") != F.col("component_y")) & (F.col("home_x") != F.col("home_y")) & ((F.col("home_y") == F.col("top")) | (F.col("node_x") < F.col("node_y")))
    met = one.join(two, "band").where(F.when(fits, alike("sketch_x", "sketch_y", table)).otherwise(False))
    return met.select(F.least("node_x", "node_y").alias("leader"), F.greatest("node_x", "node_y").alias("node")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 5, bands: int = 32, miss: float = 1e-6, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) and kept for every row of docs."""
    tables, source = Tables(docs.sparkSession), (docs, words, id_column, text)
    signed = tables.write("signed", sign(docs, words, rows * bands, id_column, text))
    member = written(signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")))
    sets = member.where("node IS NOT NULL").select("doc_id", "node")
    least = sets.groupBy("node").agg(F.min("doc_id").alias("first"))

    # one sketch for each class: rows that the bitmap says are no copies need no join
    copies = tables.write("copies", sets.join(least, "node").where("doc_id <> first").select("doc_id", "node").distinct())
    flagged = IdBitmap(copies, "doc_id").marked(signed.where("node IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "node", "sketch"), "doc_id", "maybe")
    nodes = flagged.where("NOT maybe").drop("maybe").unionByName(flagged.where("maybe").drop("maybe").join(copies, ["doc_id", "node"], "left_anti"))

    places = banded(nodes, rows, bands)
    sizes = places.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("band", "n")
    buckets = tables.write("buckets", places.join(sizes, "band"))
    # a family's centre shares its bands with most of the family, so it leads wherever it is
    fame = tables.write("fame", buckets.groupBy("node").agg(F.sum("n").alias("fame")))
    known = tables.write("known", IdBitmap(fame, "node").matching(nodes, "node").join(fame, "node").dropDuplicates(["node"]))
    tables.free("signed", "copies")
    famous = F.struct("fame", (-F.col("node")).alias("m"))
    leaders = buckets.join(fame, "node").groupBy("band").agg(F.max(famous).alias("top")).select("band", (-F.col("top.m")).alias("leader"))
    tested = buckets.join(leaders, "band").where("node <> leader").select("leader", "node").distinct()
    likely = survivors(tested, known, least_matches(HOME_PERCENT / 100, rows * bands, miss))
    best = likely.join(fame.select(F.col("node").alias("leader"), "fame"), "leader").groupBy("node").agg(F.max(F.struct("fame", (-F.col("leader")).alias("m"))).alias("top"))
    # fame grows along homes, or the number falls, so no two nodes are each other's home
    own = best.join(fame, "node").where(F.col("top") > famous).select((-F.col("top.m")).alias("leader"), "node")
    homes = tables.write("homes", compared(tables.write("own", own), known, *source))

    table = least_matches(percent / 100, rows * bands, miss)
    links = tables.write("links1", linked(homes, percent))
    found = components(links)
    links = tables.write("links2", links.unionByName(relatives(homes, found, known, percent, table)))
    found = components(links)
    left = tables.write("left", strangers(buckets, homes, found, known, table))
    links = links.unionByName(linked(compared(left, known, *source), percent))
    # the texts of one id are one document
    split = sets.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    links = links.unionByName(sets.join(split, "doc_id").where("node > a").select("a", F.col("node").alias("b")))
    found = components(tables.write("links3", links))
    tables.free("buckets", "fame", "known", "own", "homes", "links1", "links2", "left", "links3")

    placed = member.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(smallest, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
