"""What several of these operators need: shared folders, ordered prefixes, byte views of Arrow text."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy pass takes at a time; a longer document is a pass of its own.
PASS_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session takes a temporary one, and a cluster is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, folder: str | None = None, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark) + '/tidemark-tables'}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """The written tables of one computation, by name, so that those that nothing reads any more can be deleted before it ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/tidemark-tables/{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        return written(df, f"{self.folder}/{name}")

    def free(self, *names: str) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as make it none of the columns (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its partitions as they are, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ordered_prefix(df: DataFrame, group: str, order: list, value: str, position: str, before: str, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, finished: T.StructType | None = None) -> tuple[DataFrame, dict]:
    """Add the row's place in its group (from 0) and the sum of `value` over the rows before it.

    Rows are dealt out by range of (group, order), so a group of any size spreads over tasks. The driver
    sees one count and sum for each group in each partition. Also returns {group: (rows, sum)}. `finish`
    turns each numbered batch into one of the schema `finished` in the same worker.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group), *order]
    dealt = checkpointed(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys))
    sums = dealt.groupBy(F.spark_partition_id().alias("part"), group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s")).collect()
    totals: dict = {}
    offsets: dict = {}
    for row in sorted(sums, key=lambda r: r["part"]):
        n, s = totals.get(row[group], (0, 0))
        offsets[row["part"], row[group]] = (n, s)
        totals[row[group]] = (n + row["n"], s + row["s"])
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(position, T.LongType()), T.StructField(before, T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at: dict = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            groups = np.array(table.column(group).to_pylist(), dtype=object)
            values = table.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            place, sums = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(values) else []
            for lo, hi in zip(starts, [*starts[1:], len(values)], strict=True):
                key = groups[lo]
                n, s = at.get(key) or offsets[part, key]
                run = np.cumsum(values[lo:hi])
                place[lo:hi] = n + np.arange(hi - lo)
                sums[lo:hi] = s + run - values[lo:hi]
                at = {key: (n + hi - lo, s + int(run[-1]))}
            numbered = pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in names], pa.array(place), pa.array(sums)], names=[*names, position, before])
            yield finish(numbered) if finish else numbered

    return dealt.mapInArrow(number, finished if finish else schema), totals


def give_back() -> None:
    """At the end of a partition: free memory goes back to the system, as workers live on and other stages need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array; the nulls of a text column become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column without nulls, and where each text begins (one more entry at the end)."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def passes(column: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each that cover the whole column."""
    _, offsets = text_bytes(column)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(len(column), max(high, low + 1))
        yield low, high
        low = high


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A fixed random number for each byte, and an odd base with its inverse modulo 2**64.
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def lowered_with(column: pa.Array, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, A-Z lower-cased, with the byte `apart` before, between and after them; and where each text begins."""
    raw, offsets = text_bytes(column)
    out = np.full(len(raw) + len(column) + 1, apart, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(1, len(column) + 1), np.diff(offsets))] = _LOWER[raw]
    return out, offsets[:-1] + np.arange(1, len(column) + 1)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with a space before, between and after them, A-Z lower-cased; where each word `[^\\x20\\x09-\\x0D]+` starts and ends in them; and each text's first word."""
    raw, offsets = text_bytes(column)
    count = len(column)
    spaced = np.full(len(raw) + count + 1, 32, np.uint8)
    spaced[np.arange(len(raw)) + np.repeat(np.arange(1, count + 1), np.diff(offsets))] = _LOWER[raw]
    word = ~_SPACE[spaced]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    return spaced, starts, ends, np.searchsorted(starts, offsets + np.arange(count + 1))


def hashed(spaced: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches of bytes."""
    power, inverse = _powers(len(spaced) + 1)
    sums = np.cumsum(_BYTE[spaced] * power[: len(spaced)])
    return mixed((sums[ends - 1] - sums[starts - 1]) * inverse[starts])


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and each text's first word."""
    spaced, starts, ends, begin = words_of(column)
    return hashed(spaced, starts, ends), begin


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its `words`-word shingles; a shorter text is one shingle."""
    hashes, begin = word_hashes(column)
    rolled = np.zeros(len(hashes), np.uint64)
    factor = 1
    for k in range(words):
        factor = factor * 0xA0761D6478BD642F % 2**64
        rolled[: max(0, len(hashes) - k)] += hashes[k:] * np.uint64(factor)
    rolled = mixed(rolled)
    for low, high in zip(begin[:-1], begin[1:], strict=True):
        if high - low >= words:
            yield np.unique(rolled[low : high - words + 1])
        elif high > low:
            factor, whole = 1, 0
            for h in hashes[low:high].tolist():
                factor = factor * 0xA0761D6478BD642F % 2**64
                whole = (whole + h * factor) % 2**64
            yield mixed(np.array([(whole + 0x5851F42D4C957F2D * int(high - low)) % 2**64], np.uint64))
        else:
            yield np.empty(0, np.uint64)


#: The most bits of an IdBitmap: 262,144 rows of 64, whatever the input.
BITMAP_BITS = 1 << 24


class IdBitmap:
    """A Bloom filter with one hash over a table's ids: sure of what is absent. Its size is bounded, so it can be sent to every task; a full one only lets more rows through to the exact join that follows."""

    def __init__(self, ids: DataFrame, column: str):
        self.bits = min(BITMAP_BITS, 1 << max(10, (16 * ids.count()).bit_length()))
        word, bit = self._place(F.col(f"`{column}`"))
        self.words = written(ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")))

    def _place(self, value: Column) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(value), F.lit(self.bits))
        return F.shiftright(at, 6), (at % 64).cast("int")

    def marked(self, df: DataFrame, column: str, flag: str) -> DataFrame:
        """df with a flag that is false where the id is surely not in the table."""
        word, bit, mask = (unused(n, [*df.columns, flag]) for n in ("_word", "_bit", "_mask"))
        at = self._place(F.col(f"`{column}`"))
        placed = df.withColumns({word: at[0], bit: at[1]}).join(F.broadcast(self.words.select(F.col("word").alias(word), F.col("mask").alias(mask))), word, "left")
        return placed.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.expr(f"shiftright(`{mask}`, `{bit}`) & 1L = 1L"), F.lit(False)).alias(flag))

    def matching(self, df: DataFrame, column: str) -> DataFrame:
        flag = unused("_hit", df.columns)
        return self.marked(df, column, flag).where(F.col(f"`{flag}`")).drop(flag)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of the graph whose edges are the columns a and b.

    Labels hook to the smallest label next to them, and hooks are shortened by pointer jumps, until no edge
    joins two labels. Every round is a written table, and takes the place of the round before.
    """
    tables = Tables(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = tables.write("labels0", both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    turn = 0
    while True:
        ends = edges.join(labels.select(F.col("node").alias("a"), F.col("component").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("component").alias("lb")), "b")
        hooks = tables.write(f"hooks{turn}", ends.where("la <> lb").groupBy(F.greatest("la", "lb").alias("high")).agg(F.min(F.least("la", "lb")).alias("low")))
        if hooks.isEmpty():
            return labels
        for _ in range(2):
            on = hooks.select(F.col("high").alias("low"), F.col("low").alias("lower"))
            hooks = hooks.join(on, "low", "left").select("high", F.coalesce("lower", "low").alias("low"))
        turn += 1
        labels = tables.write(f"labels{turn}", labels.join(hooks, labels["component"] == hooks["high"], "left").select("node", F.coalesce("low", "component").alias("component")))
        tables.free(f"labels{turn - 1}", f"hooks{turn - 1}")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed, rows: int, max_bytes: int, longest: int, ones: float = 0.5, id_column: str = "doc_id", text: str = "text") -> tuple[list[tuple[str, int]], float]:
    """[(text, label)] of at most `rows` labelled documents, a share `ones` of them of label 1 where there are as many, and the share of label 1 in all.

    `allowed` says which labelled rows may be learned from. Documents are taken in the order of a hash of their
    id; one whose text has more than `longest` bytes, or would take the texts over `max_bytes`, is left out, whole,
    and the next one takes its place.
    Rows that share an id are one document, with the least of their texts. The driver is sent the ids and sizes of
    2 * `rows` documents, and then `max_bytes` of text, at most.
    """
    known = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).where(allowed(F.col("id"))).distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    there = texts.select("id", F.octet_length("t").alias("n")).groupBy("id").agg(F.max("n").alias("n")).where(F.col("n") <= longest).join(known, "id")
    order = [F.xxhash64("id", F.lit(3)), F.col("id")]
    most = {1: int(rows * ones), 0: rows - int(rows * ones)}
    first = [there.where(F.col("y") == y).orderBy(*order).limit(2 * n).withColumn("place", F.xxhash64("id", F.lit(3))).collect() for y, n in most.items()]
    chosen: dict[int, int] = {}
    left, taken = dict(most), 0
    for r in sorted((r for part in first for r in part), key=lambda r: (r["place"], r["id"], r["y"])):
        if left[r["y"]] and taken + r["n"] <= max_bytes and r["id"] not in chosen:
            chosen[r["id"]] = r["y"]
            left[r["y"]] -= 1
            taken += r["n"]
    ids = F.broadcast(docs.sparkSession.createDataFrame(sorted(chosen.items()), "id long, y int"))  # `rows` at most
    found = texts.join(ids, "id").groupBy("id", "y").agg(F.min("t").alias("t"))
    sample = [(t, y) for _, t, y in sorted((r["id"] * 0x9E3779B97F4A7C15 % 2**64, r["t"], r["y"]) for r in found.toLocalIterator())]
    total = sum(counts.values())
    return sample, (counts.get(1, 0) / total if total else 0.5)
