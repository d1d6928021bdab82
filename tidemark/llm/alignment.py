"""Tokens of two tokenizers over the same text, aligned by where they end.

A text goes to a byte-level tokenizer (A, which is given a space and the text) and to a piece tokenizer (B, which
adds that space itself). Both cut a text before a space that stands between a letter or digit and something else than
the text's end, so a text is a row of stretches, each encoded alone; `Chunks` checks the files for this, and where they
don't a text is one stretch. Texts stand in blocks of a bounded size, and a block has each of its stretches once.

The alignment is relational, over the stretches of all blocks: each side's tokens are exploded with their positions, a
windowed sum of their byte lengths gives their ends, and an equi-join on stretch and end finds the cuts, where both
sides end a token. The tokens between two cuts are one group, and every token of A there is linked with every token of
B there. A stretch's end is a cut, so a text's groups are those of its stretches, in order: a block and its cuts meet,
and its texts are put together.

Explode, window and joins stay in one partitioning, by block. A text's links are kept as distinct id pairs with how
often they occur. An id pair's count, in how many texts it is linked, is an aggregate over the distinct pairs of each
text; the counts return to the texts by a broadcast where they are counted small, else by a join on the pair.

Defined results: a null or empty text, and one whose tokens' bytes do not give a space and the text on either side,
has no tokens: zeros and an empty digest. Rows that share an id, and repeated rows, are texts of their own. Texts are
read whole. An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import BYTE_LETTERS
from .shared import as_array, give_back, passes, written

#: Stretches of text whose ids a worker remembers, and characters of them, in each of two generations.
REMEMBERED, REMEMBERED_CHARS = 100_000, 3 << 20
#: Different stretches of a block, and characters of its texts, at which it ends.
BLOCK_STRETCHES, BLOCK_CHARS = 50_000, 3 << 19
#: Links of a group up to which they are listed one by one; of a larger group distinct id pairs are.
LISTED = 64
#: Id pairs whose counts are sent to all tasks, some 16 bytes each; beyond it they meet the texts by a shuffle.
SENT_PAIRS = 1_000_000


def byte_vocabulary(path: str) -> dict[int, bytes]:
    """The bytes of each id of a byte-level tokenizer's file."""
    with open(path, encoding="utf-8") as f:
        known = json.load(f)["model"]["vocab"]
    letters = {c: b for b, c in BYTE_LETTERS.items()} | {b: b for b in range(256) if b not in BYTE_LETTERS}
    return {i: bytes(letters[ord(c)] for c in word) for word, i in known.items() if all(ord(c) in letters for c in word)}


def piece_vocabulary(path: str) -> dict[int, bytes]:
    """The bytes of each id of a piece tokenizer's file; a byte piece is its byte."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    of = lambda i, s: bytes([int(s[3:5], 16)]) if p.is_byte(i) else s.replace("▁", " ").encode()
    return {i: of(i, p.id_to_piece(i)) for i in range(p.get_piece_size())}


class Chunks:
    """Ids of both tokenizers for stretches of text that begin with a space; None where their bytes are not the text's."""

    def __init__(self, byte_file: str, piece_file: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_file), sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.bytes_a, self.bytes_b = byte_vocabulary(byte_file), piece_vocabulary(piece_file)
        if max(*self.bytes_a, *self.bytes_b) >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        # no token of either goes on over a space behind a letter or digit
        self.splits = not any(c.isalnum() and d == " " for side in (self.bytes_a, self.bytes_b) for v in side.values() if b" " in v for t in [v.decode("utf-8", "replace")] for c, d in zip(t, t[1:], strict=False))
        self.young: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}
        self.chars = 0

    def cut(self, text: str) -> list[str]:
        """A space and the text, in stretches that both tokenizers encode alone as they do together."""
        if not self.splits:
            return [" " + text]
        parts = text.split(" ")
        out, held = [], parts[0]
        for i, part in enumerate(parts[1:], 2):
            if held[-1:].isalnum() and (part or i < len(parts)):
                out.append(" " + held)
                held = part
            else:
                held += " " + part
        out.append(" " + held)
        return out

    def learn(self, chunks: list[str]) -> None:
        for low in range(0, len(chunks), 8192):
            some = chunks[low : low + 8192]
            a, b = [x.ids for x in self.a.encode_batch_fast(some, add_special_tokens=False)], self.b.encode([c[1:] for c in some], num_threads=1)
            raw = [c.encode() for c in some]
            right = [all(x) for x in zip(self.give(a, self.bytes_a, raw), self.give(b, self.bytes_b, raw), strict=True)]
            self.young.update((c, (array("i", x).tobytes(), array("i", y).tobytes()) if z else None) for c, x, y, z in zip(some, a, b, right, strict=True))

    def give(self, ids: list[list[int]], known: dict[int, bytes], raw: list[bytes]) -> list[bool]:
        """Whether the ids' bytes are those of the stretches."""
        found = [known.get(i, b"") for i in chain.from_iterable(ids)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))[np.append(0, np.cumsum(sizes))]
        whole = b"".join(found)
        if whole == b"".join(raw) and (np.diff(ends) == np.fromiter(map(len, raw), np.int64, len(raw))).all():
            return [True] * len(raw)
        return [whole[low:high] == r for low, high, r in zip(ends.tolist(), ends[1:].tolist(), raw, strict=False)]

    def of(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        if len(self.young) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.old, self.young, self.chars = self.young, {}, 0
        young, old = self.young, self.old
        fresh = [c for c in chunks if c not in young]
        young.update((c, old[c]) for c in fresh if c in old)
        self.learn([c for c in fresh if c not in old])
        self.chars += sum(map(len, fresh))
        return [young[c] for c in chunks]


_CHUNKS: dict[tuple[str, str], Chunks] = {}


def packed(values: np.ndarray | bytes) -> bytes:
    """Their size in bytes, and the bytes compressed."""
    raw = bytes(values)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(column: pa.Array | pa.ChunkedArray, row: int) -> np.ndarray:
    raw = memoryview(column[row].as_buffer())
    return np.frombuffer(pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd"), "<i4")


class Block:
    """Texts, as numbers of stretches, and the ids of these, until it is given out."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}  # of each stretch; -1 where its tokens are not its bytes
        self.ids: list[bytes] = []
        self.sizes: list[int] = []
        self.rows: list[pa.Array] = []
        self.doc_ids: list[pa.Array] = []
        self.texts: list[np.ndarray] = []
        self.chars = 0

    def add(self, rows: pa.Array, doc_ids: pa.Array, texts: list[str], chunks: Chunks) -> None:
        cut = [chunks.cut(t) if t else [] for t in texts]
        numbers = self.numbers
        fresh = list(set().union(*cut) - numbers.keys())
        for chunk, found in zip(fresh, chunks.of(fresh), strict=True):
            if found is None:
                numbers[chunk] = -1
                continue
            numbers[chunk] = len(self.ids)
            self.ids.append(found[0] + found[1])
            self.sizes += len(found[0]) // 4, len(found[1]) // 4
        for c in cut:
            numbered = np.fromiter(map(numbers.__getitem__, c), np.int32, len(c))
            self.texts.append(numbered if not len(c) or numbered.min() >= 0 else numbered[:0])
        self.rows.append(rows)
        self.doc_ids.append(doc_ids)
        self.chars += sum(map(len, texts))

    def full(self, stretches: int, chars: int) -> bool:
        return len(self.numbers) > stretches or self.chars > chars

    def given(self) -> pa.RecordBatch:
        rows, doc_ids = pa.concat_arrays(self.rows), pa.concat_arrays(self.doc_ids)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        data = [pa.array([packed(np.array(d, "<i4"))], pa.binary()) for d in ([len(t) for t in self.texts], np.concatenate(self.texts))]
        sizes, ids = np.array(self.sizes, np.int64).reshape(-1, 2), np.frombuffer(b"".join(self.ids), "<i4")
        listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes.sum(axis=1))), pa.int32()), pa.array((ids - 32768).astype(np.int16)))
        return pa.RecordBatch.from_arrays([rows[:1], one(rows), one(doc_ids), *data, one(pa.array(sizes[:, 0], pa.int32())), one(listed)], names=["block", "rows", "doc_ids", "texts", "numbers", "n_a", "ids"])


def blocks(docs: DataFrame, byte_file: str, piece_file: str, id_column: str, text: str) -> DataFrame:
    """block (a number of its own), rows (a number of its own for each row of docs) and doc_ids; texts and numbers: how many stretches each text has, and all of them, as packed little-endian 32-bit numbers; of each stretch n_a, how many ids A has, and ids, A's and then B's, as 16 bits and less 32768."""
    kind = docs.schema[id_column].dataType
    limits = BLOCK_STRETCHES, BLOCK_CHARS
    fields = [T.StructField("doc_ids", T.ArrayType(kind), False), *T.StructType.fromDDL("texts binary NOT NULL, numbers binary NOT NULL, n_a array<int> NOT NULL, ids array<array<smallint>> NOT NULL").fields]
    schema = T.StructType([T.StructField("block", T.LongType(), False), T.StructField("rows", T.ArrayType(T.LongType()), False), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _CHUNKS.get((byte_file, piece_file)) or _CHUNKS.setdefault((byte_file, piece_file), Chunks(byte_file, piece_file))
        held = Block()
        for batch in batches:
            texts = as_array(batch.column(2))
            for low, high in passes(texts):
                held.add(batch.column(0)[low:high], batch.column(1)[low:high], texts[low:high].to_pylist(), chunks)
                if held.full(*limits):
                    yield held.given()
                    held = Block()
        if held.rows:
            yield held.given()
        del held
        chunks.young, chunks.old, chunks.chars = {}, {}, 0
        give_back()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def stretches(held: DataFrame) -> DataFrame:
    """block, weight (the same in all of a block), stretch (its place there), n_a and ids of the blocks' stretches."""
    # the weight is of the columns that are not needed here, and blocks without stretches stay, so that all sides read the same shuffle
    weight = F.size("rows") + F.size("doc_ids") + F.octet_length("texts") + F.octet_length("numbers")
    each = held.sortWithinPartitions("block").select("block", weight.alias("weight"), "n_a", F.posexplode_outer("ids").alias("stretch", "ids"))
    return each.withColumn("n_a", F.get("n_a", F.col("stretch")))


def ends(rows: DataFrame, ids: Column, lengths: DataFrame, name: str) -> DataFrame:
    """block, weight, stretch, end, and how many tokens of the side end up to there."""
    placed = rows.select("block", "weight", "stretch", F.posexplode(ids).alias("pos", "id")).join(F.broadcast(lengths), "id")
    so_far = Window.partitionBy("block", "weight", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select("block", "weight", "stretch", F.sum("length").over(so_far).alias("end"), (F.col("pos") + 1).alias(name))


def cuts(held: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """in_block, stretch, and how many tokens of A and of B end up to each cut (a, b)."""
    rows = stretches(held)
    # one row for each id of a vocabulary
    lengths = [held.sparkSession.createDataFrame(sorted((i - 32768, len(v)) for i, v in known.items()), "id smallint, length long") for known in (byte_vocabulary(byte_file), piece_vocabulary(piece_file))]
    a = ends(rows, F.slice("ids", F.lit(1), F.col("n_a")), lengths[0], "a")
    b = ends(rows, F.slice("ids", F.col("n_a") + 1, F.size("ids") - F.col("n_a")), lengths[1], "b")
    return a.join(b, ["block", "weight", "stretch", "end"]).select(F.col("block").alias("in_block"), "stretch", "a", "b")


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, and so on for all."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


@lru_cache(maxsize=1)
def written_ids() -> list[str]:
    """Each id of 16 bits with a comma, a bar and a semicolon behind it."""
    return [f"{i}{c}" for i in range(1 << 16) for c in ",|;"]


@dataclass
class Groups:
    """A block's texts and the groups of its stretches."""

    rows: pa.Array
    doc_ids: pa.Array
    sizes: np.ndarray  # stretches of each text
    numbers: np.ndarray  # of the texts' stretches
    tokens: np.ndarray  # of each stretch: A's, B's
    ids: np.ndarray
    first: np.ndarray  # each stretch's first group; one more entry at the end
    starts: np.ndarray  # of each group where A's ids and B's begin
    counts: np.ndarray  # and how many they are

    @classmethod
    def of(cls, block: pa.Table, found: pa.Table) -> Groups:
        lists = lambda c: block.column(c).combine_chunks().flatten()
        sizes, numbers, listed = unpacked(block.column("texts"), 0), unpacked(block.column("numbers"), 0), lists("ids")
        ids, n_a, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (listed.flatten(), lists("n_a"), listed.value_lengths()))
        ids, tokens = (ids + 32768).astype(np.int32), np.stack([n_a, n - n_a], axis=1)
        stretch, a, b = (found.column(c).to_numpy().astype(np.int64) for c in ("stretch", "a", "b"))
        order = np.lexsort((a, stretch))
        stretch, upto = stretch[order], np.stack([a[order], b[order]], axis=1)
        first = np.searchsorted(stretch, np.arange(len(tokens) + 1))
        before = np.concatenate([np.zeros((1, 2), np.int64), upto[:-1]])[: len(upto)]
        before[first[:-1][np.diff(first) > 0]] = 0
        at = np.cumsum(tokens.sum(axis=1)) - tokens.sum(axis=1)
        begin = np.stack([at, at + tokens[:, 0]], axis=1)[stretch]
        return cls(lists("rows"), lists("doc_ids"), sizes, numbers, tokens, ids, first, begin + before, upto - before)

    def summed(self, of_stretches: np.ndarray) -> np.ndarray:
        """For each text the sum over its stretches."""
        so_far = np.append(0, np.cumsum(of_stretches[self.numbers]))
        ends = np.cumsum(self.sizes)
        return so_far[ends] - so_far[ends - self.sizes]

    def of_stretches(self, of_groups: np.ndarray) -> np.ndarray:
        so_far = np.append(0, np.cumsum(of_groups))
        return so_far[self.first[1:]] - so_far[self.first[:-1]]

    def listed(self) -> pa.Array:
        """Each text's groups, as ids."""
        sides = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(self.counts[:, k])), pa.int32()), pa.array(self.ids[runs(self.starts[:, k], self.counts[:, k])], pa.int32())) for k in (0, 1)]
        each = pa.ListArray.from_arrays(pa.array(self.first, pa.int32()), pa.StructArray.from_arrays(sides, names=["a", "b"])).take(pa.array(self.numbers))
        return pa.ListArray.from_arrays(each.offsets.take(pa.array(np.append(0, np.cumsum(self.sizes)))), each.values)

    def digests(self) -> list[str]:
        """The SHA-256 of each text's groups as `a1,a2|b1;a3|b2,b3`; '' without groups."""
        sizes = self.counts.reshape(-1)  # A's tokens of a group, then B's
        at = runs(self.starts.reshape(-1), sizes)
        mark = np.zeros(len(at), np.int64)
        mark[np.cumsum(sizes) - 1] = np.tile([1, 2], len(self.counts))
        words = written_ids()
        told = [words[i] for i in (self.ids[at] * 3 + mark).tolist()]
        ends = np.append(0, np.cumsum(self.counts.sum(axis=1)))[self.first].tolist()
        stretches = ["".join(told[low:high]) for low, high in zip(ends, ends[1:], strict=False)]
        numbers, out, low = self.numbers.tolist(), [], 0
        for size in self.sizes.tolist():
            whole = "".join([stretches[i] for i in numbers[low : low + size]])
            out.append(hashlib.sha256(whole[:-1].encode()).hexdigest() if whole else "")
            low += size
        return out

    def pairs(self, listed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links of the stretches: in order of the stretch, the id pair a * 2**32 + b, and how many links it stands for."""
        n_a, n_b = self.counts.T
        some = np.flatnonzero(n_a * n_b <= listed)
        size = (n_a * n_b)[some]
        group, at = np.repeat(some, size), runs(np.zeros(len(some), np.int64), size)
        x, y = self.ids[self.starts[group, 0] + at // n_b[group]], self.ids[self.starts[group, 1] + at % n_b[group]]
        groups, p, m = [group], [x.astype(np.int64) << 32 | y], [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(n_a * n_b > listed).tolist():
            (x, c), (y, d) = (np.unique(self.ids[self.starts[g, k] : self.starts[g, k] + self.counts[g, k]], return_counts=True) for k in (0, 1))
            p.append((x.astype(np.int64)[:, None] << 32 | y).ravel())
            m.append((c[:, None] * d).ravel())
            groups.append(np.full(len(p[-1]), g))
        stretch = np.repeat(np.arange(len(self.tokens)), np.diff(self.first))[np.concatenate(groups)]
        order = np.argsort(stretch, kind="stable")
        return stretch[order], np.concatenate(p)[order], np.concatenate(m)[order]

    def links(self, listed: int) -> pa.Array:
        """For each text its distinct id pairs (p) and how many links they stand for (m)."""
        stretch, p, m = self.pairs(listed)
        first = np.searchsorted(stretch, np.arange(len(self.tokens) + 1))
        size = np.diff(first)[self.numbers]
        at = runs(first[:-1][self.numbers], size)
        text = np.repeat(np.repeat(np.arange(len(self.sizes)), self.sizes), size)
        known, place = np.unique(p, return_inverse=True)
        key = text * len(known) + place[at]
        if (m == 1).all():
            key.sort()
            where = np.flatnonzero(np.diff(key, prepend=-1))
            times = np.diff(np.append(where, len(key)))
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
            where = np.flatnonzero(np.diff(key, prepend=-1))
            times = np.add.reduceat(m[at[order]], where) if len(where) else where
        text, place = np.divmod(key[where], max(1, len(known)))
        struct = pa.StructArray.from_arrays([pa.array(known[place]), pa.array(times)], names=["p", "m"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(self.sizes) + 1)), pa.int32()), struct)


def assembled(docs: DataFrame, byte_file: str, piece_file: str, id_column: str, text: str, schema: str, finish: Callable[[Groups], list[pa.Array]]) -> DataFrame:
    """doc_id, row, n_a, n_b and what `finish` makes of a block (columns of the schema) for each row of docs. Where it is planned under `co_located` the blocks are shuffled once, and nothing else."""
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = blocks(docs, byte_file, piece_file, id_column, text).repartition(parts, "block")
    columns = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), *T.StructType.fromDDL(f"row long, n_a int, n_b int, {schema}").fields])

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        g = Groups.of(block, found)
        counts = [pa.array(g.summed(g.tokens[:, k]), pa.int32()) for k in (0, 1)]
        return pa.Table.from_arrays([g.doc_ids, g.rows, *counts, *finish(g)], names=columns.names)

    return held.groupBy("block").cogroup(cuts(held, byte_file, piece_file).groupBy("in_block")).applyInArrow(run, columns)


def align(docs: DataFrame, byte_file: str, piece_file: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, n_a, n_b and groups (array of the ids `a` and `b` of each group, in order) of each row."""
    return assembled(docs, byte_file, piece_file, id_column, text, "groups array<struct<a:array<int>,b:array<int>>>", lambda g: [g.listed()])


@contextmanager
def co_located(spark: SparkSession):
    """Plans made here join what is dealt out by a part of the join's keys where it lies."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def measured(docs: DataFrame, byte_file: str, piece_file: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    A pair's count is the number of rows that hold it linked; n_best counts links whose count is the highest of
    their A id, and count_sum adds the counts of all links.
    """
    spark, listed = docs.sparkSession, LISTED
    told = lambda g: [pa.array(g.summed(np.diff(g.first))), pa.array(g.summed(g.of_stretches(g.counts[:, 0] * g.counts[:, 1]))), pa.array(g.digests(), pa.string()), g.links(listed)]
    with co_located(spark):
        rows = written(assembled(docs, byte_file, piece_file, id_column, text, "n_groups long, n_links long, groups_sha256 string, links array<struct<p:long,m:long>>", told), codec="zstd")

    counts = rows.select(F.explode("links.p").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("count"))
    counts = written(counts)
    highest = counts.groupBy(F.shiftright("p", 32).alias("a")).agg(F.max("count").alias("highest"))
    marked = counts.withColumn("a", F.shiftright("p", 32)).join(highest, "a").select("p", "count", (F.col("count") == F.col("highest")).alias("best"))
    if counts.count() <= SENT_PAIRS:
        marked = F.broadcast(marked)
    each = rows.select("row", F.explode("links").alias("link")).select("row", "link.p", "link.m")
    best = F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best")
    sums = each.join(marked, "p").groupBy("row").agg(best, F.sum(F.col("m") * F.col("count")).alias("count_sum"))
    long = lambda c: F.col(c).cast("long").alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("links").join(sums, "row", "left").select("doc_id", long("n_a"), long("n_b"), long("n_groups"), long("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
