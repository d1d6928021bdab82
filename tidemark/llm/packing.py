"""Best-fit packing by exact complements.

A document is its token ids and an end id; one that is longer than a sequence is cut into whole sequences
and a rest. Packing works on how many pieces there are of each length. Lengths and sums of pairs are
indexed by hash, and the sum of a triple is looked up as a length and the pair sum that is then missing; a
sequence that begins with the longest piece left looks up the combination that fills its gap exactly, and takes
it as often as the counts allow. What no combination fills is packed by best fit. Where best fit alone takes
fewer sequences its plan is taken; the column `plan` says which it was. The plan holds one entry for each kind of sequence, of which there are as many
as lengths, not pieces. Pieces find their place in it by their rank among pieces of their length.

Defined results: a null text is an empty one, whose piece is the end id alone; equal texts and repeated rows
are pieces of their own; an empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

import bisect
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_array, give_back, ordered_prefix, passes, written

#: Bytes of text that are cut into chunks at a time; the larger, the fewer chunks are looked up again.
TEXTS_BYTES = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids binary"
#: Chunks between spaces whose ids a worker remembers, and characters of them, in each of two generations.
REMEMBERED = 160_000
REMEMBERED_CHARS = 8 << 20
_KNOWN: dict[str, ChunkIds] = {}
_TOKENIZERS: dict = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


#: Byte-level vocabularies write the bytes 33-126, 161-172 and 174-255 as the characters of those numbers, and the other bytes, in order, as those from 256 on.
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174))}


class ChunkIds:
    """Ids of the chunks of text between spaces, as little-endian unsigned 32-bit integers.

    The tokenizer lower-cases, and none of its merges crosses a space, a line end or the border between a
    letter and a mark; so a chunk is encoded once, and one that ends in a mark is its letters and the mark.
    When a generation is full it becomes the old one, and only what is used again comes over.
    """

    def __init__(self, path: str):
        self.encode = tokenizer(path).encode_batch_fast
        self.merge = tokenizer(path).model.tokenize
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = 0

    def learn(self, chunks: set[str]) -> None:
        young, old = self.young, self.old
        absent = []
        for c in chunks:
            got = old.get(c)
            if got is None:
                absent.append(c)
            else:
                young[c] = got
        stems = {c: c[:-1] for c in absent if len(c) > 1 and c[-1] in ".,;:!?" and c[-2].isalpha()}
        plain = {*absent} - stems.keys() | {c[-1] for c in stems} | {*stems.values()}
        order = []
        merge, stable = self.merge, unicodedata.is_normalized
        for c in plain:
            if c in young:
                continue
            if c in old:
                young[c] = old[c]
            elif c.isalpha() and c == c.lower() and stable("NFC", c):
                # letters alone are one word for the tokenizer, so its merges can be asked without the steps before them
                young[c] = array("I", [t.id for t in merge(c if c.isascii() else c.encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
            else:
                order.append(c)
        for low in range(0, len(order), 8192):
            part = order[low : low + 8192]
            for chunk, got in zip(part, self.encode(part, add_special_tokens=False), strict=True):
                young[chunk] = np.array(got.ids, "<u4").tobytes()
        for c, stem in stems.items():
            young[c] = young[stem] + young[c[-1]]

    def rest(self) -> None:
        """Between partitions nothing is kept: workers live on while other stages need the memory."""
        self.old, self.young, self.chars = {}, {}, 0

    def of(self, texts: list[str]) -> list[bytes]:
        # str.lower is the tokenizer's own lower-casing but for the sigma that ends a word
        split = [(t if "\u03a3" in t else t.lower()).replace("\n", " ").split(" ") for t in texts]
        if len(self.young) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.old, self.young, self.chars = self.young, {}, 0
        fresh = set().union(*split) - self.young.keys()
        if fresh:
            self.learn(fresh)
            self.chars += sum(map(len, fresh))
        young = self.young
        return [b"".join([young[c] for c in chunks]) for chunks in split]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    if path not in _KNOWN:
        _KNOWN[path] = ChunkIds(path)
    return _KNOWN[path].of(texts)


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int = 0, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids of every piece of at most `size` tokens; one pass, no shuffle."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in passes(as_array(whole.column(1)), TEXTS_BYTES):
                batch = whole.slice(low, high - low)
                rows = []
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc, ids in zip(batch.column(0).to_pylist(), encode_texts(texts, path), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        rows.append((doc, piece, at // 4, len(part) // 4, part))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids"])
        if path in _KNOWN:
            _KNOWN[path].rest()
        give_back()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def plan_sequences(counts: dict[int, int], size: int) -> tuple[list[tuple[tuple[int, ...], int]], str]:
    """[(lengths of a sequence, how many such sequences)] that use up the counts, and its name: complements, or best fit where that alone takes fewer sequences."""
    plans = [(fill_sequences(counts, size, name == "complements"), name) for name in ("complements", "best fit")]
    return min(plans, key=lambda plan: sum(times for _, times in plan[0]))


def fill_sequences(counts: dict[int, int], size: int, complements: bool = True) -> list[tuple[tuple[int, ...], int]]:
    """From the longest length down: alone if it fills the sequence, else with one, two or three pieces whose lengths sum to the gap, else with whatever fits best."""
    left = {n: c for n, c in counts.items() if c > 0}
    plan: list[tuple[tuple[int, ...], int]] = []
    pair_sums: dict[int, list[tuple[int, int]]] = defaultdict(list)
    lengths = sorted(left)
    for i, a in enumerate(lengths):
        for b in lengths[i:]:
            if a + b >= size:
                break
            pair_sums[a + b].append((a, b))

    def often(parts: tuple[int, ...]) -> int:
        need: dict[int, int] = defaultdict(int)
        for p in parts:
            need[p] += 1
        return min(left.get(p, 0) // n for p, n in need.items())

    def take(parts: tuple[int, ...], times: int) -> None:
        plan.append((parts, times))
        for p in parts:
            left[p] -= times

    def live_pair(total: int, also: tuple[int, ...]) -> tuple[int, int] | None:
        """The stored pair of this sum that the counts still hold beside `also`; pairs that are used up are dropped."""
        pairs = pair_sums.get(total, [])
        while pairs and (not left.get(pairs[-1][0]) or not left.get(pairs[-1][1])):
            pairs.pop()
        return next((p for p in reversed(pairs) if often((*also, *p))), None)

    for longest in reversed(lengths):
        while left[longest] > 0:
            gap = size - longest
            if gap == 0:
                take((longest,), left[longest])
                continue
            if complements and often((longest, gap)):
                take((longest, gap), often((longest, gap)))
                continue
            if complements and (pair := live_pair(gap, (longest,))):
                take((longest, *pair), often((longest, *pair)))
                continue
            triple = None
            for third in (n for n in lengths if complements and n < gap and left[n]):
                if pair := live_pair(gap - third, (longest, third)):
                    triple = (longest, third, *pair)
                    break
            if triple:
                take(triple, often(triple))
                continue
            # best fit: fill what is left with the longest piece that fits, again and again
            parts, room = [longest], gap
            used: dict[int, int] = defaultdict(int, {longest: 1})
            at = bisect.bisect_right(lengths, room) - 1
            while at >= 0 and room > 0:
                n = lengths[at]
                if n <= room and left[n] > used[n]:
                    parts.append(n)
                    used[n] += 1
                    room -= n
                    at = min(at, bisect.bisect_right(lengths, room) - 1)
                else:
                    at -= 1
            take(tuple(parts), often(tuple(parts)))
    return plan


class Places:
    """Where the r-th piece of a length goes: the plan as sorted first ranks for each length."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        taken: dict[int, int] = defaultdict(int)
        base = 0
        for parts, times in plan:
            offset = 0
            for n in parts:
                rows[n].append((taken[n], base, offset))
                taken[n] += times
                offset += n
            base += times
        self.sequences = base
        self.by_length = {n: np.array(x, np.int64) for n, x in rows.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            table = self.by_length[int(n)]
            row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
            sequence[at] = row[:, 1] + rank[at] - row[:, 0]
            offset[at] = row[:, 2]
        return sequence, offset


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """pieces (doc_id, piece, length and other columns) with sequence_id, offset and plan.

    The driver holds a count for each length, at most `size` of them, and a plan of about as many entries.
    """
    table = written(pieces)
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, kind = plan_sequences(counts, size)
    places = Places(plan)
    names = pieces.columns

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        sequence, offset = places.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ordered_prefix(table, "length", [F.col("doc_id"), F.col("piece")], "length", "rank", "_before", place, schema)[0].withColumn("plan", F.lit(kind))
