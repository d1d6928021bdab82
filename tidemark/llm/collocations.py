"""Phrases whose words stand together more often than chance, by language.

Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and pieces into words `[^\\x20\\x09]+`. All
runs of 1 to `max_words` words of a piece are exploded and counted by hash aggregation, which adds up in every task
before it shuffles, so a frequent phrase or a language of any size is a few rows a task. Most runs are rare and no
answer needs them, so they are exploded twice: first as hashes, whose counts say which runs can occur `least` times
(a filter of BITS bits, which is what goes to all tasks; a full one lets more through), then those as rows with their
words, whose counts are exact. Phrases of two words or more that occur `least` times are candidates. Their cuts join
the counts of both parts, scores are exact decimals, a join with one-word extensions takes out what a longer
candidate covers, and a window ranks what stays; each language is ranked in salted parts first.

Only one-word extensions need be asked: a longer candidate that covers a phrase has an extension of one word
between them, which is at least as frequent and so a candidate that covers it too.

Defined results: a null text has no words; a null language is `und`; repeated rows count each; a phrase ties
with another by count and then by its UTF-8 bytes; texts are read whole, whatever their length; an empty table
gives an empty one; other columns are not read. Within one stretch of text runs are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_array, give_back, hashed, lowered_with, mixed, passes, written

#: Kinds of bytes: 0 stands in words, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
#: Bytes of text that are one numpy pass; hashes that a task adds up before it sends them on; bits of the filter.
PASS, MOST_COUNTS, BITS = 1 << 20, 3 << 20, 1 << 26
#: Parts in which each language is ranked before its first phrases are ranked together.
PARTS = 64
#: A count, and a product of counts.
COUNT, PRODUCT = "decimal(16,0)", "decimal(38,0)"


class Runs:
    """The words of some texts, and the runs of them within pieces."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        self.bytes, begins = lowered_with(texts, 0x2E)  # texts are pieces apart
        kinds = KIND[self.bytes]
        edges = np.flatnonzero(np.diff(kinds == 0, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(kinds == 2)[self.starts]
        self.text = np.searchsorted(begins, self.starts, side="right") - 1
        known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
        self.lang = np.array([known[x] for x in langs], np.uint64)[self.text] if len(self.starts) else np.empty(0, np.uint64)
        self.words = hashed(self.bytes, self.starts, self.ends) if len(self.starts) else np.empty(0, np.uint64)

    def of(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each number of words: where its runs start, and their hashes, which mind the language."""
        rolled = mixed(self.words ^ self.lang)
        for n in range(1, most + 1):
            if n > 1:
                rolled = mixed(rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.words[n - 1 :])
            at = np.flatnonzero(self.piece[: len(rolled)] == self.piece[n - 1 :])
            yield n, at, rolled[at]

    def phrase(self, i: int, n: int) -> str:
        return b" ".join([self.bytes[a:b].tobytes() for a, b in zip(self.starts[i : i + n].tolist(), self.ends[i : i + n].tolist(), strict=True)]).decode("utf-8", "replace")


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Runs, list[str]]]:
    """The runs of each stretch of texts, and the texts' languages. batches: text, lang."""
    for batch in batches:
        texts, langs = as_array(batch.column(0)), batch.column(1).to_pylist()
        for low, high in passes(texts, PASS):
            yield Runs(texts[low:high], langs[low:high]), langs[low:high]


def run_counts(docs: DataFrame, max_words: int) -> DataFrame:
    """h, c: how often each run of words occurs, by its hash. docs: text, lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            hashes, where = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return hashes, np.bincount(where, np.concatenate([c for _, c in held])).astype(np.int64)

        def rows(hashes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for low in range(0, len(hashes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[low : low + (1 << 16)]) for x in (hashes.view(np.int64), counts)], names=["h", "c"])

        for runs, _ in stretches(batches):
            held.append(np.unique(np.concatenate([h for _, _, h in runs.of(max_words)]), return_counts=True))
            size += len(held[-1][0])
            if size > MOST_COUNTS:
                held = [merged()]
                size = len(held[0][0])
                if size > MOST_COUNTS // 2:
                    yield from rows(*held[0])
                    held, size = [], 0
        if held:
            yield from rows(*merged())
        give_back()

    # added up in each task already: another sum before the shuffle would only spill
    return docs.mapInArrow(run, "h long, c long").repartition("h").groupBy("h").agg(F.sum("c").alias("c"))


def frequent(docs: DataFrame, max_words: int, least: int) -> np.ndarray:
    """A bit for each hash, modulo BITS, of the runs that can occur `least` times: BITS / 8 bytes, whatever the input."""
    place = F.pmod("h", F.lit(BITS))
    hot = run_counts(docs, max_words).where(F.col("c") >= least).select(F.shiftright(place, 6).cast("int").alias("word"), (place % 64).cast("int").alias("bit"))
    words = hot.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return bits


def phrase_counts(docs: DataFrame, max_words: int, least: int) -> DataFrame:
    """lang, phrase, f: how often each run of words occurs within pieces, overlaps included, from `least` on; the empty phrase stands for all rarer words. docs: text, lang."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent(docs, max_words, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for runs, langs in stretches(batches):
            out: list[tuple[str, str, int]] = []
            for n, at, hashes in runs.of(max_words):
                places = hashes % np.uint64(BITS)
                kept = (bits[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1) == 1
                _, first, counts = np.unique(hashes[kept], return_index=True, return_counts=True)
                where = at[kept][first]
                out += [(langs[t], runs.phrase(i, n), c) for t, i, c in zip(runs.text[where].tolist(), where.tolist(), counts.tolist(), strict=True)]
                if n == 1:
                    rest = np.bincount(runs.text[at[~kept]], minlength=len(langs)).tolist()
                    out += [(x, "", c) for x, c in zip(langs, rest, strict=True) if c]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "f"])
        give_back()

    rows = docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    exact = rows.where((F.col("f") >= least) | (F.instr("phrase", " ") == 0))
    return exact.groupBy("lang", F.when(F.col("f") >= least, F.col("phrase")).otherwise("").alias("phrase")).agg(F.sum("f").alias("f"))


def exact_score() -> Column:
    """floor(1000000 * a * a / (l * r)) in decimals of 38 digits: exact up to counts of 15 digits."""
    whole = lambda x: f"CAST({x} AS {PRODUCT})"
    square, parts = (f"CAST({a} AS {COUNT}) * CAST({b} AS {COUNT})" for a, b in ("aa", "lr"))
    return F.expr(f"CAST({whole(f'{square} * 1000000')} div {whole(parts)} AS bigint)")


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, covered: int = 50, most: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `most` phrases.

    `a` is the phrase's count, `l` and `r` those of the parts of its weakest cut, `n` the language's words, and
    score floor(1000000 * a * a / (l * r)). A phrase goes where a longer candidate that holds it has `covered`
    per cent of its count.
    """
    docs = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    # a part occurs at least as often as the whole, so nothing rarer is asked for
    known = written(phrase_counts(docs, max_words, least))
    sized = known.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words"))
    candidates = sized.where(F.col("size") > 1)

    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    count_of = lambda side, name: known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cut = cuts.join(count_of("left", "l"), ["lang", "left"]).join(count_of("right", "r"), ["lang", "right"])
    weakest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact_score().alias("score"), "k", "l", "r")).alias("cut"))
    scored = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    extended = candidates.where(F.col("size") > 2).select("lang", F.col("f").alias("more"), F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"))
    covering = extended.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    free = scored.join(covering, ["lang", "phrase"], "left").where(F.col("more").isNull() | (F.col("more") * 100 < F.col("a") * covered)).drop("more")

    first = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = free.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    near = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*first))).where(F.col("rank") <= most)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*first))).where(F.col("rank") <= most)
    totals = known.where(F.instr("phrase", " ") == 0).groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
