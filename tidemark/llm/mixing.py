"""Log-probabilities of texts by online logistic context mixing.

A text is its words, lower-cased (A-Z), and an end. Each is written as bits, the steps down a Huffman tree over the
WORDS most frequent words and an escape. What escapes is a word by its share of all rarer words, one more for each and
for all unknown ones. Every step is a bit that several predictors guess. A predictor is a table of hashed
contexts: it knows from all training texts how often the bit was 0 and 1 at this node of the tree after this context
(nothing; the word before; the last very frequent word; the last two of those; the two words before), and says the
logistic of that. The guesses are added with weights that a gate chooses, by the depth of the step and whether the
word before is frequent, and the sum's logistic is the probability. While a text is scored its weights are refined:
after each stretch, of 64 tokens and then twice as many each time, they move along the gradient of that stretch's
bits. A text's score depends on the model and the text alone; its bits are the score over log10(2), and `bits_per_byte`
is those over its length.

Training is two aggregates over all training texts. Words: each task adds up hashes and counts, which are summed by
hash; this table grows with the corpus and is never collected: it gives the base score and the shares of rarer words
by a join. Contexts: each task adds up bits in tables of `SLOTS` entries for each predictor and sends them on in
blocks, which are summed by block in a stream; what comes to the driver and goes to all tasks is a byte a slot and
the most frequent words, whatever the input's size. Weights are learned by each task on every stretch of its
texts before it is counted, so from texts that its counts have not seen, and averaged.

Defined results: a null text is an empty one, whose tokens are the end alone; repeated rows count and are scored each;
rows that share an id are texts of their own; texts are read whole. Words are told apart by 64-bit hashes. Without
training texts every count is nought and every bit even. An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, as_array, give_back, hashed, passes, text_bytes, words_of

#: The most frequent words, which have codes of their own; entries of each predictor's table; predictors; kinds of steps.
WORDS, SLOTS, PREDICTORS, GATES = 1 << 16, 1 << 21, 5, 8
#: Words, by frequency, that are contexts as the word before; and as the last very frequent word. Rarer ones are one context.
CONTEXT_WORDS, SAID_WORDS = 2047, 255
ESCAPE, END = 0, 1
END_HASH = np.uint64(0x5BD1E9955BD1E995)
#: Bytes of text whose bits are one numpy pass; the weights' step; slots of a block; guesses, in steps of 1/16.
PASS, RATE, BLOCK, GUESSES = 1 << 18, 0.02, 1 << 13, (np.arange(256, dtype=np.float32) - 128) / 16
#: Words that a task adds up before it sends them on.
MOST_COUNTS, ONE = 1 << 20, np.int32(1)


def huffman(weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol where its path through the `most` heaviest nodes starts and how long it is; the nodes and bits of all paths; and each symbol's share of the weight under its path's end. The root is node 0, and heavier nodes come first."""
    n = len(weights)
    parent, side, weight = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8), np.concatenate([weights, np.zeros(n - 1, np.int64)])
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    for inner in range(n, 2 * n - 1):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[[x, y]], side[y], weight[inner] = inner, 1, a + b
        heapq.heappush(heap, (a + b, inner))
    root, at, steps = 2 * n - 2, np.arange(n), []
    under = weights.astype(np.int64)
    while (at != root).any():
        node = np.where(at != root, 2 * n - 2 - parent[at], -1)
        under = np.where(node >= most, weight[parent[at]], under)
        steps.append((np.where(node < most, node, -1), side[at]))
        at = np.where(at != root, parent[at], root)
    nodes, bits = (np.stack([s[i] for s in reversed(steps)], axis=1) for i in (0, 1))
    there = nodes >= 0
    lengths = there.sum(axis=1)
    return np.cumsum(lengths) - lengths, lengths, nodes[there].astype(np.uint32), bits[there], weights / under


@dataclass
class Codes:
    """The tree, and which words have a path of their own. Symbols: the escape, the end, and words by frequency."""

    hashes: np.ndarray  # of the words, sorted
    symbols: np.ndarray
    counts: np.ndarray  # by symbol
    paths: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    shares: np.ndarray  # nats of each symbol below its path
    total: int  # N, all training tokens
    distinct: int  # V

    @classmethod
    def of(cls, words: list[tuple[int, int]], ends: int, total: int, distinct: int) -> Codes:
        """words: hash and count, most frequent first."""
        h = np.array([w[0] for w in words], np.int64).view(np.uint64)
        c = np.array([w[1] for w in words], np.int64)
        weights = np.concatenate([[max(1, total - ends - int(c.sum())), max(1, ends)], c])
        order = np.argsort(h)
        *paths, share = huffman(weights, len(weights))  # every bit of every path is guessed
        return cls(h[order], (order + 2).astype(np.int32), np.concatenate([[0, ends], c]), tuple(paths), -np.log(share), total, distinct)

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.symbols[at], ESCAPE).astype(np.int32)


@dataclass
class Steps:
    """The bits of some texts: each one's slot in each predictor's table, its text and gate, its stretch."""

    slots: np.ndarray  # predictor, bit
    bits: np.ndarray
    text: np.ndarray
    place: np.ndarray  # text * GATES + gate
    stretch: np.ndarray
    texts: int
    rest: np.ndarray  # nats of each text's words below their paths


def spread(context: np.ndarray) -> np.ndarray:
    return (context * np.uint32(0x9E3779B1)) ^ ((context * np.uint32(0x85EBCA6B)) >> np.uint32(15))


def tokens_of(column: pa.Array, codes: Codes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The hashes of all texts' tokens, each text's first token, and the tokens' symbols."""
    spaced, starts, ends, begin = words_of(column)
    at = begin[1:]
    hashes = np.insert(hashed(spaced, starts, ends), at, END_HASH)
    symbols = codes.symbols_of(hashes) if codes else None
    if codes:
        symbols[at + np.arange(len(at))] = END
    return hashes, begin + np.arange(len(begin)), symbols


def contexts(symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each token what was said before it in its text: the word before, the last very frequent word, the last two of those, the two words before."""
    numbers = np.arange(len(symbols), dtype=np.int32)
    first = np.repeat(begin[:-1].astype(np.int32), np.diff(begin))
    word = lambda at: np.where(at >= first, symbols[np.maximum(at, 0)], END).astype(np.uint32)
    one, two = word(numbers - 1), word(numbers - 2)
    until = np.maximum.accumulate(np.where((symbols > END) & (symbols <= SAID_WORDS), numbers, -1)).astype(np.int32)
    before = lambda at: np.where(at > 0, until[np.maximum(at, 1) - 1], -1)
    last = before(numbers)
    said = word(last)
    return np.minimum(one, CONTEXT_WORDS), said, said << np.uint32(8) | word(before(last)), spread(one) + two


def steps_of(symbols: np.ndarray, begin: np.ndarray, codes: Codes, slots: int) -> Steps:
    texts = len(begin) - 1
    text = np.repeat(np.arange(texts, dtype=np.int32), np.diff(begin))
    number = np.arange(len(symbols), dtype=np.int32) - np.repeat(begin[:-1].astype(np.int32), np.diff(begin))
    stretch = np.log2(number / 64 + 1).astype(np.uint8)
    known = contexts(symbols, begin)

    starts, lengths, nodes, bits = codes.paths
    n = lengths[symbols]
    of = np.repeat(np.arange(len(symbols), dtype=np.int32), n)
    depth = np.arange(len(of), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
    at = starts.astype(np.int32)[symbols][of] + depth
    node = nodes[at]
    mark = spread(node + np.uint32(1))
    shift, table = np.uint32(33 - slots.bit_length()), np.empty((PREDICTORS, len(of)), np.uint32)
    table[0] = (mark * np.uint32(0xC2B2AE35)) >> shift
    for k, context in enumerate(known, 1):
        x = spread(context + np.uint32(k << 24))[of]
        x ^= mark
        x *= np.uint32(0xC2B2AE35)
        table[k] = x >> shift
    gate = np.minimum(depth >> 1, 6) + (known[0] == CONTEXT_WORDS)[of]
    text_of = text[of]
    return Steps(table, bits[at], text_of, text_of * GATES + gate, stretch[of], texts, np.bincount(text, codes.shares[symbols], texts))


def mixed_bits(steps: Steps, guess: Callable[[int, np.ndarray], np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nats of each text, and each text's weights at its end. guess: what a predictor says at its slots; weights: gate, predictor."""
    own = np.tile(weights.T, steps.texts).astype(np.float32)  # predictor, text and gate
    nats = steps.rest.copy()
    whole = not len(steps.stretch) or not steps.stretch.any()
    order = np.arange(len(steps.bits)) if whole else np.argsort(steps.stretch, kind="stable")
    bounds = np.flatnonzero(np.diff(steps.stretch[order].astype(np.int16), prepend=-1, append=-1)).tolist() if len(order) else []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        some = order[low:high]
        of = lambda column: column if whole else column.take(some)  # noqa: B023, E731
        place, sign = of(steps.place), of(steps.bits).astype(np.float32) * 2 - 1
        guesses = [guess(k, of(steps.slots[k])) for k in range(PREDICTORS)]
        z = own[0].take(place) * guesses[0]
        for k in range(1, PREDICTORS):
            z += own[k].take(place) * guesses[k]
        right = 1 / (1 + np.exp(-np.clip(z * sign, -14, 14)))  # the probability of what came
        nats -= np.bincount(of(steps.text), np.log(right), steps.texts)
        error = (1 - right) * sign
        rate = RATE / np.sqrt(np.bincount(place, minlength=own.shape[1]) + 16)
        for k, g in enumerate(guesses):
            own[k] += rate * np.bincount(place, error * g, own.shape[1])
    return nats, own.T


def logistic(counts: np.ndarray) -> np.ndarray:
    """The logistic of how often a bit was 1. counts: ..., bit."""
    return np.log((counts[..., 1] + np.float32(0.4)) / (counts[..., 0] + np.float32(0.4)))


def logistic_at(counts: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The logistic of counts[slots], in 32 bits. counts: slot, bit, little-endian."""
    pairs = counts.view(np.int64).reshape(-1).take(slots)
    one = (pairs >> 32).astype(np.float32)
    one += np.float32(0.4)
    zero = pairs.astype(np.int32).astype(np.float32)  # the lower half
    zero += np.float32(0.4)
    one /= zero
    return np.log(one, out=one)


def guessed(counts: np.ndarray) -> np.ndarray:
    """The same as numbers of GUESSES."""
    return np.clip(np.rint(logistic(counts) * 16) + 128, 0, 255).astype(np.uint8)


def learned(weights: np.ndarray, steps: Steps, own: np.ndarray) -> np.ndarray:
    """weights, moved towards those of the texts at their ends."""
    seen = np.bincount(steps.place, minlength=len(own)).reshape(-1, GATES, 1)
    mean = (own.reshape(-1, GATES, PREDICTORS) * seen).sum(0) / np.maximum(seen.sum(0), 1)
    return np.where(seen.sum(0) > 0, weights + 0.2 * (mean - weights), weights).astype(np.float32)


def add_up(steps: Steps, counts: np.ndarray) -> None:
    """counts: predictor, slot, bit."""
    for k in range(PREDICTORS):
        np.add.at(counts[k].reshape(-1), (steps.slots[k] * 2 + steps.bits).astype(np.intp), ONE)


def even_weights() -> np.ndarray:
    return np.full((GATES, PREDICTORS), 0.3, np.float32)


def word_counts(docs: DataFrame) -> DataFrame:
    """h, c: how often each token of the texts occurs, by its hash. docs: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            hashes, where = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return hashes, np.bincount(where, np.concatenate([c for _, c in held])).astype(np.int64)

        def rows(hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["h", "c"])

        for batch in batches:
            texts = as_array(batch.column(0))
            for low, high in passes(texts):
                held.append(np.unique(tokens_of(texts[low:high])[0], return_counts=True))
                size += len(held[-1][0])
                if size > MOST_COUNTS:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > MOST_COUNTS // 2:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*merged())
        give_back()

    return docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def context_counts(docs: DataFrame, codes: Codes) -> DataFrame:
    """block and data: the summed bits of each block of slots (block -1: weights, times the bits they were learned from, and these bits). docs: text."""
    sent = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, weights, learned_from = sent.value, None, even_weights(), 0
        for batch in batches:
            texts = as_array(batch.column(0))
            for low, high in passes(texts, PASS):
                if counts is None:
                    counts = np.zeros((PREDICTORS, SLOTS, 2), np.int32)
                _, begin, symbols = tokens_of(texts[low:high], codes)
                steps = steps_of(symbols, begin, codes, SLOTS)
                # each stretch is guessed by what came before it, and teaches the weights
                _, own = mixed_bits(steps, lambda k, slots: logistic_at(counts[k], slots), weights)
                weights = learned(weights, steps, own)
                learned_from += len(steps.bits)
                add_up(steps, counts)
        if counts is not None:
            blocks = counts.reshape(-1, BLOCK * 2)
            for block in np.flatnonzero(blocks.any(axis=1)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([blocks[block].astype("<i8").tobytes()])], names=["block", "data"])
            summed = np.append(weights.astype(np.float64).ravel() * learned_from, learned_from)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([summed.tobytes()])], names=["block", "data"])
        del counts
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                some = np.frombuffer(data.as_buffer(), "<f8" if block < 0 else "<i8")
                sums[block] = sums[block] + some if block in sums else some.copy()
        for block, data in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data.tobytes() if block < 0 else guessed(data.reshape(-1, 2)).tobytes()])], names=["block", "data"])

    # a stream of blocks is added up, whatever number of tasks sent them
    return docs.mapInArrow(run, "block int, data binary").repartition("block").mapInArrow(add, "block int, data binary")


@dataclass
class Model:
    codes: Codes
    tables: np.ndarray  # predictor, slot, as numbers of GUESSES
    weights: np.ndarray
    words: DataFrame  # h, c of all training tokens: not for tasks


def fit(docs: DataFrame, words: int = WORDS, text: str = "text") -> Model:
    """Learned from all rows of docs. The driver gets the `words` most frequent words and a byte for each slot."""
    texts = docs.select(F.col(text).cast("string").alias("text"))
    tables = Tables(docs.sparkSession)
    counted = tables.write("words", word_counts(texts))
    end = int(END_HASH.view(np.int64))
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("h") == end, F.col("c"))), F.lit(0)).alias("ends")).first()
    top = counted.where(F.col("h") != end).orderBy(F.desc("c"), "h").limit(words).collect()
    codes = Codes.of([(r["h"], r["c"]) for r in top], sums["ends"], sums["n"], sums["v"])
    guesses, weights = np.full(PREDICTORS * SLOTS, 128, np.uint8), even_weights()
    for r in context_counts(texts, codes).toLocalIterator():
        if r["block"] < 0:
            summed = np.frombuffer(r["data"])
            weights = (summed[:-1] / summed[-1]).reshape(weights.shape).astype(np.float32) if summed[-1] else weights
        else:
            guesses[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["data"], np.uint8)
    return Model(codes, guesses.reshape(PREDICTORS, SLOTS), weights, counted)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (null for an empty text) of each row of docs."""
    spark, codes = docs.sparkSession, model.codes
    sent = spark.sparkContext.broadcast((codes, model.tables, model.weights))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, tables, weights = sent.value
        base = np.log10((codes.counts + 1) / (codes.total + codes.distinct + 1))
        base[ESCAPE] = 0  # those words are looked up
        guess = lambda k, slots: GUESSES.take(tables[k].take(slots))
        for batch in batches:
            texts = as_array(batch.column(2))
            for low, high in passes(texts, PASS):
                hashes, begin, symbols = tokens_of(texts[low:high], codes)
                steps = steps_of(symbols, begin, codes, SLOTS)
                nats, _ = mixed_bits(steps, guess, weights)
                of = np.repeat(np.arange(high - low), np.diff(begin))
                rare = symbols == ESCAPE
                ends = np.concatenate([[0], np.cumsum(np.bincount(of[rare], minlength=high - low))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[low:high], batch.column(1)[low:high], pa.array(np.diff(text_bytes(texts[low:high])[1])), pa.array(np.diff(begin)), pa.array(np.bincount(of, ~rare & (codes.counts[symbols] > 0), high - low).astype(np.int64)),
                        pa.array(np.bincount(of, base[symbols], high - low)), pa.array(-nats / np.log(10)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[rare].view(np.int64))),
                    ],
                    names=["row", "doc_id", "n_bytes", "n_tokens", "n_known", "base_score", "score", "rare"],
                )
        give_back()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = Tables(spark).write("scored", rows.mapInArrow(run, f"row long, doc_id {kind}, n_bytes long, n_tokens long, n_known long, base_score double, score double, rare array<long>"))
    c = F.coalesce("c", F.lit(0))
    rarer = codes.total + codes.distinct - int(codes.counts.sum()) - len(codes.counts) + 2 - (codes.counts[END] == 0)  # words that escape, one more for each
    log = lambda whole: F.sum(F.log10((c + 1) / F.lit(float(whole))))
    looked_up = rows.select("row", F.explode("rare").alias("h")).join(model.words, "h", "left").groupBy("row").agg(F.count_if(c > 0).alias("more"), log(codes.total + codes.distinct + 1).alias("base"), log(max(1, rarer)).alias("share"))
    number = lambda name: F.coalesce(name, F.lit(0))
    total = F.col("score") + number("share")
    return rows.join(looked_up, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + number("more")).alias("n_known"), F.lit(codes.total).cast("long").alias("train_tokens"), (F.col("base_score") + number("base")).alias("base_score"), total.alias("score"),
        F.when(F.col("n_bytes") > 0, -total * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
