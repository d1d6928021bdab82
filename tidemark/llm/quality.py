"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its words and of its characters' n-grams, both hashed to
buckets; a softmax over that average gives the score. Vectors and softmax are trained together by stochastic
gradient descent in numpy, on a bounded sample of labelled documents. As the average and the softmax's input
are linear, a trained bucket's vector comes down to one number for scoring: the same score, one gather a
feature.

Defined results: null and empty texts, and texts of white space only, have the one feature "nothing"; equal
texts get equal scores; without labelled rows of both kinds every score is the share of label 1; an empty
table gives an empty one; other columns stay, and columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_array, give_back, labelled_sample, mixed, passes, text_bytes, word_hashes

BITS = 17
GRAMS = (3, 5)
_SPACES = np.zeros(0x3001, bool)
_SPACES[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000]] = True
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
NOTHING = 0
AGAIN = np.uint64(0x5BD1E995 << 32)


def features(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each kind of feature its buckets, text by text, and where each text's begin (one more entry at the end)."""
    raw, offsets = text_bytes(texts)
    count = len(texts)
    first = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # characters before each byte
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    starts = first[offsets]
    if len(chars) != starts[-1]:  # not UTF-8: count bytes as characters
        chars, starts = raw.astype(np.uint32), offsets
    gap = 6  # spaces between texts, so that no n-gram spans two
    spaced = np.full(len(chars) + gap * (count + 1), 32, np.uint32)
    spaced[np.arange(len(chars)) + np.repeat(gap * np.arange(1, count + 1), np.diff(starts))] = chars
    edge = starts + gap * np.arange(count + 1)  # where the spaces before each text begin
    word = ~_SPACES[np.minimum(spaced, 0x3000)]
    kinds = []
    for n in GRAMS:
        at = np.flatnonzero(np.logical_and.reduce([word[i : len(word) - n + i + 1] for i in range(1, n - 1)]))
        h = np.zeros(len(at), np.uint32)
        for i in range(n):
            h = (h ^ spaced[at + i]) * _FACTORS[i]
            h ^= h >> np.uint32(15)
        kinds.append((at, ((h * np.uint32(0x2C1B3C6D + 2 * n)) >> np.uint32(32 - BITS)).astype(np.int32)))
    bounds = [np.searchsorted(at, edge) for at, _ in kinds]
    buckets = [b for _, b in kinds]
    hashes, begin = word_hashes(texts)
    buckets.append((hashes >> np.uint64(64 - BITS)).astype(np.int32))
    bounds.append(begin)
    # pairs of words; a word and itself is the same pair for every word
    inner = np.ones(len(hashes), bool)
    inner[begin[1:][begin[1:] > begin[:-1]] - 1] = False
    at = np.flatnonzero(inner)
    pair = mixed(hashes[at] * np.uint64(3) + hashes[at + 1])
    pair[hashes[at] == hashes[at + 1]] = AGAIN
    buckets.append((pair >> np.uint64(64 - BITS)).astype(np.int32))
    bounds.append(np.searchsorted(at, begin))
    return buckets, bounds


@dataclass(frozen=True)
class Model:
    """weights: a number for each bucket, the product of its vector and the softmax's difference; bias: the rest of the log odds."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for low, high in passes(texts):
            buckets, bounds = features(texts.slice(low, high - low))
            total, number = np.zeros(high - low), np.zeros(high - low)
            for b, bound in zip(buckets, bounds, strict=True):
                sums = np.r_[0.0, np.cumsum(self.weights[b], dtype=np.float64)]
                total += sums[bound[1:]] - sums[bound[:-1]]
                number += np.diff(bound)
            mean = np.where(number > 0, total / np.maximum(number, 1), self.weights[NOTHING])
            out[low:high] = 1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30)))
        return np.round(out, 6)


def train(sample: list[tuple[str, int]], prior: float, dims: int = 8, visits: int = 14_400, batch: int = 16, rate: float = 0.5, seed: int = 5) -> Model:
    """Stochastic gradient descent on the softmax loss, at least `visits` documents in all where six rounds are fewer; a bucket's step is scaled by its own past gradients."""
    size = 1 << BITS
    y = np.array([label for _, label in sample], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size, np.float32), float(np.log(np.clip(prior, 1e-6, 1 - 1e-6) / (1 - np.clip(prior, 1e-6, 1 - 1e-6)))))
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    texts = pa.array([t for t, _ in sample], pa.string())
    for low, high in passes(texts):
        buckets, bounds = features(texts.slice(low, high - low))
        for i in range(high - low):
            ids, n = np.unique(np.concatenate([b[c[i] : c[i + 1]] for b, c in zip(buckets, bounds, strict=True)]), return_counts=True)
            bags.append((ids, (n / n.sum()).astype(np.float32)) if len(ids) else (np.array([NOTHING]), np.ones(1, np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (size, dims)).astype(np.float32)
    softmax, bias = rng.normal(0, 1, (dims, 2)).astype(np.float32), np.zeros(2, np.float32)
    past, past_softmax, past_bias = np.full(size, 1e-8, np.float32), 1e-2, 1e-2
    share_of_ones = y.mean()
    even = np.where(y == 1, 0.5 / share_of_ones, 0.5 / (1 - share_of_ones)).astype(np.float32)  # both labels weigh the same
    for _ in range(max(6, min(30, visits // len(bags)))):
        order = rng.permutation(len(bags))
        for low in range(0, len(order), batch):
            rows = order[low : low + batch]
            ids = np.concatenate([bags[r][0] for r in rows])
            share = np.concatenate([bags[r][1] for r in rows])
            lengths = [len(bags[r][0]) for r in rows]
            begin = np.r_[0, np.cumsum(lengths)[:-1]]
            hidden = np.add.reduceat(vectors[ids] * share[:, None], begin)
            logits = hidden @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= even[rows, None]
            back = p @ softmax.T
            step = np.repeat(back, lengths, axis=0) * share[:, None]
            np.add.at(past, ids, np.square(step).mean(1))
            np.add.at(vectors, ids, -rate * step / np.sqrt(past[ids])[:, None])
            slope = hidden.T @ p / len(rows)
            past_softmax += float(np.square(slope).mean())
            softmax -= rate * 0.1 * slope / np.sqrt(past_softmax)
            slope_bias = p.mean(0)
            past_bias += float(np.square(slope_bias).mean())
            bias -= rate * 0.1 * slope_bias / np.sqrt(past_bias)
    weights = vectors @ (softmax[:, 1] - softmax[:, 0])
    shift = np.log(np.clip(prior, 1e-6, 1 - 1e-6) / (1 - np.clip(prior, 1e-6, 1 - 1e-6)))
    return Model(weights.astype(np.float32), float(bias[1] - bias[0] + shift))


def fit(docs: DataFrame, labels: DataFrame, allowed, rows: int = 2400, max_bytes: int = 12 << 20, longest: int = 40 << 10) -> Model:
    """Learn labels.quality from at most `rows` labelled documents of up to `longest` bytes and `max_bytes` of text in all."""
    return train(*labelled_sample(docs, labels, "quality", allowed, rows, max_bytes, longest))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, a double from 0 to 1. One pass, no shuffle; the model, of a fixed size, goes to each executor once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != "score"]
    at = kept.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(as_array(batch.column(at))))], names=[*kept, "score"])
        give_back()

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(scored, schema)
