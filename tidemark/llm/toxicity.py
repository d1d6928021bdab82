"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

Two words are alike by the gap-weighted subsequences of three characters that they share: a subsequence that
spans s characters weighs DECAY**s, up to SPAN characters, and the kernel is normalised by both words' own
weight. Gaps let an insult with inserted or left-out characters stay near its plain form; a run of single
letters counts as one word too. The machine works in the Nyström space of landmark words with a squared
hinge loss. A text scores as its worst word. It is trained on the words of labelled documents, each a set of
its words: those of clean documents are clean; a toxic document has at least one toxic word, its witness, which
is chosen anew by each round's machine; words of many toxic documents and no clean one are witnesses in every
round, without which recall falls (held out, check_s: 0.87 to 0.99 by the sample, against 0.98 to 1.0). Units
are words and runs of letters, not sentences: an insult that only several words together make is not seen. As
the kernel is a sum over subsequences, a trained machine comes down to one number for each subsequence.

Defined results: null and empty texts, and texts of white space only, score as a text whose words share
nothing with any landmark; very long texts are scored whole; equal texts and repeated rows get equal scores; without labelled rows of both kinds every score is
the share of label 1; an empty table gives an empty one; other columns stay, and columns named like a result
are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_array, give_back, hashed, labelled_sample, passes, words_of

DECAY = 0.7
SPAN = 6
#: a-z are 1-26, other letters and digits share 27-39, and marks are 0, which no subsequence holds.
CLASSES = 40
_ASCII = np.zeros(128, np.int32)
_ASCII[97:123] = np.arange(1, 27)
_ASCII[48:58] = 27 + np.arange(10) % 13
_PAIRS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
#: Bytes of text whose distinct words are scored at a time.
PASS = 1 << 18
_EMPTY = -4.0
#: How many times a clean document weighs in the final fit: a wrong accusation is worse than a miss.
CAUTION = 2.0
COST = 100.0
#: Minus the log of the chance that a word's documents are all toxic, from which on it is surely a toxic word.
SURE = 11.5
#: The most of them that are learned in disguise too.
DISGUISED = 64


def subsequences(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all words of a stream of characters, parted by single spaces: index and weight of each subsequence, and the number of its word."""
    code = np.where(chars < 128, _ASCII[np.minimum(chars, 127)], 27 + (chars * np.uint32(2654435761) >> np.uint32(16)) % 13).astype(np.int32)
    word = np.cumsum(chars == 32, dtype=np.int32)
    index, weight, number = [], [], []
    for i, j in _PAIRS:
        if len(code) <= j:
            continue
        a, b, c = code[:-j], code[i : len(code) - j + i], code[j:]
        at = np.flatnonzero((word[:-j] == word[j:]) & (a > 0) & (b > 0) & (c > 0))
        index.append((a[at] * CLASSES + b[at]) * CLASSES + c[at])
        weight.append(np.full(len(at), DECAY ** (j + 1), np.float32))
        number.append(word[at])
    if not index:
        return np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.int32)
    return np.concatenate(index), np.concatenate(weight), np.concatenate(number)


def char_stream(words: str) -> np.ndarray:
    return np.frombuffer(words.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def kernel_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised subsequence weights of each word, whose inner products are the kernel, and the subsequences that the columns stand for: those that occur."""
    index, weight, number = subsequences(char_stream(" ".join(words)))
    known, place = np.unique(index, return_inverse=True)
    rows = np.zeros((len(words), len(known)), np.float32)
    np.add.at(rows, (number, place), weight)
    own = np.bincount(number, np.square(weight), len(words))
    return rows / np.sqrt(np.maximum(own, 1e-9))[:, None].astype(np.float32), known


def alike(words: list[str], marks: np.ndarray) -> np.ndarray:
    """The kernel of each word with each landmark (marks: a row for each subsequence, a column for each landmark)."""
    out = np.zeros((len(words), marks.shape[1]))
    for low in range(0, len(words), 512):
        part = words[low : low + 512]
        index, weight, number = subsequences(char_stream(" ".join(part)))
        if not len(index):
            continue
        order = np.argsort(number, kind="stable")
        index, weight, number = index[order], weight[order], number[order]
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        own = np.add.reduceat(np.square(weight), first)
        out[low + number[first]] = np.add.reduceat(marks[index] * weight[:, None], first) / np.sqrt(own)[:, None]
    return out


def stream_scores(stream: np.ndarray, count: int, weights: np.ndarray) -> np.ndarray:
    """The sum of each word's weighted subsequences, normalised; `count` words."""
    index, weight, number = subsequences(stream)
    total = np.bincount(number, weights[index] * weight, count)
    own = np.bincount(number, np.square(weight), count)
    return np.where(own > 0, total / np.sqrt(np.maximum(own, 1e-9)), 0.0)


def vocabulary_scores(words: list[str], weights: np.ndarray, chunk: int = 20_000) -> np.ndarray:
    parts = [words[low : low + chunk] for low in range(0, len(words), chunk)]
    return np.concatenate([stream_scores(char_stream(" ".join(p)), len(p), weights) for p in parts] or [np.empty(0)])


@dataclass(frozen=True)
class Model:
    """weights: a number for each subsequence; a text's score is logistic(slope * tanh(worst word's sum + bias) + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def worst(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), _EMPTY)
        for low, high in passes(texts, PASS):
            spaced, starts, ends, begin = words_of(texts.slice(low, high - low))
            if not len(starts):
                continue
            _, first, which = np.unique(hashed(spaced, starts, ends), return_index=True, return_inverse=True)
            lengths = ends[first] - starts[first]
            edge = np.r_[0, np.cumsum(lengths + 1)]
            at = np.arange(edge[-1]) - np.repeat(edge[:-1], lengths + 1) + np.repeat(starts[first], lengths + 1)
            joined = spaced[at]
            joined[edge[1:] - 1] = 32
            text = joined[:-1].tobytes().decode("utf-8", "replace")
            scores = stream_scores(char_stream(text), len(first), self.weights)[which]
            filled = np.flatnonzero(begin[1:] > begin[:-1])
            out[low + filled] = np.maximum.reduceat(scores, begin[filled]) + self.bias
            self._letter_runs(spaced, starts, ends, begin, out, low)
        return out

    def _letter_runs(self, spaced, starts, ends, begin, out, low) -> None:
        """Runs of four or more single letters of a text score as one word."""
        single = np.r_[False, (ends - starts == 1) & (spaced[starts] >= 97) & (spaced[starts] < 123), False]
        change = np.flatnonzero(single[1:] != single[:-1])
        runs = [(a, b) for a, b in zip(change[::2], change[1::2], strict=True) if b - a >= 4]
        if runs:
            doc = np.searchsorted(begin, [a for a, _ in runs], side="right") - 1
            pieces = [spaced[starts[a : min(b, begin[d + 1])]].tobytes().decode() for (a, b), d in zip(runs, doc, strict=True)]
            scores = stream_scores(char_stream(" ".join(pieces)), len(pieces), self.weights) + self.bias
            np.maximum.at(out, low + doc, scores)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.slope * np.tanh(self.worst(texts)) + self.shift, -30, 30))), 6)


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25) -> np.ndarray:
    """The primal machine with weights w: least |w|^2 / 2 + sum of cost * max(0, 1 - y * xw)^2, by Newton steps; the last column of x is 1."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        gap = 1 - y * (x @ w)
        on = gap > 0
        slope = ridge @ w - 2 * x[on].T @ (cost[on] * y[on] * gap[on])
        if np.abs(slope).max() < 1e-6:
            break
        w = w - np.linalg.solve(ridge + 2 * x[on].T @ (x[on] * cost[on, None]), slope)
    return w


def logistic_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """slope and shift of the weighted logistic fit of y by x, with targets kept off 0 and 1."""
    target = np.where(y == 1, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    z, theta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]) + 1e-6 * np.eye(2), z.T @ (weight * (target - p)))
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def spread(words: list[str], most: int, rows: np.ndarray) -> list[int]:
    """Up to `most` words in order, each less than 0.9 alike to those before."""
    chosen: list[int] = []
    for i in range(len(words)):
        if len(chosen) < most and (not chosen or (rows[chosen] @ rows[i]).max() < 0.9):
            chosen.append(i)
    return chosen


def disguises(word: str, rng: np.random.Generator) -> list[str]:
    """The word with marks between all its letters, with a mark in one place, and with a letter doubled."""
    at, twice = rng.integers(1, max(2, len(word) - 1), 2)
    return [".".join(word), word[:at] + str(rng.choice(list("-*._"))) + word[at:], word[:twice] + word[twice - 1] + word[twice:]]


def family_counts(members: list[np.ndarray], family: list[int], size: int) -> Counter:
    """{word: number of families a member of which holds it}."""
    pairs = np.unique(np.concatenate([m * np.int64(size + 1) + f for m, f in zip(members, family, strict=True)]))
    counts = np.bincount(pairs // (size + 1), minlength=size)
    return Counter({int(w): int(counts[w]) for w in np.flatnonzero(counts)})


def train(sample: list[tuple[str, int]], prior: float, landmarks: int = 96, rounds: int = 4, hard: int = 6000, seed: int = 5) -> Model:
    y = np.array([label for _, label in sample], np.int64)
    clipped = float(np.clip(prior, 1e-6, 1 - 1e-6))
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(CLASSES**3, np.float32), 0.0, 0.0, float(np.log(clipped / (1 - clipped))))
    # each document's distinct words
    bags = [sorted({w for s in t.lower().splitlines() for w in s.split()}) for t, _ in sample]
    vocabulary = sorted({w for b in bags for w in b})
    place = {w: i for i, w in enumerate(vocabulary)}
    members = [np.array([place[w] for w in b], np.int64) for b in bags]
    rng = np.random.default_rng(seed)
    tune = rng.random(len(sample)) < 0.3  # kept for the logistic line
    toxic, clean = ([i for i in range(len(sample)) if y[i] == k and not tune[i] and len(members[i])] for k in (1, 0))
    if not toxic or not clean:
        toxic, clean = ([i for i in range(len(sample)) if y[i] == k and len(members[i])] for k in (1, 0))
    # a family of near copies counts as few documents: those with the same least hash of a word
    scramble = rng.permutation(len(vocabulary))
    family = [int(scramble[m].min()) if len(m) else 0 for m in members]
    in_toxic, in_clean = (family_counts([members[i] for i in rows], [family[i] for i in rows], len(vocabulary)) for rows in (toxic, clean))
    odds = {w: np.log((n + 0.5) / (len(toxic) + 1)) - np.log((in_clean[w] + 0.5) / (len(clean) + 1)) + 0.1 * np.log(n) for w, n in in_toxic.items()}
    guess = np.full(len(vocabulary), -9.0)
    guess[list(odds)] = list(odds.values())
    ranked = sorted(odds, key=lambda w: (-in_toxic[w] * (in_clean[w] == 0), -odds[w], vocabulary[w]))[: 6 * landmarks]
    common = [w for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], vocabulary[x[0]]))[: 2 * landmarks]]
    pool = ranked + common
    pool_rows, known = kernel_rows([vocabulary[w] for w in pool])
    bad = spread([vocabulary[w] for w in ranked], landmarks * 2 // 3, pool_rows[: len(ranked)])
    good = spread([vocabulary[w] for w in common], landmarks - len(bad), pool_rows[len(ranked) :])
    marks = pool_rows[[*bad, *[len(ranked) + i for i in good]]]
    values, axes = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-4
    to_nystrom = axes[:, keep] / np.sqrt(values[keep])
    columns = np.zeros((CLASSES**3, len(marks)), np.float32)
    columns[known] = marks.T

    weights, bias = np.zeros(CLASSES**3, np.float32), 0.0
    is_clean = np.zeros(len(vocabulary), bool)
    is_clean[list(in_clean)] = True
    # words of many toxic documents and no clean one are positive whether or not they are a document's worst
    chance = -np.log(len(toxic) / (len(toxic) + len(clean)))
    sure = np.array([w for w, n in sorted(in_toxic.items()) if n * chance >= SURE and not is_clean[w]], np.int64)
    disguised = [v for w in sure[np.argsort([-in_toxic[w] for w in sure.tolist()], kind="stable")][:DISGUISED].tolist() for v in disguises(vocabulary[w], rng)]
    score = guess
    for _ in range(rounds):
        witness = np.array([members[i][np.argmax(np.where(is_clean[members[i]], -99.0, score[members[i]]))] for i in toxic])
        witness = np.concatenate([witness[~is_clean[witness]], sure])
        clean_words = np.flatnonzero(is_clean)
        worst = clean_words[np.argsort(-score[clean_words], kind="stable")[: hard // 2]]
        some = rng.choice(clean_words, min(hard // 2, len(clean_words)), replace=False)
        positive, times = np.unique(witness, return_counts=True)
        times = np.maximum(times, np.where(np.isin(positive, sure), [in_toxic[w] for w in positive.tolist()], 0))
        words = np.concatenate([positive, worst, some])
        target = np.r_[np.ones(len(positive)), -np.ones(len(worst) + len(some))]
        cost = COST * np.r_[np.sqrt(times), np.ones(len(worst) + len(some))]
        texts = [vocabulary[w] for w in words] + disguised
        target, cost = np.r_[target, np.ones(len(disguised))], np.r_[cost, np.full(len(disguised), COST)]
        x = np.c_[alike(texts, columns) @ to_nystrom, np.ones(len(texts))]
        w = squared_hinge(x, target, cost)
        weights = (columns @ (to_nystrom @ w[:-1])).astype(np.float32)
        bias = float(w[-1])
        score = vocabulary_scores(vocabulary, weights) + bias
    model = Model(weights, bias, 1.0, 0.0)
    rows = [i for i in range(len(sample)) if tune[i]]
    if len({int(y[i]) for i in rows}) < 2:
        rows = list(range(len(sample)))
    worst = model.worst(pa.array([sample[i][0] for i in rows], pa.string()))
    own = y[rows]
    weight = np.where(own == 1, clipped / max(own.mean(), 1e-9), CAUTION * (1 - clipped) / max(1 - own.mean(), 1e-9))
    slope, shift = logistic_line(np.tanh(worst), own, weight)
    return Model(weights, bias, max(slope, 0.0), shift)


def fit(docs: DataFrame, labels: DataFrame, allowed, rows: int = 3600, max_bytes: int = 14 << 20, longest: int = 32 << 10) -> Model:
    """Learn labels.toxic from at most `rows` labelled documents of up to `longest` bytes and `max_bytes` of text in all."""
    return train(*labelled_sample(docs, labels, "toxic", allowed, rows, max_bytes, longest, ones=0.25))


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
