"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once. At each position it gives, along its output links, every piece that ends
there; each relaxes the best score of that position from the position where the piece began. A character that
no piece holds costs the least score less 10, as in the unigram model, and is written as its UTF-8 bytes when
the model has byte pieces, else as the unknown id. Equal scores go to the longer piece.

Scores of a model made by merges are the merges' order, and such a model's own ids are those that its merges
leave, not those of the best sum. With `merges` the same pass finds them too: at each position it takes the first piece along
the output links that merging would leave beside the piece before it, which two pieces tell by themselves.

No piece of such a model reaches from a character over a following word mark, so the best path of a text is
the best paths of its words, and a worker remembers those of common words. Where a model has a piece that
does, whole texts are read at once.

Defined results: a null text is an empty one and has no ids; the normaliser is the model's own; decoding
gives back the normalised text, less the mark put before it; equal texts give equal ids; repeated rows are
encoded alike; an empty table gives an empty one; other columns stay, and columns named like a result are
replaced.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_array, give_back, passes

MARK = "▁"
UNKNOWN_COST = 10.0
#: Words whose paths a worker remembers, and characters of them, in each of two generations.
REMEMBERED = 250_000
REMEMBERED_CHARS = 4 << 20
#: Up to so many characters a word's merges are made one by one; in longer texts that takes the square of the length.
SHORT = 40
#: Pairs of pieces for which a worker remembers whether merging leaves them.
MOST_PAIRS = 1_000_000
#: New words that are relaxed in one pass, and what stands between them.
TOGETHER, APART = 16_384, "\0"
#: Bytes of text that are cut into words at a time.
TEXTS_BYTES = 3 << 19


class Pieces:
    def __init__(self, path: str, merges: bool = False):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = model.normalize
        self.unknown = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        self.plain: dict[int, bytes] = {}
        self.byte_ids: dict[int, int] = {}
        least = 0.0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.IsByte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.plain[i] = bytes([int(piece[3:-1], 16)])
            elif not (model.IsControl(i) or model.IsUnknown(i) or model.IsUnused(i)):
                score = model.get_score(i)
                self.automaton.add_word(piece, (len(piece), i, score))
                self.plain[i] = piece.encode()
                least = min(least, score if score > -1e8 else 0.0)
        self.automaton.make_automaton()
        self.has_bytes = len(self.byte_ids) == 256
        self.singles = {p for p in self.automaton if len(p) == 1}
        self.unknown_score = least - UNKNOWN_COST
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.automaton)
        # in a model made by merges the scores count down with the ids
        self.made_by_merges = len({i + own for _, i, own in self.automaton.values() if own > -1e8}) == 1
        self.merges = merges and self.made_by_merges
        self.text_of = {i: p.decode() for i, p in self.plain.items() if i not in self.byte_ids.values()}
        self.spans = {p[i : i + 2] for p in self.automaton for i in range(len(p) - 1)}
        self.word = self.words_pattern()
        self.apart = not any(APART in p for p in self.automaton)
        self.stays: dict[int, bool] = {}
        self.halves: dict[str, tuple[str, str] | tuple[()] | None] = {}
        # whose turn to merge comes first has the least number; characters are there before all merges
        self.turn = {p: -self.automaton.get(p)[2] if len(p) > 1 else -1.0 for p in self.automaton} if self.merges else {}
        self.young: dict[str, tuple[bytes, float, bytes]] = {}
        self.old: dict[str, tuple[bytes, float, bytes]] = {}
        self.chars = 0
        self.lengths = [0] * model.get_piece_size()
        for length, i, _ in self.automaton.values():
            self.lengths[i] = length
        # numbers in the order of the merges; what no merge makes has none
        self.order = {p: t for p, t in self.turn.items() if len(p) > 1}
        self.id_of = {p: i for i, p in self.text_of.items()}

    def words_pattern(self) -> re.Pattern:
        """What finds words: runs of characters that pieces have side by side, directly or by way of others, with the marks before them; and runs of what no piece has beside anything. No piece spans their borders."""
        group = {p: {p} for p in self.singles if p != MARK}
        for a, b in self.spans:
            if MARK not in (a, b):
                one, other = (group.setdefault(c, {c}) for c in (a, b))
                if one is not other:
                    small, large = sorted((one, other), key=len)
                    large |= small
                    group.update(dict.fromkeys(small, large))
        groups = {id(g): g for g in group.values() if len(g) > 1}.values()
        alike = ["".join(map(re.escape, sorted(g))) for g in groups]
        return re.compile("|".join([*(f"{MARK}*[{g}]+" for g in alike), f"{MARK}*[^{MARK}{''.join(alike)}]+", f"{MARK}+"]))

    def merged(self, text: str, fewest: int = 1) -> list[str]:
        """What merging leaves, or has left at `fewest` parts: again and again the neighbours whose joined piece scores best, the first ones first."""
        parts = list(text)
        get = self.automaton.get
        while len(parts) > fewest:
            scores = [get(a + b, None) for a, b in zip(parts, parts[1:], strict=False)]
            at = max((i for i, s in enumerate(scores) if s), key=lambda i: (scores[i][2], -i), default=None)
            if at is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def beside(self, before: int, piece: int) -> bool:
        """Whether merging leaves the two pieces as they are; -1 is a text's start or an unknown character."""
        key = before << 32 | piece
        got = self.stays.get(key)
        if got is None:
            got = self.last_merge(self.text_of[piece]) is not None if before < 0 else self.beside(-1, piece) and self.beside(-1, before) and self.unmerged(self.text_of[before], self.text_of[piece])
            if len(self.stays) < MOST_PAIRS:
                self.stays[key] = got
        return got

    def last_merge(self, piece: str) -> tuple[str, str] | tuple[()] | None:
        """The two parts whose merge makes the piece; () for a single character, None where merging does not leave the piece whole."""
        if piece not in self.halves:
            parts = [piece] if len(piece) == 1 else self.merged(piece, 2)
            whole = len(parts) == 1 or (len(parts) == 2 and self.automaton.get("".join(parts), None) is not None)
            self.halves[piece] = tuple(parts) * (len(parts) == 2) if whole else None
        return self.halves[piece]

    def unmerged(self, a: str, b: str) -> bool:
        """Whether merging leaves a and b, each whole by itself: their merges are taken back, the last first, and no two parts that then meet may merge before those."""
        turn, limit = self.turn, float("inf")
        while True:
            if turn.get(a + b, limit) < limit:
                return False
            if turn[a] > turn[b]:
                limit, a = turn[a], self.last_merge(a)[1]
            elif len(b) > 1:
                limit, b = turn[b] + 0.5, self.last_merge(b)[0]  # of equal merges the first one goes first
            else:
                return True

    def best(self, text: str) -> tuple[list[int], float, list[int]]:
        """Ids and score of the best segmentation of a normalised text, and the ids that merging leaves (none for other models)."""
        size = len(text)
        low = float("-inf")
        if self.singles.issuperset(text):  # nothing but relaxing
            return self.relaxed(text)
        score, back, piece = [0.0] + [low] * size, [0] * (size + 1), [-1] * (size + 1)
        last, since = [-2] * (size + 1), [0] * (size + 1)  # -2: not known yet
        last[0] = -1
        singles, unknown, merges, stays = self.singles, self.unknown_score, self.merges, self.stays
        ready = 0  # positions up to which unknown characters are relaxed
        for end, (length, i, own) in self.automaton.iter(text):
            while ready <= end:
                if text[ready] not in singles:
                    if score[ready] + unknown > score[ready + 1]:
                        score[ready + 1], back[ready + 1], piece[ready + 1] = score[ready] + unknown, ready, -1
                    last[ready + 1], since[ready + 1] = -1, ready
                ready += 1
            start = end + 1 - length
            new = score[start] + own
            if new > score[end + 1]:
                score[end + 1], back[end + 1], piece[end + 1] = new, start, i
            if merges and last[end + 1] == -2 and last[start] != -2:
                fits = stays.get(last[start] << 32 | i)
                if fits or (fits is None and self.beside(last[start], i)):
                    last[end + 1], since[end + 1] = i, start
        while ready < size:
            if score[ready] + unknown > score[ready + 1]:
                score[ready + 1], back[ready + 1], piece[ready + 1] = score[ready] + unknown, ready, -1
            last[ready + 1], since[ready + 1] = -1, ready
            ready += 1
        return self.path(text, back, piece), score[size], self.path(text, since, last) if merges else []

    def relaxed(self, text: str) -> tuple[list[int], float, list[int]]:
        """The same for a text of known characters. score[e] is the best of what ends with character e; the last place is what is before the first one."""
        size = len(text)
        score, piece, lengths = [float("-inf")] * size + [0.0], [0] * size, self.lengths
        short = size <= SHORT or not self.merges
        matches = self.automaton.iter(text) if short else list(self.automaton.iter(text))
        for end, (length, i, own) in matches:
            new = score[end - length] + own
            if new > score[end]:
                score[end], piece[end] = new, i
        ids, at = [], size - 1
        while at >= 0:
            i = piece[at]
            ids.append(i)
            at -= lengths[i]
        ids.reverse()
        total = score[size - 1] if size else 0.0
        if not self.merges:
            return ids, total, []
        return ids, total, self.stepwise(text) if short else self.left(size, ids, matches)

    def stepwise(self, text: str) -> list[int]:
        """The ids that merging leaves of known characters, by making the merges."""
        get, never = self.order.get, float("inf")
        parts = list(text)
        turns = [get(a + b, never) for a, b in pairwise(text)]
        while turns:
            first = min(turns)
            if first == never:
                break
            i = turns.index(first)
            whole = parts[i] = parts[i] + parts.pop(i + 1)
            del turns[i]
            if i:
                turns[i - 1] = get(parts[i - 1] + whole, never)
            if i < len(turns):
                turns[i] = get(whole + parts[i + 1], never)
        return [*map(self.id_of.__getitem__, parts)]

    def left(self, size: int, ids: list[int], matches: list[tuple[int, tuple[int, int, float]]]) -> list[int]:
        """The ids that merging leaves of `size` known characters: the best path's where merging leaves these, else they are searched for.

        At each position it is the first piece that merging leaves beside the piece before it. Positions are
        settled from the end, so only those on which the end depends are looked at.
        """
        get, before = self.stays.get, -1
        for i in ids:
            fits = get(before << 32 | i)
            if not (fits or (fits is None and self.beside(before, i))):
                break
            before = i
        else:
            return ids
        last: dict[int, tuple[int, int] | None] = {0: (-1, 0)}  # None: no piece fits there
        waiting = [(size, bisect_left(matches, (size - 1,)))]
        while waiting:
            end, k = waiting.pop()
            last[end] = None
            while k < len(matches) and matches[k][0] == end - 1:
                length, i, _ = matches[k][1]
                start = end - length
                if start not in last:
                    waiting += [(end, k), (start, bisect_left(matches, (start - 1,)))]
                    break
                if last[start] is not None:
                    before = last[start][0]
                    fits = get(before << 32 | i)
                    if fits or (fits is None and self.beside(before, i)):
                        last[end] = i, start
                        break
                k += 1
        found, at = [], size
        while at:
            i, at = last[at]
            found.append(i)
        return found[::-1]

    def path(self, text: str, back: list[int], piece: list[int]) -> list[int]:
        ids: list[int] = []
        at = len(text)
        while at:
            start = back[at]
            if piece[at] >= 0:
                ids.append(piece[at])
            elif self.has_bytes:
                ids += [self.byte_ids[b] for b in reversed(text[start:at].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(self.unknown)
            at = start
        return ids[::-1]

    def learn(self, words: set[str]) -> None:
        """Find the paths of words."""
        young, old = self.young, self.old
        fresh = []
        for word in words:
            got = old.get(word)
            if got is None:
                fresh.append(word)
            else:
                young[word] = got
        for low in range(0, len(fresh), TOGETHER):
            some = fresh[low : low + TOGETHER]
            young.update(zip(some, self.found_together(some), strict=True))

    def found_together(self, words: list[str]) -> list[tuple[bytes, float, bytes]]:
        """`found` of each word; short ones of known characters are relaxed in one pass over all of them, as no piece reaches over the APART between them."""
        known = self.singles.issuperset
        short = [w for w in words if len(w) <= SHORT and known(w)] if self.apart else []
        if not short:
            return [self.found(w) for w in words]
        text = APART + APART.join(short)
        score, piece, lengths = [float("-inf")] * len(text), [0] * len(text), self.lengths
        at = 0
        for word in short:
            score[at] = 0.0
            at += len(word) + 1
        for end, (length, i, own) in self.automaton.iter(text):
            new = score[end - length] + own
            if new > score[end]:
                score[end], piece[end] = new, i
        done, before = {}, 0
        for word in short:
            last = at = before + len(word)
            ids = []
            while at > before:
                i = piece[at]
                ids.append(i)
                at -= lengths[i]
            ids.reverse()
            done[word] = array("I", ids).tobytes(), score[last], array("I", self.stepwise(word)).tobytes() if self.merges else b""
            before = last + 1
        return [done.get(w) or self.found(w) for w in words]

    def found(self, word: str) -> tuple[bytes, float, bytes]:
        ids, score, left = self.best(word)
        return array("I", ids).tobytes(), score, array("I", left).tobytes() if left else b""

    def encode(self, texts: list[str]) -> list[tuple[bytes, float, bytes, str]]:
        """For each text the ids of the best path as little-endian unsigned 32-bit integers, their score, the ids that merging leaves, and the normalised text."""
        normal = [self.normalize(t) for t in texts]
        split = [self.word.findall(n) if self.by_word else [n] * bool(n) for n in normal]
        if len(self.young) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.old, self.young, self.chars = self.young, {}, 0
        fresh = set().union(*split) - self.young.keys()
        if fresh:
            self.learn(fresh)
            self.chars += sum(map(len, fresh))
        young = self.young
        out = []
        for words, text in zip(split, normal, strict=True):
            found = [young[w] for w in words]
            out.append((b"".join([f[0] for f in found]), float(sum([f[1] for f in found])), b"".join([f[2] for f in found]), text))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of the ids: marks become spaces, and the mark put before the text goes."""
        plain = self.plain
        text = b"".join([plain.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text.replace(MARK, " ").removeprefix(" ")


@lru_cache(maxsize=4)
def pieces(path: str, merges: bool = False) -> Pieces:
    """One automaton for each model in each worker."""
    return Pieces(path, merges)


def encode(docs: DataFrame, model: str, text: str = "text", merges: bool = False, decoded: bool = False) -> DataFrame:
    """docs without the text, with ids (the best path's; binary, little-endian unsigned 32-bit), path_score, merge_ids (what merging leaves, if asked for and the model is made by merges; else empty), normal_text (what decoding must give) and decoded_text (if asked for; else null). One pass, no shuffle."""
    names = ["ids", "path_score", "merge_ids", "normal_text", "decoded_text"]
    kept = [c for c in docs.columns if c != text and c.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_pieces = pieces(model, merges)
        for whole in batches:
            for low, high in passes(as_array(whole.column(len(kept))), TEXTS_BYTES):
                batch = whole.slice(low, high - low)
                found = model_pieces.encode([t or "" for t in batch.column(len(kept)).to_pylist()])
                normal = [f[3].replace(MARK, " ").removeprefix(" ") for f in found]
                back = [model_pieces.decode(f[0]) if decoded else None for f in found]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.binary()), pa.array(normal, pa.string()), pa.array(back, pa.string())], names=[*kept, *names])
        give_back()

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("ids", T.BinaryType()), T.StructField("path_score", T.DoubleType()), T.StructField("merge_ids", T.BinaryType()), *[T.StructField(n, T.StringType()) for n in names[3:]]])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text)).mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """rows with decoded_text. One pass, no shuffle."""
    kept = [c for c in rows.columns if c.lower() != "decoded_text"]
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_pieces = pieces(model)
        for whole in batches:
            for low in range(0, len(whole), 512):
                batch = whole.slice(low, 512)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([model_pieces.decode(i or b"") for i in batch.column(at).to_pylist()], pa.string())], names=[*kept, "decoded_text"])

    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("decoded_text", T.StringType())])
    return rows.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
