"""Judgements: a rule-based judge, a hook for any other, and a tolerant reader of a judge's answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .gates import normal_direction
from .scoring import importance, rule_direction, scope_of

JUDGED = "idx int, push boolean, score double, direction string, scope string, reason string, title string"
_MARKS = str.maketrans({"“": '"', "”": '"', "：": ":", "，": ",", "｛": "{", "｝": "}", "［": "[", "］": "]"})


def rule_judge(news: DataFrame) -> DataFrame:
    """The judge without a model: direction by rules, score from importance, push where both are strong."""
    t, c, n, k, d, s, a, b = (F.col(x) for x in ("title", "content", "name", "category", "impact_direction", "source", "affected_sectors", "affected_stocks"))
    row = {x: F.col(x) for x in ("title", "content", "source", "name", "affected_sectors", "affected_stocks", "influence_scope")}
    score = F.round(10 * importance(t, c, n, k, d, s, a, b), 2)
    out = news.withColumn("direction", rule_direction(t, c)).withColumn("score", score).withColumn("scope", scope_of(row))
    return out.withColumn("push", F.col("direction").isin("bullish", "bearish") & (F.col("score") >= 6)).withColumn("judged", F.lit(True))


def judged_by(news: DataFrame, judge: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], batch: int = 4) -> DataFrame:
    """news with the judgements of any function over batches of rows; rows that it leaves out are not judged."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from judge(frame.iloc[i : i + batch] for i in range(0, len(frame), batch))

    found = news.select("seq", "title", "content", "source").mapInPandas(run, "seq long, push boolean, score double, direction string, scope string, reason string")
    known = news.join(found, "seq", "left")
    return known.withColumn("judged", F.col("push").isNotNull()).withColumn("direction", F.when(F.col("push").isNotNull(), normal_direction(F.col("direction"), F.col("title"), F.col("content"))))


def _rescued(text: str) -> dict | None:
    push, score = re.search(r'"push"\s*:\s*(true|false)', text, re.I), re.search(r'"score"\s*:\s*(\d+(?:\.\d+)?)', text)
    if not push or not score:
        return None
    out = {"push": push[1].lower() == "true", "score": float(score[1])}
    for name in ("direction", "scope", "reason"):
        if m := re.search(rf'"{name}"\s*:\s*"([^"]*)"', text):
            out[name] = m[1]
    if m := re.search(r'"idx"\s*:\s*(\d+)', text):
        out["idx"] = int(m[1])
    if m := re.search(r'"title"\s*:\s*"(.+?)"\s*,', text):
        out["title"] = m[1]
    return out


def _objects(text: str) -> Iterator[str]:
    """The outermost {...} of a text, quotes minded; where quotes don't pair, from brace to brace."""
    depth, start, quoted, skip = 0, -1, False, False
    for i, ch in enumerate(text):
        if skip:
            skip = False
        elif ch == "\\":
            skip = True
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch == "{":
            start = i if depth == 0 else start
            depth += 1
        elif not quoted and ch == "}" and depth:
            depth -= 1
            if depth == 0:
                yield text[start : i + 1]


def read_answer(text: str | None) -> list[dict]:
    """Every judgement in an answer: in a code block or not, with wrong marks or broken quotes."""
    text = text or ""
    if block := re.search(r"```(?:json)?\s*(.*?)```", text, re.S):
        text = block[1]
    found = []
    for part in _objects(text[text.find("[") :] if "[" in text else ""):
        for attempt in (part, part.translate(_MARKS)):
            try:
                found.append(json.loads(attempt, strict=False))
                break
            except ValueError:
                continue
        else:
            if rescued := _rescued(part):
                found.append(rescued)
    return [f for f in found if isinstance(f, dict)]


def _text(value) -> str | None:
    return None if value is None else str(value)


def parsed_judgements(answers: DataFrame, column: str) -> DataFrame:
    """One row for each judgement of each answer, with the answer's other columns."""

    @F.pandas_udf(T.ArrayType(T._parse_datatype_string(f"struct<{', '.join(f'{a}:{b}' for a, b in (p.split() for p in JUDGED.split(', ')))}>")))
    def read(texts: pd.Series) -> pd.Series:
        def row(d: dict) -> dict:
            number = lambda x: float(x) if isinstance(x, int | float) or re.fullmatch(r"\s*[\d.]+\s*", str(x or "")) else None
            idx = number(d.get("idx"))
            return {"idx": None if idx is None else int(idx), "push": bool(d.get("push")), "score": number(d.get("score")), "direction": _text(d.get("direction")) or "neutral", "scope": _text(d.get("scope")) or "stock", "reason": _text(d.get("reason")) or "", "title": _text(d.get("title"))}

        return texts.map(lambda t: [row(d) for d in read_answer(t)])

    others = [F.col(c) for c in answers.columns if c != column]
    return answers.select(*others, F.inline(read(F.col(column))))


# The labels of steps that a judge may write into its chain of reasons.
_STEPS = r"(事件识别|影响范围|方向|强度|置信度|置信|第[0-9]步)[：:]\s*"


def clean_chain(chain: Column) -> Column:
    """A judge's chain of reasons without the labels of its steps; null and empty stay."""
    return F.when(F.coalesce(chain, F.lit("")) == "", chain).otherwise(F.regexp_replace(F.regexp_replace(chain, _STEPS, ""), r"^\s+|\s+$", ""))


def direction_date(history: Column) -> Column:
    """The latest day of a map from days to directions; empty where there is none."""
    return F.coalesce(F.array_max(F.filter(F.map_keys(history), lambda d: F.trim(d) != "")), F.lit(""))
