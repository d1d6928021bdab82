"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and a path prefix, either of which may hold `*`; it fits the host and all its subdomains.
Each rule is filed under the one of its whole literal tokens that the table's URLs use least. A URL's tokens
fetch the rules filed under them, and only those rules run their regular expression; the longest rule that
fits wins, then the smaller rule text. URLs that no rule fits get `default`.

Defined results: a null URL, an empty one or one without `://` has an empty host and path and gets the
default; repeated rows are judged alike; an empty table gives an empty one; other columns stay, and a column
named like a result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import unused

_TOKEN = re.compile(r"[^/.\-_:@?#=&%+*~,;!]+")
_SPLIT = r"[/.\-_:@?#=&%+*~,;!]+"
RESULT = "host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block. host and path may hold `*` for any run of characters."""

    verdict: str
    host: str
    path: str = "/"

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        """`example.com/en/` is the host example.com and the path prefix /en/."""
        host, slash, path = text.partition("/")
        return cls(verdict, host.lower(), slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path

    def patterns(self) -> tuple[re.Pattern, re.Pattern]:
        """One that fits whole hosts, and one that fits the beginning of paths; either may hold any character, line ends too."""
        host, path = (".*".join(re.escape(x) for x in part.split("*")) for part in (self.host, self.path))
        return re.compile(rf"(?:.*\.)?{host}\Z", re.DOTALL), re.compile(path, re.DOTALL)

    def tokens(self) -> set[str]:
        """Literal tokens that every URL the rule fits holds whole: host labels, and path segments that end within the prefix."""
        whole = re.sub(r"[^/.\-_:@?#=&%+*~,;!]*\*[^/.\-_:@?#=&%+*~,;!]*", "/", self.host)
        inner = re.sub(r"[^/.\-_:@?#=&%+*~,;!]*\*[^/.\-_:@?#=&%+*~,;!]*|[^/.\-_:@?#=&%+*~,;!]+$", "/", self.path)
        return {*_TOKEN.findall(whole), *_TOKEN.findall(inner)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path: what stands after the first `://`, up to `/`, `?` or `#`; then up to `?` or `#`."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = re.search(r"[/?#]", rest)
    host, rest = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    host = re.sub(r"[A-Z]+", lambda m: m[0].lower(), host)
    return host, re.split(r"[?#]", rest, maxsplit=1)[0]


#: A rule set of up to so many tokens is sent to every task; a larger one meets tokens that are counted first.
SENT_TOKENS = 100_000


def token_counts(urls: DataFrame, column: str, tokens: set[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; the result is no larger than the rule set."""
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    found = urls.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), _SPLIT))).alias("token"))
    count = F.count(F.lit(1)).alias("n")
    if len(tokens) <= SENT_TOKENS:
        counts = found.join(F.broadcast(wanted), "token", "left_semi").groupBy("token").agg(count)
    else:
        counts = found.groupBy("token").agg(count).join(wanted, "token", "left_semi")
    return {r["token"]: r["n"] for r in counts.collect()}


class RuleIndex:
    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern, re.Pattern]] = []
        for rule in dict.fromkeys(rules):
            entry = (rule, *rule.patterns())
            literal = sorted(rule.tokens(), key=lambda t: (counts.get(t.lower(), 0), t))
            (self.by_token.setdefault(literal[0], []) if literal else self.always).append(entry)

    def judge(self, host: str, path: str) -> Rule | None:
        found = [*self.always]
        for token in {*_TOKEN.findall(host), *_TOKEN.findall(path)}:
            found += self.by_token.get(token, ())
        fits = [rule for rule, of_host, of_path in found if of_path.match(path) and of_host.match(host)]
        return min(fits, key=lambda r: (-len(r.text), r.text), default=None)


def filter_urls(pages: DataFrame, rules: Iterable[Rule], column: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict. One pass over the URLs besides the count of the rules' tokens; nothing is shuffled."""
    rules = list(rules)
    tokens = {t.lower() for r in rules for t in r.tokens()}
    index = RuleIndex(rules, token_counts(pages, column, tokens) if tokens else {})

    @F.pandas_udf(RESULT)
    def judged(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for url in urls:
            host, path = split_url(url if isinstance(url, str) else None)
            rule = index.judge(host, path)
            rows.append((host, path, rule.text if rule else None, rule.verdict if rule else default))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    result = unused("_judged", pages.columns)
    return pages.select(*kept, judged(F.col(column)).alias(result)).select(*kept, f"{result}.*")
