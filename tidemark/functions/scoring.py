"""Scores, classes and directions of a news row, as column expressions over the fixed word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import abbreviations, any_of, bound, clean_url, first_group, hit_count, hits, text_of, url_host, weight_sum, without, word_pattern

#: Words that make an abbreviation a medical one.
_EYE_WORDS = ("黄斑变性", "眼底", "眼科", "视网膜", "视力")
_PLAIN_TECH = tuple(w for w in L.TECH_WORDS if w not in L.TECH_ABBREVIATIONS)
_EXEMPT_SOURCES = tuple(s for s in L.NATIONAL_SOURCES if s not in ("光明日报", "银保监会", "国家发改委"))
STEADY_DIRECTIONS = ("bullish", "bearish")


def credibility(source: Column) -> Column:
    """By name, else by the first name that holds the source or is held by it, else by kind of name."""
    s = F.coalesce(source, F.lit(""))
    exact = F.create_map(*[x for k, v in L.CREDIBILITY.items() for x in (F.lit(k), F.lit(v))])
    near = [F.when(F.contains(s, F.lit(k)) | F.contains(F.lit(k), s), F.lit(v)) for k, v in L.CREDIBILITY.items()]
    kinds = [
        F.when(any_of(s, ("交易所", "证监会", "央行", "国务院", "银保监", "发改委")), F.lit(0.95)),
        F.when(any_of(s, ("证券报", "证券时报", "财经", "时报", "日报")), F.lit(0.82)),
        F.when(any_of(s, ("券商", "证券", "研究")), F.lit(0.74)),
    ]
    return F.when(s == "", F.lit(0.62)).otherwise(F.coalesce(F.element_at(exact, s), *near, *kinds, F.lit(0.62)))


def tech_words(text: Column) -> Column:
    """The distinct technology words; abbreviations stand alone, and AMD is none in a text on eyes."""
    return bound(text, _tech_words)


def _tech_words(text: Column) -> Column:
    eyes = any_of(text, _EYE_WORDS)
    short = [F.when(F.contains(text, F.lit(w)) & text.rlike(word_pattern(w, True)) & (~eyes if w == "AMD" else F.lit(True)), F.lit(w)) for w in L.TECH_ABBREVIATIONS]
    return F.array_compact(F.array(*short, *[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in _PLAIN_TECH]))


def is_tech(text: Column) -> Column:
    return bound(text, _is_tech)


def _is_tech(text: Column) -> Column:
    others = tuple(w for w in L.TECH_ABBREVIATIONS if w != "AMD")
    return any_of(text, (*others, *_PLAIN_TECH), bounded=others) | (any_of(text, ("AMD",), bounded=("AMD",)) & ~any_of(text, _EYE_WORDS))


def announcement_importance(text: Column) -> Column:
    out = F.when(any_of(text, ("撤销退市", "撤销*ST", "撤销ST", "申请撤销", "摘帽", "撤销退市风险警示", "撤销退市风险")), F.lit(0.75))
    out = out.when(any_of(text, ("*ST", "ST", "退市", "终止上市", "实施退市风险")), F.lit(0.35))
    for words, score in L.ANNOUNCEMENT_TIERS:
        out = out.when(any_of(text, words), F.lit(score))
    return out.otherwise(F.lit(0.30))


def importance(title: Column, content: Column, name: Column, category: Column, direction: Column, source: Column, sectors: Column, stocks: Column) -> Column:
    """Importance before any judgement: 0.1 for noise, else 0.99 tanh(1.4 x) of the category's sum x, less for what is no technology."""
    clean = text_of(without(F.coalesce(title, F.lit("")), name), without(F.coalesce(content, F.lit("")), name))
    return bound(clean, lambda text: _importance(text, category, direction, source, sectors, stocks))


def _importance(text: Column, category: Column, direction: Column, source: Column, sectors: Column, stocks: Column) -> Column:
    n_sectors, n_stocks = (F.coalesce(F.size(x), F.lit(0)) for x in (sectors, stocks))
    n_sectors, n_stocks = F.greatest(n_sectors, F.lit(0)), F.greatest(n_stocks, F.lit(0))
    tech = F.size(tech_words(text))
    way = F.coalesce(direction, F.lit("neutral"))
    strong = way.isin(*STEADY_DIRECTIONS)
    listed = F.least(n_sectors * 0.02, F.lit(0.06)) + F.least(n_stocks * 0.03, F.lit(0.06))
    exempt = any_of(source, _EXEMPT_SOURCES)

    swing = F.abs(F.regexp_extract(text, r"幅度([+-]?[0-9.]+)%", 1).try_cast("double"))
    by_swing = F.when(swing > 1000, 0.25).when(swing > 500, 0.20).when(swing > 100, 0.15).when(swing > 50, 0.10).otherwise(0.0)
    signal = F.when(strong, 0.55).otherwise(0.35) + by_swing + F.when(any_of(text, ("机构净买入", "龙虎榜")), 0.10).otherwise(0.0) + F.when(n_stocks > 0, 0.05).otherwise(0.0)

    base = announcement_importance(text)
    announced = F.when((way == "neutral") & (base >= 0.75), base * 0.6).otherwise(base) + F.least(tech * 0.15, F.lit(0.40)) + F.when(strong, 0.06).otherwise(0.0) + listed

    high = weight_sum(text, L.IMPACT_WEIGHTS)
    high = F.least(F.when(way == "neutral", high * 0.3).otherwise(high), F.lit(0.45))
    other_sectors = tuple(w for w in L.SECTOR_WORDS if w not in L.TECH_WORDS)
    news = (
        0.10 + high + F.least(weight_sum(text, L.POLICY_WEIGHTS), F.lit(0.35)) + F.least(tech * 0.20, F.lit(0.50)) + F.least(hit_count(text, other_sectors) * 0.04, F.lit(0.10))
        + F.least(hit_count(text, L.MEDIUM_WORDS) * 0.04, F.lit(0.12)) + F.when(strong, 0.08).otherwise(0.0) + listed
    )
    squeezed = lambda x, less: F.round(0.99 * F.tanh(1.4 * x) * F.when(less, 0.65).otherwise(1.0), 2)
    plain = ~is_tech(text)
    of_category = (
        F.when(category == "signal", squeezed(signal, plain & ~any_of(source, ("龙虎榜", "业绩预告"))))
        .when(category == "announcement", squeezed(announced, plain & ~exempt))
        .otherwise(squeezed(news, plain & (n_stocks > 0) & ~exempt))
    )
    return F.when(any_of(text, L.NOISE_WORDS), F.lit(0.10)).otherwise(of_category)


def is_official(url: Column, source: Column) -> Column:
    return url_host(clean_url(url)).isin(*L.OFFICIAL_HOSTS) | any_of(source, L.OFFICIAL_LABELS)


def relevance(title: Column, content: Column, url: Column, source: Column, code: str = "", name: str = "") -> Column:
    """score (0-100) and category (direct, macro or sector) of a row for a stock."""
    title, content, url = (F.coalesce(x, F.lit("")) for x in (title, content, url))
    return bound(text_of(title, content), lambda text: _relevance(text, title, content, url, source, code, name))


def _relevance(text: Column, title: Column, content: Column, url: Column, source: Column, code: str, name: str) -> Column:
    has = lambda where, what: F.contains(where, F.lit(what)) if what else F.lit(False)
    direct = F.when(has(title, code), 55).when(has(content, code), 34).when(has(url, code), 18).otherwise(0) + F.when(has(title, name), 45).when(has(content, name), 28).otherwise(0)
    event = any_of(text, L.COMPANY_EVENT_WORDS)
    named = F.when(event & (direct > 0), direct + 12).otherwise(direct)
    macro = any_of(text, L.MACRO_NEWS_WORDS)
    world = hit_count(text, L.GLOBAL_RISK_WORDS)
    score = (
        direct + F.when(event, F.when(direct > 0, 12).otherwise(6)).otherwise(0) + F.when(is_tech(text), 10).otherwise(0) + F.when(is_official(url, source), 8).otherwise(0)
        + F.when(any_of(text, L.SECTOR_NEWS_WORDS), 6).otherwise(0) - F.when(macro & (named == 0) & ~any_of(text, L.POLICY_WEIGHTS) & (world == 0), 12).otherwise(0) + F.least(world * 5, F.lit(15))
    )
    category = F.when(named >= 38, "direct").when(macro & (named == 0), "macro").otherwise("sector")
    return F.struct(F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int").alias("score"), category.alias("category"))


def relevance_bonus(title: Column, content: Column, watched: tuple[str, ...]) -> Column:
    text = text_of(title, content)
    watch = F.when(any_of(text, watched), 0.25).otherwise(0.0) if watched else F.lit(0.0)
    return F.round(F.least(watch + F.least(hit_count(text, L.CHAIN_WORDS) * 0.05, F.lit(0.15)), F.lit(0.40)), 4)


def sectors_of(title: Column, content: Column, name: Column) -> Column:
    """Up to five sectors, in the order of the list."""
    text = text_of(without(F.coalesce(title, F.lit("")), name), without(F.coalesce(content, F.lit("")), name))
    found = bound(text, lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w)), F.lit(s)) for w, s in L.SECTOR_NAMES.items()])))
    return F.slice(F.array_distinct(found), 1, 5)


def canonical_sector(raw: Column) -> Column:
    s = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(s == "", F.lit("")).otherwise(F.coalesce(first_group(F.lower(s), L.SECTOR_RULES), s))


def announcement_type(kind: Column, title: Column) -> Column:
    return F.coalesce(first_group(text_of(kind, title), L.ANNOUNCEMENT_TYPES), F.lit(""))


def macro_subject(title: Column, content: Column) -> Column:
    return bound(text_of(title, content), lambda text: F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in L.MACRO_SUBJECTS]))


def is_national(source: Column) -> Column:
    return any_of(source, L.NATIONAL_SOURCES)


def is_delisting(text: Column) -> Column:
    return text.rlike(r"\*ST|(?<![A-Za-z])ST(?![A-Za-z])|退市|终止上市")


def band_to_direction(band: Column) -> Column:
    return F.when(band.isin("bullish", "mildly_bullish"), "bullish").when(band.isin("bearish", "mildly_bearish"), "bearish").otherwise("neutral")


def band_conflicts(band: Column, direction: Column) -> Column:
    return (band.isin("bullish", "mildly_bullish") & (direction == "bearish")) | (band.isin("bearish", "mildly_bearish") & (direction == "bullish"))


def milder_band(band: Column) -> Column:
    return F.when(band == "bullish", "mildly_bullish").when(band == "bearish", "mildly_bearish").otherwise("neutral")


def band_priority(band: Column) -> Column:
    return F.when(band.isin("bullish", "bearish", "mixed"), 6).when(band.isin("mildly_bullish", "mildly_bearish"), 4).when(band == "neutral", 1).otherwise(3)


def text_direction(reason: Column, chain: Column) -> Column:
    """The direction that only one side's words speak for; the chain counts where there is no reason."""
    text = F.when(F.trim(F.coalesce(reason, F.lit(""))) == "", F.coalesce(chain, F.lit(""))).otherwise(reason)
    down, up = any_of(text, L.BEARISH_TEXT), any_of(text, L.BULLISH_TEXT)
    return F.when(down & ~up, "bearish").when(up & ~down, "bullish").otherwise("neutral")


def has_risk(text: Column) -> Column:
    return any_of(text, L.RISK_WORDS) & ~any_of(text, L.BENEFIT_WORDS)


def guarded_band(band: Column, score: Column, title: Column, reason: Column, chain: Column) -> Column:
    """The band after the guardrails: neutral phrases, then the text's direction, then risk words, then low scores."""
    known = F.when(band.isin("bullish", "mildly_bullish", "neutral", "mixed", "mildly_bearish", "bearish"), band).otherwise("neutral")
    to_bear = lambda b: F.when(b == "bullish", "bearish").when(b.isin("mildly_bullish", "mixed"), "mildly_bearish").otherwise(b)
    to_bull = lambda b: F.when(b == "bearish", "bullish").when(b.isin("mildly_bearish", "mixed"), "mildly_bullish").otherwise(b)
    way = text_direction(reason, chain)
    turned = F.when(way == "bearish", to_bear(known)).when(way == "bullish", to_bull(known)).otherwise(known)
    turned = F.when(has_risk(text_of(title, reason)), to_bear(turned)).otherwise(turned)
    said = F.concat(F.coalesce(reason, F.lit("")), F.coalesce(chain, F.lit(""))) != ""
    weak = (F.coalesce(score, F.lit(3.0)) < 4.0) & ~turned.isin("neutral", "mixed") & said
    return F.when(any_of(text_of(reason, chain), L.NEUTRAL_PHRASES), "neutral").when(weak, "neutral").otherwise(turned)


_NEGATION = "|".join(sorted(L.NEGATIONS, key=lambda w: -len(w)))


def negations_before(text: Column, word: Column, window: int = 8) -> Column:
    """How many negations stand in the `window` characters before the word, over all its occurrences (which may overlap)."""
    # the leading line ends stand for characters that are not there
    before = F.regexp_extract_all(F.concat(F.lit("\n" * window), text), F.concat(F.lit(rf"(?s)(?=(.{{{window}}})\Q"), word, F.lit(r"\E)")), F.lit(1))
    return F.aggregate(before, F.lit(0), lambda n, w: n + F.regexp_count(w, F.lit(_NEGATION)))


def _speaks(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is in the text with an even number of negations before it."""
    found = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return F.exists(found, lambda w: negations_before(text, w) % 2 == 0)


def _scan(text: Column) -> Column:
    return F.when(_speaks(text, L.BULLISH_WORDS), "bullish").when(_speaks(text, L.BEARISH_WORDS), "bearish").otherwise("neutral")


def rule_direction(title: Column, content: Column) -> Column:
    """Direction by rules: a reversing word with a strong word in the 12 characters after it, then the title, then the first sentence of the content."""
    # each text is built once for each row, however many words are searched for in it
    return bound(F.struct(F.coalesce(title, F.lit("")).alias("title"), F.coalesce(content, F.lit("")).alias("content")), lambda t: _direction(t["title"], t["content"]))


def _direction(title: Column, content: Column) -> Column:
    more = (*L.BULLISH_WORDS, "增持", "回购", "并购", "重组", "中标", "签约")

    def reversed_(full: Column) -> Column:
        def by(p: str) -> Column:
            way = lambda window: F.when(any_of(window, L.BEARISH_WORDS), "bullish").when(any_of(window, more), "bearish")
            return F.when(F.contains(full, F.lit(p)), bound(F.substring(full, F.instr(full, p), F.lit(len(p) + 12)), way))

        return F.coalesce(*[by(p) for p in L.REVERSING_PREFIXES])

    by_title = bound(_scan(title), lambda d: F.when(d != "neutral", d))
    return F.coalesce(bound(text_of(title, content), reversed_), by_title, bound(F.element_at(F.split(content, "[。；;！!？?]", 2), 1), _scan))


def rounded(x: Column) -> Column:
    """To 4 places; what binary fractions put a hair under a tie goes up with it."""
    return F.round(x + 1e-9, 4)


def continuous_score(row: dict[str, Column], time_factor: Column, watched: tuple[str, ...] = (), constituents: Column | None = None) -> Column:
    """The ranking score: weighted credibility, judged impact and cluster weight, then the factors, rounded to 4 places after each.

    constituents: an array of index member names, or null where membership is not known (nothing is taken off then).
    """
    title, content, name = (F.coalesce(row[k], F.lit("")) for k in ("title", "content", "name"))
    source, direction, category = row["source"], F.coalesce(row["impact_direction"], F.lit("neutral")), row["category"]
    cred, impact = credibility(source), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(row["market_impact_score"], F.lit(3.0)) / 10))
    base = (
        F.when(category == "announcement", 0.05 * cred + 0.95 * impact).when(category == "signal", 0.10 * cred + 0.90 * impact)
        .otherwise(0.15 * cred + 0.70 * impact + F.least(F.coalesce(row["cluster_weight"], F.lit(0.0)) * 0.05, F.lit(0.15)))
    )
    mood = F.when((direction != "neutral") | (impact >= 0.7), 1.0).when(impact >= 0.4, 0.92).otherwise(0.80)
    total = rounded(base * mood)
    clean, raw = text_of(without(title, name), without(content, name)), text_of(title, content)
    national = is_national(source)
    scope = scope_of(row, constituents)
    factor = F.when(is_tech(clean), 1.20).when(national & any_of(clean, L.NATIONAL_POLICY_WORDS), 1.15).when(national, 1.08).when(scope == "market", 1.0).otherwise(0.85)
    total = rounded(total * factor)
    delisting = is_delisting(raw)
    if constituents is not None:
        stocks = F.coalesce(row["affected_stocks"], F.array().cast("array<string>"))
        checked = F.when(name != "", F.array_append(stocks, name)).otherwise(stocks)
        outside = (scope == "stock") & (F.size(checked) > 0) & (F.size(constituents) > 0) & ~F.arrays_overlap(checked, constituents)
        total = F.when(outside & delisting, rounded(rounded(total * 0.7) * 0.6)).when(outside, rounded(total * 0.7)).when(delisting & (direction == "bearish"), rounded(total * 0.85)).otherwise(total)
    else:
        total = F.when(delisting & (direction == "bearish"), rounded(total * 0.85)).otherwise(total)
    if watched:
        stocks = F.coalesce(row["affected_stocks"], F.array().cast("array<string>"))
        hit = F.exists(F.array_append(stocks, name), lambda s: (F.char_length(s) >= 2) & (any_of(s, watched) | sum((F.contains(F.lit(w), s).cast("int") for w in watched), F.lit(0)).cast("boolean")))
        total = F.when(hit, rounded(total * 1.2)).otherwise(total)
    return rounded(total * (0.90 + 0.10 * time_factor))


def scope_of(row: dict[str, Column], constituents: Column | None = None) -> Column:
    """The given scope, else market, sector or stock by source, policy words, sectors and index membership."""
    text = text_of(row["title"], row["content"])
    sectors = F.greatest(F.coalesce(F.size(row["affected_sectors"]), F.lit(0)), F.lit(0))
    member = F.lit(False)
    if constituents is not None:
        checked = F.array_append(F.coalesce(row["affected_stocks"], F.array().cast("array<string>")), F.coalesce(row["name"], F.lit("")))
        member = F.coalesce(F.arrays_overlap(F.filter(checked, lambda s: s != ""), constituents), F.lit(False))
    by_rule = F.when((is_national(row["source"]) & any_of(text, L.NATIONAL_POLICY_WORDS)) | (sectors >= 3), "market").when((sectors > 0) | member, "sector").otherwise("stock")
    return F.when(F.coalesce(row["influence_scope"], F.lit("")) == "", by_rule).otherwise(row["influence_scope"])


def signal_words(text: Column) -> Column:
    return hits(text, L.SIGNAL_WORDS, abbreviations(L.SIGNAL_WORDS))


def core_signal_words(text: Column) -> Column:
    return F.array_except(signal_words(text), F.array(*map(F.lit, L.BROAD_SIGNAL_WORDS)))
