"""Row-local gates: each names the first reason for which a row stops, or is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .scoring import is_tech, rule_direction
from .text import abbreviations, any_of, bound, text_of
from .times import quiet_window

# Results depend on these exact names and patterns.
_INDEXES = (*L.INDEX_NAMES, "KOSPI", "恒生指数", "综合指数", "美元指数", "美元兑日元", "日元", "WTI", "原油期货", "柴油期货", "柴油价格", "现货黄金", "现货白银", "黄金期货", "白银期货", "伦敦金", "COMEX")
_MOVE = "涨超|跌超|涨逾|跌逾|涨幅|跌幅|大涨|大跌|暴涨|暴跌|走强|走弱|拉升|下挫|高开|低开|创新高|创新低|净流入|净流出|异动|翻红|翻绿|收涨|收跌|现报"
_SIZE = r"[0-9]+(?:\.[0-9]+)?%|超[0-9]+%|[0-9]+个点|[0-9]+cm|[0-9]+天[0-9]+板|涨停|跌停|连板"
_SCALE = r"(?i)[0-9][0-9,]*(?:\.[0-9]+)?\s*[万亿]?\s*(?:台|块|件|片|卡|核|节点|G|纳米|毫瓦|千瓦时|天|(?:[A-Za-z][A-Za-z-]*\s*)?(?:chips?|units?|shares?|vehicles?|servers?|GPUs?))|十万卡|万卡|千卡|万片|万块|万台"


def is_macro_release(text: Column) -> Column:
    return any_of(text, L.RELEASE_CONTEXT) & text.rlike("|".join(L.MACRO_DATA_PATTERNS))


def is_major_deal(text: Column) -> Column:
    return any_of(text, L.DEAL_WORDS) & (text.rlike(r"[0-9]+(?:\.[0-9]+)?\s*亿") | is_tech(text))


def is_macro_policy(title: Column, content: Column) -> Column:
    return any_of(text_of(title, content), L.MACRO_POLICY_WORDS)


def has_signal(text: Column) -> Column:
    return any_of(text, L.SIGNAL_WORDS, abbreviations(L.SIGNAL_WORDS))


def goes_straight(text: Column, watched: tuple[str, ...] = ()) -> Column:
    """What is judged whatever its score: signal words, data releases, major deals, leading names."""
    return bound(text, lambda t: has_signal(t) | is_macro_release(t) | is_major_deal(t) | any_of(t, (*L.HEADLINE_ENTITIES, *watched)))


def is_watched(title: Column, name: Column, content: Column, watched: tuple[str, ...]) -> Column:
    return any_of(text_of(title, name, content), watched) if watched else F.lit(False)


def is_truncated(title: Column) -> Column:
    """Ends in an ellipsis; what 【】 holds counts where there is such a part."""
    t = F.trim(F.coalesce(title, F.lit("")))
    ends = "(…|。。。|\\.\\.\\.|。。)$"
    bracket = t.rlike("【[^】]*】")
    inner, after = F.trim(F.regexp_extract(t, "【([^】]*)】", 1)), F.trim(F.regexp_extract(t, "^(?s).*?【[^】]*】(.*)$", 1))
    return F.when(bracket, inner.rlike(ends) | after.isin(*L.TRUNCATED_ENDINGS)).otherwise(t.rlike(ends))


def title_names(title: Column, name: Column, stocks: Column) -> Column:
    """Whether the title names its subject, by the row's names or before a colon."""
    t = F.coalesce(title, F.lit(""))
    head = F.trim(F.regexp_extract(t, "^([^：:]*)[：:]", 1))
    own = (F.coalesce(name, F.lit("")) != "") & F.contains(t, F.coalesce(name, F.lit("")))
    listed = F.coalesce(F.exists(stocks, lambda s: (s != "") & F.contains(t, s)), F.lit(False))
    return own | listed | (t.rlike("[：:]") & F.char_length(head).between(2, 12))


def headline_quality(title: Column, name: Column, stocks: Column) -> Column:
    """1 for a subject, a number and a change; -1 for feeling without number or change; else 0."""
    t = F.trim(F.coalesce(title, F.lit("")))
    number, change = t.rlike("[0-9]"), any_of(t, L.INCREMENT_WORDS)
    return F.when(title_names(t, name, stocks) & number & change, 1).when(~number & ~change & (any_of(t, L.EMOTION_WORDS) | t.rlike("[！!]")), -1).otherwise(0)


def broadcast_reason(title: Column, watched: tuple[str, ...]) -> Column:
    t = F.coalesce(title, F.lit(""))
    spared = any_of(t, (*L.EVENT_VERBS, *watched))
    return F.when(~spared & t.rlike(_MOVE) & t.rlike(_SIZE), "播报体").otherwise("")


def noise_reason(title: Column, name: Column, content: Column, judge_score: Column, judge_scope: Column, judge_leader: Column, watched: tuple[str, ...]) -> Column:
    """Columns, index reports, foreign stock reports, intraday moves and broadcasts, in this order."""
    t = F.coalesce(title, F.lit(""))
    rest = F.regexp_replace(t, "|".join(sorted(L.COLUMN_MARKERS, key=lambda w: -len(w))), "")
    weighty = is_macro_release(rest) | is_major_deal(rest)
    index_move = lambda x: any_of(x, _INDEXES) & any_of(x, L.INDEX_MOVES)
    seen = is_watched(t, name, content, watched)
    column = (
        F.when(any_of(t, L.DAILY_COLUMNS), F.when(weighty | seen, "").otherwise("日报栏目"))
        .when(~(has_signal(rest) | is_macro_release(rest)), "栏目汇总")
        .when(~(weighty | any_of(rest, (*L.HEADLINE_ENTITIES, *watched))) & (index_move(rest) | any_of(rest, L.INTRADAY_WORDS)), "栏目汇总")
        .otherwise("")
    )
    leader = seen | any_of(t, L.NOISE_LEADERS) | (F.coalesce(judge_leader, F.lit(False)) & (F.coalesce(judge_score, F.lit(0.0)) >= 8) & (judge_scope == "stock"))
    body = F.when(any_of(t, L.NOISE_LEADERS), "").otherwise(broadcast_reason(t, watched))
    return (
        F.when(t == "", "").when(any_of(t, L.COLUMN_MARKERS), column).when(index_move(t), "指数播报").when(any_of(t, L.OVERSEAS_STOCKS) & any_of(t, L.OVERSEAS_MOVES), "外盘个股播报")
        .when(any_of(t, L.INTRADAY_WORDS) & ~any_of(t, L.CORPORATE_EVENTS) & ~leader, "盘面异动").otherwise(body)
    )


def passes_threshold(mode: str, score: Column, direction: Column, scope: Column, leader: Column) -> Column:
    s, strong = F.coalesce(score, F.lit(0.0)), F.lower(F.coalesce(direction, F.lit("neutral"))).isin("bullish", "bearish")
    where = F.lower(F.coalesce(scope, F.lit("stock")))
    by_mode = {
        "strict": F.when(where == "sector", (s >= 6) | strong).when(where == "stock", leader & ((s >= 6) | strong)).otherwise(False),
        "standard": (s >= 6) | (strong & where.isin("sector", "stock")),
    }.get(mode, s >= 5)
    return F.when(where == "market", True).otherwise(by_mode)


def tech_source(title: Column, content: Column, source: Column, sectors: Column) -> Column:
    """overseas or domestic where the row speaks of technology, else empty."""
    text = text_of(title, content, F.concat_ws(" ", sectors))
    tech = any_of(text, L.OVERSEAS_TECH_WORDS, abbreviations(L.OVERSEAS_TECH_WORDS))
    return F.when(tech, F.when(any_of(source, L.OVERSEAS_SOURCES), "overseas").otherwise("domestic")).otherwise("")


def has_hard_fact(title: Column, content: Column) -> Column:
    """An amount, a percentage that is no price move, a multiple, a finished deed without a forward word before it, or a quantity."""
    text = text_of(title, F.substring(F.coalesce(content, F.lit("")), 1, 200))
    shares = F.regexp_extract_all(F.concat(F.lit("\n" * 8), text), F.lit(r"(?s)(?=(.{8}(?<![0-9.])[0-9]+(?:\.[0-9]+)?\s*%))"), 1)
    done = F.lit(False)
    for w in L.DONE_EVENT_WORDS:
        at = F.instr(text, w)
        before = F.substring(text, F.greatest(at - 6, F.lit(1)), F.least(at - 1, F.lit(6)))
        done = done | ((at > 0) & ~any_of(before, L.FORWARD_WORDS))
    return text.rlike(r"[0-9]+(?:\.[0-9]+)?\s*(亿|万)") | F.exists(shares, lambda s: ~s.rlike("涨|跌")) | text.rlike("翻[一二两三四五六七八九十百0-9]倍|倍增") | done | text.rlike(_SCALE)


def falls_with_risk(title: Column, content: Column, source: Column, sectors: Column, direction: Column) -> Column:
    """In a risk-off market, bullish technology without a hard fact is held back."""
    tech = (tech_source(title, content, source, sectors) != "") | any_of(F.concat_ws(" ", sectors), L.TECH_SECTOR_WORDS)
    return (direction == "bullish") & tech & ~has_hard_fact(title, content)


def quiet_reason(title: Column, content: Column, direction: Column, score: Column, direct: Column, at: Column) -> Column:
    text = text_of(title, content)
    spared = direct | is_macro_release(text) | is_major_deal(text) | ((direction == "bearish") & (F.coalesce(score, F.lit(0.0)) >= 7))
    return F.when(spared, "").otherwise(quiet_window(at))


def normal_direction(value: Column, title: Column, content: Column) -> Column:
    """Any wording of a direction as one of the six bands; by rules where there is none."""
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    up, down = ("涨", "升", "利好", "看多", "看涨", "偏多", "走强", "上行"), ("跌", "降", "利空", "看空", "看跌", "偏空", "走弱", "回落", "下行")
    names = (
        ("bullish", ("看涨", "看多", "利多", "利好", "强利好", "偏多", "强势", "positive", "涨", "升")),
        ("bearish", ("看跌", "看空", "利淡", "利空", "强利空", "偏空", "弱势", "negative", "跌", "降")),
        ("mildly_bullish", ("弱利好", "小幅利好", "中性偏多")), ("mildly_bearish", ("弱利空", "小幅利空", "中性偏空")), ("mixed", ("多空交织",)), ("neutral", ("中性", "无影响")),
    )
    order = sorted(((w, band) for band, words in names for w in words), key=lambda x: -len(x[0]))
    exact = F.create_map(*[F.lit(x) for pair in order for x in pair])
    part = F.coalesce(*[F.when(F.contains(raw, F.lit(w)), F.lit(band)) for w, band in order])
    ruled = rule_direction(title, content)
    return (
        F.when(raw.isin("bullish", "mildly_bullish", "bearish", "mildly_bearish", "neutral", "mixed"), raw).when(any_of(raw, up) & any_of(raw, down), "mixed")
        .otherwise(F.coalesce(F.element_at(exact, raw), part, F.when(raw.startswith("mildly"), "neutral"), ruled))
    )


def risk_grade(risk_state: Column, high_volatility: Column, down_pct: Column, main_net: Column, gc007: Column, pcr: Column) -> Column:
    warn = F.coalesce(high_volatility, F.lit(False)) | F.coalesce(down_pct >= 80, F.lit(False)) | F.coalesce(main_net <= -500, F.lit(False)) | F.coalesce(gc007 >= 3.0, F.lit(False)) | F.coalesce(pcr >= 1.5, F.lit(False))
    return F.when(risk_state == "risk_off", "风险收缩").when(warn, "警戒").otherwise("中性")


