import itertools

import pytest
from pyspark.sql import functions as F

from tidemark.functions import gates, judge, scoring, signatures, text, times
from tidemark.functions import lexicons as L


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for n, v in values.items())).select(column(*map(F.col, names))).first()[0]


@pytest.mark.parametrize(("url", "clean"), [
    ("https://WWW.Example.com/a/b/?x=1#y", "https://example.com/a/b"), ("HTTP://m.example.com", "http://m.example.com"), ("", ""), ("  ", ""), (None, ""), ("https://a.com/x//", "https://a.com/x"),
])
def test_clean_url(spark, url, clean):
    assert one(spark, text.clean_url, u=url) == clean


def test_simhash_near_and_far(spark):
    value = lambda t: one(spark, text.simhash32, t=t)
    a, b, c = map(value, ("半导体板块大涨创历史新高", "半导体板块大涨创历史新高！", "央行降准释放流动性"))
    assert bin(a ^ b).count("1") == 2 and bin(a ^ c).count("1") > 3
    assert value("四个字符") == 0 and value(None) == 0


@pytest.mark.parametrize(("a", "b", "n"), [("恩智浦洽谈收购", "因传恩智浦洽谈收购而飙升", 7), ("", "x", 0), ("abc", "xyz", 0), ("aXbc", "Ybcz", 2), ("aaaa", "aa", 2)])
def test_common_stretch(spark, a, b, n):
    assert one(spark, text.common_stretch, a=a, b=b) == n


def test_common_subsequence(spark):
    assert one(spark, text.common_subsequence, a="存储ETF上市", b="内存ETF今日上市") == 6
    assert one(spark, text.common_subsequence, a="", b="内存") == 0


def test_common_subsequences_of_any_length(spark):
    import random

    r = random.Random(3)
    pairs = [("".join(r.choices("abc中文", k=n)), "".join(r.choices("abc中文", k=m))) for n, m in ((5, 9), (1, 1), (40, 40), (60, 80), (61, 64), (75, 70), (0, 0), (59, 3))]

    def table(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            before, row = row, [0]
            for j, d in enumerate(y):
                row.append(before[j] + 1 if c == d else max(before[j + 1], row[j]))
        return row[-1]

    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.common_subsequence(F.col("a"), F.col("b")).alias("n")).collect()
    assert len(got) == len(pairs) and all(x["n"] == table(x["a"], x["b"]) for x in got)


def test_title_norm_keeps_dots_between_digits(spark):
    assert one(spark, text.title_norm, t="升2.9个基点. A.B【x】" + "长" * 60) == ("升2.9个基点ABx" + "长" * 60)[:40]


def test_amounts(spark):
    assert one(spark, text.amounts, t="签约30.53亿元") == one(spark, text.amounts, t="30.53 亿补充协议") == ["亿:3.053e+01"]
    assert one(spark, text.amounts, t="1亿与10000万") == ["万:1.000e+04", "亿:1.000e+00"]
    assert one(spark, text.amounts, t="12341亿") == one(spark, text.amounts, t="12344亿")


def test_boundaries(spark):
    assert not one(spark, gates.has_signal, t="STMicroelectronics 财报") and one(spark, gates.has_signal, t="*ST海医") and one(spark, gates.has_signal, t="ST股")
    assert not one(spark, scoring.is_tech, t="nAMD患者") and not one(spark, scoring.is_tech, t="AMD 黄斑变性") and one(spark, scoring.is_tech, t="AMD芯片")


@pytest.mark.parametrize(("at", "factor"), [("2024-01-01 19:30:00", 1.0), ("2024-01-01 17:30", 0.95), ("2024-01-01T15:00:00", 0.9), ("2024-1-1", 0.8), ("2023/12/01 00:00:00", 0.6), ("2024-01-02 00:00:00", 1.0), ("soon", 0.0), ("", 0.0)])
def test_freshness(spark, at, factor):
    assert one(spark, lambda t: times.freshness(t, F.lit("2024-01-01 20:00:00").cast("timestamp")), t=at) == factor


@pytest.mark.parametrize(("at", "window"), [("2024-01-06 12:00:00", "周末静默"), ("2024-01-05 21:30:00", "夜间静默(21:30-08:00)"), ("2024-01-05 21:29:00", ""), ("2024-01-05 07:59:00", "夜间静默(21:30-08:00)"), ("2024-01-05 08:00:00", "")])
def test_quiet_window(spark, at, window):
    assert one(spark, lambda t: times.quiet_window(t.cast("timestamp")), t=at) == window


def negated(t: str, kw: str) -> bool:
    count, at = 0, t.find(kw)
    while at >= 0:
        before, i = t[max(0, at - 8) : at], 0
        while i < len(before):
            word = next((w for w in sorted(L.NEGATIONS, key=len, reverse=True) if before.startswith(w, i)), None)
            count, i = (count + 1, i + len(word)) if word else (count, i + 1)
        at = t.find(kw, at + 1)
    return count % 2 == 1


def direction(title: str, content: str) -> str:
    full = f"{title} {content}"
    for p in L.REVERSING_PREFIXES:
        if (at := full.find(p)) >= 0:
            window = full[at : at + len(p) + 12]
            if any(w in window for w in L.BEARISH_WORDS):
                return "bullish"
            if any(w in window for w in (*L.BULLISH_WORDS, "增持", "回购", "并购", "重组", "中标", "签约")):
                return "bearish"
    sentence = content
    for mark in "。；;！!？?":
        sentence = sentence.split(mark)[0]
    for t in (title, sentence):
        if any(w in t and not negated(t, w) for w in L.BULLISH_WORDS):
            return "bullish"
        if any(w in t and not negated(t, w) for w in L.BEARISH_WORDS):
            return "bearish"
    return "neutral"


def test_rule_direction_is_brute_force(spark):
    titles = ("业绩预增", "未能否认业绩预增", "公司没有退市风险", "不会大涨，不会大涨", "取消增持计划", "放宽稀土出口管制", "市场走高", "平淡", "终止回购", "大涨后跌停", "未大涨但下跌", "拒绝否认中标", "")
    contents = ("", "股价暴跌。其他大涨", "无关；大涨", "解除制裁", "未见减持！涨停")
    rows = [(t, c) for t, c in itertools.product(titles, contents)]
    got = spark.createDataFrame(rows, "t string, c string").select("t", "c", scoring.rule_direction(F.col("t"), F.col("c")).alias("d")).collect()
    assert [(r["t"], r["c"], r["d"]) for r in got] == [(t, c, direction(t, c)) for t, c in rows]


def sig(title, events=(), numbers=(), entities=(), stocks=(), sectors=()):
    return (list(stocks), list(entities), list(events), list(numbers), list(sectors), "stock", title)


PAIRS = [
    (sig("恩智浦洽谈收购Ambarella", ["并购重组"]), sig("安霸股价因传恩智浦洽谈收购而飙升", ["并购重组"]), True),
    (sig("甲公司洽谈收购乙科技", ["并购重组"], entities=["甲公司"]), sig("丙集团宣布收购丁能源", ["并购重组"], entities=["丁能源"]), False),
    (sig("行云科技签约30.53亿", ["中标签约"], ["亿:3.053e+01"]), sig("补充协议30.53亿元", ["中标签约"], ["亿:3.053e+01"]), True),
    (sig("今日A股三大指数集体收涨"), sig("欧洲央行宣布维持利率不变"), False),
    (sig("美债10Y收益率升至4.75%为2025年1月以来最高", ["x"]), sig("美债10Y收益率突破4.75%创2025年1月以来新高"), True),
    (sig("美债10Y收益率升至4.75%"), sig("美债10Y收益率跌破4.30%"), False),
    (sig("美股开盘三大股指齐涨"), sig("道指开盘涨0.52"), True),
    (sig("日本央行考虑加息", entities=["日本央行"]), sig("日本央行考虑降息", entities=["BOJ"]), False),
    (sig("最快可能在9月加息日元", entities=["日本央行"]), sig("加息或提速美元对日元急跌", entities=["BOJ"]), True),
]


def test_same_event(spark):
    kind = "struct<stocks:array<string>,entities:array<string>,events:array<string>,numbers:array<string>,sectors:array<string>,scope:string,title_norm:string>"
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(PAIRS)], f"i int, a {kind}, b {kind}")
    there = rows.select("i", signatures.same_event(F.col("a"), F.col("b")).alias("s"), signatures.same_event(F.col("b"), F.col("a")).alias("r")).orderBy("i").collect()
    assert [r["s"] for r in there] == [x for _, _, x in PAIRS] == [r["r"] for r in there]


def test_noise(spark):
    reason = lambda t: one(spark, lambda x: gates.noise_reason(x, F.lit(""), F.lit(""), F.lit(0.0), F.lit("stock"), F.lit(False), ("中际旭创",)), t=t)
    assert [reason(t) for t in ("隔夜要闻汇总", "午评创业板指半日跌35", "SK海力士涨幅扩大至5%", "PCB概念表现活跃 方邦股份涨超10%", "中际旭创跌停", "央行宣布降准")] == ["日报栏目", "栏目汇总", "外盘个股播报", "盘面异动", "", ""]


def test_read_answer():
    broken = '说明\n```json\n[{"idx": 1, "title": "是个"悬而未决"的问题", "push": false, "score": 4.5}, {“idx”: 2， "push": true, "score": 8}]\n```'
    assert [(d["idx"], d["push"], d["score"]) for d in judge.read_answer(broken)] == [(1, False, 4.5), (2, True, 8)]
    assert judge.read_answer(None) == judge.read_answer("no list") == []


def test_rule_direction_builds_its_text_once(spark):
    from tidemark.functions import scoring

    rows = spark.range(2).selectExpr("CAST(id AS string) AS title", "CAST(id AS string) AS content").repartition(2)
    plan = rows.select(scoring.rule_direction(F.col("title"), F.col("content")))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("concat_ws(") <= 2
