import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.common import stored
from tidemark.functions.signatures import event_groups, titled_stocks
from tidemark.functions.text import amounts, text_of
from tidemark.operators import dedup, events, health, market, ranking, state
from tidemark.plans import views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def news(spark):
    return views.news(spark, SF).cache()


def greedy(order, near):
    kept = []
    for x in order:
        if not any(near(k, x) for k in kept):
            kept.append(x)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_greedy_keep_is_the_loop(spark, seed):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(30), 2))) for _ in range(r.randint(0, 60))}
    kept = dedup.greedy_keep(spark.range(30).withColumnRenamed("id", "seq"), spark.createDataFrame(sorted(pairs), "a long, b long"))
    assert sorted(x[0] for x in kept.collect()) == greedy(range(30), lambda a, b: (a, b) in pairs)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_keep_by_keys_is_the_loop(spark, seed):
    r = random.Random(seed)
    keys = {i: {r.randint(0, 12) for _ in range(r.randint(0, 3))} for i in range(30)}
    rows = spark.createDataFrame([(i, str(k)) for i, ks in keys.items() for k in ks], "seq long, key string")
    kept = dedup.greedy_keep_by_keys(spark.range(30).withColumnRenamed("id", "seq"), rows)
    assert sorted(x[0] for x in kept.collect()) == greedy(range(30), lambda a, b: bool(keys[a] & keys[b]))


def test_first_of_events_is_the_loop(spark, news):
    rows = news.select("seq", titled_stocks(F.col("affected_stocks"), F.col("name"), F.col("title")).alias("s"), event_groups(F.col("title"), F.col("content")).alias("e"), amounts(text_of("title", "content")).alias("n")).orderBy("seq").collect()
    known = {r["seq"]: tuple(map(set, (r["s"], r["e"], r["n"]))) for r in rows}
    near = lambda a, b: bool(known[a][0] & known[b][0] and (known[a][1] & known[b][1] or known[a][2] & known[b][2]))
    assert sorted(x["seq"] for x in dedup.first_of_events(news).select("seq").collect()) == greedy(sorted(known), near)


def test_first_of_titles_is_the_loop(spark, news):
    from tidemark.functions.text import title_core

    core = {r["seq"]: r["c"] for r in news.select("seq", title_core(F.col("title")).alias("c")).collect()}

    def near(a, b):
        x, y = core[a], core[b]
        short, long = sorted((x, y), key=len)
        alike = bool(x and y) and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.6
        return alike or (len(short) >= 6 and short in long)

    assert sorted(x["seq"] for x in dedup.first_of_titles(news).select("seq").collect()) == greedy(sorted(core), near)


def test_order_of_rows_does_not_matter(spark, news):
    one = dedup.three_layers(news).select("seq").collect()
    two = dedup.three_layers(news.orderBy(F.rand(1)).repartition(3)).select("seq").collect()
    assert sorted(one) == sorted(two) and len(one) < news.count()


@pytest.mark.parametrize(("counts", "quota"), [((0, 0, 0), (None, 0, 0)), ((5, 0, 0), (None, 0, 0)), ((25, 5, 5), (10, 5, 5)), ((5, 20, 10), (None, 10, 5))])
def test_quota(spark, counts, quota):
    row = spark.createDataFrame([counts], "d long, s long, m long").select(ranking.quota(F.col("d"), F.col("s"), F.col("m")).alias("q")).select("q.*").first()
    assert tuple(row) == quota


def test_display_keeps_the_caps(news):
    order = [F.asc("seq")]
    shown = ranking.for_display(news, order)
    assert shown.count() <= news.count()
    assert ranking.for_display(shown, order).count() == shown.count()  # nothing more goes the second time


def at(text):
    return datetime.datetime.fromisoformat(text)


def test_merges(spark):
    seen = lambda *rows: spark.createDataFrame(rows, "fp string, t timestamp, pushed boolean, title string")
    a, b = ("x", at("2024-01-01"), True, "a"), ("x", at("2024-01-02"), False, "b")
    for one, two in ((a, b), (b, a)):
        assert [tuple(r) for r in state.merge_seen(seen(one), seen(two)).collect()] == [a]
    pend = lambda *rows: spark.createDataFrame(rows, "fp string, t timestamp, retry int, title string, payload string")
    local, remote = ("x", at("2024-01-01"), 2, "l", None), ("x", at("2024-01-01"), 2, "r", None)
    assert state.merge_pending(pend(local), pend(remote)).first()["title"] == "l"
    ev = lambda *rows: spark.createDataFrame(rows, "event_id long, t timestamp, sig_key string")
    merged = state.merge_events(ev((1, at("2024-01-01"), "k")), ev((2, at("2024-01-01"), "k"), (3, at("2024-01-01"), "m")))
    assert sorted(r["event_id"] for r in merged.collect()) == [2, 3]


def test_spaced(spark):
    log = spark.createDataFrame([("a", at(f"2024-01-01T{h:02}:00:00")) for h in (0, 5, 23)] + [("a", at("2024-01-02T00:00:00")), ("b", at("2024-01-01T01:00:00"))], "k string, t timestamp")
    assert sorted((r["k"], r["t"].day, r["t"].hour) for r in state.spaced(log, "k").collect()) == [("a", 1, 0), ("a", 2, 0), ("b", 1, 1)]


def test_streaks_agree(spark):
    rounds = spark.createDataFrame([("a", i, c) for i, c in enumerate((0, 3, 0, 0))] + [("b", i, 0) for i in range(7)], "source string, round int, count long")
    last = {r["source"]: r["streak"] for r in health.latest(rounds).collect()}
    full = {r["source"]: r["streak"] for r in health.streaks(rounds).orderBy("round").collect()}
    assert last == full == {"a": 2, "b": 7}
    none = spark.createDataFrame([("a", 1, 0, 9, None)], "source string, round int, count long, streak long, last_alert timestamp")
    assert health.alerts(none, F.lit("2024-01-01").cast("timestamp")).count() == 0  # every source is empty


def test_next_day_crosses_years(spark):
    days = [datetime.date(2023, 12, 28), datetime.date(2024, 1, 3), datetime.date(2026, 1, 5)]
    cal = spark.createDataFrame([(d,) for d in days], "day date")
    ev = [datetime.date(2023, 12, 28), datetime.date(2023, 12, 30), datetime.date(2024, 1, 4), datetime.date(2025, 6, 1), datetime.date(2026, 2, 1), None]
    got = market.next_day(spark.createDataFrame(list(enumerate(ev)), "id int, pub date"), cal).orderBy("id").collect()
    assert [(r["id"], r["day"]) for r in got] == [(0, days[0]), (1, days[1]), (2, days[2]), (3, days[2])]


def test_mean_ranks(spark):
    rows = spark.createDataFrame([("g", float(v)) for v in (1, 2, 2, 5)], "g string, v double")
    assert sorted(r["k"] for r in market.mean_ranks(rows, ["g"], "v", "k").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_empty_tables(spark, news):
    none = news.where("seq < 0")
    assert dedup.three_layers(none).count() == dedup.first_of_events(none).count() == dedup.first_of_titles(none).count() == ranking.before_judging(none).count() == 0


def test_topics_count_an_event_once(spark):
    sig = "struct<stocks:array<string>,entities:array<string>,events:array<string>,numbers:array<string>,sectors:array<string>,scope:string,title_norm:string>"
    row = lambda e, s: ([], e, [], [], s, "stock", "t")
    rows = spark.createDataFrame([(1, row(["NVIDIA", "台积电(TSM.N)"], ["AI算力"]))], f"seq long, sig {sig}")
    log = spark.createDataFrame([(1, at("2024-01-01T10:00:00"), row(["英伟达", "台积电"], ["算力"])), (2, at("2024-01-01T11:00:00"), row([], ["半导体"])), (3, at("2023-12-01T11:00:00"), row(["英伟达"], []))], f"event_id long, t timestamp, sig {sig}")
    assert events.topic_counts(rows, log, F.lit("2024-01-01 12:00:00").cast("timestamp")).first()["n"] == 1


def test_titles_are_decided_in_steps(spark, monkeypatch):
    """Steps of any size keep what the loop keeps; pairs come once each, and are all pairs."""
    r = random.Random(5)
    words = ["央行宣布降准释放资金", "半导体板块大涨", "公司签订合同", "alpha", "beta", "gamma"]
    cores = sorted({"".join(r.choices(words, k=r.randint(1, 3))) + r.choice(["", "甲乙", "丙丁x", "12"]) for _ in range(90)}, key=lambda _: r.random())
    sets = [set(c) for c in cores]
    near = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6 or any(len(x) >= 6 and x in y for x, y in ((cores[i], cores[j]), (cores[j], cores[i])))
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cores)], "seq long, title string")
    titles = dedup.distinct_titles(rows)
    pairs = [(p["a"], p["b"]) for p in dedup.title_pairs(titles).collect()]
    assert sorted(pairs) == [(i, j) for i in range(len(cores)) for j in range(i + 1, len(cores)) if near(i, j)] and pairs
    kept = []
    for i in range(len(cores)):
        if not any(near(k, i) for k in kept):
            kept.append(i)
    monkeypatch.setattr(dedup, "FIRST", 4)
    assert sorted(x["seq"] for x in dedup.first_alike(titles).collect()) == kept


def test_rare_characters_and_blocks_lose_no_pair(spark, monkeypatch):
    """Most characters without a bit of their own, and blocks of three titles."""
    r = random.Random(8)
    cores = sorted({"".join(r.sample("甲乙丙丁戊己庚abcdeé", r.randint(1, 8))) for _ in range(120)}, key=lambda _: r.random())
    sets = [set(c) for c in cores]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cores)], "seq long, title string")
    monkeypatch.setattr(dedup, "BIT_CHARS", 5)
    monkeypatch.setattr(dedup, "TITLES", 3)
    marked = dedup.marked_titles(dedup.distinct_titles(rows)).cache()
    assert marked.where("size(rare) > 0").count() > 100
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6
    got = sorted((x["s"], x["l"]) for x in dedup.title_links(marked, marked).collect())
    assert got == [(i, j) for i in range(len(cores)) for j in range(len(cores)) if i != j and alike(i, j)] and got
    assert sorted((x["s"], x["l"]) for x in dedup.title_links(marked, marked, once=True).collect()) == [p for p in got if p[0] < p[1]]


def test_exploded_titles_are_not_broadcast(spark, news):
    marked = stored(dedup.marked_titles(dedup.distinct_titles(news)))
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (dedup.title_links(marked, marked), dedup.held_titles(marked, marked))]
    assert all("SortMergeJoin" in p for p in plans) and "Broadcast" not in plans[1]
