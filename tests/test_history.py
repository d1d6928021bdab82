import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, market, replay
from tidemark.plans import history_queries, views
from tidemark.streaming import stateful

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2024, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


def test_actions(spark):
    """One code for each way a history can go."""
    cached, feeds = [], []
    old = lambda code, source, end=10: cached.extend((code, day(i), 1.0 + i, 5.0, source) for i in range(end))
    feed = lambda code, p, source, days, close=2.0, amount=7.0: feeds.extend((code, p, source, day(i), close, amount) for i in days)
    old(1, "sina_volume"), feed(1, 0, "sina_volume", range(15))  # the same source: appended
    old(2, "sina_volume"), feed(2, 0, "tencent_volume", range(15))  # another unit: rebuilt
    old(3, None), feed(3, 0, "sina_volume", range(15))  # nobody knows the source: rebuilt
    old(4, "mystery"), feed(4, 0, "mystery", range(15))  # the same source, but its unit is not known: rebuilt
    feed(5, 0, "sina_volume", range(15))  # new
    old(6, "sina_volume", 14)  # no feed: kept
    old(7, "sina_volume", 5), feed(7, 0, "sina_volume", range(8))  # all too old: nothing
    old(8, "sina_volume"), feed(8, 0, "sina_volume", range(14)), feed(8, 0, "sina_volume", [14], close=float("nan")), feed(8, 1, "eastmoney_hist", range(15))  # one bad row: the next source
    old(9, "eastmoney_hist"), feed(9, 0, "eastmoney_hist", [*range(14), 14, 14])  # a repeated row
    schema = "code long, date date, close double, amount double, source string"
    c = spark.createDataFrame(cached, schema)
    f = spark.createDataFrame(feeds, "code long, priority int, source string, date date, close double, amount double")
    workdays = spark.createDataFrame([(day(i),) for i in range(20)], "day date")
    got = history.index_history(c, f, workdays, F.lit(day(14)), F.lit(day(2))).collect()
    told = {}
    for r in got:
        told.setdefault(r["code"], []).append(r)
    assert {k: (v[0]["action"], len(v), {r["source"] for r in v}, {r["unit"] for r in v}) for k, v in told.items()} == {
        1: ("append", 13, {"sina_volume"}, {"shares"}), 2: ("rebuild", 13, {"tencent_volume"}, {"hands"}), 3: ("rebuild", 13, {"sina_volume"}, {"shares"}), 4: ("rebuild", 13, {"mystery"}, {"unknown"}), 5: ("new", 13, {"sina_volume"}, {"shares"}),
        6: ("keep", 12, {"sina_volume"}, {"shares"}), 8: ("rebuild", 13, {"eastmoney_hist"}, {"yuan"}), 9: ("append", 13, {"eastmoney_hist"}, {"yuan"}),
    }
    assert [r["close"] for r in sorted(told[1], key=lambda r: r["date"])] == [1.0 + i for i in range(2, 10)] + [2.0] * 5
    assert history.index_history(c.where("code < 0"), f.where("code < 0"), workdays, F.lit(day(14)), F.lit(day(2))).count() == 0


def quote(price="10", high="11", low="9", hands="3", yuan="99", fields=40):
    cells = ["x"] * fields
    for i, v in ((3, price), (33, high), (34, low), (36, hands), (37, yuan)):
        if i < fields:
            cells[i] = v
    return "~".join(cells)


def test_quotes(spark):
    lines = [quote(), quote(high="9.5"), quote(price="0"), quote(price="nan"), quote(hands="-1"), quote(yuan="?"), quote(fields=36), quote(fields=37), "", None, quote(low="x")]
    bars = [r["b"] for r in spark.createDataFrame([(x,) for x in lines], "line string").select(history.quoted_bar(F.col("line")).alias("b")).collect()]
    full = (10.0, 11.0, 9.0, 300.0, 99.0)
    assert [b and tuple(b) for b in bars] == [full, (10.0, None, None, 300.0, 99.0), None, None, None, (*full[:4], None), None, (*full[:4], None), None, None, (10.0, None, None, 300.0, 99.0)]


def test_bars_of_a_stream_are_replaced_until_they_are_final(spark, tmp_path):
    at = lambda d, h: datetime.datetime(2024, 1, 1 + d, h)
    batches = [
        [(1, at(0, 10), quote("10")), (1, at(0, 9), quote("9.5")), (2, at(0, 10), quote("0"))],
        [(1, at(0, 14), quote("10.5")), (1, at(0, 14), quote("10.5")), (1, at(0, 11), quote("9"))],  # repeated, and older than what is known
        [(1, at(3, 10), quote("12", high="13", low="11"))],
        [(2, at(3, 10), quote("6", high="8", low="5"))],  # Spark leaves out what was late a batch ago
        [(1, at(0, 15), quote("99", high="100")), (2, at(3, 11), quote("7", high="8", low="6"))],  # the first is behind the watermark
    ]
    schema = "code long, at timestamp, line string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    store = stateful.StateStore(spark, str(tmp_path / "bars"), stateful.BARS)
    stateful.stream_bars(stream, store, str(tmp_path / "check")).awaitTermination(300)
    bars = store.read("bars")
    assert sorted((r["code"], r["date"].day, r["close"]) for r in bars.collect()) == [(1, 1, 10.5), (1, 4, 12.0), (2, 4, 7.0)] and len(store.batches()) <= 3
    final = spark.createDataFrame([(1, datetime.date(2024, 1, 1), 10.25, 1.0), (1, datetime.date(2024, 1, 2), 10.0, 1.0)], "code long, date date, close double, amount double")
    assert sorted((r["code"], r["date"].day, r["close"], r["provisional"]) for r in history.with_provisional(final, bars).collect()) == [(1, 1, 10.25, False), (1, 2, 10.0, False), (1, 4, 12.0, True), (2, 4, 7.0, True)]


def test_every_action_is_in_the_query(spark):
    kinds = {r["action"] for r in history_queries.index_history(spark, "/root/testdata/sf0.01").select("action").distinct().collect()}
    assert kinds == {"append", "rebuild", "new"}  # what is kept without new rows is too old here, and gives nothing


def test_panels_of_any_width_are_one(spark):
    bars = views.bars(spark, SF)
    rows = {}
    for width in (3, 400):
        chunks = market.wide_panels(bars, "close", bars.where("code = 1"), width)
        assert all(len(panel.columns) == 2 + len(codes) for codes, panel in chunks)
        rows[width] = sorted(tuple(map(str, r)) for codes, panel in chunks for r in market.long_panel(codes, panel, "close").collect())
    assert rows[3] == rows[400] and len(rows[3]) == bars.select("date").distinct().count() * bars.select("code").distinct().count()
    assert market.wide_panels(bars.where("code < 0"), "close", bars) == []


def test_replay_calls_blocked_deeds_wrong(spark):
    titles = ["PCB概念表现活跃 方邦股份涨超10%", "某股涨超10% 拉升", "隔夜要闻汇总：某公司回购股份", "央行宣布降准", "某股涨超10% 拉升"]
    rows = spark.createDataFrame([(t,) for t in titles], "title string")
    t = F.col("title")
    judged = replay.judged(rows, replay.archived_reason(t, ()), replay.archived_reason(t, ("方邦股份",)), ("方邦股份",))
    sums = replay.summary(judged).first()
    assert sums["n"] == 5 and sums["watched"] == 1 and sums["old_blocked"] >= sums["new_blocked"] >= 2
    table = replay.crossed(judged).collect()
    assert sum(r["n"] for r in table) == 5 and all((r["change"] == "kept") == (r["old"] == r["new"] == "") for r in table)
    blocked = [r for r in judged.collect() if r["new"]]
    assert all(r["wrong"] == (r["watched"] or r["deed"]) for r in blocked)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_quote_is_split_once(spark):
    quotes = spark.range(3).selectExpr("id AS code", "timestamp_micros(id) AS at", "concat(CAST(id AS string), repeat('1~', 40)) AS line").repartition(2)
    assert plan_of(history.intraday_bars(quotes)).count("split(") == 1


def test_feeds_are_read_once_for_all_choices(spark):
    rows = lambda n: spark.range(n).selectExpr("id % 3 AS code", "date_add(DATE '2024-01-01', CAST(id AS INT)) AS date", "1.0D AS close", "2.0D AS amount", "'sina_volume' AS source")
    feeds = rows(77).withColumn("priority", F.lit(0))
    found = history.index_history(rows(9), feeds, rows(77).select(F.col("date").alias("day")), F.lit("2024-03-10").cast("date"), F.lit("2024-01-01").cast("date"))
    # its rows, and the ends of its histories; the choice is made in a table of its own
    assert plan_of(found).count("(0, 77,") <= 3
    assert found.count() == 70 and {r["action"] for r in found.select("action").collect()} == {"append"}


@pytest.mark.parametrize("width", (2, 3, 64))
def test_panel_blocks_are_the_wide_panels(spark, width):
    bars = spark.createDataFrame([(f"2024-01-{d:02}", c, float(10 * c + d)) for c in (1, 3, 4, 9, 12) for d in (1, 2, 3) if (c + d) % 4], "date string, code long, close double")
    mark = bars.where("code = 1")
    want = sorted(tuple(map(str, r)) for codes, panel in market.wide_panels(bars, "close", mark, width) for r in market.long_panel(codes, panel, "close").collect())
    blocks = market.panel_blocks(bars, "close", mark, width)
    assert sorted(tuple(map(str, r)) for r in market.long_blocks(blocks, "close").collect()) == want
    # one table for all blocks: no union of a plan for each
    assert blocks.select("block").distinct().count() == -(-5 // width) and "Union" not in plan_of(blocks)
