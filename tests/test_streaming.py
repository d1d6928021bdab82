import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import events
from tidemark.plans import views
from tidemark.sources import feeds
from tidemark.streaming import rounds

SF = "/root/testdata/sf0.001"


def test_stream_is_the_batch(spark, tmp_path):
    news = views.news(spark, SF)
    news.coalesce(1).write.json(str(tmp_path / "in"))
    log = views.event_log(spark, SF)
    got = []
    q = rounds.stream_rounds(spark.readStream.schema(news.schema).json(str(tmp_path / "in")), lambda: log, lambda df, i: got.extend(df.collect()), str(tmp_path / "check"))
    q.awaitTermination(300)
    latest = news.agg(F.max("published_at")).first()[0]
    assert sorted(map(tuple, got)) == sorted(map(tuple, rounds.round_of(news, log, F.lit(latest).cast("timestamp")).collect())) and got


def candidates(spark, titles):
    rows = spark.createDataFrame([(i, t, i == 1) for i, t in enumerate(titles)], "seq long, title string, push boolean")
    same = {"content": "", "name": "", "source": "", "direction": "bullish", "scope": "market", "score": 8.0, "pref_score": 0.9, "judged": True, "published_at": "2026-01-05 10:00:00"}
    rows = rows.withColumns({k: F.lit(v) for k, v in same.items()} | {k: F.array().cast("array<string>") for k in ("affected_stocks", "affected_sectors", "entities")})
    return events.signed(rows, F.col("entities"), F.col("affected_sectors"), F.col("scope"))


def test_representatives_meet_without_a_shared_key(spark):
    rows = candidates(spark, ["美股开盘三大股指齐涨", "道指开盘涨0.52", "欧洲央行宣布维持利率不变"])
    assert sorted(r["seq"] for r in rounds.representatives(rows).collect()) == [1, 2]


def test_events_sent_within_48_hours_are_not_sent_again(spark):
    rows = candidates(spark, ["美股开盘三大股指齐涨", "欧洲央行宣布维持利率不变"])
    sent = candidates(spark, ["道指开盘涨0.52"]).select(F.lit(1).alias("event_id"), "sig", F.lit("2026-01-04 10:00:00").cast("timestamp").alias("t"))
    gates = lambda at: {r["seq"]: r["gate"] for r in rounds.gated(rows, sent, F.lit(at).cast("timestamp"), ()).collect()}
    assert gates("2026-01-05 10:00:00") == {0: "same event", 1: "sent"}
    assert gates("2026-01-06 10:00:01") == {0: "sent", 1: "sent"}


def test_seen_rows_are_left_out(spark):
    from tidemark.functions.signatures import fingerprint

    news, log, at = views.news(spark, SF), views.event_log(spark, SF), F.lit(views.AS_OF).cast("timestamp")
    before = {r["seq"] for r in rounds.round_of(news, log, at).collect()}
    seen = news.where(F.col("seq").isin(*before)).select(fingerprint(*map(F.col, ("published_at", "title", "content", "name", "affected_stocks"))).alias("fp"))
    assert before and not before & {r["seq"] for r in rounds.round_of(news, log, at, seen=seen).collect()}


def test_windowed_counts(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = rounds.windowed_counts(s).writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == e.count()


def test_landed(spark, tmp_path):
    assert feeds.landed(spark, str(tmp_path / "nothing")).count() == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"seq": 1, "title": "", "content": "x" * 50, "stamp": 1704067200123}) + "\n" + json.dumps({"seq": 2, "title": "t", "content": "y", "stamp": 1704067201}))
    rows = feeds.normal(feeds.landed(spark, str(tmp_path / "in"))).orderBy("seq").collect()
    assert [(r["title"], r["published_at"]) for r in rows] == [("x" * 40 + "...", "2024-01-01 00:00:00"), ("t", "2024-01-01 00:00:01")]


def test_rss_and_kline(spark):
    xml = "<rss><channel><item><title>A &amp;amp; B - Src</title><description>&lt;b&gt;hi&lt;/b&gt; x</description><pubDate>d</pubDate><source>S</source></item><item><title>C</title><description>y</description></item></channel></rss>"
    got = feeds.rss_items(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert [(r["title"], r["content"]) for r in got] == [("A & B", "hi x"), ("C", "y")]
    lines = spark.createDataFrame([("2024-01-02,1,2.5,3,4,5,6.5",), ("bad,1,2",), ("x,1,2,3,4,5,6",)], "line string")
    assert [(str(r["date"]), r["close"], r["amount"]) for r in feeds.kline(lines).collect()] == [("2024-01-02", 2.5, 6.5)]


def test_stateful_rounds(spark, tmp_path):
    from tidemark.streaming import stateful

    news, at = views.news(spark, SF), F.lit(views.AS_OF).cast("timestamp")
    store = stateful.StateStore(spark, str(tmp_path / "state"))
    assert store.batches() == [] and store.read("seen").count() == 0
    first = {r["seq"]: r["gate"] for r in stateful.stateful_round(news, store, at, 1, views.WATCHED, most=10).collect()}
    seen, pending, sent = (store.read(n).collect() for n in ("seen", "pending", "sent"))
    assert store.batches() == [1] and first and len(sent) == sum(g == "sent" for g in first.values())
    assert sum(r["pushed"] for r in seen) == len(sent) and not {r["fp"] for r in seen} & {r["fp"] for r in pending}
    assert pending and all(r["retry"] == 1 and r["payload"] for r in pending)
    # a committed batch is read, not run again
    assert {r["seq"]: r["gate"] for r in stateful.stateful_round(news.limit(1), store, at, 1, views.WATCHED).collect()} == first
    # the same rows again: only those that waited are looked at, and no event goes out twice
    second = stateful.stateful_round(news.where("seq < 0"), store, at, 2, views.WATCHED, most=10).collect()
    assert store.batches() == [1, 2] and second and all(r["seq"] < 0 and r["fp"] in {p["fp"] for p in pending} for r in second)
    assert {r["fp"] for r in store.read("seen").collect()} >= {r["fp"] for r in second}
    assert {r["fp"] for r in store.read("pending").collect()} < {p["fp"] for p in pending} and store.read("seen", 1).count() == len(seen)
    judged = store.read("candidates").collect()
    assert {(r["day"], r["sig_key"]) for r in judged} and len({(r["day"], r["sig_key"]) for r in judged}) == len(judged)
    assert sum(r["pushed"] for r in judged) == len({r["sig_key"] for r in store.read("sent").collect()})
    store.forget(1)
    assert store.batches() == [2]
    with pytest.raises(ValueError):
        stateful.stateful_round(news, store, at, 1)
    # three days later the log is the archive's, and a watched announcement goes out once a day for its key
    later = F.lit("2024-01-05 12:00:00").cast("timestamp")
    notice = news.limit(2).withColumns({"title": F.concat(F.lit("某公司关于解除质押的公告"), F.col("seq").cast("string")), "url": F.lit(""), "watch_key": F.lit("000001|质押"), "seq": F.col("seq") + 10**6})
    third = {r["seq"]: r["gate"] for r in stateful.stateful_round(notice, store, later, 3, most=10).collect()}
    assert sorted(third.values()).count("sent") == 1 and [r["key"] for r in store.read("watch").collect()] == ["000001|质押"]
    assert store.read("archive").count() == len({r["sig_key"] for r in sent}) and store.read("sent").count() == 1
    fourth = stateful.stateful_round(notice.withColumn("title", F.concat("title", F.lit("更正"))), store, later, 4, most=10).collect()
    assert all(r["gate"] != "sent" for r in fourth) and store.read("watch").count() == 1


def test_a_round_that_breaks_off_leaves_nothing(spark, tmp_path, monkeypatch):
    from tidemark.streaming import stateful

    store = stateful.StateStore(spark, str(tmp_path / "s"), {"x": "n long", "y": "n long"})
    tables = lambda n: {"x": spark.range(n).toDF("n"), "y": spark.range(n + 1).toDF("n")}
    store.commit(1, tables(2))

    def broken(draft, batch):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "publish", broken)
        with pytest.raises(OSError):
            store.commit(2, tables(5))
    again = stateful.StateStore(spark, str(tmp_path / "s"), {"x": "n long", "y": "n long"})
    assert again.batches() == [1] and (again.read("x").count(), again.read("y").count()) == (2, 3)
    again.commit(2, tables(5))
    assert again.batches() == [1, 2] and (again.read("x").count(), again.read("y").count()) == (5, 6) and sorted(p.name for p in (tmp_path / "s").iterdir()) == [f"{i:020d}" for i in (1, 2)]
    again.commit(2, tables(9))  # another run of a batch that is there
    assert again.read("x").count() == 5 and len(list((tmp_path / "s").iterdir())) == 2
    open_reader = again.read("x", 1)
    again.forget(1)
    assert again.batches() == [2] and again.read("x").count() == 5 and open_reader.columns == ["n"]


def test_two_replicas_are_merged(spark, tmp_path):
    import datetime

    from tidemark.streaming import stateful

    t = datetime.datetime(2024, 1, 1)
    sig = ([], [], [], [], [], "stock", "t")
    event = lambda i, k: (i, t, "bullish", "x", "s", sig, False, None, k)
    judged = lambda k, pushed, gate: ("2024-01-01", k, "bullish", t, pushed, 5.0, gate, "s", "x")
    sides = {
        "a": {"seen": [("f1", t, True, "x")], "pending": [("p", t, 1, "x", None), ("f2", t, 1, "x", None)], "sent": [event(1, "k")], "archive": [], "candidates": [judged("k", True, "sent"), judged("m", False, "topic")], "watch": [("w", t)]},
        "b": {"seen": [("f1", t, False, "y"), ("f2", t, False, "y")], "pending": [("p", t, 2, "y", None)], "sent": [event(2, "k"), event(3, "l")], "archive": [event(9, "z")], "candidates": [judged("k", False, "threshold")], "watch": [("w", t), ("v", t)]},
    }
    stores = {}
    for name, tables in sides.items():
        stores[name] = stateful.StateStore(spark, str(tmp_path / name))
        stores[name].commit(1, {n: spark.createDataFrame(rows, stateful.TABLES[n]) for n, rows in tables.items()} | {"outcome": spark.createDataFrame([], stateful.OUTCOME)})
    stores["a"].commit(2, stateful.merged(stores["a"], stores["b"]))
    read = lambda n: stores["a"].read(n).collect()
    assert sorted((r["fp"], r["pushed"]) for r in read("seen")) == [("f1", True), ("f2", False)] and [(r["fp"], r["retry"]) for r in read("pending")] == [("p", 2)]
    assert sorted(r["event_id"] for r in read("sent")) == [2, 3] and [r["event_id"] for r in read("archive")] == [9]
    assert sorted((r["sig_key"], r["pushed"], r["gate"]) for r in read("candidates")) == [("k", True, "sent"), ("m", False, "topic")] and sorted(r["key"] for r in read("watch")) == ["v", "w"]


def test_daily_limit_spares_signals(spark):
    at = F.lit("2026-01-05 10:00:00").cast("timestamp")
    rows = candidates(spark, ["公司甲获批新药", "公司乙签订合同", "央行宣布降准", "公司丙签订合同"])
    sent = candidates(spark, ["日报一", "日报二"]).select(F.col("seq").alias("event_id"), "sig", F.lit("2026-01-05 01:00:00").cast("timestamp").alias("t"))
    gates = {r["seq"]: r["gate"] for r in rounds.gated(rows, sent, at, (), daily_limit=3).collect()}
    assert gates == {0: "sent", 1: "daily limit", 2: "sent", 3: "daily limit"}


def test_numbered(spark):
    from tidemark.common import numbered

    rows = spark.createDataFrame([((i * 37) % 101, i) for i in range(300)], "k int, seq long").repartition(5)
    got = [(r["k"], r["seq"]) for r in numbered(rows, [F.desc("k"), F.asc("seq")], "n").orderBy("n").collect()]
    assert got == sorted(got, key=lambda x: (-x[0], x[1])) and len(got) == 300
