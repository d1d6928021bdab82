import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import health, state
from tidemark.streaming import keyed

START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def run(spark, tmp_path, batches, schema, of):
    """What the stream gives, one file for each batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={i}"))
    folder = str(tmp_path / "in" / "*")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)
    q = of(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def greedy(times, gap):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= gap:
            kept.append(t)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_spaced_is_the_loop(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("abc"), at(r.choice((r.randint(0, 20000), 1440 * r.randint(0, 12))))) for _ in range(200)] + [("d", at(5))]
    got = state.spaced(spark.createDataFrame(rows, "k string, t timestamp"), "k").collect()
    want = {(k, t) for k in "abcd" for t in greedy([t for x, t in rows if x == k], datetime.timedelta(hours=24))}
    assert {(g["k"], g["t"]) for g in got} == want and len(got) == len(want)


def test_spaced_stream_with_late_and_repeated_rows(spark, tmp_path):
    r = random.Random(5)
    batches, seen = [], []
    for b in range(5):
        base = 2000 * b
        rows = [(r.choice("ab"), at(base + r.randint(0, 1990))) for _ in range(25)]
        batches.append(rows + rows[:3])
        seen += rows
    seen += [("a", at(1_000_000))]
    batches.append([("a", at(1_000_000))])
    batches.append([("a", at(1)), ("z", at(2))])  # far behind the watermark: left out
    batches.append([("a", at(1_000_100))])
    got = run(spark, tmp_path, batches, "k string, t timestamp", lambda s: keyed.spaced(s, "k", late="3000 minutes"))
    want = {(k, t) for k in "ab" for t in greedy([t for x, t in seen if x == k and t < at(900_000)], datetime.timedelta(hours=24))}
    assert {(g["k"], g["t"]) for g in got} == want and len(got) == len(want)
    # what no longer matters is gone: nothing is remembered, two rows wait for the watermark
    left = lambda name: spark.read.format("statestore").option("path", str(tmp_path / "check")).option("stateVarName", name).load().count()
    assert left("known") == 0 and left("waiting") == 2


def test_source_health_stream_is_the_batch(spark, tmp_path):
    r = random.Random(7)
    rounds = []
    for i in range(60):
        counts = {s: r.choice((0, 0, 3)) if s == "c" else 0 if s == "a" and i % 25 < 20 or s == "b" and i > 30 else 2 for s in "abc"}
        if i % 13 == 0:
            counts = dict.fromkeys("abc", 0)  # every source is empty
        rounds += [(s, at(300 * i), n, any(counts.values())) for s, n in counts.items()]
    shuffled = [rounds[i : i + 45] for i in range(0, len(rounds), 45)]
    for part in shuffled:
        r.shuffle(part)
    end = [(s, at(10**6), 1, True) for s in "abc"]
    schema = "source string, t timestamp, count long, alive boolean"
    got = run(spark, tmp_path, [*shuffled, end], schema, lambda s: keyed.source_health(s, late="10 hours"))
    want = health.history(spark.createDataFrame(rounds, schema)).collect()
    key = lambda x: (x["source"], x["t"], x["count"], x["streak"], x["alert"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and sum(x["alert"] for x in want) > 3


def test_empty_history(spark):
    none = spark.createDataFrame([], "source string, t timestamp, count long, alive boolean")
    assert health.history(none).count() == 0 and state.spaced(none.select("source", "t"), "source").count() == 0


class Held:
    """A state of one key that counts how often it is asked."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "get":
                return iter(self.value) if isinstance(self.value, list) else self.value
            if name == "exists":
                return self.value is not None
            self.value = (self.value or []) + args[0] if name == "appendList" else None if name == "clear" else args[0]

        return call


def test_state_is_asked_for_keys_not_rows():
    import types

    import pandas as pd

    calls = []
    handle = types.SimpleNamespace(getListState=lambda *a: Held(calls), getValueState=lambda *a: Held(calls), registerTimer=lambda t: calls.append("timer"))
    rule = keyed.Spaced(10)
    rule.init(handle)
    rows = pd.DataFrame({"u": range(1000, 2000), "count": 1, "alive": True})
    list(rule.handleInputRows(("k",), iter([rows]), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    [out] = rule.handleExpiredTimer(("k",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 5), types.SimpleNamespace(getExpiryTimeInMs=lambda: 1))
    assert out["u"].tolist() == list(range(1000, 2000, 10)) and len(calls) < 12
