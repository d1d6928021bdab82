import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.signatures import all_entities, chain_key, merged_signature, same_event, theme_keys
from tidemark.functions.text import overlapping
from tidemark.operators import events
from tidemark.plans import state_queries, views
from tidemark.streaming import folds

SF = "/root/testdata/sf0.001"
SETS = ("stocks", "entities", "events", "numbers", "sectors")


def cases(spark, seed, rounds=4, size=9):
    """Rounds of random headlines, names and sectors: few of each, so that rows meet."""
    r = random.Random(seed)
    rows, heads = [], r.sample(views.HEADLINES, 14)
    for i in range(rounds):
        for j in range(size):
            title = r.choice(heads) + r.choice(("", " 快讯", " 盘中"))
            rows.append((i, j, 100 * i + j, title, r.sample(views.ENTITIES, r.randint(0, 2)), r.sample(views.SECTORS, r.randint(0, 2)), r.random() < 0.5, r.randint(0, 3) / 1.0, r.random()))
    df = spark.createDataFrame(rows, "round int, place int, seq long, title string, entities array<string>, affected_sectors array<string>, push boolean, score double, pref_score double")
    df = df.withColumns({"content": F.lit(""), "name": F.lit(""), "affected_stocks": F.array().cast("array<string>")})
    return events.signed(df, F.col("entities"), F.col("affected_sectors"), F.lit("stock")).cache()


def loop(spark, rows):
    """The groups by a loop in Python; the test and the union of two signatures are asked of Spark, for all rounds at once."""
    listed = {}
    for r in rows.orderBy("round", "place").collect():
        listed.setdefault(r["round"], []).append((r["seq"], {n: r["sig"][n] for n in (*SETS, "title_norm")}))
    kind = folds._SIGNATURE
    flat = lambda s: tuple(s[n] for n in (*SETS, "title_norm"))
    groups = {i: [] for i in listed}
    for j in range(max(map(len, listed.values()))):
        asked = [(i, g, flat(mine[j][1]), flat(sig)) for i, mine in listed.items() if j < len(mine) for g, (sig, _) in enumerate(groups[i])]
        told = {}
        if asked:
            pair = spark.createDataFrame(asked, f"i int, g int, x {kind}, y {kind}")
            for t in pair.select("i", "g", same_event(F.col("x"), F.col("y")).alias("same"), merged_signature(F.col("y"), F.col("x")).alias("both")).collect():
                told[t["i"], t["g"]] = (t["same"], t["both"].asDict())
        for i, mine in listed.items():
            if j >= len(mine):
                continue
            seq, sig = mine[j]
            at = next((g for g in range(len(groups[i])) if told[i, g][0]), None)
            if at is None:
                groups[i].append((sig, [seq]))
            else:
                groups[i][at] = (told[i, at][1], [*groups[i][at][1], seq])
    return {(i, g, m, s) for i, gs in groups.items() for g, (_, seqs) in enumerate(gs) for m, s in enumerate(seqs)}


@pytest.mark.parametrize("seed", range(2))
def test_groups_grow_as_in_the_loop(spark, seed):
    rows = cases(spark, seed)
    want = loop(spark, rows)
    got = {(r["round"], r["group"], r["member"], r["seq"]) for r in folds.grown_groups(rows, ("round",)).collect()}
    assert got == want and len({g[:2] for g in got}) < rows.count()
    worth = {r["seq"]: (r["push"], r["score"], r["pref_score"]) for r in rows.collect()}
    groups = {}
    for i, g, m, s in sorted(want):
        groups.setdefault((i, g), []).append(s)
    assert {r["seq"] for r in folds.best_of_groups(rows, ("round",)).collect()} == {max(seqs, key=lambda s: worth[s]) for seqs in groups.values()}  # max takes the first of equals


def test_a_grown_signature_catches_a_chain(spark):
    # the third is like neither of the first two alone, but like what they make together
    sets = [(["甲"], [], ["并购"], [], []), (["甲"], ["乙"], ["并购"], ["5亿元"], []), ([], ["乙"], ["中标"], ["5亿元"], [])]
    titles = ["甲公司并购", "甲公司并购乙作价5亿元", "乙中标5亿元"]
    kind = folds._SIGNATURE.replace("title_norm", "scope:string,title_norm")
    rows = spark.createDataFrame([(i, i, (*s, "stock", t)) for i, (s, t) in enumerate(zip(sets, titles, strict=True))], f"seq long, place int, sig {kind}")
    got = folds.grown_groups(rows).collect()
    assert len(got) == 3 and {r["group"] for r in got} >= {0}
    assert {(r["group"], r["member"], r["seq"]) for r in got} == {t[1:] for t in loop(spark, rows.withColumn("round", F.lit(0)))}


def facts(spark, rows, seed):
    r = random.Random(seed)
    seqs = [x["seq"] for x in rows.select("seq").collect()]
    known = [(s, r.choice(("", "", "", "noise")), r.random() < 0.1, r.randint(0, 4), r.randint(0, 2), r.random() < 0.2, 3, r.random() < 0.4, r.random() < 0.2, r.random() < 0.3, r.random() < 0.1) for s in seqs]
    df = spark.createDataFrame(known, "seq long, reason string, told boolean, topics long, themes long, used boolean, day long, market boolean, released boolean, spared boolean, direct boolean")
    return rows.join(df, "seq").withColumn("chain", chain_key(F.col("sig"), F.col("title"), F.col("content"))).cache()


@pytest.mark.parametrize(("seed", "limit"), [(0, None), (1, 8), (2, 6)])
def test_rows_see_what_their_round_sent_before(spark, seed, limit):
    rows = facts(spark, cases(spark, seed), seed)
    side = lambda n: rows.select("round", F.col("seq").alias(n), F.col("sig").alias(f"s{n}"))
    a, b = F.col("sx"), F.col("sy")
    topic = F.arrays_overlap(all_entities(a), all_entities(b)) | (F.size(overlapping(a["sectors"], b["sectors"])) > 0)
    near = {(p["x"], p["y"]): p for p in side("x").join(side("y"), "round").select("x", "y", same_event(a, b).alias("same"), topic.alias("topic"), F.arrays_overlap(theme_keys(a), theme_keys(b)).alias("theme")).collect()}
    want = {}
    for i in range(4):
        sent, chains = [], set()
        for x in rows.where(F.col("round") == i).orderBy("place").collect():
            count = lambda n: sum(bool(near[x["seq"], s][n]) for s in sent)  # noqa: B023, E731
            full = x["topics"] + count("topic") >= 5
            if x["market"] and x["released"]:
                full = False
            elif x["market"] and x["themes"] + count("theme") >= 3:
                full = True
            full = full and not x["direct"]
            free = x["chain"] != "" and not x["used"] and x["chain"] not in chains
            over = limit is not None and x["day"] + len(sent) >= limit and not x["spared"] and not x["direct"]
            gate = x["reason"] or ("same event" if x["told"] or count("same") else "topic" if full and not free else "daily limit" if over else "sent")
            if gate == "sent":
                sent.append(x["seq"])
                if full:
                    chains.add(x["chain"])
            want[x["seq"]] = (gate, gate == "sent" and full)
    got = {r["seq"]: (r["gate"], r["exempt"]) for r in folds.admitted(rows, ("round",), daily_limit=limit).collect()}
    assert got == want and len(set(want.values())) > 2


def test_the_sixth_row_of_a_topic_is_stopped(spark):
    rows = spark.createDataFrame([(i, i, f"{'甲乙丙丁戊己庚'[i] * 6}", ["半导体"]) for i in range(7)], "seq long, place int, title string, affected_sectors array<string>")
    rows = rows.withColumns({"content": F.lit(""), "name": F.lit(""), "affected_stocks": F.array().cast("array<string>")})
    rows = events.signed(rows, F.array().cast("array<string>"), F.col("affected_sectors"), F.lit("stock"))
    flags = {n: F.lit(False) for n in ("told", "used", "market", "released", "spared", "direct")} | {n: F.lit(0).cast("long") for n in ("topics", "themes", "day")} | {"reason": F.lit(""), "chain": F.lit("")}
    got = [r["gate"] for r in folds.admitted(rows.withColumns(flags)).orderBy("seq").collect()]
    assert got == ["sent"] * 5 + ["topic"] * 2


def test_empty_rounds(spark):
    rows = cases(spark, 0).where("seq < 0")
    assert folds.best_of_groups(rows, ("round",)).count() == 0


def test_no_row_goes_out_that_any_sent_event_told(spark):
    told = events.already_sent(state_queries._signed(spark, SF), views.event_log(spark, SF), state_queries.as_of())
    sent = state_queries.admitted_events(spark, SF).where("gate = 'sent'")
    assert told.count() > 0 and sent.join(told, "seq").count() == 0
