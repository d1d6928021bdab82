import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import neardup, queries, shared


def brute(rows, words, percent):
    """{id: (set size, least id reachable)} by comparing all pairs."""
    sets = []
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append((i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("words", "table"), [(2, "sf0.001"), (5, "sf0.001")])
def test_documents_are_brute_force(spark, words, table):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, words=words).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], words, 80)


@pytest.mark.parametrize("seed", range(2))
def test_families_are_brute_force(spark, seed):
    """Families whose members are linked through some of them only: several turns and the last comparison have work."""
    r = random.Random(seed)
    rows = []
    for f in range(3):
        base = [f"w{f}_{i}" for i in range(60)]
        for _ in range(50):
            words = list(base)
            for _ in range(r.randint(0, 9)):
                words[r.randrange(60)] = f"x{r.random()}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(docs, words=2).collect()}
    assert got == brute(rows, 2, 80)


@pytest.mark.parametrize(("words", "seed"), [(1, 0), (2, 1), (5, 2)])
def test_links_apart_from_the_centre_are_found(spark, words, seed):
    """Members that share their changes are linked with each other and not with the family's centre: they meet through rare elements of their differences to it."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    rows = [" ".join(base)] * 3
    for _ in range(40):  # near the centre
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(150)] = f"n{r.random()}"
        rows.append(" ".join(w))
    for g in range(12):  # small groups away from it
        away = list(base)
        for i in r.sample(range(150), {1: 16, 2: 14, 5: 8}[words]):
            away[i] = f"g{g}_{i}"
        for _ in range(4):
            w = list(away)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(150)] = r.choice([f"x{r.random()}", "common"])
            rows.append(" ".join(w))
    r.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, words, 80)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(docs, words=words).collect()} == expected
    assert len({c for _, c in expected.values()}) > 2


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(7, a), (7, b), (3, b), (9, a), (20, c), (20, c), (21, c)]
    got = {(x["doc_id"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(7, 3, False), (3, 3, True), (9, 3, False), (20, 20, True), (21, 20, False)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, a, "y")], "doc_id long, text string, _maybe string")
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 20]


def test_odd_rows(spark, odd_docs):
    rows = neardup.near_duplicates(odd_docs, words=2).collect()
    assert len(rows) == odd_docs.count()
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert {(1, 5, 1, True), (2, 5, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 7, True), (9, 1, 9, True), (None, 0, None, True)} <= got
    assert neardup.near_duplicates(odd_docs.where("doc_id < 0")).count() == 0


def test_components(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(25)]
    edges = spark.createDataFrame([(a, b) for a, b in pairs if a != b], "a long, b long")
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {x["node"]: x["component"] for x in shared.components(edges).collect()} == {n: find(n) for n in root}


def test_sequential_test_keeps_its_promise():
    table = neardup.least_matches(0.8, 160, 1e-6)
    r = random.Random(0)
    for _ in range(2000):
        seen = [r.random() < 0.8 for _ in range(160)]
        assert all(sum(seen[:n]) >= least for n, least in table.items())
    assert sum(all(sum(s[:n]) >= m for n, m in table.items()) for s in ([r.random() < 0.4 for _ in range(160)] for _ in range(500))) == 0


def test_bitmap(spark):
    ids = spark.range(0, 1000, 7).withColumnRenamed("id", "n")
    some = shared.IdBitmap(ids, "n").matching(spark.range(1000).withColumnRenamed("id", "n"), "n")
    kept = {r["n"] for r in some.collect()}
    assert kept >= set(range(0, 1000, 7)) and len(kept) < 300 and some.columns == ["n"]


def test_ordered_prefix(spark):
    r = random.Random(2)
    rows = [(r.choice([None, 1, 2]), r.randint(0, 5), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, v long, i long").repartition(7)
    got, totals = shared.ordered_prefix(df, "g", [F.desc("v"), F.col("i")], "v", "place", "before")
    found = {(x["g"], x["i"]): (x["place"], x["before"]) for x in got.collect()}
    for g in (None, 1, 2):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))
        assert [found[g, x[2]] for x in own] == [(n, sum(y[1] for y in own[:n])) for n in range(len(own))] and totals[g] == (len(own), sum(x[1] for x in own))


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality classifier", "minhash near-dedup", "best-fit packing"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, shared.written(stage(spark, kept, sf))
        assert kept.columns == docs.columns and kept.join(before, "doc_id", "left_anti").count() == 0
    third = before  # what the near-dup stage was given
    expected = {i for i, (_, c) in brute([(r["doc_id"], r["text"]) for r in third.collect()], 5, 80).items() if i == c}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == expected
    packed = corpus_pipeline.STAGES[3][1](spark, kept, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == expected


def test_pipeline_of_odd_rows(spark, odd_docs, tmp_path):
    base = "/root/testdata/sf0.001"
    docs = queries.table(spark, base, "documents")
    odd = odd_docs.select("doc_id", "text", "source").unionByName(docs.select(F.col("doc_id") + 1000, "text", "source").toDF("doc_id", "text", "source"))
    odd = odd.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long")).select(docs.columns)
    rows = odd
    for _, stage in corpus_pipeline.STAGES:
        rows = shared.written(stage(spark, rows, base))
    assert rows.count() > 0
    none = odd.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, none, base).count() == 0


def test_stages_keep_columns_of_any_name(spark, sf):
    docs = queries.table(spark, sf, "documents")
    odd = docs.withColumns({"score": F.lit(123.0), "a.b": F.col("doc_id") * 2, "SCORE x`y": F.lit("z"), "c0": F.col("lang"), "kept": F.lit(7)})
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, odd, sf)
        assert kept.columns == odd.columns
        rows = kept.toDF(*[f"x{i}" for i in range(len(odd.columns))]).collect()
        i = odd.columns.index("score")
        assert rows and all(r[i] == 123.0 and r[i + 1] == 2 * r[0] and r[i + 2] == "z" and r[i + 4] == 7 for r in rows)
        assert stage(spark, odd.where("doc_id < 0"), sf).count() == 0
