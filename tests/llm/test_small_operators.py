import hashlib
import io
import itertools
import random
import wave
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import media, packing, queries, resharding, topk_search, url_filters


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, sf, db, name):
    ours, theirs = queries.queries()[name](spark, sf).toPandas(), db.sql(queries.oracle_sql()[name]).df()
    columns = list(ours.columns)
    plain = lambda f: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in f[columns].itertuples(index=False))
    assert plain(ours) == plain(theirs)


URLS = [None, "", "no scheme", "http://Example.COM/en/7?x#y", "https://a.example.com/en/8", "https://xcom/en/1", "ftp://com/en/", "http://m.example.net/de/80", "http://example.net/de/9", "http://org?x=/es/", "http://org#/es/", "http://ORG/es/a", "//x://net/de/1", "http://é.org/es/", "http://a\nb.com/en/\n1", "http://x\n.com/en/", "http://com\n/en/", "http://" + "a" * 5000 + ".org/es/" + "b" * 5000]


def brute_rule(rules, host, path):
    fits = [(-len(r.text), r.text, r.verdict) for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fits)[1:] if fits else (None, "allow")


def test_url_rules_are_brute_force(spark):
    rules = [url_filters.Rule.parse(*r) for r in queries.URL_RULES]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string").withColumn("_judged", F.lit("stays"))
    got = url_filters.filter_urls(rows, rules).orderBy("page_id").collect()
    assert len(got) == len(URLS) + 3
    for r, u in zip(got, URLS + URLS[:3], strict=True):
        host, path = url_filters.split_url(u)
        assert (r["host"], r["path"]) == (host, path) and (r["rule"], r["verdict"]) == brute_rule(rules, host, path)
    assert url_filters.filter_urls(rows.where("page_id < 0"), rules).count() == 0
    assert url_filters.filter_urls(rows, []).where("verdict <> 'allow'").count() == 0


def test_url_rules_are_the_contracts(spark, tmp_path):
    spark.createDataFrame(enumerate(("http://a.net/de/1", "http://example.net/de/8", "http://m.example.net/de/9", "http://a.com/en/1", "http://example.com/en/7", "http://org/es/", "http://org/fr/")), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r["rule"], r["verdict"]) for r in queries.op1_url_filters(spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == [("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block"), (None, "allow")]
    for word, rule in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")):
        assert f"('{word}', '{rule}')" in queries.oracle_sql()["op1_url_filters"]


def test_url_wildcards_and_rare_tokens():
    rule = url_filters.Rule.parse("block", "ads*.example.com/*/banner/")
    assert rule.tokens() == {"example", "com", "banner"}
    index = url_filters.RuleIndex([rule], {"example": 9, "com": 9, "banner": 1})
    assert list(index.by_token) == ["banner"]
    assert index.judge("x.ads7.example.com", "/en/banner/1") == rule and index.judge("example.com", "/en/banner/1") is None


def test_top_k_on_odd_vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(5)]) for i in range(60)] + [(60, None), (61, [1.0, None, 0.0, 0.0, 0.0]), (80, [float("nan")] * 5), (100, [float("inf")] * 5), (120, [1.0, 2.0]), (140, [2.0, 1.0]), (160, []), (161, []), (None, [1.0] * 5), (20, [0.5] * 5)]
    vectors = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, score long")
    got = {}
    for x in topk_search.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=7, vector_block=16, query_block=2, step=2).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    clean = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q in {i for i, _ in clean if i % 20 == 0}:
        v = min(v for i, v in clean if i == q)  # of two rows under one id the smaller vector asks
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in clean if i != q and len(w) == len(v))[:7]
        assert sorted(got.get(q, [])) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert topk_search.top_k(vectors.where("vec_id < 0"), "vec_id", "embedding", F.lit(True)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_min_cost_flow_is_least(seed):
    r = random.Random(seed)
    supply = [r.randint(0, 50) for _ in range(4)]
    capacity = resharding.even_capacities(sum(supply), 4)
    flow = resharding.min_cost_flow(supply, capacity, [[int(i != j) for j in range(4)] for i in range(4)])
    assert [sum(f) for f in flow] == supply and [sum(f[j] for f in flow) for j in range(4)] == capacity
    # with unit costs no plan keeps more than what fits where it is
    assert sum(f[i] for i, f in enumerate(flow)) == sum(map(min, supply, capacity))


def all_flows(supply, capacity):
    """Every way to ship all supply within the capacities."""
    if not supply:
        yield []
        return
    for row in itertools.product(*(range(min(supply[0], c) + 1) for c in capacity)):
        if sum(row) == supply[0]:
            for rest in all_flows(supply[1:], [c - x for c, x in zip(capacity, row, strict=True)]):
                yield [list(row), *rest]


@pytest.mark.parametrize("seed", range(6))
def test_min_cost_flow_is_brute_force(seed):
    r = random.Random(seed)
    supply = [r.randint(0, 4) for _ in range(3)]
    capacity = [r.randint(2, 5) for _ in range(3)]
    cost = [[r.randint(0, 9) for _ in range(3)] for _ in range(3)]
    price = lambda f: sum(cost[i][j] * f[i][j] for i in range(3) for j in range(3))
    best = min((price(f) for f in all_flows(supply, capacity)), default=None)
    flow = resharding.min_cost_flow(supply, capacity, cost)
    if best is not None:
        assert sum(map(sum, flow)) == sum(supply) and price(flow) == best


@pytest.mark.parametrize("shares", [(5, 1, 1, 1, 0, 2, 3, 1), (1, 0, 0, 0, 0, 0, 0, 0), (1, 2, 3, 4, 5, 6, 7, 8)])
def test_uneven_capacities_move_the_fewest_bytes(spark, sf, shares):
    docs = queries.table(spark, sf, "documents").select("doc_id", "text", "source")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(8))
    rows = resharding.reshard(docs, old, 8, shares=shares).select("doc_id", "size", "old_shard", "shard").toPandas()
    assert sorted(rows.doc_id) == sorted(r[0] for r in docs.select("doc_id").collect())
    want = resharding.capacities_for(int(rows["size"].sum()), 8, shares)
    assert sum(want) == rows["size"].sum() and all((w == 0) == (s == 0) for w, s in zip(want, shares))
    before, after = (rows.groupby(c)["size"].sum().reindex(range(8), fill_value=0).tolist() for c in ("old_shard", "shard"))
    # what cannot stay moves, and no more; each cut falls between two rows
    cuts = sum(b > w for b, w in zip(before, want)) + 8
    largest = rows["size"].max()
    moved = rows["size"][rows.old_shard != rows["shard"]].sum()
    assert abs(moved - (sum(before) - sum(map(min, before, want)))) <= cuts * largest
    assert all(abs(a - w) <= cuts * largest for a, w in zip(after, want))
    blocks = resharding.plan_blocks({o: (1, b) for o, b in enumerate(before) if b}, 8, shares)
    assert all(shares[j] > 0 for cut in blocks.values() for _, j in cut)


def test_capacities_are_checked():
    for shares in ((1, 2), (0, 0, 0), (1, -1, 2)):
        with pytest.raises(ValueError):
            resharding.capacities_for(10, 3, shares)
    assert resharding.capacities_for(10, 3, (1, 1, 2)) == [2, 3, 5] and resharding.even_capacities(11, 4) == resharding.capacities_for(11, 4)


def test_resharding_moves_the_fewest_bytes(spark, sf):
    docs = queries.table(spark, sf, "documents").select("doc_id", "text", "source")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(8))
    rows = resharding.reshard(docs, old, 8).select("size", "old_shard", "shard").toPandas()
    before = rows.groupby("old_shard")["size"].sum().reindex(range(8), fill_value=0).tolist()
    least = sum(before) - sum(map(min, before, resharding.even_capacities(sum(before), 8)))
    moved = rows["size"][rows.old_shard != rows["shard"]].sum()
    # a block begins with the row that holds its first byte: each cut is off by less than a row
    assert abs(moved - least) <= 8 * rows["size"].max()


COLUMNS = {
    "op1_url_filters": "page_id host path rule verdict", "op2_topk_search": "query_id rank vec_id score", "op3_resharding": "doc_id size text_crc32 law shard slot grown_shard", "op4_toxicity": "doc_id held_out score predicted",
    "op5_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op6_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op7_license_scans": "doc_id paragraph family confirmed",
    "op8_sentencepiece": "doc_id n_ids ids_crc32 n_merge_ids merge_ids_crc32", "op9_quality": "doc_id held_out score predicted", "op10_minhash_near_dedup": "doc_id n_shingles component_id kept",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_every_query_covers_its_table(spark, sf, name):
    rows = queries.queries()[name](spark, sf).toPandas()
    assert {*COLUMNS[name].split()} <= {*rows.columns}
    if "doc_id" in COLUMNS[name] and name != "op7_license_scans":
        assert {*rows.doc_id} == {r["doc_id"] for r in queries.table(spark, sf, "documents").select("doc_id").collect()}


def test_media_query_is_brute_force(spark, sf):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in queries.table(spark, sf, "documents").collect()}
    for r in queries.op5_media(spark, sf).collect():
        payload = media.payload_of(texts[r["doc_id"]])
        stored = media.to_wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_resharding(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op3_resharding(spark, sf).toPandas()
    assert sorted(rows.doc_id) == sorted(docs)
    for r in rows.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    sums = rows.groupby("shard")["size"].sum()
    assert set(sums.index) == set(range(8)) and sums.max() - sums.min() <= 8 * rows["size"].max()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))


def test_resharding_odd_rows(spark, odd_docs):
    old = F.when(F.col("source") == "a", F.lit(None)).when(F.col("source") == "b", 99).otherwise(0)
    moved = resharding.slots(resharding.reshard(odd_docs, old, 3))
    assert moved.count() == odd_docs.count() and set(moved.columns) > set(odd_docs.columns) - {"size", "old_shard", "shard", "slot"}
    assert {r["shard"] for r in moved.collect()} <= {0, 1, 2}
    assert resharding.reshard(odd_docs.where("doc_id < 0"), old, 3).count() == 0


def test_unmoved_shards_are_read_in_place(spark):
    docs = spark.createDataFrame([(i, "x" * 9, i % 2) for i in range(40)] + [(100 + i, "x" * 9, 2) for i in range(20)], "doc_id long, text string, old int")
    rows = resharding.reshard(docs, F.col("old"), 3).toPandas()
    assert (rows.old_shard == rows["shard"]).all() and rows.groupby("shard")["size"].sum().tolist() == [200] * 3


def test_media_round_trip(spark, odd_docs):
    texts = [r["text"] for r in odd_docs.select("text").collect()]
    rows = media.add_media(odd_docs).collect()
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts, strict=True):
        raw = (t or "").encode()
        with wave.open(io.BytesIO(bytes(r["media"])), "rb") as f:
            back = f.readframes(f.getnframes())
        assert back == bytes(r["payload"]) and back[: len(raw)] == raw and not any(back[len(raw) :]) and len(back) % 64 == 0 and len(back) >= 64
        assert r["n_bytes"] == len(raw) and len(r["times"]) == len(r["codes"])
    by_text = {}
    for r, t in zip(rows, texts, strict=True):
        assert by_text.setdefault(t or "", (r["times"], r["codes"])) == (r["times"], r["codes"])
    assert media.add_media(odd_docs.where("doc_id < 0")).count() == 0


def test_fingerprint_finds_tones():
    t = np.arange(8 * media.WINDOW)
    tone = lambda k: (128 + 60 * np.sin(2 * np.pi * k * t / media.WINDOW)).astype(np.uint8)
    _, codes = media.fingerprint(tone(20))
    assert {int(c) >> 16 for c in codes} == {20} and {int(c) & 255 for c in codes} == {1, 2, 3}
    long = np.tile(tone(20), 40)
    assert all(np.array_equal(a, b) for a, b in zip(media.fingerprint(long, run=7), media.fingerprint(long), strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece(seed):
    r = random.Random(seed)
    counts = {n: r.randint(1, 40) for n in r.sample(range(1, 129), r.randint(1, 90))}
    plan, name = packing.plan_sequences(counts, 128)
    assert name in ("complements", "best fit")
    used = {}
    for parts, times in plan:
        assert sum(parts) <= 128 and times > 0
        for p in parts:
            used[p] = used.get(p, 0) + times
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    # no worse than best fit decreasing
    bins: list[int] = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        room = min((b for b in bins if b >= n), default=None)
        if room is None:
            bins.append(128 - n)
        else:
            bins.remove(room)
            bins.append(room - n)
    assert -(-total // 128) <= sum(t for _, t in plan) <= len(bins)


def test_exact_complements_of_all_kinds():
    assert packing.plan_sequences({10: 2}, 10) == ([((10,), 2)], "complements")
    assert packing.plan_sequences({7: 3, 3: 3}, 10) == ([((7, 3), 3)], "complements")
    assert packing.plan_sequences({7: 1, 2: 1, 1: 1}, 10) == ([((7, 1, 2), 1)], "complements")
    assert sum(t for _, t in packing.plan_sequences({4: 1, 3: 1, 2: 1, 1: 1}, 10)[0]) == 1


def test_packing(spark, sf, odd_docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    for docs, size in ((queries.table(spark, sf, "documents"), 2048), (odd_docs, 100)):
        texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        rows = packing.pack(packing.token_pieces(docs, path, size), size).toPandas()
        expected = sorted((-1 if d is None else d, tuple(plain.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t in texts)
        whole, start = [], {}
        for r in rows.sort_values(["doc_id", "piece"], na_position="first").itertuples():
            assert r.length == len(r.ids) // 4 and r.start % size == 0 and r.length <= size
            start.setdefault((r.doc_id, r.start), 0)
        if docs is not odd_docs:
            for d, g in rows.sort_values("piece").groupby("doc_id"):
                whole.append((d, tuple(np.frombuffer(b"".join(map(bytes, g.ids)), "<u4").tolist())))
            assert sorted(whole) == expected
        assert rows.length.sum() == sum(len(ids) for _, ids in expected)
        for _, g in rows.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= size
    assert packing.pack(packing.token_pieces(odd_docs.where("doc_id < 0"), path, 100), 100).count() == 0


def test_chunks_are_the_whole_text():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    odd = ["ΣΑΣ. Foo's x", "áb É ﬁ İstanbul K", "don't  stop...\tnow\x1cthen x 12,5 a.b.c U.S., <|endoftext|> hi<|startoftext|>.", "  ", "", "a\r\nb\x0b c", "日本語。テスト, 12345.", "é. ́x l'été. x'S", "Ünï, ö. ß! ñ; É:"]
    for _ in range(2):  # unknown, then remembered
        assert [np.frombuffer(i, "<u4").tolist() for i in packing.encode_texts(odd, path)] == [plain.encode(t, add_special_tokens=False).ids for t in odd]


def test_no_chunks_are_remembered_between_partitions():
    known = packing.ChunkIds(queries.tokenizer_file("word_bpe_49k.json"))
    first = known.of(["the word, the word.", "thing"])
    known.of(["another"])
    known.rest()
    assert not known.young and not known.old and not known.chars
    assert known.of(["the word, the word.", "thing"]) == first
