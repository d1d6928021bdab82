import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, collocations, mixing, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FILES = [queries.tokenizer_file(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def aligned(rows):
    """n_a, n_b, groups, links, n_best, count_sum and digest of each (id, text), by the libraries and lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILES[0])
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a_bytes, b_bytes = alignment.byte_vocabulary(FILES[0]), alignment.piece_vocabulary(FILES[1])
    out, counts = [], collections.Counter()
    for d, x in rows:
        a = t.encode(" " + x, add_special_tokens=False).ids if x else []
        b = sp.encode(x) if x else []
        whole = (" " + (x or "")).encode()
        if x and not b"".join(a_bytes[i] for i in a) == whole == b"".join(b_bytes[i] for i in b):
            a = b = []
        sizes = [np.cumsum([len(v[i]) for i in ids]).tolist() for v, ids in ((a_bytes, a), (b_bytes, b))]
        groups, i, j = [], 0, 0
        for cut in sorted({*sizes[0]} & {*sizes[1]}):
            i2, j2 = sizes[0].index(cut, i) + 1, sizes[1].index(cut, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        out.append((d, a, b, groups))
        counts.update({(x, y) for p, q in groups for x in p for y in q})
    highest = collections.defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    told = []
    for d, a, b, groups in out:
        links = [(x, y) for p, q in groups for x in p for y in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        told.append((d, len(a), len(b), len(groups), len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(told, key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\n  b", "x\u2581y", "<|endoftext|> <s> </s> <unk> <0x41>", "tabs\tand\r\nlines ", "don't  can't", "日本語 テキスト", "é è", "😀 😀", "\u3000x y", "=" * 300, "ab" * 200 + " " + "é" * 80,
    "1 2  3 4,5 .6", "a . b", "end.", "nul\x00byte", "\u00a0x \u00a0 y", "...... ......",
]


def test_alignment_is_the_lists(spark, monkeypatch):
    rows = [*enumerate(ODD), (0, "a"), (7, "a  b"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "ids": F.lit("x"), "n_a": F.lit(0)})
    want = aligned(rows)
    for listed, sent in ((64, 10**6), (1, 0)):  # every group as distinct pairs; counts by a join
        monkeypatch.setattr(alignment, "LISTED", listed)
        monkeypatch.setattr(alignment, "SENT_PAIRS", sent)
        got = alignment.measured(docs.repartition(3), *FILES)
        assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == want
    assert alignment.measured(docs.where("doc_id < -1"), *FILES).count() == 0


def test_alignment_of_the_table(spark, sf):
    rows = [(r[0], r[1]) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = queries.queries()["op11_tokenizer_alignment"](spark, sf)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == aligned(rows)


def test_stretches_of_common_texts_are_known(spark, monkeypatch):
    chunks = alignment.Chunks(*FILES)
    assert chunks.cut("the cat and  the dog ") == [" the", " cat", " and", "  the", " dog "]
    # each stretch once in a block; texts of several blocks, and blocks of several texts
    rows = [(i, t) for i, t in enumerate(["the cat and the dog", "the dog and the cat 日本", "x\u2581y the cat", "the the the", "=" * 90 + " the cat"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    held = alignment.blocks(docs, *FILES, "doc_id", "text")
    assert alignment.stretches(held).count() == len({c for _, t in rows if "\u2581" not in t for c in chunks.cut(t)})
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 30)
    got = alignment.measured(docs.repartition(4), *FILES)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == aligned(rows)


def test_groups_give_the_tokens_back(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox — déjà vu, naïve 日本")], "doc_id long, text string")
    r = alignment.align(docs, *FILES).first()
    words = alignment.byte_vocabulary(FILES[0]), alignment.piece_vocabulary(FILES[1])
    for side, known in zip("ab", words, strict=True):
        assert b"".join(known[i] for g in r["groups"] for i in g[side]).decode() == " The quick brown fox — déjà vu, naïve 日本"
    for g in r["groups"]:
        assert b"".join(words[0][i] for i in g["a"]) == b"".join(words[1][i] for i in g["b"])


def phrases(rows, max_words, least, covered, most):
    """The phrases by counters."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    some = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in some.items():
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if not any(x == lang and len(q) > len(p) and inside(q) and 100 * c >= covered * a for (x, q), c in some.items()):
            out[lang].append((-score, -a, " ".join(p).encode(), " ".join(p), left, right))
    return sorted((lang, i, p, -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, _, p, left, right) in enumerate(sorted(found)[:most], 1))


@pytest.mark.parametrize(("max_words", "most"), [(3, 2000), (4, 5)])
def test_collocations_are_the_counters(spark, sf, max_words, most):
    rows = [("New York, new  York\tnew york city. É É", "en"), ("new york city hall", "en"), (None, "en"), ("", None), ("a b a b a b", None), ("x\x0by\x0cz x y", "de\t1"), ("A B C " * 60, "en"), ("ü ö ü ö", "de")] * 3
    rows += [(r["text"], r["lang"]) for r in queries.table(spark, sf, "documents").limit(60).collect()]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({"phrase": F.lit("p"), "f": F.lit(1), "key": F.lit("k")})
    got = collocations.collocations(docs.repartition(3), max_words=max_words, least=3, covered=50, most=most)
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == phrases(rows, max_words, 3, 50, most)
    assert collocations.collocations(docs.where("f > 1")).count() == 0


def test_products_over_64_bits(spark):
    a, b = 3 * 10**9, 3 * 10**9 + 7
    score = spark.range(1).select(F.lit(a).alias("a"), F.lit(b).alias("l"), F.lit(b + 2).alias("r")).select(collocations.exact_score()).first()[0]
    assert score == 10**6 * a * a // (b * (b + 2))


def test_phrase_query_is_its_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    ours, theirs = queries.queries()["op12_phrase_collocations"](spark, sf).toPandas(), db.sql(queries.oracle_sql()["op12_phrase_collocations"]).df()
    assert sorted(map(tuple, ours[list(theirs.columns)].itertuples(index=False))) == sorted(map(tuple, theirs.itertuples(index=False))) and len(ours)


def base_scores(rows, held):
    end = object()
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), end] for _, t in rows]
    c = collections.Counter(w for (d, _), t in zip(rows, tokens, strict=True) if not held(d) for w in t)
    total, distinct = sum(c.values()), len(c)
    return [(len(t), sum(c[w] > 0 for w in t), total, sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in t)) for t in tokens]


def test_base_scores_are_the_counters_and_the_model_is_better(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    got = {r["doc_id"]: r for r in queries.queries()["op13_lm_scoring"](spark, sf).collect()}
    assert len(got) == len(rows)
    for (d, _), (n, known, total, base) in zip(rows, base_scores(rows, held), strict=True):
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d), n, known, total) and abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.94 * sum(r["base_score"] for r in out) and sum(r["score"] > r["base_score"] for r in out) > 0.9 * len(out)


def test_probabilities_of_all_next_words_are_one(spark):
    """Over every word that can come next, and one for those that are not known, the model's probabilities add up to one."""
    texts = ["red green blue", "red green red green", "blue red", "green blue green yellow", "red red blue"] * 6
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = mixing.fit(docs, words=3)
    words = ["red", "green", "blue", "yellow", "neverseen"]
    for start in ("", "red ", "green blue "):
        ask = spark.createDataFrame([(i, start + w) for i, w in enumerate(words)], "doc_id long, text string")
        with_end = {r["doc_id"]: r["score"] for r in mixing.score(ask, model).collect()}
        # the end's own probability is taken out: it follows each word
        ends = {}
        for i, w in enumerate(words):
            sides = spark.createDataFrame([(0, start + w)], "doc_id long, text string")
            ends[i] = parts(mixing.score(sides, model).first()["score"], model, (start + w).split())
        whole = sum(10 ** (with_end[i] - ends[i][1] - ends[i][0]) for i in with_end)
        stop = 10 ** parts(None, model, start.split())[1]
        assert abs(whole + stop - 1) < 1e-3


def parts(_, model, words):
    """log10 of what stands before the last word, and of the end after all words, step by step under the model's first weights."""
    import pyarrow as pa

    hashes, begin, symbols = mixing.tokens_of(pa.array([" ".join(words)]), model.codes)
    guess = lambda k, slots: mixing.GUESSES[model.tables[k][slots]]

    def nats(symbols):
        steps = mixing.steps_of(symbols, np.array([0, len(symbols)]), model.codes, mixing.SLOTS)
        return float(mixing.mixed_bits(steps, guess, model.weights)[0][0]) if len(symbols) else 0.0

    rare = model.codes.total + model.codes.distinct - int(model.codes.counts.sum()) - len(model.codes.counts) + 2
    counts = {"yellow": 6}
    shared = sum(math.log10((counts.get(w, 0) + 1) / rare) for w, s in zip(words[:-1], symbols[:-2], strict=True) if s == mixing.ESCAPE)
    before = -nats(symbols[:-2]) / math.log(10) + shared if len(symbols) > 1 else 0.0
    return before, -(nats(symbols) - nats(symbols[:-1])) / math.log(10)


def test_scores_of_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumns({"n_tokens": F.lit("x"), "row": F.lit(1)})
    model = mixing.fit(docs.where("doc_id <> 6"))
    got = mixing.score(docs.repartition(2), model).collect()
    assert len(got) == docs.count() and all(r["score"] < 0 and r["base_score"] < 0 and r["n_known"] <= r["n_tokens"] for r in got)
    same = {round(r["score"], 9) for r in got if r["n_tokens"] == 7}
    assert len(same) == 1  # equal texts score alike
    empty = [r for r in got if r["n_tokens"] == 1]
    assert len({r["score"] for r in empty}) == 1 and {r["bits_per_byte"] is None for r in empty} == {True, False}  # blank texts have bytes
    assert mixing.score(docs.where("doc_id < 0"), model).count() == 0
    none = mixing.fit(docs.where("doc_id < 0"))
    r = mixing.score(docs.where("doc_id = 7"), none).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0)


def test_paths_share_no_prefix():
    weights = np.array([5, 1, 1, 3, 9, 2])
    starts, lengths, nodes, bits, shares = mixing.huffman(weights, 100)
    paths = ["".join(map(str, bits[s : s + n])) for s, n in zip(starts, lengths, strict=True)]
    assert all(not q.startswith(p) for i, p in enumerate(paths) for j, q in enumerate(paths) if i != j) and sum(2.0 ** -len(p) for p in paths) == 1 and (shares == 1).all()
    starts, lengths, nodes, bits, shares = mixing.huffman(weights, 2)
    assert nodes.max(initial=0) < 2
    under = collections.defaultdict(float)
    for s, n, share in zip(starts, lengths, shares, strict=True):
        under[tuple(zip(nodes[s : s + n].tolist(), bits[s : s + n].tolist(), strict=True))] += share
    assert all(abs(v - 1) < 1e-12 for v in under.values())  # what is under one end of a path shares it out


def test_every_bit_of_a_word_is_guessed():
    codes = mixing.Codes.of([(i, 9000 // (i + 1)) for i in range(6000)], 500, 100000, 7000)
    assert sum(2.0 ** -n for n in codes.paths[1].tolist()) == 1 and not codes.shares.any()


def test_training_guesses_are_32_bits_wide():
    counts = np.random.default_rng(3).integers(0, 10**6, (1024, 2), np.int32)
    slots = np.arange(0, 1024, 3, dtype=np.uint32)
    got = mixing.logistic_at(counts, slots)
    assert got.dtype == np.float32 and np.allclose(got, mixing.logistic(counts[slots].astype(np.float64)), atol=1e-5)


def test_weights_are_learned_from_every_stretch(spark):
    text = "the cat sat on the mat and the dog lay by the door " * 16000  # under one pass each
    rows = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string").coalesce(1)
    assert (mixing.fit(rows).weights != mixing.even_weights()).any()


def test_blocks_end_before_they_weigh_on_a_worker(spark):
    docs = spark.range(240, numPartitions=1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 500), i -> concat('w', id * 500 + i, 'q')), ' ') AS text")
    held = alignment.blocks(docs, *FILES, "doc_id", "text").select(F.size("n_a").alias("n"), F.size("rows").alias("rows")).collect()
    assert sum(r.n for r in held) >= 120_000 and sum(r.rows for r in held) == 240
    assert max(r.n for r in held) < 80_000
