import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses, quality, queries, sentencepieces, toxicity

SF1 = "/root/testdata/sf0.1"
MODEL = queries.tokenizer_file("piece_bpe_32k.model")


def held_out(spark, query, label):
    rows = query(spark, SF1).where("held_out").join(spark.read.parquet(f"{SF1}/labels.parquet"), "doc_id").select("score", "predicted", F.col(label).alias("y")).toPandas()
    order = rows.score.rank()
    ones, zeros = order[rows.y == 1], order[rows.y == 0]
    auc = (ones.mean() - (len(ones) + 1) / 2) / len(zeros)
    return auc, (rows.predicted[rows.y == 1] == 1).mean(), (rows.predicted[rows.y == 0] == 0).mean()


def test_quality_held_out(spark):
    auc, kept, rejected = held_out(spark, queries.op9_quality, "quality")
    assert auc > 0.98 and kept > 0.99 and rejected > 0.7


def test_toxicity_held_out(spark):
    auc, caught, clean = held_out(spark, queries.op4_toxicity, "toxic")
    assert auc > 0.9 and caught > 0.6 and clean > 0.99  # the small table has few documents of each invented insult


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_scores_of_odd_texts(spark, odd_docs, sf, module, label):
    labels = queries.table(spark, sf, "labels")
    model = module.fit(queries.table(spark, sf, "documents"), labels, queries.learnable(5, 0))
    rows = module.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault((r["text"] or "").strip() if (r["text"] or "").strip() == "" else r["text"], r["score"]) == r["score"]
    assert module.score(odd_docs.where("doc_id < 0"), model).count() == 0
    prior = module.fit(queries.table(spark, sf, "documents"), labels.where(f"{label} = 1"), lambda c: F.lit(True))
    assert {r["score"] for r in module.score(odd_docs, prior).collect()} == {round(1 - 1e-6, 6)}


def test_labelled_sample(spark):
    from tidemark.llm import shared

    docs = spark.createDataFrame([(i, "w" * (10 + i)) for i in range(40)] + [(5, "a"), (None, "n"), (40, None), (41, "x" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    sample, prior = shared.labelled_sample(docs, labels, "toxic", lambda c: c != 7, 10, 1000, 1000)
    assert len(sample) == 10 and sum(y for _, y in sample) == 5 and abs(prior - 29 / 59) < 1e-9
    assert all(len(t) in (0, 1) or int(t.count("w") - 10) % 2 == y for t, y in sample if "x" not in t) and ("w" * 17, 1) not in sample
    whole, _ = shared.labelled_sample(docs, labels, "toxic", lambda c: c.isNotNull(), 100, 10_000, 5000)
    assert {("", 0), ("a", 1), ("x" * 5000, 1)} <= {*whole} and len(whole) == 42  # ids without a document are left out
    assert shared.labelled_sample(docs.where("doc_id < 0"), labels, "toxic", lambda c: c.isNotNull(), 10, 1000, 1000)[0] == []
    assert "x" * 5000 not in dict(shared.labelled_sample(docs, labels, "toxic", lambda c: c.isNotNull(), 100, 10_000, 4999)[0])


def kernel(a: str, b: str) -> float:
    """The subsequence kernel by its definition."""

    def weights(w):
        out = {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < toxicity.SPAN and (w[i] + w[j] + w[k]).isalpha():
                out.setdefault(w[i] + w[j] + w[k], []).append(toxicity.DECAY ** (k - i + 1))
        return out

    x, y = weights(a), weights(b)
    dot = sum(sum(x[s]) * sum(y[s]) for s in x.keys() & y.keys())
    norm = lambda z: sum(v * v for vs in z.values() for v in vs)
    return dot / np.sqrt(norm(x) * norm(y)) if x and y else 0.0


def test_kernel_is_its_definition():
    words = ["idiot", "id.iot", "idddiot", "tooidi", "morning", "ab"]
    rows, _ = toxicity.kernel_rows(words)
    assert np.allclose(rows @ rows.T, [[kernel(a, b) for b in words] for a in words], atol=1e-5)


def test_gaps_are_tolerated():
    r = random.Random(0)
    plain = ["".join(r.choices(("the", "an", "er", "on", "re", "st", "ing"), k=3)) for _ in range(400)]
    sample = [(" ".join(r.sample(plain, 30) + ["blockhead", "numbskull"][: i % 2 * 2]), i % 2) for i in range(300)]
    model = toxicity.train(sample, 0.5)
    score = lambda t: model.scores(pa.array([t]))[0]
    assert min(map(score, ("blockhead", "the block-head an", "bl.ock.head", "blockkhead", "b l o c k h e a d", "Blockhead!"))) > 0.5 > max(map(score, ("the an", "", "reston")))


def test_quality_features_stay_within_texts():
    texts = ["ab cd", "", "xyz", "xyz", " q "]
    whole, bounds = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        own, own_bounds = quality.features(pa.array([t]))
        for a, b, c, d in zip(whole, bounds, own, own_bounds, strict=True):
            assert a[b[i] : b[i + 1]].tolist() == c[d[0] : d[1]].tolist()


def test_licences_are_brute_force(spark, sf):
    docs = queries.table(spark, sf, "documents").unionByName(queries.table(spark, sf, "documents").limit(1).withColumn("text", F.lit("\n\n".join([*licenses.TEMPLATES["mit"], "the license of the version", "nothing here", "MIT"]))), allowMissingColumns=True)
    model = licenses.fit(docs)
    rows = licenses.scan(docs, model).collect()
    got = {(r["doc_id"], r["paragraph"], r["family"]): r["probability"] for r in rows if r["lines"] == 1}
    within = {(r["doc_id"], i, r["family"]) for r in rows if r["lines"] > 1 for i in range(r["paragraph"], r["paragraph"] + r["lines"])}
    expected = {}
    for r in docs.select("doc_id", "text").collect():
        for i, line in enumerate((r["text"] or "").split("\n")):
            p = model.probabilities(line)
            if (k := int(np.argmax(p))) < len(licenses.TEMPLATES) and model.words & {*licenses.words_of(line)}:
                expected[r["doc_id"], i, licenses.FAMILIES[k]] = p[k]
    assert got.keys() <= expected.keys() and expected.keys() - got.keys() <= within and all(abs(got[k] - expected[k]) < 1e-5 for k in got) and got


ORDINARY = ["the quick brown fox", "an ordinary line of text", "version of the work", "of the and in a to", "this is by or with no from"]


def test_every_template_is_confirmed(spark):
    lines = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(lines)], "doc_id long, text string")
    model = licenses.train(ORDINARY)
    got = {r["doc_id"]: (r["family"], r["confirmed"], r["similarity"]) for r in licenses.scan(docs, model).collect()}
    assert got == {i: (f, True, 1.0) for i, (f, _) in enumerate(lines)}
    assert all(licenses.FAMILIES[int(np.argmax(model.probabilities(t)))] == "unknown" for t in ("the of and", "", "quick fox jumps", "see the file"))


def test_versions_and_unseen_licences(spark):
    texts = ["Licensed under the Apache License, Version 1.1.", "SPDX-License-Identifier: AGPL-3.0", "SPDX-License-Identifier: Foo-1.0", "Licensed under the Frobnitz License, Version 2.0.", "under the GNU General Public License, version 3.0", "a copy of this software and associated documentation files"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = licenses.train(ORDINARY)
    got = {r["doc_id"]: r for r in licenses.scan(docs, model).collect()}
    assert (got[0]["family"], got[0]["version"], got[0]["confirmed"]) == ("apache", "1.1", False)
    assert (got[1]["family"], got[1]["confirmed"]) == ("agpl", True) and got[5]["family"] == "mit"
    assert 2 not in got or not got[2]["confirmed"] and got[2]["probability"] < 0.7
    assert 3 not in got or not got[3]["confirmed"]
    assert (got[4]["family"], got[4]["version"]) == ("gpl", "3")
    assert [licenses.version_of(t) for t in texts] == [{0: "1 1", 1: "3", 2: "1", 3: "2", 4: "3", 5: ""}[i] for i in range(6)]


UNSEEN = ("CDDL-1.0", "Artistic-2.0", "OFL-1.1", "Zlib", "WTFPL", "CC0-1.0", "BSL-1.0", "PostgreSQL", "NCSA", "Python-2.0", "Ruby", "PHP-3.01", "Vim", "OSL-3.0", "EUPL-1.2", "MS-PL", "AFL-3.0", "CPAL-1.0", "SSPL-1.0", "BUSL-1.1", "QPL-1.0")


def test_licences_of_no_family_are_not_confirmed(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    model = licenses.fit(docs)
    frames = ("SPDX-License-Identifier: {}", "Licensed under the {} License.", "This work is distributed under the terms of the {} licence")
    lines = [f.format(n) for n in UNSEEN for f in frames] + ["SPDX-License-Identifier: MIT", "SPDX-License-Identifier: ISC", "SPDX-License-Identifier: Apache-2.0"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), model).where("confirmed").collect()
    n = len(lines)
    assert sorted((r["doc_id"], r["family"]) for r in got) == [(n - 3, "mit"), (n - 2, "isc"), (n - 1, "apache")]
    assert all(r["probability"] > 0.5 for r in got)


def test_wrapped_notices_are_confirmed(spark):
    import textwrap

    long = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts if len(t) > 90]
    wrapped = [textwrap.wrap(t, 38) for _, t in long]
    texts = ["Some code.\n\n" + "\n".join(" * " + x for x in lines) + "\n *\nend of it" for lines in wrapped]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    model = licenses.train(ORDINARY)
    rows = licenses.scan(docs, model).where("confirmed").collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"], r["similarity"]) for r in rows) == sorted([(i, 2, f, 1.0) for i, (f, _) in enumerate(long)] * 2)


def test_licences_of_odd_rows(spark, odd_docs):
    docs = odd_docs.unionByName(spark.createDataFrame([(50, "x\nReleased under the MIT License.\n" + "y" * 9), (50, "x\nReleased under the MIT License.\n" + "y" * 9)], "doc_id long, text string"), allowMissingColumns=True)
    rows = licenses.scan(docs, licenses.fit(docs)).collect()
    assert [(r["doc_id"], r["paragraph"], r["family"]) for r in rows] == [(50, 1, "mit")] * 2
    assert licenses.scan(docs.where("doc_id < 0"), licenses.fit(docs.where("doc_id < 0"))).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.Pieces(MODEL, merges=True)


TEXTS = ["", " ", "  a  b", "Hello, world.", "日本語 テスト", "\x00𓀀x", "ﬁ Ａ é", "a\nb\tc", "hahahaha!!!!!!!???", "▁▁x ▁", "aaaaaaaaaaaa", "don't stop"]


def test_best_path_is_brute_force(pieces):
    scores = {w: pieces.automaton.get(w)[2] for w in pieces.automaton}
    plain = sentencepieces.Pieces(MODEL)
    for text in TEXTS:
        n = pieces.normalize(text)
        best = [0.0] + [-1e99] * len(n)
        for e in range(1, len(n) + 1):
            for s in range(max(0, e - 48), e):
                if n[s:e] in scores:
                    best[e] = max(best[e], best[s] + scores[n[s:e]])
            if n[e - 1] not in pieces.singles:
                best[e] = max(best[e], best[e - 1] + pieces.unknown_score)
        for p in (pieces, plain):
            ids, score, _, normal = p.encode([text])[0]
            assert score == pytest.approx(best[-1]) and normal == n and p.decode(ids) == n.replace("▁", " ").removeprefix(" ")
            assert p.best(n)[1] == pytest.approx(best[-1])  # words apart or the whole at once


def test_merges_are_the_library(pieces, spark, sf):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = TEXTS + [r["text"] for r in queries.table(spark, sf, "documents").select("text").collect()]
    assert [np.frombuffer(e[2], "<u4").tolist() for e in pieces.encode(texts)] == library.encode(texts)


def test_query_returns_the_ids_of_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op8_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode(texts[r.doc_id] or ""), "<u4")
        assert (r.n_merge_ids, r.merge_ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())), r.doc_id


def test_words_end_where_no_piece_goes_on():
    fresh, words = sentencepieces.Pieces(MODEL, merges=True), ["alpha", "beta", "gamma", "delta"]
    fresh.encode([" ".join(f"{a}.\n{b}" for a in words for b in words)])
    assert len(fresh.young) == 2 * len(words) + 2  # with and without a mark, the full stop and the line end
    some = [*fresh.young, "é\0", "x" * 50, "日a", "▁"]
    assert fresh.found_together(some) == [fresh.found(w) for w in some]


def test_taking_merges_back_is_merging(pieces):
    rng = np.random.default_rng(3)
    known = list(pieces.text_of)
    for a, b in rng.choice(known, (4000, 2)).tolist():
        x, y = pieces.text_of[a], pieces.text_of[b]
        assert pieces.beside(a, b) == (pieces.merged(x) == [x] and pieces.merged(y) == [y] and pieces.merged(x + y) == [x, y]), (x, y)


def test_encode_and_decode_odd_rows(spark, odd_docs):
    rows = sentencepieces.decode(sentencepieces.encode(odd_docs, MODEL), MODEL).collect()
    assert len(rows) == odd_docs.count() and all(r["decoded_text"] == r["normal_text"] for r in rows)
    assert sentencepieces.encode(odd_docs.where("doc_id < 0"), MODEL).count() == 0
