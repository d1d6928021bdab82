import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def odd_docs(spark):
    """Null ids and texts, empty, blank and long texts, equal and repeated rows, and columns named like results."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "a"), (2, "alpha beta gamma delta epsilon zeta", "b"), (3, None, None), (4, "", "c"), (5, " \n\t ", "d"), (None, "alpha beta gamma delta epsilon zeta", "e"), (None, None, None),
        (6, "word " * 30000, "f"), (7, "x", "g"), (7, "x", "g"), (8, "Ünïcödé 日本語 😀 text\x00with bytes", "h"), (9, "a" * 50000, "i"),
    ]
    base = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ("score", "size", "shard", "slot", "ids", "media", "codes", "node", "class", "component_id", "kept", "host", "rule", "rank", "n_bytes", "old_shard", "_hit", "band", "words", "family", "length", "sequence_id")
    return base.selectExpr("*", *[f"source AS {n}" for n in names])
