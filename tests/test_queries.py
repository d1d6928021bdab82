import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import history_queries, market_queries, more_queries, state_queries, text_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = text_queries.SQL | state_queries.SQL | market_queries.SQL | more_queries.SQL | history_queries.SQL


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(6).map(lambda v: "None" if v != v else repr(float(v)))
    rows = frame.astype(str).replace({"nan": "None", "<NA>": "None", "NaT": "None"})
    return sorted(map(tuple, rows.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_is_its_sql(spark, db, name):
    ours, theirs = entry.queries()[name](spark, SF).toPandas(), db.sql(OWN[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
