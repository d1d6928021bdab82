"""Queries over announcements, judgements, waiting titles and risk, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates, signatures
from ..functions import lexicons as L
from ..operators import announcements, market
from . import views as V
from .market_queries import _NET, _calendar, _events
from .sql import any_sql, cases, chars_sql, jaccard_sql, quote
from .text_queries import with_news

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


_AT = f"TIMESTAMP '{V.STATE_AS_OF}'"


@query(with_news(f", a AS (SELECT seq, code, name, title, " + cases([(any_sql("title", w), quote(k)) for k, w in L.ANNOUNCEMENT_TYPES], "''") + f" AS type, {any_sql(chr(40) + 'title || ' + quote(' ') + ' || name' + chr(41), V.WATCHED)} AS direct FROM news), k AS (SELECT *, CASE WHEN code <> '' THEN code ELSE name END || '|' || type AS key FROM a WHERE type <> ''), l AS (SELECT DISTINCT ['688256|回购', '中际旭创|回购', '方邦股份|减持'][1 + user_id % 3] AS key FROM events WHERE ts <= {_AT} AND ts >= {_AT} - INTERVAL 24 HOUR AND user_id % 3 > 0) SELECT seq, type, direct FROM k WHERE NOT (direct AND key IN (SELECT key FROM l))"))
def announcements_ingest(spark, sf_dir):
    keys = F.element_at(F.array(*map(F.lit, ("688256|回购", "中际旭创|回购", "方邦股份|减持"))), (1 + F.col("user_id") % 3).cast("int"))
    log = V.table(spark, sf_dir, "events").where("user_id % 3 > 0").select(keys.alias("key"), F.col("ts").cast("timestamp").alias("t"))
    rows = V.news(spark, sf_dir).withColumn("kind", F.lit(""))
    return announcements.ingested(rows, log, F.lit(V.STATE_AS_OF).cast("timestamp"), V.WATCHED).select("seq", "type", "direct")


_J = "j AS (SELECT seq + (seq % 3) AS jdx, title, CASE WHEN seq % 4 = 0 THEN published_at ELSE 'x' END AS published_at, (seq % 11)::DOUBLE AS score FROM news WHERE seq % 5 > 1)"


@query(with_news(f", {_J}, o AS (SELECT n.seq, (SELECT min(score) FROM j WHERE j.jdx = n.seq AND j.title = n.title) AS s1, (SELECT arg_min(score, jdx) FROM j WHERE j.title = n.title AND j.published_at = n.published_at) AS s2, (SELECT arg_min(score, (jdx, -score)) FROM (SELECT title, jdx, min(score) AS score FROM j GROUP BY ALL) j WHERE j.title = n.title) AS s3 FROM news n) SELECT seq, CASE WHEN s1 IS NOT NULL THEN 'idx' WHEN s2 IS NOT NULL THEN 'time' WHEN s3 IS NOT NULL THEN 'title' ELSE 'none' END AS by FROM o"))
def judgement_merge(spark, sf_dir):
    n = V.news(spark, sf_dir)
    j = n.where("seq % 5 > 1").select((F.col("seq") + F.col("seq") % 3).alias("jdx"), "title", F.when(F.col("seq") % 4 == 0, F.col("published_at")).otherwise("x").alias("published_at"), (F.col("seq") % 11).cast("double").alias("score"))
    return announcements.with_judgements(n.withColumn("idx", F.col("seq")), j).select("seq", "by")


@query(with_news(f", p AS (SELECT a.seq AS a, b.seq AS b, a.title AS ta, b.title AS tb FROM news a JOIN news b ON b.seq = a.seq + 40), c AS (SELECT *, {chars_sql('ta')} AS ca, {chars_sql('tb')} AS cb, coalesce(list_max(list_transform(range(1, length(ta) + 1), lambda i: coalesce(list_max(list_filter(range(1, length(ta) - i + 2), lambda n: contains(tb, substr(ta, i::INTEGER, n::INTEGER)))), 0))), 0) AS l FROM p) SELECT a, b FROM c WHERE ta <> '' AND tb <> '' AND ({jaccard_sql('ca', 'cb')} >= 0.55 OR (least(length(ta), length(tb)) >= 6 AND l::DOUBLE / least(length(ta), length(tb)) >= 0.5))"))
def pending_same_as_sent(spark, sf_dir):
    n = V.news(spark, sf_dir).select("seq", F.col("title").alias("t"))
    pairs = n.select(F.col("seq").alias("a"), F.col("t").alias("ta")).join(n.select((F.col("seq") - 40).alias("a"), F.col("seq").alias("b"), F.col("t").alias("tb")), "a")
    return pairs.where(signatures.titles_alike(F.col("ta"), F.col("tb"))).select("a", "b")


@query(f"WITH {_NET} SELECT count(*) AS days, datediff('day', min(day), max(day))::INTEGER AS span, datediff('day', min(day), max(day)) >= 20 AND count(*) >= 10 AS enough FROM net WHERE net <> 0")
def study_sufficiency(spark, sf_dir):
    return announcements.enough_to_study(market.day_signals(_events(spark, sf_dir), _calendar(spark, sf_dir)))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN '风险收缩' WHEN o_orderkey % 7 = 0 OR o_totalprice / 5000 >= 80 OR -o_totalprice / 100 <= -5000 OR o_orderkey % 40 / 10 >= 3 THEN '警戒' ELSE '中性' END AS grade FROM orders")
def risk_grades(spark, sf_dir):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    grade = gates.risk_grade(F.when(F.col("o_orderstatus") == "F", "risk_off").otherwise("neutral"), k % 7 == 0, price / 5000, F.when(price / 100 >= 5000, -600.0).otherwise(0.0), k % 40 / 10, F.lit(None).cast("double"))
    return V.table(spark, sf_dir, "orders").select(k.alias("k"), grade.alias("grade"))


@query(with_news(f"SELECT seq, {cases([(any_sql('ta', L.TITLE_UP_WORDS) + ' AND ' + any_sql('tb', L.TITLE_DOWN_WORDS), 'true'), (any_sql('ta', L.TITLE_DOWN_WORDS) + ' AND ' + any_sql('tb', L.TITLE_UP_WORDS), 'true')], 'false')} AS opposed, coalesce(sa <> sb, false) AS sessions_differ FROM (SELECT a.seq, a.title AS ta, b.title AS tb, {cases([(any_sql('a.title', w), quote(k)) for k, w in L.SESSIONS.items()], 'NULL')} AS sa, {cases([(any_sql('b.title', w), quote(k)) for k, w in L.SESSIONS.items()], 'NULL')} AS sb FROM news a JOIN news b ON b.seq = a.seq + 1)"))
def title_conflicts(spark, sf_dir):
    n = V.news(spark, sf_dir).select("seq", "title")
    p = n.withColumnRenamed("title", "ta").join(n.select((F.col("seq") - 1).alias("seq"), F.col("title").alias("tb")), "seq")
    a, b = F.col("ta"), F.col("tb")
    return p.select("seq", signatures.titles_oppose(a, b).alias("opposed"), F.coalesce(signatures.session_of(a) != signatures.session_of(b), F.lit(False)).alias("sessions_differ"))


@query(f"WITH {V.BARS_SQL} SELECT strftime(date, '%Y-%m-%d') AS date, " + ", ".join(f"round(max(close) FILTER (code = {c}) + 1e-9::DOUBLE, 6) AS c{c}" for c in (1, 2, 3)) + " FROM bars GROUP BY date HAVING count(*) FILTER (code IN (1, 2, 3)) > 0")
def close_panel(spark, sf_dir):
    """The wide form of a long panel, for the codes that are asked for."""
    wide = V.bars(spark, sf_dir).where("code IN (1, 2, 3)").groupBy("date").pivot("code", [1, 2, 3]).agg(F.round(F.max("close") + 1e-9, 6))
    return wide.select(F.date_format("date", "yyyy-MM-dd").alias("date"), *[F.col(f"`{c}`").alias(f"c{c}") for c in (1, 2, 3)])
