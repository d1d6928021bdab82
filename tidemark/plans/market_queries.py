"""Queries over bars, returns, event studies and feeds, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import times
from ..operators import market
from ..sources import feeds
from . import views as V
from .sql import any_sql, quote

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def day(column: str = "date"):
    return F.date_format(column, "yyyy-MM-dd")


_DAY = "strftime(date, '%Y-%m-%d') AS date"
_BARS = f"WITH {V.BARS_SQL}"
r6 = lambda c: F.round(c + 1e-9, 6)  # noqa: E731  a hair, so that ties go up in any engine


@query(f"{_BARS} SELECT {_DAY}, code, round(open + 1e-9::DOUBLE, 6) AS open, round(high + 1e-9::DOUBLE, 6) AS high, round(low + 1e-9::DOUBLE, 6) AS low, round(close + 1e-9::DOUBLE, 6) AS close, volume, round(amount, 4) AS amount FROM bars")
def daily_bars(spark, sf_dir):
    b = V.bars(spark, sf_dir)
    return b.select(day().alias("date"), "code", *[r6(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "volume", F.round("amount", 4).alias("amount"))


@query(f"{_BARS} SELECT {_DAY}, code, round(close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 + 1e-9::DOUBLE, 6) AS ret FROM bars")
def daily_returns(spark, sf_dir):
    return market.returns(V.bars(spark, sf_dir)).select(day().alias("date"), "code", r6(F.col("ret")).alias("ret"))


@query(f"{_BARS}, x AS (SELECT date, code, CASE WHEN day(date) % 7 > 0 THEN amount END AS amount FROM bars) SELECT {_DAY}, code, max(amount) OVER (PARTITION BY code ORDER BY date ROWS 4 PRECEDING) IS NOT NULL AND coalesce(amount > 0, false) AS tradable FROM x")
def tradable_mask(spark, sf_dir):
    b = V.bars(spark, sf_dir).withColumn("amount", F.when(F.dayofmonth("date") % 7 > 0, F.col("amount")))
    return market.tradable(b, 5).select(day().alias("date"), "code", "tradable")


@query(f"{_BARS} SELECT {_DAY}, code, " + ", ".join(f"round(lead(close, {h}) OVER (PARTITION BY code ORDER BY date) / close - 1 + 1e-9::DOUBLE, 6) AS fwd_{h}" for h in (1, 3, 5)) + " FROM bars")
def forward_returns(spark, sf_dir):
    f = market.forward_returns(V.bars(spark, sf_dir))
    return f.select(day().alias("date"), "code", *[r6(F.col(f"fwd_{h}")).alias(f"fwd_{h}") for h in (1, 3, 5)])


@query(f"{_BARS}, u AS (SELECT date, code, close, 1 AS load FROM bars WHERE year(date) < 2000 UNION ALL SELECT date, code, close * 2, 2 FROM bars WHERE year(date) >= 1998) SELECT {_DAY}, code, round(close + 1e-9::DOUBLE, 6) AS close, load FROM u QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY load DESC) = 1")
def bars_latest_wins(spark, sf_dir):
    b = V.bars(spark, sf_dir).select("date", "code", "close")
    old, new = b.where(F.year("date") < 2000).withColumn("load", F.lit(1)), b.where(F.year("date") >= 1998).withColumn("close", F.col("close") * 2).withColumn("load", F.lit(2))
    return market.latest_bars(old, new).select(day().alias("date"), "code", r6(F.col("close")).alias("close"), "load")


@query(f"{_BARS}, x AS (SELECT code, bool_and(open > 0 AND high > 0 AND low > 0 AND close > 0 AND (low <= 2000 OR code % 3 > 0) AND volume >= 0) AS fine, count(*) AS n FROM bars GROUP BY code) SELECT code, n FROM x WHERE fine AND n >= 60")
def clean_history(spark, sf_dir):
    b = V.bars(spark, sf_dir).withColumn("low", F.when((F.col("low") <= 2000) | (F.col("code") % 3 > 0), F.col("low")))
    return market.clean_history(b).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_BARS}, f AS (SELECT code, code % 4 AS priority, code % 5 > 0 AS usable, date FROM bars UNION ALL SELECT code, 2, true, date FROM bars) SELECT code, priority::INTEGER AS priority, count(*) AS n FROM f WHERE (code, priority) IN (SELECT (code, min(priority)) FROM f WHERE usable GROUP BY code) GROUP BY ALL")
def first_usable_source(spark, sf_dir):
    b = V.bars(spark, sf_dir)
    f = b.select("code", (F.col("code") % 4).cast("int").alias("priority"), (F.col("code") % 5 > 0).alias("usable"), "date").unionByName(b.select("code", F.lit(2).alias("priority"), F.lit(True).alias("usable"), "date"))
    return market.first_usable(f).groupBy("code", "priority").agg(F.count(F.lit(1)).alias("n"))


_CAL = "cal AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem WHERE isodow(l_shipdate) <= 5)"


def _calendar(spark, sf_dir):
    return V.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")).where(F.weekday("day") < 5).distinct()


@query(f"{_BARS}, {_CAL}, l AS (SELECT code, max(date) AS last FROM bars WHERE code % 3 > 0 OR date < DATE '2001-08-01' GROUP BY code) SELECT code, strftime(last, '%Y-%m-%d') AS last, (SELECT count(*) FROM cal WHERE day > last AND day <= DATE '2001-10-31') AS lag FROM l WHERE last <= DATE '2001-10-31' AND (SELECT count(*) FROM cal WHERE day > last AND day <= DATE '2001-10-31') <= 30")
def fresh_codes(spark, sf_dir):
    b = V.bars(spark, sf_dir).where("code % 3 > 0 OR date < DATE '2001-08-01'")
    return market.fresh_codes(b, F.lit("2001-10-31").cast("date"), 30, _calendar(spark, sf_dir)).select("code", day("last").alias("last"), "lag")


_EV = "ev AS (SELECT o_orderkey AS id, (o_orderdate + to_days((o_orderkey % 5)::INTEGER))::DATE AS pub, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN -1 ELSE 0 END AS sign FROM orders)"


def _events(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 5).cast("int")).alias("pub"), F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", -1).otherwise(0).alias("sign"))


_NET = f"{_CAL}, {_EV}, net AS (SELECT (SELECT min(day) FROM cal WHERE day >= pub) AS day, sum(sign)::DOUBLE AS net FROM ev WHERE sign <> 0 GROUP BY 1 HAVING day IS NOT NULL)"


@query(f"WITH {_NET} SELECT strftime(day, '%Y-%m-%d') AS day, net FROM net")
def signal_days_asof(spark, sf_dir):
    return market.day_signals(_events(spark, sf_dir), _calendar(spark, sf_dir)).select(day("day").alias("day"), "net")


_CLOSES = "closes AS (SELECT l_shipdate::DATE AS day, avg(l_extendedprice / l_quantity) AS close FROM lineitem WHERE isodow(l_shipdate) <= 5 GROUP BY 1)"
_FWD = f"{_NET}, {_CLOSES}, f AS (SELECT c.day, coalesce(n.net, 0) AS net, h AS horizon, CASE h WHEN 1 THEN lead(close, 1) OVER w WHEN 3 THEN lead(close, 3) OVER w ELSE lead(close, 5) OVER w END / close - 1 AS r FROM closes c LEFT JOIN net n ON c.day = n.day CROSS JOIN (SELECT unnest([1, 3, 5]) AS h) WINDOW w AS (PARTITION BY h ORDER BY c.day))"


def _closes(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    return li.where(F.weekday("l_shipdate") < 5).groupBy(F.to_date("l_shipdate").alias("day")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))


@query(f"WITH {_FWD} SELECT horizon::INTEGER AS horizon, " + ", ".join(f"count(*) FILTER ({t}) AS n_{n}, round(avg(r) FILTER ({t}) + 1e-9::DOUBLE, 6) AS mean_{n}" for n, t in (("signal", "net <> 0"), ("none", "net = 0"), ("up", "net > 0"), ("down", "net < 0"))) + " FROM f WHERE r IS NOT NULL GROUP BY horizon")
def event_study(spark, sf_dir):
    s = market.study(_closes(spark, sf_dir), market.day_signals(_events(spark, sf_dir), _calendar(spark, sf_dir)))
    return s.select("horizon", *[c for n in ("signal", "none", "up", "down") for c in (F.col(f"n_{n}"), r6(F.col(f"mean_{n}")).alias(f"mean_{n}"))])


def _forward(spark, sf_dir):
    signals = market.day_signals(_events(spark, sf_dir), _calendar(spark, sf_dir))
    f = market.forward_returns(_closes(spark, sf_dir).withColumn("all", F.lit(1)), (1, 3, 5), "all", "day").join(signals, "day", "left").withColumn("net", F.coalesce("net", F.lit(0.0)))
    return f.select("net", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("r")) for h in (1, 3, 5)])).alias("x")).select("net", "x.horizon", F.coalesce("x.r", F.lit(0.0)).alias("r"), F.col("x.r").isNotNull().alias("known"))


_RANKS = "(SELECT horizon, net, r, rank() OVER (PARTITION BY horizon ORDER BY net) + (count(*) OVER (PARTITION BY horizon, net) - 1) / 2 AS rx, rank() OVER (PARTITION BY horizon ORDER BY r) + (count(*) OVER (PARTITION BY horizon, r) - 1) / 2 AS ry FROM {})"


@query(f"WITH {_FWD} SELECT horizon::INTEGER AS horizon, count(*) AS n, round(corr(rx, ry) + 1e-9::DOUBLE, 6) AS ic FROM {_RANKS.format('(SELECT horizon, net, coalesce(r, 0) AS r FROM f)')} GROUP BY horizon")
def spearman_ic(spark, sf_dir):
    return market.rank_correlation(_forward(spark, sf_dir), ["horizon"], "net", "r").select("horizon", "n", r6(F.col("ic")).alias("ic"))


@query(f"WITH {_FWD}, k AS (SELECT horizon, net <> 0 AS g, ry FROM {_RANKS.format('(SELECT horizon, net, r FROM f WHERE r IS NOT NULL)')}), s AS (SELECT horizon, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, sum(ry) FILTER (g) AS r1 FROM k GROUP BY horizon) SELECT horizon::INTEGER AS horizon, n1, n2, round(r1 - n1 * (n1 + 1) / 2 + 1e-9::DOUBLE, 6) AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1::DOUBLE * n2 * (n1 + n2 + 1) / 12) + 1e-9::DOUBLE, 6) AS z FROM s")
def mann_whitney_u(spark, sf_dir):
    rows = _forward(spark, sf_dir).where("known").withColumn("g", F.col("net") != 0)
    return market.rank_sum_test(rows, ["horizon"], "r", "g").select("horizon", "n1", "n2", r6(F.col("u")).alias("u"), r6(F.col("z")).alias("z"))


@query("WITH s AS (SELECT o_orderkey AS seq, o_custkey AS code, o_totalprice - 150000 AS net FROM orders WHERE o_totalprice - 150000 >= 30000), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY code ORDER BY abs(net) DESC, seq) = 1) SELECT seq, code, round(net, 4) AS net FROM b ORDER BY abs(net) DESC, seq LIMIT 15")
def lhb_topk(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("code"), (F.col("o_totalprice") - 150000).alias("net"))
    return market.buy_signals(o, 30000).withColumn("net", F.round("net", 4))


_KINDS = tuple(L.FORECAST_DIRECTIONS)


@query(f"WITH s AS (SELECT o_orderkey AS seq, o_custkey AS code, (o_totalprice - 200000) / 1000 AS amplitude, [{', '.join(map(quote, _KINDS))}][1 + o_orderkey % {len(_KINDS)}] AS kind FROM orders), w AS (SELECT *, CASE kind {' '.join(f'WHEN {quote(k)} THEN {quote(v)}' for k, v in L.FORECAST_DIRECTIONS.items())} ELSE 'neutral' END AS direction FROM s WHERE amplitude > 100 OR amplitude < -50), b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY code ORDER BY abs(amplitude) DESC, seq) = 1) SELECT seq, code, round(amplitude + 1e-9::DOUBLE, 6) AS amplitude, kind, direction FROM b ORDER BY abs(amplitude) DESC, seq LIMIT 20")
def yjyg_topk(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (1 + F.col("o_orderkey") % len(_KINDS)).cast("int"))
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("code"), ((F.col("o_totalprice") - 200000) / 1000).alias("amplitude"), kind.alias("kind"))
    return market.forecast_signals(o, L.FORECAST_DIRECTIONS).withColumn("amplitude", r6(F.col("amplitude")))


@query("SELECT o_orderkey AS k, CASE WHEN DATE '1998-06-30' > o_orderdate::DATE THEN len(list_filter(range(1, datediff('day', o_orderdate::DATE, DATE '1998-06-30') + 1), lambda i: isodow(o_orderdate::DATE + i::INTEGER) <= 5)) ELSE 0 END::INTEGER AS n FROM orders")
def stale_trading_days(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), times.workdays_between(F.to_date("o_orderdate"), F.lit("1998-06-30").cast("date")).alias("n"))


_FEED = """f AS (
  SELECT conv_id * 100 + turn AS seq, 'chat' AS source, CASE WHEN turn % 2 = 0 THEN '' ELSE substr(split_part(text, chr(10), 1), 1, 80) END AS title, text AS content, 1704067200 + conv_id * 60 AS stamp FROM conversations
  UNION ALL SELECT 10000000 + doc_id, source, substr(split_part(text, chr(10), 1), 1, 80), text, (1704067200 + doc_id) * 1000 FROM documents)"""


@query(f"WITH {_FEED}, n AS (SELECT seq, source, CASE WHEN trim(coalesce(title, '')) = '' THEN substr(content, 1, 40) || '...' ELSE title END AS title, strftime(to_timestamp(CASE WHEN stamp > 1e12 THEN stamp / 1000 ELSE stamp END) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS published_at FROM f) SELECT seq, source, title, published_at FROM n WHERE trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY trim(title) ORDER BY seq) = 1")
def unified_feeds(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    first = F.substring(F.substring_index("text", "\n", 1), 1, 80)
    chat = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.lit("chat").alias("source"), F.when(F.col("turn") % 2 == 0, "").otherwise(first).alias("title"), F.col("text").alias("content"), (1704067200 + F.col("conv_id") * 60).alias("stamp"))
    docs = V.table(spark, sf_dir, "documents").select((F.col("doc_id") + 10000000).alias("seq"), "source", first.alias("title"), F.col("text").alias("content"), ((1704067200 + F.col("doc_id")) * 1000).alias("stamp"))
    return feeds.unified([feeds.normal(chat), feeds.normal(docs)]).select("seq", "source", "title", "published_at")


@query(f"WITH a AS (SELECT o_orderkey AS seq, o_custkey::VARCHAR AS code, '关于' || o_orderstatus || CASE WHEN o_orderkey % 5 = 0 THEN '例会' ELSE '回购' END || '的公告' AS title, o_orderdate::DATE AS date FROM orders) SELECT min(seq) AS seq, code, title FROM a WHERE NOT {any_sql('title', ('例会', '更正公告'))} GROUP BY code, title, date")
def announcements_union(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    a = o.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("code"), F.concat(F.lit("关于"), "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "例会").otherwise("回购"), F.lit("的公告")).alias("title"), F.to_date("o_orderdate").alias("date"))
    return feeds.announcements([a.where("seq % 3 = 0"), a.where("seq % 3 = 1").withColumnRenamed("title", "公告标题"), a.where("seq % 3 = 2")], {"title": ("title", "公告标题")}, ("例会", "更正公告")).select("seq", "code", "title")


@query("SELECT p_partkey AS code, p_type AS board FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY p_type) = 1")
def industry_map(spark, sf_dir):
    """The first board, in the boards' order, that lists a code."""
    p = V.table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_partkey").alias("code")).agg(F.min("p_type").alias("board"))
