"""Queries over single rows and over titles, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gates, scoring, signatures, text, times
from ..functions import lexicons as L
from ..operators import dedup
from . import views as V
from .sql import amounts_sql, any_sql, cases, chars_sql, clean_url_sql, count_sql, groups_sql, jaccard_sql, listed, quote, simhash_sql, time_sql, title_core_sql, title_norm_sql, weights_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def with_news(body: str) -> str:
    return f"WITH {V.NEWS_SQL} {body}"


def joined(column) -> F.Column:
    return F.concat_ws(",", column)


TEXT = "(title || ' ' || content)"
CLEAN = "((CASE WHEN name = '' THEN title ELSE replace(title, name, '') END) || ' ' || (CASE WHEN name = '' THEN content ELSE replace(content, name, '') END))"


def cols(*names: str) -> list:
    return [F.col(n) for n in names]


@query(f"SELECT page_id, {clean_url_sql('url')} AS clean, regexp_extract({clean_url_sql('url')}, '^[^:/]*://([^/]*)', 1) AS host FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.clean_url(F.col("url"))
    return V.table(spark, sf_dir, "pages").select("page_id", clean.alias("clean"), text.url_host(clean).alias("host"))


@query(with_news(f"SELECT seq, {title_norm_sql('title')} AS norm, {title_core_sql('title')} AS core FROM news"))
def title_normalize(spark, sf_dir):
    return V.news(spark, sf_dir).select("seq", text.title_norm(F.col("title")).alias("norm"), text.title_core(F.col("title")).alias("core"))


@query(with_news(f"SELECT seq, {simhash_sql('title')} AS fp FROM news"))
def simhash32(spark, sf_dir):
    return V.news(spark, sf_dir).select("seq", text.simhash32(F.col("title")).alias("fp"))


@query(with_news(f", f AS (SELECT min(seq) AS seq, {simhash_sql('title')} AS fp FROM news GROUP BY 2) SELECT a.seq AS a, b.seq AS b, bit_count(xor(a.fp, b.fp))::INTEGER AS distance FROM f a JOIN f b ON a.seq < b.seq AND bit_count(xor(a.fp, b.fp)) <= 3 WHERE a.fp <> 0 AND b.fp <> 0"))
def near_dup_pairs(spark, sf_dir):
    values = V.news(spark, sf_dir).groupBy(text.simhash32(F.col("title")).alias("fp")).agg(F.min("seq").alias("seq"))
    return dedup.simhash_pairs(values).select("a", "b", F.col("distance").cast("int").alias("distance"))


_PAGES = "p AS (SELECT page_id AS seq, url FROM pages UNION ALL SELECT page_id + 1000000, replace(url, '://', '://www.') || '?again=1' FROM pages)"


@query(f"WITH {_PAGES} SELECT min(seq) AS seq, {clean_url_sql('url')} AS clean FROM p GROUP BY 2")
def dedup_url(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url")
    both = p.unionByName(p.select((F.col("seq") + 1000000).alias("seq"), F.concat(F.replace("url", F.lit("://"), F.lit("://www.")), F.lit("?again=1")).alias("url")))
    return dedup.by_url(both).select("seq", text.clean_url(F.col("url")).alias("clean"))


@query(with_news("SELECT min(seq) AS seq, trim(title) AS title FROM news WHERE trim(title) <> '' GROUP BY 2"))
def dedup_title_first(spark, sf_dir):
    return dedup.by_title(V.news(spark, sf_dir), drop_untitled=True).select("seq", F.trim("title").alias("title"))


_GREEDY_FP = with_news(f"""
, u AS (SELECT *, row_number() OVER (PARTITION BY {clean_url_sql('url')} ORDER BY seq) AS n FROM news),
t AS (SELECT seq, title, row_number() OVER (PARTITION BY trim(title) ORDER BY seq) AS n FROM u WHERE n = 1),
f AS (SELECT seq, {simhash_sql('trim(title)')} AS fp, row_number() OVER (ORDER BY seq) AS i FROM t WHERE n = 1),
walk AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS kept, NULL::BIGINT AS seq
  UNION ALL
  SELECT f.i, CASE WHEN ok THEN list_append(kept, f.fp) ELSE kept END, CASE WHEN ok OR f.fp = 0 THEN f.seq END
  FROM (SELECT w.i, w.kept, x.fp, x.seq, x.i AS j, x.fp <> 0 AND len(list_filter(w.kept, lambda k: bit_count(xor(k, x.fp)) <= 3)) = 0 AS ok FROM walk w JOIN f x ON x.i = w.i + 1) q(i0, kept, fp, seq, i, ok) JOIN f ON f.i = q.i)
SELECT seq FROM walk WHERE seq IS NOT NULL""").replace("WITH ", "WITH RECURSIVE ", 1)


@query(_GREEDY_FP)
def dedup_3layer(spark, sf_dir):
    return dedup.three_layers(V.news(spark, sf_dir)).select("seq")


@query(with_news(f""", t AS (SELECT min(seq) AS seq, core, {chars_sql('core')} AS chars FROM (SELECT seq, {title_core_sql('title')} AS core FROM news) WHERE core <> '' GROUP BY core)
SELECT a.seq AS a, b.seq AS b FROM t a JOIN t b ON a.seq < b.seq AND ({jaccard_sql('a.chars', 'b.chars')} >= 0.6 OR (least(length(a.core), length(b.core)) >= 6 AND (contains(a.core, b.core) OR contains(b.core, a.core))))"""))
def like_title_pairs(spark, sf_dir):
    return dedup.title_pairs(dedup.distinct_titles(V.news(spark, sf_dir)))


@query(with_news("SELECT seq, source, " + cases([("source = ''", "0.62"), *[(f"source = {quote(k)}", str(v)) for k, v in L.CREDIBILITY.items()], *[(f"contains(source, {quote(k)}) OR contains({quote(k)}, source)", str(v)) for k, v in L.CREDIBILITY.items()], (any_sql("source", ("交易所", "证监会", "央行", "国务院", "银保监", "发改委")), "0.95"), (any_sql("source", ("证券报", "证券时报", "财经", "时报", "日报")), "0.82"), (any_sql("source", ("券商", "证券", "研究")), "0.74")], "0.62") + "::DOUBLE AS credibility FROM news"))
def credibility(spark, sf_dir):
    return V.news(spark, sf_dir).select("seq", "source", scoring.credibility(F.col("source")).alias("credibility"))


_OTHER_ABBR = tuple(w for w in L.TECH_ABBREVIATIONS if w != "AMD")
_PLAIN_TECH = tuple(w for w in L.TECH_WORDS if w not in L.TECH_ABBREVIATIONS)
_EYES = ("黄斑变性", "眼底", "眼科", "视网膜", "视力")


def tech_sql(t: str) -> str:
    return f"({any_sql(t, (*_OTHER_ABBR, *_PLAIN_TECH), _OTHER_ABBR)} OR ({any_sql(t, ('AMD',), ('AMD',))} AND NOT {any_sql(t, _EYES)}))"


def tech_count_sql(t: str) -> str:
    short = " + ".join(f"({any_sql(t, (w,), (w,))} {'AND NOT ' + any_sql(t, _EYES) if w == 'AMD' else ''})::INTEGER" for w in L.TECH_ABBREVIATIONS)
    return f"({count_sql(t, _PLAIN_TECH)} + {short})"


def importance_sql() -> str:
    listed_bonus = "least(len(affected_sectors) * 0.02::DOUBLE, 0.06) + least(len(affected_stocks) * 0.03::DOUBLE, 0.06)"
    strong = "impact_direction IN ('bullish', 'bearish')"
    swing = "abs(TRY_CAST(regexp_extract(x, '幅度([+-]?[0-9.]+)%', 1) AS DOUBLE))"
    signal = f"(CASE WHEN {strong} THEN 0.55 ELSE 0.35 END + CASE WHEN {swing} > 1000 THEN 0.25 WHEN {swing} > 500 THEN 0.2 WHEN {swing} > 100 THEN 0.15 WHEN {swing} > 50 THEN 0.1 ELSE 0 END + CASE WHEN {any_sql('x', ('机构净买入', '龙虎榜'))} THEN 0.1 ELSE 0 END + CASE WHEN len(affected_stocks) > 0 THEN 0.05 ELSE 0 END)::DOUBLE"
    tier = cases([(any_sql("x", ("撤销退市", "撤销*ST", "撤销ST", "申请撤销", "摘帽")), "0.75"), (any_sql("x", ("ST", "退市", "终止上市")), "0.35"), *[(any_sql("x", words), str(score)) for words, score in L.ANNOUNCEMENT_TIERS]], "0.30")
    announced = f"((CASE WHEN impact_direction = 'neutral' AND tier >= 0.75 THEN tier::DOUBLE * 0.6 ELSE tier END) + least(tech * 0.15::DOUBLE, 0.4) + CASE WHEN {strong} THEN 0.06 ELSE 0 END + {listed_bonus})"
    others = tuple(w for w in L.SECTOR_WORDS if w not in L.TECH_WORDS)
    high = f"least({weights_sql('x', L.IMPACT_WEIGHTS)} * CASE WHEN impact_direction = 'neutral' THEN 0.3 ELSE 1.0 END, 0.45)"
    plain = f"(0.1 + {high} + least({weights_sql('x', L.POLICY_WEIGHTS)}, 0.35) + least(tech * 0.2::DOUBLE, 0.5) + least({count_sql('x', others)} * 0.04::DOUBLE, 0.1) + least({count_sql('x', L.MEDIUM_WORDS)} * 0.04::DOUBLE, 0.12) + CASE WHEN {strong} THEN 0.08 ELSE 0 END + {listed_bonus})"
    exempt = any_sql("source", [s for s in L.NATIONAL_SOURCES if s not in ("光明日报", "银保监会", "国家发改委")])
    squeeze = lambda raw, less: f"round(0.99 * tanh(1.4 * {raw}) * CASE WHEN {less} THEN 0.65 ELSE 1.0 END, 2)"
    return with_news(f""", x AS (SELECT *, {CLEAN} AS x FROM news), y AS (SELECT *, {tech_sql('x')} AS is_tech, {tech_count_sql('x')} AS tech, {tier} AS tier FROM x)
SELECT seq, category, CASE WHEN {any_sql('x', L.NOISE_WORDS)} THEN 0.1 WHEN category = 'signal' THEN {squeeze(signal, f"NOT is_tech AND NOT {any_sql('source', ('龙虎榜', '业绩预告'))}")}
  WHEN category = 'announcement' THEN {squeeze(announced, f'NOT is_tech AND NOT {exempt}')} ELSE {squeeze(plain, f'NOT is_tech AND len(affected_stocks) > 0 AND NOT {exempt}')} END::DOUBLE AS importance FROM y""")


@query(importance_sql())
def importance(spark, sf_dir):
    t, c, n, k, d, s, a, b = cols("title", "content", "name", "category", "impact_direction", "source", "affected_sectors", "affected_stocks")
    return V.news(spark, sf_dir).select("seq", "category", scoring.importance(t, c, n, k, d, s, a, b).alias("importance"))


def relevance_sql() -> str:
    host = f"regexp_extract({clean_url_sql('url')}, '^[^:/]*://([^/]*)', 1)"
    return with_news(f""", x AS (SELECT *, {TEXT} AS x, (CASE WHEN contains(title, '600519') THEN 55 WHEN contains(content, '600519') THEN 34 WHEN contains(url, '600519') THEN 18 ELSE 0 END) + (CASE WHEN contains(title, '宁德时代') THEN 45 WHEN contains(content, '宁德时代') THEN 28 ELSE 0 END) AS direct FROM news),
y AS (SELECT *, {any_sql('x', L.COMPANY_EVENT_WORDS)} AS event, {any_sql('x', L.MACRO_NEWS_WORDS)} AS macro, {count_sql('x', L.GLOBAL_RISK_WORDS)} AS world FROM x),
z AS (SELECT *, CASE WHEN event AND direct > 0 THEN direct + 12 ELSE direct END AS named FROM y)
SELECT seq, greatest(0, least(100, direct + CASE WHEN event THEN CASE WHEN direct > 0 THEN 12 ELSE 6 END ELSE 0 END + CASE WHEN {tech_sql('x')} THEN 10 ELSE 0 END
  + CASE WHEN {host} IN ({', '.join(map(quote, L.OFFICIAL_HOSTS))}) OR {any_sql('source', L.OFFICIAL_LABELS)} THEN 8 ELSE 0 END + CASE WHEN {any_sql('x', L.SECTOR_NEWS_WORDS)} THEN 6 ELSE 0 END
  - CASE WHEN macro AND named = 0 AND NOT {any_sql('x', L.POLICY_WEIGHTS)} AND world = 0 THEN 12 ELSE 0 END + least(world * 5, 15)))::INTEGER AS score,
  CASE WHEN named >= 38 THEN 'direct' WHEN macro AND named = 0 THEN 'macro' ELSE 'sector' END AS category FROM z""")


@query(relevance_sql())
def relevance(spark, sf_dir):
    r = scoring.relevance(*cols("title", "content", "url", "source"), code="600519", name="宁德时代")
    return V.news(spark, sf_dir).select("seq", r.alias("r")).select("seq", "r.score", "r.category")


@query(with_news(f"SELECT seq, round(least(CASE WHEN {any_sql(TEXT, V.WATCHED)} THEN 0.25 ELSE 0 END + least({count_sql(TEXT, L.CHAIN_WORDS)} * 0.05::DOUBLE, 0.15), 0.40), 4)::DOUBLE AS bonus FROM news"))
def relevance_bonus(spark, sf_dir):
    return V.news(spark, sf_dir).select("seq", scoring.relevance_bonus(F.col("title"), F.col("content"), V.WATCHED).alias("bonus"))


@query(with_news("""SELECT seq, CASE WHEN impact_band IN ('bullish', 'mildly_bullish') THEN 'bullish' WHEN impact_band IN ('bearish', 'mildly_bearish') THEN 'bearish' ELSE 'neutral' END AS direction,
  (impact_band IN ('bullish', 'mildly_bullish') AND impact_direction = 'bearish') OR (impact_band IN ('bearish', 'mildly_bearish') AND impact_direction = 'bullish') AS conflict,
  CASE impact_band WHEN 'bullish' THEN 'mildly_bullish' WHEN 'bearish' THEN 'mildly_bearish' ELSE 'neutral' END AS milder, CASE WHEN impact_band IN ('bullish', 'bearish', 'mixed') THEN 6 WHEN impact_band LIKE 'mildly%' THEN 4 ELSE 1 END::INTEGER AS priority FROM news"""))
def band_rules(spark, sf_dir):
    b = F.col("impact_band")
    return V.news(spark, sf_dir).select("seq", scoring.band_to_direction(b).alias("direction"), scoring.band_conflicts(b, F.col("impact_direction")).alias("conflict"), scoring.milder_band(b).alias("milder"), scoring.band_priority(b).alias("priority"))


def guardrails_sql() -> str:
    bear = lambda b: f"CASE WHEN {b} = 'bullish' THEN 'bearish' WHEN {b} IN ('mildly_bullish', 'mixed') THEN 'mildly_bearish' ELSE {b} END"
    bull = lambda b: f"CASE WHEN {b} = 'bearish' THEN 'bullish' WHEN {b} IN ('mildly_bearish', 'mixed') THEN 'mildly_bullish' ELSE {b} END"
    return with_news(f""", x AS (SELECT seq, title, impact_band AS band, market_impact_score AS score, content AS reason FROM news),
y AS (SELECT *, {any_sql('reason', L.BEARISH_TEXT)} AS down, {any_sql('reason', L.BULLISH_TEXT)} AS up, title || ' ' || reason AS said FROM x),
z AS (SELECT *, CASE WHEN down AND NOT up THEN {bear('band')} WHEN up AND NOT down THEN {bull('band')} ELSE band END AS b1 FROM y),
w AS (SELECT *, CASE WHEN {any_sql('said', L.RISK_WORDS)} AND NOT {any_sql('said', L.BENEFIT_WORDS)} THEN {bear('b1')} ELSE b1 END AS b2 FROM z)
SELECT seq, CASE WHEN {any_sql('reason', L.NEUTRAL_PHRASES)} THEN 'neutral' WHEN score < 4 AND b2 NOT IN ('neutral', 'mixed') THEN 'neutral' ELSE b2 END AS band FROM w""")


@query(guardrails_sql())
def guardrails(spark, sf_dir):
    b = scoring.guarded_band(F.col("impact_band"), F.col("market_impact_score"), F.col("title"), F.col("content"), F.lit(""))
    return V.news(spark, sf_dir).select("seq", b.alias("band"))


_TIMES = "CASE seq % 8 WHEN 0 THEN published_at WHEN 1 THEN substr(published_at, 1, 16) WHEN 2 THEN replace(published_at, ' ', 'T') WHEN 3 THEN substr(published_at, 1, 10) WHEN 4 THEN replace(substr(published_at, 1, 10), '-', '') WHEN 5 THEN replace(published_at, '-', '/') WHEN 6 THEN 'soon' ELSE '' END"


def _stamps(news: DataFrame) -> DataFrame:
    return news.withColumn("stamp", F.expr(_TIMES))


@query(with_news(f""", x AS (SELECT seq, {_TIMES} AS stamp FROM news), y AS (SELECT *, {time_sql('stamp', 7)} AS t FROM x), z AS (SELECT *, (epoch_us(TIMESTAMP '{V.AS_OF}') - epoch_us(t)) / 3.6e9 AS h FROM y)
SELECT seq, stamp, CASE WHEN t IS NULL THEN 0.0 WHEN h <= 1 THEN 1.0 WHEN h <= 3 THEN 0.95 WHEN h <= 6 THEN 0.9 WHEN h <= 12 THEN 0.85 WHEN h <= 24 THEN 0.8 ELSE 0.6 END::DOUBLE AS factor FROM z"""))
def time_factor(spark, sf_dir):
    return _stamps(V.news(spark, sf_dir)).select("seq", "stamp", times.freshness(F.col("stamp"), F.lit(V.AS_OF).cast("timestamp")).alias("factor"))


@query(with_news(f", x AS (SELECT seq, {_TIMES} AS stamp FROM news) SELECT seq, coalesce(({time_sql('stamp')})::DATE BETWEEN DATE '2023-12-31' AND DATE '2024-01-01', false) AS inside FROM x"))
def news_window(spark, sf_dir):
    return _stamps(V.news(spark, sf_dir)).select("seq", times.in_window(F.col("stamp"), F.lit(V.AS_OF).cast("timestamp")).alias("inside"))


_BOUND = text.abbreviations(L.SIGNAL_WORDS)


def hits_sql(t: str, words) -> str:
    tests = ", ".join(f"CASE WHEN {any_sql(t, (w,), _BOUND)} THEN {quote(w)} END" for w in words)
    return f"array_to_string(list_filter([{tests}], lambda x: x IS NOT NULL), ',')"


@query(with_news(f"SELECT seq, {hits_sql('title', L.SIGNAL_WORDS)} AS hits, {hits_sql('title', [w for w in L.SIGNAL_WORDS if w not in L.BROAD_SIGNAL_WORDS])} AS core FROM news"))
def signal_hits(spark, sf_dir):
    return V.news(spark, sf_dir).select("seq", joined(scoring.signal_words(F.col("title"))).alias("hits"), joined(scoring.core_signal_words(F.col("title"))).alias("core"))


def sectors_sql() -> str:
    found = ", ".join(f"CASE WHEN contains({CLEAN}, {quote(w)}) THEN {quote(s)} END" for w, s in L.SECTOR_NAMES.items())
    first = "list_filter(l, lambda x, i: x IS NOT NULL AND list_position(l, x) = i)"
    return with_news(f", x AS (SELECT seq, [{found}] AS l FROM news) SELECT seq, array_to_string(list_slice({first}, 1, 5), ',') AS sectors FROM x")


@query(sectors_sql())
def sector_infer(spark, sf_dir):
    return V.news(spark, sf_dir).select("seq", joined(scoring.sectors_of(*cols("title", "content", "name"))).alias("sectors"))


@query(with_news("SELECT seq, " + cases([(f"contains({TEXT}, {quote(w)})", quote(w)) for w in L.MACRO_SUBJECTS], "NULL") + " AS subject FROM news"))
def macro_subject(spark, sf_dir):
    return V.news(spark, sf_dir).select("seq", scoring.macro_subject(F.col("title"), F.col("content")).alias("subject"))


@query(with_news(f"SELECT seq, {amounts_sql(TEXT)} AS numbers FROM news"))
def core_numbers(spark, sf_dir):
    return V.news(spark, sf_dir).select("seq", joined(text.amounts(text.text_of("title", "content"))).alias("numbers"))


_ANCHORS = r"第[一二三四五六七八九十百]+代|[A-Za-z]{2,12}[0-9]+[A-Za-z0-9]*|[0-9]+(?:\.[0-9]+)?(?:亿|万|%|倍|GB|TB|nm|纳米|百分点|年|月|日|G)"


@query(with_news(f"SELECT seq, array_to_string(list_sort(list_distinct(regexp_extract_all(title, {quote(_ANCHORS)}))), ',') AS anchors FROM news"))
def title_anchors(spark, sf_dir):
    return V.news(spark, sf_dir).select("seq", joined(text.title_anchors(F.col("title"))).alias("anchors"))


_STOCKS = "list_sort(list_distinct(list_concat(affected_stocks, CASE WHEN name <> '' THEN [name] ELSE []::VARCHAR[] END)))"
_EVENTS = groups_sql(TEXT, (*L.EVENT_GROUPS, *L.EXTRA_EVENT_GROUPS))
_CORE = [w for w in L.SIGNAL_WORDS if w not in L.BROAD_SIGNAL_WORDS]


@query(with_news(f"SELECT seq, array_to_string({_STOCKS}, ',') AS stocks, {_EVENTS} AS events, {amounts_sql(TEXT)} AS numbers, {title_norm_sql('title')} AS norm FROM news"))
def event_signature(spark, sf_dir):
    t, c, n, s = cols("title", "content", "name", "affected_stocks")
    sig = signatures.signature(t, c, n, s, F.col("entities"), F.col("affected_sectors"), F.col("influence_scope"))
    return V.news(spark, sf_dir).select("seq", sig.alias("s")).select("seq", joined("s.stocks").alias("stocks"), joined("s.events").alias("events"), joined("s.numbers").alias("numbers"), F.col("s.title_norm").alias("norm"))


def fingerprint_sql() -> str:
    words = f"array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN {any_sql(TEXT, (w,), _BOUND)} THEN {quote(w)} END' for w in _CORE)}], lambda x: x IS NOT NULL)), ',')"
    return with_news(f""", x AS (SELECT seq, substr(published_at, 1, 10) AS day, {words} AS sig, array_to_string({_STOCKS}, ',') AS st, {_EVENTS} AS ev, {amounts_sql(TEXT)} AS num, {title_norm_sql('title')} AS norm FROM news)
SELECT seq, substr(md5(CASE WHEN sig <> '' AND st <> '' THEN day || '|sig:[' || sig || ']|ev:[' || ev || ']|st:[' || st || ']' WHEN sig <> '' THEN day || '|sig:[' || sig || ']|ev:[' || ev || ']|t:' || substr(norm, 1, 6)
  WHEN st <> '' THEN day || '|st:[' || st || ']|ev:[' || ev || ']|num:[' || num || ']' WHEN ev <> '' OR num <> '' THEN day || '|ev:[' || ev || ']|num:[' || num || ']|t:' || substr(norm, 1, 6) ELSE day || '|t:' || norm END), 1, 16) AS fp FROM x""")


@query(fingerprint_sql())
def event_fingerprint(spark, sf_dir):
    return V.news(spark, sf_dir).select("seq", signatures.fingerprint(*cols("published_at", "title", "content", "name", "affected_stocks")).alias("fp"))


@query(with_news(f"SELECT seq, {groups_sql('title', L.CORE_FACTS)} AS facts, {groups_sql('title', L.MARKET_THEMES)} AS themes, {groups_sql('title', L.MARKET_DOMAINS.items())} AS domains, " + cases([(any_sql("title", w), quote(k)) for k, w in L.SESSIONS.items()], "NULL") + " AS session FROM news"))
def title_classes(spark, sf_dir):
    t = F.col("title")
    return V.news(spark, sf_dir).select("seq", joined(text.groups_in(t, L.CORE_FACTS)).alias("facts"), joined(text.groups_in(t, L.MARKET_THEMES)).alias("themes"), joined(text.groups_in(t, L.MARKET_DOMAINS.items())).alias("domains"), signatures.session_of(t).alias("session"))


def hard_facts_sql() -> str:
    groups = ", ".join(f"CASE WHEN {any_sql(TEXT, w)} THEN {quote(k)} END" for k, w in L.HARD_EVENTS)
    more = f"CASE WHEN contains({TEXT}, '产能') AND {any_sql(TEXT, L.CAPACITY_WORDS)} THEN 'capacity_expansion' END, CASE WHEN contains({TEXT}, '回购') AND {any_sql(TEXT, ('完成', '完毕', '注销', '实施'))} THEN 'buyback_completion' END"
    return with_news(f"SELECT seq, array_to_string(list_sort(list_distinct(list_filter([{groups}, {more}], lambda x: x IS NOT NULL))), ',') AS facts FROM news")


@query(hard_facts_sql())
def hard_event_facts(spark, sf_dir):
    return V.news(spark, sf_dir).select("seq", joined(signatures.hard_facts(F.col("title"), F.col("content"))).alias("facts"))


_QUALITY = f"""CASE WHEN ((name <> '' AND contains(title, name)) OR len(list_filter(affected_stocks, lambda s: s <> '' AND contains(title, s))) > 0 OR (regexp_matches(title, '[：:]') AND length(trim(regexp_extract(title, '^([^：:]*)[：:]', 1))) BETWEEN 2 AND 12))
  AND regexp_matches(title, '[0-9]') AND {any_sql('title', L.INCREMENT_WORDS)} THEN 1 WHEN NOT regexp_matches(title, '[0-9]') AND NOT {any_sql('title', L.INCREMENT_WORDS)} AND ({any_sql('title', L.EMOTION_WORDS)} OR regexp_matches(title, '[！!]')) THEN -1 ELSE 0 END::INTEGER"""
_ENDS = "'(…|。。。|\\.\\.\\.|。。)$'"
_TRUNCATED = f"CASE WHEN regexp_matches(trim(title), '【[^】]*】') THEN regexp_matches(trim(regexp_extract(trim(title), '【([^】]*)】', 1)), {_ENDS}) OR trim(regexp_extract(trim(title), '【[^】]*】(.*)$', 1)) IN ('…', '。。。', '...', '。。') ELSE regexp_matches(trim(title), {_ENDS}) END"


@query(with_news(f"SELECT seq, {_QUALITY} AS quality, {_TRUNCATED} AS truncated FROM news"))
def headline_quality(spark, sf_dir):
    return V.news(spark, sf_dir).select("seq", gates.headline_quality(*cols("title", "name", "affected_stocks")).alias("quality"), gates.is_truncated(F.col("title")).alias("truncated"))


_MACRO_RE = "|".join(p.replace("(?<![A-Za-z0-9])", "(^|[^A-Za-z0-9])").replace("(?![A-Za-z0-9])", "([^A-Za-z0-9]|$)") for p in L.MACRO_DATA_PATTERNS)


def release_sql(t: str) -> str:
    return f"(regexp_matches({t}, {quote(_MACRO_RE)}) AND {any_sql(t, L.RELEASE_CONTEXT)})"


def deal_sql(t: str) -> str:
    return f"({any_sql(t, L.DEAL_WORDS)} AND (regexp_matches({t}, {quote(chr(91) + '0-9]+(\\.[0-9]+)?\\s*亿')}) OR {tech_sql(t)}))"


def straight_sql(t: str) -> str:
    return f"({any_sql(t, L.SIGNAL_WORDS, _BOUND)} OR {release_sql(t)} OR {deal_sql(t)} OR {any_sql(t, (*L.HEADLINE_ENTITIES, *V.WATCHED))})"


@query(with_news(f"SELECT seq, {release_sql('title')} AS release, {deal_sql('title')} AS deal, {any_sql(TEXT, L.MACRO_POLICY_WORDS)} AS policy, {any_sql('title', L.SIGNAL_WORDS, _BOUND)} AS signal, {straight_sql('title')} AS straight FROM news"))
def direct_pass(spark, sf_dir):
    t = F.col("title")
    return V.news(spark, sf_dir).select("seq", gates.is_macro_release(t).alias("release"), gates.is_major_deal(t).alias("deal"), gates.is_macro_policy(t, F.col("content")).alias("policy"), gates.has_signal(t).alias("signal"), gates.goes_straight(t, V.WATCHED).alias("straight"))


REST_SQL = f"regexp_replace(title, {quote('|'.join(sorted(L.COLUMN_MARKERS, key=lambda w: -len(w))))}, '', 'g')"


def noise_case(names: tuple[str, ...], watched: str, leader: str) -> str:
    """The noise rule over the columns title and rest (REST_SQL). watched: whether a row names one of the names; leader: whether its stock leads."""
    moves = lambda t: f"({any_sql(t, gates._INDEXES)} AND {any_sql(t, L.INDEX_MOVES)})"
    weighty = f"({release_sql('rest')} OR {deal_sql('rest')})"
    column = f"CASE WHEN {any_sql('title', L.DAILY_COLUMNS)} THEN CASE WHEN {weighty} OR {watched} THEN '' ELSE '日报栏目' END WHEN NOT ({any_sql('rest', L.SIGNAL_WORDS, _BOUND)} OR {release_sql('rest')}) THEN '栏目汇总' WHEN NOT ({weighty} OR {any_sql('rest', (*L.HEADLINE_ENTITIES, *names))}) AND ({moves('rest')} OR {any_sql('rest', L.INTRADAY_WORDS)}) THEN '栏目汇总' ELSE '' END"
    body = f"CASE WHEN {any_sql('title', L.NOISE_LEADERS)} OR {any_sql('title', (*L.EVENT_VERBS, *names))} THEN '' WHEN regexp_matches(title, {quote(gates._MOVE)}) AND regexp_matches(title, {quote(gates._SIZE)}) THEN '播报体' ELSE '' END"
    return f"""CASE WHEN title = '' THEN '' WHEN {any_sql('title', L.COLUMN_MARKERS)} THEN {column} WHEN {moves('title')} THEN '指数播报' WHEN {any_sql('title', L.OVERSEAS_STOCKS)} AND {any_sql('title', L.OVERSEAS_MOVES)} THEN '外盘个股播报'
  WHEN {any_sql('title', L.INTRADAY_WORDS)} AND NOT {any_sql('title', L.CORPORATE_EVENTS)} AND NOT ({watched} OR {any_sql('title', L.NOISE_LEADERS)} OR {leader}) THEN '盘面异动' ELSE {body} END"""


def noise_sql() -> str:
    watched = any_sql("(title || ' ' || name || ' ' || content)", V.WATCHED)
    reason = noise_case(V.WATCHED, watched, "(market_impact_score >= 8 AND influence_scope = 'stock')")
    return with_news(f", x AS (SELECT *, {REST_SQL} AS rest FROM news), y AS (SELECT seq, {reason} AS reason FROM x) SELECT reason, count(*) AS n, min(seq) AS first FROM y GROUP BY reason")


@query(noise_sql())
def noise_reason_counts(spark, sf_dir):
    r = gates.noise_reason(*cols("title", "name", "content", "market_impact_score", "influence_scope"), F.lit(True), V.WATCHED)
    return V.news(spark, sf_dir).groupBy(r.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


_LEADER = f"title IN ({', '.join(map(quote, V.HEADLINES[:9]))})"


@query(with_news(f"""SELECT seq, influence_scope = 'market' OR CASE WHEN influence_scope = 'sector' THEN s >= 6 OR strong WHEN influence_scope IN ('stock', '') AND influence_scope = 'stock' THEN {_LEADER} AND (s >= 6 OR strong) ELSE false END AS strict,
  influence_scope = 'market' OR s >= 6 OR (strong AND influence_scope IN ('sector', 'stock')) AS standard, influence_scope = 'market' OR s >= 5 AS loose FROM (SELECT *, market_impact_score AS s, impact_direction IN ('bullish', 'bearish') AS strong FROM news)"""))
def threshold_modes(spark, sf_dir):
    args = cols("market_impact_score", "impact_direction", "influence_scope")
    leader = F.col("title").isin(*V.HEADLINES[:9])
    return V.news(spark, sf_dir).select("seq", *[gates.passes_threshold(m, *args, leader).alias(m) for m in ("strict", "standard", "loose")])


@query(with_news(f"""SELECT seq, CASE WHEN {release_sql(TEXT)} OR {deal_sql(TEXT)} OR (impact_direction = 'bearish' AND market_impact_score >= 7) THEN '' WHEN isodow(t) >= 6 THEN '周末静默' WHEN hour(t) * 60 + minute(t) >= 1290 OR hour(t) < 8 THEN '夜间静默(21:30-08:00)' ELSE '' END AS reason FROM (SELECT *, strptime(published_at, '%Y-%m-%d %H:%M:%S') AS t FROM news)"""))
def quiet_hours(spark, sf_dir):
    t, c, d, s = cols("title", "content", "impact_direction", "market_impact_score")
    return V.news(spark, sf_dir).select("seq", gates.quiet_reason(t, c, d, s, F.lit(False), F.col("published_at").cast("timestamp")).alias("reason"))


@query(with_news(f"""SELECT seq, CASE WHEN {any_sql("(title || ' ' || content || ' ' || array_to_string(affected_sectors, ' '))", L.OVERSEAS_TECH_WORDS, text.abbreviations(L.OVERSEAS_TECH_WORDS))} THEN CASE WHEN {any_sql('source', L.OVERSEAS_SOURCES)} THEN 'overseas' ELSE 'domestic' END ELSE '' END AS origin,
  {any_sql("array_to_string(affected_sectors, ' ')", L.TECH_SECTOR_WORDS)} AS by_sector, regexp_matches(title || ' ' || content, '\\*ST|(^|[^A-Za-z])ST([^A-Za-z]|$)|退市|终止上市') AS delisting FROM news"""))
def tech_origin(spark, sf_dir):
    t, c, s, a = cols("title", "content", "source", "affected_sectors")
    return V.news(spark, sf_dir).select("seq", gates.tech_source(t, c, s, a).alias("origin"), text.any_of(F.concat_ws(" ", a), L.TECH_SECTOR_WORDS).alias("by_sector"), scoring.is_delisting(text.text_of(t, c)).alias("delisting"))


@query()
def risk_off_downgrade(spark, sf_dir):
    """Left contexts of numbers and verbs: no SQL without look-behind; held against cases in the tests."""
    t, c, s, a, d = cols("title", "content", "source", "affected_sectors", "impact_direction")
    return V.news(spark, sf_dir).select("seq", gates.has_hard_fact(t, c).alias("hard"), gates.falls_with_risk(t, c, s, a, d).alias("falls"))


@query()
def direction_rules(spark, sf_dir):
    """Negations in left windows: held against a brute-force version in the tests."""
    return V.news(spark, sf_dir).select("seq", scoring.rule_direction(F.col("title"), F.col("content")).alias("direction"))


@query()
def direction_wordings(spark, sf_dir):
    value = F.element_at(F.array(*map(F.lit, ("看涨", "强利空", "先涨后跌", " Bullish ", "中性偏多", "弱利好", "???", "mildly_x"))), (1 + F.col("seq") % 8).cast("int"))
    return V.news(spark, sf_dir).select("seq", value.alias("value"), gates.normal_direction(value, F.col("title"), F.col("content")).alias("direction"))


@query(with_news("SELECT sector, count(*) AS n FROM (SELECT " + cases([(any_sql("low", w), quote(k)) for k, w in L.SECTOR_RULES], "raw") + " AS sector FROM (SELECT raw, lower(raw) AS low FROM (SELECT unnest(affected_sectors) AS raw FROM news))) GROUP BY sector"))
def sector_heat(spark, sf_dir):
    raw = V.news(spark, sf_dir).select(F.explode("affected_sectors").alias("raw"))
    return raw.groupBy(scoring.canonical_sector(F.col("raw")).alias("sector")).agg(F.count(F.lit(1)).alias("n"))


@query(with_news(f"SELECT seq, {any_sql('source', L.NATIONAL_SOURCES)} AS national, {any_sql(TEXT, L.NATIONAL_POLICY_WORDS)} AS policy, {any_sql(TEXT, L.HIGH_IMPACT_ANNOUNCEMENTS)} AS high_impact, " + cases([(any_sql("title", w), quote(k)) for k, w in L.ANNOUNCEMENT_TYPES], "''") + " AS kind FROM news"))
def row_classes(spark, sf_dir):
    from ..operators import ranking

    t, c = cols("title", "content")
    return V.news(spark, sf_dir).select("seq", scoring.is_national(F.col("source")).alias("national"), text.any_of(text.text_of(t, c), L.NATIONAL_POLICY_WORDS).alias("policy"), ranking.is_high_impact(t, c).alias("high_impact"), scoring.announcement_type(F.lit(""), t).alias("kind"))


_PAIRS = "x AS (SELECT seq, title, row_number() OVER (ORDER BY seq) AS i FROM news), p AS (SELECT a.seq AS a, b.seq AS b, a.title AS ta, b.title AS tb FROM news a JOIN news b ON b.seq = a.seq + 1)"


@query(with_news(f", {_PAIRS} SELECT a, b, coalesce(list_max(list_transform(range(1, length(ta) + 1), lambda i: coalesce(list_max(list_filter(range(1, length(ta) - i + 2), lambda n: contains(tb, substr(ta, i::INTEGER, n::INTEGER)))), 0))), 0)::INTEGER AS stretch FROM p"))
def lcs_pairs(spark, sf_dir):
    """The longest common stretch of each title and the next row's."""
    n = V.news(spark, sf_dir).select("seq", F.col("title").alias("t"))
    pairs = n.select(F.col("seq").alias("a"), F.col("t").alias("ta")).join(n.select((F.col("seq") - 1).alias("a"), F.col("seq").alias("b"), F.col("t").alias("tb")), "a")
    return pairs.select("a", "b", text.common_stretch(F.col("ta"), F.col("tb")).alias("stretch"))


def _event_links(spark, sf_dir):
    from ..operators.events import signed
    from ..operators.same_events import same_event_links

    return same_event_links(signed(V.news(spark, sf_dir), F.col("entities"), F.col("affected_sectors"), F.col("influence_scope")))


@query()
def same_event_pairs(spark, sf_dir):
    """All pairs of classes (rows with one signature, named by the least) that tell of the same event; `same_event_rows` has the rows."""
    return _event_links(spark, sf_dir)[1]


@query()
def same_event_rows(spark, sf_dir):
    """Each row's class, and with how many other classes it shares an event."""
    rows, pairs = _event_links(spark, sf_dir)
    ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class")))
    return rows.join(ends.groupBy("class").agg(F.count(F.lit(1)).alias("links")), "class", "left").select("seq", "class", F.coalesce("links", F.lit(0)).alias("links"))
