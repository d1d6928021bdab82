"""Queries over feeds, state, ranking and sent events, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import numbered, shared_folder, stored
from ..functions import lexicons as L
from ..operators import dedup, events, health, ranking, state
from . import views as V
from .sql import amounts_sql, any_sql, cases, chars_sql, greedy_sql, groups_sql, jaccard_sql, listed, quote, title_core_sql
from .text_queries import CLEAN, TEXT, _BOUND, _QUALITY, _STOCKS, _TRUNCATED, cols, importance_sql, release_sql, straight_sql, tech_sql, with_news

QUERIES: dict = {}
SQL: dict[str, str] = {}
TIMED = {"seen_prune", "pending_settle", "pending_given_up", "pending_reinject", "merge_seen", "merge_pending", "events_compaction", "events_archive", "candidates_compaction", "rate_limit_24h", "rate_limit_stream", "source_alerts", "source_alerts_stream"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            SQL[f.__name__] = f"SELECT * REPLACE (strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS t) FROM ({text})" if f.__name__ in TIMED else text
        return f

    return add


def dated(f):
    """The query with its times as text, so that no engine's time type or zone matters."""

    def run(spark, sf_dir):
        return f(spark, sf_dir).withColumn("t", F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS"))

    run.__name__ = f.__name__
    run.__doc__ = f.__doc__
    return run


def as_of(text: str = V.STATE_AS_OF):
    return F.lit(text).cast("timestamp")


_AT = f"TIMESTAMP '{V.STATE_AS_OF}'"


@query(f"WITH {V.SEEN_SQL}, live AS (SELECT * FROM seen WHERE t >= {_AT} - CASE WHEN pushed THEN INTERVAL 48 HOUR ELSE INTERVAL 24 HOUR END) SELECT fp, t, pushed, title FROM live ORDER BY pushed DESC, t DESC, fp DESC LIMIT 200")
@dated
def seen_prune(spark, sf_dir):
    return state.prune_seen(V.seen(spark, sf_dir), as_of(), most=200, max_bytes=10**9)


@query(f"WITH {V.SEEN_SQL}, {V.PENDING_SQL}, p AS (SELECT *, retry >= CASE WHEN {any_sql('title', L.SIGNAL_WORDS, _BOUND)} THEN 10 ELSE 3 END AS spent FROM pending) SELECT fp, t, retry, title, payload FROM p WHERE NOT spent AND t >= {_AT} - INTERVAL 48 HOUR ORDER BY t DESC, fp DESC LIMIT 200")
@dated
def pending_settle(spark, sf_dir):
    return state.settle_pending(V.pending(spark, sf_dir), V.seen(spark, sf_dir), as_of())[0]


@query(f"WITH {V.SEEN_SQL}, {V.PENDING_SQL}, p AS (SELECT *, retry >= CASE WHEN {any_sql('title', L.SIGNAL_WORDS, _BOUND)} THEN 10 ELSE 3 END AS spent FROM pending) SELECT fp, t, false AS pushed, substr(title, 1, 60) || '[溢出放弃]' AS title FROM p WHERE spent AND fp NOT IN (SELECT fp FROM seen WHERE pushed)")
@dated
def pending_given_up(spark, sf_dir):
    return state.settle_pending(V.pending(spark, sf_dir), V.seen(spark, sf_dir), as_of())[1]


@query(f"WITH {V.SEEN_SQL}, {V.PENDING_SQL}, fetched AS (SELECT fp FROM pending WHERE retry = 5) SELECT fp, t, retry, title, payload FROM pending WHERE payload IS NOT NULL AND fp NOT IN (SELECT replace(fp, 'f', 'f') || 'p0' FROM seen WHERE pushed) AND fp NOT IN (SELECT fp FROM fetched)")
@dated
def pending_reinject(spark, sf_dir):
    p, s = V.pending(spark, sf_dir), V.seen(spark, sf_dir).where("pushed").withColumn("fp", F.concat("fp", F.lit("p0")))
    return state.reinjected(p, s, p.where("retry = 5").select("fp"))


@query(f"WITH {V.SEEN_SQL}, r AS (SELECT fp, t + INTERVAL 1 HOUR AS t, NOT pushed AS pushed, title || ' r' AS title FROM seen WHERE title < 'purchase 5') SELECT fp, CASE WHEN r_has AND (NOT l_has OR NOT (l_p AND NOT r_p)) THEN rt ELSE lt END AS t, coalesce(l_p, false) OR coalesce(r_p, false) AS pushed, CASE WHEN r_has AND (NOT l_has OR NOT (l_p AND NOT r_p)) THEN rn ELSE ln END AS title FROM (SELECT coalesce(l.fp, r.fp) AS fp, l.fp IS NOT NULL AS l_has, r.fp IS NOT NULL AS r_has, l.pushed AS l_p, r.pushed AS r_p, l.t AS lt, r.t AS rt, l.title AS ln, r.title AS rn FROM seen l FULL JOIN r ON l.fp = r.fp)")
@dated
def merge_seen(spark, sf_dir):
    local = V.seen(spark, sf_dir)
    remote = local.where("title < 'purchase 5'").select("fp", (F.col("t") + F.expr("INTERVAL 1 HOUR")).alias("t"), (~F.col("pushed")).alias("pushed"), F.concat("title", F.lit(" r")).alias("title"))
    return state.merge_seen(local, remote)


@query(f"WITH {V.PENDING_SQL}, r AS (SELECT fp, t, ((retry * 7) % 12)::INTEGER AS retry, title || ' r' AS title, payload FROM pending) SELECT l.fp, l.t, greatest(l.retry, r.retry) AS retry, CASE WHEN l.retry >= r.retry THEN l.title ELSE r.title END AS title, l.payload FROM pending l JOIN r ON l.fp = r.fp")
@dated
def merge_pending(spark, sf_dir):
    local = V.pending(spark, sf_dir)
    remote = local.select("fp", "t", ((F.col("retry") * 7) % 12).cast("int").alias("retry"), F.concat("title", F.lit(" r")).alias("title"), "payload")
    return state.merge_pending(local, remote)


_KEYED = f"{V.LOG_SQL}, k AS (SELECT event_id, t, dir || '#' || array_to_string(entities, '|') AS sig_key FROM log)"


def _keyed_log(spark, sf_dir):
    return V.event_log(spark, sf_dir).select("event_id", "t", F.concat_ws("#", "dir", F.concat_ws("|", "sig.entities")).alias("sig_key"))


@query(f"WITH {_KEYED} SELECT event_id, t, sig_key FROM k WHERE t >= {_AT} - INTERVAL 48 HOUR ORDER BY t DESC, event_id DESC LIMIT 300")
@dated
def events_compaction(spark, sf_dir):
    log = _keyed_log(spark, sf_dir)
    return state.compact_events(log, log.where("event_id < 0"), as_of())[0]


@query(f"WITH {_KEYED}, kept AS (SELECT event_id FROM k WHERE t >= {_AT} - INTERVAL 48 HOUR ORDER BY t DESC, event_id DESC LIMIT 300), old AS (SELECT * FROM k WHERE event_id % 97 = 0), gone AS (SELECT * FROM k WHERE event_id NOT IN (SELECT event_id FROM kept) AND sig_key NOT IN (SELECT sig_key FROM old)), once AS (SELECT * FROM gone QUALIFY row_number() OVER (PARTITION BY sig_key ORDER BY event_id) = 1) SELECT event_id, t, sig_key FROM (SELECT * FROM old UNION ALL SELECT * FROM once) ORDER BY t DESC, event_id DESC LIMIT 2000")
@dated
def events_archive(spark, sf_dir):
    log = _keyed_log(spark, sf_dir)
    return state.compact_events(log, log.where("event_id % 97 = 0"), as_of())[1]


@query(f"WITH {V.SEEN_SQL} SELECT fp, t, pushed, title FROM seen WHERE t >= {_AT} - INTERVAL 48 HOUR ORDER BY pushed, t DESC, fp DESC LIMIT 300")
@dated
def candidates_compaction(spark, sf_dir):
    return state.compact_candidates(V.seen(spark, sf_dir), as_of())


@query(with_news("SELECT n.seq FROM news n WHERE n.seq::VARCHAR NOT IN (SELECT user_id::VARCHAR FROM events)"))
def seen_antijoin(spark, sf_dir):
    seen = V.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("fp")).distinct()
    return state.unseen(V.news(spark, sf_dir).withColumn("fp", F.col("seq").cast("string")), seen).select("seq")


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS k, ts AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
walk AS (SELECT k, t, t AS last, i, true AS kept FROM e WHERE i = 1 UNION ALL SELECT e.k, e.t, CASE WHEN e.t - w.last >= INTERVAL 24 HOUR THEN e.t ELSE w.last END, e.i, e.t - w.last >= INTERVAL 24 HOUR FROM walk w JOIN e ON e.k = w.k AND e.i = w.i + 1) SELECT k, t FROM walk WHERE kept""")
@dated
def rate_limit_24h(spark, sf_dir):
    return state.spaced(V.table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("t")), "k")


_WALK = """e AS (SELECT {k} AS k, {t} AS t, row_number() OVER (PARTITION BY {k} ORDER BY {t}) AS i FROM {rows}),
walk AS (SELECT k, t, t AS last, i, true AS kept FROM e WHERE i = 1 UNION ALL SELECT e.k, e.t, CASE WHEN e.t - w.last >= INTERVAL 24 HOUR THEN e.t ELSE w.last END, e.i, e.t - w.last >= INTERVAL 24 HOUR FROM walk w JOIN e ON e.k = w.k AND e.i = w.i + 1)"""


def _streamed(spark, rows, of):
    """What a keyed stream over the rows has given when they have all come, an hour before the last one."""
    import uuid

    folder = f"{shared_folder(spark)}/tidemark-streams/{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    out = of(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query(f"WITH RECURSIVE {_WALK.format(k='user_id', t='ts', rows='events')} SELECT k, t FROM walk WHERE kept AND t <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
@dated
def rate_limit_stream(spark, sf_dir):
    """rate_limit_24h as a stream with state for each key."""
    from ..streaming import keyed

    rows = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("t"))
    return _streamed(spark, rows, lambda s: keyed.spaced(s, "k"))


_TIMED_ROUNDS = f"{V.ROUNDS_SQL}, timed AS (SELECT source, TIMESTAMP '2024-01-01 00:00:00' + to_hours(round * 7) AS t, count, max(count) OVER (PARTITION BY round) > 0 AS alive FROM rounds), m AS (SELECT *, sum(CASE WHEN count > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY t) AS g FROM timed), s AS (SELECT source, t, count, alive, sum(CASE WHEN count > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY source, g ORDER BY t)::BIGINT AS streak FROM m), due AS (SELECT * FROM s WHERE streak >= 6 AND alive)"
_ALERTS = f"WITH RECURSIVE {_TIMED_ROUNDS}, {_WALK.format(k='source', t='t', rows='due')} SELECT s.source, s.t, s.count, s.streak, coalesce(w.kept, false) AS alert FROM s LEFT JOIN walk w ON w.k = s.source AND w.t = s.t"


def _timed_rounds(spark, sf_dir):
    r = V.rounds(spark, sf_dir)
    alive = r.groupBy("round").agg((F.max("count") > 0).alias("alive"))
    t = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("round") * 7 * 3600)
    return r.join(alive, "round").select("source", t.alias("t"), "count", "alive")


@query(_ALERTS)
@dated
def source_alerts(spark, sf_dir):
    """Streaks and rate-limited alerts of all rounds, as tables."""
    return health.history(_timed_rounds(spark, sf_dir)).select("source", "t", "count", "streak", "alert")


@query(f"{_ALERTS} WHERE s.t <= (SELECT max(t) FROM s) - INTERVAL 1 HOUR")
@dated
def source_alerts_stream(spark, sf_dir):
    """The same as a stream with state for each source."""
    from ..streaming import keyed

    return _streamed(spark, _timed_rounds(spark, sf_dir), keyed.source_health)


@query(f"WITH {V.ROUNDS_SQL}, m AS (SELECT *, sum(CASE WHEN count > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY round) AS g FROM rounds) SELECT source, round::INTEGER AS round, count, sum(CASE WHEN count > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY source, g ORDER BY round)::BIGINT AS streak FROM m")
def source_streak(spark, sf_dir):
    return health.streaks(V.rounds(spark, sf_dir))


_LATEST = f"{V.ROUNDS_SQL}, last AS (SELECT source, max(round)::INTEGER AS round, arg_max(count, round) AS count, coalesce(max(CASE WHEN count > 0 THEN round END), 0) AS full_round FROM rounds GROUP BY source), h AS (SELECT source, round, count, (30 - full_round)::BIGINT AS streak FROM last)"


@query(f"WITH {_LATEST} SELECT * FROM h")
def source_health(spark, sf_dir):
    return health.latest(V.rounds(spark, sf_dir))


@query(f"WITH {_LATEST}, g AS (SELECT *, CASE WHEN source % 2 = 0 THEN {_AT} - to_hours(source % 50) END AS last_alert FROM h) SELECT source, round, count, streak FROM g WHERE streak >= 6 AND (last_alert IS NULL OR {_AT} - last_alert >= INTERVAL 24 HOUR) AND (SELECT max(count) FROM h) > 0")
def health_alerts(spark, sf_dir):
    h = health.latest(V.rounds(spark, sf_dir))
    last = F.when(F.col("source") % 2 == 0, F.timestamp_micros(F.unix_micros(as_of()) - (F.col("source") % 50) * 3_600_000_000))
    return health.alerts(h.withColumn("last_alert", last), as_of()).select("source", "round", "count", "streak")


def ranked_sql() -> str:
    cred = cases([("source = ''", "0.62"), *[(f"source = {quote(k)}", str(v)) for k, v in L.CREDIBILITY.items()], *[(f"contains(source, {quote(k)}) OR contains({quote(k)}, source)", str(v)) for k, v in L.CREDIBILITY.items()], (any_sql("source", ("交易所", "证监会", "央行", "国务院", "银保监", "发改委")), "0.95"), (any_sql("source", ("证券报", "证券时报", "财经", "时报", "日报")), "0.82"), (any_sql("source", ("券商", "证券", "研究")), "0.74")], "0.62")
    national = any_sql("source", L.NATIONAL_SOURCES)
    checked = "CASE WHEN name <> '' THEN list_append(affected_stocks, name) ELSE affected_stocks END"
    return f""", r0 AS (SELECT *, {cred}::DOUBLE AS cred, greatest(0, least(1, market_impact_score / 10))::DOUBLE AS impact, {CLEAN} AS clean, {TEXT} AS raw, {checked} AS checked FROM news),
r1 AS (SELECT *, round((CASE category WHEN 'announcement' THEN 0.05::DOUBLE * cred + 0.95::DOUBLE * impact WHEN 'signal' THEN 0.1::DOUBLE * cred + 0.9::DOUBLE * impact ELSE 0.15::DOUBLE * cred + 0.7::DOUBLE * impact + least(cluster_weight * 0.05::DOUBLE, 0.15::DOUBLE) END) * (CASE WHEN impact_direction <> 'neutral' OR impact >= 0.7 THEN 1.0 WHEN impact >= 0.4 THEN 0.92 ELSE 0.8 END)::DOUBLE + 1e-9::DOUBLE, 4) AS t1,
  CASE WHEN influence_scope <> '' THEN influence_scope WHEN ({national} AND {any_sql('raw', L.NATIONAL_POLICY_WORDS)}) OR len(affected_sectors) >= 3 THEN 'market' WHEN len(affected_sectors) > 0 OR list_has_any(list_filter(list_append(affected_stocks, name), lambda s: s <> ''), {listed(V.MEMBERS)}) THEN 'sector' ELSE 'stock' END AS scope FROM r0),
r2 AS (SELECT *, round(t1 * (CASE WHEN {tech_sql('clean')} THEN 1.2 WHEN {national} AND {any_sql('clean', L.NATIONAL_POLICY_WORDS)} THEN 1.15 WHEN {national} THEN 1.08 WHEN scope = 'market' THEN 1.0 ELSE 0.85 END)::DOUBLE + 1e-9::DOUBLE, 4) AS t2, regexp_matches(raw, '\\*ST|(^|[^A-Za-z])ST([^A-Za-z]|$)|退市|终止上市') AS delisting, scope = 'stock' AND len(checked) > 0 AND NOT list_has_any(checked, {listed(V.MEMBERS)}) AS outside FROM r1),
r3 AS (SELECT *, CASE WHEN outside AND delisting THEN round(round(t2 * 0.7::DOUBLE + 1e-9::DOUBLE, 4) * 0.6::DOUBLE + 1e-9::DOUBLE, 4) WHEN outside THEN round(t2 * 0.7::DOUBLE + 1e-9::DOUBLE, 4) WHEN delisting AND impact_direction = 'bearish' THEN round(t2 * 0.85::DOUBLE + 1e-9::DOUBLE, 4) ELSE t2 END AS t3,
  (epoch_us(TIMESTAMP '{V.AS_OF}') - epoch_us(strptime(published_at, '%Y-%m-%d %H:%M:%S'))) / 3.6e9 AS h,
  CASE WHEN (impact_band IN ('bullish', 'mildly_bullish') AND impact_direction = 'bearish') OR (impact_band IN ('bearish', 'mildly_bearish') AND impact_direction = 'bullish') THEN CASE impact_band WHEN 'bullish' THEN 'mildly_bullish' WHEN 'bearish' THEN 'mildly_bearish' ELSE 'neutral' END ELSE impact_band END AS band FROM r2),
r4 AS (SELECT *, CASE WHEN h <= 1 THEN 1.0 WHEN h <= 3 THEN 0.95 WHEN h <= 6 THEN 0.9 WHEN h <= 12 THEN 0.85 WHEN h <= 24 THEN 0.8 ELSE 0.6 END::DOUBLE AS tf FROM r3),
r5 AS (SELECT *, round(round(t3 * (0.9::DOUBLE + 0.1::DOUBLE * tf) + 1e-9::DOUBLE, 4) * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.9 WHEN 'low' THEN 0.7 ELSE 0.85 END::DOUBLE + 1e-9::DOUBLE, 4) AS total, CASE WHEN band IN ('bullish', 'bearish', 'mixed') THEN 6 WHEN band LIKE 'mildly%' THEN 4 ELSE 1 END AS priority FROM r4),
ranks AS (SELECT *, row_number() OVER (ORDER BY priority DESC, round(total + CASE scope WHEN 'market' THEN 0.2 WHEN 'stock' THEN -0.05 ELSE 0 END, 4) DESC, tf DESC, seq) AS rank FROM r5)"""


def _members():
    return F.array(*map(F.lit, V.MEMBERS))


def _ranked(spark, sf_dir):
    """news in order with rank: narrow rows are sorted by range and numbered, and the rank comes back to the rows."""
    n = ranking.scored(V.news(spark, sf_dir), as_of(V.AS_OF), constituents=_members())
    boost = F.when(F.col("influence_scope") == "market", 0.20).when(F.col("influence_scope") == "stock", -0.05).otherwise(0.0)
    scored = stored(n.withColumn("rank_score", F.round(F.col("total_score") + boost, 4)))
    order = [F.desc("band_priority"), F.desc("rank_score"), F.desc("time_factor"), F.asc("seq")]
    ranks = numbered(scored.select("seq", "band_priority", "rank_score", "time_factor"), order, "rank")
    return scored.join(ranks.select("seq", "rank"), "seq")


@query(with_news(ranked_sql() + " SELECT rank, seq, band AS impact_band, scope AS influence_scope, total AS total_score, tf AS time_factor FROM ranks"))
def rank_news(spark, sf_dir):
    return _ranked(spark, sf_dir).select("rank", "seq", "impact_band", "influence_scope", "total_score", "time_factor")


def candidates_sql(order: str, limit: int) -> str:
    inner = importance_sql().split("SELECT seq, category,", 1)
    body = inner[0].split("WITH", 1)[1]
    return f"WITH {body}, pref AS (SELECT seq AS s, {inner[1].split(' FROM y')[0].strip().removesuffix('AS importance')} AS pref FROM y), c AS (SELECT n.*, p.pref, {straight_sql('x')} AS hit, {release_sql(TEXT)} AS released, round(least(CASE WHEN {any_sql(TEXT, V.WATCHED)} THEN 0.25 ELSE 0 END + least(len(list_filter({listed(L.CHAIN_WORDS)}, lambda w: contains({TEXT}, w))) * 0.05::DOUBLE, 0.15), 0.40), 4)::DOUBLE AS relevance, {_QUALITY} AS quality, {_TRUNCATED} AS truncated FROM y n JOIN pref p ON p.s = n.seq) SELECT seq, pref AS pref_score, hit, relevance, quality, truncated FROM c WHERE pref >= 0.55 OR hit ORDER BY {order} LIMIT {limit}"


@query(candidates_sql("hit DESC, released DESC, relevance DESC, truncated, quality DESC, pref DESC, seq", 40))
def candidate_top40(spark, sf_dir):
    return ranking.candidates(V.news(spark, sf_dir), V.WATCHED).select("seq", "pref_score", "hit", "relevance", "quality", "truncated")


_HEAD = "CASE WHEN instr(title, '：') > 0 THEN trim(split_part(title, '：', 1)) WHEN instr(title, ':') > 0 THEN trim(split_part(title, ':', 1)) END"


@query(with_news(f", k AS (SELECT seq, market_impact_score, CASE WHEN category = 'announcement' THEN CASE WHEN len({_STOCKS}) > 0 THEN {_STOCKS}[1] ELSE {_HEAD} END END AS key FROM news) SELECT seq FROM k QUALIFY key IS NULL OR row_number() OVER (PARTITION BY key ORDER BY market_impact_score DESC, seq) <= 2"))
def cap_per_stock(spark, sf_dir):
    return ranking.cap_per_stock(V.news(spark, sf_dir), [F.desc("market_impact_score"), F.asc("seq")]).select("seq")


@query(with_news(", k AS (SELECT seq, market_impact_score, CASE WHEN influence_scope IN ('market', 'sector') THEN " + cases([(f"contains({TEXT}, {quote(w)})", quote(w)) for w in L.MACRO_SUBJECTS], "NULL") + " END AS key FROM news) SELECT seq FROM k QUALIFY key IS NULL OR row_number() OVER (PARTITION BY key ORDER BY market_impact_score DESC, seq) <= 2"))
def cap_per_subject(spark, sf_dir):
    return ranking.cap_per_subject(V.news(spark, sf_dir), [F.desc("market_impact_score"), F.asc("seq")]).select("seq")


_QUOTA = """q0 AS (SELECT *, d > 10 AS cut, CASE WHEN d > 10 THEN 10 ELSE greatest(20 - d, 10) END AS rest, s + m AS o FROM counts),
q1 AS (SELECT *, CASE WHEN o = 0 THEN 0 WHEN o <= rest THEN s ELSE greatest(least(round_even(rest * s::DOUBLE / o, 0)::BIGINT, s), least(6, s)) END AS qs FROM q0),
q2 AS (SELECT *, CASE WHEN o = 0 THEN 0 WHEN o <= rest THEN m ELSE greatest(least(rest - qs, m), least(4, m)) END AS qm FROM q1)"""


@query(f"WITH counts AS (SELECT p_partkey AS k, p_size::BIGINT AS d, (p_partkey % 23)::BIGINT AS s, (p_partkey % 17)::BIGINT AS m FROM part), {_QUOTA} SELECT k, CASE WHEN cut THEN 10 + greatest(0, 10 - qs - qm) ELSE -1 END::INTEGER AS direct, qs::INTEGER AS sector, qm::INTEGER AS macro FROM q2")
def adaptive_quota(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("k"), ranking.quota(F.col("p_size").cast("long"), F.col("p_partkey") % 23, F.col("p_partkey") % 17).alias("q")).select("k", F.coalesce("q.direct", F.lit(-1)).alias("direct"), "q.sector", "q.macro")


@query(with_news(f""", k AS (SELECT seq, market_impact_score AS score, CASE seq % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'sector' ELSE 'macro' END AS bucket FROM news), counts AS (SELECT count(*) FILTER (bucket = 'direct') AS d, count(*) FILTER (bucket = 'sector') AS s, count(*) FILTER (bucket = 'macro') AS m FROM k), {_QUOTA},
l AS (SELECT 'direct' AS b, CASE WHEN cut THEN 10 + greatest(0, 10 - qs - qm) END AS most FROM q2 UNION ALL SELECT 'sector', qs FROM q2 UNION ALL SELECT 'macro', qm FROM q2),
n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, seq) AS i FROM k) SELECT seq, bucket, score FROM n JOIN l ON b = bucket WHERE most IS NULL OR i <= most ORDER BY score DESC, seq LIMIT 20"""))
def quota_selection(spark, sf_dir):
    n = V.news(spark, sf_dir).select("seq", F.col("market_impact_score").alias("score"), F.element_at(F.array(*map(F.lit, ("direct", "sector", "macro"))), (1 + F.col("seq") % 3).cast("int")).alias("bucket"))
    return ranking.take_by_quota(n).select("seq", "bucket", "score")


@query()
def judging_selection(spark, sf_dir):
    return ranking.before_judging(V.news(spark, sf_dir), constituents=_members()).select("seq", "bucket", "score", "cluster_weight")


@query(with_news(f"""SELECT seq, category <> 'announcement' AND NOT (name IN ({', '.join(map(quote, L.LEADER_NAMES))}) OR code IN ({', '.join(map(quote, L.LEADER_CODES))}) OR {any_sql('x', L.LEADER_NAMES)}) AND (name <> '' OR code <> '' OR regexp_matches(x, '(^|[^0-9])[0-9]{{6}}([^0-9]|$)')) AND NOT {any_sql('x', (*L.SECTOR_WORDS, *L.MACRO_NEWS_WORDS))} AS self_only,
  {any_sql(TEXT, L.HIGH_IMPACT_ANNOUNCEMENTS)} OR name IN ({', '.join(map(quote, V.MEMBERS))}) OR lpad(trim(code), 6, '0') IN ({', '.join(map(quote, L.LEADER_CODES))}) OR name IN ({', '.join(map(quote, L.LEADER_NAMES))}) AS matters FROM (SELECT *, CASE WHEN name = '' THEN {TEXT} ELSE replace({TEXT}, name, '') END AS x FROM news)"""))
def leader_gates(spark, sf_dir):
    t, c, n, code, k = cols("title", "content", "name", "code", "category")
    return V.news(spark, sf_dir).select("seq", ranking.is_self_only(t, c, n, code, k).alias("self_only"), ranking.leads_or_matters(t, c, n, code, _members()).alias("matters"))


_TITLED = f"CASE WHEN len({_STOCKS}) > 0 THEN {_STOCKS} WHEN {_HEAD} IS NOT NULL THEN [{_HEAD}] ELSE []::VARCHAR[] END"


def _by_event(rows: str) -> str:
    """CTEs that end in e_kept: greedy over shared stocks and facts."""
    facts = f"list_concat(list_transform(string_split({groups_sql(TEXT, L.EVENT_GROUPS)}, ','), lambda x: 'e:' || x), list_transform(string_split({amounts_sql(TEXT)}, ','), lambda x: 'n:' || x))"
    return f"""e_keys AS MATERIALIZED (SELECT DISTINCT seq, stock || chr(1) || fact AS key FROM (SELECT seq, unnest(stocks) AS stock, facts FROM (SELECT seq, {_TITLED} AS stocks, {facts} AS facts FROM {rows})) x, (SELECT unnest(x.facts) AS fact) f WHERE length(fact) > 2),
e_pairs AS (SELECT DISTINCT a.seq AS a, b.seq AS b FROM e_keys a JOIN e_keys b ON a.key = b.key AND a.seq < b.seq), {greedy_sql('e', rows, 'e_pairs')}"""


def _by_title(rows: str) -> str:
    """CTEs that end in t_out: greedy over like titles; equal cores stand together under their first row."""
    return f"""cores AS (SELECT seq, {title_core_sql('title')} AS core FROM {rows}), t_nodes AS MATERIALIZED (SELECT min(seq) AS seq, core, {chars_sql('core')} AS chars FROM cores WHERE core <> '' GROUP BY core),
t_pairs AS (SELECT a.seq AS a, b.seq AS b FROM t_nodes a JOIN t_nodes b ON a.seq < b.seq AND ({jaccard_sql('a.chars', 'b.chars')} >= 0.6 OR (least(length(a.core), length(b.core)) >= 6 AND (contains(a.core, b.core) OR contains(b.core, a.core))))),
{greedy_sql('t', 't_nodes', 't_pairs')}, t_out AS (SELECT seq FROM t_kept UNION ALL SELECT seq FROM cores WHERE core = '')"""


def _recursive(tail: str) -> str:
    return with_news(tail).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(f", {_by_event('news')} SELECT seq FROM e_kept"))
def dedup_by_event(spark, sf_dir):
    """Greedy over shared stocks and facts."""
    return dedup.first_of_events(V.news(spark, sf_dir)).select("seq")


@query(_recursive(f", {_by_title('news')} SELECT seq FROM t_out"))
def dedup_by_title(spark, sf_dir):
    return dedup.first_of_titles(V.news(spark, sf_dir)).select("seq")


_SUBJECT = "CASE WHEN influence_scope IN ('market', 'sector') THEN " + cases([(f"contains({TEXT}, {quote(w)})", quote(w)) for w in L.MACRO_SUBJECTS], "NULL") + " END"


@query(_recursive(f""", {_by_event('news')}, one AS MATERIALIZED (SELECT n.* FROM news n JOIN e_kept k ON k.seq = n.seq), {_by_title('one')}, two AS (SELECT n.*, {_SUBJECT} AS subject FROM one n JOIN t_out k ON k.seq = n.seq),
three AS (SELECT *, CASE WHEN category = 'announcement' THEN CASE WHEN len({_STOCKS}) > 0 THEN {_STOCKS}[1] ELSE {_HEAD} END END AS stock FROM (SELECT * FROM two QUALIFY subject IS NULL OR row_number() OVER (PARTITION BY subject ORDER BY seq) <= 2))
SELECT seq FROM three QUALIFY stock IS NULL OR row_number() OVER (PARTITION BY stock ORDER BY seq) <= 2"""))
def display_selection(spark, sf_dir):
    return ranking.for_display(V.news(spark, sf_dir), [F.asc("seq")]).select("seq")


@query()
def rescored_ranks(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    scores = r.where("rank <= 20").select("title", ((F.col("seq") * 7) % 11).cast("double").alias("score")).dropDuplicates(["title"])
    return ranking.rescored(r.drop("rank_score"), scores, as_of(V.AS_OF)).select("seq", "rank", "new_rank", "market_impact_score")


def _signed(spark, sf_dir):
    return events.signed(V.news(spark, sf_dir), F.col("entities"), F.col("affected_sectors"), F.col("influence_scope")).withColumn("direction", F.col("impact_direction"))


def entity_sql(e: str) -> str:
    bare = f"trim(regexp_replace(trim({e}), '[（(][A-Za-z0-9.\\-]+[)）]$', ''))"
    return "CASE " + bare + " " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in L.ENTITY_ALIASES.items()) + f" ELSE {bare} END"


_MINE = f"mine AS (SELECT seq, list_distinct(list_transform(list_concat({_STOCKS}, list_sort(list_distinct(list_transform(entities, lambda e: {entity_sql('e')})))), lambda e: {entity_sql('e')})) AS ents, list_sort(list_distinct(affected_sectors)) AS secs, impact_direction AS dir FROM news)"
_LIVE = f"{V.LOG_SQL}, live AS (SELECT *, list_distinct(list_transform(list_concat(stocks, entities), lambda e: {entity_sql('e')})) AS ents FROM log WHERE t <= {_AT} AND t >= {_AT} - INTERVAL 24 HOUR)"


@query(with_news(f", {_MINE}, {_LIVE} SELECT m.seq, count(l.event_id) AS n FROM mine m LEFT JOIN live l ON list_has_any(m.ents, l.ents) OR len(list_filter(m.secs, lambda s: len(list_filter(l.sectors, lambda o: contains(s, o) OR contains(o, s))) > 0)) > 0 GROUP BY m.seq"))
def topic_saturation(spark, sf_dir):
    return events.topic_counts(_signed(spark, sf_dir), V.event_log(spark, sf_dir), as_of())


def theme_list_sql(t: str) -> str:
    parts = ", ".join(f"CASE WHEN {any_sql(t, words)} THEN {quote(name)} END" for name, words in L.MARKET_THEMES)
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


@query(with_news(f", m AS (SELECT seq, {theme_list_sql(chr(39) + chr(39) + ' || title_n || ' + chr(39) + ' ' + chr(39) + ' || en || ' + chr(39) + ' ' + chr(39) + ' || st')} AS themes FROM (SELECT seq, replace(replace(title, ' ', ''), '…', '') AS title_n, array_to_string(list_sort(list_distinct(list_transform(entities, lambda e: {entity_sql('e')}))), ' ') AS en, array_to_string({_STOCKS}, ' ') AS st FROM news)), {V.LOG_SQL}, live AS (SELECT event_id, {theme_list_sql('title_norm || ' + chr(39) + ' ' + chr(39) + ' || array_to_string(entities, ' + chr(39) + ' ' + chr(39) + ')')} AS themes FROM log WHERE t <= {_AT} AND t >= {_AT} - INTERVAL 24 HOUR) SELECT m.seq, count(l.event_id) AS n FROM m LEFT JOIN live l ON list_has_any(m.themes, l.themes) GROUP BY m.seq"))
def theme_saturation(spark, sf_dir):
    return events.theme_counts(_signed(spark, sf_dir), V.event_log(spark, sf_dir), as_of())


_SIDE = "CASE WHEN dir IN ('bullish', 'mildly_bullish') THEN 1 WHEN dir IN ('bearish', 'mildly_bearish') THEN -1 END"


@query(with_news(f", {_MINE}, {_LIVE.replace('INTERVAL 24 HOUR', 'INTERVAL 48 HOUR')}, o AS (SELECT m.seq, l.event_id FROM (SELECT *, {_SIDE} AS side FROM mine) m JOIN (SELECT *, {_SIDE} AS side, list_distinct(list_transform(list_append(stocks, entities[1]), lambda e: {entity_sql('e')})) AS main FROM live) l ON m.side = -l.side AND list_has_any(m.ents, l.ents) AND (list_has_any(m.ents, list_intersect(l.main, l.ents)) OR len(list_intersect(m.ents, l.ents)) >= 2)) SELECT seq, event_id, row_number() OVER (PARTITION BY seq ORDER BY event_id)::INTEGER AS place FROM o QUALIFY place <= 2"))
def opposite_events(spark, sf_dir):
    return events.opposite_events(_signed(spark, sf_dir), V.event_log(spark, sf_dir), as_of())


@query(with_news(f", {V.LOG_SQL}, live AS (SELECT event_id, list_distinct(list_append(stocks, entities[1])) AS names FROM log WHERE t <= {_AT} AND t >= {_AT} - INTERVAL 48 HOUR), o AS (SELECT n.seq, l.event_id FROM (SELECT seq, {TEXT} AS x FROM news) n JOIN live l ON len(list_filter(l.names, lambda k: contains(n.x, k))) > 0) SELECT seq, event_id, row_number() OVER (PARTITION BY seq ORDER BY event_id)::INTEGER AS place FROM o QUALIFY place <= 3"))
def related_recent(spark, sf_dir):
    return events.related_events(V.news(spark, sf_dir), V.event_log(spark, sf_dir), as_of())


@query(with_news(f", b AS (SELECT seq, category, {straight_sql(CLEAN)} AS hit, market_impact_score AS score FROM news WHERE strptime(published_at, '%Y-%m-%d %H:%M:%S') >= TIMESTAMP '2023-12-31 15:00:00'), n AS (SELECT *, CASE WHEN category = 'signal' THEN row_number() OVER (PARTITION BY category ORDER BY hit DESC, score DESC, seq) END AS i FROM b) SELECT seq, category, hit, score FROM n WHERE coalesce(i, 0) <= 2 ORDER BY hit DESC, score DESC, seq LIMIT 5"))
def brief_top5(spark, sf_dir):
    from .reports import morning_brief

    return morning_brief(V.news(spark, sf_dir).withColumn("score", F.col("market_impact_score")), F.lit("2023-12-31 15:00:00").cast("timestamp"), V.WATCHED).select("seq", "category", "hit", "score")


@query(f"WITH {V.LOG_SQL} SELECT dir, count(*) AS n FROM log WHERE t::DATE = DATE '2024-01-29' GROUP BY dir")
def evening_directions(spark, sf_dir):
    from .reports import evening_review

    return evening_review(V.event_log(spark, sf_dir), F.lit("2024-01-29").cast("date"))[0]


@query(f"WITH {V.LOG_SQL} SELECT sector, count(*) AS n FROM (SELECT " + cases([(any_sql("low", w), quote(k)) for k, w in L.SECTOR_RULES], "raw") + " AS sector FROM (SELECT raw, lower(raw) AS low FROM (SELECT unnest(sectors) AS raw FROM log WHERE t::DATE = DATE '2024-01-29'))) GROUP BY sector ORDER BY n DESC, sector LIMIT 3")
def evening_sectors(spark, sf_dir):
    from .reports import evening_review

    return evening_review(V.event_log(spark, sf_dir), F.lit("2024-01-29").cast("date"))[1]


@query("""SELECT doc_id AS seq, doc_id::INTEGER AS idx, true AS push, 7.5::DOUBLE AS score, '看涨' AS direction, 'sector' AS scope, 'x' AS reason, 'a "quoted" title' AS title FROM documents
UNION ALL SELECT doc_id, 2, false, 3.0, 'neutral', 'stock', '', NULL FROM documents""")
def judge_parse(spark, sf_dir):
    """One row for each object of a judge's answer, broken ones rescued: held against cases in the tests."""
    from ..functions.judge import parsed_judgements

    n = V.news(spark, sf_dir)
    answer = F.concat(F.lit('```json\n[{"idx": '), F.col("seq").cast("string"), F.lit(', "push": true, "score": 7.5, "direction": "看涨", "scope": "sector", "title": "a "quoted" title", "reason": "x"}, {"idx": 2, "push": false, "score": 3}]\n```'))
    return parsed_judgements(n.select("seq", answer.alias("answer")), "answer")


@query()
def rule_judgements(spark, sf_dir):
    from ..functions.judge import rule_judge

    return rule_judge(V.news(spark, sf_dir)).select("seq", "push", "score", "direction", "scope")


@query()
def batch_round(spark, sf_dir):
    """One whole round: duplicates, what was seen, candidates, judgement, groups, gates."""
    from ..streaming.rounds import round_of

    return round_of(V.news(spark, sf_dir), V.event_log(spark, sf_dir), as_of(V.AS_OF), V.WATCHED)


def _rounds(spark, sf_dir):
    """All news, judged and signed, in rounds of 40 rows."""
    n = _signed(spark, sf_dir)
    judged = {"round": F.floor(F.col("seq") / 40), "place": F.col("seq"), "push": F.col("seq") % 3 > 0, "score": F.col("market_impact_score"), "pref_score": (F.col("seq") % 7) / 7, "scope": F.col("influence_scope"), "judged": F.col("seq") % 11 > 0}
    return n.withColumns(judged)


@query()
def growing_events(spark, sf_dir):
    """The events of each round of 40 rows: a row joins the first whose signature, grown by all rows before it, is like its own."""
    from ..streaming.folds import grown_groups

    return grown_groups(_rounds(spark, sf_dir).select("round", "place", "seq", "sig"), by=("round",))


@query()
def admitted_events(spark, sf_dir):
    """What goes out of each round of 40 rows, row by row: each sees what its round sent before it."""
    from ..streaming.rounds import gated, representatives

    by = ("round",)
    best = representatives(_rounds(spark, sf_dir), by, "place")
    return gated(stored(best), V.event_log(spark, sf_dir), as_of(), V.WATCHED, mode="loose", by=by, order="place", daily_limit=400).select("round", "group", "seq", "gate", "exempt")


@query()
def stateful_rounds(spark, sf_dir):
    """Two rounds in a row with state between them: the second has the first one's rows again, and new ones."""
    import uuid

    from ..streaming.stateful import StateStore, stateful_round

    news = V.news(spark, sf_dir)
    store = StateStore(spark, f"{shared_folder(spark)}/tidemark-state/{uuid.uuid4().hex}")
    first = stateful_round(news.where("seq % 2 = 0"), store, as_of(V.AS_OF), 1, V.WATCHED)
    second = stateful_round(news, store, as_of(V.AS_OF), 2, V.WATCHED)
    return first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
