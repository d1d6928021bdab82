"""News, feeds and logs made from the test tables, in both engines.

The tables hold invented prose without finance words, so headlines, sources and labels that the word lists
know are dealt out by the row's number. Texts stay whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql import pick

AS_OF = "2024-01-01 20:00:00"
STATE_AS_OF = "2024-01-30 00:00:00"

HEADLINES = (
    "央行宣布降准0.5个百分点 释放长期资金1.2万亿", "某公司：签订30.53亿元算力服务合同", "半导体板块大涨 创历史新高", "美联储官员称可能加息", "日本央行考虑9月加息", "午评：沪指半日跌0.8%", "中际旭创：关于回购股份的公告",
    "寒武纪股权激励计划草案披露", "宁德时代中标200亿储能订单", "美国7月CPI同比公布 符合预期", "欧洲央行宣布维持利率不变", "PCB概念表现活跃 方邦股份涨超10%", "隔夜要闻汇总", "局势跟踪：以色列空袭", "某药企nAMD新药获批",
    "AMD发布新款服务器芯片", "证监会立案调查某公司", "*ST海医申请撤销退市风险警示", "机构看好光模块前景 有望受益", "原油暴跌 地缘冲突升级", "放宽稀土出口管制", "取消增持计划", "未能否认业绩预增", "公司30周年庆典举行", "疯涨！彻底慌了",
    "龙虎榜：机构净买入3.2亿", "业绩预告：净利润幅度+1200%", "台积电第三代HBM3E量产 良率98%", "美债收益率升至4.75%", "纳指涨超2% 英伟达领涨", "特朗普宣布对加拿大加征关税", "伊朗制裁升级", "STMicroelectronics财报超预期", "DUBAI旅游旺季来临", "国常会部署人工智能产业政策",
    "存储芯片涨价 SK海力士扩产", "恩智浦洽谈收购Ambarella", "长鑫科技回购完成 注销股份", "工厂罢工停产…", "【现货黄金日内跌幅扩大至2%】",
)
BODIES = (
    "公司表示业绩预增。其他股票下跌", "受益于新能源和储能需求", "国务院提出财政政策", "行业龙头产业链受益", "北向资金净流入12.5亿", "监管处罚与警示函", "外资机构调研 目标价上调", "算力服务器液冷需求大增", "并购重组计划终止", "美股走低 纳指下挫", "良率98% 产能翻倍", "合同金额5亿元，另有3.10万", "贸易战与出口管制风险",
)
SOURCES = ("财联社电报", "新浪财经", "央视新闻", "富途牛牛", "金十数据", "证券时报网", "某研究所", "上海证券交易所", "交易所龙虎榜", "", "Reuters", "不知名站点")
NAMES = ("中际旭创", "寒武纪", "某公司", "宁德时代", "方邦股份", "海医", "长鑫存储", "贵州茅台")
ENTITIES = ("日本央行", "美联储", "Fed", "英伟达", "NVIDIA", "台积电(TSM.N)", "伊朗", "加拿大", "SK Hynix", "大摩")
SECTORS = ("半导体", "AI算力", "算力", "CPO", "新能源", "宏观", "半导体/存储芯片", "港股")
DIRECTIONS = ("bullish", "neutral", "bearish", "neutral", "mixed")
BANDS = ("bullish", "mildly_bullish", "neutral", "mixed", "mildly_bearish", "bearish")
CONFIDENCE = ("high", "medium", "low", "unknown")
SCOPES = ("", "market", "sector", "stock")
WATCHED = ("中际旭创", "方邦股份")
MEMBERS = ("宁德时代", "贵州茅台", "中际旭创")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(words: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, words)), (1 + index % len(words)).cast("int"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    head = F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 30)
    stocks = F.when(i % 5 == 0, F.array(_pick(NAMES, i), _pick(NAMES, F.floor(i / 7)))).otherwise(F.array().cast("array<string>"))
    sectors = F.when(i % 3 == 0, F.array(_pick(SECTORS, i))).when(i % 7 == 1, F.array(_pick(SECTORS, i), _pick(SECTORS, i + 1), _pick(SECTORS, i + 2))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select(
        i.alias("seq"), F.concat(_pick(HEADLINES, i), F.when(i % 3 == 0, F.concat(F.lit(" "), head)).otherwise("")).alias("title"), F.concat(_pick(BODIES, F.floor(i / 3)), F.lit(" "), F.coalesce("text", F.lit(""))).alias("content"),
        _pick(SOURCES, i).alias("source"), F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + i * 60), "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        F.concat(F.lit("https://www.Example.com/a/"), (i % 400).cast("string"), F.lit("?id="), i.cast("string")).alias("url"),
        F.when(i % 10 < 2, "announcement").when(i % 10 == 2, "signal").otherwise("news").alias("category"), F.when(i % 4 == 0, _pick(NAMES, i)).otherwise("").alias("name"), F.when(i % 9 == 0, "688256").otherwise("").alias("code"),
        _pick(DIRECTIONS, i).alias("impact_direction"), _pick(BANDS, i).alias("impact_band"), _pick(CONFIDENCE, i).alias("confidence"), _pick(SCOPES, F.floor(i / 2)).alias("influence_scope"),
        ((i % 101) / 10).alias("market_impact_score"), sectors.alias("affected_sectors"), stocks.alias("affected_stocks"), (i % 5).cast("double").alias("cluster_weight"),
        F.array(_pick(ENTITIES, i), _pick(ENTITIES, F.floor(i / 3))).alias("entities"),
    )


NEWS_SQL = f"""
news AS (
  SELECT i AS seq,
    {pick(HEADLINES, 'i')} || CASE WHEN i % 3 = 0 THEN ' ' || substr(split_part(coalesce(text, ''), chr(10), 1), 1, 30) ELSE '' END AS title,
    {pick(BODIES, 'i // 3')} || ' ' || coalesce(text, '') AS content, {pick(SOURCES, 'i')} AS source,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(i), '%Y-%m-%d %H:%M:%S') AS published_at,
    'https://www.Example.com/a/' || (i % 400) || '?id=' || i AS url,
    CASE WHEN i % 10 < 2 THEN 'announcement' WHEN i % 10 = 2 THEN 'signal' ELSE 'news' END AS category,
    CASE WHEN i % 4 = 0 THEN {pick(NAMES, 'i')} ELSE '' END AS name, CASE WHEN i % 9 = 0 THEN '688256' ELSE '' END AS code,
    {pick(DIRECTIONS, 'i')} AS impact_direction, {pick(BANDS, 'i')} AS impact_band, {pick(CONFIDENCE, 'i')} AS confidence, {pick(SCOPES, 'i // 2')} AS influence_scope,
    (i % 101) / 10 AS market_impact_score,
    CASE WHEN i % 3 = 0 THEN [{pick(SECTORS, 'i')}] WHEN i % 7 = 1 THEN [{pick(SECTORS, 'i')}, {pick(SECTORS, 'i + 1')}, {pick(SECTORS, 'i + 2')}] ELSE []::VARCHAR[] END AS affected_sectors,
    CASE WHEN i % 5 = 0 THEN [{pick(NAMES, 'i')}, {pick(NAMES, 'i // 7')}] ELSE []::VARCHAR[] END AS affected_stocks,
    (i % 5)::DOUBLE AS cluster_weight, [{pick(ENTITIES, 'i')}, {pick(ENTITIES, 'i // 3')}] AS entities
  FROM (SELECT doc_id AS i, text FROM documents))
"""


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("fp"), F.col("ts").cast("timestamp").alias("t"), (F.col("event_type") == "purchase").alias("pushed"), F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("title"))


SEEN_SQL = "seen AS (SELECT 'f' || event_id AS fp, ts AS t, event_type = 'purchase' AS pushed, event_type || ' ' || user_id AS title FROM events)"


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')")
    title = F.concat(F.when(F.col("user_id") % 3 == 0, "回购 ").otherwise("普通 "), F.col("event_id").cast("string"))
    return e.select(F.concat(F.lit("f"), F.floor(F.col("event_id") / 2).cast("string"), F.lit("p"), (F.col("event_id") % 2).cast("string")).alias("fp"), F.col("ts").cast("timestamp").alias("t"), (F.col("user_id") % 12).cast("int").alias("retry"), title.alias("title"), F.when(F.col("event_id") % 4 > 0, F.col("props")).alias("payload"))


PENDING_SQL = """pending AS (SELECT 'f' || (event_id // 2) || 'p' || (event_id % 2) AS fp, ts AS t, (user_id % 12)::INTEGER AS retry,
  CASE WHEN user_id % 3 = 0 THEN '回购 ' ELSE '普通 ' END || event_id AS title, CASE WHEN event_id % 4 > 0 THEN props END AS payload FROM events WHERE event_type IN ('view', 'click'))"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sent events: one for each row of events, with a signature."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events")
    none = F.array().cast("array<string>")
    sig = F.struct(
        F.when(i % 4 == 0, F.array(_pick(NAMES, i))).otherwise(none).alias("stocks"), F.array(_pick(ENTITIES, F.floor(i / 2)), _pick(ENTITIES, i + 3)).alias("entities"), none.alias("events"), none.alias("numbers"),
        F.when(i % 3 == 0, F.array(_pick(SECTORS, i))).otherwise(none).alias("sectors"), F.lit("stock").alias("scope"), _pick(HEADLINES, i).alias("title_norm"),
    )
    return e.select(i.alias("event_id"), F.col("ts").cast("timestamp").alias("t"), _pick(DIRECTIONS, F.floor(i / 5)).alias("dir"), sig.alias("sig"), (i % 6 == 0).alias("exempt"))


LOG_SQL = f"""
log AS (
  SELECT i AS event_id, ts AS t, {pick(DIRECTIONS, 'i // 5')} AS dir, CASE WHEN i % 4 = 0 THEN [{pick(NAMES, 'i')}] ELSE []::VARCHAR[] END AS stocks,
    [{pick(ENTITIES, 'i // 2')}, {pick(ENTITIES, 'i + 3')}] AS entities, CASE WHEN i % 3 = 0 THEN [{pick(SECTORS, 'i')}] ELSE []::VARCHAR[] END AS sectors, {pick(HEADLINES, 'i')} AS title_norm, i % 6 = 0 AS exempt
  FROM (SELECT event_id AS i, ts FROM events))
"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.market import daily_bars

    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return daily_bars(li, "l_suppkey", "l_shipdate", ["l_orderkey", "l_linenumber"], price, F.col("l_quantity"), F.col("l_extendedprice"))


BARS_SQL = """
bars AS (
  SELECT l_shipdate::DATE AS date, l_suppkey AS code, arg_min(p, (l_orderkey, l_linenumber)) AS open, max(p) AS high, min(p) AS low, arg_max(p, (l_orderkey, l_linenumber)) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2)
"""


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows fetched by source (a user) and round (a day of the month), empty rounds included."""
    e = table(spark, sf_dir, "events")
    per = e.groupBy(F.col("user_id").alias("source"), F.dayofmonth("ts").alias("round")).agg(F.count(F.lit(1)).alias("count"))
    grid = e.select(F.col("user_id").alias("source")).distinct().select("source", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("round"))
    return grid.join(per, ["source", "round"], "left").select("source", "round", F.coalesce(F.when(F.col("source") % 3 > 0, F.col("count")).when(F.col("round") % 11 == 0, F.col("count")), F.lit(0)).alias("count"))


ROUNDS_SQL = """
rounds AS (
  SELECT g.source, g.round, coalesce(CASE WHEN g.source % 3 > 0 THEN p.n WHEN g.round % 11 = 0 THEN p.n END, 0) AS count
  FROM (SELECT source, unnest(range(1, 31)) AS round FROM (SELECT DISTINCT user_id AS source FROM events)) g
  LEFT JOIN (SELECT user_id AS source, day(ts) AS round, count(*) AS n FROM events GROUP BY 1, 2) p ON g.source = p.source AND g.round = p.round)
"""
