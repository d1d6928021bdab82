"""Ranking, caps for each key, quotas and selections. Every order ends in seq, so it is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import stored
from ..functions import gates, scoring
from ..functions import lexicons as L
from ..functions.signatures import titled_stocks
from ..functions.text import any_of, bound, characters, jaccard, text_of, without
from ..functions.times import freshness
from . import dedup

ROW = ("title", "content", "name", "source", "category", "impact_direction", "market_impact_score", "cluster_weight", "affected_stocks", "affected_sectors", "influence_scope")


def scored(news: DataFrame, as_of: Column, watched: tuple[str, ...] = (), constituents: Column | None = None) -> DataFrame:
    """news with time_factor, total_score, impact_band, band_priority and influence_scope."""
    row = {n: F.col(n) for n in ROW}
    fresh = freshness(F.col("published_at"), as_of)
    weight = F.when(F.col("confidence") == "high", 1.0).when(F.coalesce("confidence", F.lit("medium")) == "medium", 0.9).when(F.col("confidence") == "low", 0.7).otherwise(0.85)
    band = F.coalesce("impact_band", F.lit("neutral"))
    band = F.when(scoring.band_conflicts(band, F.col("impact_direction")), scoring.milder_band(band)).otherwise(band)
    out = news.withColumn("time_factor", fresh).withColumn("total_score", scoring.rounded(scoring.continuous_score(row, F.col("time_factor"), watched, constituents) * weight))
    return out.withColumn("influence_scope", scoring.scope_of(row, constituents)).withColumn("impact_band", band).withColumn("band_priority", scoring.band_priority(F.col("impact_band")))


def ranked(news: DataFrame, as_of: Column, watched: tuple[str, ...] = (), constituents: Column | None = None) -> DataFrame:
    """scored news in order: band, score with the scope's boost, freshness. Sorting is by range, over all tasks."""
    boost = F.when(F.col("influence_scope") == "market", 0.20).when(F.col("influence_scope") == "stock", -0.05).otherwise(0.0)
    return scored(news, as_of, watched, constituents).withColumn("rank_score", F.round(F.col("total_score") + boost, 4)).orderBy(F.desc("band_priority"), F.desc("rank_score"), F.desc("time_factor"), "seq")


def first_of_each(rows: DataFrame, key: Column, order: list, most: int) -> DataFrame:
    """At most `most` rows of each key, in order; rows without a key all stay.

    Each task keeps its own first rows of a key before any row moves (the window group limit), so a key that
    many rows share is no burden.
    """
    keyed = rows.withColumn("_key", key)
    numbered = keyed.where(F.col("_key").isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where(F.col("_n") <= most)
    return keyed.where(F.col("_key").isNull()).drop("_key").unionByName(numbered.drop("_key", "_n"))


def cap_per_stock(rows: DataFrame, order: list, most: int = 2) -> DataFrame:
    """Announcements only; a stock's key is its first name, or what stands before the title's colon."""
    key = F.when(F.col("category") == "announcement", F.array_min(titled_stocks(F.col("affected_stocks"), F.col("name"), F.col("title"))))
    return first_of_each(rows, key, order, most)


def cap_per_subject(rows: DataFrame, order: list, most: int = 2) -> DataFrame:
    """Market and sector news only, by the first macro subject in the list's order."""
    key = F.when(F.col("influence_scope").isin("market", "sector"), scoring.macro_subject(F.col("title"), F.col("content")))
    return first_of_each(rows, key, order, most)


def for_display(rows: DataFrame, order: list, per_stock: int = 2, per_subject: int = 2) -> DataFrame:
    """Event and title duplicates out, then both caps. seq must be the rank."""
    return cap_per_stock(cap_per_subject(dedup.first_of_titles(dedup.first_of_events(rows)), order, per_subject), order, per_stock)


def quota(direct: Column, sector: Column, macro: Column, total: int = 20, least_sector: int = 6, least_macro: int = 4) -> Column:
    """How many rows of each bucket are taken. Shares are rounded half to even; places that are left go to direct, null is no limit."""
    floor = least_sector + least_macro
    cut = direct > total - floor
    left = F.when(cut, F.lit(floor)).otherwise(F.greatest(F.lit(total) - direct, F.lit(floor)))
    others = sector + macro
    share = F.bround(left * sector / F.when(others > 0, others)).cast("int")
    part = F.greatest(F.least(share, sector), F.least(F.lit(least_sector), sector))
    rest = left - part
    s = F.when(others == 0, 0).when(others <= left, sector).otherwise(part)
    m = F.when(others == 0, 0).when(others <= left, macro).otherwise(F.greatest(F.least(rest, macro), F.least(F.lit(least_macro), macro)))
    d = F.when(cut, F.lit(total - floor) + F.greatest(F.lit(0), F.lit(total - (total - floor)) - s - m))
    return F.struct(d.cast("int").alias("direct"), s.cast("int").alias("sector"), m.cast("int").alias("macro"))


def take_by_quota(rows: DataFrame, total: int = 20) -> DataFrame:
    """rows with bucket and score, as many of each bucket as its quota says, and no more than `total`."""
    counts = rows.agg(*[F.count(F.when(F.col("bucket") == b, 1)).alias(b) for b in ("direct", "sector", "macro")])
    limits = counts.select(quota(F.col("direct"), F.col("sector"), F.col("macro"), total).alias("q")).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("direct", "sector", "macro"))), F.array("q.direct", "q.sector", "q.macro"))).alias("bucket", "most"))
    # no more than `total` rows are taken, so no bucket sends on more than that
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("score"), "seq"))).where(F.col("_n") <= total)
    kept = best.join(F.broadcast(limits), "bucket").where(F.col("most").isNull() | (F.col("_n") <= F.col("most"))).drop("_n", "most")
    return kept.orderBy(F.desc("score"), "seq").limit(total)


def is_self_only(title: Column, content: Column, name: Column, code: Column, category: Column) -> Column:
    """Whether a row speaks of one stock alone, and none that leads: such rows are left out before judging."""
    name, code = F.coalesce(name, F.lit("")), F.coalesce(code, F.lit(""))
    text = without(text_of(title, content), name)
    leads = name.isin(*L.LEADER_NAMES) | code.isin(*L.LEADER_CODES) | any_of(text, L.LEADER_NAMES)
    specific = (name != "") | (code != "") | text.rlike("(?<![0-9])[0-9]{6}(?![0-9])")
    return (category != "announcement") & ~leads & specific & ~any_of(text, (*L.SECTOR_WORDS, *L.MACRO_NEWS_WORDS))


def is_high_impact(title: Column, content: Column) -> Column:
    return any_of(text_of(title, content), L.HIGH_IMPACT_ANNOUNCEMENTS)


def leads_or_matters(title: Column, content: Column, name: Column, code: Column, constituents: Column | None = None) -> Column:
    """High-impact announcements, index members and leaders; with no members known, all."""
    member = F.lit(True) if constituents is None else F.when(F.size(constituents) == 0, True).otherwise(F.array_contains(constituents, F.coalesce(name, F.lit(""))))
    return is_high_impact(title, content) | member | F.lpad(F.trim(F.coalesce(code, F.lit(""))), 6, "0").isin(*L.LEADER_CODES) | F.coalesce(name, F.lit("")).isin(*L.LEADER_NAMES)


def before_judging(news: DataFrame, total: int = 20, constituents: Column | None = None) -> DataFrame:
    """The rows that are judged: relevant, with a link to technology or markets, not of one stock alone, by quota, with their cluster weight."""
    t, c, n, code, cat = (F.col(x) for x in ("title", "content", "name", "code", "category"))
    r = scoring.relevance(t, c, F.col("url"), F.col("source"))
    text = text_of(t, c)
    linked = scoring.is_tech(text) | any_of(text, L.TECH_SECTOR_TERMS) | any_of(text, L.CORE_TRANSMISSION)
    fit = news.where((cat != "announcement") | leads_or_matters(t, c, n, code, constituents)).withColumn("_r", r).withColumn("score", F.col("_r.score")).withColumn("bucket", F.col("_r.category")).drop("_r")
    # counted and then ranked: stored, so that the texts are searched once
    kept = take_by_quota(stored(fit.where((F.col("score") > 0) & linked & ~is_self_only(t, c, n, code, cat))), total)
    return cluster_weights(kept)


def cluster_weights(kept: DataFrame, above: float = 0.35, most: int = 10) -> DataFrame:
    """How many other titles have a character similarity over `above`. For the few rows of one selection: at most `total` of them."""
    titles = kept.select("seq", characters(F.col("title")).alias("chars"))
    a, b = (titles.select(F.col("seq").alias(n), F.col("chars").alias(f"c{n}")) for n in "ab")
    near = a.join(F.broadcast(b), F.col("a") != F.col("b")).where(jaccard(F.col("ca"), F.col("cb")) > above).groupBy(F.col("a").alias("seq")).agg(F.count(F.lit(1)).alias("n"))
    return kept.drop("cluster_weight").join(near, "seq", "left").withColumn("cluster_weight", F.least(F.coalesce("n", F.lit(0)), F.lit(most)).cast("double")).drop("n")


def passing(news: DataFrame, watched: tuple[str, ...] = (), least_score: float = 0.55) -> DataFrame:
    """The rows that may go to the judge, with pref_score, hit, released, relevance, truncated and quality."""
    t, c, n = F.col("title"), F.col("content"), F.col("name")
    text = without(text_of(t, c), n)
    pref = scoring.importance(t, c, n, F.col("category"), F.col("impact_direction"), F.col("source"), F.col("affected_sectors"), F.col("affected_stocks"))
    # both are found once for each row, and what does not pass makes no row
    judged = bound(F.struct(pref.alias("pref_score"), gates.goes_straight(text, watched).alias("hit")), lambda s: F.when((s["pref_score"] >= least_score) | s["hit"], F.array(s)))
    rows = news.select("*", F.explode(judged).alias("_judged")).select(*news.columns, "_judged.pref_score", "_judged.hit")
    return rows.withColumn("released", gates.is_macro_release(text_of(t, c))).withColumn("relevance", scoring.relevance_bonus(t, c, watched)).withColumn("truncated", gates.is_truncated(t)).withColumn("quality", gates.headline_quality(t, n, F.col("affected_stocks")))


def first_candidates(passed: DataFrame, most: int = 40) -> DataFrame:
    """The first `most` of them, with their place: direct ones, releases, relevance, whole titles, quality, score."""
    order = [F.desc("hit"), F.desc("released"), F.desc("relevance"), F.asc("truncated"), F.desc("quality"), F.desc("pref_score"), F.asc("seq")]
    return passed.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def candidates(news: DataFrame, watched: tuple[str, ...] = (), most: int = 40, least_score: float = 0.55) -> DataFrame:
    """The rows that go to the judge, at most `most`, with pref_score, hit, released, relevance, truncated and quality."""
    return first_candidates(passing(news, watched, least_score), most)


def rescored(rows: DataFrame, scores: DataFrame, as_of: Column, top: int = 20) -> DataFrame:
    """New impact scores by title for the first `top` ranks, put in order within band and scope; groups keep the order of their first row."""
    head = rows.where(F.col("rank") <= top).join(scores.select(F.trim("title").alias("_t"), F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("score"))).alias("_s")), F.trim("title") == F.col("_t"), "left")
    head = head.withColumn("market_impact_score", F.coalesce("_s", "market_impact_score")).drop("_t", "_s")
    again = scored(head.drop("time_factor", "total_score", "band_priority"), as_of)
    group = Window.partitionBy("impact_band", "influence_scope")
    placed = again.withColumn("_g", F.min("rank").over(group)).withColumn("_w", F.row_number().over(group.orderBy(F.desc("total_score"), F.desc("time_factor"), "rank")))
    return placed.withColumn("new_rank", F.row_number().over(Window.orderBy("_g", "_w"))).drop("_g", "_w")
