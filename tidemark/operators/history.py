"""Histories of several sources that must not be mixed, and today's bar before it is final.

A history has one source and one unit of its amounts. New rows are appended where they come from the same source in
the same unit; else the whole history is rebuilt from the source that can be used now. All codes are decided at
once, by one row for each code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import stored
from ..functions.text import bound

#: What the amounts of a source count.
AMOUNT_UNITS = {"sina_volume": "shares", "tencent_volume": "hands", "eastmoney_hist": "yuan", "eastmoney_push2his": "yuan", "eastmoney_push2his_akshare": "yuan"}
#: Fields of a quote, from 0.
PRICE, HIGH, LOW, HANDS, YUAN = 3, 33, 34, 36, 37


def amount_unit(source: Column) -> Column:
    """What a source's amounts count; unknown for one that is not known, which is never appended to."""
    known = F.create_map(*[F.lit(x) for pair in AMOUNT_UNITS.items() for x in pair])
    return F.coalesce(known[F.trim(F.coalesce(source, F.lit("")))], F.lit("unknown"))


def fresh_since(workdays: DataFrame, today: Column, most_lag: int = 3) -> DataFrame:
    """One row, `since`: a history that ends on it or later is at most `most_lag` workdays behind today. The calendar is bounded."""
    return workdays.where(F.col("day") <= today).orderBy(F.desc("day")).limit(most_lag + 1).agg(F.coalesce(F.min("day"), F.lit("0001-01-01").cast("date")).alias("since"))


def sound_row() -> Column:
    """Whether a landed row has a date, a finite close over 0 and a finite amount of 0 or more."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    close, amount = F.col("close").cast("double"), F.col("amount").cast("double")
    return F.coalesce(F.col("date").isNotNull() & finite(close) & finite(amount) & (close > 0) & (amount >= 0), F.lit(False))


def chosen_frames(landed: DataFrame, since: DataFrame, today: Column, parts: dict[str, Column]) -> DataFrame:
    """code, and for each part of its rows (a test) the priority and the source of the first source that can be used there: every row of the part sound, and its end fresh.

    landed: code, priority, source, date, close, amount. A source with one unsound row in a part is out as a whole
    there. The rows are read once for all parts, and are added up before they move.
    """
    ends = [[F.bool_and(F.when(test, sound_row())).alias(f"{n}_sound"), F.max(F.when(test, F.col("date"))).alias(f"{n}_last")] for n, test in parts.items()]
    sources = landed.groupBy("code", "priority").agg(F.max("source").alias("source"), *[c for pair in ends for c in pair]).crossJoin(F.broadcast(since))
    fit = lambda n: F.col(f"{n}_sound") & F.col(f"{n}_last").between(F.col("since"), today) & F.col("priority").isNotNull()
    best = sources.groupBy("code").agg(*[F.min(F.when(fit(n), F.struct("priority", "source"))).alias(n) for n in parts])
    return best.select("code", *[F.col(f"{n}.{c}").alias(alias) for n in parts for c, alias in (("priority", n), ("source", f"{n}_source"))])


def index_history(cached: DataFrame, feeds: DataFrame, workdays: DataFrame, today: Column, start: Column, most_lag: int = 3) -> DataFrame:
    """code, date, close, amount, source, unit and action of each code's history from `start` on.

    cached: code, date, close, amount, source (null where it was not written down). feeds: the landed rows of all
    sources (code, priority, source, date, close, amount). Actions: `append` new rows where source and unit are the
    cached ones and the unit is known; `rebuild` from the whole feed where they are not, or the source is not known;
    `keep` where no new rows can be used; `new` where nothing is cached. A code whose history then ends more than
    `most_lag` workdays ago gives nothing.
    """
    since = fresh_since(workdays, today, most_lag)
    last = stored(cached.groupBy("code").agg(F.max("date").alias("last"), F.max("source").alias("had")))
    landed = feeds.where((F.col("date") <= today) | F.col("date").isNull())
    undated = F.col("date").isNull()
    later, whole = F.col("cached") & (undated | (F.col("date") > F.col("last"))), undated | (F.col("date") >= start)
    chosen = chosen_frames(landed.join(last.select("code", "last", F.lit(True).alias("cached")), "code", "left"), since, today, {"more": later, "all": whole})
    plan = last.join(chosen, "code", "full")
    had, more = F.col("had"), F.col("more_source")
    same = (more == had) & (amount_unit(more) == amount_unit(had)) & (amount_unit(had) != "unknown")
    action = (
        F.when(F.col("last").isNull(), F.when(F.col("all").isNotNull(), "new")).when(F.col("last") >= today, "keep")
        .when(F.col("more").isNotNull() & F.coalesce(same, F.lit(False)), "append")
        .when((F.col("more").isNotNull() | had.isNull()) & F.col("all").isNotNull(), "rebuild").otherwise("keep")
    )
    plan = stored(plan.withColumn("action", action).where("action IS NOT NULL"))
    kept = cached.join(plan.where("action IN ('keep', 'append')").select("code", "action"), "code").select("code", "date", "close", "amount", "source", "action")
    taken = plan.where("action <> 'keep'").select("code", "action", "last", F.when(F.col("action") == "append", F.col("more")).otherwise(F.col("all")).alias("priority"))
    fetched = landed.join(taken, ["code", "priority"]).where(F.when(F.col("action") == "append", undated | (F.col("date") > F.col("last"))).otherwise(whole)).select("code", "date", "close", "amount", "source", "action")
    # one row for each date: of repeated ones the largest
    once = kept.unionByName(fetched).groupBy("code", "date").agg(F.max(F.struct("close", "amount", "source", "action")).alias("r")).select("code", "date", "r.*")
    # the end of a code's history is found from its parts, so that `once` is made once
    fresh = kept.unionByName(fetched).groupBy("code").agg(F.max("date").alias("end")).crossJoin(F.broadcast(since)).where(F.col("end").between(F.col("since"), today)).select("code")
    return once.join(fresh, "code", "left_semi").where(F.col("date") >= start).withColumn("unit", amount_unit(F.col("source")))


def quoted_bar(line: Column) -> Column:
    """close, high, low, amount (shares) and amount_yuan of a quote, fields parted by `~`; null where price or volume are no good.

    high and low are given where the price lies between them.
    """

    def number(fields: Column, i: int) -> Column:
        return bound(F.get(fields, F.lit(i)).try_cast("double"), lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))

    def bar(q: Column) -> Column:
        inside = (q["low"] > 0) & (q["high"] >= q["price"]) & (q["price"] >= q["low"])
        made = F.struct(q["price"].alias("close"), F.when(inside, q["high"]).alias("high"), F.when(inside, q["low"]).alias("low"), (q["hands"] * 100.0).alias("amount"), F.when(q["yuan"] >= 0, q["yuan"]).alias("amount_yuan"))
        return F.when((q["fields"] > HANDS) & (q["price"] > 0) & (q["hands"] >= 0), made)

    places = {"price": PRICE, "high": HIGH, "low": LOW, "hands": HANDS, "yuan": YUAN}
    # a line is split once, and each number is read once
    return bound(F.split(line, "~"), lambda fields: bound(F.struct(F.size(fields).alias("fields"), *[number(fields, i).alias(n) for n, i in places.items()]), bar))


def intraday_bars(quotes: DataFrame, late: str | None = None) -> DataFrame:
    """code, date, at and the bar of each code's last good quote of a day. quotes: code, at, line; also a stream, with its watermark `late`."""
    rows = quotes.withWatermark("at", late) if late else quotes
    # exploded, not filtered: a filter would make the bar a second time
    good = rows.select("code", "at", F.explode(F.array_compact(F.array(quoted_bar(F.col("line"))))).alias("bar"))
    last = F.max(F.struct("at", "bar")).alias("last")
    days = good.groupBy("code", F.window("at", "1 day").alias("day")).agg(last) if late else good.groupBy("code", F.to_date("at").alias("date")).agg(last)
    date = F.to_date("day.start") if late else F.col("date")
    return days.select("code", date.alias("date"), "last.at", "last.bar.*")


def newer_bars(known: DataFrame, bars: DataFrame) -> DataFrame:
    """Provisional bars of two tables: of each code and date the one quoted last."""
    names = [c for c in known.columns if c not in ("code", "date")]
    best = F.max(F.struct("at", *[c for c in names if c != "at"])).alias("r")
    return known.unionByName(bars).groupBy("code", "date").agg(best).select("code", "date", "r.*")


def with_provisional(final: DataFrame, bars: DataFrame) -> DataFrame:
    """Final rows (code, date, close, amount) with a provisional one for each later date of a code; a final row always wins."""
    ends = final.groupBy("code").agg(F.max("date").alias("end"))
    ahead = bars.join(ends, "code", "left").where(F.col("end").isNull() | (F.col("date") > F.col("end")))
    return final.select("code", "date", "close", "amount", F.lit(False).alias("provisional")).unionByName(ahead.select("code", "date", "close", "amount", F.lit(True).alias("provisional")))


def universe(members: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """index, code (six digits) and name of each index's members as its last landed list has them; a list is good for `days`.

    members: index, code, name, loaded (a date). Of a code that is listed twice the least name stays.
    """
    live = members.where((F.col("loaded") <= as_of) & (F.date_diff(as_of, F.col("loaded")) <= days))
    last = live.groupBy("index").agg(F.max("loaded").alias("loaded"))
    code = F.col("code").cast("string")
    six = F.when(F.char_length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)
    return live.join(last, ["index", "loaded"], "left_semi").groupBy("index", six.alias("code")).agg(F.min("name").alias("name"))
