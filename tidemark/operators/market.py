"""Bars, returns and event studies. Panels stay long: one row for each date and code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import numbered, stored


def daily_bars(trades: DataFrame, code: str, day: str, at: list[str], price: Column, quantity: Column, amount: Column) -> DataFrame:
    """date, code, open, high, low, close, volume and amount of each day's trades in the order of `at`."""
    order = F.struct(*at)
    return trades.groupBy(F.to_date(day).alias("date"), F.col(code).alias("code")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(quantity).alias("volume"), F.sum(amount).alias("amount")
    )


def latest_bars(stored_bars: DataFrame, loaded: DataFrame) -> DataFrame:
    """Appended history in which a date's later load wins; `load` says which."""
    both = stored_bars.unionByName(loaded)
    best = both.groupBy("code", "date").agg(F.max("load").alias("load"))
    return both.join(best, ["code", "date", "load"], "left_semi")


def returns(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(Window.partitionBy("code").orderBy("date"))
    return bars.withColumn("ret", F.col("close") / before - 1)


def tradable(bars: DataFrame, window: int = 1) -> DataFrame:
    """Whether a bar has an amount now, and one in the last `window` bars is known."""
    span = Window.partitionBy("code").orderBy("date").rowsBetween(-(window - 1), 0)
    return bars.withColumn("tradable", F.max("amount").over(span).isNotNull() & F.coalesce(F.col("amount") > 0, F.lit(False)))


def forward_returns(closes: DataFrame, horizons: tuple[int, ...] = (1, 3, 5), by: str = "code", at: str = "date") -> DataFrame:
    """fwd_1, fwd_3 ...: from this close to the close so many bars on; null at the end."""
    order = Window.partitionBy(by).orderBy(at)
    return closes.withColumns({f"fwd_{h}": F.lead("close", h).over(order) / F.col("close") - 1 for h in horizons})


def clean_history(bars: DataFrame, least: int = 60) -> DataFrame:
    """The codes whose whole history can be used: every price over 0 and finite, no negative volume, enough bars. A code with one bad bar is out as a whole."""
    sound = lambda c: F.col(c).isNotNull() & (F.col(c) > 0) & (F.col(c) < float("inf"))
    fine = sound("open") & sound("high") & sound("low") & sound("close") & F.coalesce(F.col("volume") >= 0, F.lit(False))
    good = bars.groupBy("code").agg(F.bool_and(fine).alias("fine"), F.count(F.lit(1)).alias("n")).where(F.col("fine") & (F.col("n") >= least)).select("code")
    return bars.join(good, "code", "left_semi")


def first_usable(feeds: DataFrame) -> DataFrame:
    """Of several sources of a code, all bars of the first by priority that is fresh and sound (`usable`)."""
    best = feeds.where("usable").groupBy("code").agg(F.min("priority").alias("priority"))
    return feeds.join(best, ["code", "priority"], "left_semi")


def fresh_codes(bars: DataFrame, today: Column, most_lag: int, workdays: DataFrame) -> DataFrame:
    """code, last and lag (workdays after the last bar, up to today) of the codes that lag no more. The calendar is a table of days: bounded, and broadcast."""
    last = bars.groupBy("code").agg(F.max("date").alias("last"))
    late = last.join(F.broadcast(workdays.where(F.col("day") <= today)), F.col("day") > F.col("last"), "left").groupBy("code", "last").agg(F.count("day").alias("lag"))
    return late.where((F.col("last") <= today) & (F.col("lag") <= most_lag))


def next_day(events: DataFrame, calendar: DataFrame, at: str = "pub") -> DataFrame:
    """events with `day`: the first calendar day on or after the event; events after the last day go.

    A forward as-of join as one window: days and distinct event days in one order, each event day taking the
    next calendar day.
    """
    stamps = events.select(F.to_date(at).alias("d")).where("d IS NOT NULL").distinct().select("d", F.lit(None).cast("date").alias("c"))
    days = calendar.select(F.col("day").alias("d"), F.col("day").alias("c")).distinct()
    # years are handled apart, so that no task holds the whole calendar
    placed = stamps.unionByName(days).withColumn("y", F.year("d"))
    later = days.groupBy(F.year("d").alias("y2")).agg(F.min("d").alias("start"))
    inside = placed.withColumn("n", F.min("c").over(Window.partitionBy("y").orderBy("d").rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    inside = inside.where("c IS NULL").select("d", "y", "n")
    # an event after its year's last day takes the first day of the next year that has one: the years are few
    late = inside.where("n IS NULL").join(F.broadcast(later), F.col("y2") > F.col("y")).groupBy("d").agg(F.min("start").alias("n"))
    found = inside.where("n IS NOT NULL").select("d", "n").unionByName(late)
    return events.join(found.withColumnRenamed("n", "day"), F.to_date(at) == F.col("d")).drop("d")


def day_signals(events: DataFrame, calendar: DataFrame, at: str = "pub", sign: str = "sign") -> DataFrame:
    """day and net: the sum of the signs of the events that fall to it."""
    return next_day(events.where(F.col(sign) != 0), calendar, at).groupBy("day").agg(F.sum(sign).cast("double").alias("net"))


def study(closes: DataFrame, signals: DataFrame, horizons: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """For each horizon, number and mean forward return of days with a signal, without, with a positive and with a negative one. closes: day, close."""
    one = closes.withColumn("all", F.lit(1))
    fwd = forward_returns(one, horizons, "all", "day").join(signals, "day", "left").withColumn("net", F.coalesce("net", F.lit(0.0)))
    long = fwd.select("net", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("r")) for h in horizons])).alias("x")).select("net", "x.horizon", "x.r").where("r IS NOT NULL")
    groups = {"signal": F.col("net") != 0, "none": F.col("net") == 0, "up": F.col("net") > 0, "down": F.col("net") < 0}
    return long.groupBy("horizon").agg(*[f(F.when(test, F.col("r"))).alias(f"{what}_{name}") for name, test in groups.items() for what, f in (("n", F.count), ("mean", F.avg))])


def mean_ranks(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """rows with the mean rank of `value` in its group: equal values share one. Ranks come from counts of distinct values, so ties cost one row."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn(out, below + (F.col("_n") + 1) / 2).drop("_n")
    return rows.join(ranks, [*by, value])


def rank_correlation(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spearman's correlation of x and y in each group, and n."""
    both = mean_ranks(mean_ranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, x, "_rx"), by, y, "_ry")
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("ic"))


def rank_sum_test(rows: DataFrame, by: list[str], value: str, group: str) -> DataFrame:
    """Mann-Whitney U of the rows where `group` is true, with z by the normal approximation without tie correction."""
    ranked = mean_ranks(rows.where(F.col(value).isNotNull()), by, value, "_r")
    sums = ranked.groupBy(*by).agg(F.count(F.when(F.col(group), 1)).alias("n1"), F.count(F.when(~F.col(group), 1)).alias("n2"), F.sum(F.when(F.col(group), F.col("_r"))).alias("r1"))
    n1, n2 = F.col("n1"), F.col("n2")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    return sums.select(*by, "n1", "n2", u.alias("u"), ((u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)).alias("z"))


def buy_signals(rows: DataFrame, least: float, most: int = 15) -> DataFrame:
    """Net buys of at least `least`, one a code, the largest first. rows: seq, code, net."""
    strong = rows.where(F.col("net") >= least)
    best = strong.groupBy("code").agg(F.max_by("seq", F.struct(F.abs("net"), -F.col("seq"))).alias("seq"))
    return strong.join(best, ["code", "seq"], "left_semi").orderBy(F.desc(F.abs("net")), "seq").limit(most)


def forecast_signals(rows: DataFrame, directions: dict[str, str], above: float = 100.0, below: float = -50.0, most: int = 20) -> DataFrame:
    """Forecasts with an amplitude beyond the limits, with their direction by type; one a code, the widest first."""
    named = F.create_map(*[F.lit(x) for pair in directions.items() for x in pair])
    wide = rows.where((F.col("amplitude") > above) | (F.col("amplitude") < below)).withColumn("direction", F.coalesce(F.element_at(named, F.col("kind")), F.lit("neutral")))
    best = wide.groupBy("code").agg(F.max_by("seq", F.struct(F.abs("amplitude"), -F.col("seq"))).alias("seq"))
    return wide.join(best, ["code", "seq"], "left_semi").orderBy(F.desc(F.abs("amplitude")), "seq").limit(most)


def wide_panels(bars: DataFrame, field: str, benchmark: DataFrame, width: int = 400) -> list[tuple[list, DataFrame]]:
    """(codes, panel) for each `width` codes of the bars: date, index_close, and a column of the field for each code, named by it.

    Every panel has the same dates, all those of the bars, in rows that any two of them share by date; a code
    without a bar of a date is null there. benchmark: date, close. Column names are the driver's, so it is sent the
    codes; the bars themselves are pivoted where they lie.
    """
    codes = [r[0] for r in bars.select("code").where("code IS NOT NULL").distinct().orderBy("code").toLocalIterator()]
    dates = bars.select("date").distinct().join(benchmark.select("date", F.col("close").alias("index_close")), "date", "left")
    out = []
    for low in range(0, len(codes), width):
        some = codes[low : low + width]
        # between the least and the largest code of the chunk: a range, not a list of values
        mine = bars.where(F.col("code").between(some[0], some[-1]))
        out.append((some, dates.join(mine.groupBy("date").pivot("code", some).agg(F.max(field)), "date", "left")))
    return out


def panel_blocks(bars: DataFrame, field: str, benchmark: DataFrame, width: int = 64) -> DataFrame:
    """block, date, index_close, codes and values: the panels of `width` codes each as one table, a row for each block and date.

    Every block has the same dates, all those of the bars; values stand in the order of codes, null where a code has
    no bar of a date. One plan for any number of codes: the bars are read as often for many blocks as for one.
    """
    known = stored(bars.where("code IS NOT NULL").groupBy("date", "code").agg(F.max(field).alias("value")))
    places = stored(numbered(known.select("code").distinct(), ["code"], "place").select("code", F.floor((F.col("place") - 1) / width).alias("block")))
    blocks = places.groupBy("block").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    dates = bars.select("date").distinct().join(benchmark.select("date", F.col("close").alias("index_close")), "date", "left")
    cells = known.join(places, "code").groupBy("block", "date").agg(F.map_from_entries(F.collect_list(F.struct("code", "value"))).alias("cells"))
    # the calendar is one row a day
    grid = blocks.repartition("block").crossJoin(F.broadcast(dates))
    values = F.transform("codes", lambda c: F.element_at("cells", c))
    return grid.join(cells, ["block", "date"], "left").select("block", "date", "index_close", "codes", values.alias("values"))


def long_blocks(blocks: DataFrame, field: str) -> DataFrame:
    """date, index_close, code and field of panel_blocks, cells without a value too."""
    given = F.coalesce(F.col("values"), F.transform("codes", lambda c: F.lit(None).cast(blocks.schema["values"].dataType.elementType)))
    return blocks.select("date", "index_close", F.inline(F.arrays_zip(F.col("codes").alias("code"), given.alias(field))))


def long_panel(codes: list, panel: DataFrame, field: str) -> DataFrame:
    """date, index_close, code and field of a wide panel, cells without a value too."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(f"`{c}`").alias(field)) for c in codes])).alias("cell")
    return panel.select("date", "index_close", cells).select("date", "index_close", "cell.*")
