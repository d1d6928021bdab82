"""Two versions of a rule set judged over an archive in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gates
from ..functions import lexicons as L
from ..functions.text import any_of


def archived_reason(title: Column, watched: tuple[str, ...]) -> Column:
    """The noise rule for an archived title, as for a strong row of a sector."""
    empty = F.lit("")
    return gates.noise_reason(title, empty, empty, F.lit(8.0), F.lit("sector"), F.lit(False), watched)


def judged(archive: DataFrame, old: Column, new: Column, watched: tuple[str, ...], title: str = "title") -> DataFrame:
    """archive with old and new (the reason of either version, empty where it lets a row through), watched, deed and wrong.

    A blocked row is called wrong where its title names a watched stock or a deed that has been done.
    """
    t = F.coalesce(title, F.lit(""))
    rows = archive.withColumns({"old": F.coalesce(old, F.lit("")), "new": F.coalesce(new, F.lit("")), "watched": any_of(t, watched), "deed": any_of(t, L.EVENT_VERBS)})
    return rows.withColumn("wrong", (F.col("new") != "") & (F.col("watched") | F.col("deed")))


def crossed(rows: DataFrame) -> DataFrame:
    """old, new, change (kept, blocked, freed or both) and how many rows, watched ones, deeds and wrongly blocked ones there are."""
    change = F.when((F.col("old") == "") & (F.col("new") == ""), "kept").when(F.col("old") == "", "blocked").when(F.col("new") == "", "freed").otherwise("both")
    count = lambda c: F.count_if(F.col(c)).alias(c)
    return rows.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"), count("watched"), count("deed"), count("wrong")).withColumn("change", change)


def summary(rows: DataFrame) -> DataFrame:
    """One row: how many rows either version blocks, how many broadcasts there are and are blocked, and how many watched rows stay."""
    broadcast = gates.broadcast_reason(F.col("title"), ()) != ""
    n = lambda test, name: F.count_if(test).alias(name)
    old, new = F.col("old") != "", F.col("new") != ""
    sums = rows.agg(F.count(F.lit(1)).alias("n"), n(old, "old_blocked"), n(new, "new_blocked"), n(broadcast, "broadcasts"), n(broadcast & new, "broadcasts_blocked"), n(F.col("watched"), "watched"), n(F.col("watched") & new, "watched_blocked"), n(F.col("wrong"), "wrong"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.round(100 * F.col(part) / F.col(whole) + 1e-9, 1)).otherwise(0.0)
    return sums.withColumn("broadcast_rate", share("broadcasts_blocked", "broadcasts")).withColumn("kept", F.col("watched") - F.col("watched_blocked")).withColumn("keep_rate", share("kept", "watched")).drop("kept")
