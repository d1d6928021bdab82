"""What a round decides row by row, in order: which event a row belongs to, and what goes out.

Both are folds: a row's outcome depends on those before it. A round has few candidates (at most `most`), so each
round's rows are one array, folded by one expression; many rounds, as in a replay of an archive, are as many groups
and fold side by side. `by` names the columns that tell rounds apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import stored
from ..functions.signatures import all_entities, merged_profile, profile, same_profiles, theme_keys
from ..functions.text import bound, overlapping

#: What of a signature a fold reads.
_SIGNATURE = "struct<stocks:array<string>,entities:array<string>,events:array<string>,numbers:array<string>,sectors:array<string>,title_norm:string>"


def in_order(rows: DataFrame, by: tuple[str, ...], order: str, value: Column) -> DataFrame:
    """by and rows: each round's values as one array, in order."""
    items = F.collect_list(F.struct(F.col(order).alias("_order"), F.col("seq").alias("_seq"), value.alias("value")))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(items), lambda x: x["value"]).alias("rows"))


def grown_groups(rows: DataFrame, by: tuple[str, ...] = (), order: str = "place") -> DataFrame:
    """by, group, member and seq: the event of each row (seq, sig), numbered in the order of first rows, and its place in it.

    A row joins the first group whose signature tells of the same event; the group's signature grows by the row's,
    so that it catches more. A chain A ~ B ~ C is one group where A and B together are like C.
    """
    sig = F.struct(*[F.col(f"sig.{n}").alias(n) for n in ("stocks", "entities", "events", "numbers", "sectors", "title_norm")])
    lists = in_order(rows, by, order, F.struct("seq", sig.alias("sig")))
    lists = lists.withColumn("rows", F.transform("rows", lambda x: F.struct(x["seq"].alias("seq"), profile(x["sig"]).alias("sig"))))

    def step(groups: Column, x: Column) -> Column:
        def joined(at: Column) -> Column:
            new = F.array_append(groups, F.struct(x["sig"].alias("sig"), F.array(x["seq"]).alias("seqs")))
            grow = lambda g, i: F.when(i == at - 1, F.struct(merged_profile(g["sig"], x["sig"]).alias("sig"), F.array_append(g["seqs"], x["seq"]).alias("seqs"))).otherwise(g)
            return F.when(at == 0, new).otherwise(F.transform(groups, grow))

        # n: groups gone through; at: the place of the first that is like the row, after which none is tested
        place = lambda s, g: F.struct((s["n"] + 1).alias("n"), F.when((s["at"] == 0) & F.coalesce(same_profiles(x["sig"], g["sig"]), F.lit(False)), s["n"] + 1).otherwise(s["at"]).alias("at"))
        return bound(F.aggregate(groups, F.struct(F.lit(0).alias("n"), F.lit(0).alias("at")), place, lambda s: s["at"]), joined)

    kind = lists.schema["rows"].dataType.elementType["sig"].dataType.simpleString()
    start = F.expr(f"CAST(array() AS array<struct<sig:{kind},seqs:array<bigint>>>)")
    groups = lists.select(*by, F.posexplode(F.aggregate("rows", start, step, lambda g: g["seqs"])).alias("group", "seqs"))
    return groups.select(*by, "group", F.posexplode("seqs").alias("member", "seq"))


def best_of_groups(rows: DataFrame, by: tuple[str, ...] = (), order: str = "place") -> DataFrame:
    """rows with group, one for each group: the best by push, score and pref_score, the first of equals."""
    members = grown_groups(rows, by, order)
    worth = rows.select(*by, "seq", F.struct(F.coalesce("push", F.lit(False)).alias("push"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("pref_score", F.lit(0.0)).alias("pref")).alias("worth"))
    keys = [*by, "seq"]
    best = members.join(worth, keys).groupBy(*by, "group").agg(F.max_by("seq", F.struct("worth", -F.col("member"))).alias("seq"))
    return rows.join(best, keys)


def peers(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, seq, same, topic and theme: the other rows of the round (few) that tell of the same event, share an entity or sector, share a theme."""
    known = stored(rows.select(*by, "seq", "sig", profile(F.col("sig")).alias("profile"), theme_keys(F.col("sig")).alias("themes"), all_entities(F.col("sig")).alias("names")))
    side = lambda n: known.select(*by, F.col("seq").alias(n), F.struct("sig.sectors", "profile", "themes", "names").alias(f"s{n}"))
    pairs = side("x").join(side("y"), list(by)) if by else side("x").crossJoin(F.broadcast(side("y")))
    a, b = F.col("sx"), F.col("sy")
    topic = F.arrays_overlap(a["names"], b["names"]) | (F.size(overlapping(a["sectors"], b["sectors"])) > 0)
    # a table of their own: the test is large
    told = stored(pairs.where("x <> y").select(*by, "x", "y", F.coalesce(same_profiles(a["profile"], b["profile"]), F.lit(False)).alias("same"), F.coalesce(topic, F.lit(False)).alias("topic"), F.arrays_overlap(a["themes"], b["themes"]).alias("theme")))
    return told.groupBy(*by, F.col("x").alias("seq")).agg(*[F.collect_list(F.when(F.col(n), F.col("y"))).alias(n) for n in ("same", "topic", "theme")])


def admitted(rows: DataFrame, by: tuple[str, ...] = (), order: str = "place", topic_limit: int = 5, theme_limit: int = 3, daily_limit: int | None = None) -> DataFrame:
    """rows with gate and exempt: what goes out, decided in order, each row seeing what went out before it in its round.

    rows: seq, sig and `reason` (a gate that needs no other row, or empty); what the log said before the round:
    `told` (the same event went out), `topics` and `themes` (how many events share one), `used` (its chain had its
    exemption), `day` (how many went out that day); `market` and `released` (a market-wide row, one that is a data
    release), `spared` (not counted against the day's limit), `direct` (past every gate but `told`), and `chain`
    (empty where it has none).
    """
    near = peers(rows, by)
    none = F.array().cast("array<bigint>")
    lists_of = lambda n: F.coalesce(F.col(n), none).alias(n)
    known = rows.select(*by, "seq", order if order != "seq" else F.col("seq").alias("_at"), "reason", "told", "topics", "themes", "used", "day", "market", "released", "spared", "direct", "chain").join(near, [*by, "seq"], "left")
    item = F.struct("seq", "reason", "told", "topics", "themes", "used", "day", "market", "released", "spared", "direct", "chain", *map(lists_of, ("same", "topic", "theme")))
    lists = in_order(known, by, order if order != "seq" else "_at", item)

    def step(acc: Column, x: Column) -> Column:
        sent = acc["sent"]
        shared = lambda n: F.size(F.array_intersect(x[n], sent))
        told = x["told"] | F.arrays_overlap(x["same"], sent)
        topics, themes = x["topics"] + shared("topic"), x["themes"] + shared("theme")
        full = F.when(x["market"] & x["released"], False).when(x["market"] & (themes >= theme_limit), True).otherwise(topics >= topic_limit) & ~x["direct"]
        free = (x["chain"] != "") & ~x["used"] & ~F.array_contains(acc["chains"], x["chain"])
        over = F.lit(False) if daily_limit is None else ((x["day"] + F.size(sent)) >= daily_limit) & ~x["spared"] & ~x["direct"]
        gate = F.when(x["reason"] != "", x["reason"]).when(told, "same event").when(full & ~free, "topic").when(over, "daily limit").otherwise("sent")

        def after(g: Column) -> Column:
            exempt = (g["gate"] == "sent") & g["full"]
            return F.struct(
                F.when(g["gate"] == "sent", F.array_append(sent, x["seq"])).otherwise(sent).alias("sent"),
                F.when(exempt, F.array_append(acc["chains"], x["chain"])).otherwise(acc["chains"]).alias("chains"),
                F.array_append(acc["out"], F.struct(x["seq"].alias("seq"), g["gate"].alias("gate"), exempt.alias("exempt"))).alias("out"),
            )

        return bound(F.struct(gate.alias("gate"), full.alias("full")), after)

    start = F.expr("struct(CAST(array() AS array<bigint>) AS sent, CAST(array() AS array<string>) AS chains, CAST(array() AS array<struct<seq:bigint,gate:string,exempt:boolean>>) AS out)")
    out = lists.select(*by, F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("o")).select(*by, "o.*")
    return rows.join(out, [*by, "seq"])
