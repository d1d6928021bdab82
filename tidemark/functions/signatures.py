"""Event signatures and the tests that say whether two of them tell of the same event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .scoring import core_signal_words
from .text import amounts, any_of, bit_masks, bound, characters, common_stretch, entity_name, first_group, groups_in, has_stretch, has_subsequence, jaccard, overlapping, stretches, take_out, text_of, title_anchors, title_norm

def empty() -> Column:
    return F.array().cast("array<string>")


def stocks_of(stocks: Column, name: Column) -> Column:
    """The named stocks and the row's own, sorted."""
    own = F.when(F.coalesce(name, F.lit("")) != "", F.array(name)).otherwise(empty())
    return F.array_sort(F.array_union(F.coalesce(stocks, empty()), own))


def titled_stocks(stocks: Column, name: Column, title: Column) -> Column:
    """The same, or else what stands before the title's first colon."""
    known = stocks_of(stocks, name)
    wide = F.instr(title, "：") > 0
    head = F.when(wide, F.trim(F.substring_index(title, "：", 1))).when(F.instr(title, ":") > 0, F.trim(F.substring_index(title, ":", 1)))
    return F.when((F.size(known) == 0) & head.isNotNull(), F.array(head)).otherwise(known)


def event_groups(title: Column, content: Column, extra: bool = False) -> Column:
    return groups_in(text_of(title, content), (*L.EVENT_GROUPS, *(L.EXTRA_EVENT_GROUPS if extra else ())))


def signature(title: Column, content: Column, name: Column, stocks: Column, entities: Column, sectors: Column, scope: Column) -> Column:
    return F.struct(
        stocks_of(stocks, name).alias("stocks"),
        F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(entities, empty()), lambda e: F.trim(e) != ""), lambda e: entity_name(e, L.ENTITY_ALIASES)))).alias("entities"),
        event_groups(title, content, extra=True).alias("events"),
        amounts(text_of(title, content)).alias("numbers"),
        F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(sectors, empty()), lambda s: F.trim(s)), lambda s: s != ""))).alias("sectors"),
        F.coalesce(scope, F.lit("stock")).alias("scope"),
        title_norm(title).alias("title_norm"),
    )


def signature_key(s: Column) -> Column:
    """Entities, events, numbers and title in one text."""
    joined = lambda x: F.concat_ws("|", F.array_sort(F.coalesce(x, empty())))
    return F.concat_ws("#", joined(s["entities"]), joined(s["events"]), joined(s["numbers"]), F.coalesce(s["title_norm"], F.lit("")))


def merged_signature(a: Column, b: Column) -> Column:
    """Both sides' sets and the longer title; the scope is dropped."""
    sets = [F.array_sort(F.array_union(a[n], b[n])).alias(n) for n in ("stocks", "entities", "events", "numbers", "sectors")]
    return F.struct(*sets, F.when(F.char_length(a["title_norm"]) >= F.char_length(b["title_norm"]), a["title_norm"]).otherwise(b["title_norm"]).alias("title_norm"))


def fingerprint(published: Column, title: Column, content: Column, name: Column, stocks: Column) -> Column:
    """16 digits of an MD5 over the day and, by what the row has, signal words, stocks, events, amounts, or its title."""
    day = F.substring(F.coalesce(published, F.lit("")), 1, 10)
    text = text_of(title, content)
    facts = F.struct(core_signal_words(text).alias("words"), stocks_of(stocks, name).alias("own"), event_groups(title, content, extra=True).alias("events"), amounts(text).alias("numbers"), title_norm(title).alias("norm"))
    return F.substring(F.md5(bound(facts, lambda f: _fingerprint_key(day, f)).cast("binary")), 1, 16)


def _fingerprint_key(day: Column, facts: Column) -> Column:
    words, own, events, numbers, norm = (facts[n] for n in ("words", "own", "events", "numbers", "norm"))
    listed = lambda x: F.concat(F.lit("["), F.concat_ws(",", F.array_sort(x)), F.lit("]"))
    ev, st, num, head = (F.concat(F.lit(p), x) for p, x in (("ev:", listed(events)), ("st:", listed(own)), ("num:", listed(numbers)), ("t:", F.substring(norm, 1, 6))))
    sig = F.concat(F.lit("sig:"), listed(words))
    has = lambda x: F.size(x) > 0
    return (
        F.when(has(words) & has(own), F.concat_ws("|", day, sig, ev, st)).when(has(words), F.concat_ws("|", day, sig, ev, head))
        .when(has(own), F.concat_ws("|", day, st, ev, num)).when(has(events) | has(numbers), F.concat_ws("|", day, ev, num, head))
        .otherwise(F.concat_ws("|", day, F.concat(F.lit("t:"), norm)))
    )


def titles_oppose(a: Column, b: Column) -> Column:
    up, down = (lambda t, w=w: any_of(t, w) for w in (L.TITLE_UP_WORDS, L.TITLE_DOWN_WORDS))
    return (up(a) & down(b)) | (down(a) & up(b))


def session_of(title: Column) -> Column:
    return first_group(title, L.SESSIONS.items())


def theme_keys(s: Column) -> Column:
    return groups_in(F.concat_ws(" ", s["title_norm"], F.concat_ws(" ", s["entities"]), F.concat_ws(" ", s["stocks"])), L.MARKET_THEMES)


def hard_facts(title: Column, content: Column) -> Column:
    return bound(text_of(title, content), _hard_facts)


def _hard_facts(text: Column) -> Column:
    more = F.array_compact(F.array(
        F.when(F.contains(text, F.lit("产能")) & any_of(text, L.CAPACITY_WORDS), "capacity_expansion"),
        F.when(F.contains(text, F.lit("回购")) & any_of(text, ("完成", "完毕", "注销", "实施")), "buyback_completion"),
    ))
    return F.array_sort(F.array_union(groups_in(text, L.HARD_EVENTS), more))


def chain_key(s: Column, title: Column, content: Column) -> Column:
    """Facts, entities and sectors of a hard event; empty where there is no fact."""
    facts = hard_facts(title, content)
    names = F.array_sort(F.array_distinct(F.transform(F.concat(s["stocks"], s["entities"]), lambda e: entity_name(e, L.ENTITY_ALIASES))))
    return F.when(F.size(facts) == 0, "").otherwise(F.concat(F.lit("facts="), F.concat_ws(",", facts), F.lit("|entities="), F.concat_ws(",", names), F.lit("|sectors="), F.concat_ws(",", s["sectors"])))


def all_entities(s: Column) -> Column:
    return F.array_distinct(F.transform(F.concat(s["stocks"], s["entities"]), lambda e: entity_name(e, L.ENTITY_ALIASES)))


def pieces(names: Column) -> Column:
    """Each name's pairs of characters; a name of one character whole."""
    return F.flatten(F.transform(F.filter(names, lambda n: n != ""), lambda n: F.when(F.char_length(n) == 1, F.array(n)).otherwise(stretches(n, 2))))


def entities_meet(a: Column, b: Column) -> Column:
    """Equal names, one that holds the other, or a shared stretch of two or more that is 60% of the shorter."""

    def pair(x: Column, y: Column) -> Column:
        shorter = F.least(F.char_length(x), F.char_length(y))
        inside = F.contains(x, y) | F.contains(y, x)
        return (x == y) | ((shorter >= 2) & (inside | has_stretch(x, y, F.greatest(F.lit(2), F.ceil(0.6 * shorter).cast("int")))))

    return F.exists(F.filter(a, lambda x: x != ""), lambda x: F.exists(F.filter(b, lambda y: y != ""), lambda y: pair(x, y)))


def profile(s: Column) -> Column:
    """What the test for the same event asks of one signature: its sets, its names, the title without these, and what the title holds. It is found once for each row, and not for each pair."""
    return bound(s, _profile)


def _profile(s: Column) -> Column:
    title, parts = s["title_norm"], F.array_union(s["stocks"], s["entities"])
    held = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(title, w))
    hawk, dove = any_of(title, L.HAWK_WORDS), any_of(title, L.DOVE_WORDS)
    codes = F.transform(F.filter(F.split(title, ""), lambda c: c != ""), lambda c: F.ascii(c))
    hashes = lambda texts: F.transform(texts, lambda x: F.hash(x))
    titled = F.struct(
        title.alias("text"), F.char_length(title).alias("n"), codes.alias("codes"), bound(codes, bit_masks).alias("masks"), F.array_distinct(codes).alias("chars"), hashes(stretches(title, 5)).alias("fives"), groups_in(title, L.CORE_FACTS).alias("facts"), title_anchors(title).alias("anchors"),
        any_of(title, L.TITLE_UP_WORDS).alias("up"), any_of(title, L.TITLE_DOWN_WORDS).alias("down"), (hawk & ~dove).alias("hawk"), (dove & ~hawk).alias("dove"), session_of(title).alias("session"), groups_in(title, L.MARKET_DOMAINS.items()).alias("domains"),
        held(L.INDEX_NAMES).alias("indexes"), held(L.EVENT_PHRASES).alias("phrases"), any_of(title, L.MACRO_EVENT_WORDS).alias("macro"), any_of(title, L.POLICY_EVENT_WORDS).alias("policy"), any_of(title, L.MARKET_MOVES).alias("moves"),
    )
    names = all_entities(s)
    return F.struct(
        titled.alias("title"), parts.alias("parts"), take_out(title, parts).alias("rest"), names.alias("names"), F.array_distinct(hashes(pieces(names))).alias("pieces"), F.array_intersect(names, F.array(*map(F.lit, L.CENTRAL_BANKS))).alias("banks"),
        F.array_except(s["events"], F.array(*map(F.lit, L.MARKET_STATES))).alias("kinds"), s["numbers"].alias("numbers"), s["sectors"].alias("sectors"),
    )


def merged_profile(a: Column, b: Column) -> Column:
    """The profile of the merged signature."""
    sets = {n: F.array_union(a[n], b[n]) for n in ("parts", "names", "pieces", "banks", "kinds", "numbers", "sectors")}
    title = F.when(a["title"]["n"] >= b["title"]["n"], a["title"]).otherwise(b["title"])
    rest = take_out(title["text"], sets["parts"])
    return F.struct(title.alias("title"), sets["parts"].alias("parts"), rest.alias("rest"), *[sets[n].alias(n) for n in ("names", "pieces", "banks", "kinds", "numbers", "sectors")])


def same_event(a: Column, b: Column) -> Column:
    """Whether two signatures tell of the same event: shared core facts, then by event groups on both, neither or one side."""
    return same_profiles(profile(a), profile(b))


def same_profiles(a: Column, b: Column) -> Column:
    """The same of two profiles. What costs most is asked last, and a length only where it decides."""
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda s: _same(s["a"], s["b"]))


def _same(a: Column, b: Column) -> Column:
    x, y = a["title"], b["title"]
    ta, tb = x["text"], y["text"]
    some = lambda v: F.size(v) > 0
    overlap = lambda n: F.arrays_overlap(x[n], y[n])
    clash = lambda v, w: some(v) & some(w) & ~F.arrays_overlap(v, w)
    # names that meet share a piece
    meet = F.arrays_overlap(a["pieces"], b["pieces"]) & (F.arrays_overlap(F.filter(a["names"], lambda n: n != ""), b["names"]) | entities_meet(a["names"], b["names"]))
    opposed = (x["up"] & y["down"]) | (x["down"] & y["up"])
    titled, shorter = (ta != "") & (tb != ""), F.least(x["n"], y["n"])
    numbers_meet, numbers_clash = F.arrays_overlap(a["numbers"], b["numbers"]), clash(a["numbers"], b["numbers"])

    def alike(least: float) -> Column:
        """Of the titles' characters, as `jaccard` has it."""
        share = lambda n: F.when(some(x["chars"]) & some(y["chars"]), n / (F.size(x["chars"]) + F.size(y["chars"]) - n)).otherwise(F.lit(0.0)) >= least
        return bound(F.size(F.array_intersect(x["chars"], y["chars"])), share)

    five = lambda test: overlap("fives") & test  # noqa: E731  # what shares more than five characters in a row shares five
    least = lambda share: F.ceil(shorter * share - 1e-9).cast("int")

    common = lambda n: has_subsequence(x, y, n)

    by_facts = overlap("facts") & ~opposed & ~numbers_clash & ~clash(x["anchors"], y["anchors"]) & (numbers_meet | overlap("anchors") | meet)

    with_names = F.when(titled, overlap("phrases") | alike(0.15) | has_stretch(ta, tb, F.lit(3))).otherwise((ta != "") | (tb != ""))
    by_group = F.when(meet, with_names).otherwise(numbers_meet | five(has_stretch(ta, tb, F.lit(5))))

    domain, banks = overlap("domains"), F.arrays_overlap(a["banks"], b["names"])
    no = F.lit(None).cast("boolean")
    by_market = (
        F.when(F.coalesce(x["session"] == y["session"], F.lit(False)) & domain, True)
        .when(~F.coalesce(x["session"] != y["session"], F.lit(False)) & domain & overlap("indexes"), True)
        .when(domain & (x["moves"] | y["moves"]) & F.arrays_overlap(a["sectors"], b["sectors"]), True)
        .when(domain & x["macro"] & y["macro"], True)
        .when(banks & ((x["hawk"] & y["dove"]) | (x["dove"] & y["hawk"])), False)
        .when(banks & x["policy"] & y["policy"], True)
        .otherwise(no)
    )
    shared_sectors = F.size(overlapping(a["sectors"], b["sectors"]))
    rest = lambda n: has_stretch(a["rest"], b["rest"], F.lit(n))

    def by_names(met: Column) -> Column:
        by_entity = (
            F.when(~met, no).when(numbers_clash, False).when(overlap("phrases"), True).when(has_stretch(ta, tb, F.lit(2)) & (shared_sectors >= 2), True)
            .when(rest(2) & ((shared_sectors >= 1) | rest(6)), True).otherwise(no)
        )
        by_title = F.when(shorter < 8, False).otherwise(bound(met | numbers_meet, lambda anchored: (
            F.when(anchored & (a["rest"] != "") & (b["rest"] != "") & ~rest(3), False)
            .when(anchored, has_stretch(ta, tb, least(0.35)) | common(F.greatest(F.lit(10), least(0.45))))
            .otherwise(five(has_stretch(ta, tb, least(0.55))) | common(F.greatest(F.lit(12), least(0.6))))
        )))
        return F.coalesce(by_entity, by_title)

    by_none = F.when(~titled | opposed, False).otherwise(F.coalesce(by_market, F.when(alike(0.6), True), bound(F.coalesce(meet, F.lit(False)), by_names)))
    by_one = titled & ~opposed & ~numbers_clash & (alike(0.55) | ((shorter >= 8) & five(has_stretch(ta, tb, F.greatest(F.lit(8), least(0.5))))))
    return F.when(by_facts, True).when(F.arrays_overlap(a["kinds"], b["kinds"]), by_group).when(~some(a["kinds"]) & ~some(b["kinds"]), by_none).otherwise(by_one)


def titles_alike(a: Column, b: Column) -> Column:
    """The looser test for titles that wait and titles that were sent."""
    shorter = F.least(F.char_length(a), F.char_length(b))
    return (a != "") & (b != "") & ((jaccard(characters(a), characters(b)) >= 0.55) | ((shorter >= 6) & (common_stretch(a, b) / shorter >= 0.5)))

