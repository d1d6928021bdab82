"""Text functions on columns. All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once for each row however often f uses it: an expression that is used in a lambda, or in many places, would be computed there each time."""
    return F.element_at(F.transform(F.array(value), f), 1)


def text_of(*parts: Column | str) -> Column:
    """The parts joined by a space; nulls are empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])


def without(text: Column, name: Column) -> Column:
    """text with every occurrence of name taken out; an empty name takes nothing out."""
    return F.when(F.coalesce(name, F.lit("")) == "", text).otherwise(F.replace(text, name, F.lit("")))


def word_pattern(word: str, bounded: bool) -> str:
    """A literal; a bounded one has no letter or digit beside it."""
    return rf"(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])" if bounded else re.escape(word)


def abbreviations(words: Iterable[str]) -> set[str]:
    """Words of ASCII letters and stars alone, which must stand by themselves."""
    return {w for w in words if re.fullmatch(r"[A-Za-z*]+", w)}


def any_of(text: Column, words: Iterable[str], bounded: Iterable[str] = ()) -> Column:
    """Whether the text holds one of the words. Plain words are searched as bytes, which is many times faster than one long alternation; bounded ones by one regular expression."""
    bounded = set(bounded)
    plain, alone = [w for w in words if w not in bounded], [w for w in words if w in bounded]

    def found(t: Column) -> Column:
        held = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(t, w)) if ws else F.lit(False)
        # the expression runs only on texts that hold one of its words at all
        return held(plain) | (held(alone) & t.rlike("|".join(word_pattern(w, True) for w in alone))) if alone else held(plain)

    return bound(F.coalesce(text, F.lit("")), found)


def hits(text: Column, words: Sequence[str], bounded: Iterable[str] = ()) -> Column:
    """The words that the text holds, in their own order."""
    bounded = set(bounded)
    held = lambda t, w: F.contains(t, F.lit(w)) & t.rlike(word_pattern(w, True)) if w in bounded else F.contains(t, F.lit(w))
    return bound(text, lambda t: F.array_compact(F.array(*[F.when(held(t, w), F.lit(w)) for w in words])))


def hit_count(text: Column, words: Iterable[str]) -> Column:
    return bound(text, lambda t: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))))


def weight_sum(text: Column, weights: dict[str, float]) -> Column:
    """The weights of the words that the text holds, added in the list's order."""
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(float(x)).alias("x")) for w, x in weights.items()])
    return bound(text, lambda t: F.aggregate(F.filter(table, lambda r: F.contains(t, r["w"])), F.lit(0.0), lambda total, r: total + r["x"]))


def first_group(text: Column, groups: Iterable[tuple[str, Sequence[str]]]) -> Column:
    """The name of the first group a word of which the text holds, else null."""
    groups = list(groups)
    return bound(text, lambda t: F.coalesce(*[F.when(any_of(t, words), F.lit(name)) for name, words in groups]))


def groups_in(text: Column, groups: Iterable[tuple[str, Sequence[str]]]) -> Column:
    """The names of all groups a word of which the text holds, sorted."""
    groups = list(groups)
    return bound(text, lambda t: F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(any_of(t, words), F.lit(name)) for name, words in groups])))))


def clean_url(url: Column) -> Column:
    """Scheme and host in lower case, no www., no query, no fragment, no slash at the end; empty for no URL."""
    u = F.trim(F.coalesce(url, F.lit("")))
    plain = F.regexp_replace(u, r"(?s)[?#].*$", "")
    has = plain.rlike(r"^[^:/]+://")
    scheme = F.lower(F.regexp_extract(plain, r"^([^:/]+)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, r"^[^:/]+://([^/]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.when(has, F.regexp_extract(plain, r"^[^:/]+://[^/]*(.*)$", 1)).otherwise(plain), r"/+$", "")
    return F.when(u == "", F.lit("")).otherwise(F.concat(scheme, F.lit("://"), host, path))


def url_host(cleaned: Column) -> Column:
    return F.regexp_extract(cleaned, r"^[^:/]*://([^/]*)", 1)


def title_norm(title: Column) -> Column:
    """Chinese characters, ASCII letters and digits, and dots between digits; the first 40 of them."""
    kept = F.regexp_replace(F.coalesce(title, F.lit("")), r"[^一-龥A-Za-z0-9.]+", "")
    return F.substring(F.regexp_replace(kept, r"(?<![0-9])\.|\.(?![0-9])", ""), 1, 40)


def title_core(title: Column) -> Column:
    """The title without brackets, marks and spaces."""
    return F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N}_]", "")


def characters(text: Column) -> Column:
    """The distinct characters, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 where one is empty."""
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda s: F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(s["a"], s["b"])) / F.size(F.array_union(s["a"], s["b"]))))


def simhash32(text: Column) -> Column:
    """Character trigrams voted by the low 32 bits of the first 8 bytes of their MD5; 0 for texts under 5 characters."""
    t = F.coalesce(text, F.lit(""))

    def values(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))
        return F.transform(grams, lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 9, 8), 16, 10).cast("long"))

    def votes(vs: Column) -> Column:
        bits = F.array(*[F.lit(1 << b).cast("long") for b in range(32)])
        won = F.filter(bits, lambda b: 2 * F.size(F.filter(vs, lambda v: v.bitwiseAND(b) != 0)) > F.size(vs))
        return F.aggregate(won, F.lit(0).cast("long"), lambda total, b: total + b)

    return F.when(F.char_length(t) < 5, F.lit(0).cast("long")).otherwise(bound(bound(t, values), votes))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def amounts(text: Column) -> Column:
    """Amounts in 亿 or 万 as `unit:value`, the value to four digits; distinct and sorted. Units are not converted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*(亿|万)"), 0)
    keys = F.transform(found, lambda x: F.concat(F.right(x, F.lit(1)), F.lit(":"), F.format_string("%.3e", F.regexp_extract(x, r"^[0-9.]+", 0).cast("double"))))
    return F.array_sort(F.array_distinct(keys))


def title_anchors(title: Column) -> Column:
    """Generations, model names and numbers with their unit; distinct and sorted."""
    pattern = r"(第[一二三四五六七八九十百]+代|[A-Za-z]{2,12}[0-9]+[A-Za-z0-9]*|[0-9]+(?:\.[0-9]+)?(?:亿|万|%|倍|GB|TB|nm|纳米|百分点|年|月|日|G))"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(pattern), 1)))


def entity_name(entity: Column, aliases: dict[str, str]) -> Column:
    """The entity without a ticker in brackets at its end, under its agreed name."""
    bare = F.trim(F.regexp_replace(F.trim(entity), r"[（(][A-Za-z0-9.\-]+[)）]$", ""))
    named = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(named, bare), bare)


def overlapping(a: Column, b: Column) -> Column:
    """Of all pairs of which one holds the other, the shorter; distinct and sorted."""
    clean = lambda x: F.filter(F.transform(x, lambda s: F.trim(s)), lambda s: s != "")
    pairs = F.flatten(F.transform(clean(a), lambda x: F.transform(F.filter(clean(b), lambda y: F.contains(x, y) | F.contains(y, x)), lambda y: F.when(F.char_length(x) <= F.char_length(y), x).otherwise(y))))
    return F.array_sort(F.array_distinct(pairs))


def take_out(text: Column, parts: Column) -> Column:
    """text without the parts, the longest first."""
    longest = F.array_sort(F.transform(F.array_distinct(parts), lambda p: F.struct((-F.char_length(p)).alias("n"), p.alias("p"))))
    return F.aggregate(longest, text, lambda t, p: F.when(p["p"] == "", t).otherwise(F.replace(t, p["p"], F.lit(""))))


def shares_stretch(a: Column, b: Column, length: int) -> Column:
    """Whether the texts share a stretch of so many characters: a substring test for each place in a."""
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda s: _shares(s["a"], s["b"], length))


def _shares(a: Column, b: Column, length: int) -> Column:
    last = F.char_length(a) - length + 1
    return (last > 0) & F.exists(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(a, i, F.lit(length))), lambda s: F.contains(b, s))


def has_stretch(a: Column, b: Column, length: Column) -> Column:
    """The same for a length (1 at least) that differs by row, with a and b bound. It stops at the first."""
    last = F.char_length(a) - length + 1
    return (last > 0) & (F.char_length(b) >= length) & F.exists(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.contains(b, F.substring(a, i, length)))


def common_stretch(a: Column, b: Column) -> Column:
    """Length of the longest stretch that both texts hold. Rises one length at a time from each place, so it costs |a| + the answer tests."""
    return bound(F.struct(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b")), lambda s: _stretch(s["a"], s["b"]))


def _stretch(a: Column, b: Column) -> Column:
    places = F.when(F.char_length(a) > 0, F.sequence(F.lit(1), F.char_length(a))).otherwise(F.array().cast("array<int>"))

    def longer(best: Column, i: Column) -> Column:
        steps = F.sequence(best, F.greatest(best, F.char_length(a) - i + 1))
        return F.greatest(best, F.array_max(F.transform(steps, lambda n: F.when(F.contains(b, F.substring(a, i, n)), n).otherwise(F.lit(0)))))

    return F.aggregate(places, F.lit(0), longer)


#: Characters of which each is one bit of a 64-bit number, with room for a carry.
_BITS = 60


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; null is empty.

    Up to 60 characters of the shorter text are the bits of a number, and each character of the other one step of
    it: bits that become 0 count. Longer texts fill the table of lengths row by row.
    """
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")

    def by_bits(x: Column, y: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(y) - 1)
        all_bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.size(y)) - 1

        def step(v: Column, c: Column) -> Column:
            mask = F.aggregate(places, F.lit(0).cast("long"), lambda m, i: F.when(F.get(y, i) == c, m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(m))
            return bound(mask, lambda m: (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(all_bits))

        return F.size(y) - F.bit_count(F.aggregate(x, all_bits, step))

    def by_rows(x: Column, y: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(y))
        zeros = F.array_repeat(F.lit(0), F.size(y) + 1)
        cell = lambda row, before, c, j: F.when(F.get(y, j - 1) == c, F.get(before, j - 1) + 1).otherwise(F.greatest(F.get(before, j), F.get(row, j - 1)))
        return F.array_max(F.aggregate(x, zeros, lambda before, c: F.aggregate(places, F.array(F.lit(0)), lambda row, j: F.array_append(row, cell(row, before, c, j)))))

    def length(t: Column) -> Column:
        x, y = t["long"], t["short"]
        return F.when(F.size(y) == 0, 0).when(F.size(y) <= _BITS, by_bits(x, y)).otherwise(by_rows(x, y)).cast("int")

    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    first = F.char_length(x) >= F.char_length(y)
    return bound(F.struct(chars(F.when(first, x).otherwise(y)).alias("long"), chars(F.when(first, y).otherwise(x)).alias("short")), length)


def stretches(text: Column, length: int) -> Column:
    """All stretches of so many characters."""
    places = F.when(F.char_length(text) >= length, F.sequence(F.lit(1), F.char_length(text) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(text, i, F.lit(length)))


def bit_masks(codes: Column) -> Column:
    """For each character, by its code, the places where it stands, as bits; of the first `_BITS` characters."""
    first = F.slice(codes, 1, _BITS)
    bits = F.transform(first, lambda c, i: F.struct(c.alias("c"), F.call_function("shiftleft", F.lit(1).cast("long"), i).alias("b")))
    mask = lambda c: F.aggregate(F.filter(bits, lambda x: x["c"] == c), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x["b"]))
    return F.map_from_entries(F.transform(F.array_distinct(first), lambda c: F.struct(c.alias("c"), mask(c).alias("m"))))


def has_subsequence(a: Column, b: Column, length: Column) -> Column:
    """Whether the longest common subsequence has so many characters. a, b: structs, bound, of the text, its number n of characters, their codes and `bit_masks`.

    It has no more than the places of a text whose characters are in the other; else as `common_subsequence` by bits, with masks that are found once for each text.
    """
    places = lambda x, y: F.char_length(x) - F.char_length(F.call_function("translate", x, y, F.lit("")))
    all_bits = F.call_function("shiftleft", F.lit(1).cast("long"), a["n"]) - 1
    step = lambda v, c: bound(F.coalesce(F.try_element_at(a["masks"], c), F.lit(0).cast("long")), lambda m: F.when(m == 0, v).otherwise((v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(all_bits)))
    by_bits = a["n"] - F.bit_count(F.aggregate(b["codes"], all_bits, step))
    ta, tb = a["text"], b["text"]
    return (places(ta, tb) >= length) & (places(tb, ta) >= length) & (F.when(a["n"] <= _BITS, by_bits).otherwise(common_subsequence(ta, tb)) >= length)
