"""Headline text as column expressions.

All keywords of types, metals and countries are looked up in the whole text in one pass (``keywords.group_hits``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.keywords import SUBSTRINGS, Match, group_hits

# Fixed values.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
CAUSE_PATTERNS = [
    r"due to ([^,.\-|]{6,65})",
    r"following ([^,.\-|]{6,65})",
    r"amid ([^,.\-|]{6,65})",
    r"after ([^,.\-|]{6,65})",
    r"as ([a-z][^,.\-|]{5,60})",
    r"because of ([^,.\-|]{6,65})",
]
NO_EVENT = "General"
NO_METAL = "Metals"
NO_PRESSURE = "?"
NO_COLOR = "gray"
SEPARATOR = " - "


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def headline(raw: Column) -> Column:
    """Title before the last separator, trimmed; the whole text without one."""
    tail = F.substring_index(raw, SEPARATOR, -1)
    head = F.substring(raw, F.lit(1), F.length(raw) - F.length(tail) - len(SEPARATOR))
    return strip(F.when(raw.contains(SEPARATOR), head).otherwise(raw))


def publisher(raw: Column) -> Column:
    """Publisher after the last separator, trimmed; empty without one."""
    return F.when(raw.contains(SEPARATOR), strip(F.substring_index(raw, SEPARATOR, -1))).otherwise("")


def _names(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _hit(hits: Column, names: Sequence[str]) -> Column:
    """Those of ``names`` with a hit, in order; ``hits`` has a count for each."""
    pairs = F.arrays_zip(_names(names).alias("name"), F.coalesce(hits, F.array().cast("array<int>")).alias("hits"))
    return F.transform(F.filter(pairs, lambda p: p["hits"] > 0), lambda p: p["name"])


def metal_tags(hits: Column, names: Sequence[str]) -> Column:
    """All metals with a hit, in dictionary order."""
    found = _hit(hits, names)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_METAL)))


#: Signs that a pattern takes for an s or i whatever their case, as they are once lower-cased.
_ODD_SIGNS = ["\u017f", "\u0131", "i\u0307"]


def cause_signs() -> list[list[str]]:
    """For each cause pattern what a lower-cased title holds if the pattern matches: its opening words, or an odd sign."""
    return [[p[: p.index("(")], *_ODD_SIGNS] for p in CAUSE_PATTERNS]


def cause(title: Column, signs: Column | None = None) -> Column:
    """Phrase of the first pattern whose trimmed capture is longer than 5 characters; each pattern is tried once.

    With ``signs``, the hits of ``cause_signs``, only patterns that can match are tried.
    """
    captures = [strip(F.regexp_extract(title, "(?iu)" + p, 1)) for p in CAUSE_PATTERNS]
    if signs is not None:
        captures = [F.when(F.get(signs, F.lit(k)) > 0, c).otherwise("") for k, c in enumerate(captures)]
    return F.substring(F.get(F.filter(F.array(*captures), lambda c: F.length(c) > 5), F.lit(0)), 1, 70)


def _in_order(places: Sequence[str], match: Match) -> list[str]:
    return sorted(places, key=len, reverse=True) if match.longest_match else list(places)


def country(lowered: Column, places: Sequence[str], match: Match = SUBSTRINGS) -> Column:
    """First listed country whose lower-cased name occurs in the text; with ``longest_match`` the longest one."""
    order = _in_order(places, match)
    return F.get(_hit(group_hits(lowered, [[n.lower()] for n in order], match), order), F.lit(0))


def classify(items: DataFrame, types: Sequence[tuple[str, str, str, Sequence[str]]],
             metals: Sequence[tuple[str, Sequence[str]]], places: Sequence[str],
             title: str = "title", match: Match = SUBSTRINGS) -> DataFrame:
    """Add etype, pressure, color, metals, cause and country to titled items."""
    order = _in_order(places, match)
    groups = [t[3] for t in types] + [keys for _, keys in metals] + [[n.lower()] for n in order]
    n_groups = len(groups)
    if match == SUBSTRINGS:
        groups += cause_signs()
    counted = items.withColumn("_hits", group_hits(F.lower(title), groups, match))

    def part(first: int, count: int) -> Column:
        return F.slice("_hits", first + 1, count)

    scores = part(0, len(types))
    best = F.array_max(scores)

    def of_best(position: int, otherwise: str) -> Column:
        """The first type with the most hits."""
        return F.when(best == 0, otherwise).when(
            best > 0, F.element_at(_names([t[position] for t in types]), F.array_position(scores, best).cast("int")))

    return counted.withColumns({
        "etype": of_best(0, NO_EVENT),
        "pressure": of_best(1, NO_PRESSURE),
        "color": of_best(2, NO_COLOR),
        "metals": metal_tags(part(len(types), len(metals)), [m for m, _ in metals]),
        "cause": cause(F.col(title), part(n_groups, len(CAUSE_PATTERNS)) if match == SUBSTRINGS else None),
        "country": F.get(_hit(part(len(types) + len(metals), len(order)), order), F.lit(0)),
    }).drop("_hits")


def published_at(published: Column) -> Column:
    return F.try_to_timestamp(published)


def sort_key(published: Column) -> Column:
    """Epoch seconds of a readable publication time, else 0."""
    return F.coalesce(F.unix_timestamp(published_at(published)).cast("double"), F.lit(0.0))


def date_label(published: Column) -> Column:
    """Month and day of a readable publication time, else its first 10 characters."""
    return F.coalesce(F.date_format(published_at(published), "MMM dd"), F.substring(published, 1, 10), F.lit(""))


def absolute_link(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))
