"""Locations: aliases, lexicon tests, formatting, lists behind a summary. Lexicons are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlode.functions.text import collapse

ROLL_UP = r"(?i)^\s*\d+\s+Locations?\s*$"


def canonical(c: Column, aliases: dict[str, str]) -> Column:
    """The alias's place, else the location with single spaces; "" for null."""
    x = F.coalesce(F.trim(collapse(c)), F.lit(""))
    if not aliases:
        return x
    known = F.create_map(*(F.lit(v) for pair in aliases.items() for v in pair))
    return F.coalesce(known[x], x)


def holds(c: Column, words: tuple[str, ...]) -> Column:
    """Whether any word is within the text, also inside other words; case does not count, null is no."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(c), F.lit(w.lower()))
    return F.coalesce(hit, F.lit(False))


def is_near(c: Column, near: tuple[str, ...], far: tuple[str, ...] = ()) -> Column:
    """A word of near and none of far, as substrings."""
    return ~holds(c, far) & holds(c, near)


def written(*parts: Column) -> Column:
    """City, region, country by commas, without blank parts and without repeats of the part before."""
    kept = F.filter(F.array(*(F.trim(p) for p in parts)), lambda p: p.isNotNull() & (p != ""))
    fresh = F.filter(kept, lambda p, i: (i == 0) | (p != F.get(kept, i - 1)))
    return F.nullif(F.array_join(fresh, ", "), F.lit(""))


def resolve_roll_up(summary: Column, details: Column) -> Column:
    """"3 Locations" becomes its distinct detailed places, joined by " | "; anything else stays."""
    places = F.array_distinct(F.filter(F.transform(details, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != "")))
    return F.when(summary.rlike(ROLL_UP) & (F.size(places) > 0), F.array_join(places, " | ")).otherwise(summary)
