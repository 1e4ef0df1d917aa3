"""Values read from free text: amounts, years, dates, countries, flags, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlode.functions.text import strip

#: Country names by ISO code, first match wins.
COUNTRY_NAMES = {
    "DE": ("deutschland", "germany", "allemagne"),
    "FR": ("france", "frankreich"),
    "BE": ("belgique", "belgium", "belgien", "belgië"),
    "AT": ("österreich", "austria", "autriche"),
    "NL": ("nederland", "netherlands", "pays-bas", "niederlande"),
    "IT": ("italia", "italy", "italien"),
    "ES": ("españa", "spain", "espagne", "spanien"),
    "PT": ("portugal",),
    "PL": ("polska", "poland", "pologne", "polen"),
    "CH": ("schweiz", "suisse", "switzerland", "svizzera"),
    "LU": ("luxembourg", "luxemburg"),
    "DK": ("danmark", "denmark", "dänemark"),
    "SE": ("sverige", "sweden", "schweden"),
    "NO": ("norge", "norway", "norwegen"),
    "FI": ("suomi", "finland", "finnland"),
    "IE": ("ireland", "irlande", "irland"),
    "CZ": ("česko", "czech", "tschechien"),
    "US": ("united states", "u.s.a", "usa"),
    "GB": ("united kingdom", "england", "scotland", "wales"),
    "CA": ("canada",),
}
REMOTE_WORDS = ("remote", "anywhere", "work from home", "wfh", "telework")
#: Month names, English ones by their first three letters.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12, "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12}
_NUMBER = r"(\d[\d.,  ]*)"
_SYMBOL = r"(?:[A-Z]{0,3}[$€£¥₹]|USD|EUR|GBP)?\s*"
_UNIT = r"(thousand|million|k|m)?"
SALARY_RANGE = rf"(?iU){_SYMBOL}{_NUMBER}\s*{_UNIT}\b?\s*(?:-|–|—|~|\bto\b)\s*{_SYMBOL}{_NUMBER}\s*{_UNIT}"
SALARY_ONE = rf"(?iU){_SYMBOL}{_NUMBER}\s*{_UNIT}"


def _amount(number: Column, unit: Column) -> Column:
    digits = F.regexp_replace(number, r"[,  ]", "")
    whole = F.regexp_replace(digits, r"\.(?=.*\.)", "")
    scale = F.when(F.lower(unit).isin("k", "thousand"), 1e3).when(F.lower(unit).isin("m", "million"), 1e6).otherwise(1.0)
    return F.expr("1").cast("double") * whole.try_cast("double") * scale


def salary_range(c: Column) -> Column:
    """struct(min, max) of doubles: a range, else one amount as both; each side with its own unit; swapped if needed."""
    part = lambda p, i: F.regexp_extract(c, p, i)
    low, high = _amount(part(SALARY_RANGE, 1), part(SALARY_RANGE, 2)), _amount(part(SALARY_RANGE, 3), part(SALARY_RANGE, 4))
    ranged = low.isNotNull() & high.isNotNull()
    one = F.when(F.length(F.regexp_replace(F.regexp_extract(c, SALARY_ONE, 0), r"\s", "")) >= 3, _amount(part(SALARY_ONE, 1), part(SALARY_ONE, 2)))
    return F.struct(F.when(ranged, F.least(low, high)).otherwise(one).alias("min"), F.when(ranged, F.greatest(low, high)).otherwise(one).alias("max"))


def experience_range(c: Column) -> Column:
    """struct(min, max) of years: "2-4 years", "3+ years" (no max), "5 years" (both)."""
    years = r"\s*(?:years?|yrs?)"
    two, plus, one = rf"(?i)(\d{{1,2}})\s*(?:-|to)\s*(\d{{1,2}}){years}", rf"(?i)(\d{{1,2}})\s*\+{years}", rf"(?i)(\d{{1,2}}){years}"
    get = lambda p, i: F.regexp_extract(c, p, i).try_cast("int")
    return F.struct(F.coalesce(get(two, 1), get(plus, 1), get(one, 1)).alias("min"), F.when(get(two, 1).isNotNull(), get(two, 2)).when(get(plus, 1).isNotNull(), F.lit(None)).otherwise(get(one, 1)).alias("max"))


def country_of(c: Column) -> Column:
    """ISO code from a location: names, then a region prefix "DE (DEA58)", then a known code at the end (in brackets, behind a slash or before a full stop too); else ""."""
    low = F.lower(strip(c))
    out = F.when(low.isNull() | (low == ""), F.lit(""))
    for code, names in COUNTRY_NAMES.items():
        pattern = "|".join(r"\b" + n.replace(".", r"\.") + r"\b" for n in names)
        out = out.when(low.rlike(f"(?U){pattern}"), F.lit(code))
    prefix, last = F.regexp_extract(strip(c), r"^([A-Za-z]{2})\s*\(", 1), F.upper(F.regexp_extract(strip(c), r"(?:^|[,\s(/])([A-Za-z]{2})[\s).]*$", 1))
    return out.when(prefix != "", F.upper(prefix)).when(last.isin(*COUNTRY_NAMES), last).otherwise(F.lit(""))


def remote_from_title(c: Column) -> Column:
    """True if a keyword is in the title, else null; never False."""
    hit = F.lit(False)
    for w in REMOTE_WORDS:
        hit = hit | F.contains(F.lower(c), F.lit(w))
    return F.when(hit, F.lit(True))


def flag(c: Column) -> Column:
    """Three-valued: true, yes, 1, remote; false, no, 0; else null."""
    x = F.lower(strip(c.cast("string")))
    return F.when(x.isin("true", "yes", "1", "remote"), F.lit(1)).when(x.isin("false", "no", "0"), F.lit(0))


def iso_time(c: Column) -> Column:
    return F.try_to_timestamp(c)


def feed_time(c: Column) -> Column:
    """RFC 822, with or without the weekday."""
    return F.try_to_timestamp(F.regexp_replace(c, r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def epoch_time(c: Column) -> Column:
    """Seconds or, from 10^11 on, milliseconds."""
    n = c.try_cast("long")
    return F.when(n.isNotNull(), F.timestamp_millis(F.when(F.abs(n) >= 100_000_000_000, n).otherwise(n * 1000)))


def local_date(c: Column, day_first: bool | Column = False) -> Column:
    """Date from d/m/y or m/d/y (dots and dashes too), y-m-d, or a day with an English or French month name; else null."""
    part = lambda p, i: F.nullif(F.regexp_extract(F.lower(c), p, i), F.lit(""))
    numbers, iso, word = r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\s*$", r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})", r"(?U)\b(\d{1,2})(?:er|st|nd|rd|th)?\.?\s+(\p{L}+)\.?,?\s+(\d{4})\b"
    swapped = r"(?U)\b(\p{L}+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,\s*(\d{4})\b"
    known = F.create_map(*(F.lit(x) for name, n in MONTHS.items() for x in (name, n)))
    a, b = part(numbers, 1).try_cast("int"), part(numbers, 2).try_cast("int")
    first = F.lit(day_first) if isinstance(day_first, bool) else day_first
    date = lambda y, m, d: F.try_make_timestamp(y.try_cast("int"), m.try_cast("int"), d.try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    named = lambda p, day, month: date(part(p, 3), F.coalesce(known[part(p, month)], known[F.substring(part(p, month), 1, 3)]), part(p, day))
    return F.coalesce(date(part(numbers, 3), F.when(first, b).otherwise(a), F.when(first, a).otherwise(b)), date(part(iso, 1), part(iso, 2), part(iso, 3)), named(word, 1, 2), named(swapped, 2, 1))


def relative_time(c: Column, now: Column) -> Column:
    """"3 weeks ago", "16 days", "yesterday", "today" before a given time."""
    n, unit = F.regexp_extract(F.lower(c), r"(\d+)\s*\+?\s*(hour|day|week|month|year)", 1).try_cast("int"), F.regexp_extract(F.lower(c), r"(\d+)\s*\+?\s*(hour|day|week|month|year)", 2)
    hours = F.when(unit == "hour", n).when(unit == "day", n * 24).when(unit == "week", n * 168).when(unit == "month", n * 720).when(unit == "year", n * 8760)
    hours = F.when(F.lower(c).contains("today"), 0).when(F.lower(c).contains("yesterday"), 24).otherwise(hours)
    return now - F.make_dt_interval(hours=hours)


def fingerprint(*parts: Column) -> Column:
    """sha256 of lower-cased, stripped parts joined by |, nulls as empty."""
    return F.sha2(F.concat_ws("|", *(F.lower(F.coalesce(strip(p.cast("string")), F.lit(""))) for p in parts)), 256)


def short_id(*parts: Column) -> Column:
    return F.substring(fingerprint(*parts), 1, 16)


def global_id(source: Column, own: Column) -> Column:
    """source:id; a random id where it is blank or holds control characters (so never a key to join on)."""
    x = strip(own)
    return F.when((x != "") & ~own.rlike(r"[\x00\t\r\n]"), F.concat_ws(":", source, x)).otherwise(F.uuid())


def serialised(*columns: str) -> Column:
    """The columns as one JSON object, nulls left out."""
    return F.to_json(F.struct(*columns))


def sum_of_map(c: Column) -> Column:
    """The sum of a map's values; nulls count as nothing."""
    return F.aggregate(F.coalesce(F.map_values(c), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)).cast("long"))
