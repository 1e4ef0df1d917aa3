"""Pay in the formats of single providers; the general rule is values.salary_range()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Intervals of pay components and their periods.
PERIODS = {"HOURLY": "HOUR", "DAILY": "DAY", "WEEKLY": "WEEK", "MONTHLY": "MONTH", "ANNUALLY": "YEAR", "YEARLY": "YEAR", "1 YEAR": "YEAR", "1 MONTH": "MONTH", "1 WEEK": "WEEK", "1 DAY": "DAY", "1 HOUR": "HOUR"}
_TIERS = "struct<compensationTiers: array<struct<components: array<struct<compensationType: string, minValue: double, maxValue: double, currencyCode: string, interval: string>>>>>"


def _dollars(side: Column, unit: Column) -> Column:
    return F.nullif(F.regexp_extract(side, r"\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double") * F.when(unit == "K", 1e3).when(F.lower(unit) == "m", 1e6).otherwise(1.0)


def dollar_range(c: Column) -> Column:
    """struct(min, max, currency): "$180-250K" (a missing upper unit is the lower one's; a missing lower one stays), "$120K".

    Units are drawn to their numbers and the words between two amounts become one mark; the sides of the first such
    pair that starts with a dollar, or the first dollar amount, are then read one by one.
    """
    tight = F.regexp_replace(F.regexp_replace(c, r"(?<=\d)\s+(?=[KMm])", ""), r"(?<=[\dKMm])\s*(?:-|–|to)\s*\$?(?=\d)", "~")
    pair = F.regexp_extract(tight, r"\$[\d.]+[KMm]?~[\d.]+[KMm]?", 0)
    sides = F.split(F.when(pair != "", pair).otherwise(F.regexp_extract(tight, r"\$[\d.]+[KMm]?", 0)), "~")
    unit = lambda i: F.nullif(F.regexp_extract(F.get(sides, i), "[KMm]$", 0), F.lit(""))
    low, high = _dollars(F.get(sides, 0), unit(0)), _dollars(F.get(sides, 1), F.coalesce(unit(1), unit(0)))
    some = (low > 0) | F.coalesce(high > 0, F.lit(False))
    low, high = F.when(some, low), F.when(some, F.coalesce(high, low))
    return F.struct(low.alias("min"), high.alias("max"), F.when(low.isNotNull(), "USD").alias("currency"))


def grouped_range(c: Column, symbol: str = "Kč") -> Column:
    """struct(min, max): whole amounts with digits in groups before a symbol, "55 000 – 60 000 Kč"; one amount has no max."""
    amount = r"(\d[\d\s\x{a0}\x{202f}]*)"
    shape = rf"{amount}\s*(?:[–-]\s*{amount})?\s*{symbol}"
    number = lambda i: F.regexp_replace(F.regexp_extract(c, shape, i), r"\D", "").try_cast("double")
    return F.struct(number(1).alias("min"), number(2).alias("max"))


def pay_component(c: Column) -> Column:
    """struct(min, max, currency, period) of the first salary component in JSON pay tiers; all null without one."""
    tiers = F.from_json(c, _TIERS)["compensationTiers"]
    parts = F.flatten(F.transform(F.filter(tiers, lambda t: t["components"].isNotNull()), lambda t: t["components"]))
    first = F.try_element_at(F.filter(parts, lambda p: p["compensationType"] == "Salary"), F.lit(1))
    period = F.lit(None).cast("string")
    for name, unit in PERIODS.items():
        period = F.when(first["interval"] == name, unit).otherwise(period)
    return F.struct(first["minValue"].alias("min"), first["maxValue"].alias("max"), first["currencyCode"].alias("currency"), F.when(first.isNotNull(), F.coalesce(period, F.lit("YEAR"))).alias("period"))
