"""Filters and look-ups: literal search, company directory, top-k lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has(c: Column, needle: str) -> Column:
    """Literal substring without regard to case; null holds nothing."""
    return F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))


def search(df: DataFrame, title: str = "", location: str = "", company: str = "", remote: bool | None = None, salary_min: float | None = None, salary_max: float | None = None, experience_max: int | None = None, limit: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows that meet all given conditions, or the first `limit` of them in the order given.

    Conditions on columns that df lacks are left out, or use the location.
    """
    tests: list[Column] = [has(F.col(c), x) for c, x in (("title", title), ("location", location), ("company", company)) if x]
    if remote is not None:
        says = has(F.col("location"), "remote") if "location" in df.columns else F.lit(False)
        if "is_remote" in df.columns:
            known = F.col("is_remote")
            tests.append(F.coalesce(known, says) if remote else F.coalesce(~known, F.lit(False)))
        else:
            tests.append(says if remote else ~says)
    if salary_min is not None and "salary_max" in df.columns:
        tests.append(F.coalesce("salary_max", F.lit(0.0)) >= salary_min)
    if salary_max is not None and "salary_min" in df.columns:
        tests.append(F.coalesce("salary_min", F.lit(float("inf"))) <= salary_max)
    if experience_max is not None and "experience" in df.columns:
        tests.append(F.coalesce("experience", F.lit(0)) <= experience_max)
    found = df.where(reduce(lambda a, b: a & b, tests)) if tests else df
    if limit is None:
        return found
    return (found.orderBy(*order) if order else found).limit(limit)


def find_company(df: DataFrame, needle: str, name: str = "name", slug: str = "slug", order: str = "name") -> DataFrame:
    """Companies whose name or slug holds the needle: equal slugs first, then equal names, then the rest."""
    n = needle.strip().lower()
    if not n:
        return df.limit(0)
    miss = lambda c: F.when(F.lower(F.coalesce(F.col(c), F.lit(""))) == n, 0).otherwise(1)
    return df.where(has(F.col(name), n) | has(F.col(slug), n)).withColumn("match_rank", 2 * miss(slug) + miss(name)).orderBy("match_rank", order)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def first_batch(df: DataFrame, key: str, share: int = 30, most: int = 500) -> DataFrame:
    """The oldest max(1, share % of min(size, most)) rows. The size is one number; rows come by a top-k."""
    n = max(1, min(df.count(), most) * share // 100)
    return df.orderBy(key).limit(n)
