"""Postings of any source as rows of the store, and descriptions from earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlode.functions import values
from postlode.functions.text import strip

MOST_DESCRIPTION = 25_000
TEXT = ("url", "apply_url", "title", "company", "location", "ats_type", "ats_id", "global_id", "requisition_id", "department", "team", "commitment", "description", "country_iso")


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def to_store(df: DataFrame, now: Column) -> DataFrame:
    """One row a posting: stripped texts (blank is null), URL fall-backs, work_mode, fingerprint, confidence inputs.

    Columns that df lacks are null. is_remote true, false, null become REMOTE, ONSITE, UNKNOWN; the application URL falls
    back on the posting's and the other way round. The fingerprint is of the global id where there is one, else of
    company, title, location and URL. Rows without a title or any URL are left out, as nothing could show them.
    """
    clean = {c: F.nullif(strip(_column(df, c).cast("string")), F.lit("")) for c in TEXT}
    remote = values.flag(_column(df, "is_remote"))
    out = df.select(*(e.alias(c) for c, e in clean.items()), remote.alias("remote_flag"), _column(df, "salary_min", "double").cast("double").alias("salary_min"), _column(df, "salary_max", "double").cast("double").alias("salary_max"), _column(df, "posted_at", "timestamp").alias("posted_at"))
    out = out.withColumns({"url": F.coalesce("url", "apply_url"), "apply_url": F.coalesce("apply_url", "url"), "description": F.substring("description", 1, MOST_DESCRIPTION)})
    mode = F.when(F.col("remote_flag") == 1, "REMOTE").when(F.col("remote_flag") == 0, "ONSITE").otherwise("UNKNOWN")
    mark = F.when(F.col("global_id").isNotNull(), values.fingerprint(F.col("global_id"))).otherwise(values.fingerprint(F.col("company"), F.col("title"), F.col("location"), F.col("url")))
    return out.where(F.col("title").isNotNull() & F.col("url").isNotNull()).withColumns({"work_mode": mode, "fingerprint": mark, "fetched_at": now}).drop("remote_flag")


def fill_descriptions(df: DataFrame, cache: DataFrame, keys: list[str], most: int = MOST_DESCRIPTION) -> DataFrame:
    """df with missing or blank descriptions from cache (keys, description; the longest of a key), cut at most characters.

    Only rows without a description meet the cache; null keys match nothing.
    """
    blank = F.coalesce(F.trim("description"), F.lit("")) == ""
    known = cache.where(F.coalesce(F.trim("description"), F.lit("")) != "").groupBy(*keys).agg(F.max_by("description", F.struct(F.length("description"), "description")).alias("__found"))
    filled = df.where(blank).join(known, keys, "left").withColumn("description", F.substring(F.coalesce("__found", "description"), 1, most))
    return df.where(~blank).unionByName(filled.select(*df.columns))


def to_fetch(df: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose description must be fetched: blank, and not in the cache."""
    missing = df.where(F.coalesce(F.trim("description"), F.lit("")) == "")
    return missing.join(cache.where(F.coalesce(F.trim("description"), F.lit("")) != "").select(*keys).distinct(), keys, "left_anti")
