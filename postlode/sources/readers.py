"""Reading landed postings, registries, JSON files and published datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.functions import values
from postlode.sources import manifest
from postlode.sources.schema import COLUMNS, POSTING

#: Column names under which registries give a company's name.
NAME_ALIASES = ("company", "company_name", "name", "employer", "organization")


def postings(spark: SparkSession, folder: str, file: str = "jobs.csv", skip: tuple[str, ...] = ("custom",)) -> DataFrame:
    """folder/<source>/<file> of all sources but those to skip, as text columns of the posting schema, with ats_type from the path.

    Each file is read by its own header: only columns it has by name are filled, in any order or case, and ids never
    become numbers. Files without a byte have no rows, as have those with a header alone. row_order is the number of
    the file among the files and of the row in it, so it stays as long as the files do.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", file).option("recursiveFileLookup", "true").load(folder).where("length > 0").select("path").collect()
    out = spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS) + ", row_order long")
    for number, path in enumerate(sorted(r["path"] for r in listed)):
        source = path.rsplit("/", 2)[-2]
        if source in skip:
            continue
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
        own = {c.lower().strip("\ufeff "): c for c in raw.columns}
        # A file of many-line records is one task, so the low bits of the id are the row's number in the file.
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(number << 33)
        columns = [F.lit(source).alias("ats_type") if c == "ats_type" else (F.col(f"`{own[c]}`") if c in own else F.lit(None).cast("string")).alias(c) for c in COLUMNS]
        out = out.unionByName(raw.select(*columns, row.alias("row_order")))
    return out


def typed(df: DataFrame) -> DataFrame:
    """Text columns cast to the posting schema; what does not fit becomes null."""
    kinds = dict(f.split() for f in POSTING.split(", "))
    return df.select(*(F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns))


def with_global_id(df: DataFrame) -> DataFrame:
    """Adds global_id to datasets of before it, where its inputs are there."""
    if "global_id" in df.columns or not {"ats_type", "ats_id"} <= set(df.columns):
        return df
    return df.withColumn("global_id", values.global_id(F.col("ats_type"), F.col("ats_id")))


def registry_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """company from whichever alias df has; rows without one go."""
    own = {c.lower().strip("﻿ "): c for c in df.columns}
    found = [F.col(f"`{own[a]}`") for a in NAME_ALIASES if a in own]
    name = F.coalesce(*found) if found else F.lit(None).cast("string")
    return df.select(*keep, name.alias("company")).where("trim(company) <> ''")


def registry(spark: SparkSession, *paths: str) -> DataFrame:
    """company, slug, url of CSV files whose headers differ."""
    out = None
    for path in paths:
        df = spark.read.csv(path, header=True, encoding="UTF-8")
        own = {c.lower(): c for c in df.columns}
        df = df.select(*df.columns, *(F.lit(None).cast("string").alias(c) for c in ("slug", "url") if c not in own))
        df = registry_columns(df, ["slug", "url"])
        out = df if out is None else out.unionByName(df)
    return out


def json_records(spark: SparkSession, path: str, schema: str, root: str = "results") -> DataFrame:
    """Objects of JSON files that hold a list, or an object with the list under root."""
    whole = spark.read.text(path, wholetext=True)
    bare = F.ltrim("value").startswith("[")
    items = F.when(bare, F.from_json("value", f"array<struct<{schema}>>")).otherwise(F.from_json("value", f"struct<{root}: array<struct<{schema}>>>")[root])
    return whole.select(F.explode(items).alias("item")).where("item is not null").select("item.*")


class Dataset:
    """A published dataset: its manifest, and the files it names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.manifest = manifest.latest(spark, folder)[1]
        if not self.manifest:
            raise ValueError(f"{folder} has no manifest")

    def load(self, source: str | None = None, date: str | None = None) -> DataFrame:
        """All rows, or one source's, or one date's; Parquet before CSV."""
        if source and date:
            raise ValueError("a source or a date, not both")
        entry = self.manifest["by_ats"][source]["jobs"] if source else self.manifest["by_date"][date] if date else self.manifest["all"]
        if entry.get("parquet"):
            return with_global_id(self.spark.read.parquet(f"{self.folder}/{entry['parquet']}"))
        return with_global_id(typed(self.spark.read.csv(f"{self.folder}/{entry['csv']}", header=True, multiLine=True, escape='"')))
