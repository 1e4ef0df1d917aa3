"""Publishing: slices per source, the deduplicated snapshot, a manifest written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.functions import values
from postlode.operators import dedup
from postlode.sources import manifest as manifests


def enrich(df: DataFrame) -> DataFrame:
    """Adds what is missing: is_remote and salaries only as new columns, countries only where blank."""
    if "is_remote" not in df.columns and "title" in df.columns:
        df = df.withColumn("is_remote", values.remote_from_title(F.col("title")))
    if "salary_min" not in df.columns and "salary_max" not in df.columns and "salary_summary" in df.columns:
        df = df.withColumn("__s", values.salary_range(F.col("salary_summary"))).withColumn("salary_min", F.col("__s.min")).withColumn("salary_max", F.col("__s.max")).drop("__s")
    if "location" in df.columns:
        own = F.nullif(F.trim("country_iso"), F.lit("")) if "country_iso" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("country_iso", F.coalesce(own, values.country_of(F.col("location"))))
    return df


def _rows(entry: object) -> int:
    n = entry.get("rows") if isinstance(entry, dict) else None
    return n if isinstance(n, int) and n > 0 else 0


def guard_empty(counts: dict[str, int], before: dict, allow: bool = False) -> None:
    """A source that had rows, or still has companies, and now has none stops the run; allow lets it pass.

    before: the manifest so far; by_ats holds entries with rows (or jobs, an entry of its own), by_ats_companies too.
    """
    if allow:
        return
    part = lambda name: found if isinstance(found := before.get(name), dict) else {}
    jobs = {s: e.get("jobs", e) if isinstance(e, dict) else e for s, e in part("by_ats").items()}
    companies = part("by_ats_companies")
    gone = [f"{s} ({_rows(jobs.get(s))} rows, {_rows(companies.get(s))} companies before)" for s in sorted(jobs | companies) if _rows(jobs.get(s)) + _rows(companies.get(s)) and not counts.get(s)]
    if gone:
        raise ValueError(f"sources without rows that had some: {', '.join(gone)}")


def prune(spark: SparkSession, folder: str, prefixes: tuple[str, ...] = ("jobs", "companies")) -> int:
    """Deletes what an older layout left below a folder; returns how many of these were there. Repeatable."""
    jvm, n = spark.sparkContext._jvm, 0
    for p in prefixes:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{p}")
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def export_json(df: DataFrame, folder: str, by: str) -> DataFrame:
    """Writes rows as JSON lines, and beside them their number by a column; returns these numbers."""
    df.write.json(f"{folder}/rows")
    counts = df.sparkSession.read.schema(df.schema).json(f"{folder}/rows").groupBy(by).count()
    counts.write.json(f"{folder}/statistics")
    return counts


def publish(df: DataFrame, folder: str, generated_at: str, before: dict | None = None, version: str = "1", allow_empty: bool = False) -> dict:
    """Writes slices (never deduplicated) and the snapshot (deduplicated), then the manifest; returns it.

    df: postings with source in ats_type and row_order. Data lies in a folder of its own per run and the manifest
    moves to it last, so a run that fails leaves the one before in place. The entries of jobs replace those of the
    newest manifest of the folder (before, where the folder has none), whatever else other writers put there stays. Each entry
    has the rows, files, size and sha256 of what it names.
    """
    spark = df.sparkSession
    so_far = lambda newest: newest or before or {}
    run = f"runs/{generated_at}"
    rich = enrich(df)
    counts = {r[0]: r[1] for r in rich.groupBy("ats_type").count().collect()}
    guard_empty(counts, so_far(manifests.latest(spark, folder)[1]), allow_empty)
    rich.repartition("ats_type", F.pmod(F.xxhash64("row_order"), F.lit(8))).write.partitionBy("ats_type").option("compression", "zstd").parquet(f"{folder}/{run}/by_ats")
    kept = dedup.survivors(rich.withColumnRenamed("ats_type", "source")).withColumnRenamed("source", "ats_type").drop("row_order")
    kept.write.option("compression", "zstd").parquet(f"{folder}/{run}/all.parquet")
    spark.read.parquet(f"{folder}/{run}/all.parquet").write.option("escape", '"').csv(f"{folder}/{run}/all.csv", header=True)
    rows = spark.read.parquet(f"{folder}/{run}/all.parquet").count()
    files = checksums(spark, f"{folder}/{run}").where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]"))
    parts = (F.regexp_extract("path", "/by_ats/ats_type=([^/]*)/", 1), F.regexp_extract("path", r"/all\.(parquet|csv)/", 1))
    named = files.withColumn("name", F.when(parts[1] != "", parts[1]).otherwise(F.concat(F.lit("="), parts[0])))
    found = {r["name"]: {k: r[k] for k in ("files", "size", "sha256")} for r in manifests.sums(named, "name").collect()}

    def change(newest: dict) -> dict:
        newest = so_far(newest)
        guard_empty(counts, newest, allow_empty)
        kept = {k: v for k, v in newest.items() if k not in ("by_date", "companies_by_ats")}
        return kept | {
            "version": version,
            "generated_at": generated_at,
            "updated_at": generated_at,
            "stats": {"total_jobs": rows, "ats_count": len(counts)},
            "all": {"parquet": f"{run}/all.parquet", "csv": f"{run}/all.csv", "rows": rows, "sums": {k: found.get(k) for k in ("parquet", "csv")}},
            "by_ats": {s: {"jobs": {"parquet": f"{run}/by_ats/ats_type={s}", "rows": n} | found.get(f"={s}", {})} for s, n in sorted(counts.items())},
        }

    return manifests.update(spark, folder, change, f"jobs-{generated_at}")


def publish_companies(df: DataFrame, folder: str, generated_at: str) -> dict:
    """Writes companies (ats_type and more) by source and puts their entries into the manifest that jobs share; returns it.

    Entries of jobs stay as they are. Rows without a source lie in the entry "all" alone.
    """
    spark, run = df.sparkSession, f"companies/{generated_at}"
    df.repartition("ats_type").write.option("compression", "zstd").partitionBy("ats_type").parquet(f"{folder}/{run}")
    counts = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/{run}").groupBy("ats_type").count().collect()}

    def change(newest: dict) -> dict:
        by = {s: {"parquet": f"{run}/ats_type={s}", "rows": n} for s, n in sorted((s, n) for s, n in counts.items() if s is not None)}
        return newest | {"updated_at": generated_at, "companies": {"parquet": run, "rows": sum(counts.values())}, "by_ats_companies": by}

    return manifests.update(spark, folder, change, f"companies-{generated_at}")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, sha256 of a folder's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
