"""The operational tables as frames: upsert, histories, queue, missing rows. Each returns the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(state: DataFrame, batch: DataFrame, key: str, now: Column, keep: tuple[str, ...] = ("first_seen",)) -> DataFrame:
    """state with the rows of batch: the last row of a key wins, columns in keep stay, check_count and last_seen move.

    state has key, its own columns, first_seen, last_seen, check_count, status. Keys seen are ACTIVE again.
    """
    own = [c for c in batch.columns if c not in ("__order", key)]
    w = Window.partitionBy(key).orderBy(F.desc("__order"))
    last = (batch if "__order" in batch.columns else batch.withColumn("__order", F.monotonically_increasing_id())).withColumn("__r", F.row_number().over(w)).where("__r = 1")
    new = last.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in own), F.lit(True).alias("__seen"))
    joined = state.join(new, key, "full_outer")
    seen = F.coalesce("__seen", F.lit(False))
    out = []
    for c in state.columns:
        if c == key:
            out.append(F.col(key))
        elif c == "check_count":
            out.append((F.coalesce(c, F.lit(0)) + F.when(seen, 1).otherwise(0)).alias(c))
        elif c == "last_seen":
            out.append(F.when(seen, now).otherwise(F.col(c)).alias(c))
        elif c == "status":
            out.append(F.when(seen, F.lit("ACTIVE")).otherwise(F.col(c)).alias(c))
        elif c == "first_seen":
            out.append(F.coalesce(c, now).alias(c))
        elif c in own and c not in keep:
            out.append(F.when(seen, F.coalesce(f"__{c}", c)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def bulk_upsert(state: DataFrame, batch: DataFrame, key: str, now: Column, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(state after the good rows of batch, the bad rows with error): a row without key or a required value is bad.

    One bad row keeps no other out; of rows with one key the later wins, as in upsert().
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    error = F.coalesce(*(F.when(blank(c), F.lit(f"{c} is missing")) for c in (key, *required)))
    return upsert(state, batch.where(error.isNull()), key, now), batch.withColumn("error", error).where("error is not null")


def change_log(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Rows where a key's value differs from its value before, with old_value."""
    old = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("old_value", old).where(F.col("old_value").isNotNull() & (F.col("old_value") != F.col(value)))


def missing(active: DataFrame, scan: DataFrame, key: str) -> DataFrame:
    """Active rows that a full scan did not return."""
    return active.join(scan.select(key).distinct(), key, "left_anti")


def enqueue(rows: DataFrame, queue: DataFrame, key: str) -> DataFrame:
    return rows.join(queue.select(key), key, "left_anti")


def cleanup(queue: DataFrame, rows: DataFrame, key: str, eligible: Column) -> DataFrame:
    """Queue rows that still have an eligible row behind them."""
    return queue.join(rows.where(eligible).select(key).distinct(), key, "left_semi")


def expired(df: DataFrame, started: str, now: Column, minutes: int = 30) -> DataFrame:
    return df.where(F.col(started) < now - F.make_dt_interval(mins=F.lit(minutes)))


#: Fixed value: what a recovered row's error says.
RECOVERED = "RECOVERED_AFTER_STALE_PROCESS"


def recovered(queue: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """queue (started_at, processed_at, error and more) with rows that were started too long ago and never ended free again."""
    stale = F.coalesce(F.col("processed_at").isNull() & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes))), F.lit(False))
    put = {"started_at": F.when(~stale, F.col("started_at")), "error": F.when(stale, F.lit(RECOVERED)).otherwise(F.col("error"))}
    return queue.select(*(put.get(c, F.col(c)).alias(c) for c in queue.columns))


def sparse_update(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Values of new where they are not null, else those of df."""
    fields = [c for c in new.columns if c != key and c in df.columns]
    joined = df.join(new.select(key, *(F.col(c).alias(f"__{c}") for c in fields)), key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns))


def mark(queue: DataFrame, done: DataFrame, key: str, now: Column) -> DataFrame:
    """queue with started_at, processed_at, result, error of the rows in done (key, result, error) set."""
    new = done.select(key, F.col("result").alias("__result"), F.col("error").alias("__error"), F.lit(True).alias("__done"))
    joined = queue.join(new, key, "left")
    hit = F.coalesce("__done", F.lit(False))
    put = {"processed_at": now, "result": F.col("__result"), "error": F.col("__error"), "started_at": F.coalesce("started_at", now)}
    return joined.select(*(F.when(hit, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in queue.columns))


def quarantine(held: DataFrame, failed: DataFrame, healed: DataFrame, key: str, now: Column) -> DataFrame:
    """held (key, reason, failure_count, last_failure) with one failure more for those in failed, without those healed."""
    one = failed.groupBy(key).agg(F.max("reason").alias("reason")).select(key, "reason", F.lit(1).cast("long").alias("failure_count"), now.alias("last_failure"))
    both = held.select(key, "reason", F.col("failure_count").cast("long").alias("failure_count"), "last_failure").unionByName(one)
    merged = both.groupBy(key).agg(F.max_by("reason", F.struct(F.col("last_failure").isNotNull(), "last_failure")).alias("reason"), F.sum("failure_count").alias("failure_count"), F.max("last_failure").alias("last_failure"))
    return merged.join(healed.select(key), key, "left_anti")


def set_status(df: DataFrame, changes: DataFrame, key: str, column: str, now: Column, always: bool = False) -> tuple[DataFrame, DataFrame]:
    """(df with the new values of column, history rows: key, old_value, new_value, changed_at).

    changes: key (unique), column. Keys that df lacks do nothing; an equal value makes no history unless always.
    """
    joined = df.join(changes.select(key, F.col(column).alias("__new")), key, "left")
    put = joined.select(*(F.coalesce("__new", c).alias(c) if c == column else F.col(c) for c in df.columns))
    moved = F.col("__new").isNotNull() & (F.lit(always) | ~F.col("__new").eqNullSafe(F.col(column)))
    return put, joined.where(moved).select(key, F.col(column).alias("old_value"), F.col("__new").alias("new_value"), now.alias("changed_at"))


def finish_scans(scans: DataFrame, results: DataFrame, key: str, now: Column) -> DataFrame:
    """Open scans (key, started_at, finished_at, status, and counters) closed by results: key, error, and counters."""
    counters = [c for c in results.columns if c not in (key, "error") and c in scans.columns]
    joined = scans.join(results.select(key, F.col("error").alias("__error"), *(F.col(c).alias(f"__{c}") for c in counters), F.lit(True).alias("__done")), key, "left")
    hit = F.coalesce("__done", F.lit(False)) & F.col("finished_at").isNull()
    put = {"finished_at": now, "status": F.when(F.col("__error").isNull(), "COMPLETED").otherwise("FAILED")} | {c: F.coalesce(f"__{c}", c) for c in counters}
    return joined.select(*(F.when(hit, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in scans.columns))


def repair(queue: DataFrame, rows: DataFrame, key: str, columns: list[str], broken: Column) -> DataFrame:
    """Broken queue rows with the missing values among columns filled from rows (key unique); others as they are."""
    joined = queue.join(rows.select(key, *(F.col(c).alias(f"__{c}") for c in columns)), key, "left")
    return joined.select(*(F.when(broken, F.coalesce(c, f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in queue.columns))


def add_counts(totals: DataFrame, cycle: DataFrame, key: str) -> DataFrame:
    """Counters per key carried on: totals plus the rows of one cycle."""
    counters = [c for c in totals.columns if c != key]
    return totals.select(key, *counters).unionByName(cycle.select(key, *counters)).groupBy(key).agg(*(F.sum(c).alias(c) for c in counters))
