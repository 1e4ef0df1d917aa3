"""Structured Streaming: keyed state, first occurrences, and an idempotent alert sink.

Sources are folders of Parquet files; triggers are availableNow, so a run takes what is there and its checkpoint
remembers the rest. Results are tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.staging import new_folder


def _work(spark: SparkSession) -> str:
    return new_folder(spark, "streams")


def source(spark: SparkSession, sf_dir: str, name: str, files: int = 8) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*" if not name.endswith("*") else f"{sf_dir}/{name}")


def _drain(stream: DataFrame, folder: str, write) -> None:
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def _latest(spark: SparkSession, folder: str, below: float = float("inf")) -> str | None:
    """The newest version of a state below a number, from the folder itself, so a restart finds it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = [int(n) for n in done if int(n) < below]
    return f"{folder}/state/{max(numbers)}" if numbers else None


def run_upsert(spark: SparkSession, sf_dir: str, name: str, folder: str | None = None) -> DataFrame:
    """first_seen, last_seen, check_count per user: each batch is merged into the state of the batch before.

    Kept for states that are to be tables; presence keeps its state in Spark's store and rewrites none of it.

    A batch writes its own version of the state, named by its number; a repeated batch writes the same again. With the
    folder of an earlier run the stream goes on behind what that run has read.
    """
    folder = folder or _work(spark)

    def write(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("check_count"))
        before = _latest(spark, folder, number)
        if before:
            both = spark.read.parquet(before).unionByName(new)
            new = both.groupBy("user_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("check_count").alias("check_count"))
        new.write.mode("overwrite").parquet(f"{folder}/state/{number}")

    _drain(source(spark, sf_dir, name), folder, write)
    return spark.read.parquet(_latest(spark, folder))


def run_first_seen(spark: SparkSession, sf_dir: str, name: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """The first row of each key over the whole stream (state grows with the keys; see within() for a bound)."""
    folder = folder or _work(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    _drain(source(spark, sf_dir, name).select(*keys).dropDuplicates(keys), folder, write)
    return spark.read.parquet(f"{folder}/out").select(*keys)


def within(stream: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key, with state kept for as long as rows may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def alerts(stream: DataFrame, eligible, key: str, sent: str, checkpoint: str):
    """Appends eligible rows whose key is not in the table `sent` yet; blank keys are never taken as sent."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where(eligible).dropDuplicates([key])
        try:
            old = spark.read.parquet(sent).where(F.col("__batch") != number).select(key)
            new = new.join(old.where(F.trim(F.col(key)) != ""), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{sent}/part={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
