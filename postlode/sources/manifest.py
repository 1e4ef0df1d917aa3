"""A manifest that several writers share: each change is a new version, and a version is created by one writer only.

A writer reads the newest version, changes it and creates the next one, which fails where another was faster; then it
starts over from that one. So no entry is lost, and a reader sees a whole version at any time. manifest.json beside
the versions is a copy for readers of the plain layout; it is what a folder of before has alone, and is taken over.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits of a version's name, so that names sort as numbers.
DIGITS = 10


def _paths(spark: SparkSession, path: str):
    """(Hadoop's FileContext of a path's store, a maker of paths)."""
    jvm = spark.sparkContext._jvm
    made = jvm.org.apache.hadoop.fs.Path
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(made(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration()), made


def _move(spark: SparkSession, path: str, body: str, temp: str, replace: bool) -> bool:
    """Writes a file beside its place and renames it there; False if the place is taken and not to be replaced."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    files, made = _paths(spark, path)
    fs = made(temp).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(made(temp), True)
    out.write(bytearray(body.encode()))
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if replace else kind.NONE
    try:
        files.rename(made(temp), made(path), how)
    except Exception as e:
        if replace or "FileAlreadyExistsException" not in str(e):
            raise
        fs.delete(made(temp), False)
        return False
    return True


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def latest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """(number, manifest) of the newest version; (0, what manifest.json holds, or {}) where there is none yet.

    A manifest.json that is no JSON object counts as {}: the next version starts afresh.
    """
    files, made = _paths(spark, folder)
    fs = made(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    place = made(f"{folder}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if numbers:
        return max(numbers), json.loads(_text(spark, f"{folder}/manifests/{max(numbers):0{DIGITS}d}.json"))
    if not fs.exists(made(f"{folder}/manifest.json")):
        return 0, {}
    try:
        found = json.loads(_text(spark, f"{folder}/manifest.json"))
    except ValueError:
        return 0, {}
    return 0, found if isinstance(found, dict) else {}


def update(spark: SparkSession, folder: str, change: Callable[[dict], dict], writer: str, tries: int = 100) -> dict:
    """Puts change(newest manifest) in place as the next version, and returns it.

    change may run more than once, on a newer manifest each time, so it only computes. What it raises stops the update
    with nothing written. writer names this writer's temporary file.
    """
    files, made = _paths(spark, folder)
    made(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(made(f"{folder}/manifests"))
    for _ in range(tries):
        number, before = latest(spark, folder)
        new = change(dict(before))
        body = json.dumps(new, sort_keys=True)
        if _move(spark, f"{folder}/manifests/{number + 1:0{DIGITS}d}.json", body, f"{folder}/manifests/.{writer}.tmp", False):
            newest = latest(spark, folder)[1]
            _move(spark, f"{folder}/manifest.json", json.dumps(newest, sort_keys=True), f"{folder}/manifests/.{writer}.copy", True)
            return new
    raise RuntimeError(f"{folder}: other writers were faster {tries} times")


def sums(files: DataFrame, by: str) -> DataFrame:
    """by, files, size, sha256 of groups of files (path, size, sha256): the sum of a group is the one of its files' sums in order of their paths.

    One row a file is gathered for each group, never a file's content.
    """
    listed = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), F.sha2(F.array_join(F.transform(listed, lambda x: x["sha256"]), ""), 256).alias("sha256"))
