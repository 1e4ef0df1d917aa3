"""Sends this package to the executors, for sessions whose Python workers do not find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_NAME = "postlode-src.zip"


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once per application."""
    sc = spark.sparkContext
    if any(os.path.basename(f) == _NAME for f in sc._python_includes):
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="postlode-")) / _NAME
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
