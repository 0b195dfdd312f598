"""Makes this package importable in Python workers of any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's source as a zip to the session's Python files, once per context.

    Spark's own file server hands it to executors, also to those that join later.
    """
    context = spark.sparkContext
    if getattr(context, "_tallyloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tallyloom-")) / "tallyloom_src.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._tallyloom_shipped = True
