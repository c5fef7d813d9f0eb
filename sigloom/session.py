"""Making this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to all executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_sigloom_shipped", False):
        return spark
    handle, path = tempfile.mkstemp(prefix="sigloom_src_", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, Path(PACKAGE.name) / file.relative_to(PACKAGE))
    context.addPyFile(path)
    context._sigloom_shipped = True
    return spark
