"""Making the package known to a session's Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once; Spark hands it to every executor."""
    context = spark.sparkContext
    if getattr(context, "_gaugeworks_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="gaugeworks-"), "gaugeworks"), "zip", root, "gaugeworks")
    context.addPyFile(archive)
    context._gaugeworks_shipped = True
