"""What a session needs to run this package's Python code on its executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_adspectra_shipped", False):
        return
    base = Path(tempfile.mkdtemp(prefix="adspectra-")) / PACKAGE.name
    sc.addPyFile(shutil.make_archive(str(base), "zip", PACKAGE.parent, PACKAGE.name))
    sc._adspectra_shipped = True
