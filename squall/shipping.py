"""Makes this package importable on every executor, wherever the driver was started."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package as a Python file of the application, once."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    if context.applicationId not in _SHIPPED and package.is_dir():
        folder = tempfile.mkdtemp(prefix="squall-")
        staged = Path(folder) / "tree"
        shutil.copytree(package, staged / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(f"{folder}/{package.name}_package", "zip", staged)
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark
