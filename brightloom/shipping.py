"""Sending this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets executors import this package: unless PYTHONPATH has its folder, Spark sends it to them as a zip, once an application."""
    root, app = Path(__file__).resolve().parents[1], spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    out = Path(tempfile.mkdtemp(prefix="brightloom-"), "brightloom.zip")  # on the driver, which serves it
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted((root / "brightloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)
