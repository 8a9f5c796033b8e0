"""Make this package importable in Python workers that have it neither on PYTHONPATH nor in their folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Once a context, and only where needed: Spark sends a zip of the sources to all workers."""
    sc = spark.sparkContext
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(PACKAGE.parent) in known or os.path.exists(os.path.join(os.getcwd(), PACKAGE.name)) or getattr(sc, "_siftspark_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(), "siftspark_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(out)
    sc._siftspark_shipped = True
