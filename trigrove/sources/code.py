"""This package's modules for the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the modules to the executors, once a session, so that they need not have the package installed."""
    sc = spark.sparkContext
    if getattr(sc, "_trigrove_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="trigrove-code-")) / "trigrove_code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(at))
    sc._trigrove_shipped = True
