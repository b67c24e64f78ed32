"""Sending this package to executors that may not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def send_package(spark: SparkSession) -> None:
    """Ships the package's modules with the session's jobs, once a session; functions that run on executors need them."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    with zipfile.ZipFile(to := Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry_package.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(to))
    sc._quarry_sent = True
