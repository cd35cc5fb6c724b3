"""Sends the package to the executors where they couldn't import it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, unless workers inherit a path to it."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    inherited = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _SENT or any(p and Path(p).resolve() == root for p in inherited):
        return
    _SENT.add(app)
    target = Path(tempfile.mkdtemp(prefix="package-")) / "tessera.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "tessera").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
