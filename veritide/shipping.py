"""Sends this package to the executors, for Python code that runs there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the executors' path, once per application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).parent
    at = os.path.join(tempfile.mkdtemp(prefix="veritide-"), "veritide.zip")
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(at)
    _sent.add(context.applicationId)
