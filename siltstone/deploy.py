"""Sending this package to the executors of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the session's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="siltstone-")) / "siltstone.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(here.rglob("*.py")):
            archive.write(file, str(file.relative_to(here.parent)))
    context.addPyFile(str(target))
    _SENT.add(context.applicationId)
