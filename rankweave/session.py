"""Sending this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers on every executor import this package, whatever their working folder; done once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SENT:
        root = Path(__file__).resolve().parent
        at = os.path.join(tempfile.mkdtemp(prefix="rankweave-ship-"), "rankweave.zip")
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, p.relative_to(root.parent))
        sc.addPyFile(at)
        _SENT.add(sc.applicationId)
    return spark
