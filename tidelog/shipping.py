"""Sends the package to Python workers, which need not have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: the package's sources as a zip for all executors."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tidelog-")
    atexit.register(shutil.rmtree, folder, True)
    target = Path(folder) / "tidelog_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, Path("tidelog") / p.relative_to(top))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
