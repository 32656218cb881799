"""Brings this package to the executors, which may not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per session, before Python code of this package runs on executors."""
    context = spark.sparkContext
    if getattr(context, "_weft_shipped", False):
        return
    here = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="weft-")) / "weft_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(str(to))
    context._weft_shipped = True
