"""The package itself for the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so that nothing has to be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="quern-")) / "quern_package.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(str(to))
    sc._quern_shipped = True
