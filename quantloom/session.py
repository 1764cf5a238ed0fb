"""Makes the library importable on executors, whatever their working folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the library's sources to the application, once; Spark hands them to each executor."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        home = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="quantloom-")) / "quantloom.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(home.rglob("*.py")):
                z.write(p, f"quantloom/{p.relative_to(home)}")
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)
    return spark
