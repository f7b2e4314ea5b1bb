"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HOME = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers, once for each application, unless they find it anyway."""
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if str(HOME.parent) in (os.path.realpath(p) for p in known if p) or spark.sparkContext.applicationId in _sent:
        return spark
    path = Path(tempfile.mkdtemp(prefix="lagweave-")) / "lagweave.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in HOME.rglob("*.py"):
            z.write(f, f.relative_to(HOME.parent))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(spark.sparkContext.applicationId)
    return spark
