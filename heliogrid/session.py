"""Session settings that the engine's semantics need, and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Wall-clock columns are naive UTC; a snapshot map keeps the last of two equal metric names.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
}


def session(app: str = "heliogrid", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_heliogrid_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="heliogrid-zip-"), "heliogrid.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(at)  # the driver serves it; executors fetch their own copy
    sc._heliogrid_shipped = True
