"""Sessions, and the way of this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "rasterlens") -> SparkSession:
    """A session on this machine, for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the executors' Python workers, once an application.

    Where ``PYTHONPATH`` names the package's folder already there is nothing to do.
    """
    sc = spark.sparkContext
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_rasterlens_shipped", False):
        return spark
    out = Path(tempfile.mkdtemp(prefix="rasterlens-")) / "rasterlens_src.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    sc.addPyFile(str(out))
    sc._rasterlens_shipped = True
    return spark
