"""Spark sessions of the engine, and the way its code gets to Python workers."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "lattica", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; the cluster's own settings stay unless named."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_lattica_core_shipped", False):
        return
    package = Path(__file__).resolve().parent
    holder = tempfile.TemporaryDirectory(prefix="lattica-")
    atexit.register(holder.cleanup)
    archive = f"{holder.name}/lattica_core.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)
    sc._lattica_core_shipped = True


_holder: tempfile.TemporaryDirectory | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    On one machine a temporary folder stands in where none is named; a cluster must name one.
    """
    global _holder
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _holder is None:
        _holder = tempfile.TemporaryDirectory(prefix="lattica-")
        atexit.register(_holder.cleanup)
    return "file://" + _holder.name
