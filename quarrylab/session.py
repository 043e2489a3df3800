"""A Spark session with the settings the library expects."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Identifiers may be written "so", as in the SQL that users bring along.
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_spark(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("quarrylab").config(map=CONF | conf)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one, for all of a session, only where none is named and no other machine works."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = spark.sparkContext.applicationId
        named = _folders.get(own) or _folders.setdefault(own, tempfile.mkdtemp(prefix="spark-shared-"))
    return named.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once a session, unless PYTHONPATH brings it there already."""
    package = Path(__file__).resolve().parent
    context = spark.sparkContext
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_quarrylab_shipped", False):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='quarrylab-')}/quarrylab", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._quarrylab_shipped = True
