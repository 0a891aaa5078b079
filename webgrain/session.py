"""Session settings for the engine."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # html rows are fat: small Arrow batches bound a Python worker's memory
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; a local one also gets few shuffle partitions."""
    builder = SparkSession.builder.appName("webgrain")
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            settings = {"spark.sql.shuffle.partitions": str(os.cpu_count() or 8), "spark.ui.enabled": "false"} | settings
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a session: they need not have it."""
    context = spark.sparkContext
    if getattr(context, "_webgrain_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="webgrain")) / "webgrain.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._webgrain_shipped = True
