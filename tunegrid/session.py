"""Spark session used by tests, the bench and local runs."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

REPO = str(Path(__file__).resolve().parents[1])


def local_session(cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution on; cluster runs bring their own session."""
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, os.environ.get("PYTHONPATH", "")) if x)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tunegrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TUNEGRID_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
