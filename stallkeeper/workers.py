"""Letting Python workers import this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def ready(spark: SparkSession) -> None:
    """Adds the code's folder to the workers' path.

    A cluster gets the package with --py-files; where driver and workers share the folder,
    its path is enough.
    """
    home = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{home}:{known}".strip(":")
