"""Dumps of threat-intelligence answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_feed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``ip, provider, payload`` from JSON lines; a nested payload is kept as its JSON text."""
    return spark.read.schema("ip STRING, provider STRING, payload STRING").json(path)
