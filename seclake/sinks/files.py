"""Event tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _plain(events: DataFrame) -> DataFrame:
    """Without the order key; formats for people carry no nested columns."""
    return events.select(*[c for c, t in events.dtypes if not t.startswith(("struct", "array"))])


def write_csv(events: DataFrame, path: str) -> None:
    _plain(events).write.option("header", True).option("escape", '"').csv(path)


def write_json(events: DataFrame, path: str) -> None:
    """One JSON object per line; missing fields are left out."""
    _plain(events).write.json(path)


def write_table(events: DataFrame, path: str) -> None:
    """Parsed events as parquet, one folder per day: parse once, query many times.

    Events without a time have no day: their ``event_date`` is NULL.  Rows are dealt out by day before they are
    written, so a day has few files; large days are split, small ones share a task.
    """
    dated = events.withColumn("event_date", F.to_date("event_ts"))
    dated.hint("rebalance", F.col("event_date")).write.partitionBy("event_date").parquet(path)
