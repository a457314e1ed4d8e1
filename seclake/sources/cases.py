"""Structured case files (CSV with a fixed header)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..schema import CASE, EVENT_FIELDS


def read_cases(
    spark: SparkSession, path: str | list[str], year: int | str | None = None
) -> DataFrame:
    """Case rows as events: text in ``message``, empty cells kept as empty strings."""
    raw = (
        spark.read.schema(CASE)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .csv(path)
    )
    order = F.struct(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    known = set(CASE.fieldNames())
    # An unquoted empty cell is read as NULL; in a case file it is an empty value.
    fields = [
        f"coalesce({name}, '') as {name}" if name in known else f"cast(null as string) as {name}"
        for name in EVENT_FIELDS
    ]
    ordered = raw.select("*", F.col("_metadata.file_path").alias("file"), order.alias("seq"))
    return ordered.selectExpr(
        "file", "seq", "'case' as format", f"{times.event_time('timestamp', year)} as event_ts", *fields
    )
