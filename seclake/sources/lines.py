"""Log lines from files and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip


def _line_columns(df: DataFrame) -> DataFrame:
    # File, split start and row id together order the lines of a file; row ids
    # alone do not, since Spark packs splits into tasks by size.
    order = F.struct(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    return df.select(
        F.col("_metadata.file_path").alias("file"), order.alias("seq"), F.expr(strip("value")).alias("line")
    ).where("line <> ''")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All non-blank lines of text files, stripped, with their file and order."""
    return _line_columns(spark.read.text(path))


def stream_lines(
    spark: SparkSession,
    path: str,
    process_existing: bool = True,
    started_at: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Lines of the files arriving in a directory.

    ``process_existing=False`` follows from now on: files last changed before
    ``started_at`` (default: the moment of the call) are passed over.
    """
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.text(path)
    if not process_existing:
        if started_at is None:
            started_at = spark.range(1).select(F.current_timestamp().cast("string")).first()[0]
        start = F.to_timestamp(F.lit(started_at))
        raw = raw.where(F.col("_metadata.file_modification_time") >= start)
    return raw.selectExpr("_metadata.file_path as file", f"{strip('value')} as line").where("line <> ''")


def message_lines(messages: DataFrame, value: str = "value", source: str | None = None) -> DataFrame:
    """Lines from network messages (socket or Kafka rows), one message per line.

    Bytes which are no UTF-8 are dropped; ``source`` names the sender column.
    """
    body = value
    if dict(messages.dtypes)[value] == "binary":
        # Valid text stays as it is; undecodable bytes become U+FFFD, which is removed.
        text = f"cast({value} as string)"
        body = f"coalesce(try_validate_utf8({text}), replace(make_valid_utf8({text}), '\\uFFFD', ''))"
    return messages.selectExpr(
        f"cast({source or 'null'} as string) as source_address", f"{strip(body)} as line"
    ).where("line <> ''")
