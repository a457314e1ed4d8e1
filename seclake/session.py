"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "seclake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are designed for.

    Adaptive execution coalesces small shuffle partitions and splits skewed join
    partitions, so ``spark.sql.shuffle.partitions`` may be set generously.  The JVM
    never compiles methods of more than 8000 bytes; stages beyond that limit run
    faster as separate, smaller methods.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session, else its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/seclake/{name}-{uuid.uuid4().hex}"


def literal_table(spark: SparkSession, columns: str, rows: list[str]) -> DataFrame:
    """A small fixed table from SQL row texts such as ``(1, 'a')``.

    Planned as a local relation, whose size the optimizer knows.
    """
    return spark.sql(f"select * from values {', '.join(rows)} as t({columns})")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Used where several jobs need the same derived rows: the source is scanned
    once, the stored columns stay prunable, and lost executors cost no
    recomputation of the lineage before this point.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
