"""Lookups against tables of one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A table of up to this many (narrow) rows is broadcast.
BROADCAST_ROWS = 200_000
# Keys holding more than one row in HOT_SHARE are looked up by broadcast; there can
# be at most HOT_SHARE of them.
HOT_SHARE = 1_000


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    key: str,
    broadcast_rows: int = BROADCAST_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Left join with ``table``, which has unique keys and is cheap to count.

    A table within ``broadcast_rows`` is broadcast.  Beyond it, rows of hot keys get
    their match, or that there is none, from a broadcast of just these keys.  They and
    rows with a NULL key travel under scattered keys, so no task of the shuffle join
    receives more than its share.  ``counts`` (key, _n) saves counting the keys of ``left``.
    """
    payload = [c for c in table.columns if c != key]
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return left.join(F.broadcast(table), key, "left")

    if counts is None:
        counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot_keys = counts.where(F.col("_n") * HOT_SHARE > total).select(key)
    matched = table.join(F.broadcast(hot_keys), key, "left_semi")
    hot = hot_keys.join(F.broadcast(matched), key, "left").select(
        key, F.lit(True).alias("_is_hot"), F.struct(*payload).alias("_hot")
    )
    found = left.join(F.broadcast(hot), key, "left")
    scattered = F.when(
        F.col("_is_hot").isNotNull() | F.col(key).isNull(),
        F.concat(F.lit("\u0000"), F.xxhash64(*left.columns).cast("string")),
    ).otherwise(F.col(key).cast("string"))
    rest = table.select(F.col(key).cast("string").alias("_key"), F.struct(*payload).alias("_rest"))
    return (
        found.withColumn("_key", scattered)
        .join(rest, "_key", "left")
        .withColumn("_m", F.when(F.col("_is_hot"), F.col("_hot")).otherwise(F.col("_rest")))
        .select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in payload])
    )
