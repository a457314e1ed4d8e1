"""Reduction of a series of values to a few levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import count_ahead

LEVELS = 8


def levels(series: DataFrame, order: str, value: str, width: int = 50) -> DataFrame:
    """At most ``width`` evenly spaced points of a series, each on a scale from 0 to 8.

    Point i of a longer series is its value at position floor(i * n / width).
    """
    stored = materialize(
        series.selectExpr(f"cast({order} as bigint) as _order", f"{value} as value"), "series"
    )
    n = stored.count()
    indexed = count_ahead(stored, [], "position", seq="_order", later=False)
    points = series.sparkSession.range(width).selectExpr(
        "cast(id as int) as point", f"floor(id * ({n} / {float(width)}D)) as position"
    )
    return (
        indexed.join(F.broadcast(points), "position", "left")  # ``width`` rows
        .selectExpr("value", "cast(position as int) as point" if n <= width else "point")
        .where("point is not null")
        .dropDuplicates(["point"])
        # at most ``width`` rows
        .selectExpr("point", "value", "min(value) over () as low", "max(value) over () as high")
        .selectExpr(
            "point", "value",
            f"cast(floor((value - low) / if(high = low, 1, high - low) * {LEVELS}) as int) as level",
        )
    )
