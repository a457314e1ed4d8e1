"""Compute an expression once per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def pin(df: DataFrame, **expressions: str) -> DataFrame:
    """Add columns which later filters cannot inline.

    A filter on a computed column is pushed below the projection and repeats its
    expression there, once per mention; with detection and parsing chains this
    multiplies the regex work.  Going through a one-element ``explode`` stops the
    inlining, while filters on other columns still reach the scan.
    """
    for name, sql in expressions.items():
        df = df.selectExpr("*", f"explode(array({sql})) as {name}")
    return df
