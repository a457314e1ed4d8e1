"""Counting and cutting in row order without one big window.

``count(*) over (partition by key order by seq)`` sends all rows of a key to one
task.  The helpers here work in two levels instead: rows are counted inside blocks
of at most 2**20 consecutive order values, and the (small) block counts are summed
up separately.  Every sort group is bounded by the block size, whatever the key
distribution is, and the block of a row follows from its own order value, so a
recomputed task always yields the same blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BITS = 20


def order_blocks(df: DataFrame, seq: str = "seq") -> tuple[Column, Column]:
    """Block of a row and block of that block, both in row order.

    A BIGINT order value is cut by its high bits; the order struct of text lines
    (file, split start, row id) by split and high bits of the row id.
    """
    dtype = df.schema[seq].dataType
    if isinstance(dtype, T.StructType):
        path, start, row = (F.col(seq).getField(name) for name in dtype.names)
        return (
            F.struct(path.alias("p"), start.alias("s"), F.shiftright(row, BLOCK_BITS).alias("b")),
            F.struct(path.alias("p")),
        )
    order = F.col(seq).cast("bigint")
    return F.shiftright(order, BLOCK_BITS), F.shiftright(order, 2 * BLOCK_BITS)


def count_ahead(
    df: DataFrame,
    keys: list[str],
    out: str,
    seq: str = "seq",
    later: bool = True,
) -> DataFrame:
    """Add ``out``: number of rows with the same keys and a later (earlier) order value.

    Keys must not be NULL.  With an empty key list all rows form one group.
    """
    block, super_block = order_blocks(df, seq)
    rows = df.withColumn("_block", block).withColumn("_super", super_block)

    def direction(name: str) -> Column:
        return F.col(name).desc() if later else F.col(name).asc()

    in_block = Window.partitionBy(*keys, "_super", "_block").orderBy(direction(seq))
    in_super = (
        Window.partitionBy(*keys, "_super")
        .orderBy(direction("_block"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    top = (
        Window.partitionBy(*keys)
        .orderBy(direction("_super"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    blocks = rows.groupBy(*keys, "_super", "_block").agg(F.count("*").alias("_n"))
    supers = blocks.groupBy(*keys, "_super").agg(F.sum("_n").alias("_m"))
    supers = supers.withColumn("_outside", F.sum("_m").over(top)).drop("_m")
    blocks = (
        blocks.withColumn("_inside", F.sum("_n").over(in_super))
        .join(supers, [*keys, "_super"])
        .selectExpr(*keys, "_super", "_block", "coalesce(_inside, 0) + coalesce(_outside, 0) as _offset")
    )
    return (
        rows.withColumn("_rank", F.row_number().over(in_block))
        .join(blocks, [*keys, "_super", "_block"])
        .selectExpr(*df.columns, f"_rank - 1 + _offset as {out}")
    )


def order_value_at(df: DataFrame, position: str, seq: str = "seq") -> DataFrame:
    """One row, one column ``cut``: the order value of the row at a 1-based position.

    ``position`` is an expression over ``n``, the number of rows.  NULL when there is
    no such row.
    """
    block, super_block = order_blocks(df, seq)
    rows = df.select(F.col(seq).alias("_seq"), block.alias("_block"), super_block.alias("_super"))
    blocks = rows.groupBy("_super", "_block").agg(F.count("*").alias("_n"))
    # Running sums over the super blocks (2**40 order values or one file each), then
    # over the blocks of the one which holds the position.
    supers = blocks.groupBy("_super").agg(F.sum("_n").alias("_m"))
    running = Window.orderBy("_super").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("_super").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    top = (
        supers.withColumn("_end", F.sum("_m").over(running))
        .withColumn("n", F.sum("_m").over(everything))
        .selectExpr("*", f"{position} as _position")
        .where("_position <= _end and _position > _end - _m")
        .selectExpr("_super", "_position - _end + _m as _in_super")
    )
    inside = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    target = (
        blocks.join(F.broadcast(top), "_super")  # one row at most
        .withColumn("_end", F.sum("_n").over(inside))
        .where("_in_super <= _end and _in_super > _end - _n")
        .selectExpr("_super", "_block", "_in_super - _end + _n as _in_block")
    )
    return (
        rows.join(F.broadcast(target), ["_super", "_block"])  # one row at most
        .withColumn("_rank", F.row_number().over(Window.orderBy("_seq")))
        .where("_rank = _in_block")
        .agg(F.max("_seq").alias("cut"))
    )
