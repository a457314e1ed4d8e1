"""Tables in the shared folder and groups of sorted rows."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seclake.session import materialize, scratch_path

__all__ = ["bucketed", "frugal", "materialize", "partitions", "runs", "scratch_path"]

Batches = Iterable[pa.RecordBatch]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, column: str, n: int) -> DataFrame:
    """Write ``df`` to the shared folder in ``n`` buckets of ``column`` and read it back.

    Every later grouping, cogrouping or join by that column then reads the rows where
    they lie, without another shuffle of them.
    """
    spark = df.sparkSession
    name = f"seclake_{uuid.uuid4().hex}"
    (df.write.format("parquet").bucketBy(n, column).sortBy(column)
       .option("path", scratch_path(spark, name)).saveAsTable(name))
    return spark.table(name)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def frugal(run: Callable[[Batches], Iterator[pa.RecordBatch]]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """``run``, which gives freed memory back after each batch.

    Worker processes outlive their tasks beside the executor's JVM; what their allocators keep for later is
    missing there.
    """
    def each(batches: Batches) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                _give_back()

        yield from run(given())
        _give_back()
    return each


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of adjacent rows with the same ``key`` (an integer column without nulls).

    Cheaper than one Python call per group where there are very many small groups; a group
    may continue over batches.  At most one group is held.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        k = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(edges, edges[1:]):
            if held and k[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = k[lo]
    if held:
        yield pa.Table.from_batches(held)
