"""Connected components of a graph given by edges, as joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialize


#: Edges which are replaced by stars at a time.
EDGES = 1 << 16


def _stars(edges: pa.Table) -> pa.RecordBatch:
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in zip(edges["a"].to_pylist(), edges["b"].to_pylist()):
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    nodes = [n for n in up if root(n) != n]
    return pa.record_batch({"a": pa.array([root(n) for n in nodes], pa.binary()), "b": pa.array(nodes, pa.binary())})


def shrink(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace every ``EDGES`` edges by as many stars as they have components.

    For use behind what finds the edges, in the same worker.
    """
    held: list[pa.RecordBatch] = []
    waiting = 0
    for batch in batches:
        held.append(batch)
        waiting += batch.num_rows
        if waiting >= EDGES:
            yield _stars(pa.Table.from_batches(held))
            held, waiting = [], 0
    if held:
        yield _stars(pa.Table.from_batches(held))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (binary columns a, b); the label is the least node.

    Labels spread to neighbours and then jump to the label of the label, so the number of rounds
    grows with the logarithm of the longest path.  Every round is a written table.  An empty graph
    gives an empty result; loops and repeated edges do no harm.
    """
    stars = edges.distinct()
    both = materialize(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
                         .select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen")))
        spread = labels.join(near, "node", "left").select(
            "node", F.least("label", "seen").alias("next"), "label")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = spread.join(jump, "next", "left").select(
            "node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved"))
        stored = materialize(step, "labels")
        labels = stored.select("node", "label")
        if not stored.where("moved").head(1):
            return labels
