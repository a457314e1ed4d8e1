"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector by M projections on normal random directions, cut into slots of
``WIDTH`` times R.
A query visits, besides its own bucket, perturbed buckets in the order of the estimated probability that a
neighbour at distance R lies in them: the difference of a projection is normal with standard deviation R,
which gives the probability of each slot, and a bucket's is the product.  Buckets are added until the
estimated success over all tables reaches ``SUCCESS``; R is the distance of the k-th neighbour which most
of a bounded sample of queries need.  Queries which did not find k neighbours within R ask again, by an index
with an R fitted to them; the few left in the end are compared with all rows.

Equal vectors are one class, so any number of copies is one row of the index.  Buckets are dealt out by
key, large ones in blocks; a task compares a query with the rows of its buckets at once and gives only the
best k, so candidate pairs never become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize, partitions
from .words import _mix

TABLES, WIDTH, SUCCESS, SEED = 4, 2.5, 0.98, 7
#: Sampled queries which R is fitted on, and the part of them whose k-th neighbour it reaches.
FIT_QUERIES, FIT_PART = 64, 0.9
#: Index rows of a block of a bucket, and of a group of buckets dealt to one call.
BLOCK_ROWS, GROUP_ROWS = 20_000, 50_000
#: Times that queries ask an index; those left, and any FIT_QUERIES left before, are compared with all rows.
ROUNDS = 5
_REACH = 2  # slots on either side
_U = np.uint64


def _floats(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _directions(dim: int, m: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(TABLES, dim, m)), rng.uniform(0, width, (TABLES, m))


def _keys(slots: np.ndarray, table: int) -> np.ndarray:
    """64-bit key of rows of slot numbers of a table."""
    h = np.full(len(slots), _mix(np.array([table + 1], _U))[0])
    for column in slots.astype(np.int64).view(_U).T:
        h = _mix(h * _U(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def _index(dim: int, m: int, width: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _directions(dim, m, width)
        for batch in batches:
            x = _floats(batch.column("vector"))
            keys = np.stack([_keys(np.floor((x @ a[t] + b[t]) / width), t) for t in range(TABLES)], axis=1)
            yield pa.record_batch({"class": batch.column("class"), "vector": batch.column("vector"),
                                   "keys": pa.array(keys.tolist(), pa.list_(pa.int64()))})
    return run


def _normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


def visiting_order(place: np.ndarray, width: float, r: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` likeliest perturbations of a bucket and their probabilities, likeliest first.

    ``place`` has the projections in slots.  A prefix of a likeliest perturbation is a likeliest one of its
    length, so the best are kept while slot by slot is added.
    """
    away = np.arange(-_REACH, _REACH + 1)
    inside = place - np.floor(place)
    low = (away[None] - inside[:, None]) * width / r
    chance = _normal(low + width / r) - _normal(low)
    total, steps = np.ones(1), np.zeros((1, 0), np.int64)
    for p in chance:
        every = (total[:, None] * p[None]).ravel()
        best = np.argsort(-every, kind="stable")[:most]
        total = every[best]
        steps = np.column_stack([steps[best // len(away)], away[best % len(away)]])
    return steps, total


def probes(x: np.ndarray, a: np.ndarray, b: np.ndarray, width: float, r: float) -> np.ndarray:
    """Keys of the buckets which a query visits: equally many in each table, until success is likely enough."""
    places = [(x @ a[t] + b[t]) / width for t in range(TABLES)]
    every = (2 * _REACH + 1) ** a.shape[2]
    most = 256
    while True:
        orders = [visiting_order(p, width, r, most) for p in places]
        missed = np.prod([1 - np.minimum(np.cumsum(total), 1) for _, total in orders], axis=0)
        done = np.flatnonzero(missed <= 1 - SUCCESS)
        if len(done) or most >= every:
            n = int(done[0]) + 1 if len(done) else len(missed)
            return np.concatenate([_keys(np.floor(p) + steps[:n], t) for t, (p, (steps, _)) in enumerate(zip(places, orders))])
        most *= 4


def _visit(dim: int, m: int, width: float, r: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _directions(dim, m, width)
        for batch in batches:
            for i, x in enumerate(_floats(batch.column("vector"))):
                keys = np.unique(probes(x, a, b, width, r))
                yield pa.record_batch({"query": batch.column("class").slice(i, 1),
                                       "keys": pa.array([keys.tolist()], pa.list_(pa.int64()))})
    return run


def _nearest(x: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest rows, ties to the smaller id."""
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    if len(d) > k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        ids, d = ids[near], d[near]
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def _ranges(key: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the sorted ``key`` which hold the wanted keys, adjoining ones as one."""
    wanted = np.unique(wanted)
    lo, hi = np.searchsorted(key, wanted), np.searchsorted(key, wanted, "right")
    lo, hi = lo[hi > lo], hi[hi > lo]
    apart = lo[1:] != hi[:-1]
    return lo[np.r_[True, apart]] if len(lo) else lo, hi[np.r_[apart, True]] if len(hi) else hi


def _promising(x: np.ndarray, squares: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int) -> np.ndarray:
    """Rows of the ranges which may be among the ``most`` nearest.

    Products give each distance but for a rounding error; what lies within its bound beyond the last is kept.
    """
    rows = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
    if len(rows) <= most:
        return rows
    size = squares[rows].max() + q @ q
    if not np.isfinite(size):
        return rows
    about = squares[rows] - 2 * np.concatenate([x[a:b] @ q for a, b in zip(lo, hi)])
    return rows[about <= np.partition(about, most - 1)[most - 1] + 8 * (len(q) + 2) * np.finfo(float).eps * size]


def _scan(queries: list[tuple[int, list[float]]], k: int):
    """The k nearest rows of each batch for a bounded list of queries."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _floats(batch.column("vector")), batch.column("class").to_numpy()
            if len(ids):
                for q, v in queries:
                    near, d = _nearest(x, np.array(v), ids, k)
                    yield pa.record_batch({"query": pa.array([q] * len(d), pa.int64()), "class": pa.array(near), "score": pa.array(d)})
    return run


def _compare(k: int):
    """The best rows of a group of buckets for each query which visits some of them."""
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(index) and len(queries):
            key = index["key"].to_numpy()
            order = np.argsort(key, kind="stable")
            key, x, ids = key[order], _floats(index["vector"])[order], index["class"].to_numpy()[order]
            squares = np.einsum("ij,ij->i", x, x)
            vectors = _floats(queries["vector"])
            for q, v, wanted in zip(queries["query"].to_pylist(), vectors, queries["keys"]):
                lo, hi = _ranges(key, wanted.values.to_numpy())
                if len(lo):
                    rows = _promising(x, squares, v, lo, hi, TABLES * k)  # a row is seen in each table at most
                    rows = rows[np.unique(ids[rows], return_index=True)[1]]
                    near, d = _nearest(x[rows], v, ids[rows], k)
                    out.append((np.full(len(d), q), near, d))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query": pa.array(columns[0], pa.int64()), "class": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2])})
    return run


def _radius(classes: DataFrame, asked: DataFrame, k: int) -> float:
    """Distance within which most of a bounded sample of queries have their k nearest classes."""
    sample = [(r["query"], r["vector"]) for r in asked.orderBy(F.xxhash64("query")).limit(FIT_QUERIES).collect()]
    fitted = classes.select("class", "vector").mapInArrow(_scan(sample, k + 1), "query bigint, class bigint, score double").where("query <> class")
    place = Window.partitionBy("query").orderBy("score", "class")
    kth = fitted.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).groupBy("query").agg(F.max("score").alias("r"))
    return kth.agg(F.percentile("r", FIT_PART)).first()[0] or 1.0


def _best(index: DataFrame, asked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k + 1 nearest classes in each group for the queries which visit some of its keys."""
    asked = asked.groupBy("g", "query").agg(F.collect_set("key").alias("keys")).join(queries, "query")
    return index.groupBy("g").cogroup(asked.groupBy("g")).applyInArrow(
        _compare(k + 1), "query bigint, class bigint, score double")


def _through_index(classes: DataFrame, queries: DataFrame, dim: int, size: int, r: float, groups: int, k: int) -> DataFrame:
    """Candidates by an index whose slots are fitted to ``r``."""
    m = min(16, max(4, round(math.log2(max(size, 2)) / 2)))
    settings = (dim, m, WIDTH * r)
    keyed = classes.select("class", "vector").mapInArrow(_index(*settings), "class bigint, vector array<double>, keys array<bigint>")
    index = materialize(keyed, "index").select("class", "vector", F.explode("keys").alias("key"))
    large = index.groupBy("key").count().where(F.col("count") > BLOCK_ROWS).select(
        "key", F.ceil(F.col("count") / BLOCK_ROWS).alias("blocks"))
    large = materialize(large, "large")
    group = F.pmod(F.xxhash64("key", "block"), F.lit(groups)).alias("g")
    one = F.coalesce("blocks", F.lit(1).cast("bigint"))
    index = index.join(large, "key", "left").withColumn("block", F.pmod(F.xxhash64("class"), one)).select(group, "key", "class", "vector")
    asked = materialize(queries.withColumnRenamed("query", "class").repartition(partitions(classes.sparkSession)).mapInArrow(
        _visit(*settings, r), "query bigint, keys array<bigint>"), "probes").select("query", F.explode("keys").alias("key"))
    asked = asked.join(large, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), one - 1))).select(group, "key", "query")
    return _best(index, asked, queries, k)


def _exact(classes: DataFrame, queries: DataFrame, groups: int, k: int) -> DataFrame:
    """Candidates of queries which are compared with all classes, block by block."""
    g = F.pmod(F.xxhash64("class"), F.lit(groups))
    index = classes.select(g.alias("g"), g.alias("key"), "class", "vector")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))
    asked = queries.select(every.alias("g"), "query").withColumn("key", F.col("g"))
    return _best(index, asked, queries, k)


def nearest(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found rows of every row for which ``is_query`` holds, other than itself, by Euclidean distance.

    Returns query_id, rank (from 1, nearest first, ties to the smaller id), vec_id, score (the distance in double
    precision on the vectors as given).  Every query gets k rows; fewer than k candidates are all returned.

    Vectors which are null, zero, or hold a null or not finite component take no part, nor do rows without an id
    or vectors of another length than most have (of equally frequent lengths the larger).  Rows which repeat an id
    with another vector are rows of their own; a row never is its own id's neighbour.  An empty table gives an
    empty result; other columns are ignored.
    """
    n = partitions(rows.sparkSession)
    usable = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
                         F.coalesce(is_query, F.lit(False)).alias("asks")).where(
        "id is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity')) "
        "and exists(vector, x -> x <> 0)")
    lengths = usable.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = lengths["dim"] if lengths else 1
    usable = materialize(usable.where(F.size("vector") == dim).withColumn("hash", F.xxhash64("vector")), "vectors")
    classes = materialize(usable.groupBy("hash", "vector").agg(F.min("id").alias("class"), F.max("asks").alias("asks"),
                                                        F.count_distinct("id").alias("ids")), "classes")
    classed = materialize(usable.join(classes.select("hash", "vector", "class"), ["hash", "vector"]).select("class", "id", "asks"), "classed")
    first = Window.partitionBy("class").orderBy("id")
    members = classed.select("class", "id").distinct().withColumn("place", F.row_number().over(first)).where(
        F.col("place") <= k + 1).select("class", "id")
    asking = classed.where("asks").select(F.col("class").alias("query"), F.col("id").alias("query_id"))

    size = classes.count()
    groups = max(n, size * TABLES // GROUP_ROWS)
    left = classes.where("asks").select(F.col("class").alias("query"), "vector")
    found = classes.where("asks").select(F.col("class").alias("query"), "class", F.lit(0.0).alias("score"))
    for turn in range(ROUNDS + 1):
        waiting = left.count()
        if not waiting:
            break
        if turn == ROUNDS or turn and waiting <= FIT_QUERIES:
            found = found.unionByName(materialize(_exact(classes, left, groups, k), "scanned"))
            break
        r = _radius(classes, left, k)
        some = materialize(_through_index(classes, left, dim, size, r, groups, k), "found")
        found = found.unionByName(some)
        # sure of its neighbours is a query which has k within R; the others ask again, with an R fitted to them
        near = some.where(F.col("score") <= r).join(classes.select("class", "ids"), "class").groupBy("query").agg(
            F.sum("ids").alias("ids")).where(F.col("ids") >= k + 1)
        left = materialize(left.join(near, "query", "left_anti"), "left")
    best = Window.partitionBy("query").orderBy("score", "class")
    found = found.distinct().withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    near = found.join(members, "class").withColumn("place", F.row_number().over(
        Window.partitionBy("query").orderBy("score", "id"))).where(F.col("place") <= k + 1)
    out = near.join(asking, "query").where("id <> query_id").withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "id"))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op7_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
