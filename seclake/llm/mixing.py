"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are aggregated by membership pattern.  A flow routes each
pattern's words to the quotas of its sources: the first use of a pattern is cheap, each repetition dearer, so
quotas are met with the least repetition.  Sources which no pattern connects are networks of their own, so the
flow is solved for each connected part: for a source with its one pattern in the tasks, where sources may be as
many as there are web sites; patterns which overlap, and those on the same sources, come to the driver.  Sizes,
ranks and shares of sources are computed in tables as well.
The flow of a pattern then says how often its documents are used: all of them a whole number of times, and
a seeded part of them once more.  That part is the beginning of a pseudo-random order of the documents,
found by sums over slices of the order first, so that no task sorts a whole pattern.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize, partitions

#: Words of a text: `[^\x20\x09-\x0D]+`.
_WORDS = r"[^\\x20\\x09-\\x0D]+"
MAX_REPEAT = 3
#: Extra cost of the second, third, ... use of a document.
REPEAT_COST = 1
#: Slices of the pseudo-random order of a pattern, as a power of two; patterns whose uses are broadcast.
SLICE_BITS = 12
BROADCAST_PATTERNS = 20_000


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], most: int = MAX_REPEAT) -> list[list[int]]:
    """Words which each pattern gives to each of its sources (in the order of ``members``).

    Patterns give up to ``most`` times their supply; the k-th use costs (k - 1) * REPEAT_COST a word.  As many
    words as the quotas and supplies allow flow, at the least cost, by successive shortest paths.
    """
    first_source = 1 + len(supply)
    sink = first_source + len(quota)
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, r: int, c: int) -> int:
        for x, y, z, w in ((a, b, r, c), (b, a, 0, -c)):
            out[x].append(len(to))
            to.append(y)
            room.append(z)
            cost.append(w)
        return len(to) - 2

    for p, s in enumerate(supply):
        for k in range(most):
            arc(0, 1 + p, s, k * k * REPEAT_COST)
    given = [[arc(1 + p, first_source + s, sum(quota), 0) for s in sources] for p, sources in enumerate(members)]
    for s, q in enumerate(quota):
        arc(first_source + s, sink, q, 0)
    level = [0] * (sink + 1)
    while True:
        far = [float("inf")] * (sink + 1)
        by = [-1] * (sink + 1)
        far[0] = 0
        queue = [(0, 0)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in out[x]:
                if room[e] and (there := d + cost[e] + level[x] - level[to[e]]) < far[to[e]]:
                    far[to[e]], by[to[e]] = there, e
                    heapq.heappush(queue, (there, to[e]))
        if by[sink] < 0:
            return [[room[e ^ 1] for e in arcs] for arcs in given]
        level = [v + f if f < float("inf") else v + far[sink] for v, f in zip(level, far)]
        path, x = [], sink
        while x:
            path.append(by[x])
            x = to[by[x] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step


def networks(members: list[list[int]]) -> list[list[int]]:
    """Patterns of each connected part of the network, in order."""
    leader = {s: s for m in members for s in m}

    def root(s: int) -> int:
        while leader[s] != s:
            leader[s] = s = leader[leader[s]]
        return s

    for m in members:
        for s in m[1:]:
            leader[root(s)] = root(m[0])
    parts: dict[int, list[int]] = {}
    for p, m in enumerate(members):
        parts.setdefault(root(m[0]), []).append(p)
    return list(parts.values())


def uses(supply: list[int], members: list[list[int]], quota: list[int], most: int = MAX_REPEAT) -> list[int]:
    """Words which each pattern gives, by a flow for each connected part."""
    out = [0] * len(supply)
    for part in networks(members):
        place = {s: i for i, s in enumerate(sorted({s for p in part for s in members[p]}))}
        flow = min_cost_flow([supply[p] for p in part], [[place[s] for s in members[p]] for p in part], [quota[s] for s in place], most)
        for p, f in zip(part, flow):
            out[p] = sum(f)
    return out


def _single_uses(most: int):
    """``given`` of patterns of one source which no other shares: a flow with one pattern and one quota each."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [uses([w], [[0]], [q], most)[0] for w, q in zip(batch.column("words").to_pylist(), batch.column("quota").to_pylist())]
            yield pa.record_batch({**{c: batch.column(c) for c in ("source", "words", "source_size", "target")},
                                   "given": pa.array(given, pa.int64())})
    return run


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        yield pa.record_batch({"source": batch.column("source"), "size": batch.column("size"), "part": pa.array([part] * batch.num_rows, pa.int32()),
                               "at": pa.array(range(seen, seen + batch.num_rows), pa.int64())})
        seen += batch.num_rows


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, size, place): place 0, 1, ... by code points, null last; numbered in ranges."""
    none = F.col("source").isNull()
    rows = sizes.repartitionByRange(partitions(sizes.sparkSession), none, "source").sortWithinPartitions(none, "source")
    rows = materialize(rows.mapInArrow(_number, "source string, size bigint, part int, at bigint"), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "part").selectExpr("source", "size", "offset + at as place")


def capped_targets(sources: DataFrame, weights: str, most: int = MAX_REPEAT) -> DataFrame:
    """``target`` of each source: a share of all sizes by weight.

    None gets over ``most`` times its size, the excess is shared anew.  Each round caps what exceeds its share; the
    share of a weight only grows, so a capped source stays so, and the round is told by the share alone.
    """
    rows = materialize(sources.selectExpr("*", f"cast({weights} as double) as weight"), "weights")
    total = float(rows.agg(F.sum("size")).first()[0] or 0)
    rest, weight, capped = total, rows.agg(F.sum("weight")).first()[0] or 0.0, 0
    while True:
        over = f"({rest}D * weight / {weight}D > {most} * size)" if weight > 0 else "true"
        n, fixed, free = rows.selectExpr(f"count_if({over})", f"coalesce(sum({most} * size) filter (where {over}), 0)",
                                         f"coalesce(sum(weight) filter (where not {over}), 0D)").first()
        if n == capped or not weight > 0:
            share = f"{rest}D * weight / {weight}D" if weight > 0 else "0D"
            return rows.selectExpr("source", "size as source_size", f"cast(if({over}, {most} * size, {share}) as double) as target")
        rest, weight, capped = total - float(fixed), free, n


def word_count(text: str) -> F.Column:
    return F.expr(f"cast(coalesce(regexp_count({text}, '{_WORDS}'), 0) as bigint)")


def _plan(patterns: DataFrame, weights: str, most: int) -> DataFrame:
    """(__pattern, given, words, source_size, target) of patterns (__pattern, words)."""
    spark = patterns.sparkSession
    each = patterns.select(F.explode("__pattern").alias("source"), "words")  # a word of several sources counts in each
    targets = materialize(capped_targets(ranked_sources(each.groupBy("source").agg(F.sum("words").alias("size"))), weights, most), "targets")
    targets = targets.withColumn("quota", F.bround("target").cast("bigint"))
    overlapping = patterns.where("size(__pattern) > 1")
    touched = materialize(overlapping.select(F.explode("__pattern").alias("source")).distinct(), "touched")
    single = patterns.where("size(__pattern) = 1").select(F.get("__pattern", F.lit(0)).alias("source"), "words")
    shared = single.join(touched, single.source.eqNullSafe(touched.source), "left_semi")
    alone = single.join(touched, single.source.eqNullSafe(touched.source), "left_anti").alias("a").join(
        targets.alias("t"), F.expr("a.source <=> t.source")).select("a.source", "words", "source_size", "target", "quota")
    done = alone.mapInArrow(_single_uses(most), "source string, words bigint, source_size bigint, target double, given bigint")
    done = done.select(F.array("source").alias("__pattern"), "given", "words", "source_size", "target")

    here = targets.join(touched, targets.source.eqNullSafe(touched.source), "left_semi").collect()
    place = {r.source: i for i, r in enumerate(here)}
    rows = [(list(r[0]), r.words) for r in overlapping.collect()] + [([r.source], r.words) for r in shared.collect()]
    given = uses([w for _, w in rows], [[place[s] for s in m] for m, _ in rows], [r.quota for r in here], most)
    solved = [(m, g, w, here[place[m[0]]].source_size, here[place[m[0]]].target) for (m, w), g in zip(rows, given)]
    return done.unionByName(spark.createDataFrame(solved, done.schema))


def mix(docs: DataFrame, size: str, sources: str, weights: str, seed: int = 0, most: int = MAX_REPEAT, id_col: str = "doc_id") -> DataFrame:
    """Choose how often each document is used, so that every source gets its share of all words.

    ``size`` names a column of word counts, ``sources`` an array of source names (null stands for documents
    without a source); ``weights`` is the SQL expression of a source's weight by its ``place`` (0, 1, ... in the
    order of code points, null last).  Shares are capped at ``most`` times a source's size.

    Returns the rows of ``docs`` with repeats (0 to ``most``), taken (size * repeats), source_size and target of
    the document's first source.  The same documents and seed give the same choice; the order of rows with equal
    ids is decided by size, and null counts as one id.  Every row is used by itself.  Documents of size 0 are used as
    often as the pattern as a whole.  An empty array belongs to no source and is not used.  The driver holds one
    row for each pattern which shares a source with another one.
    """
    names = ["__pattern", "__slice", "__order"]
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(id_col).cast("string")))
    text = F.transform(F.col(sources), lambda x: x.cast("string"))
    rows = docs.withColumn("__pattern", F.array_sort(F.array_distinct(text))).withColumn("__order", order).withColumn(
        "__slice", F.conv(F.substring("__order", 1, SLICE_BITS // 4), 16, 10).cast("int"))
    slices = materialize(rows.groupBy("__pattern", "__slice").agg(F.sum(size).cast("bigint").alias("words")), "slices")
    patterns = materialize(slices.where("size(__pattern) > 0").groupBy("__pattern").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words")), "patterns")
    plan_df = materialize(_plan(patterns, weights, most).selectExpr(
        "__pattern", f"if(words > 0, given div words, {min(1, most)}) as whole", "if(words > 0, given % words, 0) as part", "source_size", "target"), "plan")
    small = F.broadcast if plan_df.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS else (lambda table: table)

    along = Window.partitionBy("__pattern").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    edge = (slices.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0)))
            .join(small(plan_df), "__pattern").where("before <= part and part < before + words")
            .groupBy("__pattern").agg(F.max("__slice").alias("edge"), F.max("before").alias("edge_before")))
    ruled = plan_df.join(edge, "__pattern", "left").withColumn("edge", F.when(F.col("part") > 0, F.coalesce("edge", F.lit(1 << SLICE_BITS))).otherwise(-1))
    # only in the slice in which the part ends does the order of its rows matter
    keyed = rows.join(small(ruled), "__pattern", "left")
    run = Window.partitionBy("__pattern", "__slice").orderBy("__order", size).rowsBetween(Window.unboundedPreceding, -1)
    inner = F.sum(size).over(run)
    ahead = F.col("edge_before") + F.coalesce(inner, F.lit(0))
    more = F.when(F.col("__slice") < F.col("edge"), 1).when(
        (F.col("__slice") == F.col("edge")) & (2 * (F.col("part") - ahead) >= F.col(size)) & (ahead < F.col("part")), 1).otherwise(0)
    repeats = F.when(F.col("whole").isNull(), 0).otherwise(F.least(F.col("whole") + more, F.lit(most))).cast("int")
    return keyed.withColumn("repeats", repeats).withColumn("taken", (F.col("repeats") * F.col(size)).cast("bigint")).drop(
        *names, "whole", "part", "edge", "edge_before")


#: Weights 1, 2, 3, 1, 2, 3, ...
CYCLE = "1 + place % 3"


def mix_documents(docs: DataFrame, *keep: str) -> DataFrame:
    """The mix of a documents table by its column source: weights 1, 2, 3, repeating, over the sorted sources.

    Rows have the columns ``keep`` too; those with equal or null ids are rows of their own.
    """
    rows = docs.select(*keep, F.col("doc_id"), word_count("text").alias("size"), F.array(F.col("source").cast("string")).alias("sources"))
    return mix(rows, "size", "sources", CYCLE)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken", "repeats")
