"""The trie of conversations: which ones share their first turns, and what storing shared turns once saves.

Texts are read once; after that a turn is its SHA-256 and its size.  Conversations are cut into blocks of a
fixed number of turns.  A block's digest and the digests of all blocks before it (an exclusive-or of hashes
which depend on the place, so a prefix needs no chain) name the point which a block leads to, in 128 bits.
Conversations are grouped by these names first: a group of any size is a count, a smallest member and sums.
Only where several different blocks follow the same point are the turns inside these blocks looked at one by
one, and that once for each different block, not for each conversation.

Sums over subtrees need no walk.  A node belongs to its smallest member, and the nodes of a conversation are
the end of its path.  So the turns stored below a node, and its leaves, are sums over its members of what each
of them owns, and a second grouping by the same names has them.

Long conversations are numbered and summed up in two levels, and all groups are aggregates with partial sums,
so no task holds a group whatever share of the rows it has.  The one list asked for, the ids of conversations
which end at a node, goes through its hash in pieces, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seclake.operators.joins import lookup_join

from .tables import frugal, materialize, partitions

#: Turns of a block; blocks of a span, within which sums over a conversation are made by one window.
BLOCK, SPAN = 4, 1024
#: Ids which are joined to one text before they are hashed.
IDS_AT_ONCE = 1 << 16
ROOT = "0" * 32
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each key within this task's sorted rows."""
    from pyspark import TaskContext

    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        key = batch.column("conv_id").to_numpy()
        if not len(key):
            continue
        first = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(first)
        number = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key)))) + 1
        if last is not None and key[0] == last:
            number[:start[1] if len(start) > 1 else len(key)] += count
        last, count = key[-1], int(number[-1])
        yield pa.record_batch({
            "part": pa.array([part] * len(key), pa.int32()), "conv_id": batch.column("conv_id"), "place": pa.array(number),
            "digest": batch.column("digest"), "size": batch.column("size")})


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Turns as conv_id, pos (from 1), digest, size (bytes of the text).

    Turns are in the order of ``turn``, null first; equal ones in the order of their digests.  A null role or
    text is empty.  Rows without a conv_id belong to no conversation and are left out.  Rows are dealt out by
    ranges of that order, so a conversation may lie in many tasks; those which cross an edge get the number of
    their rows in the tasks before from a table of at most two rows a task.
    """
    spark = conversations.sparkSession
    rows = conversations.where("conv_id is not null").selectExpr(
        "cast(conv_id as bigint) as conv_id", "turn", "coalesce(role, '') as role", "coalesce(text, '') as text").selectExpr(
        "conv_id", "turn", "unhex(sha2(length(role) || ':' || role || text, 256)) as digest", "cast(octet_length(text) as bigint) as size")
    dealt = rows.repartitionByRange(partitions(spark), "conv_id", F.asc_nulls_first("turn"), "digest").sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), "digest")
    turns = materialize(dealt.select("conv_id", "digest", "size").mapInArrow(
        frugal(_number), "part int, conv_id bigint, place bigint, digest binary, size bigint"), "turns")
    edges = turns.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("z"))
    crossing = edges.select("part", F.explode(F.array_distinct(F.array("a", "z"))).alias("conv_id"))
    counts = turns.join(F.broadcast(crossing), ["part", "conv_id"]).groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "conv_id", F.sum("n").over(earlier).alias("before")).where("before is not null")
    return turns.join(F.broadcast(before), ["part", "conv_id"], "left").selectExpr(
        "conv_id", "place + coalesce(before, 0) as pos", "digest", "size")


def _names(first: str, n: str) -> str:
    """SQL: name of the point behind the first ``n`` turns of a block, from the lanes of the point before it."""
    lane = "lpad(hex({p} ^ xxhash64({seed}, b, slice(digests, 1, {n}))), 16, '0')"
    return f"concat({lane.format(p=first + '0', seed=0, n=n)}, {lane.format(p=first + '1', seed=1, n=n)})"


def blocks_of(turns: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """One row for each block of each conversation.

    conv_id, b, digests, sizes, n (turns), point and after (names of where it starts and ends), steps (names
    behind each of its turns), pre (bytes before it), total (bytes of the conversation), ends (the last block).
    """
    rows = turns.withColumn("b", F.expr(f"(pos - 1) div {block}")).groupBy("conv_id", "b").agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "size"))).alias("t"))  # at most a block
    rows = rows.selectExpr("conv_id", "b", f"b div {span} as s", "t.digest as digests", "t.size as sizes", "size(t) as n",
                           "aggregate(t.size, 0L, (a, x) -> a + x) as bytes").selectExpr(
        "*", "xxhash64(0, b, digests) as f0", "xxhash64(1, b, digests) as f1")
    rows = materialize(rows, "blocks")
    inside = Window.partitionBy("conv_id", "s")
    before = inside.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*", F.bit_xor("f0").over(before).alias("x0"), F.bit_xor("f1").over(before).alias("x1"), F.sum("bytes").over(before).alias("y"),
        F.sum("bytes").over(inside).alias("span_bytes"), F.sum("n").over(inside).alias("span_turns"))
    spans = rows.groupBy("conv_id", "s").agg(
        F.bit_xor("f0").alias("g0"), F.bit_xor("f1").alias("g1"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    whole = Window.partitionBy("conv_id")
    ahead = whole.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(  # one row for thousands of turns of a conversation
        "s", "conv_id", F.bit_xor("g0").over(ahead).alias("h0"), F.bit_xor("g1").over(ahead).alias("h1"),
        F.sum("bytes").over(ahead).alias("hy"), F.sum("bytes").over(whole).alias("all_bytes"), F.sum("n").over(whole).alias("all_turns"),
        F.max("s").over(whole).alias("top")).where("top > 0").selectExpr(
        "conv_id || ':' || s as span", "h0", "h1", "hy", "all_bytes", "all_turns")
    rows = lookup_join(rows.withColumn("span", F.expr("conv_id || ':' || s")), spans, "span")
    rows = rows.selectExpr(
        "conv_id", "b", "digests", "sizes", "n", "coalesce(x0, 0L) ^ coalesce(h0, 0L) as p0", "coalesce(x1, 0L) ^ coalesce(h1, 0L) as p1",
        "coalesce(y, 0L) + coalesce(hy, 0L) as pre", "coalesce(all_bytes, span_bytes) as total",
        f"b * {block} + n = coalesce(all_turns, span_turns) as ends")
    return rows.selectExpr(
        "conv_id", "b", "sizes", "n", "lpad(hex(p0), 16, '0') || lpad(hex(p1), 16, '0') as point",
        f"transform(sequence(1, n), j -> {_names('p', 'j')}) as steps", "pre", "total", "ends").withColumn(
        "after", F.element_at("steps", -1))


def _inside(blocks: DataFrame, block: int, sums: list[str]) -> DataFrame:
    """Nodes inside different blocks, with sums over the members of each.

    Behind a point which one block follows, all nodes of the block have its members.  Behind any other, blocks
    which begin alike share nodes.
    """
    turn = F.posexplode(F.arrays_zip("steps", "sizes"))
    rows = blocks.select("point", "b", "pre", "sizes", "alone", "steps", *sums, turn.alias("j", "t")).selectExpr(
        "t.steps as key", "if(j = 0, point, element_at(steps, j)) as parent", f"b * {block} + j + 1 as depth", "t.sizes as size",
        "pre + aggregate(slice(sizes, 1, j), 0L, (a, x) -> a + x) as pre", "alone", *sums)
    merged = [F.min(c).alias(c) if c == "conv_id" else F.sum(c).alias(c) for c in sums]
    columns = ["key", "parent", "depth", "size", "pre"]
    return rows.where("alone").select(*columns, *sums).unionByName(
        rows.where("not alone").groupBy(*columns).agg(*merged))


def _join_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids with one key as texts."""
    for batch in batches:
        key, ids = batch.column("key"), batch.column("conv_id").to_pylist()
        if not ids:
            continue
        code = pc.dictionary_encode(key).indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])).tolist()
        cuts = [c for a, z in zip(starts, [*starts[1:], len(ids)]) for c in range(a, z, IDS_AT_ONCE)]
        yield pa.record_batch({
            "key": key.take(pa.array(cuts)), "first": pa.array([ids[c] for c in cuts], pa.int64()),
            "ids": pa.array([",".join(map(str, ids[a:z])) for a, z in zip(cuts, [*cuts[1:], len(ids)])])})


def _hash_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined texts of each key, which come in order."""
    key, state = None, None

    def row(key, state):
        return {"key": key, "ends_sha256": state.hexdigest()}

    for batch in batches:
        out = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append(row(key, state))
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out)
    if key is not None:
        yield pa.RecordBatch.from_pylist([row(key, state)])


def hashed_ids(ends: DataFrame) -> DataFrame:
    """(key, conv_id) to key, ends_sha256: of the decimal ids in ascending order, joined by commas.

    Ids are sorted and joined in ranges which may part a key; only these texts meet in one task, one at a time.
    """
    n = partitions(ends.sparkSession)
    texts = ends.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(
        frugal(_join_ids), "key string, first bigint, ids string")
    return texts.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(
        frugal(_hash_ids), "key string, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv_id, pos, digest, size), each pos from 1 on once a conversation.

    ``conversations`` (conv_id) may have more ids; those have no turns.  Without any id there are no nodes, not
    even a root.  Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes of texts which sharing them in the subtree saves), ends_sha256.
    """
    blocks = materialize(blocks_of(turns, block, span), "blocks")
    known = conversations.select("conv_id").distinct()
    ended = blocks.where("ends").select(F.col("after").alias("key"), "conv_id", "total")
    ends = materialize(ended.unionByName(known.join(ended, "conv_id", "left_anti").selectExpr(
        f"'{ROOT}' as key", "conv_id", "0L as total")), "ends")

    different = blocks.groupBy("point", "after", "b", "pre", "n", "steps", "sizes").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    different = materialize(different, "different")
    following = different.groupBy("point").agg((F.count("*") == 1).alias("alone"))
    different = materialize(lookup_join(different, following, "point"), "different")
    root = ends.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").selectExpr(
        f"'{ROOT}' as key", "cast(null as string) as parent", "0L as depth", "0L as size", "0L as pre", "n_convs", "conv_id")
    nodes = materialize(_inside(different, block, ["n_convs", "conv_id"]).unionByName(root), "nodes")

    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    # what a conversation owns starts behind `own` bytes of it; its last node is a leaf if nothing follows there
    owners = nodes.groupBy("conv_id").agg(
        F.min("pre").alias("own"), (F.max(F.struct("depth", "n_children")).getField("n_children") == 0).cast("bigint").alias("leaf"))
    owners = materialize(owners, "owners")
    members = lookup_join(blocks.select("conv_id", "after", "total"), owners, "conv_id").groupBy("after").agg(
        F.sum(F.coalesce("own", "total")).alias("own"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"))
    below = _inside(different.join(members, "after"), block, ["own", "n_leaves"]).select("key", "own", "n_leaves")
    everything = ends.join(owners, "conv_id", "left").agg(
        F.sum(F.coalesce("own", "total")).alias("own"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"))
    below = below.unionByName(everything.selectExpr(f"'{ROOT}' as key", "own", "n_leaves"))

    out = nodes.join(below, "key").join(hashed_ids(ends.select("key", "conv_id")), "key", "left")
    out = lookup_join(out, owners.selectExpr("conv_id", "own as first_own"), "conv_id")
    out = lookup_join(out, nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    return out.selectExpr(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "own - (n_convs - 1) * pre - first_own as saved_tokens", f"coalesce(ends_sha256, '{NO_ENDS}') as ends_sha256")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations which begin with turns of another one, and all their ids.

    Conversation c has the first h turns of conversation c - c % 5 (all if there are fewer, none if it is absent),
    then its own turns after its first h; h is the CRC-32 of the decimal c modulo 9.
    """
    turns = turns.selectExpr("*", "conv_id - conv_id % 5 as base", "crc32(cast(conv_id as string)) % 9 as h")
    sizes = materialize(turns.groupBy("conv_id", "base", "h").agg(F.count("*").alias("n")), "sizes")
    first = turns.where("pos <= 8 and conv_id = base").select(F.col("conv_id").alias("base"), "pos", "digest", "size")
    taken = sizes.where("h > 0 and conv_id <> base").join(first, "base").where("pos <= h").select("conv_id", "pos", "digest", "size")
    heads = sizes.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    own = lookup_join(turns.where("conv_id = base or pos > h"), heads, "base").selectExpr(
        "conv_id", "if(conv_id = base, pos, pos - h + least(h, coalesce(n_base, 0L))) as pos", "digest", "size")
    return taken.unionByName(own), sizes.select("conv_id")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = materialize(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return trie(*rebuilt(turns))


SQL = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 5 as base, xor(4294967295, list_reduce(
    list_concat([4294967295::bigint], range(8 * length(conv_id::varchar))),
    lambda a, i: xor(case when i % 8 = 0 then xor(a, ascii(substring(conv_id::varchar, (i // 8 + 1)::int, 1))) else a end >> 1,
      case when (case when i % 8 = 0 then xor(a, ascii(substring(conv_id::varchar, (i // 8 + 1)::int, 1))) else a end) % 2 = 1
        then 3988292384 else 0 end))) % 9 as h
  from (select distinct conv_id from t)),
r as (
  select c.conv_id, 0 as own, pos, role, text from c join t on t.conv_id = c.base and t.pos <= c.h
  union all select t.conv_id, 1, pos, role, text from t join c using (conv_id) where pos > h),
o as (select *, row_number() over (partition by conv_id order by own, pos) as depth from r),
p as (
  select conv_id, 0 as depth, '' as key, 0 as bytes from c
  union all
  select conv_id, depth, string_agg(md5(length(role) || ':' || role || text), '') over (partition by conv_id order by depth), strlen(text) from o),
n as (select key, depth, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes from p group by key, depth),
k as (select left(key, 32 * (depth - 1)) as key, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by all),
v as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (key, depth)),
s as (
  select p.key, p.depth, sum((v.n_convs - 1) * v.bytes) as saved_tokens, count(*) filter (v.n_children = 0) as n_leaves
  from v join p on p.conv_id = v.conv_id and p.depth <= v.depth group by p.key, p.depth),
e as (
  select key, depth, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from (
    select * from p qualify row_number() over (partition by conv_id order by depth desc) = 1) group by key, depth)
select v.conv_id::bigint as conv_id, v.depth::bigint as depth, u.conv_id::bigint as parent_conv_id, v.n_convs::bigint as n_convs,
  v.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens,
  coalesce(e.ends_sha256, sha256('')) as ends_sha256
from v join s using (key, depth) left join e using (key, depth)
left join n u on v.depth > 0 and u.depth = v.depth - 1 and u.key = left(v.key, 32 * (v.depth - 1))"""
