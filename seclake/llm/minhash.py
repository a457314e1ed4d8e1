"""Near-duplicate documents by b-bit MinHash.

1. Every document: its set of distinct shingles, a 128-bit digest of that set, and ``PERMS`` minima
   of hashed shingles, of which ``BITS`` low bits each are packed into a signature.  Documents with
   equal sets are one *node* from here on, so any number of copies costs one row.
2. Nodes which share a band of full minima are candidates.  In each bucket the signatures are
   compared by bit counts; with C = 2^-BITS, equal fields E estimate the similarity (E - C) / (1 - C).
   Nodes which may reach the similarity, with a margin of ``MARGIN`` standard errors, are tied
   together by a spanning forest, never by all their pairs.
3. The trees make families.  Links are confirmed inside families on the full sets.  A search over
   the nodes not yet reached finds the components: a spanning forest of confirmed links comes out.

Buckets and families beyond a fixed size are compared in pairs of blocks, in as many tasks, so no
link is lost and no task holds more than two blocks.

With 28 bands of 5 rows, a pair at similarity 0.85 meets in no band with probability 7e-8,
one at 0.80 with 1.5e-5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, shrink
from .tables import frugal, materialize, partitions, runs
from .words import _FIRST, _mix, slices, text_buffer, windows, words

SHINGLE = 5
BANDS, ROWS, BITS = 28, 5, 4
PERMS = BANDS * ROWS
MARGIN = 5
#: Signatures of a block of a bucket; shingles of a block of a family.
BLOCK_NODES = 4096
BLOCK_SHINGLES = 1_000_000
#: Bytes of text signed at a time.
TEXT_PIECE = 1 << 18
_U = np.uint64
_FACTORS = _mix(np.arange(1, PERMS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_ADDENDS = _mix(_FACTORS)
_BAND_FACTORS = _mix(np.arange(1, ROWS + 1, dtype=_U) + _U(77)) | _U(1)


def _sets(raw: np.ndarray, at: np.ndarray):
    """Sorted distinct shingle hashes of each text."""
    _, _, h, bounds = words(raw, at, lower=True)
    where, wh = windows(h, bounds, SHINGLE)
    cut = np.searchsorted(where, bounds)
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < SHINGLE))
    whole = dict(zip(short.tolist(), _FIRST.ranges(h, bounds[short], bounds[short + 1])))
    for i in range(len(at) - 1):
        yield np.array([whole[i]]) if i in whole else np.unique(wh[cut[i]:cut[i + 1]])


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = text_buffer(batch.column("text"))
        for lo, hi in slices(at, TEXT_PIECE):
            sets = list(_sets(raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]))
            size = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(size)
            nodes: list[bytes | None] = [_digest(s) if len(s) else None for s in sets]
            signature: list[bytes | None] = [None] * len(sets)
            bands: list[list[int] | None] = [None] * len(sets)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                first = np.cumsum(size[full]) - size[full]
                minima = np.empty((PERMS, len(full)), np.uint32)
                for j in range(PERMS):
                    minima[j] = np.minimum.reduceat(
                        ((every * _FACTORS[j] + _ADDENDS[j]) >> _U(32)).astype(np.uint32), first)
                low = (minima & 15).astype(np.uint8).T
                packed = np.zeros((len(full), 8 * math.ceil(PERMS / 16)), np.uint8)
                packed[:, :PERMS // 2] = low[:, ::2] | low[:, 1::2] << 4
                keys = minima.T.astype(_U).reshape(len(full), BANDS, ROWS)
                keys = _mix((_mix(keys) * _BAND_FACTORS).sum(axis=2, dtype=_U) + np.arange(BANDS, dtype=_U)).view(np.int64)
                for i, p, k in zip(full, packed, keys):
                    signature[i], bands[i] = p.tobytes(), k.tolist()
            yield pa.record_batch({
                "row": batch.column("row").slice(lo, hi - lo), "doc_id": batch.column("doc_id").slice(lo, hi - lo), "n_shingles": pa.array(size),
                "node": pa.array(nodes, pa.binary()), "signature": pa.array(signature, pa.binary()),
                "bands": pa.array(bands, pa.list_(pa.int64()))})


def needed_matches(percent: int) -> int:
    """Equal fields which a pair at the wanted similarity has, less ``MARGIN`` standard errors."""
    chance = 2.0 ** -BITS
    e = chance + (1 - chance) * percent / 100
    return math.floor(PERMS * e - MARGIN * math.sqrt(PERMS * e * (1 - e)))


def _differing(x: np.ndarray) -> np.ndarray:
    x = x | x >> _U(1)
    x = x | x >> _U(2)
    return np.bitwise_count(x & _U(0x1111111111111111)).sum(axis=-1, dtype=np.int64)


def _tie(need: int):
    """Spanning forest of the pairs of a bucket which may be similar enough."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "g"):
            nodes = group["node"].to_pylist()
            if len(nodes) < 2:
                continue
            sig = np.frombuffer(b"".join(group["signature"].to_pylist()), _U).reshape(len(nodes), -1)
            most = PERMS - need  # fields beyond PERMS are zero in all signatures
            left = np.arange(len(nodes))
            a, b = [], []
            while len(left):
                seed, left = left[0], left[1:]
                front = [seed]
                while front and len(left):
                    some, front = front[:32], front[32:]
                    near = (_differing(sig[some][:, None] ^ sig[left][None]) <= most).any(axis=0)
                    new = left[near].tolist()
                    left = left[~near]
                    front += new
                    a += [nodes[seed]] * len(new)
                    b += [nodes[i] for i in new]
            if a:
                yield pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})
    return run


def _confirm(percent: int):
    """Spanning forest of the pairs of a family with 100 * common >= percent * union."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "g"):
            raw, at = text_buffer(group["text"])
            found: dict[bytes, np.ndarray] = {}
            for node, s in zip(group["node"].to_pylist(), _sets(raw, at)):
                found[node] = s
            nodes = list(found)
            if len(nodes) < 2:
                continue
            _, ids = np.unique(np.concatenate(list(found.values())), return_inverse=True)
            size = np.array([len(s) for s in found.values()])
            parts = np.split(ids, np.cumsum(size)[:-1])
            mark = np.zeros(int(ids.max()) + 1, bool)
            reached = np.zeros(len(nodes), bool)
            left, joined, first = np.arange(len(nodes)), ids, np.cumsum(size) - size
            a, b = [], []
            for seed in range(len(nodes)):
                if reached[seed]:
                    continue
                reached[seed] = True
                front = [seed]
                while front:
                    x = front.pop()
                    if 2 * (~reached[left]).sum() < len(left):  # forget the nodes already reached
                        left = left[~reached[left]]
                        joined = np.concatenate([parts[i] for i in left]) if len(left) else ids[:0]
                        first = np.cumsum(size[left]) - size[left]
                    if not len(left):
                        break
                    mark[parts[x]] = True
                    common = np.add.reduceat(mark[joined], first, dtype=np.int64)
                    mark[parts[x]] = False
                    near = (100 * common >= percent * (size[x] + size[left] - common)) & ~reached[left]
                    new = left[near].tolist()
                    reached[new] = True
                    front += new
                    a += [nodes[x]] * len(new)
                    b += [nodes[i] for i in new]
            if a:
                yield pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})
    return run


def _in_blocks(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Column g: the pairs of blocks in which a row is compared; one where a group has one block."""
    return rows.withColumn("g", F.expr(
        f"explode(if({blocks} = 1, array(xxhash64({key})), transform(sequence(0L, {blocks} - 1), j -> xxhash64({key}, "
        f"least(j, pmod(xxhash64(node), {blocks})), greatest(j, pmod(xxhash64(node), {blocks}))))))"))


def _by_group(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "g").sortWithinPartitions("g")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
                    row_col: str | None = None) -> DataFrame:
    """Components of documents linked by 100 * common >= percent * union of their shingles.

    Words are runs of bytes other than space and ``\\t\\n\\v\\f\\r`` with A-Z lower-cased; a set holds the
    distinct shingles of five words, or the whole sequence where there are fewer.

    Returns one row per input row: row (its number), doc_id, n_shingles, component_id (smallest doc_id
    reachable), kept (doc_id is the component's), group (equal in the rows of a component, null without
    shingles).

    ``row_col`` names a column which numbers the rows of a stored table; without one the rows are numbered
    and written first, as texts are fetched by that number.  Null, empty and blank texts have no shingles and
    stand alone.  Rows with equal ids are each judged by their own text.  A null id is never a component's id
    unless all of its documents have none.  An empty table gives an empty result; other columns are ignored.
    """
    n, tie, confirm = partitions(docs.sparkSession), _tie(needed_matches(percent)), _confirm(percent)
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not row_col:
        rows = materialize(rows, "rows")
    signed = materialize(rows.mapInArrow(
        frugal(_sign), "row bigint, doc_id bigint, n_shingles bigint, node binary, signature binary, bands array<bigint>"), "signed")
    nodes = materialize(
        signed.where("node is not null").groupBy("node").agg(
            F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"),
            F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands")), "nodes")

    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = materialize(banded.join(shared, "key"), "members").join(nodes.select("node", "signature"), "node")
    tied = _by_group(_in_blocks(members, "key", f"ceil(members / {BLOCK_NODES})").select("g", "node", "signature"), n)
    family = components(tied.mapInArrow(frugal(lambda b: shrink(tie(b))), "a binary, b binary"))

    of = family.join(nodes.select("node", "row", "n_shingles"), "node")
    total = of.groupBy("label").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("blocks"))
    texts = rows.select("row", "text").join(of.join(total, "label"), "row")
    grouped = _by_group(_in_blocks(texts, "label", "blocks").select("g", "node", "text"), n)
    linked = components(grouped.mapInArrow(frugal(lambda b: shrink(confirm(b))), "a binary, b binary"))

    whole = nodes.select("node", "doc_id").join(linked, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = whole.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    result = signed.select("row", "doc_id", "n_shingles", "node").join(
        whole.select("node", "label").join(ids, "label").select("node", "component_id", F.col("label").alias("group")), "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return result.select("row", "doc_id", "n_shingles", component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"), "group")


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row", "group")


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, md5(array_to_string(ws[i:i + 4], ' ')) as sh
  from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id
  group by 1, 2),
links as (
  select p.a, p.b from pairs p join n x on x.doc_id = p.a join n y on y.doc_id = p.b
  where 100 * common >= 85 * (x.n + y.n - common)),
reach(a, b) as (select doc_id, doc_id from w union select r.a, l.b from reach r join links l on l.a = r.b)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.b) as component_id, w.doc_id = min(r.b) as kept
from w left join n using (doc_id) join reach r on r.a = w.doc_id group by w.doc_id"""
