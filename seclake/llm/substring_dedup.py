"""Substring deduplication with fixed-block anchors.

Repeats of ``window`` or more words are found in three steps over chunks of documents:

1. *Index and probe.*  The non-overlapping blocks of ``block`` words of every document are the
   index; every rolling window of ``block`` words is a probe.  With ``window >= 2 * block - 1``
   each window of an earlier document contains a whole block of it, so each repeat of ``window``
   words has at least one probe which meets a block.  A chunk sends each distinct probe once
   (4 bytes: 30 bits of the hash, "is a block", "more than once"), so a passage shared by a third
   of the corpus costs one entry per chunk, not one per occurrence.
2. *Extend.*  Windows of ``window`` words around a hit are compared by a 64-bit hash within a
   bucket of a second, independent hash; the smallest (doc_id, place) of each is its origin.
3. *Merge.*  Repeated windows run together into maximal spans, which are removed.

The answer to a chunk is a bitmap over the entries it sent; the chunk computes its entries again
instead of storing them.  Documents are stored once, bucketed by chunk, and never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bucketed, materialize, partitions
from .words import PIECE, slices, text_buffer, windows, words

#: Documents of a chunk, as a power of two.
CHUNK_BITS = 10
#: Entries which one bucket of step 1 gets on average; bounds the memory of its task.
BUCKET_ENTRIES = 1 << 20
_LAST = np.iinfo(np.int64).max
_U = np.uint64


def _ordered(t: pa.Table) -> pa.Table:
    """Rows in the order in which repeats are judged: doc_id (null last), then input order."""
    return t.sort_by([("doc_id", "ascending"), ("row", "ascending")])


def _ids(t: pa.Table) -> np.ndarray:
    return t["doc_id"].combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(n)) >> _U(32)


def _probes(h: np.ndarray, bounds: np.ndarray, block: int, n: int):
    """Positions of all rolling windows, their 30-bit keys below the bucket, and the distinct keys."""
    where, wh = windows(h, bounds, block)
    key = _bucket(wh, n) << _U(30) | (wh & _U((1 << 30) - 1))
    place = where - np.repeat(bounds[:-1], np.maximum(np.diff(bounds) - block + 1, 0))
    both = np.sort(key << _U(1) | (place % block == 0).astype(_U))
    k = both >> _U(1)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    end = np.append(first[1:], len(k))
    flags = (both[end - 1] & _U(1)) << _U(1) | (end - first > 1).astype(_U) if len(k) else k
    return where, key, k[first], flags


def _pieces(sorted_buckets: np.ndarray, n: int):
    """(bucket, from, to) of the buckets which have entries."""
    edges = np.searchsorted(sorted_buckets, np.arange(n + 1))
    for b in np.flatnonzero(edges[1:] > edges[:-1]):
        yield int(b), int(edges[b]), int(edges[b + 1])


def _bits(answers: pa.Table, sorted_buckets: np.ndarray, n: int, step: int) -> np.ndarray:
    out = np.zeros(len(sorted_buckets), bool)
    found = {b: bits for s, b, bits in zip(answers["step"].to_pylist(), answers["bucket"].to_pylist(),
                                          answers["bits"].to_pylist()) if s == step}
    for b, lo, hi in _pieces(sorted_buckets, n):
        out[lo:hi] = np.unpackbits(np.frombuffer(found[b], np.uint8), count=hi - lo)
    return out


class _Chunk:
    """Words of a chunk and, as far as answers are there, its repeated windows."""

    def __init__(self, t: pa.Table, block: int, window: int, n: int):
        self.t, self.block, self.window, self.n = _ordered(t), block, window, n
        self.ids = _ids(self.t)
        self.raw, self.at = text_buffer(self.t["text"])
        self.start, self.end, self.h, self.bounds = words(self.raw, self.at)

    def probes(self):
        return _probes(self.h, self.bounds, self.block, self.n)

    def candidates(self, answers: pa.Table):
        """Starts of windows around a hit, and which are the first of their kind in the chunk."""
        where, key, distinct, _ = self.probes()
        hit = _bits(answers, distinct >> _U(30), self.n, 1)
        mark = np.zeros(len(self.h) + 1, np.int64)
        mark[where] = hit[np.searchsorted(distinct, key)]
        sums = np.concatenate([[0], np.cumsum(mark)])
        # all window hashes first: the places are needed anyway and the prefix sums are shared
        places, first = windows(self.h, self.bounds, self.window)
        _, second = windows(self.h, self.bounds, self.window, second=True)
        near = sums[places + self.window - self.block + 1] > sums[places]
        places, first, second = places[near], first[near], second[near]
        order = np.argsort(first, kind="stable")  # ties stay in order of place
        new = np.concatenate([[True], first[order][1:] != first[order][:-1]]) if len(order) else np.zeros(0, bool)
        heads = order[new]
        bucket = _bucket(second[heads], self.n)
        by_bucket = np.argsort(bucket, kind="stable")
        group = np.empty(len(order), np.int64)
        rank = np.empty(len(heads), np.int64)
        rank[by_bucket] = np.arange(len(heads))
        group[order] = rank[np.cumsum(new) - 1]
        heads = heads[by_bucket]
        return places, first, heads, bucket[by_bucket], group

    def repeated(self, answers: pa.Table) -> np.ndarray:
        """Which words are covered by a window that also starts earlier."""
        places, _, heads, bucket, group = self.candidates(answers)
        later = _bits(answers, bucket, self.n, 2)[group]
        is_head = np.zeros(len(places), bool)
        is_head[heads] = True
        places = places[later | ~is_head]
        step = np.zeros(len(self.h) + 1, np.int64)
        np.add.at(step, places, 1)
        np.add.at(step, places + self.window, -1)
        return np.cumsum(step[:-1]) > 0


def _send_probes(block: int, window: int, n: int):
    def run(t: pa.Table) -> pa.Table:
        c = _Chunk(t, block, window, n)
        _, _, keys, flags = c.probes()
        entries = ((keys & _U((1 << 30) - 1)) << _U(2) | flags).astype(np.uint32)
        rows = list(_pieces(keys >> _U(30), n))
        return pa.table({
            "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
            "chunk": pa.array([t["chunk"][0].as_py()] * len(rows), pa.int64()),
            "entries": pa.array([entries[lo:hi].tobytes() for _, lo, hi in rows], pa.binary()),
        })
    return run


def _spread(t: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of blobs and the row of each."""
    blobs = t[name].to_pylist()
    sizes = np.array([len(b) for b in blobs]) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(blobs), kind), np.repeat(np.arange(len(blobs)), sizes)


def _answer(t: pa.Table, rows: np.ndarray, flag: np.ndarray, step: int) -> pa.Table:
    edges = np.searchsorted(rows, np.arange(len(t) + 1))
    return pa.table({
        "chunk": t["chunk"], "step": pa.array([step] * len(t), pa.int32()), "bucket": t["bucket"],
        "bits": pa.array([np.packbits(flag[lo:hi]).tobytes() for lo, hi in zip(edges, edges[1:])], pa.binary()),
    })


def _meet_blocks(t: pa.Table) -> pa.Table:
    """An entry is a hit if its hash is that of some block and occurs more than once."""
    v, rows = _spread(t, "entries", np.uint32)
    order = np.argsort(v >> 2, kind="stable")
    k = v[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] >> 2 != k[:-1] >> 2]))
    flags = np.bitwise_or.reduceat(k & 3, first)
    count = np.diff(np.append(first, len(k)))
    good = (flags & 2 > 0) & ((flags & 1 > 0) | (count > 1))
    hit = np.empty(len(v), bool)
    hit[order] = np.repeat(good, count)
    return _answer(t, rows, hit, 1)


def _send_windows(block: int, window: int, n: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t):
            return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()),
                             "keys": pa.array([], pa.binary()), "docs": pa.array([], pa.binary())})
        c = _Chunk(t, block, window, n)
        places, key, heads, bucket, _ = c.candidates(answers)
        doc = c.ids[np.searchsorted(c.bounds, places[heads], "right") - 1]
        keys = key[heads]
        rows = list(_pieces(bucket, n))
        return pa.table({
            "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
            "chunk": pa.array([t["chunk"][0].as_py()] * len(rows), pa.int64()),
            "keys": pa.array([keys[lo:hi].tobytes() for _, lo, hi in rows], pa.binary()),
            "docs": pa.array([doc[lo:hi].tobytes() for _, lo, hi in rows], pa.binary()),
        })
    return run


def _find_origins(t: pa.Table) -> pa.Table:
    """An entry is a repeat if another chunk has the window in an earlier document."""
    keys, rows = _spread(t, "keys", np.uint64)
    docs, _ = _spread(t, "docs", np.int64)
    chunk = t["chunk"].to_numpy()[rows]
    order = np.lexsort((chunk, docs, keys))
    k = keys[order]
    later = np.empty(len(keys), bool)
    later[order] = np.concatenate([[False], k[1:] == k[:-1]])
    return _answer(t, rows, later, 2)


def _kept(c: _Chunk, gone: np.ndarray) -> pa.Array:
    """Texts of the words that stay, joined by one space."""
    parts = []
    for lo, hi in slices(c.at, PIECE):
        span = slice(c.bounds[lo], c.bounds[hi])
        stay = ~gone[span]
        start, size = c.start[span][stay], (c.end - c.start)[span][stay] + 1
        last = np.cumsum(size)
        from_ = np.arange(int(last[-1]) if len(last) else 0) + np.repeat(start - last + size, size)
        out = c.raw[np.minimum(from_, len(c.raw) - 1)] if len(from_) else np.zeros(0, np.uint8)
        out[last - 1] = 0x20
        text_end = np.concatenate([[0], last])[np.searchsorted(np.flatnonzero(stay) + span.start, c.bounds[lo:hi + 1])]
        data = out.tobytes()
        parts.append(pa.array([data[a:max(a, b - 1)] for a, b in zip(text_end, text_end[1:])], pa.binary()))
    return pa.concat_arrays(parts).cast(pa.string()) if parts else pa.array([], pa.string())


_OUT = "doc_id bigint, row bigint, n_words bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept_text string"
_OUT_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
    ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])


def _cut(block: int, window: int, n: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t):
            return _OUT_ARROW.empty_table()
        c = _Chunk(t, block, window, n)
        gone = c.repeated(answers)
        total = np.concatenate([[0], np.cumsum(gone)])
        count = np.diff(c.bounds)
        edge = np.zeros(len(gone) + 1, bool)  # spans end with their text
        edge[c.bounds] = True
        begin = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
        stop = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
        doc = np.searchsorted(c.bounds, begin, "right") - 1
        spans = pa.StructArray.from_arrays(
            [pa.array(begin - c.bounds[doc]), pa.array(stop - c.bounds[doc])], ["start", "end"])
        offsets = pa.array(np.searchsorted(doc, np.arange(len(c.t) + 1)), pa.int32())
        return pa.table([
            c.t["doc_id"], c.t["row"], pa.array(count), pa.array(total[c.bounds[1:]] - total[c.bounds[:-1]]),
            pa.ListArray.from_arrays(offsets, spans), _kept(c, gone)], schema=_OUT_ARROW)
    return run


def remove_repeats(docs: DataFrame, window: int = 20, block: int = 10,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts earlier.

    Earlier means in a document with a smaller id, or before in the same document; all windows are
    judged on the input.  Words are runs of bytes other than space and ``\\t\\n\\v\\f\\r``.

    Returns one row per input row: doc_id, row (identity of the input row), n_words, n_removed,
    removed (spans of word positions, end exclusive), kept_text (words that stay, joined by one space).

    Null or empty text: no words, kept_text empty.  Texts shorter than a window keep all words.
    Rows with the same id are told apart by their input order, so the second of two equal rows is
    the later one.  A null id counts as the largest.  An empty table gives an empty result; other
    columns are ignored.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block: window >= 2 * block - 1")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    stored = bucketed(rows.select("*", F.shiftright("row", CHUNK_BITS).alias("chunk"),
                                  F.octet_length("text").alias("size")), "chunk", partitions(spark))
    size = stored.agg(F.sum("size")).first()[0] or 0
    n = max(partitions(spark), size // (6 * BUCKET_ENTRIES) + 1)  # a word has about six bytes
    by_chunk = stored.select("chunk", "row", "doc_id", "text").groupBy("chunk")
    args = (block, window, n)
    answer = "chunk bigint, step int, bucket int, bits binary"
    probes = by_chunk.applyInArrow(_send_probes(*args), "bucket int, chunk bigint, entries binary")
    hits = materialize(probes.groupBy("bucket").applyInArrow(_meet_blocks, answer), "hits")
    sent = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(
        _send_windows(*args), "bucket int, chunk bigint, keys binary, docs binary")
    origins = materialize(sent.groupBy("bucket").applyInArrow(_find_origins, answer), "origins")
    return by_chunk.cogroup(hits.unionByName(origins).groupBy("chunk")).applyInArrow(_cut(*args), _OUT)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with w as (
  select doc_id, generate_subscripts(ws, 1) as p, unnest(ws) as word, len(ws) as n
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents)),
g as (
  select doc_id, p, string_agg(word, ' ') over (partition by doc_id order by p rows between current row and 19 following) as gram
  from w qualify p + 19 <= n),
later as (select doc_id, p from g qualify row_number() over (partition by md5(gram) order by doc_id, p) > 1),
near as (
  select w.doc_id, w.p, w.word, max(l.p) over (partition by w.doc_id order by w.p rows between 19 preceding and current row) as hit
  from w left join later l using (doc_id, p)),
k as (
  select doc_id, count(*) as n_words, count(hit) as n_removed,
    coalesce(string_agg(word, ' ' order by p) filter (where hit is null), '') as kept
  from near group by doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from documents d left join k using (doc_id)"""
