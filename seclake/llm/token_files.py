"""Token ids in frequency-ranked, byte-aligned variable-length code.

Documents are encoded where they lie.  The ids are counted over the whole corpus and ranked, so that
frequent ids are small numbers.  A rank takes one to four bytes; its length minus one stands as two bits
in a separate control byte, which serves four ranks.  Every document starts at a byte of its own in both
streams.  Files are Parquet tables of blocks of whole documents in ascending doc_id order (shard, block,
doc_ids, sizes, control, data) beside the table of ranks, so any storage and any reader of Spark can hold
them.  Decoding looks the lengths of four ranks up by control byte and the bytes by position, in numpy.

Encoding works on segments: a text is cut where its pre-tokenizer must cut in any case (before a space
which a visible character follows, and around a single line end), and a worker process encodes a segment
once as long as it remembers it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import frugal, partitions, scratch_path
from .words import VALUES, Rolling, slices, text_buffer

END_ID = 2
#: Bytes of text encoded at a time; ids of a block of a file; distinct segments which a worker process remembers
#: (about 60 bytes each); bytes from which on a segment is not remembered; segments given to the library in one call.
TEXT_PIECE, BLOCK_IDS, REMEMBERED, LONG, AT_ONCE = 1 << 21, 1 << 20, 1 << 21, 64, 1 << 13
#: Bytes of numbers which are ranked or packed at a time.
IDS_PIECE = 1 << 21

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def _cuts(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Places at which segments begin, those of ``edges`` among them; what lies behind an edge is not looked at.

    Bytes which may belong to white space beyond ASCII are never taken for visible ones.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    edges = edges[edges < len(raw)]
    visible = (raw > 0x20) & (raw < 0x7F)
    leads = visible | ((raw >= 0xC3) & (raw != 0xE1) & (raw != 0xE2) & (raw != 0xE3))
    next_leads = np.append(leads[1:], False)
    next_leads[edges[edges > 0] - 1] = False
    after_visible = np.concatenate([[False], visible[:-1]])
    after_visible[edges] = False
    line_end = (raw == 0x0A) & after_visible
    cut = ((raw == 0x20) & next_leads) | line_end
    cut[1:] |= line_end[:-1] & leads[1:]
    cut[edges] = True
    return np.flatnonzero(cut)


class _Runs:
    """Runs of values one after the other in arrays which grow."""

    def __init__(self, kind: type):
        self.values, self.ends, self.n = np.zeros(1 << 16, kind), np.zeros(1 << 16, np.int32), 0

    def add(self, values: np.ndarray, size: np.ndarray) -> None:
        used = int(self.ends[self.n])
        for name, need in (("values", used + len(values)), ("ends", self.n + 1 + len(size))):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[:len(old)] = old
                setattr(self, name, new)
        self.values[used:used + len(values)] = values
        self.ends[self.n + 1:self.n + 1 + len(size)] = used + np.cumsum(size)
        self.n += len(size)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.ends[which].astype(np.int64)
        return first, self.ends[which + 1] - first


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs of the given sizes which begin at ``first``, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + size, size)


class _Segments:
    """Ids of segments, each encoded once while remembered.

    Bytes and ids of known segments lie in two arrays, found by hash in a table at most half full; a segment
    found is compared byte by byte.  All are forgotten when the table is full, or too much lies outside it.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens which take the text beside them are not supported")
        strings = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, strings))) if strings else None
        self.hash = Rolling(0x9E3779B97F4A7C15)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at = np.zeros(2 * REMEMBERED, np.uint64), np.zeros(2 * REMEMBERED, np.int32)
        self.known, self.segments, self.ids = 0, _Runs(np.uint8), _Runs(np.int32)

    def _keys(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of segments, never 0; that of a long one is 0."""
        out = np.zeros(len(size), np.uint64)
        short = np.flatnonzero(size <= LONG)
        for lo in range(0, len(short), AT_ONCE):
            some = short[lo:lo + AT_ONCE]
            stop = np.cumsum(size[some])
            values = VALUES[data[_places(first[some], size[some])]]
            out[some] = np.maximum(self.hash.ranges(values, stop - size[some], stop), np.uint64(1))
        return out

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the first known segment with each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(keys)
        slot = self._slot(keys[left])
        while len(left):
            there = self.keys[slot]
            same = there == keys[left]
            out[left[same]] = self.at[slot[same]]
            go = ~same & (there != 0)
            left, slot = left[go], self._next(slot[go])
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & (len(self.keys) - 1)

    def _insert(self, keys: np.ndarray, number: np.ndarray) -> None:
        left = np.flatnonzero(keys)[:REMEMBERED - self.known]
        self.known += len(left)
        slot = self._slot(keys[left])
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            taken, first = np.unique(slot[free], return_index=True)
            self.keys[taken], self.at[taken] = keys[left[free[first]]], number[left[free[first]]]
            rest = np.ones(len(left), bool)
            rest[free[first]] = False
            left, slot = left[rest], self._next(slot[rest])

    def _entries(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of distinct segments; new ones are encoded."""
        if self.known >= REMEMBERED or self.ids.ends[self.ids.n] > 8 * REMEMBERED or self.segments.ends[self.segments.n] > 16 * REMEMBERED:
            self._forget()
        first, size = ends[:-1], np.diff(ends)
        keys = self._keys(data, first, size)
        out = self._find(keys)
        hit = np.flatnonzero(out >= 0)
        begin, length = self.segments.of(out[hit])
        out[hit[length != size[hit]]] = -1
        hit, begin = hit[length == size[hit]], begin[length == size[hit]]
        if len(hit):
            other = data[_places(first[hit], size[hit])] != self.segments.values[_places(begin, size[hit])]
            out[hit[np.add.reduceat(other, np.cumsum(size[hit]) - size[hit], dtype=np.int64) > 0]] = -1
        new = np.flatnonzero(out < 0)
        for lo in range(0, len(new), AT_ONCE):  # what the library returns is many times larger than the ids
            some = new[lo:lo + AT_ONCE]
            encoded = self.tokenizer.encode_batch_fast(
                [data[a:b].tobytes().decode() for a, b in zip(first[some], ends[some + 1])], add_special_tokens=False)
            out[some] = self.ids.n + np.arange(len(some))
            ids = [e.ids for e in encoded]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            self.ids.add(np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())), n)
            kept = np.where(keys[some] > 0, size[some], 0)  # long ones are never looked up
            self.segments.add(data[_places(first[some], kept)], kept)
        self._insert(keys[new], out[new])
        return out

    def _whole(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of strings of added tokens, which the library takes out of a text before all else."""
        begin, end, place = [], [], 0
        while self.added and (hit := self.added.search(raw, place)):
            edge = int(at[np.searchsorted(at, hit.start(), "right")])  # the end of its text
            if hit.end() <= edge:
                begin.append(hit.start())
                end.append(hit.end())
            place = min(hit.end(), edge)
        return np.array(begin, np.int64), np.array(end, np.int64)

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, and their bounds."""
        begin, end = self._whole(raw, at)
        cut = _cuts(raw, np.unique(np.concatenate([at, begin, end])))
        if len(begin):
            token = np.searchsorted(begin, cut) - 1  # the last one which begins before the cut
            cut = cut[(token < 0) | (cut >= end[token])]
        if not len(cut):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        offsets = np.append(cut, len(raw)).astype(np.int32)
        coded = pc.dictionary_encode(pa.Array.from_buffers(
            pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]))
        first, size = self.ids.of(self._entries(*text_buffer(coded.dictionary)))
        which = coded.indices.to_numpy()
        n = size[which]
        out = self.ids.values[_places(first[which], n)]
        return out, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(cut, at)]


@lru_cache(maxsize=2)
def segments_of(path: str) -> _Segments:
    """Encoder of a tokenizer file; one per worker process, which runs many tasks."""
    return _Segments(path)


def _encode(path: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = segments_of(path)
        for batch in batches:
            raw, at = text_buffer(batch.column("text"))
            for lo, hi in slices(at, TEXT_PIECE):
                ids, bounds = segments(raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                ids = np.insert(ids, bounds[1:], end_id).astype("<i4")
                bounds = bounds + np.arange(len(bounds))
                narrow = not len(ids) or int(ids.max()) < 1 << 16
                data = ids.astype("<u2" if narrow else "<u4")
                rows = [data[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(lo, hi - lo), "row": batch.column("row").slice(lo, hi - lo),
                    "n": pa.array(np.diff(bounds)), "wide": pa.array([not narrow] * (hi - lo)),
                    "ids": pa.array(rows, pa.binary())})
    return run


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.column("n").to_numpy()
    parts = [np.frombuffer(b, "<u4" if w else "<u2") for b, w in
             zip(batch.column("ids").to_pylist(), batch.column("wide").to_pylist())]
    return (np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)), n


def _small(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Parts of batches whose ``column`` takes about ``IDS_PIECE`` bytes; a longer row stands alone."""
    for batch in batches:
        for lo, hi in slices(text_buffer(batch.column(column))[1], IDS_PIECE):
            yield batch.slice(lo, hi - lo)


def _tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in _small(batches, "ids"):
        count = np.bincount(_numbers(batch)[0])
        if len(count) > len(total):
            total = np.pad(total, (0, len(count) - len(total)))
        total[:len(count)] += count
    there = np.flatnonzero(total)
    yield pa.record_batch({"id": pa.array(there), "n": pa.array(total[there])})


def pack(ranks: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of runs of ranks of the given sizes, with the bounds of both."""
    length = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = -(-size // 4)
    ends = np.cumsum(size)
    place = np.arange(len(ranks)) + np.repeat(4 * (np.cumsum(quads) - quads) - ends + size, size)
    codes = np.zeros(4 * int(quads.sum()), np.uint8)
    codes[place] = length - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    stop = np.cumsum(length)
    begin = stop - length
    data = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    for k in range(4):
        long = length > k
        data[begin[long] + k] = ranks[long] >> 8 * k & 0xFF
    return (control, data, np.concatenate([[0], np.cumsum(quads)]),
            np.concatenate([[0], stop])[np.concatenate([[0], ends])])


def unpack(control: np.ndarray, data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ranks of runs of the given sizes: lengths by control byte, then four bytes at each place, masked."""
    quads = -(-size // 4)
    ends = np.cumsum(size)
    place = np.arange(int(size.sum())) + np.repeat(4 * (np.cumsum(quads) - quads) - ends + size, size)
    length = _LENGTHS[control].reshape(-1)[place]
    stop = np.cumsum(length, dtype=np.int64)
    begin = stop - length
    more = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    out = more[begin]
    for k in range(1, 4):
        long = np.flatnonzero(length > k)
        out[long] |= more[begin[long] + k] << np.uint32(8 * k)
    return out


def _blocks(by_id: np.ndarray):
    """Blocks of whole documents of the sorted rows of a shard, ranked and packed; a longer document stands alone."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        total = 0

        def block():
            nonlocal held, total, number
            ids, n, control, data = zip(*held)
            out = pa.record_batch({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int64()), "ids": pa.array([total], pa.int64()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([n], pa.list_(pa.int64())),
                "control": pa.array([b"".join(control)], pa.binary()), "data": pa.array([b"".join(data)], pa.binary())})
            held, total, number = [], 0, number + 1
            return out

        for batch in _small(batches, "ids"):
            ids, n = _numbers(batch)
            control, data, c, d = pack(by_id[ids], n)
            control, data = control.tobytes(), data.tobytes()
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                if held and total + int(n[i]) > BLOCK_IDS:
                    yield block()
                held.append((doc, int(n[i]), control[c[i]:c[i + 1]], data[d[i]:d[i + 1]]))
                total += int(n[i])
        if held:
            yield block()
    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write token files below ``path``.

    ``tokenizer`` is the place of a byte-level BPE file of the tokenizers library on every node.  Rows are
    written in ascending doc_id order, null first, equal ids in input order.  Null and empty texts have the end
    id only.  An empty table gives empty files; other columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    at = scratch_path(spark, "ids")
    rows.mapInArrow(frugal(_encode(tokenizer, end_id)), "doc_id bigint, row bigint, n bigint, wide boolean, ids binary").write.option(
        "compression", "zstd").parquet(at)
    coded = spark.read.parquet(at)
    counts = coded.mapInArrow(frugal(_tally), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a vocabulary
    counts = counts.sort_values(["n", "id"], ascending=[False, True])
    ids = counts["id"].to_numpy(np.int64)
    by_id = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    by_id[ids] = np.arange(len(ids))
    spark.createDataFrame(list(enumerate(ids.tolist())), "rank bigint, id bigint").coalesce(1).write.parquet(f"{path}/ranks")
    # rows are dealt out before they are ranked: finding the bounds of the ranges reads the stored rows once more
    (coded.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row")
     .mapInArrow(frugal(_blocks(by_id)), "shard int, block bigint, ids bigint, doc_ids array<bigint>, sizes array<bigint>, "
                                         "control binary, data binary")
     .write.option("compression", "zstd").parquet(f"{path}/blocks"))


def _decode(by_rank: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 1) for whole in batches for i in range(whole.num_rows)):
            doc_ids, size = (batch.column(c).to_pylist()[0] for c in ("doc_ids", "sizes"))
            control, data = (np.frombuffer(batch.column(c)[0].as_py(), np.uint8) for c in ("control", "data"))
            size = np.array(size, np.int64)
            ids = by_rank[unpack(control, data, size)].astype("<u4")
            ends = np.cumsum(size)
            n = len(size)
            yield pa.record_batch({
                "shard": pa.array([batch.column("shard")[0].as_py()] * n, pa.int32()),
                "block": pa.array([batch.column("block")[0].as_py()] * n, pa.int64()),
                "doc_id": pa.array(doc_ids, pa.int64()), "before": pa.array(ends - size), "n_tokens": pa.array(size),
                "ids": pa.array([ids[a:b].tobytes() for a, b in zip(ends - size, ends)], pa.binary())})
    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Read token files: doc_id, start (ids of all documents before), n_tokens, ids (little-endian 32-bit numbers)."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()  # a vocabulary
    by_rank = ranks["id"].to_numpy(np.int64) if len(ranks) else np.zeros(1, np.int64)
    blocks = spark.read.schema("shard int, block bigint, ids bigint, doc_ids array<bigint>, sizes array<bigint>, "
                               "control binary, data binary").parquet(f"{path}/blocks")
    # ids before each block: over the few shards, then inside each
    sums = blocks.groupBy("shard").agg(F.sum("ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sums.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("ids").over(inside), F.lit(0)).alias("inner")).join(
        shards, "shard").select("shard", "block", (F.col("base") + F.col("inner")).alias("base"))
    rows = blocks.mapInArrow(frugal(_decode(by_rank)), "shard int, block bigint, doc_id bigint, before bigint, n_tokens bigint, ids binary")
    return rows.select("*", F.crc32("ids").alias("crc")).join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids", "crc")


def tokens_of(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write token files of ``docs`` to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    return tokens_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
