"""Best-fit decreasing packing of tokenized documents into sequences of one length.

Documents are encoded where they lie.  What fills whole windows of a document becomes sequences at once; the
remainders are collected into pools of bounded size and packed longest first, each into the open window which
it fills best.  A segment tree over remaining capacities finds that window.  Windows which stay open in the end
are filled up with pieces cut off the emptiest ones, and the last tokens of a task become sequences whose
lengths are powers of two, which need no padding.

Tasks share nothing, so there is no shuffle, and a pool bounds their memory.  Sequences are written as files
(sequence_id, n_tokens, ids, pieces), which hold the real ids; all that is derived from them reads these files.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import frugal, scratch_path
from .token_files import TEXT_PIECE, segments_of
from .words import slices, text_buffer

END_ID = 0
#: Tokens of a sequence; padding of a window which is not filled up by cutting.
WINDOW, SLACK = 1024, 1
#: Remainders which are packed together; sequences sent on at a time.
POOL, AT_ONCE = 1 << 14, 1 << 9

SCHEMA = ("sequence_id bigint, n_tokens int, ids binary, "
          "pieces array<struct<doc_id bigint, start bigint, length bigint, doc_tokens bigint, offset bigint>>")


class OpenWindows:
    """Open windows by remaining capacity.

    A node of the segment tree holds the number of open windows whose capacity lies in its range; ``take``
    climbs from a capacity to the next range with one, and descends to its smallest capacity.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _count(self, capacity: int, change: int) -> None:
        node = self.leaves + capacity
        while node:
            self.open[node] += change
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._count(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove a window with the least capacity of ``need`` or more; (capacity, window)."""
        tree, node = self.open, self.leaves + need
        while not tree[node]:
            while node & 1:  # a right child: nothing greater below its parent
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._count(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit(sizes: np.ndarray, window: int = WINDOW) -> list[list[int]]:
    """Best-fit decreasing: items (by number) of each window; no item is longer than a window."""
    tree = OpenWindows(window)
    filled: list[list[int]] = []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        found = tree.take(size)
        if found is None:
            filled.append([item])
            capacity, number = window, len(filled) - 1
        else:
            capacity, number = found
            filled[number].append(item)
        if capacity > size:
            tree.put(capacity - size, number)
    return filled


def _power(n: int) -> bool:
    return n & (n - 1) == 0


class Piece:
    """Ids of a document from ``start`` on."""

    __slots__ = ("doc_id", "start", "doc_tokens", "ids")

    def __init__(self, doc_id, start: int, doc_tokens: int, ids: np.ndarray):
        self.doc_id, self.start, self.doc_tokens, self.ids = doc_id, start, doc_tokens, ids

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:n]),
                Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[n:]))


Sequence = list[Piece]


def fill_up(pool: Sequence, window: int = WINDOW, slack: int = SLACK) -> tuple[list[Sequence], Sequence]:
    """Sequences of the pieces of a pool, and the pieces (together shorter than a window) which are left.

    Windows with more padding than ``slack`` take what they lack from the emptiest ones, of whose last pieces
    it is cut.
    """
    done: list[Sequence] = []
    loose: list[tuple[int, Sequence]] = []
    for items in best_fit(np.array([len(p.ids) for p in pool], np.int64), window):
        pieces = [pool[i] for i in items]
        length = sum(len(p.ids) for p in pieces)
        if window - length <= slack:
            done.append(pieces)
        else:
            loose.append((length, pieces))
    loose.sort(key=lambda x: x[0])
    first = 0  # the emptiest window which still has pieces
    while len(loose) - first > 1:
        length, pieces = loose.pop()
        while length < window and first < len(loose):
            lacks, (rest, donor) = window - length, loose[first]
            if len(donor[-1].ids) <= lacks:
                taken = donor.pop()
            else:
                taken, donor[-1] = donor[-1].cut(lacks)
            pieces.append(taken)
            length += len(taken.ids)
            loose[first] = (rest - len(taken.ids), donor)
            if not donor:
                first += 1
        if length == window:
            done.append(pieces)
        else:
            return done, pieces
    return done, loose[first][1] if first < len(loose) else []


def powers_of_two(pieces: Sequence) -> Iterator[Sequence]:
    """Cut pieces into sequences whose lengths are powers of two, the longest first."""
    left = sum(len(p.ids) for p in pieces)
    pieces = pieces[::-1]
    while left:
        room, out = 1 << left.bit_length() - 1, []
        left -= room
        while room:
            piece = pieces.pop()
            if len(piece.ids) > room:
                piece, rest = piece.cut(room)
                pieces.append(rest)
            out.append(piece)
            room -= len(piece.ids)
        yield out


def _batch(first: int, sequences: list[Sequence]) -> pa.RecordBatch:
    pieces = [p for s in sequences for p in s]
    size = np.array([len(p.ids) for p in pieces], np.int64)
    ends = np.cumsum([len(s) for s in sequences])  # of the pieces of each sequence
    total = np.concatenate([[0], np.cumsum(size)])
    begin = total[np.concatenate([[0], ends[:-1]])]  # ids before each sequence
    counts = np.diff(ends, prepend=0)
    data = np.concatenate([p.ids for p in pieces]).astype("<u4").tobytes()
    bounds = (4 * np.append(begin, total[-1])).astype(np.int32)
    ids = pa.Array.from_buffers(pa.binary(), len(sequences), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    rows = pa.StructArray.from_arrays([
        pa.array([p.doc_id for p in pieces], pa.int64()), pa.array([p.start for p in pieces], pa.int64()), pa.array(size),
        pa.array([p.doc_tokens for p in pieces], pa.int64()), pa.array(total[:-1] - np.repeat(begin, counts))],
        ["doc_id", "start", "length", "doc_tokens", "offset"])
    return pa.record_batch({
        "sequence_id": pa.array(first + np.arange(len(sequences))), "n_tokens": pa.array(np.diff(bounds) // 4, pa.int32()), "ids": ids,
        "pieces": pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), rows)})


def _sequences(tokenizer: str, end_id: int, window: int, slack: int):
    def documents(batches: Iterable[pa.RecordBatch]):
        segments = segments_of(tokenizer)
        for batch in batches:
            raw, at = text_buffer(batch.column("text"))
            for lo, hi in slices(at, TEXT_PIECE):
                ids, bounds = segments(raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                for doc, a, b in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                    yield doc, ids[a:b]

    def sequences(batches: Iterable[pa.RecordBatch]) -> Iterator[Sequence]:
        pool: Sequence = []
        for doc, ids in documents(batches):
            whole = len(ids) - len(ids) % window
            for start in range(0, whole, window):
                yield [Piece(doc, start, len(ids), ids[start:start + window])]
            if whole < len(ids):
                pool.append(Piece(doc, whole, len(ids), ids[whole:].copy()))
            if len(pool) >= POOL:
                done, pool = fill_up(pool, window, slack)
                yield from done
        done, pool = fill_up(pool, window, slack)
        yield from done
        yield from powers_of_two(pool)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        held: list[Sequence] = []
        for sequence in sequences(batches):
            held.append(sequence)
            if len(held) == AT_ONCE:
                yield _batch(number, held)
                number, held = number + len(held), []
        if held:
            yield _batch(number, held)
    return run


def write_sequences(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, window: int = WINDOW,
                    slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, pack the ids, and write sequences below ``path``.

    ``tokenizer`` is the place of a byte-level BPE file of the tokenizers library on every node.  Null and
    empty texts have the end id only.  Every row is a document of its own, whatever its id (null and repeated
    ids stay as they are); other columns are ignored; an empty table gives no sequences.  A sequence has
    ``window`` ids or up to ``slack`` fewer, but for the last ones of a task, whose lengths are powers of two.
    Sequences of a task are a function of its rows in their order.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.mapInArrow(frugal(_sequences(tokenizer, end_id, window, slack)), SCHEMA).write.option("compression", "zstd").parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of the files: sequence_id, n_tokens, ids (little-endian 32-bit numbers, without padding), pieces."""
    return spark.read.schema(SCHEMA).parquet(path)


def pieces_of(sequences: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of sequences with their ids, and the padding of their sequences."""
    n = F.col("n_tokens")
    padding = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(window - n).cast("bigint")
    return sequences.select("sequence_id", padding.alias("padding"), "ids", F.explode("pieces").alias("p")).selectExpr(
        "p.doc_id", "p.start", "p.length", "substring(ids, int(4 * p.offset + 1), int(4 * p.length)) as ids", "p.doc_tokens",
        "sequence_id", "p.offset", "padding")


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write sequences of ``docs`` to the shared folder and read their pieces back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = scratch_path(docs.sparkSession, "sequences")
    write_sequences(docs, tokenizer, path)
    return pieces_of(read_sequences(docs.sparkSession, path))


def op11_packing(spark, sf_dir: str) -> DataFrame:
    rows = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padding")
