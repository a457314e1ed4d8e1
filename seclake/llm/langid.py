"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes, learned from a bounded sample and
then frozen.  After a context seen t times with d different next bytes, a byte seen c times has
probability c / (t + d), and the escape to the next shorter context d / (t + d); a context which the
language never met passes on at no cost; below the empty context every byte has probability 1/256.

The code length of a text is the sum over its bytes.  As the statistics are frozen, the length of a
byte after a known context is a constant, so all languages' lengths of all known strings are prepared
in one table per order, in units of 2^-12 bit.  Scoring looks the longest strings up in the table, goes
on with the next shorter ones only where that fails, and adds integers: the result is exact whatever
the order and size of the pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .tables import frugal
from .words import slices, text_buffer

ORDER = 4
UNIT = 4096
#: Bytes of text scored at a time; bounds the temporary arrays.
PIECE = 1 << 18
#: Labelled rows learned from, shared evenly by the languages; longer texts are not learned from.
TRAIN_ROWS = 1600
TRAIN_TEXT_BYTES = 1 << 16
UNDETERMINED = "und"
_U = np.uint64
_EMPTY = np.iinfo(np.uint64).max


class _Lookup:
    """Index of 64-bit keys: open addressing in a table at most a quarter full."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _EMPTY, _U)
        self.at = np.zeros(1 << bits, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot] == _EMPTY
            _, first = np.unique(slot[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.keys[slot[take]] = keys[left[take]]
            self.at[slot[take]] = left[take]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.at[slot], -1)
        left = np.flatnonzero((there != keys) & (there != _EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            same = there == keys[left]
            out[left[same]] = self.at[slot[same]]
            go = ~same & (there != _EMPTY)
            left, slot = left[go], slot[go]
        return out


@dataclass
class Model:
    """Frozen statistics: per order, code lengths of strings and escape lengths of contexts."""

    languages: list[str]
    strings: list[_Lookup]  # order k: strings of k + 1 bytes
    lengths: list[np.ndarray]  # (strings, languages)
    contexts: list[_Lookup]  # order k: strings of k bytes
    escapes: list[np.ndarray]  # (contexts, languages)

    def score(self, piece: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code lengths (texts, languages); every text has ORDER bytes of context before its bound."""
        total = np.zeros((len(bounds) - 1, len(self.languages)), np.int64)
        size = np.diff(bounds) - ORDER
        skip = ORDER * np.arange(1, len(size) + 1)
        place = np.arange(int(size.sum())) + np.repeat(skip, size)
        text = np.repeat(np.arange(len(size)), size)
        wide = piece.astype(_U)
        key = np.zeros(len(place), _U)
        for back in range(ORDER, -1, -1):
            key = key << _U(8) | wide[place - back]
        for k in range(ORDER, -1, -1):
            if not len(key):
                return total
            at = self.strings[k].find(key)
            known = at >= 0
            self._add(total, text[known], self.lengths[k], at[known])
            key, text = key[~known], text[~known]
            context = self.contexts[k].find(key >> _U(8))
            met = context >= 0
            self._add(total, text[met], self.escapes[k], context[met])
            key = key & _U((1 << 8 * k) - 1)
        return total + 8 * UNIT * np.bincount(text, minlength=len(total))[:, None]

    @staticmethod
    def _add(total: np.ndarray, text: np.ndarray, table: np.ndarray, at: np.ndarray) -> None:
        if len(at):
            edge = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            total[text[edge]] += np.add.reduceat(table[at], edge, axis=0, dtype=np.int64)

    def code_lengths(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code lengths of texts; a text of any length is read in pieces of bounded size."""
        out = np.zeros((len(at) - 1, len(self.languages)), np.int64)
        for lo, hi in slices(at, PIECE):
            begin = int(at[lo])
            while True:
                stop = min(int(at[hi]), begin + PIECE) if hi == lo + 1 else int(at[hi])
                bounds = np.minimum(np.maximum(at[lo:hi + 1], begin), stop) - begin
                part, bounds = _padded(raw[begin:stop], bounds)
                if begin > at[lo]:  # goes on within a text
                    part[:ORDER] = raw[begin - ORDER:begin]
                out[lo:hi] += self.score(part, bounds)
                if stop >= at[hi]:
                    break
                begin = stop
        return out


def _padded(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ORDER line ends before each, and their bounds."""
    size = np.diff(at)
    out = np.full(len(raw) + ORDER * len(size), 10, np.uint8)
    out[np.arange(len(raw)) + np.repeat(ORDER * np.arange(1, len(size) + 1), size)] = raw
    return out, at + ORDER * np.arange(len(at))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of 1 to ORDER + 1 bytes of each text with their counts; the length stands above the bytes."""
    for batch in batches:
        raw, at = text_buffer(batch.column("text"))
        languages = batch.column("lang").to_pylist()
        for i, language in enumerate(languages):
            piece, _ = _padded(raw[at[i]:at[i + 1]], np.array([0, at[i + 1] - at[i]]))
            wide = piece.astype(_U)
            key = np.zeros(len(piece) - ORDER, _U)
            for k in range(ORDER + 1):
                key = key | wide[ORDER - k:len(piece) - k] << _U(8 * k)
                found, n = np.unique(key, return_counts=True)
                if len(found):
                    yield pa.record_batch({
                        "lang": pa.array([language] * len(found), pa.string()),
                        "key": pa.array((found | _U((k + 1) << 48)).astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def learn(docs: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Model:
    """Learn from at most ``rows`` rows with a text of at most ``TRAIN_TEXT_BYTES`` bytes and a language.

    Of a language which has longer texts only, their beginnings of at most so many bytes are learned.

    The rows are the first of each language by the hash of their id, so the sample is the same in every run
    and does not grow with the table; the string counts which come to the driver are bounded by it.
    """
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                           F.col(lang_col).cast("string").alias("lang")).where("lang is not null and length(text) > 0")
    least = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.min(F.octet_length("text"))).collect()}
    languages = sorted(least)
    if not languages:
        return Model([], [], [], [], [])
    short = labelled.where(F.octet_length("text") <= TRAIN_TEXT_BYTES)
    long_only = [language for language in languages if least[language] > TRAIN_TEXT_BYTES]
    if long_only:  # a character takes four bytes at most
        short = short.unionByName(labelled.where(F.col("lang").isin(long_only)).withColumn("text", F.substring("text", 1, TRAIN_TEXT_BYTES // 4)))
    short = short.withColumn("digest", F.xxhash64("text", "lang"))
    each = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "digest")
    chosen = (short.select("lang", "doc_id", "digest").distinct().withColumn("place", F.row_number().over(each))
              .where(F.col("place") <= max(1, rows // len(languages))).select(F.col("doc_id").alias("id"), F.col("digest").alias("of")))
    # as many rows as the parameter says, so they may go to all tasks; only their texts are moved
    sample = short.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")))
    counts = sample.select("lang", "text").mapInArrow(frugal(_count), "lang string, key bigint, n bigint").groupBy(
        "lang", "key").agg(F.sum("n").alias("n")).toArrow()
    key = counts["key"].to_numpy()
    number = np.searchsorted(languages, counts["lang"].to_numpy(zero_copy_only=False).astype(str))
    n = counts["n"].to_numpy()
    model = Model(languages, [], [], [], [])
    shorter = np.zeros(0, _U)
    for k in range(ORDER + 1):
        own = key >> 48 == k + 1
        strings, row = np.unique((key[own] & ((1 << 48) - 1)).astype(_U), return_inverse=True)
        count = np.zeros((len(strings), len(languages)))
        count[row, number[own]] = n[own]
        contexts, of = np.unique(strings >> _U(8), return_inverse=True)
        seen, kinds = (np.zeros((len(contexts), len(languages))) for _ in range(2))
        np.add.at(seen, of, count)
        np.add.at(kinds, of, count > 0)
        whole = np.maximum(seen + kinds, 1)
        escape = np.where(seen > 0, -np.log2(np.maximum(kinds, 1) / whole), 0)
        below = np.full(count.shape, 8.0) if k == 0 else model.lengths[-1][
            np.searchsorted(shorter, strings & _U((1 << 8 * k) - 1))] / UNIT
        length = np.where(count > 0, -np.log2(np.maximum(count, 1) / whole[of]), escape[of] + below)
        model.strings.append(_Lookup(strings))
        model.lengths.append(np.rint(length * UNIT).astype(np.int32))
        model.contexts.append(_Lookup(contexts))
        model.escapes.append(np.rint(escape * UNIT).astype(np.int32))
        shorter = strings
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Language of every whole text.

    Returns the columns ``keep`` (all, if None; one named like a new column is replaced) and lang_pred,
    lang_score (probability of that language if all are equally likely before), lang_bits (its code length in
    bits per byte).

    Null and empty texts, texts without a letter, and all texts if the model knows no language get ``und``,
    score 0 and null bits.  Of languages with equal lengths the first by name wins.
    """
    new = ["lang_pred", "lang_score", "lang_bits"]
    kept = [f for f in docs.schema.fields if (keep is None or f.name in keep) and f.name not in new]
    quoted = [F.col(f"`{f.name}`") for f in kept]
    # a text which is kept anyway goes to the worker once
    sent = text_col if any(f.name == text_col and f.dataType == StringType() for f in kept) else "__text"
    rows = docs.select(*quoted, *([F.col(text_col).cast("string").alias("__text")] if sent == "__text" else []),
                       F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    names = np.array([*model.languages, UNDETERMINED], dtype=object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one piece after the other is scored and given back, so neither side holds more than a batch
        for batch in (whole.slice(lo, hi - lo) for whole in batches
                      for lo, hi in slices(text_buffer(whole.column(sent))[1], PIECE)):
            raw, at = text_buffer(batch.column(sent))
            best = np.full(batch.num_rows, len(model.languages))
            score, bits = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            good = batch.column("__letter").to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
            if good.any():
                lengths = model.code_lengths(raw, at)[good]
                best[good] = lengths.argmin(axis=1)
                least = lengths.min(axis=1)
                score[good] = 1 / np.exp2((least[:, None] - lengths) / UNIT).sum(axis=1)
                bits[good] = least / UNIT / np.diff(at)[good]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(names[best], pa.string()), pa.array(score),
                 pa.array(bits, mask=~good)], names=[*(f.name for f in kept), *new])

    schema = StructType([*kept, StructField(new[0], StringType()), StructField(new[1], DoubleType()),
                         StructField(new[2], DoubleType())])
    return rows.mapInArrow(frugal(run), schema)


def _held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def op9_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~_held_out()))
    out = identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "lang_pred",
                      F.col("lang_score").alias("score"), "lang_bits")
