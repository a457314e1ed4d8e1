"""Words of many texts at once, as numpy arrays inside a task.

A text column of an Arrow batch is one byte buffer with offsets.  Words, their hashes
and the hashes of word windows come from whole-array operations on that buffer, a few
nanoseconds per byte, without a Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes handled at a time; bounds the temporary arrays (several of 8 bytes per byte of text).
PIECE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values which spreads every input bit over the output."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    have = 1
    while have < n:  # doubling
        take = min(have, n - have)
        step = _U(pow(base, have, 1 << 64))
        out[have:have + take] = out[:take] * step
        have += take
    return out


class Rolling:
    """Hash of any range of a sequence of 64-bit values from prefix sums, modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))
            self._up, self._down = _powers(self.base, size), _powers(self.inverse, size)

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ``values[start:end]``; equal ranges have equal hashes wherever they are."""
        n = len(values)
        self._grow(n + 1)
        sums = np.empty(n + 1, _U)
        sums[0] = 0
        np.cumsum(values * self._up[:n], out=sums[1:])
        return _mix((sums[end] - sums[start]) * self._down[start] + (end - start).astype(_U))


_BYTES = Rolling(0x9E3779B97F4A7C15 | 1)
_FIRST, _SECOND = Rolling(0xD1342543DE82EF95 | 1), Rolling(0xA0761D6478BD642F | 1)


def _values(lower: bool) -> np.ndarray:
    out = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    if lower:
        out[65:91] = out[97:123]
    return out


_VALUES = {False: _values(False), True: _values(True)}
VALUES = _VALUES[False]
#: Bytes of words `[^\x20\x09-\x0D]+`.
VISIBLE = np.ones(256, bool)
VISIBLE[[0x20, *range(0x09, 0x0E)]] = False


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def words(raw: np.ndarray, at: np.ndarray, inside: np.ndarray = VISIBLE, lower: bool = False):
    """Starts, ends and hashes of all words, and where each text's words begin (n + 1 values).

    A word is a run of bytes for which ``inside`` holds; texts are bounded by ``at``.
    """
    n = len(raw)
    starts, ends, hashes = [], [], []
    begin = 0
    while begin < n:
        stop = min(n, begin + PIECE)
        if stop < n:  # cut behind a word
            out = ~inside[raw[stop:stop + PIECE]]
            while not out.any() and stop + len(out) < n:
                stop += len(out)
                out = ~inside[raw[stop:stop + PIECE]]
            stop = stop + int(out.argmax()) if out.any() else n
        piece = raw[begin:stop]
        flag = inside[piece]
        first = np.zeros(len(piece) + 1, bool)
        cuts = at[np.searchsorted(at, begin):np.searchsorted(at, stop, "right")] - begin
        first[cuts] = True
        first[0] = first[-1] = True
        s = flag.copy()
        s[1:] &= ~flag[:-1] | first[1:-1]
        e = flag.copy()
        e[:-1] &= ~flag[1:] | first[1:-1]
        s, e = np.flatnonzero(s), np.flatnonzero(e) + 1
        hashes.append(_BYTES.ranges(_VALUES[lower][piece], s, e))
        starts.append(s + begin)
        ends.append(e + begin)
        begin = stop
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U), np.zeros(len(at), np.int64)
    s, e, h = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    return s, e, h, np.searchsorted(s, at)


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int, second: bool = False):
    """Positions and hashes of all windows of ``size`` words which lie in one text."""
    n = np.diff(bounds)
    room = np.maximum(n - size + 1, 0)
    total = int(room.sum())
    first = np.cumsum(room) - room
    where = np.arange(total) + np.repeat(bounds[:-1] - first, room)
    return where, (_SECOND if second else _FIRST).ranges(hashes, where, where + size)


def slices(at: np.ndarray, limit: int):
    """Ranges of texts of about ``limit`` bytes together; a longer text stands alone."""
    begin, n = 0, len(at) - 1
    while begin < n:
        end = int(np.searchsorted(at, at[begin] + limit, "right")) - 1
        end = min(max(end, begin + 1), n)
        yield begin, end
        begin = end
