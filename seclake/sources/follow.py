"""Log files followed by bytes: what is appended to a file is read once, whole lines only.

A streaming source of Spark's Python data source interface.  Its offset is the number of bytes read of each
file, up to the end of the last finished line; a line which has no end yet waits for the next batch.  Ranges
of bytes become partitions and travel as Arrow batches.  A file which has become shorter was replaced and is
read from its beginning; one which is gone is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.text import strip

FORMAT = "appended_lines"
SCHEMA = "file string, seq bigint, line binary"
#: Bytes of a partition; bytes read at a time; bytes in which a file's last line end is looked for.
PARTITION_BYTES, READ_BYTES, TAIL_BYTES = 64 << 20, 4 << 20, 1 << 16
NEWLINE, RETURN = 10, 13


def _open(uri: str):
    """File system and path of a URI or an absolute path (local and shared folders, HDFS, object stores)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _sizes(uri: str, pattern: str) -> dict[str, int]:
    """Size of every file below a folder whose name fits the pattern; hidden ones are passed over."""
    from fnmatch import fnmatch

    from pyarrow import fs

    system, path = _open(uri)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in found
            if f.type == fs.FileType.File and fnmatch(f.base_name, pattern) and not f.base_name.startswith((".", "_"))}


def finished(system, path: str, start: int, size: int) -> int:
    """Place behind the last line end between ``start`` and ``size``; ``start`` if there is none."""
    with system.open_input_file(path) as file:
        stop = size
        while stop > start:
            begin = max(start, stop - TAIL_BYTES)
            place = file.read_at(stop - begin, begin).rfind(b"\n")
            if place >= 0:
                return begin + place + 1
            stop = begin
    return start


@dataclass
class _Range(InputPartition):
    """Lines which begin in [start, stop) of a file; the first line of the range begins at ``first``."""

    path: str
    start: int
    stop: int
    first: int


def ranges(path: str, first: int, stop: int, size: int = PARTITION_BYTES) -> list[_Range]:
    return [_Range(path, at, min(at + size, stop), first) for at in range(first, stop, size)]


def lines_of(data: bytes, at: int) -> tuple[np.ndarray, pa.Array]:
    """Places and texts of the non-empty lines of ``data``, which begins at place ``at`` of its file."""
    raw = np.frombuffer(data, np.uint8)
    end = (raw == NEWLINE) | (raw == RETURN)
    ends = np.flatnonzero(end)
    if not len(raw) or not end[-1]:
        ends = np.append(ends, len(raw))
    starts = np.append(0, ends[:-1] + 1)
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    text = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~end].tobytes())])
    return starts + at, text


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        options = {name.lower(): value for name, value in options.items()}
        self.uri, self.pattern = options["path"], options.get("pattern", "*")
        self.existing = options.get("process_existing", "true").lower() == "true"
        self.ended = options.get("ended", "false").lower() == "true"
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))
        self.known: dict[str, tuple[int, int]] = {}  # size and finished bytes of each file when last looked at

    def initialOffset(self) -> dict:
        return {} if self.existing else self.latestOffset()

    def latestOffset(self) -> dict:
        system, _ = _open(self.uri)
        now = {}
        for path, size in sorted(_sizes(self.uri, self.pattern).items()):
            before, done = self.known.get(path, (0, 0))
            if size < before:
                done = 0
            now[path] = (size, done if size == before else finished(system, path, done, size))
        self.known = now
        return {path: size if self.ended else done for path, (size, done) in now.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, stop in end.items():
            first = start.get(path, 0)
            out += ranges(path, 0 if stop < first else first, stop, self.size)
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.uri)
        with system.open_input_file(partition.path) as file:
            at, held = partition.start, b""
            skip = at > partition.first  # the line which goes on here belongs to the range in which it begins
            if skip and file.read_at(1, at - 1) == b"\n":
                skip = False
            size = file.size()
            begin = at
            while begin < size:
                data = file.read_at(min(READ_BYTES, size - begin), begin)
                begin += len(data)
                if skip:
                    place = data.find(b"\n")
                    if place < 0:
                        at = begin
                        if at >= partition.stop:
                            return
                        continue
                    at, data, skip = begin - len(data) + place + 1, data[place + 1:], False
                if at + len(held) >= partition.stop and not held:
                    return
                held += data
                if at + len(held) >= partition.stop:  # up to the end of the line which goes over the range's end
                    cut = held.find(b"\n", partition.stop - at - 1)
                    if cut >= 0 or begin >= size:
                        yield self._batch(partition, held[:cut + 1] if cut >= 0 else held, at)
                        return
                cut = held.rfind(b"\n") + 1
                if cut and at + cut < partition.stop:
                    yield self._batch(partition, held[:cut], at)
                    at, held = at + cut, held[cut:]
            if held:
                yield self._batch(partition, held, at)

    def _batch(self, partition: _Range, data: bytes, at: int) -> pa.RecordBatch:
        place, text = lines_of(data, at)
        keep = place < partition.stop
        place, text = place[keep], text.filter(pa.array(keep))
        return pa.record_batch({"file": pa.array([partition.path] * len(place), pa.string()),
                                "seq": pa.array(place, pa.int64()), "line": text})


class AppendedLines(DataSource):
    """``spark.readStream.format("appended_lines").load(folder)``: lines appended to the files of a folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def follow_lines(
    spark: SparkSession,
    folder: str,
    pattern: str = "*",
    process_existing: bool = True,
    ended: bool = False,
    partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """``file, seq, line`` of lines as they are finished; ``seq`` is the byte at which a line begins.

    ``process_existing=False`` begins at the files' present ends.  ``ended=True`` says that nobody writes any
    more, so last lines without an end count too.  Bytes which are no UTF-8 are dropped, blank lines left out.
    """
    spark.dataSource.register(AppendedLines)
    raw = (
        spark.readStream.format(FORMAT)
        .option("pattern", pattern)
        .option("process_existing", str(process_existing).lower())
        .option("ended", str(ended).lower())
        .option("partition_bytes", partition_bytes)
        .load(folder)
    )
    text = "cast(line as string)"
    known = f"coalesce(try_validate_utf8({text}), replace(make_valid_utf8({text}), '\\uFFFD', ''))"
    return raw.selectExpr("file", "seq", f"{strip(known)} as line").where("line <> ''")
