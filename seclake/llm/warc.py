"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own.  A file is read by any number of tasks: each has a byte range,
looks for the gzip magic in it, and takes a place for the start of a member only if decoding from there
gives the first words of a record.  A record belongs to the task in whose range it starts, which reads on
past the end of the range until the record ends.  Inside a record the task goes from member to member,
so magic bytes inside compressed data are not even looked at, except before the first member of a range.

Files are opened with ``pyarrow.fs`` (local and shared folders, HDFS where its client library is installed,
S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import materialize, scratch_path

#: Bytes of a file which a reading task gets, and bytes read at a time.
SPLIT_BYTES, READ_BYTES = 64 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
_GZIP = 31  # window bits of gzip members in zlib
_REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _record(page_id, url: str | None, payload: bytes, sha1: str, refers_to, revisit: bool, date: str) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def _write(path: str, date: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        storage, folder = _open(path)
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        passing = f"{folder}/_{uuid.uuid4().hex}"  # only a whole file gets its name; a second attempt replaces it
        out, records = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = storage.open_output_stream(passing, compression=None)
                out.write(_record(row["page_id"], row["url"], row["payload"] or b"", row["sha1"], row["refers_to"],
                                  row["revisit"], date))
                records += 1
        if out is not None:
            out.close()
            storage.move(passing, name)
            yield pa.record_batch({"file": pa.array([name]), "records": pa.array([records], pa.int64())})
    return run


def write_warc(pages: DataFrame, path: str, min_revisit: int = 0, date: str = "1970-01-01T00:00:00Z",
               id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one record per page below ``path``; returns (file, records).

    Of pages with equal payloads of at least ``min_revisit`` bytes, the one with the smallest id is written in
    full and the others as revisits of it.

    A null payload is an empty one.  Rows which repeat the smallest id with the same payload are all written in
    full.  A null id is larger than any other; pages with equal payloads and no ids are all written in full.
    A null url gives no header, control characters of a url are percent-encoded.  An empty table writes no file.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    keys = materialize(rows.select("page_id", "sha1", F.octet_length("payload").alias("size")), "payloads")
    first = keys.where(F.col("size") >= min_revisit).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = keys.join(first.where("n > 1"), "sha1").where("not page_id <=> first").select(
        F.col("page_id").alias("again"), F.col("sha1").alias("of"), F.col("first").alias("refers_to")).distinct()
    marked = rows.join(again, rows.page_id.eqNullSafe(again.again) & (rows.sha1 == again.of), "left").select(
        "page_id", "url", "payload", "sha1", "refers_to", F.col("of").isNotNull().alias("revisit"))
    storage, folder = _open(path)
    storage.create_dir(folder, recursive=True)
    # the order makes a second attempt of a task write the same file
    placed = marked.sortWithinPartitions("page_id", "sha1", "url")
    return materialize(placed.mapInArrow(_write(path, date), "file string, records bigint"), "archives")


class _Window:
    """Bytes of a file from a place on, read as they are asked for and forgotten once passed."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data, self.ended = file, start, b"", False

    def more(self) -> bool:
        if not self.ended:
            self.file.seek(self.start + len(self.data))
            new = self.file.read(max(READ_BYTES, len(self.data)))
            self.ended = not new
            self.data += new
        return not self.ended

    def forget(self, place: int) -> None:
        self.data, self.start = self.data[place - self.start:], place


def _member(window: _Window, place: int) -> tuple[bytes, int] | None:
    """The decoded member which starts at ``place`` and the place behind it; None if no record starts there."""
    decoder = zlib.decompressobj(_GZIP)
    parts: list[bytes] = []
    have = 0
    used = place - window.start
    while not decoder.eof:
        chunk = window.data[used:used + READ_BYTES]
        if not chunk:
            if not window.more():
                return None
            continue
        used += len(chunk)
        try:
            parts.append(decoder.decompress(chunk))
        except zlib.error:
            return None
        if have < 5:  # decide early
            have = sum(map(len, parts))
            if not b"WARC/".startswith(b"".join(parts)[:5]):
                return None
    text = b"".join(parts)
    return (text, window.start + used - len(decoder.unused_data)) if text.startswith(b"WARC/") else None


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and text of the records whose gzip member starts in ``[start, end)``."""
    window, place = _Window(file, start), start
    while place < end:
        found = window.data.find(MAGIC, place - window.start)
        if found < 0:
            place = max(place, window.start + len(window.data) - len(MAGIC) + 1)
            window.forget(place)
            if not window.more():
                return
            continue
        place = window.start + found
        if place >= end:
            return
        window.forget(place)
        if got := _member(window, place):
            yield place, got[0]
            place = got[1]
        else:
            place += 1


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def parse(text: bytes) -> dict:
    """Fields of a record; the payload of HTTP records is what follows their header."""
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = _fields(head)
    size = fields.get("content-length", "")
    block = rest[:int(size)] if size.isdigit() else rest
    revisit = fields.get("warc-type") == "revisit"
    payload, length = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = _fields(http).get("content-length", "")
        length = int(stated) if revisit and stated.isdigit() else len(payload)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else \
        base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"),
            "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to": fields.get("warc-refers-to"),
            "payload_bytes": length, "payload_digest": digest, "payload": None if revisit else payload}


_RECORD = ("file string, place bigint, record_type string, record_id string, uri string, date string, refers_to string, "
           "payload_bytes bigint, payload_digest string, payload binary")
_RECORD_ARROW = pa.schema([
    *((c, pa.string() if c != "place" else pa.int64()) for c in ("file", "place", "record_type", "record_id", "uri", "date", "refers_to")),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _read(payloads: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                storage, name = _open(split["file"])
                rows, held = [], 0
                with storage.open_input_file(name) as file:
                    for place, text in members(file, split["start"], split["end"]):
                        row = parse(text) | {"file": split["file"], "place": place}
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(text) if payloads else 500
                        if held > 4 * READ_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD_ARROW)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD_ARROW)
    return run


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Records of all ``*.warc.gz`` files below ``path``, one row each.

    Returns file, place (byte offset), record_type, record_id, uri, date, refers_to, payload_bytes and
    payload_digest (bare base32 SHA-1; both computed for full records, as stated for revisits), payload (null for
    revisits, or if not asked for).

    Bytes which are no record are passed over, so are members cut short at the end of a file; empty files give
    no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    splits = files.where("length > 0").select(
        F.col("path").alias("file"), "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes).cast("bigint"))).alias("start"))
    dealt = splits.select("file", "start", F.least(F.col("start") + split_bytes, F.col("length")).alias("end"))
    number = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    return dealt.repartition(max(1, int(number)), "file", "start").mapInArrow(_read(payloads), _RECORD)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.expr(f"cast(nullif(regexp_extract({c}, '<urn:page:(.*)>', 1), '') as bigint)")
    return read_warc(spark, path, payloads=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as bytes, sha1(coalesce(html, '')) as hex from pages),
d as (
  select page_id, bytes, hex, array_to_string(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::int, 5))::int >> (15 - 5 * (i % 4)::int)) & 31), 1)), '') as digest from p),
f as (select hex, min(page_id) as first from p group by hex)
select page_id, bytes::bigint as payload_bytes, digest as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from d join f using (hex)"""
