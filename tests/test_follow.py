"""Files followed by bytes, and callbacks which keep a state over batches."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seclake.sources import follow
from seclake.streaming import live


class Logs:
    def __init__(self, spark, path):
        self.spark, self.path, self.folder = spark, path, str(path / "logs")
        os.mkdir(self.folder)

    def put(self, name, data, mode="ab"):
        with open(f"{self.folder}/{name}", mode) as file:
            file.write(data)

    def run(self, **options):
        """New lines since the last run as (file, seq, line)."""
        rows = follow.follow_lines(self.spark, self.folder, **options)
        before = self.read(rows.schema)
        live.append_to_table(rows, f"{self.path}/table", f"{self.path}/checkpoint", availableNow=True).awaitTermination()
        return sorted(set(self.read(rows.schema)) - set(before))

    def read(self, schema):
        if not os.path.exists(f"{self.path}/table"):
            return []
        return [(os.path.basename(r.file), r.seq, r.line) for r in self.spark.read.schema(schema).parquet(f"{self.path}/table").collect()]


@pytest.fixture
def logs(spark, tmp_path):
    return Logs(spark, tmp_path)


def test_appended_bytes(logs):
    logs.put("a.log", b"one\ntwo\r\nthr")
    logs.put("b.log", "  é\xa0\n\n \n".encode() + b"bad \xff byte\nrest")
    logs.put(".hidden", b"no\n")
    assert logs.run(partition_bytes=4) == [("a.log", 0, "one"), ("a.log", 4, "two"), ("b.log", 0, "é"), ("b.log", 10, "bad  byte")]
    assert logs.run() == []
    logs.put("a.log", b"ee\n")
    logs.put("c.log", b"new\n")
    assert logs.run(partition_bytes=2) == [("a.log", 9, "three"), ("c.log", 0, "new")]
    logs.put("a.log", b"x\n", "wb")  # replaced by a shorter one
    os.remove(f"{logs.folder}/c.log")
    assert logs.run() == [("a.log", 0, "x")]
    assert logs.run(ended=True) == [("b.log", 21, "rest")]


def test_only_what_comes_later(logs):
    logs.put("a.log", b"old\nol")
    assert logs.run(process_existing=False) == []
    logs.put("a.log", b"d two\nnew\n")
    assert logs.run(process_existing=False) == [("a.log", 4, "old two"), ("a.log", 12, "new")]


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_ranges_share_lines_out(tmp_path, size):
    text = b"".join(b"%d%s\n" % (i, b"x" * (i % 13)) for i in range(60)) + b"\n\r\nlast"
    (tmp_path / "f").write_bytes(text)
    reader = follow._Reader({"path": str(tmp_path)})
    found = []
    for part in follow.ranges(str(tmp_path / "f"), 0, len(text), size):
        for batch in reader.read(part):
            found += zip(batch["seq"].to_pylist(), batch["line"].to_pylist())
    starts, at = [], 0
    for line in text.split(b"\n"):
        if line.strip(b"\r"):
            starts.append((at, line.strip(b"\r")))
        at += len(line) + 1
    assert sorted(found) == starts


def test_small_reads(tmp_path, monkeypatch):
    monkeypatch.setattr(follow, "READ_BYTES", 5)
    monkeypatch.setattr(follow, "TAIL_BYTES", 5)
    text = b"a" * 23 + b"\nbb\n" + b"c" * 11 + b"\nd"
    (tmp_path / "f").write_bytes(text)
    reader = follow._Reader({"path": str(tmp_path)})
    for size in (2, 6, 100):
        lines = [x for part in follow.ranges(str(tmp_path / "f"), 0, len(text), size) for b in reader.read(part) for x in b["line"].to_pylist()]
        assert lines == [b"a" * 23, b"bb", b"c" * 11, b"d"]
    system, path = follow._open(str(tmp_path / "f"))
    assert follow.finished(system, path, 0, len(text)) == len(text) - 1 and follow.finished(system, path, 30, 35) == 30


def test_lines_of_bytes():
    place, text = follow.lines_of(b"\n\na\r\nb\n\xff\r", 100)
    assert place.tolist() == [102, 105, 107] and text == pa.array([b"a", b"b", b"\xff"], pa.binary())
    assert len(follow.lines_of(b"", 0)[0]) == 0


# --- groups of rows ---------------------------------------------------------

def test_groups_cross_batches(spark, tmp_path):
    def batch(*seqs):
        return spark.createDataFrame([(s, f"r{s}") for s in seqs], "seq BIGINT, text STRING")

    groups = live.RowGroups(str(tmp_path / "g"), size=3)
    groups(batch(2, 1), 4)
    groups(batch(5, 4, 3, 6, 7), 5)
    groups(batch(5, 4, 3, 6, 7), 5)  # repeated
    groups(batch(), 7)
    groups(batch(8), 9)
    schema = batch(1).schema
    kept = sorted((r.group_id, r.position, r.seq) for r in groups.read(spark, schema).collect())
    assert kept == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 1, 5), (1, 2, 6)]
    groups.flush(spark, schema, 10)
    assert sorted((r.group_id, r.position, r.seq) for r in groups.read(spark, schema).collect())[6:] == [(2, 0, 7), (2, 1, 8)]


def test_recent_alerts_keep_two_lists(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(rows, "seq BIGINT, event_ts STRING").selectExpr("seq", "cast(event_ts as timestamp) as event_ts")

    recent = live.RecentAlerts(str(tmp_path / "recent"), keep=3)
    for i in range(6):
        recent(batch((i, f"2024-01-01 00:00:0{i}"), (i + 100, None)), i)
    recent(batch((5, "2024-01-01 00:00:05"), (105, None)), 5)  # repeated
    schema = batch((1, None)).schema
    assert sorted(r.seq for r in recent.read(spark, 5, schema).collect()) == [3, 4, 5]
    assert sorted(r.seq for r in recent.read(spark, 4, schema).collect()) == [2, 3, 4]
    assert sorted(os.listdir(tmp_path / "recent")) == ["slot=0", "slot=1"]
    assert recent.read(spark, 3, schema).count() == 0
    recent(batch(), 6)
    assert recent.read(spark, 6, schema).agg(F.max("seq")).first()[0] == 5
