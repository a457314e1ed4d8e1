"""Best-fit decreasing packing, held against brute force and the library's own ids."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seclake.llm import packing

SMALL = "/root/testdata/sf0.001"


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_best_fit(sizes, window):
    out, room = [], []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [w for w in range(len(out)) if room[w] >= sizes[item]]
        if not fits:
            out.append([])
            room.append(window)
            fits = [len(out) - 1]
        best = min(fits, key=lambda w: room[w])
        out[best].append(item)
        room[best] -= sizes[item]
    return room


@pytest.mark.parametrize("window", [1, 7, 64, 1000])
def test_tightest_open_window(window):
    rng = random.Random(window)
    for n in (0, 1, 5, 300):
        sizes = [rng.randint(1, window) for _ in range(n)]
        got = packing.best_fit(np.array(sizes, np.int64), window)
        assert sorted(i for w in got for i in w) == list(range(n))
        # which of equally tight windows is taken does not change the capacities that are left
        assert sorted(window - sum(sizes[i] for i in w) for w in got) == sorted(plain_best_fit(sizes, window))


def pieces_by(sequences):
    return sorted((p.doc_id, p.start, tuple(p.ids.tolist())) for s in sequences for p in s)


@pytest.mark.parametrize("sizes", [[], [600] * 50, [513, 511, 1], [1023] * 30, [1024], list(range(1, 200)), [700, 700]])
def test_filling_up_loses_nothing(sizes):
    pool = [packing.Piece(i, 0, n, np.arange(n)) for i, n in enumerate(sizes)]
    done, rest = packing.fill_up(pool)
    assert all(sum(len(p.ids) for p in s) >= 1023 for s in done) and sum(len(p.ids) for p in rest) < 1024
    last = list(packing.powers_of_two(rest))
    lengths = [sum(len(p.ids) for p in s) for s in last]
    assert all(n & (n - 1) == 0 for n in lengths) and lengths == sorted(set(lengths), reverse=True)
    seen = {i: np.zeros(n, int) for i, n in enumerate(sizes)}
    for s in done + last:
        for p in s:
            assert len(p.ids) and (p.ids == np.arange(p.start, p.start + len(p.ids))).all()
            seen[p.doc_id][p.start:p.start + len(p.ids)] += 1
    assert all((n == 1).all() for n in seen.values())


def check(rows, expected):
    """Every id of every document lies in one piece, sequences are whole, and padding is little."""
    by_sequence, by_document = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_document.setdefault(r.doc_id, []).append(r)
    padding = tokens = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        n = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert 0 < n <= 1024
        pad = 0 if n & (n - 1) == 0 else 1024 - n
        assert {r.padding for r in pieces} == {pad}
        padding, tokens = padding + pad, tokens + n
    assert padding <= 0.001 * tokens
    for doc, texts in expected.items():
        left = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_document.pop(doc))
        for ids in texts:  # texts with one id differ in length here
            mine = [r for r in left if r[3] == len(ids)]
            assert [r[0] for r in mine] == np.cumsum([0] + [r[1] for r in mine])[:-1].tolist() and sum(r[1] for r in mine) == len(ids)
            assert all(zlib.crc32(np.array(ids[a:a + n], "<u4").tobytes()) == c for a, n, c, _ in mine)
            left = [r for r in left if r[3] != len(ids)]
        assert not left
    assert not by_document


def digests(pieces):
    return pieces.withColumn("ids_crc32", F.crc32("ids")).collect()


def test_packed_documents(spark, docs):
    t = library()
    rows = [(1, None), (2, ""), (3, "a  <|endoftext|> b"), (None, "without an id"), (4, "twice"), (4, "twice, longer"),
            (5, "long word " * 40000), *((100 + i, "word " * 700) for i in range(40))]
    got = digests(packing.packed(docs(rows)))
    expected = {}
    for i, text in rows:
        expected.setdefault(i, []).append(t.encode(text or "", add_special_tokens=False).ids + [0])
    check(got, expected)
    assert packing.packed(docs([])).count() == 0


def test_pools_within_a_task():
    """Pools which end within a task hand their last pieces on."""
    rng = random.Random(3)
    pool, done, total = [], [], 0
    for i in range(200):
        n = rng.randint(1, 1023)
        total += n
        pool.append(packing.Piece(i, 0, n, np.arange(n)))
        if len(pool) >= 16:
            more, pool = packing.fill_up(pool)
            done += more
    more, pool = packing.fill_up(pool)
    done += more + list(packing.powers_of_two(pool))
    assert sum(len(p.ids) for s in done for p in s) == total
    assert len({(p.doc_id, p.start) for s in done for p in s}) == sum(map(len, done))


def test_query(spark):
    t = library()
    table = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    expected = {r.doc_id: [t.encode(r.text or "", add_special_tokens=False).ids + [0]] for r in table}
    result = packing.op11_packing(spark, SMALL)
    assert result.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(result.collect(), expected)
