"""Pseudonyms, token files, quotes, nearest neighbours, mixing, WARC, the pipeline, and the SQL twins."""

import datetime
import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import by_id
from pyspark.sql import functions as F

from seclake.llm import ann, mixing, pii, quotes, registry, token_files, warc

SMALL = "/root/testdata/sf0.001"


# ---- pseudonyms

def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_shift(x, h):
    out = ""
    for i, c in enumerate(x):
        k = int(h[2 * (i % 32):2 * (i % 32) + 2], 16)
        for low, n in (("0", 10), ("a", 26), ("A", 26)):
            if c.isascii() and ord(low) <= ord(c) < ord(low) + n:
                c = chr(ord(low) + (ord(c) - ord(low) + k) % n)
                break
        out += c
    return out


def brute_permute(key, kind, x):
    half = -(-len(x) // 2)
    a, b = x[:half], x[half:]
    for r in range(1, pii.ROUNDS + 1):
        h = hashlib.sha256(f"{key}/{kind}/{r}/{b if r % 2 else a}".encode()).hexdigest()
        a, b = (brute_shift(a, h), b) if r % 2 else (a, brute_shift(b, h))
    return a + b


def brute_card(key, d):
    p = brute_permute(key, "card", d[:-1])
    return next(p + c for c in "0123456789" if luhn(p + c))


TEXTS = [
    (1, "card 4111 1111 1111 1111, again 4111111111111111; not 4111111111111112"),
    (2, "4111-1111-1111-1111 on 2024-02-29 and 2023-02-29, 02/29/2024, 29.02.2024"),
    (3, "call +1 (521) 555-6210 or +1 (121) 555-6210 or +49301234567, ssn 123-45-6789 or 000-45-6789"),
    (4, "ip 10.0.0.255 10.0.0.256 mail Ann.Lee9@mail5.example.com iban GB82WEST12345698765432 GB83WEST12345698765432"),
    (5, None), (6, ""), (7, "no numbers"), (8, "1850-01-01 2100-01-01 ünï 4111111111111111é"), (1, "4111111111111111"),
    (9, "4465758382889437 4465758382889437 " * 500),
]


def test_pseudonyms(docs):
    out = pii.pseudonymize(docs(TEXTS), "k")
    assert out.columns[:9] == docs([]).columns
    got = by_id(out, "text", "n_pseudonyms")
    card = brute_card("k", "4111111111111111")
    spaced = " ".join(card[i:i + 4] for i in range(0, 16, 4))
    assert [t for t in got[1]] == sorted([(card, 1), (f"card {spaced}, again {card}; not 4111111111111112", 2)], key=repr)
    m = re.fullmatch(r"([\d-]+) on ([\d-]+) and 2023-02-29, (.*), (.*)", got[2][0][0])
    day = datetime.date.fromisoformat(m[2])
    assert m[1] == spaced.replace(" ", "-") and 1900 <= day.year <= 2099 and day != datetime.date(2024, 2, 29)
    assert m[3] == day.strftime("%m/%d/%Y") and m[4] == day.strftime("%d.%m.%Y") and got[2][0][1] == 4
    m = re.fullmatch(r"call \+1 \(([2-9]\d\d)\) ([2-9]\d\d)-(\d{4}) or \+1 \(121\) 555-6210 or \+49(\d{9}), ssn (\d{3})-(\d\d)-(\d{4}) or 000-45-6789", got[3][0][0])
    assert m and m[1] + m[2] + m[3] != "5215556210" and m[5] not in ("000", "666") and m[5] < "900" and got[3][0][1] == 3
    m = re.fullmatch(r"ip ([\d.]+) 10.0.0.256 mail (\S+)@mail5.example.com iban GB(\d\d)([A-Z]{4}\d{14}) GB83WEST12345698765432", got[4][0][0])
    assert m and all(int(o) < 256 for o in m[1].split(".")) and m[1] != "10.0.0.255"
    assert m[2] == brute_permute("k", "email", "Ann.Lee9")
    assert int("".join(str(int(c, 36)) for c in m[4] + "GB" + m[3])) % 97 == 1
    assert got[5] == [(None, 0)] and got[6] == [("", 0)] and got[7] == [("no numbers", 0)]
    assert got[8][0][0].startswith("1850-01-01 2100-01-01 ")
    assert got[9][0][1] == 1000 and len(set(got[9][0][0].split())) == 1
    other = by_id(pii.pseudonymize(docs(TEXTS), "other"), "text")
    assert other[1] != [(t,) for t, _ in got[1]]
    assert pii.pseudonymize(docs([]), "k").count() == 0


HIDDEN = [
    (1, "card 5555 4111 1111 1111 1111 end"), (2, "(555) 234-5678 or 555-234-5678, 1-555-234-5678 and 555.234.5678."),
    (3, "iban GB82 WEST 1234 5698 7654 32 SENT, GB82 WEST 1234 5698 7654 33 BE68 5390 0754 7034 PAID"),
    (4, "+1 555 234 5678 +1-155-234-5678 155-234-5678 978-316-1484-10 5555-555-234-5678"),
    (5, "GB83WEST12345698765432@example.com 1.2.3.4.5 10.10.2020.5"), (6, "999-99-9999 999.1.1.1.1 4111\u20094111 1111 1111 1111"),
    (7, "\U0001f600 5555 4111 1111 1111 1111 \U0001f600\n2024-02-30 2024-02-29"), (8, "5555 4111 1111 1111 1111 \t" * 2000),
]


def test_invalid_candidates_hide_nothing(docs):
    got = {i: rows[0] for i, rows in by_id(pii.pseudonymize(docs(HIDDEN), "k"), "text", "n_pseudonyms", "pseudonyms").items()}
    spaced = " ".join(brute_card("k", "4111111111111111")[i:i + 4] for i in range(0, 16, 4))
    assert got[1][:2] == (f"card 5555 {spaced} end", 1)
    m = re.fullmatch(r"\((\d{3})\) (\d{3})-(\d{4}) or (\d{3}-\d{3}-\d{4}), 1-(\d{3}-\d{3}-\d{4}) and (\d{3}\.\d{3}\.\d{4})\.", got[2][0])
    national = m[1] + m[2] + m[3]
    assert got[2][1] == 4 and national != "5552345678" and min(national[0], national[3]) >= "2"
    assert {re.sub(r"\D", "", m[i]) for i in (4, 5, 6)} == {national}
    m = re.fullmatch(r"iban GB(\d\d) ([A-Z]{4} \d{4} \d{4} \d{4} \d\d) SENT, GB82 WEST 1234 5698 7654 33 BE(\d\d) (\d{4} \d{4} \d{4}) PAID", got[3][0])
    for country, check, account in (("GB", m[1], m[2]), ("BE", m[3], m[4])):
        assert int("".join(str(int(c, 36)) for c in account.replace(" ", "") + country + check)) % 97 == 1
    assert got[3][1] == 2 and m[2] != "WEST 1234 5698 7654 32"
    assert got[4][0].endswith("+1-155-234-5678 155-234-5678 978-316-1484-10 5555-555-234-5678") and got[4][1] == 1
    assert got[4][0][:15] == f"+1 {national[:3]} {national[3:6]} {national[6:]}"
    assert [p.kind for p in got[5][2]] == ["email", "ip", "date"] and got[5][0].startswith(brute_permute("k", "email", HIDDEN[4][1][:22]))
    assert got[6][0].endswith("\u2009" + spaced) and [p.kind for p in got[6][2]] == ["ip", "card"]
    m = re.fullmatch("\U0001f600 5555 (.*) \U0001f600\n2024-02-30 (.*)", got[7][0])
    assert m[1] == spaced and m[2] != "2024-02-29" and got[7][1] == 2
    assert got[8][:2] == (f"5555 {spaced} \t" * 2000, 2000)


def test_pseudonyms_are_a_permutation(spark):
    days = [(datetime.date(1900, 1, 1) + datetime.timedelta(i)).isoformat() for i in range(0, 73049, 61)]
    days += ["1900-01-01", "2099-12-31"]
    phones = ["+1 (%d) %d-%04d" % (200 + i % 800, 200 + (i * 7) % 800, i) for i in range(300)]
    values = sorted(set(days + phones))
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")
    out = [r.text for r in pii.pseudonymize(rows, "k").collect()]
    assert len(set(out)) == len(values)
    assert [re.sub(r"\d", "9", x) for x in sorted(out)] == [re.sub(r"\d", "9", x) for x in sorted(values)]


# ---- token files

def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts():
    rng = random.Random(1)
    atoms = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "　", " ", "\x1c", "\x85", "a", "It's", "don't", "é", "日本", "42", "!!", "<|endoftext|>", "<|endof", "text|>", "ﬁ", "​", "Ⅷ"]
    return ["".join(rng.choices(atoms, k=rng.randint(0, 25))) for _ in range(600)]


def test_token_files(spark, docs):
    rows = [(1000 - i, t) for i, t in enumerate(odd_texts())] + [(5, None), (6, ""), (7, "long word " * 30000), (None, "null id"), (7, "again")]
    real = spark.read.parquet(f"{SMALL}/documents.parquet").select((F.col("doc_id") + 10000).alias("doc_id"), "text")
    table = docs(rows).coalesce(1).select("doc_id", "text", "row", "size").unionByName(real, allowMissingColumns=True)
    got = token_files.tokens_of(table).collect()
    t = tokenizer()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) + sorted((r.doc_id, r.text) for r in real.collect())
    expected, start = [], 0
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert token_files.tokens_of(docs([])).count() == 0


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        size = rng.integers(0, 9, n)
        ranks = (rng.integers(0, 1 << 32, int(size.sum())) >> rng.integers(0, 32, int(size.sum()))).astype(np.uint32)
        control, data, c, d = token_files.pack(ranks, size)
        assert (token_files.unpack(control, data, size) == ranks).all()
        assert c[-1] == len(control) == (-(-size // 4)).sum() and d[-1] == len(data)


# ---- quotes

def test_quotes(spark):
    rows = [
        (1, 1, "Hello all,\nhow are you?\n\nSecond thing."),
        (1, 2, "On Monday, Ann wrote:\n> Hello  ALL,\n> how are you?\n\nFine."),
        (1, 3, "On x y wrote:\n> > Hello all, how are you?\n>> \n> Fine.\n> \n> > Second thing.\nGood"),
        (1, 4, "> never said\nWhat?"),
        (1, 5, "> Second thing.\n> Fine.\n>\n> Fine.\n\nok"),
        (2, 1, "> Fine.\nin another scope"),
        (None, 1, "alone"), (None, 2, "> alone"), (2, None, "> alone"), (2, 7, None), (2, 8, ""),
    ]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv bigint, at bigint, text string, parent string, scope bigint")
    got = {(r.conv, r.at): (r.parent, r.root, r.depth, r.n_quoted, r.n_linked, r.body)
           for r in quotes.link_quotes(table, "at", "conv").collect()}
    assert got == {
        (1, 1): (None, 1, 0, 0, 0, "Hello all,\nhow are you?\n\nSecond thing."),
        (1, 2): (1, 1, 1, 1, 1, "Fine."),
        (1, 3): (2, 1, 2, 3, 3, "Good"),
        (1, 4): (None, 4, 0, 1, 0, "What?"),
        (1, 5): (2, 1, 2, 2, 1, "ok"),
        (2, 1): (None, 1, 0, 1, 0, "in another scope"),
        (None, 1): (None, 1, 0, 0, 0, "alone"), (None, 2): (1, 1, 1, 1, 1, ""),
        (2, None): (None, None, 0, 0, 0, ""), (2, 7): (None, 7, 0, 0, 0, ""), (2, 8): (None, 8, 0, 0, 0, ""),
    }
    assert quotes.link_quotes(table.limit(0), "at").count() == 0
    twice = quotes.link_quotes(table.unionByName(table), "at", "conv")
    assert twice.count() == 2 * len(rows)


@pytest.mark.parametrize("block", [1, 3, 1 << 20])
def test_latest_original_before(spark, monkeypatch, block):
    monkeypatch.setattr(quotes, "BLOCK", block)
    rows = [(1, "yes"), (2, "why?"), (3, "Yes"), (4, "> yes\n\nno"), (5, "yes"), (6, "> YES\n> > why?"), (7, "> later"), (8, "later"),
            (9, "> no\n>\n> yes"), (12, "word " * 200_000), (15, "> " + "word " * 200_000 + "\nlong"), (16, "yes\n> yes")]
    got = {r.at: (r.parent, r.n_linked) for r in quotes.link_quotes(spark.createDataFrame(rows, "at bigint, text string"), "at").collect()}
    assert got == {1: (None, 0), 2: (None, 0), 3: (None, 0), 4: (3, 1), 5: (None, 0), 6: (5, 2), 7: (None, 0), 8: (None, 0), 9: (5, 2),
                   12: (None, 0), 15: (12, 1), 16: (5, 1)}


def test_long_thread(spark):
    rows = [(i, (f"> text {i - 1}\n" if i else "") + f"text {i}") for i in range(300)]
    got = quotes.link_quotes(spark.createDataFrame(rows, "at bigint, text string"), "at").collect()
    assert {r.at: (r.parent, r.root, r.depth) for r in got} == {i: (i - 1 if i else None, 0, i) for i in range(300)}


# ---- nearest neighbours

def brute_nearest(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows
            if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in good if i != q)
            out.setdefault(q, d[:k])
    return out


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e9, 1e200])
def test_promising_rows_hold_the_nearest(scale):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(60, 8)) + 50, 5, axis=0) * scale  # far from the origin, each vector five times
    key, ids = np.sort(rng.integers(0, 40, len(x))), rng.permutation(len(x))
    for wanted in ([], [100], [3], [5, 4, 4, 9], list(range(40))):
        lo, hi = ann._ranges(key, np.array(wanted, np.int64))
        every = np.flatnonzero(np.isin(key, wanted))
        assert [r for a, b in zip(lo, hi) for r in range(a, b)] == every.tolist()
        if len(every):
            rows = ann._promising(x, np.square(x).sum(axis=1), x[7] * 1.01, lo, hi, 12)
            near, brute = ann._nearest(x[rows], x[7] * 1.01, ids[rows], 12), ann._nearest(x[every], x[7] * 1.01, ids[every], 12)
            assert near[0].tolist() == brute[0].tolist() and near[1].tolist() == brute[1].tolist()


def test_nearest_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[100][1]) for i in range(40)] + [(500, rows[0][1])]
    rows += [(600, None), (700, [0.0] * 8), (800, [1.0] * 7 + [None]), (900, [1.0] * 7 + [float("nan")]), (1000, [float("inf")] * 8), (None, [1.0] * 8)]
    table = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id bigint, embedding array<double>, class string, score double")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    want = brute_nearest(rows)
    assert set(got) == set(want)
    found = sum(len(set(x[1] for x in got[q].values()) & set(i for _, i in d)) for q, d in want.items())
    assert found >= 0.9 * sum(map(len, want.values()))
    assert got[100] == {n + 1: x for n, x in enumerate(want[100])}  # forty copies, ties by id
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, len(ranks) + 1)) and [ranks[n] for n in sorted(ranks)] == sorted(ranks.values())
    assert ann.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = ann.nearest(table.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r.rank for r in few) == [1, 2]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    got = {}
    for r in ann.op7_ann(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & set(got[q]))
    assert hits >= 0.9 * 10 * len(got)


def test_small_blocks_lose_nothing(spark, monkeypatch):
    first = {tuple(r) for r in ann.op7_ann(spark, SMALL).collect()}
    monkeypatch.setattr(ann, "BLOCK_ROWS", 3)
    monkeypatch.setattr(ann, "GROUP_ROWS", 50)
    assert {tuple(r) for r in ann.op7_ann(spark, SMALL).collect()} == first


# ---- mixing

def brute_shares(sizes, weights, most=3):
    share, free = {}, set(sizes)
    while True:
        rest = sum(sizes.values()) - sum(share.values())
        now = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if now[s] > most * sizes[s]}
        if not over:
            return share | now
        for s in over:
            share[s] = most * sizes[s]
        free -= over


def test_mixing(spark, docs):
    rng = random.Random(4)
    names = ["b", "a", "ü", None, "Z", "日", "\U0001f600"]
    rows = []
    for i in range(3000):
        s = rng.choices(names, [50, 20, 10, 8, 5, 1, 1])[0]
        rows.append((i, None if i % 97 == 0 else "w " * rng.choice([0, 5, 20, 100]), s))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"size": F.lit(3), "target": F.lit("x")})
    out = mixing.mix_documents(table)
    got = {r.doc_id: r for r in out.collect()}
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    target = brute_shares(sizes, {s: 1 + k % 3 for k, s in enumerate(order)})
    taken = Counter()
    for i, t, s in rows:
        r = got[i]
        assert r["size"] == len((t or "").split()) and r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 51 for s in sizes)
    assert {i: r.taken for i, r in got.items()} == {r.doc_id: r.taken for r in mixing.mix_documents(table.repartition(7)).collect()}
    assert mixing.mix_documents(table.limit(0)).count() == 0


def test_flow_prefers_few_repetitions():
    # the pattern of both sources spares the first a second use
    assert mixing.min_cost_flow([10, 10], [[0], [0, 1]], [15, 5]) == [[10], [5, 5]]
    assert mixing.min_cost_flow([10], [[0]], [100]) == [[30]]
    assert mixing.min_cost_flow([10, 0], [[0], [0]], [25]) == [[25], [0]]
    rng = random.Random(1)
    for _ in range(30):
        supply = [rng.randint(0, 4) for _ in range(3)]
        members = [sorted(rng.sample(range(2), rng.randint(1, 2))) for _ in range(3)]
        quota = [rng.randint(0, 12) for _ in range(2)]
        flow = mixing.min_cost_flow(supply, members, quota)
        cost = lambda given: sum(sum(min(max(g - k * s, 0), s) * k * k for k in range(3)) for g, s in zip(given, supply))
        best = None
        ranges = [range(3 * s + 1) for s in supply]
        for given in ((a, b, c) for a in ranges[0] for b in ranges[1] for c in ranges[2]):
            only = [sum(g for g, m in zip(given, members) if m == [s]) for s in range(2)]
            both = sum(g for g, m in zip(given, members) if len(m) == 2)
            if all(o <= q for o, q in zip(only, quota)) and both <= sum(q - o for o, q in zip(only, quota)):
                best = max(best or (-1, 0), (sum(given), -cost(given)))
        used = [sum(f) for f in flow]
        assert (sum(used), -cost(used)) == best
        for s in range(2):
            assert sum(f[m.index(s)] for f, m in zip(flow, members) if s in m) <= quota[s]


def test_mixing_overlapping_sources(spark):
    rows = [(i, 10, ["a"] if i < 60 else ["b", "a"] if i < 90 else ["b"] if i < 99 else []) for i in range(100)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, n bigint, sources array<string>"), "n", "sources", "1")
    used = {r.doc_id: r.taken for r in out.collect()}
    assert used[99] == 0 and 0 < sum(used.values()) and all(v <= 30 for v in used.values())


# ---- WARC

def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"http://x/{i}\n", "é" * rng.randint(0, 300) + str(rng.randint(0, 40))) for i in range(200)]
    rows += [(500, None, None), (501, "u", ""), (None, "u", "same"), (7, "u", "same"), (502, "u", "same"), (600, "u", "big " * 400000),
             (601, "u", bytes(range(31, 140)).decode("latin-1") * 50), (7, "u", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, sha1 string")
    path = f"file://{tmp_path}/out"
    manifest = warc.write_warc(pages.repartition(3), path)
    assert manifest.groupBy().sum("records").first()[0] == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        h = h or ""
        again = first[h] != i
        want.append((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    import base64

    def seen(df):
        number = lambda s: int(m[1]) if (m := re.match(r"<urn:page:(\d+)>", s or "")) else None
        return sorted(((number(r.record_id), r.payload_bytes, base64.b32decode(r.payload_digest).hex(), r.record_type, number(r.refers_to))
                       for r in df.collect()), key=repr)

    whole = warc.read_warc(spark, path)
    assert seen(whole) == sorted(want, key=repr)
    for r in whole.where("record_type = 'response'").collect():
        assert hashlib.sha1(r.payload).digest() == base64.b32decode(r.payload_digest)
    assert seen(warc.read_warc(spark, path, split_bytes=700, payloads=False)) == sorted(want, key=repr)


def test_members_of_any_ranges():
    rng = random.Random(6)
    # payloads that do not compress keep their magic bytes
    data, places = b"", []
    for i in range(30):
        places.append(len(data))
        data += warc._record(i, None, bytes(rng.randbytes(rng.randint(0, 900))) + warc.MAGIC + b"\x00" * 9, "00" * 20, None, False, "d")
        data += b"" if i % 5 else warc.MAGIC + rng.randbytes(5)  # rubbish between members
    for size in (len(data), 1, 37, 1000):
        found = [p for lo in range(0, len(data), size) for p, _ in warc.members(io.BytesIO(data), lo, min(lo + size, len(data)))]
        assert found == places
    cut = data[:places[-1] + 40]  # the last member is cut short
    assert [p for p, _ in warc.members(io.BytesIO(cut), 0, len(cut))] == places[:-1]
    assert list(warc.members(io.BytesIO(b""), 0, 10)) == []


def test_warc_threshold_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], "page_id bigint, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/a", min_revisit=4).count()
    assert {r.record_type for r in warc.read_warc(spark, f"file://{tmp_path}/a").collect()} == {"response"}
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/b")
    assert warc.read_warc(spark, f"file://{tmp_path}/b").count() == 0


# ---- pipeline and twins

def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from seclake.llm import decontaminate, minhash

    odd = [(10 ** 6, None, None, None, None), (10 ** 6 + 1, "123 456", "en", "src1", 7), (None, "a text without an id", None, None, 3)]
    start = spark.read.parquet(f"{SMALL}/documents.parquet")
    start = start.unionByName(spark.createDataFrame(odd, start.schema)).withColumns({"size": F.lit(1), "node": F.lit("x")})
    docs, results = start, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        docs.write.parquet(str(tmp_path / name))
        docs = results[name] = spark.read.parquet(str(tmp_path / name))
        if name != "token_output":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in results.items()}
    assert ids["language_id"] == {r.doc_id for r in start.select("doc_id").collect()} - {10 ** 6, 10 ** 6 + 1}
    near = minhash.near_duplicates(results["language_id"], percent=corpus_pipeline.NEAR_PERCENT).where("kept")
    assert ids["near_duplicates"] == {r.doc_id for r in near.collect()}
    hit = decontaminate.contamination(results["near_duplicates"], spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    assert ids["decontamination"] == {r.doc_id for r in hit.where("not contaminated").collect()}
    uses = {r.doc_id: r.repeats for r in mixing.mix_documents(results["decontamination"]).collect() if r.repeats}
    assert uses == Counter(r.doc_id for r in results["mixing"].collect())
    tokens = results["token_output"].collect()
    assert Counter(r.doc_id for r in tokens) == uses
    assert sum(r.n_tokens for r in tokens) == max(r.start + r.n_tokens for r in tokens)
    none = start.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SMALL)
    cursor = con.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, cursor.fetchall()))


@pytest.mark.parametrize("run", [1, 4, 4096])
def test_runs_of_answers_are_followed_whole(spark, monkeypatch, run):
    monkeypatch.setattr(quotes, "RUN", run)
    parent = {i: None if i % 11 == 0 else i - 3 if i % 7 == 3 and i > 3 else i - 1 for i in range(60)}
    rows = [(i, f"text {i}" if p is None else f"> text {p}\n\ntext {i}") for i, p in parent.items()]
    got = {r.at: (r.parent, r.root, r.depth) for r in quotes.link_quotes(
        spark.createDataFrame(rows, "at bigint, text string"), "at").collect()}

    def path(i):
        return [i] if parent[i] is None else [i, *path(parent[i])]

    assert got == {i: (p, path(i)[-1], len(path(i)) - 1) for i, p in parent.items()}
