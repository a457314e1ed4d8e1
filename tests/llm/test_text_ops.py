"""Substring deduplication, decontamination, MinHash and language ID against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import by_id

from seclake.llm import decontaminate, langid, minhash, substring_dedup, words

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary_texts(seed, n, size):
    """Random texts with passages copied between and inside them."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(40)] + ["é", "日本", "Ab", "AB"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 60))] for _ in range(8)]
    out = []
    for _ in range(n):
        ws = []
        for _ in range(rng.randint(0, size)):
            ws += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(5)]
        out.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in ws))
    return out


ODD = [None, "", " \n\t", "one", "a b c d", "x " * 19, "x " * 20, "x " * 21, "x " * 400, "  　 é", "word" * 3000]


def test_word_hashes_follow_the_words():
    texts = [t.encode() for t in vocabulary_texts(1, 30, 5)] + [b"", b"a", b" a", b"ab a"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    old = words.PIECE
    try:
        seen = []
        for piece in (1 << 20, 7):
            words.PIECE = piece
            s, e, h, bounds = words.words(raw, at)
            seen.append((s.tolist(), e.tolist(), h.tolist(), bounds.tolist()))
        assert seen[0] == seen[1]
    finally:
        words.PIECE = old
    found = [raw[a:b].tobytes() for a, b in zip(s, e)]
    assert found == [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    assert len({w for w in found}) == len(set(h.tolist()))
    assert len(set(zip(found, h.tolist()))) == len(set(found))


def brute_repeats(rows):
    """rows in input order: (doc_id, text); null ids last"""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        ws = SPACE.findall(rows[i][1] or "")
        gone = [False] * len(ws)
        for p in range(len(ws) - 19):
            gram = tuple(ws[p:p + 20])
            if gram in seen:
                gone[p:p + 20] = [True] * 20
            seen.add(gram)
        out.append((rows[i][0], len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_remove_repeats(spark, docs, seed):
    rows = [(100 - i, t) for i, t in enumerate(vocabulary_texts(seed, 40, 12) + ODD)] + [(None, "x " * 25), (3, "y " * 30), (3, "y " * 30)]
    got = substring_dedup.remove_repeats(docs(rows).coalesce(1)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute_repeats(rows)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


def test_remove_repeats_over_many_chunks(spark, docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BITS", 1)
    rows = list(enumerate(vocabulary_texts(5, 60, 8)))
    got = substring_dedup.remove_repeats(docs(rows).repartition(5, "doc_id")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute_repeats(rows)


def test_remove_repeats_of_nothing(docs):
    assert substring_dedup.remove_repeats(docs([])).count() == 0


BENCH_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_contamination(rows, items):
    spans = defaultdict(set)
    for item, text in items:
        ws = BENCH_WORDS.findall(lower(text))
        for p in range(max(len(ws) - 9, 1) if ws else 0):
            spans[tuple(ws[p:p + 10])].add(item)
    out = []
    for doc, text in rows:
        ws = BENCH_WORDS.findall(lower(text))
        hit, found = set(), set()
        for span, ids in spans.items():
            for p in range(len(ws) - len(span) + 1):
                if tuple(ws[p:p + len(span)]) == span:
                    hit |= set(range(p, p + len(span)))
                    found |= {str(i) for i in ids if i is not None}
        out.append((doc, len(ws), len(hit), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("short", [False, True])
def test_contamination(spark, docs, short):
    texts = vocabulary_texts(3, 25, 6)
    rows = [(i, t) for i, t in enumerate(texts + ODD)] + [(None, texts[0]), (2, texts[3]), (2, texts[3]), (2, texts[4])]
    pieces = [" ".join(SPACE.findall(t)[5:40]) for t in texts[:6]]
    items = [(i, t.upper() if i % 2 else t) for i, t in enumerate(pieces)] + [(1, pieces[2]), (None, pieces[3]), (20, None), (21, "-- !")]
    items += [(30, "W1"), (31, "w2, w3"), (32, " ".join(SPACE.findall(texts[0])[:9]))] if short else []
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(docs(rows), benchmark).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in got), key=repr) == \
        brute_contamination(rows, items)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)


def test_contamination_without_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    texts = vocabulary_texts(4, 15, 6)
    items = [(i, " ".join(SPACE.findall(t)[:30])) for i, t in enumerate(texts[:4])]
    got = decontaminate.contamination(docs(list(enumerate(texts))), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in got), key=repr) == \
        brute_contamination(list(enumerate(texts)), items)


def test_contamination_of_and_by_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(docs([]), none).count() == 0
    assert by_id(decontaminate.contamination(docs([(1, "a b")]), none), "n_hit", "n_words") == {1: [(0, 2)]}


def brute_near(rows):
    sets = []
    for _, t in rows:
        ws = SPACE.findall(lower(t))
        sets.append({tuple(ws[i:i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def near_texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        base = ["v%d" % rng.randrange(500) for _ in range(rng.choice([3, 6, 30, 200]))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(["NEW", "Other", "v1"])
            out.append(rng.choice([" ", "\n"]).join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block", [4096, 4])
def test_near_duplicates(docs, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_NODES", block)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 1000 * block)
    rows = [(50 + i, t) for i, t in enumerate(near_texts(block) + ODD)] + [(None, "p q r s t u"), (7, "p q r s t u"), (8, "P q r s t u"), (8, "z"), (8, "z")]
    got = minhash.near_duplicates(docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == brute_near(rows)


def test_near_duplicates_of_nothing(docs):
    assert minhash.near_duplicates(docs([])).count() == 0
    assert by_id(minhash.near_duplicates(docs([(None, None), (1, "")])), "component_id", "kept") == {None: [(None, True)], 1: [(1, True)]}


def test_signatures_estimate_the_similarity(docs):
    rng = random.Random(3)
    base = ["v%d" % rng.randrange(10 ** 6) for _ in range(1500)]
    other = list(base)
    for i in range(0, 1500, 60):
        other[i] = "x%d" % i
    a, b = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (base, other))
    true = len(a & b) / len(a | b)
    rows = docs([(1, " ".join(base)), (2, " ".join(other))]).selectExpr("doc_id as row", "doc_id", "text").mapInArrow(
        minhash._sign, "row bigint, doc_id bigint, n_shingles bigint, node binary, signature binary, bands array<bigint>").collect()
    x, y = (np.frombuffer(r.signature, np.uint64) for r in rows)
    equal = (minhash.PERMS - int(minhash._differing(x ^ y))) / minhash.PERMS
    chance = 2.0 ** -minhash.BITS
    assert abs((equal - chance) / (1 - chance) - true) < 4 * math.sqrt(true * (1 - true) / minhash.PERMS) + 0.01


def brute_length(training, text):
    """Code length in bits, by walking the contexts of each byte."""
    counts = defaultdict(Counter)
    for t in training:
        b = b"\n" * langid.ORDER + t.encode()
        for i in range(langid.ORDER, len(b)):
            for k in range(langid.ORDER + 1):
                counts[b[i - k:i]][b[i]] += 1
    total = 0.0
    b = b"\n" * langid.ORDER + text.encode()
    for i in range(langid.ORDER, len(b)):
        for k in range(langid.ORDER, -1, -1):
            seen = counts.get(b[i - k:i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if b[i] in seen:
                total -= math.log2(seen[b[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_are_exact(spark, docs, monkeypatch):
    english = ["the cat sat on the mat", "then the other cat came", "the end"]
    german = ["die katze sass auf der matte", "dann kam die andere katze", "das ende ä"]
    model = langid.learn(docs([(i, t) for i, t in enumerate(english)], lang="en").unionByName(
        docs([(10 + i, t) for i, t in enumerate(german)], lang="de")))
    assert model.languages == ["de", "en"]
    texts = ["the dog", "die ratte", "ÄÖ日本語 xyz", "a", "", "the cat sat on the mat " * 3]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    whole = model.code_lengths(raw, at)
    monkeypatch.setattr(langid, "PIECE", 5)
    assert (model.code_lengths(raw, at) == whole).all()
    for i, t in enumerate(texts):
        for j, training in enumerate((german, english)):
            assert abs(whole[i, j] / langid.UNIT - brute_length(training, t)) <= 5 * len(t.encode()) / langid.UNIT + 1e-9


def test_identify_odd_texts(spark, docs):
    model = langid.learn(docs([(1, "some english text here"), (2, None), (3, "")], lang="en"))
    got = by_id(langid.identify(docs([(i, t) for i, t in enumerate([None, "", "12 34!", "text here", "日本"])]), model),
                "lang_pred", "lang_score", "size")
    assert {k: v[0][0] for k, v in got.items()} == {0: "und", 1: "und", 2: "und", 3: "en", 4: "en"}
    assert got[3][0][1] == 1.0 and got[0][0][1] == 0.0 and got[0][0][2] == 6
    none = langid.learn(docs([(1, "no label")]))
    assert by_id(langid.identify(docs([(1, "abc")]), none), "lang_pred", "lang_bits") == {1: [("und", None)]}
    assert langid.identify(docs([]), model).count() == 0


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op9_langid(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = out.selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert n > 150 and right / n > 0.97


def test_sha256_of_kept_words(spark, docs, tmp_path):
    docs([(1, "ab  cd"), (2, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(substring_dedup.op2_substring_dedup(spark, str(tmp_path)), "n_words", "n_removed", "kept_sha256")
    assert got == {1: [(2, 0, hashlib.sha256(b"ab cd").hexdigest())], 2: [(0, 0, hashlib.sha256(b"").hexdigest())]}
