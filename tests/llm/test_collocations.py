"""Phrase mining, held against counting every phrase of the corpus."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from seclake.llm import collocations

DOCS = "doc_id bigint, text string, lang string, source string, phrase string, n string, k string, score string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, top=2000):
    counts, total = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang] = total.get(lang, 0) + len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i:i + k])
                    counts[key] = counts.get(key, 0) + 1
    displaced = {}
    for (lang, p), a in counts.items():
        if len(p) == 3 and a >= 10:
            for q in (p[:2], p[1:]):
                displaced[lang, q] = max(displaced.get((lang, q), 0), a)
    out = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= 10 and 100 * displaced.get((lang, p), 0) < 50 * a:
            cuts = [(1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(rows)


def shown(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "p", "n", "k", "x") for i, (lang, t) in enumerate(rows)], DOCS)


def corpus(seed, n=300, words=25):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(words)] + ["Ünö", "ÄB", "A", "b'c", "日本", " "]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "fr", None, "und", "a b", ""])
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "\x0b", "!?", "\xa0"])
                       for w in rng.choices(vocabulary, weights, k=rng.randint(0, 60)))
        rows.append((lang, text.replace("w1 w2", "New York City").replace("w3 w0", "In Spite Of")))
    return rows + [("en", None), ("en", ""), (None, None), ("fr", " \t"), ("it", "too rare " * 9), ("en", "same same " * 30), ("en", "same same " * 30)]


@pytest.mark.parametrize("top, first", [(2000, 4000), (5, 3), (1, 1), (40, 7)])
def test_phrases(spark, top, first):
    """Also where the first threshold settles no language, so that growth goes on."""
    rows = corpus(top)
    got = shown(collocations.collocations(table(spark, rows), top=top, first=first))
    assert got == brute(rows, top) and len({r[0] for r in got}) > 3


def test_growth_over_rounds(spark, monkeypatch):
    monkeypatch.setattr(collocations, "GROW", 2)
    rows = corpus(11, n=150)
    assert shown(collocations.collocations(table(spark, rows), top=30, first=2)) == brute(rows, 30)


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 1)
    rows = corpus(5, n=200)
    assert shown(collocations.collocations(table(spark, rows), top=20, first=10)) == brute(rows, 20)


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(3 * 10 ** 12, 7 * 10 ** 12, 3 * 10 ** 12 + 1)], "a bigint, l bigint, r bigint")
    assert row.selectExpr(collocations._exact("a a", "l r")).first()[0] == 10 ** 6 * 9 * 10 ** 24 // (7 * 10 ** 12 * (3 * 10 ** 12 + 1))


def test_chunks_of_long_texts():
    """A text beyond the limit is cut at stops only; one without stops stays whole."""
    rng = random.Random(1)
    text = "".join(rng.choice("ab .\n") for _ in range(5000))
    long = "x y " * 2000
    batch = pa.record_batch({"lang": ["a", "b", "a", "c"], "text": ["one two", text, "", long]})
    parts = list(collocations._chunks(batch, 100))
    assert b"".join(p.tobytes() for p, _, _ in parts) == ("one two" + text + long).encode()
    of_text = [p for p, _, code in parts if code.tolist() == [1]]
    assert len(of_text) > 20 and all(p.tobytes().decode()[-1] in ".\n" for p in of_text[:-1])
    for raw, at, code in parts:
        assert at[0] == 0 and at[-1] == len(raw) and len(code) == len(at) - 1


def test_long_text_and_empty_tables(spark):
    rows = [("en", "ab cd ef. " * 150_000 + "tail")]
    assert shown(collocations.collocations(table(spark, rows))) == brute(rows)
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [("en", "x"), (None, None)])).count() == 0


def test_words_of_texts():
    raw = np.frombuffer(b"A b.C dE f", np.uint8)
    words = collocations._Words(raw, np.array([0, 0, 7, 7, 10]), np.array([0, 1, 0, 1]))
    assert [words.words[c].as_py() for c in words.code.tolist()] == [b"a", b"b", b"c", b"d", b"e", b"f"]
    assert words.lang.tolist() == [1, 1, 1, 1, 1, 1] and words.next.tolist() == [True, False, True, False, True]
