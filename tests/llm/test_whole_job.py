"""Cases in which an operator or a stage once did less than the whole job."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from seclake.llm import ann, langid, mixing

SMALL = "/root/testdata/sf0.001"


# ---- near duplicates of the pipeline

def brute_kept(rows, percent):
    """Ids which are the smallest of their group."""
    sets = {}
    for i, text in rows:
        w = text.split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(len(w) - 4, 1))}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    least = {i: i for i in sets}
    for _ in links:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {i for i in sets if least[i] == i}


def test_stage_links_pairs_from_080(spark, docs):
    rng, rows = random.Random(8), []
    for changed in (3, 4, 4, 4, 4, 5):  # similarity 0.858, 0.815 and 0.774
        base = ["v%d" % rng.randrange(10 ** 6) for _ in range(200)]
        copy = list(base)
        for i in range(changed):
            copy[20 + 40 * i - 5 * (i == 4)] = "new%d" % i
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs(rows), SMALL).collect()}
    assert got == brute_kept(rows, 80) == {0, 2, 4, 6, 8, 10, 11} != brute_kept(rows, 85)


def test_stage_on_documents(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").where("text rlike '[^ \\t\\n\\x0B\\f\\r]'")
    rows = [(r.doc_id, "".join(c.lower() if c.isascii() else c for c in r.text)) for r in table.collect()]
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, table, SMALL).collect()}
    assert got == brute_kept(rows, 80)


# ---- rows without an id, or with the same one

def texts_of(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect())


def test_stages_judge_each_row(spark, docs):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    rows = [(None, item), (None, "a clean text of its own"), (4, f"x {item}"), (4, "also clean"), (4, None), (None, "")]
    got = corpus_pipeline.drop_contaminated(spark, docs(rows), SMALL)
    assert texts_of(got) == texts_of(docs([rows[1], rows[3], rows[4], rows[5]]))

    one, two = " ".join("a%d" % i for i in range(100)), " ".join("b%d" % i for i in range(100))
    rows = [(None, one), (None, one + " end"), (None, two), (None, None), (None, None), (3, two), (3, two), (2, one), (9, "c")]
    got = corpus_pipeline.drop_near_duplicates(spark, docs(rows), SMALL)
    assert texts_of(got) == texts_of(docs([(None, None), (None, None), (3, two), (2, one), (9, "c")]))

    rows = [(None, "a b c d"), (None, "e f g h i j")] + [(i, "w " * 10) for i in range(20)]
    source = lambda d: F.when(F.col("text") == "a b c d", "s1").when(F.col("doc_id").isNull(), "s2").otherwise("s0")
    table = docs(rows).withColumn("source", source("text"))
    expected = {r.text: r.repeats for r in mixing.mix_documents(table, "text").where("doc_id is null").collect()}
    used = [r.text for r in corpus_pipeline.mix_sources(spark, table, SMALL).where("doc_id is null").collect()]
    assert {t: used.count(t) for t in expected} == expected and set(expected) == {"a b c d", "e f g h i j"}
    assert corpus_pipeline.write_tokens(spark, docs([(None, "a"), (None, "b"), (1, "c"), (1, "c")]), SMALL).count() == 4


def test_texts_sent_to_confirming(spark, docs, monkeypatch):
    """As many as there are members of families, whatever the ids are."""
    from seclake.llm import minhash

    sent = []
    by_group = minhash._by_group
    monkeypatch.setattr(minhash, "_by_group", lambda rows, n: (sent.append(rows.count()) if "text" in rows.columns else 0) or by_group(rows, n))
    base = ["v%d" % i for i in range(300)]
    rows = [(None, " ".join(base[:i % 290] + ["new%d" % i] + base[i % 290:])) for i in range(100)]
    got = minhash.near_duplicates(docs(rows))
    assert got.select("group").distinct().count() == 1 and got.count() == 100
    assert sent == [100]


# ---- nearest neighbours

@pytest.mark.parametrize("rounds", [1, 5])
def test_every_query_gets_its_rows(spark, monkeypatch, rounds):
    monkeypatch.setattr(ann, "ROUNDS", rounds)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(64):  # tight groups, then vectors far from all others
        centre = rng.normal(size=8) * 10
        rows += [(centre + rng.normal(size=8) * 1e-4).tolist() for _ in range(15)]
    rows += [(rng.normal(size=8) * 10).tolist() for _ in range(20)]
    table = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(table, F.col("vec_id") >= 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert [len(got.get(i, ())) for i in range(len(rows))] == [10] * len(rows)
    x, hits = np.array(rows), 0
    for i in range(960, 980):
        hits += len(got[i] & set(np.argsort(((x - x[i]) ** 2).sum(axis=1))[1:11].tolist()))
    assert hits >= 0.9 * 200


# ---- mixing

def test_very_many_sources(spark):
    n = 21_000
    table = spark.range(n).selectExpr("id as doc_id", "'a b c d' as text", "concat('site', id) as source")
    got = mixing.mix_documents(table).groupBy("target").agg(F.count("*").alias("n"), F.sum("taken").alias("taken")).collect()
    assert sum(r.n for r in got) == n and sum(r.target * r.n for r in got) == pytest.approx(4 * n)
    assert {round(r.target, 6): r.n for r in got} == {2.0: n // 3, 4.0: n // 3, 6.0: n // 3}
    # texts of four words are used a whole number of times
    assert all(r.taken in (0, 4 * r.n, 8 * r.n) for r in got)


def test_patterns_of_each_solved_part(spark, monkeypatch):
    """Sources by themselves are solved in the tasks; the driver's flows see what overlaps, a part at a time."""
    parts = []
    flow = mixing.min_cost_flow
    monkeypatch.setattr(mixing, "min_cost_flow", lambda supply, *more: parts.append(len(supply)) or flow(supply, *more))
    rows = [(i, 10, [f"alone{i % 50}"]) for i in range(500)]
    rows += [(1000 + i, 10, ["a", "b"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["c", "d"]) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id bigint, n bigint, sources array<string>")
    got = mixing.mix(table, "n", "sources", "1 + place % 2").collect()
    assert sorted(parts) == [1, 2] and len(got) == 800
    by = {}
    for r in got:
        by.setdefault(r.sources[0], []).append(r)
    assert all(abs(sum(r.taken for r in v) - min(v[0].target, 3 * v[0].source_size)) <= 10 for k, v in by.items() if k.startswith("alone"))


def test_chosen_documents(spark):
    """Which documents are used, against the order of their digests."""
    import hashlib

    rng = random.Random(6)
    rows = [(i if i % 40 else None, "w " * rng.randint(0, 9), rng.choice(["a", "b", "b", "c", None])) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_documents(table, "text").collect()
    for source in ("a", "b", "c", None):
        own = [r for r in got if r.sources[0] == source]
        words, target = sum(r["size"] for r in own), own[0].target
        whole, part = divmod(min(round(target), 3 * words), words)
        assert all(whole <= r.repeats <= whole + 1 for r in own)
        key = lambda r: (hashlib.md5(("0/" + str(r.doc_id) if r.doc_id is not None else "0").encode()).hexdigest(), r["size"])
        before = 0
        for r in sorted(own, key=key):
            slice_edge = r.repeats == whole + 1
            if before + r["size"] <= part:
                assert slice_edge or r["size"] == 0 or 2 * (part - before) < r["size"]
            elif before >= part:
                assert not slice_edge or r["size"] == 0 or r.doc_id is None
            before += r["size"]


def test_uses_are_those_of_the_flow():
    rng = random.Random(2)
    for _ in range(200):
        members = [[0], [1], [2], [3], *([sorted(rng.sample(range(4), 2))] if rng.random() < 0.7 else [])]
        supply, quota = [rng.randrange(9) for _ in members], [rng.randrange(20) for _ in range(4)]
        assert mixing.uses(supply, members, quota) == [sum(f) for f in mixing.min_cost_flow(supply, members, quota)]


# ---- language ID

def test_language_of_long_texts_only(spark):
    rng = random.Random(4)
    words = {"en": ["the", "house", "with", "night"], "xx": ["дом", "ночь", "улица", "слово"]}
    text = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    rows = [(i, text("en", 200), "en", "s", 1) for i in range(20)] + [(100 + i, text("xx", 9000), "xx", "s", 1) for i in range(3)]
    assert all(len(r[1].encode()) > langid.TRAIN_TEXT_BYTES for r in rows[20:])
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in langid.identify(table, langid.learn(table)).collect()}
    assert all(got[r[0]].lang_pred == r[2] and got[r[0]].lang_bits < 3 for r in rows)
    kept = corpus_pipeline.identify_language(spark, table, SMALL)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows}


def test_stage_without_any_language(spark, docs):
    table = docs([(1, "a text"), (2, "12 34"), (3, None), (None, "no id"), (4, "улица")])
    kept = corpus_pipeline.identify_language(spark, table, SMALL)
    assert kept.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in kept.collect()} == {1, None, 4}
