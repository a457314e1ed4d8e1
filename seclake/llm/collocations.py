"""Phrases of two or three words which occur together more often than their parts would by themselves.

Words and pairs are counted over the whole corpus.  That gives every pair its exact score, and every longer
phrase a bound before it is counted: a phrase with the prefix x y scores at most f(x y) / f(x), as no phrase
occurs more often than its prefix and none of its parts more rarely than itself.  Phrases are then grown best
first: of each language, only prefixes whose bound reaches a threshold are expanded, and only phrases grown
from them (or which could displace a pair above the threshold) are counted.  All that scores above the
threshold is known then.  A language is settled when 2000 phrases above its threshold survive; the others are
expanded further, down to a threshold of nothing if need be.

Tasks learn which prefixes are to be expanded from a bit filter of bounded size.  It never misses one; what
it lets through beyond them is counted exactly as well, so its size changes the work and not the result.  Such
a filter also keeps most rare words and pairs from being counted by their texts: their hashes are counted first.

Within a task, words are codes of a dictionary of the text at hand and phrases are pairs of codes; what leaves
the task is one row for each different phrase of a few megabytes of text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seclake.operators.joins import lookup_join

from .tables import frugal, materialize, partitions, runs
from .words import VALUES, Rolling, _mix, slices, text_buffer

#: Least count of a candidate; share (percent) of a phrase's count from which on a longer one displaces it.
LEAST, DISPLACE = 10, 50
#: Phrases of a language; pairs of a language above its first threshold; by which factor they grow.
TOP, FIRST, GROW = 2000, 4000, 8
#: Bytes of text counted at a time; rows sent on at a time; bits of a filter for each phrase in it, and at most.
PIECE, ROWS, BITS_EACH, MOST_BITS = 1 << 21, 1 << 16, 16, 1 << 27
#: Words of 64 bits of a filter which come to the driver in one row.
BLOCK_WORDS = 1 << 12
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOPS = np.zeros(256, bool)
_STOPS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_STOPS
_INSIDE[[0x20, 0x09]] = False
_KEYS = Rolling(0xD1342543DE82EF95 | 1)


def _chunks(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, bounds and language codes of texts of about ``limit`` bytes; a longer text is cut at stops."""
    raw, at = text_buffer(batch.column("text"))
    code = batch.column("lang").dictionary_encode().indices.to_numpy().astype(np.int64)
    for lo, hi in slices(at, limit):
        part = raw[at[lo]:at[hi]]
        if hi - lo > 1 or len(part) <= limit:
            yield part, at[lo:hi + 1] - at[lo], code[lo:hi]
            continue
        begin = 0
        while begin < len(part):
            end = begin + limit
            while end < len(part) and not _STOPS[part[end:end + limit]].any():
                end += limit
            end = min(len(part), end + int(_STOPS[part[end:end + limit]].argmax()) + 1) if end < len(part) else len(part)
            yield part[begin:end], np.array([0, end - begin]), code[lo:hi]
            begin = end


_U = np.uint64
_ONE, _TWO, _ROLE = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x2545F4914F6CDD1D)


def _hash(column: pa.Array) -> np.ndarray:
    """Hash of each text, the same in every task."""
    raw, at = text_buffer(column)
    return _KEYS.ranges(VALUES[raw], at[:-1], at[1:])


def _key(lang: np.ndarray, one: np.ndarray, two: np.ndarray | int = 0) -> np.ndarray:
    """Key of a word or a pair from the hashes of its parts."""
    return _mix(lang + one * _ONE + two * _TWO)


def _phrase_keys(lang: pa.Array, phrase: pa.Array) -> np.ndarray:
    """Keys of pairs from their texts."""
    raw, at = text_buffer(phrase)
    blank = np.flatnonzero(raw == 0x20)  # one in each
    coded = lang.dictionary_encode()
    one, two = _KEYS.ranges(VALUES[raw], at[:-1], blank), _KEYS.ranges(VALUES[raw], blank + 1, at[1:])
    return _key(_hash(coded.dictionary)[coded.indices.to_numpy()], one, two)


class _Words:
    """Words of texts as codes: ``code`` of each, its ``lang``, and whether the ``next`` one is in its piece."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, lang: np.ndarray):
        inside = _INSIDE[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = at[:-1][at[:-1] < at[1:]]
        first[heads] = inside[heads]
        start = np.flatnonzero(first)
        bounds = np.append(np.cumsum(inside, dtype=np.int32)[start] - 1, np.count_nonzero(inside)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(_LOWER[raw[inside]])])
        coded = words.dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.size = max(len(self.words), 1)
        self.hash = _hash(self.words)
        text = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(start, at)))
        self.lang = lang[text]
        piece = np.cumsum(_STOPS[raw], dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
        self.next = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])

    def phrase(self, *codes: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(*(self.words.take(pa.array(c)) for c in codes), b" ").cast(pa.string())

    def singles(self) -> tuple[np.ndarray, ...]:
        """Language and code of different words, and their counts."""
        key, n = np.unique(self.lang * self.size + self.code, return_counts=True)
        return key // self.size, key % self.size, n

    def pairs(self) -> tuple[np.ndarray, ...]:
        """Language and codes of different pairs, their counts, and the pair which begins at each word (-1: none)."""
        there = np.flatnonzero(self.next)
        key = (self.lang[there] * self.size + self.code[there]) * self.size + self.code[there + 1]
        key, which, n = np.unique(key, return_inverse=True, return_counts=True)
        at = np.full(len(self.code), -1, np.int64)
        at[there] = which
        return key // self.size ** 2, key // self.size % self.size, key % self.size, n, at


def _sent(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    batch = pa.record_batch(columns)
    for lo in range(0, batch.num_rows, ROWS):
        yield batch.slice(lo, ROWS)


def _rows(langs: pa.Array, lang: np.ndarray, k: int, phrase: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    return _sent({"lang": langs.take(pa.array(lang)), "k": pa.array([k] * len(n), pa.int32()), "phrase": phrase, "n": pa.array(n)})


def _languages(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    langs = batch.column("lang").dictionary_encode().dictionary
    return langs, _hash(langs)


def _count_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the keys of words and pairs in a few megabytes of text at a time."""
    for batch in batches:
        _, known = _languages(batch)
        for chunk in _chunks(batch, PIECE):
            words = _Words(*chunk)
            lang, one, n = words.singles()
            yield from _sent({"key": pa.array(_key(known[lang], words.hash[one]).view(np.int64)), "n": pa.array(n)})
            lang, one, two, n, _ = words.pairs()
            yield from _sent({"key": pa.array(_key(known[lang], words.hash[one], words.hash[two]).view(np.int64)), "n": pa.array(n)})


def _count_short(shared):
    """Counts of words and pairs which the filter lets through, and of all words of a language (without a text)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = _Filter(shared.value)
        for batch in batches:
            langs, known = _languages(batch)
            for chunk in _chunks(batch, PIECE):
                words = _Words(*chunk)
                lang, n = np.unique(words.lang, return_counts=True)
                yield from _rows(langs, lang, 0, pa.array([""] * len(lang), pa.string()), n)
                lang, one, n = words.singles()
                keep = passes(_key(known[lang], words.hash[one]))
                yield from _rows(langs, lang[keep], 1, words.phrase(one[keep]), n[keep])
                lang, one, two, n, _ = words.pairs()
                keep = passes(_key(known[lang], words.hash[one], words.hash[two]))
                yield from _rows(langs, lang[keep], 2, words.phrase(one[keep], two[keep]), n[keep])
    return run


ANY, GROWN, ABOVE = 0, 1, 2


def _places(key: np.ndarray, role: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a filter for each key in a role."""
    key = _mix(key + _U(role) * _ROLE)
    return (key >> _U(32)).astype(np.int64) & (bits - 1), (key & _U(bits - 1)).astype(np.int64)


class _Filter:
    """Which keys may be in which role; ``packed`` holds the bits."""

    def __init__(self, packed: bytes):
        self.packed, self.bits = packed, 8 * len(packed)

    def __call__(self, key: np.ndarray, role: int = ANY) -> np.ndarray:
        table = np.frombuffer(self.packed, np.uint8)
        one, two = _places(key, role, self.bits)
        return ((table[one >> 3] >> (one & 7).astype(np.uint8)) & (table[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool)


def _count_long(shared):
    """Counts of triples which the filter lets through."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = _Filter(shared.value)
        for batch in batches:
            langs, hashes = _languages(batch)
            for chunk in _chunks(batch, PIECE):
                words = _Words(*chunk)
                if len(words.code) < 3:
                    continue
                lang, one, two, _, at = words.pairs()
                keys = _key(hashes[lang], words.hash[one], words.hash[two])
                known = passes(keys)
                grown, above = known & passes(keys, GROWN), known & passes(keys, ABOVE)
                place = np.flatnonzero((at[:-2] >= 0) & (at[1:-1] >= 0))
                left, right = at[place], at[place + 1]
                place = place[(grown[left] & known[right]) | (known[left] & above[right])]
                key, n = np.unique(at[place] * words.size + words.code[place + 2], return_counts=True)
                pair = key // words.size
                yield from _rows(langs, lang[pair], 3, words.phrase(one[pair], two[pair], key % words.size), n)
    return run


def _of_keys(batch: pa.RecordBatch, bits: int) -> list[np.ndarray]:
    return [*_places(batch.column("key").to_numpy().view(_U), ANY, bits)]


def _of_pairs(batch: pa.RecordBatch, bits: int) -> list[np.ndarray]:
    keys, places = _phrase_keys(batch.column("lang"), batch.column("phrase")), []
    for role, column in ((ANY, None), (GROWN, "grown"), (ABOVE, "above")):
        places += _places(keys[batch.column(column).to_numpy(zero_copy_only=False).astype(bool)] if column else keys, role, bits)
    return places


def _filter_of(rows: DataFrame, places) -> bytes:
    """The bits which rows set, sized by their number up to ``MOST_BITS``."""
    bits = 1 << 10
    while bits < min(BITS_EACH * rows.count(), MOST_BITS):
        bits *= 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                place = np.unique(np.concatenate(places(batch, bits)))
                word, start = np.unique(place >> 6, return_index=True)
                value = np.bitwise_or.reduceat(_U(1) << (place & 63).astype(_U), start)
                yield pa.record_batch({"word": pa.array(word), "value": pa.array(value.view(np.int64))})

    words = rows.mapInArrow(run, "word bigint, value bigint").groupBy("word").agg(F.bit_or("value").alias("value"))
    blocks = words.withColumn("block", F.expr(f"word div {BLOCK_WORDS}")).repartition("block").sortWithinPartitions("block").mapInArrow(
        _packed, "block bigint, bits binary").toArrow()  # at most MOST_BITS bits
    table = np.zeros(bits // 8, np.uint8)
    for block, packed in zip(blocks["block"].to_pylist(), blocks["bits"].to_pylist()):
        there = table[8 * BLOCK_WORDS * block:8 * BLOCK_WORDS * (block + 1)]
        there[:] = np.frombuffer(packed, np.uint8)[:len(there)]
    return table.tobytes()


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of bits from their words."""
    for group in runs(batches, "block"):
        table = np.zeros(BLOCK_WORDS, np.int64)
        table[group["word"].to_numpy() % BLOCK_WORDS] = group["value"].to_numpy()
        yield pa.record_batch({"block": group["block"].combine_chunks()[:1], "bits": pa.array([table.tobytes()], pa.binary())})


def _exact(up: str, down: str) -> str:
    """SQL: floor(1000000 * up / down) of products of bigints, beyond 64 bits."""
    def product(names: str) -> str:
        return " * ".join(f"cast({x} as decimal(19))" for x in names.split())

    return f"(cast(1000000 as decimal(7)) * {product(up)}) div ({product(down)})"


_KEY = "concat(lang, ' ', {})"  # words hold no blank, so the parts of a key are known


def counted(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Counts over all texts: lang, k (words; 0: all words of a language), phrase, n.

    Words and pairs are there from ``LEAST`` on.  Pieces of text are counted before their rows are dealt out, so a
    frequent phrase has one row a piece.
    """
    spark = docs.sparkSession
    texts = _texts(docs, lang_col, text_col)
    keys = texts.mapInArrow(frugal(_count_keys), "key bigint, n bigint").repartition(partitions(spark), "key").groupBy("key").agg(
        F.sum("n").alias("n"))
    often = materialize(keys.where(f"n >= {LEAST}").select("key"), "keys")
    shared = spark.sparkContext.broadcast(_filter_of(often, _of_keys))
    counts = texts.mapInArrow(frugal(_count_short(shared)), "lang string, k int, phrase string, n bigint")
    return materialize(counts.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where(f"k = 0 or n >= {LEAST}"), "counts")


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def scored_pairs(counts: DataFrame) -> DataFrame:
    """Candidates of two words: lang, phrase, a, l, r, score, bound (of phrases which begin with it)."""
    words = counts.where("k = 1").select(F.expr(_KEY.format("phrase")).alias("key"), F.col("n").alias("f"))
    pairs = counts.where("k = 2").selectExpr("lang", "phrase", "n as a", "substring_index(phrase, ' ', 1) as one", "substring_index(phrase, ' ', -1) as two")
    first = lookup_join(pairs.withColumn("key", F.expr(_KEY.format("one"))), words, "key").withColumnRenamed("f", "l")
    both = lookup_join(first.withColumn("key", F.expr(_KEY.format("two"))), words, "key").withColumnRenamed("f", "r")
    return materialize(both.selectExpr("lang", "phrase", "a", "l", "r", f"{_exact('a a', 'l r')} as score", f"{_exact('a', 'l')} as bound"), "pairs")


def _thresholds(pairs: DataFrame, first: int) -> DataFrame:
    """(lang, limit): a score which about ``first`` pairs of the language reach, 0 where there are fewer.

    Scores are counted in some hundred classes, so no task ranks the pairs of a language.
    """
    classes = pairs.groupBy("lang", F.floor(F.log2(F.col("score") + 1) * 32).alias("class")).agg(
        F.count("*").alias("n"), F.min("score").alias("least"))
    above = Window.partitionBy("lang").orderBy(F.desc("class"))
    return classes.withColumn("reached", F.sum("n").over(above)).groupBy("lang").agg(
        F.coalesce(F.max(F.when(F.col("reached") >= first, F.col("least"))), F.lit(0)).alias("limit"))


def _scored_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidates of three words with keys of the pairs in them."""
    named = triples.selectExpr("lang", "phrase", "n as a", f"{_KEY.format('substring_index(phrase, chr(32), 2)')} as head",
                               f"{_KEY.format('substring_index(phrase, chr(32), -2)')} as tail")
    known = pairs.withColumn("key", F.expr(_KEY.format("phrase")))
    named = lookup_join(named, known.selectExpr("key as head", "l as l1", "a as l2"), "head")
    named = lookup_join(named, known.selectExpr("key as tail", "a as r1", "r as r2"), "tail")
    cuts = named.selectExpr("*", f"{_exact('a a', 'l1 r1')} as s1", f"{_exact('a a', 'l2 r2')} as s2")
    return cuts.selectExpr("lang", "phrase", "a", "if(s1 <= s2, l1, l2) as l", "if(s1 <= s2, r1, r2) as r", "least(s1, s2) as score", "head", "tail")


def collocations(docs: DataFrame, top: int = TOP, first: int = FIRST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased in A-Z and do not reach over stops or texts.  A null language is ``und``, a null text
    empty; every row counts, repeated ones and such without an id too; other columns are ignored.  Ties of the
    score go by count, then by text.  A language without candidates, and an empty table, give no rows.
    """
    spark = docs.sparkSession
    counts = counted(docs, lang_col, text_col)
    pairs = scored_pairs(counts)
    done: list[DataFrame] = []
    open_langs: DataFrame | None = None
    while True:
        live = pairs if open_langs is None else lookup_join(pairs, open_langs.withColumn("open", F.lit(True)), "lang").where("open").drop("open")
        limits = _thresholds(live, first)
        limits = materialize(limits, "limits")
        live = lookup_join(live, limits, "lang").selectExpr("*", "bound >= limit as grown", "score >= limit as above")
        live = materialize(live, "live")
        shared = spark.sparkContext.broadcast(_filter_of(live.select("lang", "phrase", "grown", "above"), _of_pairs))
        triples = _texts(docs, lang_col, text_col).mapInArrow(
            frugal(_count_long(shared)), "lang string, k int, phrase string, n bigint")
        triples = materialize(triples.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(f"n >= {LEAST}"), "triples")
        triples = materialize(_scored_triples(triples, live), "triples")
        longer = triples.selectExpr("explode(array(head, tail)) as key", "a").groupBy("key").agg(F.max("a").alias("longer"))
        standing = lookup_join(live.where("above").withColumn("key", F.expr(_KEY.format("phrase"))), longer, "key").where(
            f"longer is null or 100 * longer < {DISPLACE} * a").select("lang", "phrase", "a", "l", "r", "score")
        surviving = lookup_join(triples.drop("head", "tail"), limits, "lang").where("score >= limit").drop("limit").unionByName(standing)
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = surviving.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        ranked = materialize(ranked.withColumn("rank", F.col("rank").cast("bigint")), "ranked")
        reached = limits.join(ranked.groupBy("lang").agg(F.max("rank").alias("n")), "lang", "left")
        settled = F.coalesce(F.col("n"), F.lit(0)) >= top
        open_langs = materialize(reached.where(~((F.col("limit") == 0) | settled)).select("lang"), "open")
        done.append(lookup_join(ranked, open_langs.withColumn("open", F.lit(True)), "lang").where("open is null").drop("open"))
        if open_langs.isEmpty():
            break
        first *= GROW
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return lookup_join(out, counts.where("k = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^ \t]+') as ws from pieces),
i as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
f as (
  select lang, 1 as k, ws[i] as phrase, count(*) as n from i group by all
  union all select lang, 2, ws[i] || ' ' || ws[i + 1], count(*) from i where i + 1 <= len(ws) group by all
  union all select lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2], count(*) from i where i + 2 <= len(ws) group by all),
c as (select lang, k, phrase, n as a, string_split(phrase, ' ') as p from f where k > 1 and n >= 10),
cut as (
  select c.lang, c.k, c.phrase, c.a, x.k as cut_at, x.n as l, y.n as r,
    (1000000::hugeint * c.a * c.a) // (x.n::hugeint * y.n) as score
  from c join f x on x.lang = c.lang and x.k < c.k and x.phrase = array_to_string(c.p[:x.k], ' ')
  join f y on y.lang = c.lang and y.k = c.k - x.k and y.phrase = array_to_string(c.p[x.k + 1:], ' ')),
s as (select * from cut qualify row_number() over (partition by lang, phrase order by score, cut_at) = 1),
longer as (
  select lang, phrase, max(a) as a from (
    select lang, p[1] || ' ' || p[2] as phrase, a from c where k = 3 union all select lang, p[2] || ' ' || p[3], a from c where k = 3)
  group by lang, phrase),
t as (select lang, sum(n) as n from f where k = 1 group by lang)
select s.lang, row_number() over (partition by s.lang order by score desc, s.a desc, s.phrase)::bigint as rank, s.phrase, s.a::bigint as a,
  s.l::bigint as l, s.r::bigint as r, t.n::bigint as n, s.score::bigint as score
from s join t using (lang) left join longer g on g.lang = s.lang and g.phrase = s.phrase and s.k = 2
where g.a is null or 100 * g.a < 50 * s.a
qualify rank <= 2000"""
