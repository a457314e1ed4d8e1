"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every window of ``WINDOW`` words the least hash of its ``GRAM``-word grams is kept (the rightmost of
equal ones).  Two equal windows keep the same gram at the same offset, so every shared span of
``WINDOW`` words shares a fingerprint.  Documents keep about two in seven of their grams, of which a bit filter passes those that may be the benchmark's; each carries
the few words around it, so that a fingerprint which meets one of a benchmark item is extended to the
windows that hold it and compared word by word, without going back to the text.

Items with fewer than ``WINDOW`` words are one window.  Winnowing guarantees nothing for such a short
span, so for each length that occurs (nine at most) all grams of that length are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialize

WINDOW, GRAM = 10, 5
#: Distinct benchmark windows up to which their fingerprints are sent to all tasks (about 10 MB).
BROADCAST_WINDOWS = 200_000

#: Bits of the filter of fingerprints, as a power of two; the largest place of a gram.
FILTER_BITS, _LAST = 17, 2147483647

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of bytes `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, letters, all beyond ASCII.
_BETWEEN = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: str) -> str:
    """Lower-cased words; ``lower`` is the same on ASCII and much faster."""
    small = f"if(octet_length({text}) = length({text}), lower({text}), translate({text}, '{_UPPER}', '{_LOWER}'))"
    return f"filter(split({small}, '{_BETWEEN}'), x -> x <> '')"


def _grams(words: str) -> str:
    """A number for each gram: 32 bits of its hash above its place, counted down.

    The least of several is thus the least hash, the rightmost of equal ones, and tells its place.  The words are
    hashed one after the other, so 'a bc' is not 'ab c'.
    """
    parts = ", ".join(f"{words}[i + {k}]" for k in range(GRAM))
    return (f"if(size({words}) < {GRAM}, array(), transform(sequence(0, greatest(size({words}) - {GRAM}, 0)), "
            f"i -> shiftleft(xxhash64({parts}), 32) | cast({_LAST} - i as bigint)))")


def _winnow(grams: str) -> str:
    """The least of every run of grams that make a window, without repeats."""
    run = WINDOW - GRAM + 1
    return (f"if(size({grams}) < {run}, array(), array_distinct(transform(sequence(0, greatest(size({grams}) - {run}, 0)), "
            f"i -> array_min(slice({grams}, i + 1, {run})))))")


def _joined(words: str, start: str, n: str) -> str:
    return f"array_join(slice({words}, cast({start} as int) + 1, {n}), ' ')"


def _key_by_row(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and a digest which tells rows with the same id but different texts apart."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn(
        "version", F.xxhash64("text"))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, size, span): the distinct windows of every item; items without words have none."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.expr(_words(f"`{text_col}`")).alias("w")).where("size(w) > 0")
    return items.select(
        "item_id", F.least(F.size("w"), F.lit(WINDOW)).alias("size"),
        F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {WINDOW}, 0)), "
                         f"i -> array_join(slice(w, i + 1, {WINDOW}), ' '))")).alias("span")).distinct()


def _fingerprints(spans: DataFrame) -> DataFrame:
    """(print, offset) of full windows."""
    cut = spans.where(f"size = {WINDOW}").select(F.split("span", " ").alias("w"))
    kept = cut.select(F.expr(_grams("w")).alias("g")).select(F.explode(F.expr(_winnow("g"))).alias("p"))
    return kept.selectExpr("shiftright(p, 32) as print", f"cast({_LAST} - (p & {_LAST}L) as int) as offset").distinct()


def _filter(prints: DataFrame) -> str:
    """An array literal with a bit for each value of some bits of the fingerprints, set where one occurs."""
    words = 1 << FILTER_BITS - 5
    rows = prints.selectExpr(f"cast(shiftright(print, 5) & {words - 1} as int) as at", "cast(print & 31 as int) as bit").groupBy(
        "at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).collect()  # at most 2^12
    bits = [0] * words
    for r in rows:
        bits[r["at"]] = r["bits"]
    return "array(" + ", ".join(f"{x}L" for x in bits) + ")"


def scan(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """One row per document (place -1) and one per fingerprint that may be one of ``prints``, from one reading.

    doc_id, version, n_words, place, print, around: the words from which a window that keeps the gram can
    start, up to where it can end.
    """
    reach = WINDOW - GRAM
    words = (1 << FILTER_BITS - 5) - 1
    may = f"(shiftright({_filter(prints)}[cast(shiftright(x, 37) & {words} as int)], cast(shiftright(x, 32) & 31 as int)) & 1) = 1"
    place = f"cast({_LAST} - (x & {_LAST}L) as int)"
    return (docs.select("doc_id", "version", F.expr(f"coalesce({_words('text')}, array())").alias("w"))
            .select("doc_id", "version", "w", F.expr(_grams("w")).alias("g"))
            .select("doc_id", "version", F.size("w").cast("bigint").alias("n_words"), F.expr(
                f"inline(concat(array(named_struct('place', -1, 'print', 0L, 'around', '')), "
                f"transform(filter({_winnow('g')}, x -> {may}), x -> named_struct('place', {place}, 'print', shiftright(x, 32), "
                f"'around', {_joined('w', f'greatest({place} - {reach}, 0)', f'least({place}, {reach}) + {WINDOW}')}))))")))


def occurrences(docs: DataFrame, scanned: DataFrame, spans: DataFrame, prints: DataFrame) -> DataFrame:
    """(doc_id, version, start, size, span): where benchmark windows occur in the documents."""
    sizes = [r[0] for r in spans.select("size").distinct().collect()]  # ten at most
    small = spans.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    sent = F.broadcast if small else lambda df: df
    reach = WINDOW - GRAM
    by_print = prints.groupBy("print").agg(F.collect_set("offset").alias("offsets"))  # six at most
    met = scanned.where("place >= 0").join(sent(by_print), "print")
    starts = met.select("doc_id", "version", "around", "place", F.explode("offsets").alias("offset")).where("place >= offset")
    every = starts.select("doc_id", "version", F.expr("place - offset").alias("start"), F.expr(_joined(
        "split(around, ' ')", f"least(place, {reach}) - offset", str(WINDOW))).alias("span"), F.lit(WINDOW).alias("size")).distinct()
    split = docs.select("doc_id", "version", F.expr(_words("text")).alias("w"))
    for n in sizes:
        if n < WINDOW:
            every = every.unionByName(split.where(f"size(w) >= {n}").select(
                "doc_id", "version", F.expr(f"posexplode(transform(sequence(0, size(w) - {n}), i -> {_joined('w', 'i', str(n))}))")
                .alias("start", "span")).withColumn("size", F.lit(n)))
    return every.join(sent(spans), ["span", "size"]).select("doc_id", "version", "start", "size", "span")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of documents inside an occurrence of a window of ten words of a benchmark item.

    Words are lower-cased (A-Z) runs of digits, a-z and all characters beyond ASCII.

    Returns one row per input row: doc_id, n_words, n_hit, item_ids (items with an occurring window,
    sorted as strings), contaminated (n_hit > 0), spans (merged word ranges, end exclusive).

    Null and empty texts have no words and no hits; items without words match nothing; items which repeat
    an id or a text are all reported, each id once.  Rows with equal ids are judged by their own text; a null
    id is kept.  Items without an id mark documents as contaminated but are in no list.  An empty benchmark
    leaves all documents clean.  Other columns are ignored.
    """
    rows = _key_by_row(docs, id_col, text_col)
    windows = materialize(benchmark_windows(benchmark), "windows")
    spans = materialize(windows.select("size", "span").distinct(), "spans")
    prints = materialize(_fingerprints(spans), "prints")
    scanned = materialize(scan(rows, prints), "scanned")
    hits = materialize(occurrences(rows, scanned, spans, prints), "occurrences")
    key = ["doc_id", "version"]
    # ranges sorted by start, merged: (end so far, words so far, ranges so far)
    merged = F.expr("""
        aggregate(array_sort(r), cast(array() as array<struct<start:int,end:int>>), (acc, x) ->
          if(size(acc) > 0 and x.start <= element_at(acc, -1).end,
             concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start,
                    'end', greatest(element_at(acc, -1).end, x.end)))),
             concat(acc, array(x))))""")
    tops = hits.withColumn("reach", F.expr("start + size"))
    # a start matters only with its longest window; then runs of touching starts are folded
    ranges = tops.groupBy(*key, "start").agg(F.max("reach").alias("end")).groupBy(*key).agg(
        F.collect_list(F.struct("start", "end")).alias("r")).withColumn("spans", merged)
    counted = ranges.select(*key, "spans", F.expr("aggregate(spans, 0L, (acc, x) -> acc + x.end - x.start)").alias("n_hit"))
    ids = hits.select(*key, "span", "size").distinct().join(
        windows.where("item_id is not null"), ["span", "size"]).select(*key, F.col("item_id").cast("string").alias("item")).distinct()
    listed = ids.groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    found = counted.join(listed, (counted.doc_id.eqNullSafe(listed.doc_id)) & (counted.version == listed.version), "left").select(
        counted.doc_id.alias("id"), counted.version.alias("v"), "n_hit", "spans", "item_ids")
    sized = scanned.where("place = -1").select("doc_id", "version", "n_words")
    none = F.array().cast("array<string>")
    return sized.join(found, sized.doc_id.eqNullSafe(found.id) & (sized.version == found.v), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
b as (
  select distinct item_id, least(len(ws), 10) as size, array_to_string(ws[i:i + 9], ' ') as span
  from (select item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) as i from bw where len(ws) > 0)),
sizes as (select distinct size from b),
g as (
  select doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') as span
  from (select doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) as i from dw, sizes where len(ws) >= size)),
m as (select g.doc_id, g.i, g.size, b.item_id from g join b using (size, span)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + size - 1)) as p from m) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, item_id::varchar as item from m) group by doc_id)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw d left join hit using (doc_id) left join items using (doc_id)"""
