"""A training-data pipeline of five stages, each one an operator of ``seclake.llm``.

Every stage takes what the one before has written and returns the columns of ``documents`` (the last one: the
token files' content).  ``run`` writes the stages to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seclake.llm import decontaminate, langid, minhash, mixing, token_files
from seclake.llm.tables import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Code length in bits per byte from which on no learned language explains a text: it takes more than its bytes.
REJECT_BITS = 8.0
#: Shingle similarity in percent from which on documents are near duplicates here (op4_minhash has its own).
NEAR_PERCENT = 80
#: Numbers of dropped rows which are broadcast; beyond that many they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents, written with a number of each row in ``__row``; ids may be null or repeated, rows are not."""
    return materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")), "numbered")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents whose row is not in ``dropped``; texts are not moved where these are few."""
    few = dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(dropped) if few else dropped, "__row", "left_anti").select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or text, and those which no learned language explains.

    Where no document has a language, none is learned, and all documents with a letter are kept.
    """
    model = langid.learn(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = langid.identify(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_bits") < REJECT_BITS)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates (similarity of 0.8 or more), that with the smallest id.

    A null id is the largest; equal rows count as copies.  Rows without text or words are in no group and stay.
    An empty table stays empty.
    """
    docs = _numbered(docs)
    found = materialize(minhash.near_duplicates(docs, percent=NEAR_PERCENT, row_col="__row").where("group is not null"), "near")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).getField("row").alias("row"))
    return _without(docs, found.join(first, "row", "left_anti").select(F.col("row").alias("__row")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows which share a window of ten words with a benchmark item, each by its own text.

    Rows without text stay; without items all rows stay; an empty table stays empty.
    """
    # rows with the same id and text are judged alike, so a digest of both will do for a number
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("/"), F.coalesce(F.concat(F.lit("+"), "text"), F.lit("")))
    docs = docs.select(*COLUMNS, F.md5(own).alias("__row"))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark, id_col="__row").where("contaminated")
    return _without(docs, materialize(found.select(F.col("doc_id").alias("__row")).distinct(), "contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring sources to their target weights; a row used n times is in n rows.

    Rows with equal or null ids are used each by itself; a null source is a source; an empty table stays empty.
    """
    used = mixing.mix_documents(docs, "text", "lang", "source", "n_chars").where("repeats > 0")
    return used.withColumn("__use", F.explode(F.sequence(F.lit(1), "repeats"))).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and return what they hold, a row for each row of ``docs``: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id only; rows with equal or null ids are each written; an empty table gives no rows.
    """
    return token_files.tokens_of(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Prediction by partial matching and tokenization are not expressible in SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
