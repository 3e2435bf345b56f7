"""Corpus preparation in five stages: each works on all that its predecessor kept, and all but the last return documents."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlode.llm import mixing
from formlode.llm.near_dup import near_duplicates
from formlode.llm.packing import pack_sequences
from formlode.llm.quality_rules import quality_rules
from formlode.llm.storage import written
from formlode.llm.substring_dedup import substring_dedup
from formlode.shipping import ship

#: Words of a near-duplicate shingle and of a repeated passage, tokens of a sequence.
SHINGLE, WINDOW, CAPACITY = 5, 50, 2048
#: Domain targets go with supply to this power: smaller languages gain a little.
TEMPERATURE = 0.85


def _stage(work):
    """A stage whose session's executors have this package."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return work(spark, docs, sf_dir)

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique _row, written so that it stays the same: ids may be null or repeated."""
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def reject_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject."""
    return quality_rules(docs).filter("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, one of the smallest id, of each group of near copies; null ids come last, texts without words all stay.

    Rows are named by a hash of id and text, so no copy of the corpus is written; of rows that agree in both, any one stays.
    """
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    groups = written(near_duplicates(rows, id_col="_row", shingle=SHINGLE, percent=80), "groups")
    names = groups.groupBy("_row").agg(F.first("component_id").alias("component_id"), ((F.count(F.lit(1)) > 1) & (F.max("n_shingles") > 0)).alias("_again"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row", "_again")).alias("first")
    kept = names.join(rows.select("_row", "doc_id").distinct(), "_row").groupBy("component_id").agg(first).select("first._row", "first._again")
    stay = rows.join(written(kept, "kept"), "_row")
    return stay.filter("NOT _again").unionByName(stay.filter("_again").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of WINDOW words or more that occur twice; a text that loses nothing stays as it is, one that loses all goes."""
    done = substring_dedup(docs, window=WINDOW)
    changed = done.filter("n_removed < n_words OR n_words = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return changed.withColumns({"text": text, "n_chars": chars}).select(*docs.columns)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of under-supplied languages so that expected tokens meet tempered targets; every document stays at least once."""
    posterior = mixing.learned(docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("domain")))
    rows = _numbered(docs)
    rates = mixing.mixed(rows, posterior, id_col="_row", temperature=TEMPERATURE, least=1.0).rows.select(F.col("id").alias("_row"), "rate")
    # Rates differ from row to row but little within a language, and a document's copies depend on its own rate and id alone.
    copies = rates.join(rows.select("_row", "doc_id"), "_row").select("_row", mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"))
    extra = written(copies.filter("copies > 1"), "copies")
    again = rows.join(extra, "_row").withColumn("copies", F.explode(F.sequence(F.lit(2), F.col("copies")))).drop("copies")
    return docs.unionByName(again.select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of CAPACITY tokens."""
    return pack_sequences(docs, capacity=CAPACITY)


STAGES = [
    ("quality rules", reject_outliers),
    ("near duplicates", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("mixing", mix_languages),
    ("packing", pack),
]
STAGES = [(name, _stage(work)) for name, work in STAGES]

#: Outlier estimates, MinHash, fitted rates and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
