"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, quality_classifier, toxicity
from .jaccard_join import ngram_components
from .near_dup import near_duplicates
from .packing import pack_sequences
from .periodic_runs import periodic_runs
from .quality_rules import fit, judged, measured
from .storage import written
from .substring_dedup import substring_dedup
from .training import remainder
from .topk import exact_top_k
from .warc import read_records, typed, write_archives
from .whitening import whitened


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(typed(_table(spark, sf_dir, "pages"), least=1000))
    back = read_records(index, with_payload=False)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    posterior = mixing.learned(docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("domain")))
    rows = mixing.mixed(docs, posterior, temperature=0.7).rows
    domains = F.array(*[F.lit(d) for d in posterior.domains])
    likeliest = F.get(domains, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1).alias("domain")
    return rows.select(F.col("id").alias("doc_id"), "tokens", likeliest, "posterior", "rate", mixing.copies(F.col("rate"), F.col("id")).alias("copies"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rest = remainder(F.col("doc_id"), 4)
    filters = langid.learned(docs.filter(rest != 2).select(F.col("doc_id").alias("id"), "text", "lang"))
    held = F.coalesce(rest == 2, F.lit(False)).alias("held_out")
    return langid.identified(docs, filters).select("doc_id", held, "lang_pred", "score")


def _labels(spark: SparkSession, sf_dir: str, label: str, modulus: int, held: int) -> DataFrame:
    """(id, label) of the rows that a score may learn from."""
    rows = _table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), modulus) != held)
    return rows.select(F.col("doc_id").alias("id"), F.col(label).alias("label"))


def _judged(docs: DataFrame, model: toxicity.Model | quality_classifier.Model, modulus: int, held: int, least: float) -> DataFrame:
    held_out = F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out")
    return toxicity.scored(docs, model).select("doc_id", held_out, "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learned(docs.select(F.col("doc_id").alias("id"), "text"), _labels(spark, sf_dir, "toxic", 3, 1))
    return _judged(docs, model, 3, 1, 0.7)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.learned(docs.select(F.col("doc_id").alias("id"), "text"), _labels(spark, sf_dir, "quality", 5, 0))
    return _judged(docs, model, 5, 0, 0.3)


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(_table(spark, sf_dir, "documents"), capacity=2048)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    docs = measured(_table(spark, sf_dir, "documents"))
    stats = written(docs.select("doc_id", "lang", "source", "n_lines", *base), "statistics")
    return judged(stats, fit(stats)).select("doc_id", *base, "kept", "outlier_distance")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(_table(spark, sf_dir, "embeddings"), components=4)


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"), size=5, percent=80)


def repeating(docs: DataFrame) -> DataFrame:
    """``docs`` with texts made to repeat from some word on where h % 10 = 0, h being the crc32 of the id as text; the rest as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(h / 10), F.size("_words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    at = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    made = F.array_join(F.transform(at, lambda i: F.get("_words", i.cast("int"))), " ")
    cut = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, p))
    return cut.withColumn("text", F.when(n > 0, made).otherwise(F.col("text"))).drop("_words", "_a", "_p")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = periodic_runs(repeating(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    digest = F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256)
    rows = done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest.alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    exponent = F.expr("1000 * best.length div -best.period")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_langid": op4_langid,
    "op5_toxicity": op5_toxicity,
    "op6_near_dup": op6_near_dup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_exact_topk": op8_exact_topk,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_ngram_jaccard": op12_ngram_jaccard,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last, payload_bytes >= 1000 AS large FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN large AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN large AND page_id IS DISTINCT FROM last THEN last END AS refers_to
        FROM g""",
    "op8_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
