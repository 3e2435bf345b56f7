"""Embeddings against a plain loop over words: values, digits, batches, and which rows are embedded anew."""

import math
import zlib
from pathlib import Path

import pytest

from formlode.operators import retrieval as re
from formlode.plans import QUERIES
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def plain(text, width=64):
    out = [0.0] * width
    for word in (text or "").lower().split():
        h = zlib.crc32(word.encode())
        out[h % width] += 1.0 if h >= 2**31 else -1.0
    norm = math.sqrt(sum(x * x for x in out)) or 1.0
    return [round(x / norm, 8) for x in out]


def same(got, text):
    return len(got) == 64 and all(abs(x - y) <= 1.01e-8 and x == round(x, 8) for x, y in zip(got, plain(text), strict=True))


TEXTS = [None, "", "  \t ", "One one ONE two", "naïve Straße 東京 東京", "a" * 100_000, "x y " * 50_000]


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_values_do_not_depend_on_batches(spark, most):
    rows = spark.createDataFrame(list(enumerate(TEXTS * 2)), "i long, text string").repartition(2)
    got = {r.i: r.e for r in rows.select("i", re.embedder(batch_texts=most)("text").alias("e")).collect()}
    assert all(same(got[i], t) for i, t in enumerate(TEXTS * 2))
    assert spark.createDataFrame([], "text string").select(re.embedder()("text")).count() == 0


def test_only_unusable_embeddings_are_made(spark):
    have = [[1.0, 2.0], None, [], [0.0, 0.0]]
    rows = spark.createDataFrame([(i, "some words", e) for i, e in enumerate(have)], "i long, text string, embedding array<double>")
    got = {r.i: r.embedding for r in re.embed_missing(rows, "text").collect()}
    assert got[0] == [1.0, 2.0] and all(same(got[i], "some words") for i in (1, 2, 3))


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_queries_embed_every_row(spark):
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    got = QUERIES["embed_text"](spark, DATA).collect()
    assert len(got) == len(texts) and all(same(r.embedding, texts[r.doc_id]) for r in got)
    part = {r.p_partkey: r for r in spark.read.parquet(f"{DATA}/part.parquet").collect()}
    named = QUERIES["udf_embed"](spark, DATA).collect()
    assert len(named) == len(part) and all(same(r.embedding, part[r.p_partkey].p_name) for r in named)
    again = QUERIES["reembed"](spark, DATA).select("vector_id", F.col("embedding").alias("e")).collect()
    assert {r.vector_id for r in again} == {k for k in part if k % 3 == 0}
    assert all(same(r.e, f"{part[r.vector_id].p_name} corrected:{part[r.vector_id].p_type}") for r in again)
