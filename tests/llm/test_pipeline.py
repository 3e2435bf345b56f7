"""The pipeline's stages on repeated rows, repeated ids and null ids."""

import collections

import corpus_pipeline
import pytest

from formlode.llm import mixing
from pyspark.sql import functions as F

from .test_operators import TONGUES, prose, syllables

STAGES = dict(corpus_pipeline.STAGES)
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SHAPE)


def test_one_row_of_each_group_of_copies_stays(spark):
    a, b, c, d, e = (prose(i, 120) for i in range(50, 55))
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(1, a), (1, a), (2, near), (2, b), (3, c), (3, c.replace("w", "W")), (None, d), (None, e), (None, e), (4, None), (4, None)]
    out = STAGES["near duplicates"](spark, table(spark, [(i, t, "en") for i, t in rows]), "")
    got = collections.Counter((r.doc_id, (r.text or "").lower()) for r in out.collect())
    assert got == {(1, a): 1, (2, b): 1, (3, c.lower()): 1, (None, d): 1, (None, e): 1, (4, ""): 2}
    cut = STAGES["repeated passages"](spark, out, "")
    assert collections.Counter((r.doc_id, (r.text or "").lower()) for r in cut.collect()) == got


@pytest.mark.parametrize("shared", [7, None])
def test_each_row_has_its_own_copies(spark, shared):
    rows = [(shared if i % 2 else n * 1000 + i, syllables(n * 1000 + i, size, TONGUES[lang]), lang) for n, (lang, many, size) in enumerate([("aa", 200, 90), ("bb", 20, 20), ("cc", 4, 9)]) for i in range(many)]
    docs = table(spark, rows)
    posterior = mixing.learned(docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("domain")))
    rates = mixing.mixed(docs.withColumn("own", F.xxhash64("text")), posterior, id_col="own", temperature=corpus_pipeline.TEMPERATURE, least=1.0).rows
    copies = rates.withColumnRenamed("id", "own").join(docs.withColumn("own", F.xxhash64("text")), "own")
    expected = {r.text: r.n for r in copies.select("text", mixing.copies(F.col("rate"), F.col("doc_id")).alias("n")).collect()}
    assert len(expected) == len(rows) and max(expected[t] for i, t, _ in rows if i == shared) > 1
    assert collections.Counter(r.text for r in STAGES["mixing"](spark, docs, "").collect()) == expected
