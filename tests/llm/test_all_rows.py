"""Scores of labels are learned from all labelled rows, in bounded blocks."""

import numpy as np
import pytest

from formlode.llm import presence, quality_classifier, toxicity
from pyspark.sql import functions as F


@pytest.mark.parametrize("learn", [toxicity.learned, quality_classifier.learned])
def test_no_sample_is_drawn(spark, monkeypatch, learn):
    seen = []
    packed = presence.blocks

    def kept(rows, size, paired):
        seen.append((rows.count(), sum(size.values())))
        return packed(rows, size, paired)

    def drawn(*_):
        raise AssertionError("a sample")

    monkeypatch.setattr(presence, "bounded_sample", drawn)
    monkeypatch.setattr(toxicity, "blocks", kept, raising=False)
    monkeypatch.setattr(quality_classifier, "blocks", kept, raising=False)
    rows = spark.range(120).selectExpr("id", "concat('some plain text ', id % 7, if(id % 3 = 0, ' scoundrel', ' friend')) AS text", "int(id % 3 = 0) AS label")
    model = learn(rows.select("id", "text"), rows.select("id", "label"), steps=5)
    assert seen == [(120, 120)]
    own = toxicity.scored(rows, model, id_col="id").join(rows, "id").groupBy("label").agg(F.min("score").alias("a"), F.max("score").alias("b")).orderBy("label").collect()
    assert own[0].b < own[1].a


@pytest.mark.parametrize("largest", [8, 10_000])
def test_blocks_hold_all_rows_and_pairs_of_both_labels(spark, monkeypatch, largest):
    monkeypatch.setattr(presence, "BLOCK", 10)
    monkeypatch.setattr(presence, "RARE", 4)
    monkeypatch.setattr(presence, "LARGEST", largest)
    rows = spark.range(200).selectExpr("int(id % 20 <> 0) AS label", "xxhash64(id) AS key", "array(smallint(id)) AS features", "array(double(id)) AS stats")
    got = presence.blocks(rows, {0: 10, 1: 190}, paired=True).collect()
    held = [np.frombuffer(r.features, np.int16) for r in got]
    assert {i for x in held for i in x.tolist()} == set(range(200))
    common = [i for x in held for i in x.tolist() if i % 20]
    assert len(common) == len(set(common)) == 190
    labels = [np.frombuffer(r.y, np.int8) for r in got]
    assert all(len(y) == len(x) and r.pairs == (y == 1).sum() * (y == 0).sum() for r, x, y in zip(got, held, labels, strict=True))


@pytest.mark.parametrize("few", [5, 1000])
@pytest.mark.parametrize("share", [0.0, 0.3, 0.999, 1.0])
def test_weighted_quantile_is_exact(spark, few, share):
    draw = np.random.default_rng(4)
    value, label = np.round(draw.normal(size=300), 1), draw.integers(0, 2, 300)
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(label, value, strict=True)], "label int, strength double")
    weight = np.where(label == 1, 1.0, 2.0)
    by = np.argsort(value)
    at = min(int(np.searchsorted(np.cumsum(weight[by]), share * weight.sum())), 299)
    after = value[value > value[by][at]]
    want = (value[by][at] + (after.min() if len(after) else value[by][at])) / 2
    assert quality_classifier.weighted_quantile(rows, {0: 2.0, 1: 1.0}, share, few) == pytest.approx(want)


@pytest.mark.parametrize("most", [1 << 15, 1 << 26])
def test_few_texts_without_a_label_are_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(presence, "MOST", most)
    seen = []
    monkeypatch.setattr(presence, "written", lambda df, _: seen.append(df) or df)
    docs = spark.range(40_000).selectExpr("id", "concat('text ', id) AS text").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id, 'none' AS text"))
    labels = spark.range(0, 44_000, 10).selectExpr("id", "int(id % 20 = 0) AS label")
    texts, size, total = presence.labelled_texts(docs, labels)
    assert size == {0: 2000, 1: 2000} and total == {0: 2200, 1: 2200}
    assert {(r.label, r.text) for r in texts.collect()} == {(int(i % 20 == 0), f"text {i}") for i in range(0, 40_000, 10)}
    passed = presence.likely(docs, labels, 4400).count()
    assert 4000 <= passed < 4000 + 36_000 * min(1, 1.2 * 4400 / min(most, 16 * 4400))
    assert "LeftSemi" in seen[0]._jdf.queryExecution().optimizedPlan().toString()  # before the join that shuffles
    other = presence.likely(docs, labels.withColumn("id", F.col("id").cast("int")), 4400)
    assert other.count() == 40_001  # ids of two types are left to the join
