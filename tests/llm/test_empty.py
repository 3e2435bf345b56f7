"""Operators that learn have a defined result where nothing can be learned from."""

from formlode.llm import mixing, quality_classifier, toxicity


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b c", None), (2, "d e", None)], "id long, text string, domain string")
    unknown = mixing.learned(docs)
    rows = mixing.mixed(docs.withColumnRenamed("id", "doc_id"), unknown).rows.collect()
    assert sorted((r.id, r.tokens, r.posterior, r.rate) for r in rows) == [(1, 3, [1.0], 1.0), (2, 2, [1.0], 1.0)]
    assert mixing.mixed(docs.filter("id < 0"), mixing.learned(docs.filter("id < 0")), id_col="id", least=1.0).rows.count() == 0
    labels = spark.createDataFrame([(1, 0), (7, 1), (8, 0)], "id long, label int")
    for some in (labels, labels.filter("id > 1")):  # texts of one label, or of none
        model = quality_classifier.learned(docs.select("id", "text"), some)
        assert len({r.score for r in toxicity.scored(docs.withColumnRenamed("id", "doc_id"), model).collect()}) == 1
