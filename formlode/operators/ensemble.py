"""Combine two predictions for each form field, classify their agreement, and act on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlode.functions.rounding import mean

KEY = ("submission_id", "field_id")
#: Confidence from which a prediction counts as made.
MATCH = 0.75


def field_ids(rag: DataFrame, llm: DataFrame) -> DataFrame:
    """Fields that either source has a row for."""
    return rag.select(*KEY).union(llm.select(*KEY)).distinct()


def paired(rag: DataFrame, llm: DataFrame) -> DataFrame:
    """Full outer join of two prediction tables (submission_id, field_id, name, conf); fields are compared as integers."""
    left = rag.select(*KEY, F.col("name").alias("rag_name"), F.col("conf").alias("rag_conf"))
    right = llm.select(*KEY, F.col("name").alias("llm_name"), F.col("conf").alias("llm_conf"))
    return left.join(right, list(KEY), "full")


def select_ensemble(pairs: DataFrame) -> DataFrame:
    """Adds selected_from, selected_field_name, selected_conf and reason; the threshold plays no part here."""
    rag, llm = F.col("rag_name").isNotNull(), F.col("llm_name").isNotNull()
    same = F.col("rag_name") == F.col("llm_name")
    higher = F.coalesce("rag_conf", F.lit(0.0)) >= F.col("llm_conf")
    source = F.when(rag & llm, F.when(same | higher, "rag").otherwise("llm")).when(rag, "rag").when(llm, "llm")
    reason = F.when(rag & llm, F.when(same, "agreed").when(higher, "rag_higher").otherwise("llm_higher")).when(rag, "only_rag").when(llm, "only_llm").otherwise("none")
    picked = pairs.withColumns({"selected_from": source, "reason": reason})
    name = F.when(F.col("selected_from") == "rag", F.col("rag_name")).when(F.col("selected_from") == "llm", F.col("llm_name"))
    conf = F.when(F.col("selected_from") == "rag", F.col("rag_conf")).when(F.col("selected_from") == "llm", F.col("llm_conf"))
    return picked.withColumns({"selected_field_name": name, "selected_conf": conf})


def case_of(threshold: float = MATCH) -> Column:
    """A same, B different, C llm only, D rag only, E neither; a prediction counts from the threshold on."""
    rag = F.col("rag_name").isNotNull() & (F.col("rag_conf") >= threshold)
    llm = F.col("llm_name").isNotNull() & (F.col("llm_conf") >= threshold)
    return F.when(rag & llm, F.when(F.col("rag_name") == F.col("llm_name"), "A").otherwise("B")).when(llm, "C").when(rag, "D").otherwise("E")


def classify_cases(finals: DataFrame, threshold: float = MATCH) -> DataFrame:
    return finals.withColumn("case_type", case_of(threshold))


def prediction_summary(predictions: DataFrame, by: str = "submission_id", name: str = "rag_name", conf: str = "rag_conf") -> DataFrame:
    """Fields, matched, unmatched and mean confidence of the matched (0 if none) of each submission."""
    matched = F.col(name).isNotNull()
    average = F.coalesce(mean(F.when(matched, F.col(conf))), F.lit(0.0))
    return predictions.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(matched).alias("matched"), F.count_if(~matched).alias("unmatched"), average.alias("avg_confidence"))


def case_distribution(cases: DataFrame) -> DataFrame:
    """Count and sorted field ids of each case, and the winners among the differing ones, for each submission."""
    counts = [F.count_if(F.col("case_type") == c).alias(f"n_{c.lower()}") for c in "ABCDE"]
    fields = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("case_type") == c, F.col("field_id")))), ",").alias(f"fields_{c.lower()}") for c in "ABCDE"]
    won = [F.count_if((F.col("case_type") == "B") & (F.col("selected_from") == s)).alias(f"b_{s}") for s in ("rag", "llm")]
    return cases.groupBy("submission_id").agg(*counts, *fields, *won)


def context_lookup(wanted: DataFrame, contexts: DataFrame) -> DataFrame:
    """The fields to make vectors for that have a context; the others are left out."""
    return wanted.join(contexts, list(KEY))


def vector_actions(cases: DataFrame, start: float = 0.75) -> DataFrame:
    """(.., action, new_name, confidence, positive_count): boost the retrieval vector, create one, or none.

    A new vector bears the name that won and begins at the start confidence with one positive; other rows have nulls there.
    """
    boost = F.col("case_type").isin("A", "D") | ((F.col("case_type") == "B") & (F.col("selected_from") == "rag"))
    create = (F.col("case_type") == "C") | ((F.col("case_type") == "B") & (F.col("selected_from") == "llm"))
    action = F.when(boost, "boost").when(create, "create").otherwise("none")
    new = lambda c: F.when(action == "create", c)
    return cases.withColumns({"new_name": new(F.col("selected_field_name")), "confidence": new(F.lit(start)), "positive_count": new(F.lit(1)), "action": action})


def action_summary(actions: DataFrame) -> DataFrame:
    """How many rows took each action, by case."""
    return actions.groupBy("case_type", "action").agg(F.count(F.lit(1)).alias("n"))


def route_errors(feedback: DataFrame, cases: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vector that each reported error is charged to.

    feedback: error_id, submission_id, field_name. The error belongs to the first field, by id, that the submission gave
    that name. Cases A and D, and B where retrieval won, charge the field's own vector; other B and C the first vector of
    that name; E none. vectors: vector_id, field_name.
    """
    first = cases.groupBy("submission_id", "selected_field_name").agg(F.min_by(F.struct("field_id", "case_type", "selected_from", "rag_vector_id"), "field_id").alias("f"))
    named = vectors.groupBy(F.col("field_name").alias("name")).agg(F.min("vector_id").alias("named_vector"))
    rows = feedback.join(first.withColumnRenamed("selected_field_name", "field_name"), ["submission_id", "field_name"])
    rows = rows.join(named, F.col("field_name") == F.col("name"), "left")
    case, won = F.col("f.case_type"), F.col("f.selected_from") == "rag"
    own = case.isin("A", "D") | ((case == "B") & won)
    target = F.when(own, F.col("f.rag_vector_id")).when(case.isin("B", "C"), F.col("named_vector"))
    return rows.select("error_id", "submission_id", "field_name", F.col("f.field_id").alias("field_id"), case.alias("case_type"), target.alias("vector_id"))


def column_key_dedupe(cells: DataFrame) -> DataFrame:
    """Within a table column a key stays in its topmost row; elsewhere key and confidence become null."""
    order = Window.partitionBy("doc_id", "table_id", "column_id", "key").orderBy("row_id")
    keep = F.row_number().over(order) == 1
    ranked = cells.withColumn("_keep", keep | F.col("key").isNull())
    return ranked.withColumns({"key": F.when(F.col("_keep"), F.col("key")), "conf": F.when(F.col("_keep"), F.col("conf"))}).drop("_keep")
