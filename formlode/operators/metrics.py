"""Submission metrics, their hierarchical series, reports and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formlode.functions.rounding import half_up, mean, ratio

AMBIGUOUS = 0.10
LEVELS = (("hash", ("pdf_hash",)), ("category", ("category",)), ("subcategory", ("category", "sub_category")), ("doctype", ("category", "sub_category", "document_type")), ("global", ()))


def submission_metrics(cases: DataFrame) -> DataFrame:
    """Counts, coverage, agreement, recovery, confidence, ambiguity and case shares of each submission, in one aggregate.

    Predicted counts ignore the match threshold while cases apply it, so recovery can exceed 1. Margins exist for retrieval
    only; the other source counts as margin 0, hence as ambiguous.
    """
    count = lambda c: F.count_if(c)
    has = {s: F.col(f"{s}_name").isNotNull() for s in ("rag", "llm")}
    case = {c: count(F.col("case_type") == c) for c in "ABCDE"}
    margins = count(has["rag"]) + count(has["llm"])
    small = count(has["rag"] & (F.coalesce("rag_margin", F.lit(0.0)) < AMBIGUOUS)) + count(has["llm"])
    raw = cases.groupBy("submission_id", "user_id", "pdf_hash", "category", "sub_category", "document_type").agg(
        F.min("ts").alias("ts"),
        F.count(F.lit(1)).alias("total_fields"),
        count(has["llm"]).alias("predicted_llm"),
        count(has["rag"]).alias("predicted_rag"),
        count(F.col("selected_field_name").isNotNull()).alias("predicted_ensemble"),
        *[n.alias(f"case_{c.lower()}") for c, n in case.items()],
        *[F.coalesce(mean(F.when(has[s], F.col(f"{s}_conf"))), F.lit(0.0)).alias(f"avg_conf_{s}") for s in ("llm", "rag")],
        F.coalesce(mean(F.when(F.col("selected_conf") != 0, F.col("selected_conf"))), F.lit(0.0)).alias("avg_conf_ensemble"),
        ratio(half_up(F.sum(F.when(has["rag"], F.coalesce("rag_margin", F.lit(0.0))).otherwise(0.0)), 6), margins).alias("margin_avg"),
        ratio(small, margins).alias("ambiguity_rate"),
    )
    both = F.col("case_a") + F.col("case_b")
    total = F.col("total_fields")
    return raw.withColumns(
        {
            **{f"coverage_{s}": ratio(F.col(f"predicted_{s}"), total) for s in ("llm", "rag", "ensemble")},
            "agreement_rate": ratio(F.col("case_a"), both),
            "conflict_rate": ratio(F.col("case_b"), both),
            "rag_recovery": ratio(F.col("case_d"), total - F.col("predicted_llm")),
            "llm_recovery": ratio(F.col("case_c"), total - F.col("predicted_rag")),
            **{f"share_{c}": ratio(F.col(f"case_{c}"), total) for c in "abcde"},
        }
    )


def accuracy_after_errors(metrics: DataFrame, finals: DataFrame, feedback: DataFrame) -> DataFrame:
    """Errors and accuracy of each source and the ensemble.

    An error counts against a source once for every final field of its name; against the ensemble once.
    """
    hit = feedback.join(finals.select("submission_id", F.col("selected_field_name").alias("field_name"), "selected_from"), ["submission_id", "field_name"])
    sources = hit.groupBy("submission_id").agg(*[F.count_if(F.col("selected_from") == s).alias(f"errors_{s}") for s in ("llm", "rag")])
    total = feedback.groupBy("submission_id").agg(F.count(F.lit(1)).alias("errors_ensemble"))
    names = ("llm", "rag", "ensemble")
    rows = metrics.join(sources, "submission_id", "left").join(total, "submission_id", "left").fillna(0, [f"errors_{s}" for s in names])
    for s in names:
        made = F.col(f"predicted_{s}")
        value = (made - F.col(f"errors_{s}")).cast("double") / made.cast("double")
        signed = F.when(value < 0, -half_up(-value)).otherwise(half_up(value))
        rows = rows.withColumn(f"accuracy_{s}", F.when(made == 0, 0.0).otherwise(signed))
    return rows


def level_report(metrics: DataFrame, *by: str) -> DataFrame:
    """Submissions, errors, mean accuracy and coverage, first and last time of each group."""
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("submissions"),
        F.sum("errors_ensemble").alias("errors"),
        mean("accuracy_ensemble").alias("avg_accuracy"),
        mean("coverage_ensemble").alias("avg_coverage"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def global_comparison(metrics: DataFrame) -> DataFrame:
    """One row: totals, means of both sources, and the winner of each measure (more wins for rates)."""
    means = {m: mean(m) for s in ("llm", "rag") for m in (f"coverage_{s}", f"avg_conf_{s}")}
    sums = {f"predicted_{s}": F.sum(f"predicted_{s}") for s in ("llm", "rag", "ensemble")}
    rows = metrics.agg(F.count(F.lit(1)).alias("submissions"), F.sum("total_fields").alias("total_fields"), *[c.alias(n) for n, c in sums.items()], *[c.alias(n) for n, c in means.items()], mean("agreement_rate").alias("agreement_rate"))
    for m in ("coverage", "avg_conf"):
        llm, rag = F.col(f"{m}_llm"), F.col(f"{m}_rag")
        rows = rows.withColumn(f"{m}_winner", F.when(llm > rag, "llm").when(rag > llm, "rag").otherwise("tie"))
    return rows


def latest(snapshots: DataFrame, key: str = "submission_id", revision: str = "revision") -> DataFrame:
    """The highest revision of each submission."""
    names = [c for c in snapshots.columns if c != key]
    return snapshots.groupBy(key).agg(F.max_by(F.struct(*names), revision).alias("r")).select(key, "r.*")


def hash_history(metrics: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pdf_hash, found, submission_count, total_fields, submission_id): a row for each submission of each wanted hash.

    A hash without submissions has one row with a null id; nothing is gathered, however many submissions a hash has.
    """
    own = metrics.join(wanted.select("pdf_hash").distinct(), "pdf_hash", "left_semi").select("pdf_hash", "submission_id", "total_fields")
    sums = own.groupBy("pdf_hash").agg(F.count(F.lit(1)).alias("n"), F.sum("total_fields").alias("fields"))
    rows = wanted.join(sums, "pdf_hash", "left").join(own.drop("total_fields"), "pdf_hash", "left")
    return rows.select("pdf_hash", F.col("n").isNotNull().alias("found"), F.coalesce("n", F.lit(0)).alias("submission_count"), F.coalesce("fields", F.lit(0)).alias("total_fields"), "submission_id")


def system_rollup(submissions: DataFrame) -> DataFrame:
    """Submissions and distinct hashes and users by category path, with subtotals at every level."""
    return submissions.rollup("category", "sub_category", "document_type").agg(F.count(F.lit(1)).alias("submissions"), F.count_distinct("pdf_hash").alias("hashes"), F.count_distinct("user_id").alias("users"))


def vector_counts(vectors: DataFrame) -> DataFrame:
    """Vectors and distinct names by where the vector came from; a null source counts as unknown."""
    return vectors.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("field_name").alias("names"))


def validate_by_type(compared: DataFrame) -> DataFrame:
    """Coverage, accuracy and precision in percent by widget type, and over all as type ALL."""
    percent = lambda a, b: F.when(b == 0, 0.0).otherwise(half_up(100.0 * a / b, 2))
    sums = compared.rollup("widget_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("embedded").isNotNull()).alias("mapped"), F.count_if(F.col("embedded") == F.col("truth")).alias("right"))
    total, mapped, right = F.col("total"), F.col("mapped"), F.col("right")
    return sums.select(F.coalesce("widget_type", F.lit("ALL")).alias("widget_type"), total, mapped, right.alias("correct"), percent(mapped, total).alias("coverage"), percent(right, total).alias("accuracy"), percent(right, mapped).alias("map_precision"))


def mapping_stats(finals: DataFrame, by: str, high: float = 0.8) -> DataFrame:
    """Fields, mapped, and mapped with high and low confidence, by type; a null key is not mapped."""
    mapped = F.col("selected_field_name").isNotNull()
    sure = mapped & (F.col("selected_conf") >= high)
    rows = finals.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(mapped).alias("mapped"), F.count_if(sure).alias("high"))
    return rows.withColumns({"low": F.col("mapped") - F.col("high"), "high_rate": ratio(F.col("high"), F.col("mapped")), "mapped_rate": ratio(F.col("mapped"), F.col("total"))})


def submission_frequency(submissions: DataFrame) -> DataFrame:
    """How often the same hash was seen up to each submission, and a composite id; repeats of a hash are duplicates.

    Submissions are numbered within a hash's months, and the months' counts are summed, so that a hash that very many share is
    numbered by many tasks.
    """
    month = F.date_trunc("month", F.col("ts"))
    local = submissions.withColumns({"_m": month, "_n": F.row_number().over(Window.partitionBy("pdf_hash", month).orderBy("ts", "submission_id"))})
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pdf_hash").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = submissions.groupBy("pdf_hash", month.alias("_m")).agg(F.count(F.lit(1)).alias("n")).select("pdf_hash", "_m", before.alias("_before"))
    rows = local.join(starts, (local.pdf_hash == starts.pdf_hash) & local._m.eqNullSafe(starts._m)).drop(starts.pdf_hash).drop(starts._m)
    rows = rows.withColumn("frequency", (F.col("_n") + F.col("_before")).cast("int")).drop("_m", "_n", "_before")
    return rows.withColumns({"is_duplicate": F.col("frequency") > 1, "composite_id": F.concat_ws("_", F.col("user_id").cast("string"), "pdf_hash", F.col("frequency").cast("string"))})


def metric_series(metrics: DataFrame) -> DataFrame:
    """Every snapshot fanned out to its five levels: (level, identifier, ts, submission_id, ..)."""
    entries = [F.struct(F.lit(name).alias("level"), F.concat_ws("/", *cols).alias("identifier") if cols else F.lit("global").alias("identifier")) for name, cols in LEVELS]
    return metrics.withColumn("_e", F.explode(F.array(*entries))).select("_e.level", "_e.identifier", "ts", "submission_id", "total_fields", "coverage_ensemble")


def series_summary(series: DataFrame) -> DataFrame:
    """First, last and number of entries of each series; a sum per level, so the global one makes no large group."""
    return series.groupBy("level", "identifier").agg(F.count(F.lit(1)).alias("entries"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("total_fields").alias("fields"))


def error_breakdown(errors: DataFrame, since: str | None = None, until: str | None = None, categories: list[str] | None = None) -> DataFrame:
    """Counts over single dimensions in one pass: (dimension, value, errors). Null values stand as 'unknown'.

    at is the error's time as text; rows from ``since`` on and before ``until`` count, and rows whose time can't be read. The days are
    those of readable times.
    """
    at = F.try_to_timestamp("at")
    rows = errors
    for limit, inside in ((since, lambda x: at >= x), (until, lambda x: at < x)):
        if limit is not None:
            rows = rows.filter(F.coalesce(inside(F.lit(limit).cast("timestamp")), F.lit(True)))
    if categories is not None:
        rows = rows.filter(F.col("category").isin(categories))
    rows = rows.withColumn("day", F.date_format(at, "yyyy-MM-dd"))
    dims = ("category", "path", "doc_path", "day", "error_type", "case_type")
    sets = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dims])).alias("e"))
    return sets.groupBy("e.dimension", "e.value").agg(F.count(F.lit(1)).alias("errors"))
