"""Queries on submissions: ensemble, cases, metrics, reports, feedback and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlode.functions.rounding import half_up
from formlode.operators import ensemble as en
from formlode.operators import learning as le
from formlode.operators import metrics as me
from formlode.shared import written

from .registry import a4, query, r4, rat
from .adapters import ENS, SUB, submissions, table

W = f"WITH {SUB}, {ENS} "


def finals(spark: SparkSession, sf: str) -> DataFrame:
    return en.classify_cases(en.select_ensemble(submissions(spark, sf)))


def sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = submissions(spark, sf)
    return tuple(rows.filter(F.col(f"{s}_name").isNotNull()).select("submission_id", "field_id", F.col(f"{s}_name").alias("name"), F.col(f"{s}_conf").alias("conf")) for s in ("rag", "llm"))


@query("field_id_union", W + "SELECT DISTINCT submission_id, field_id FROM sub WHERE rag_name IS NOT NULL OR llm_name IS NOT NULL")
def field_id_union(spark, sf):
    return en.field_ids(*sources(spark, sf))


@query("ensemble_select", W + "SELECT submission_id, field_id, selected_field_name, selected_from, reason, selected_conf FROM fin WHERE rag_name IS NOT NULL OR llm_name IS NOT NULL")
def ensemble_select(spark, sf):
    return en.select_ensemble(en.paired(*sources(spark, sf))).select("submission_id", "field_id", "selected_field_name", "selected_from", "reason", "selected_conf")


@query("case_classify", W + "SELECT submission_id, field_id, case_type FROM fin")
def case_classify(spark, sf):
    return finals(spark, sf).select("submission_id", "field_id", "case_type")


@query("context_lookup", W + "SELECT f.submission_id, f.field_id, p_name AS context FROM fin f JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk FROM lineitem GROUP BY ALL) ON l_orderkey = submission_id AND l_linenumber = field_id JOIN part ON p_partkey = pk WHERE case_type = 'C' AND p_size > 10")
def context_lookup(spark, sf):
    parts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("submission_id"), F.col("l_linenumber").alias("field_id")).agg(F.min("l_partkey").alias("p_partkey"))
    contexts = parts.join(table(spark, sf, "part").filter("p_size > 10"), "p_partkey").select("submission_id", "field_id", F.col("p_name").alias("context"))
    wanted = finals(spark, sf).filter("case_type = 'C'").select("submission_id", "field_id")
    return en.context_lookup(wanted, contexts)


@query("prediction_summary", W + f"SELECT submission_id, count(*) AS total, count(rag_name) AS matched, count(*) - count(rag_name) AS unmatched, coalesce({a4('rag_conf')}, 0.0::DOUBLE) AS avg_confidence FROM sub GROUP BY submission_id")
def prediction_summary(spark, sf):
    return en.prediction_summary(submissions(spark, sf))


_CASES = ", ".join(f"count(*) FILTER (case_type = '{c}') AS n_{c.lower()}, coalesce(array_to_string(list_sort(list(field_id) FILTER (case_type = '{c}')), ','), '') AS fields_{c.lower()}" for c in "ABCDE")


@query("case_distribution", W + f"SELECT submission_id, {_CASES}, count(*) FILTER (case_type = 'B' AND selected_from = 'rag') AS b_rag, count(*) FILTER (case_type = 'B' AND selected_from = 'llm') AS b_llm FROM fin GROUP BY submission_id")
def case_distribution(spark, sf):
    return en.case_distribution(finals(spark, sf))


_RAW = f"""met0 AS (SELECT submission_id, user_id, pdf_hash, category, sub_category, document_type, min(ts) AS ts, count(*) AS total_fields,
    count(llm_name) AS predicted_llm, count(rag_name) AS predicted_rag, count(selected_field_name) AS predicted_ensemble,
    {', '.join(f"count(*) FILTER (case_type = '{c}') AS case_{c.lower()}" for c in 'ABCDE')},
    coalesce({a4('llm_conf')}, 0) AS avg_conf_llm, coalesce({a4('rag_conf')}, 0) AS avg_conf_rag, coalesce({a4('selected_conf')}, 0) AS avg_conf_ensemble,
    {rat(r4('coalesce(sum(rag_margin), 0.0::DOUBLE)', 6), 'count(rag_name) + count(llm_name)')} AS margin_avg,
    {rat('count(*) FILTER (rag_name IS NOT NULL AND rag_margin < 0.1::DOUBLE) + count(llm_name)', 'count(rag_name) + count(llm_name)')} AS ambiguity_rate
    FROM (SELECT *, {r4('rag_conf - 0.5::DOUBLE')} AS rag_margin FROM fin) GROUP BY ALL), met AS (SELECT *,
    {', '.join(f"{rat(f'predicted_{s}', 'total_fields')} AS coverage_{s}" for s in ('llm', 'rag', 'ensemble'))},
    {rat('case_a', 'case_a + case_b')} AS agreement_rate, {rat('case_b', 'case_a + case_b')} AS conflict_rate,
    {rat('case_d', 'total_fields - predicted_llm')} AS rag_recovery, {rat('case_c', 'total_fields - predicted_rag')} AS llm_recovery,
    {', '.join(f"{rat(f'case_{c}', 'total_fields')} AS share_{c}" for c in 'abcde')} FROM met0)"""
M = f"WITH {SUB}, {ENS}, {_RAW} "


def metrics(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    rows = finals(spark, sf) if rows is None else rows
    return me.submission_metrics(rows.withColumn("rag_margin", half_up(F.col("rag_conf") - 0.5)))


@query("submission_metrics", M + "SELECT * FROM met")
def submission_metrics(spark, sf):
    return metrics(spark, sf)


# Feedback: fields 1 and 4 of submissions divisible by 5 were wrong; the error names what was selected.
_FB = "fb AS (SELECT submission_id, submission_id * 10 + field_id AS error_id, selected_field_name AS field_name, CASE WHEN field_id = 1 THEN 'wrong' ELSE 'missing' END AS error_type, ts FROM fin WHERE submission_id % 5 = 0 AND field_id IN (1, 4) AND selected_field_name IS NOT NULL)"


def feedback(rows: DataFrame) -> DataFrame:
    chosen = rows.filter("submission_id % 5 = 0 AND field_id IN (1, 4) AND selected_field_name IS NOT NULL")
    kind = F.when(F.col("field_id") == 1, "wrong").otherwise("missing").alias("error_type")
    return chosen.select("submission_id", (F.col("submission_id") * 10 + F.col("field_id")).alias("error_id"), F.col("selected_field_name").alias("field_name"), kind, "ts")


def _acc(s: str) -> str:
    v = f"(predicted_{s} - errors_{s})::DOUBLE / predicted_{s}::DOUBLE"
    return f"CASE WHEN predicted_{s} = 0 THEN 0.0::DOUBLE WHEN {v} < 0 THEN -({r4(f'-({v})')}) ELSE {r4(v)} END AS accuracy_{s}"


_ERR = f"""err AS (SELECT fb.submission_id, count(*) FILTER (selected_from = 'llm') AS errors_llm, count(*) FILTER (selected_from = 'rag') AS errors_rag
    FROM fb JOIN fin ON fb.submission_id = fin.submission_id AND fb.field_name = fin.selected_field_name GROUP BY ALL),
  tot AS (SELECT submission_id, count(*) AS errors_ensemble FROM fb GROUP BY ALL),
  acc AS (SELECT *, {', '.join(map(_acc, ('llm', 'rag', 'ensemble')))} FROM (SELECT met.*, coalesce(errors_llm, 0) AS errors_llm, coalesce(errors_rag, 0) AS errors_rag, coalesce(errors_ensemble, 0) AS errors_ensemble
    FROM met LEFT JOIN err USING (submission_id) LEFT JOIN tot USING (submission_id)))"""
A = f"WITH {SUB}, {ENS}, {_RAW}, {_FB}, {_ERR} "
_ACC = [f"{k}_{s}" for k in ("errors", "accuracy") for s in ("llm", "rag", "ensemble")]


def corrected(spark: SparkSession, sf: str) -> DataFrame:
    # The joined base serves metrics, finals and feedback: stored, it is joined once.
    rows = written(finals(spark, sf), "finals")
    return me.accuracy_after_errors(metrics(spark, sf, rows), rows, feedback(rows))


@query("accuracy_after_errors", A + f"SELECT submission_id, {', '.join(_ACC)} FROM acc")
def accuracy_after_errors(spark, sf):
    return corrected(spark, sf).select("submission_id", *_ACC)


def _report(*by):
    return A + f"SELECT {', '.join(by)}, count(*) AS submissions, CAST(sum(errors_ensemble) AS BIGINT) AS errors, {a4('accuracy_ensemble')} AS avg_accuracy, {a4('coverage_ensemble')} AS avg_coverage, min(ts) AS first_ts, max(ts) AS last_ts FROM acc GROUP BY ALL"


@query("category_report", _report("category"))
def category_report(spark, sf):
    return me.level_report(corrected(spark, sf), "category")


@query("subcategory_report", _report("category", "sub_category"))
def subcategory_report(spark, sf):
    return me.level_report(corrected(spark, sf), "category", "sub_category")


@query("doctype_report", _report("category", "sub_category", "document_type"))
def doctype_report(spark, sf):
    return me.level_report(corrected(spark, sf), "category", "sub_category", "document_type")


@query("global_comparison", M + f""", g AS (SELECT count(*) AS submissions, CAST(sum(total_fields) AS BIGINT) AS total_fields, {', '.join(f'CAST(sum(predicted_{s}) AS BIGINT) AS predicted_{s}' for s in ('llm', 'rag', 'ensemble'))},
    {', '.join(f'{a4(f"{m}_{s}")} AS {m}_{s}' for m in ('coverage', 'avg_conf') for s in ('llm', 'rag'))}, {a4('agreement_rate')} AS agreement_rate FROM met)
    SELECT *, {', '.join(f"CASE WHEN {m}_llm > {m}_rag THEN 'llm' WHEN {m}_rag > {m}_llm THEN 'rag' ELSE 'tie' END AS {m}_winner" for m in ('coverage', 'avg_conf'))} FROM g""")
def global_comparison(spark, sf):
    return me.global_comparison(metrics(spark, sf))


@query("compare_submissions", A + "SELECT submission_id, coverage_ensemble, CASE WHEN errors_ensemble > 0 THEN accuracy_ensemble ELSE 1.0::DOUBLE END AS accuracy_ensemble, CASE WHEN errors_ensemble > 0 THEN 1 ELSE 0 END AS revision FROM acc")
def compare_submissions(spark, sf):
    names = ["submission_id", "coverage_ensemble", "accuracy_ensemble"]
    after = corrected(spark, sf)
    first = after.select("submission_id", "coverage_ensemble", F.lit(1.0).alias("accuracy_ensemble"), F.lit(0).alias("revision"))
    later = after.filter("errors_ensemble > 0").select(*names, F.lit(1).alias("revision"))
    chosen = first.unionByName(later)
    return me.latest(chosen).select(*names, "revision")


@query("hash_history", M + "SELECT w.pdf_hash, m.n IS NOT NULL AS found, coalesce(m.n, 0) AS submission_count, coalesce(m.f, 0) AS total_fields, met.submission_id FROM (SELECT 'h' || (range * 5) AS pdf_hash FROM range(25)) w LEFT JOIN (SELECT pdf_hash, count(*) AS n, CAST(sum(total_fields) AS BIGINT) AS f FROM met GROUP BY ALL) m USING (pdf_hash) LEFT JOIN met ON met.pdf_hash = w.pdf_hash")
def hash_history(spark, sf):
    return me.hash_history(metrics(spark, sf), spark.range(25).select(F.concat(F.lit("h"), F.col("id") * 5).alias("pdf_hash")))


_ONE = "one AS (SELECT submission_id, user_id, pdf_hash, category, sub_category, document_type, min(ts) AS ts FROM sub GROUP BY ALL)"


def one_each(spark: SparkSession, sf: str) -> DataFrame:
    return submissions(spark, sf).groupBy("submission_id", "user_id", "pdf_hash", "category", "sub_category", "document_type").agg(F.min("ts").alias("ts"))


@query("system_rollup", f"WITH {SUB}, {_ONE} SELECT category, sub_category, document_type, count(*) AS submissions, count(DISTINCT pdf_hash) AS hashes, count(DISTINCT user_id) AS users FROM one GROUP BY ROLLUP (category, sub_category, document_type)")
def system_rollup(spark, sf):
    return me.system_rollup(one_each(spark, sf))


@query("vector_counts", "SELECT source, count(*) AS vectors, count(DISTINCT field_name) AS names FROM (SELECT CASE vec_id % 3 WHEN 0 THEN 'initial' WHEN 1 THEN 'learned' ELSE 'unknown' END AS source, label AS field_name FROM embeddings) GROUP BY ALL")
def vector_counts(spark, sf):
    source = F.when(F.col("vec_id") % 3 == 0, "initial").when(F.col("vec_id") % 3 == 1, "learned").alias("source")
    return me.vector_counts(table(spark, sf, "embeddings").select(source, F.col("label").alias("field_name")))


@query("submission_frequency", f"WITH {SUB}, {_ONE}, f AS (SELECT submission_id, pdf_hash, user_id, CAST(row_number() OVER (PARTITION BY pdf_hash ORDER BY ts, submission_id) AS INTEGER) AS frequency FROM one) SELECT submission_id, frequency, frequency > 1 AS is_duplicate, user_id || '_' || pdf_hash || '_' || frequency AS composite_id FROM f")
def submission_frequency(spark, sf):
    return me.submission_frequency(one_each(spark, sf)).select("submission_id", "frequency", "is_duplicate", "composite_id")


_E = f"WITH {SUB}, {ENS}, {_FB}, e AS (SELECT category, category || '/' || sub_category AS path, category || '/' || sub_category || '/' || document_type AS doc_path, CASE WHEN fin.submission_id % 7 <> 0 THEN strftime(fin.ts, '%Y-%m-%d') END AS day, error_type, case_type FROM fb JOIN fin ON fb.submission_id = fin.submission_id AND fb.error_id = fin.submission_id * 10 + fin.field_id WHERE (fin.submission_id % 7 = 0 OR fin.ts >= TIMESTAMP '1994-01-01' AND fin.ts < TIMESTAMP '1997-01-01') AND category IN ('ASIA', 'EUROPE')) "


@query("error_breakdown", _E + " UNION ALL ".join(f"SELECT '{d}' AS dimension, coalesce({d}, 'unknown') AS value, count(*) AS errors FROM e GROUP BY ALL" for d in ("category", "path", "doc_path", "day", "error_type", "case_type")))
def error_breakdown(spark, sf):
    rows = finals(spark, sf)
    named = rows.withColumn("error_id", F.col("submission_id") * 10 + F.col("field_id")).drop("ts")
    joined = feedback(rows).join(named, ["submission_id", "error_id"])
    at = F.when(F.col("submission_id") % 7 == 0, "not known").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    paths = {"at": at, "path": F.concat_ws("/", "category", "sub_category"), "doc_path": F.concat_ws("/", "category", "sub_category", "document_type")}
    return me.error_breakdown(joined.withColumns(paths), "1994-01-01", "1997-01-01", ["ASIA", "EUROPE"])


@query("truth_compare", W + "SELECT submission_id, field_id, truth, selected_field_name AS embedded, CASE WHEN selected_field_name IS NULL THEN 'unmapped' WHEN selected_field_name = truth THEN 'match' ELSE 'mismatch' END AS outcome FROM (SELECT *, 'f' || (submission_id % 3) AS truth FROM fin) WHERE submission_id % 11 <> 0")
def truth_compare(spark, sf):
    rows = finals(spark, sf)
    truth = rows.select("submission_id", "field_id", F.when(F.col("submission_id") % 11 == 0, "unknown_field").otherwise(F.concat(F.lit("form.f"), F.col("submission_id") % 3)).alias("name"))
    known = truth.filter(~F.col("name").contains("unknown")).withColumn("truth", F.element_at(F.split("name", r"\."), -1))
    both = known.join(rows.select("submission_id", "field_id", F.col("selected_field_name").alias("embedded")), ["submission_id", "field_id"], "left")
    outcome = F.when(F.col("embedded").isNull(), "unmapped").when(F.col("embedded") == F.col("truth"), "match").otherwise("mismatch")
    return both.select("submission_id", "field_id", "truth", "embedded", outcome.alias("outcome"))


_P = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE {r4(f'100.0::DOUBLE * {a} / {b}', 2)} END"


@query("validate_by_type", W + f", v AS (SELECT CASE field_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' ELSE 'radio' END AS widget_type, selected_field_name AS embedded, 'f' || (submission_id % 3) AS truth FROM fin), s AS (SELECT coalesce(widget_type, 'ALL') AS widget_type, count(*) AS total, count(embedded) AS mapped, count(*) FILTER (embedded = truth) AS correct FROM v GROUP BY ROLLUP (widget_type)) SELECT *, {_P('mapped', 'total')} AS coverage, {_P('correct', 'total')} AS accuracy, {_P('correct', 'mapped')} AS map_precision FROM s")
def validate_by_type(spark, sf):
    kind = F.when(F.col("field_id") % 3 == 0, "text").when(F.col("field_id") % 3 == 1, "checkbox").otherwise("radio")
    return me.validate_by_type(finals(spark, sf).select(kind.alias("widget_type"), F.col("selected_field_name").alias("embedded"), F.concat(F.lit("f"), F.col("submission_id") % 3).alias("truth")))


@query("mapping_stats", W + f", s AS (SELECT document_type, count(*) AS total, count(selected_field_name) AS mapped, count(*) FILTER (selected_field_name IS NOT NULL AND selected_conf >= 0.8::DOUBLE) AS high FROM fin GROUP BY ALL) SELECT *, mapped - high AS low, {rat('high', 'mapped')} AS high_rate, {rat('mapped', 'total')} AS mapped_rate FROM s")
def mapping_stats(spark, sf):
    return me.mapping_stats(finals(spark, sf), "document_type")


@query("column_key_dedupe", W + ", c AS (SELECT submission_id AS doc_id, field_id % 2 AS column_id, field_id AS row_id, rag_name AS key, rag_conf AS conf, row_number() OVER (PARTITION BY submission_id, field_id % 2, rag_name ORDER BY field_id) AS n FROM sub) SELECT doc_id, column_id, row_id, CASE WHEN n = 1 THEN key END AS key, CASE WHEN n = 1 AND key IS NOT NULL THEN conf END AS conf FROM c")
def column_key_dedupe(spark, sf):
    cells = submissions(spark, sf).select(F.col("submission_id").alias("doc_id"), F.lit(0).alias("table_id"), (F.col("field_id") % 2).alias("column_id"), F.col("field_id").alias("row_id"), F.col("rag_name").alias("key"), F.col("rag_conf").alias("conf"))
    return en.column_key_dedupe(cells).drop("table_id")


_ACT = "act AS (SELECT *, CASE WHEN case_type IN ('A', 'D') OR (case_type = 'B' AND selected_from = 'rag') THEN 'boost' WHEN case_type = 'C' OR case_type = 'B' THEN 'create' ELSE 'none' END AS action FROM fin) "


@query("vector_actions", f"WITH {SUB}, {ENS}, {_ACT} SELECT submission_id, field_id, case_type, action, CASE WHEN action = 'create' THEN selected_field_name END AS new_name, CASE WHEN action = 'create' THEN 0.75::DOUBLE END AS confidence, CASE WHEN action = 'create' THEN 1 END AS positive_count FROM act")
def vector_actions(spark, sf):
    return en.vector_actions(finals(spark, sf)).select("submission_id", "field_id", "case_type", "action", "new_name", "confidence", "positive_count")


@query("vector_action_summary", f"WITH {SUB}, {ENS}, {_ACT} SELECT case_type, action, count(*) AS n FROM act GROUP BY ALL")
def vector_action_summary(spark, sf):
    return en.action_summary(en.vector_actions(finals(spark, sf)))


@query("route_errors", f"WITH {SUB}, {ENS}, {_FB}, first AS (SELECT *, row_number() OVER (PARTITION BY submission_id, selected_field_name ORDER BY field_id) AS n FROM fin WHERE selected_field_name IS NOT NULL) SELECT error_id, fb.submission_id, fb.field_name, field_id, case_type, CASE WHEN case_type IN ('A', 'D') OR (case_type = 'B' AND selected_from = 'rag') THEN 'vec_' || rag_name || '_' || (field_id % 4) WHEN case_type IN ('B', 'C') THEN 'vec_' || fb.field_name || '_0' END AS vector_id FROM fb JOIN first ON fb.submission_id = first.submission_id AND fb.field_name = first.selected_field_name AND n = 1")
def route_errors(spark, sf):
    rows = written(finals(spark, sf), "finals").withColumn("rag_vector_id", F.concat(F.lit("vec_"), "rag_name", F.lit("_"), F.col("field_id") % 4))
    vectors = rows.filter("rag_vector_id IS NOT NULL").select(F.col("rag_vector_id").alias("vector_id"), F.col("rag_name").alias("field_name")).distinct()
    return en.route_errors(feedback(rows).select("error_id", "submission_id", "field_name"), rows, vectors)


_STEP = "CASE WHEN e.positive THEN floor(least(c * 1.05::DOUBLE, 0.99::DOUBLE) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE ELSE floor(greatest(c * 0.95::DOUBLE, 0.5::DOUBLE) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE END"
# A recursive walk over each vector's numbered events.
_FOLD = f"""WITH RECURSIVE ev AS (SELECT user_id AS vector_id, event_type <> 'error' AS positive, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS n FROM events),
  walk AS (SELECT DISTINCT vector_id, 0::BIGINT AS n, 0.75::DOUBLE AS c FROM ev UNION ALL SELECT e.vector_id, e.n, {_STEP.replace(' c ', ' w.c ').replace('(c ', '(w.c ')} FROM walk w JOIN ev e ON e.vector_id = w.vector_id AND e.n = w.n + 1) """


def learning_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("vector_id"), "ts", "event_id", (F.col("event_type") != "error").alias("positive"))


@query("confidence_fold", _FOLD + "SELECT vector_id, arg_max(c, n) AS confidence, CAST(max(n) AS INTEGER) AS steps FROM walk GROUP BY vector_id")
def confidence_fold(spark, sf):
    return le.confidence_fold(learning_events(spark, sf)).select("vector_id", "confidence", "steps")


@query("vector_stability", _FOLD + f", k AS (SELECT vector_id, count(*) FILTER (positive) AS positive_count, count(*) FILTER (NOT positive) AS negative_count FROM ev GROUP BY ALL) SELECT k.*, {r4('positive_count / (positive_count + negative_count)::DOUBLE')} AS stability, avg_confidence FROM k JOIN (SELECT vector_id, {r4('sum(c ORDER BY n) / count(*)')} AS avg_confidence FROM walk GROUP BY vector_id) USING (vector_id)")
def vector_stability(spark, sf):
    return le.vector_stability(learning_events(spark, sf))


@query("next_vector_ids", "SELECT p_partkey, 'vec_' || lpad(((SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY p_partkey))::VARCHAR, 6, '0') AS vector_id FROM part")
def next_vector_ids(spark, sf):
    existing = table(spark, sf, "embeddings").select(F.concat(F.lit("vec_"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("vector_id"))
    return le.next_vector_ids(existing, table(spark, sf, "part").select("p_partkey"), "p_partkey", F.floor(F.col("p_partkey") / 1000))


@query("metric_series", M + ", s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS level, {i} AS identifier, ts, total_fields FROM met" for n, i in (("hash", "pdf_hash"), ("category", "category"), ("subcategory", "category || '/' || sub_category"), ("doctype", "category || '/' || sub_category || '/' || document_type"), ("global", "'global'"))) + ") SELECT level, identifier, count(*) AS entries, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(total_fields) AS BIGINT) AS fields FROM s GROUP BY ALL")
def metric_series(spark, sf):
    return me.series_summary(me.metric_series(metrics(spark, sf)))
