"""Queries on form values, telemetry, sources and extension hooks."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formlode.functions import text as tx
from formlode.functions.rounding import half_up
from formlode.operators import layout as la
from formlode.operators import learning as le
from formlode.operators import values as va
from formlode.operators.hooks import hooked
from formlode.shared import scratch, written
from formlode.sources import files
from formlode.sources.results import read_batch, read_results, write_partitioned, write_results
from formlode.streaming import ingest, live
from formlode.streaming import telemetry as te

from .adapters import table
from .core import _FOLD, W, finals
from .layout import _ELT, _FP, fingerprints
from .registry import ORACLES, a4, query, r4, rat

_FV = "WITH fv AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS session_id, 'section_' || (user_id % 3) || '.' || event_type AS key, event_type, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS value, ts FROM events) "
_FILLED = "coalesce(value, '') <> ''"


def form_values(spark, sf):
    value = F.when(F.col("event_id") % 11 == 0, "").when(F.col("event_id") % 13 != 0, F.get_json_object("props", "$.k"))
    key = F.concat(F.lit("section_"), F.col("user_id") % 3, F.lit("."), "event_type")
    return table(spark, sf, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("session_id"), key.alias("key"), "event_type", value.alias("value"), "ts")


def last_values(spark, sf):
    return va.merge_last(form_values(spark, sf))


_LAST = f", last AS (SELECT user_id, key, arg_max(value, (ts, event_id)) AS value FROM fv WHERE {_FILLED} GROUP BY ALL) "


@query("merge_last", _FV + _LAST + "SELECT user_id, key, value FROM last")
def merge_last(spark, sf):
    return last_values(spark, sf)


_FIRST = ", one AS (SELECT user_id, key, arg_min(CASE WHEN value IS NULL THEN 'null' ELSE 'v' || value END, (ts, event_id)) AS v FROM fv GROUP BY ALL), prof AS (SELECT user_id, key, CASE WHEN v <> 'null' THEN substr(v, 2) END AS value FROM one WHERE user_id % 2 = 0) "


@query("merge_first", _FV + _LAST + _FIRST + "SELECT coalesce(p.user_id, l.user_id) AS user_id, coalesce(p.key, l.key) AS key, CASE WHEN p.user_id IS NOT NULL THEN p.value ELSE l.value END AS value FROM prof p FULL JOIN last l ON p.user_id = l.user_id AND p.key = l.key")
def merge_first(spark, sf):
    rows = form_values(spark, sf).filter("user_id % 2 = 0")
    profile = rows.groupBy("user_id", "key").agg(F.min_by(F.struct("value"), F.struct("ts", "event_id")).alias("s")).select("user_id", "key", F.col("s.value").alias("value"))
    return va.merge_first(profile, last_values(spark, sf))


@query("deep_update", _FV + _LAST + ", u AS (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'section_' || (user_id % 3) ELSE 'section_' || (user_id % 3) || '.click.deep' END AS key, 'new' AS value FROM last) SELECT user_id, key, value FROM u UNION ALL SELECT l.user_id, l.key, l.value FROM last l WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = l.user_id AND (u.key = l.key OR starts_with(l.key, u.key || '.') OR starts_with(u.key, l.key || '.')))")
def deep_update(spark, sf):
    base = last_values(spark, sf)
    section = F.concat(F.lit("section_"), F.col("user_id") % 3)
    updates = base.select("user_id").distinct().select("user_id", F.when(F.col("user_id") % 2 == 0, section).otherwise(F.concat(section, F.lit(".click.deep"))).alias("key"), F.lit("new").alias("value"))
    return va.deep_update(base, updates)


_GC = ", g AS (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'reg.' || event_type ELSE 'x.' || event_type END AS key, arg_max(value, (ts, event_id)) AS value FROM fv WHERE value IS NOT NULL AND value <> '' GROUP BY ALL), m AS (SELECT * FROM g UNION ALL SELECT DISTINCT user_id, 'mail.click' AS key, '' AS value FROM g WHERE user_id % 2 = 0) "


@query("group_copy", _FV + _GC + "SELECT m.user_id, m.key, CASE WHEN m.key LIKE 'mail.%' AND m.value = '' THEN coalesce(r.value, m.value) ELSE m.value END AS value FROM m LEFT JOIN m r ON r.user_id = m.user_id AND r.key = 'reg.' || substr(m.key, 6) AND m.key LIKE 'mail.%'")
def group_copy(spark, sf):
    named = F.concat(F.when(F.col("event_type").isin("click", "view"), "reg.").otherwise("x."), "event_type")
    rows = va.merge_last(form_values(spark, sf).withColumn("key", named))
    mail = rows.filter("user_id % 2 = 0").select("user_id", F.lit("mail.click").alias("key"), F.lit("").alias("value")).distinct()
    return va.group_copy(rows.unionByName(mail), "reg.", "mail.")


def key_schema(spark):
    return spark.createDataFrame([("click", True), ("view", True), ("signup", False), ("purchase", True), ("fax", False)], "key string, mandatory boolean")


_SCHEMA = "sch(key, mandatory) AS (VALUES ('click', true), ('view', true), ('signup', false), ('purchase', true), ('fax', false))"


def plain(spark, sf):
    return form_values(spark, sf).withColumn("key", F.col("event_type"))


_WANTED = [("click", True, "boolean", "actions"), ("view", True, "text", "actions"), ("signup", False, "checkbox", "account"), ("purchase", True, "text", "account"), ("fax", False, "text", "account")]


@query("missing_keys", _FV + f", w(key, mandatory, type, section) AS (VALUES {', '.join(map(str, _WANTED))}), m AS (SELECT user_id, w.* FROM (SELECT DISTINCT user_id FROM fv) u, w WHERE NOT EXISTS (SELECT 1 FROM fv WHERE fv.user_id = u.user_id AND event_type = w.key AND {_FILLED} AND fv.event_id % 3 = 0)) SELECT user_id, key, mandatory, CASE WHEN type IN ('boolean', 'checkbox') THEN 'boolean' ELSE 'text' END AS kind, CASE WHEN row_number() OVER (PARTITION BY user_id, mandatory, section ORDER BY key) = 1 THEN section END AS label FROM m")
def missing_keys(spark, sf):
    rows = plain(spark, sf).withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return va.missing_keys(rows, spark.createDataFrame(_WANTED, "key string, mandatory boolean, type string, section string"))


_RATE = lambda a, b: f"floor(100.0::DOUBLE * {a} / {b} * 10 + 0.5::DOUBLE) / 10.0::DOUBLE"


@query("fill_report", _FV + f""", {_SCHEMA}, e AS (SELECT user_id, session_id, sch.key, mandatory, EXISTS (SELECT 1 FROM fv WHERE fv.user_id = s.user_id AND fv.session_id = s.session_id AND event_type = sch.key AND {_FILLED}) AS have FROM (SELECT DISTINCT user_id, session_id FROM fv) s, sch),
  t AS (SELECT user_id, session_id, count(*) AS total, count(*) FILTER (have) AS filled, count(*) FILTER (mandatory) AS mandatory, count(*) FILTER (have AND mandatory) AS mandatory_filled, count(*) FILTER (NOT mandatory) AS optional, count(*) FILTER (have AND NOT mandatory) AS optional_filled, coalesce(array_to_string(list_sort(list(key) FILTER (mandatory AND NOT have)), ','), '') AS missing, coalesce(array_to_string(list_sort(list(key) FILTER (NOT mandatory AND NOT have)), ','), '') AS missing_optional FROM e GROUP BY ALL)
  SELECT *, {_RATE('filled', 'total')} AS fill_rate, {_RATE('mandatory_filled', 'mandatory')} AS mandatory_rate, {_RATE('optional_filled', 'optional')} AS optional_rate FROM t""")
def fill_report(spark, sf):
    return va.fill_report(plain(spark, sf), key_schema(spark))


@query("missing_list", "WITH m AS (SELECT p_brand, list(p_partkey ORDER BY p_partkey) FILTER (p_size % 2 = 0) AS k FROM part GROUP BY ALL) SELECT p_brand, coalesce(array_to_string(k[1:20], ','), '') AS shown, CAST(greatest(0, coalesce(len(k), 0) - 20) AS INTEGER) AS more FROM m")
def missing_list(spark, sf):
    parts = table(spark, sf, "part").select("p_brand", "p_partkey", (F.col("p_size") % 2 == 0).alias("missing"))
    return va.shown_first(parts, "p_brand", "p_partkey", "missing")


@query("key_sets", _FV + f", {_SCHEMA} SELECT (SELECT count(*) FROM (SELECT key FROM sch INTERSECT SELECT event_type FROM fv WHERE {_FILLED})) AS filled, (SELECT count(*) FROM (SELECT key FROM sch WHERE mandatory EXCEPT SELECT event_type FROM fv WHERE {_FILLED})) AS missing, (SELECT count(*) FROM sch WHERE NOT mandatory) AS optional")
def key_sets(spark, sf):
    schema, have = key_schema(spark), plain(spark, sf).filter("coalesce(value, '') <> ''").select("key").distinct()
    must = schema.filter("mandatory").select("key")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    sets = count(schema.select("key").intersect(have), "filled").crossJoin(count(must.exceptAll(have), "missing"))
    return sets.crossJoin(count(schema.select("key").exceptAll(must), "optional"))  # one row each


@query("accept_answers", _FV + _LAST + ", a AS (SELECT user_id, key, arg_max(CASE WHEN event_id % 4 < 2 THEN 'again ' || event_id ELSE value END, (ts, event_id)) AS v FROM fv WHERE event_type IN ('click', 'view') AND (event_id % 4 < 2 OR value IS NOT NULL AND value <> '') GROUP BY ALL) SELECT coalesce(l.user_id, a.user_id) AS user_id, coalesce(l.key, a.key) AS key, coalesce(a.v, l.value) AS value FROM last l FULL JOIN a ON l.user_id = a.user_id AND l.key = a.key")
def accept_answers(spark, sf):
    rows = form_values(spark, sf)
    schema = rows.filter("event_type IN ('click', 'view')").select("key").distinct()
    answers = rows.withColumn("value", F.when(F.col("event_id") % 4 < 2, F.concat(F.lit("again "), "event_id")).otherwise(F.col("value")))
    return va.accepted(last_values(spark, sf), va.merge_last(answers), schema, tx.rule_errors)


@query("user_facing", "SELECT CASE event_id % 4 WHEN 2 THEN 'b.telephone' ELSE 'c.fax' END AS key, count(*) AS n FROM events WHERE event_id % 4 > 1 GROUP BY ALL")
def user_facing(spark, sf):
    names = F.element_at(F.array(*map(F.lit, ("a.telephone_part_1", "fax_part_2", "b.telephone", "c.fax"))), (F.col("event_id") % 4 + 1).cast("int"))
    return va.user_facing(table(spark, sf, "events").select(names.alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("field_labels", _FV + "SELECT DISTINCT key, CASE WHEN event_type = 'click' THEN 'Clicked' ELSE upper(left(event_type, 1)) || substr(event_type, 2) END AS label FROM fv")
def field_labels(spark, sf):
    rows = form_values(spark, sf)
    return va.field_labels(rows, rows.filter("event_type = 'click'").select("key").distinct().withColumn("label", F.lit("Clicked")), tx.field_label)


@query("fill_values", W + "SELECT submission_id, field_id, selected_field_name AS key, CASE field_id % 2 WHEN 0 THEN 'checkbox' ELSE 'text' END AS kind, CASE WHEN selected_field_name IS NULL THEN false WHEN field_id % 2 = 0 THEN selected_field_name = 'f1' ELSE selected_field_name <> 'f2' END AS filled FROM fin")
def fill_values(spark, sf):
    answers = spark.createDataFrame([("f0", "Ada"), ("f1", "yes"), ("f2", "no")], "key string, value string")
    kind = F.when(F.col("field_id") % 2 == 0, "checkbox").otherwise("text")
    rows = finals(spark, sf).select("submission_id", "field_id", F.col("selected_field_name").alias("key"), kind.alias("kind")).join(answers, "key", "left")
    return rows.select("submission_id", "field_id", "key", "kind", va.filled_state(F.col("kind"), F.col("value")).alias("filled"))


OPTIONS = ["economic", "smal", "medium size", "promotion", "standart"]


@query("fuzzy_resolve", "WITH o(i, o) AS (VALUES " + ", ".join(f"({i}, '{o}')" for i, o in enumerate(OPTIONS)) + "), t AS (SELECT DISTINCT p_type FROM part), s AS (SELECT p_type, o, i, floor(100.0::DOUBLE * (1 - levenshtein(lower(p_type), o) / greatest(length(p_type), length(o))::DOUBLE) * 100 + 0.5::DOUBLE) / 100 AS score FROM t, o), b AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, i) AS n FROM s) SELECT p_partkey, b.p_type, CASE WHEN score >= 70 THEN o END AS resolved, score FROM part JOIN b ON part.p_type = b.p_type AND n = 1")
def fuzzy_resolve(spark, sf):
    return va.fuzzy_resolve(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", OPTIONS)


@query("cache_lookup", _ELT + _FP + """, r AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN fingerprint ELSE 'old-' || fingerprint END AS fingerprint, 3 AS u, DATE '2024-01-05' AS last_used, 'old.json' AS mapping, CAST(NULL AS VARCHAR) AS schema_file FROM fp),
  w AS (SELECT fingerprint, DATE '2024-01-01' + CAST(doc_id % 10 AS INTEGER) AS day, CASE WHEN doc_id % 4 = 0 THEN 'm' || doc_id END AS mapping, CASE WHEN doc_id % 8 = 0 THEN 's' || doc_id END AS schema_file FROM fp),
  a AS (SELECT fingerprint, count(*) AS n, max(day) AS day, arg_max(mapping, (day, mapping)) FILTER (mapping IS NOT NULL) AS mapping, arg_max(schema_file, (day, schema_file)) FILTER (schema_file IS NOT NULL) AS schema_file FROM w GROUP BY ALL)
  SELECT coalesce(a.fingerprint, r.fingerprint) AS fingerprint, coalesce(u, 0) + coalesce(n, 0) AS usage_count, greatest(a.day, r.last_used) AS last_used, coalesce(a.mapping, r.mapping) AS mapping, coalesce(a.schema_file, r.schema_file) AS schema_file, CASE WHEN n IS NOT NULL THEN u IS NOT NULL END AS hit FROM a FULL JOIN r ON a.fingerprint = r.fingerprint""")
def cache_lookup(spark, sf):
    prints, name = fingerprints(spark, sf), F.col("doc_id").cast("string")
    old = {"usage_count": F.lit(3), "last_used": F.lit("2024-01-05").cast("date"), "mapping": F.lit("old.json"), "schema_file": F.lit(None).cast("string")}
    # A third of the documents is known, the other entries are of forms that nobody asks for.
    registry = prints.select(F.when(F.col("doc_id") % 3 == 0, F.col("fingerprint")).otherwise(F.concat(F.lit("old-"), "fingerprint")).alias("fingerprint")).distinct().withColumns(old)
    at = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 10).cast("int"))
    brought = {"at": at, "mapping": F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("m"), name)), "schema_file": F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("s"), name))}
    return va.cache_lookup(prints.withColumns(brought), registry, ["mapping", "schema_file"])


@query("llm_usage", f"WITH c AS (SELECT event_type AS model, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS tokens_in, CAST(sum(event_id % 100) AS BIGINT) AS tokens_out, CAST(sum(event_id % 7) AS BIGINT) AS fields FROM events GROUP BY ALL), d AS (SELECT *, tokens_in * 0.15::DOUBLE + tokens_out * 0.6::DOUBLE AS micros FROM c) SELECT model, calls, tokens_in, tokens_out, fields, {r4('micros / 1000000', 6)} AS cost_usd, {rat('tokens_in + tokens_out', 'calls')} AS tokens_per_call, {rat('micros', 'calls')} AS micros_per_call, {rat('micros', 'fields')} AS micros_per_field FROM d")
def llm_usage(spark, sf):
    calls = table(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("tokens_in"), (F.col("event_id") % 100).alias("tokens_out"), (F.col("event_id") % 7).alias("fields"))
    return va.llm_usage(calls, 0.15, 0.6)


@query("section_tree", "SELECT r_name AS h1, n_name AS h2, coalesce(string_agg(s_name, ',' ORDER BY s_name), '') AS h3 FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def section_tree(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    rows = table(spark, sf, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("h1"), F.col("n_name").alias("h2"), F.col("s_name").alias("h3"))
    tree = la.section_tree(rows)
    return tree.select("h1", F.explode("h2").alias("s")).select("h1", F.col("s.name").alias("h2"), F.array_join("s.h3", ",").alias("h3"))


_SES = "strftime(ts, '%Y-%m-%d')"


def sessions(spark, sf):
    return table(spark, sf, "events").withColumn("session_id", F.date_format("ts", "yyyy-MM-dd"))


@query("job_summary", f"SELECT user_id, {_SES} AS job, count(*) AS logs, count(*) FILTER (event_type = 'click') AS requests, count(*) FILTER (event_type = 'error') AS errors, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS seconds, count(*) FILTER (event_type = 'error') = 0 AS success FROM events GROUP BY ALL")
def job_summary(spark, sf):
    return te.job_summary(sessions(spark, sf).withColumnRenamed("session_id", "job"))


@query("user_sessions", f"SELECT user_id, count(*) AS n, array_to_string(list_sort(list(s)), ',') AS sessions FROM (SELECT DISTINCT user_id, {_SES} AS s FROM events WHERE NOT (user_id % 5 = 0 AND {_SES} = '2024-01-01')) GROUP BY ALL")
def user_sessions(spark, sf):
    rows = sessions(spark, sf).select("user_id", "session_id").distinct()
    deleted = rows.filter("user_id % 5 = 0 AND session_id = '2024-01-01'")
    own = rows.join(deleted, ["user_id", "session_id"], "left_anti").groupBy("user_id").agg(F.array_sort(F.collect_set("session_id")).alias("s"))
    return own.select("user_id", F.size("s").cast("long").alias("n"), F.array_join("s", ",").alias("sessions"))


@query("session_latest", f"SELECT user_id, {_SES} AS session_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS updated_at FROM events GROUP BY ALL")
def session_latest(spark, sf):
    return te.session_latest(sessions(spark, sf))


@query("telemetry_rollup", f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, {r4('sum(value)', 2)} AS total FROM events GROUP BY ALL")
def telemetry_rollup(spark, sf):
    return te.rollup(table(spark, sf, "events"), "1 hour").withColumn("total", half_up(F.col("total"), 2))


@query("method_latency", f"WITH c AS (SELECT event_type AS method, count(*) AS calls, {a4('value')} AS m, max(value) AS max_latency, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS extracted, CAST(sum(100) AS BIGINT) AS expected, floor(floor(sum(value) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE / count(value) * 100 + 0.5::DOUBLE) / 100 AS avg_latency FROM events GROUP BY ALL) SELECT method, calls, avg_latency, max_latency, extracted, expected, {r4(f"100 * ({rat('extracted', 'expected')})", 2)} AS yield_pct FROM c")
def method_latency(spark, sf):
    calls = table(spark, sf, "events").select(F.col("event_type").alias("method"), F.col("value").alias("latency"), F.get_json_object("props", "$.k").cast("int").alias("extracted"), F.lit(100).alias("expected"))
    return te.method_latency(calls)


@query("session_completion", f"WITH s AS (SELECT user_id, {_SES} AS session_id, min(ts) AS begun, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS done FROM events GROUP BY ALL), d AS (SELECT strftime(begun, '%Y-%m-%d') AS day, count(*) AS sessions, CAST(sum(done) AS BIGINT) AS completed FROM s GROUP BY ALL) SELECT *, {r4(f"100 * ({rat('completed', 'sessions')})", 2)} AS completion_pct FROM d")
def session_completion(spark, sf):
    return te.completion(sessions(spark, sf), "purchase")


@query("state_transitions", "SELECT from_state, to_state, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events) WHERE from_state IS NOT NULL GROUP BY ALL")
def state_transitions(spark, sf):
    return te.transitions(table(spark, sf, "events"))


@query("quota_violations", f"WITH e AS (SELECT *, 's' || (event_id % 5) AS sid, {_SES} AS day FROM events), q AS (SELECT event_id, count(*) OVER (PARTITION BY user_id, sid ORDER BY ts, event_id) AS m, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id, sid ORDER BY ts, event_id) AS c, sum(CASE WHEN f = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day, sid ORDER BY ts, event_id) AS f FROM e)) SELECT event_id, CASE WHEN m > 12 THEN 'messages' WHEN c > 2 THEN 'calls' WHEN s > 1 THEN 'sessions' END AS violated FROM q")
def quota_violations(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", F.concat(F.lit("s"), F.col("event_id") % 5).alias("session_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_type") == "click").alias("is_call"))
    return te.quota_violations(rows, 12, 1, 2).select("event_id", "violated")


@query("turn_history", "WITH t AS (SELECT conv_id, turn, role || ': ' || coalesce(text, '') AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, count(*) AS turns, string_agg(line, chr(10) ORDER BY turn) AS history FROM t WHERE n <= 4 GROUP BY ALL")
def turn_history(spark, sf):
    recent = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))) <= 4
    rows = table(spark, sf, "conversations").withColumn("_r", recent).filter("_r")
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(ordered, "\n").alias("history"))


@query("src_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def src_json(spark, sf):
    path = scratch(spark, "json")
    table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).write.json(path)
    absent = files.load_json(spark, path + "-absent", "event_id long, k int")
    return files.load_json(spark, path, "event_id long, k int").unionByName(absent)


@query("src_jsonl", "SELECT event_id, event_type FROM events")
def src_jsonl(spark, sf):
    path, rows = scratch(spark, "jsonl"), table(spark, sf, "events").select("event_id", "event_type")
    files.append_jsonl(rows.filter("event_id % 2 = 0"), path)
    files.append_jsonl(rows.filter("event_id % 2 = 1"), path)
    return files.load_jsonl(spark, path, "event_id long, event_type string")


_KINDS = ("txt", "md", "json", "csv", "xyz")


@query("src_corpus", """WITH d AS (SELECT doc_id, lang, ['txt', 'md', 'json', 'csv', 'xyz'][doc_id % 5 + 1] AS kind, coalesce(text, '') AS t FROM documents)
    SELECT 'in/' || doc_id || '.' || kind AS path, CASE kind WHEN 'txt' THEN trim(t, ' ' || chr(9) || chr(10) || chr(13)) WHEN 'md' THEN trim(t, ' ' || chr(9) || chr(10) || chr(13)) WHEN 'csv' THEN 'doc | lang' || chr(10) || doc_id || ' | a, "' || coalesce(lang, '') || '"'
    WHEN 'json' THEN '{' || chr(10) || '  "lang": "' || coalesce(lang, '') || '",' || chr(10) || '  "ids": [' || chr(10) || '    ' || doc_id || chr(10) || '  ]' || chr(10) || '}' END AS text, CASE WHEN kind = 'xyz' THEN 'unsupported: xyz' END AS error FROM d""")
def src_corpus(spark, sf):
    kind, lang = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 5 + 1).cast("int")), F.coalesce("lang", F.lit(""))
    listed = F.concat(F.lit("doc,lang\n\n"), "doc_id", F.lit(',"a, ""'), lang, F.lit('"""\n'))
    nested = F.concat(F.lit('{"lang":"'), lang, F.lit('","ids":['), "doc_id", F.lit("]}"))
    body = F.when(kind == "csv", listed).when(kind == "json", nested).otherwise(F.coalesce("text", F.lit("")))
    return files.corpus_text(table(spark, sf, "documents").select(F.concat(F.lit("in/"), "doc_id", F.lit("."), kind).alias("path"), body.alias("content")))


@query("html_text")
def html_text(spark, sf):
    return files.html_text(table(spark, sf, "pages"), "page_id", "html")


@query("xml_text", "SELECT p_partkey AS id, p_name || chr(10) || 'tail' || chr(10) || p_brand AS text FROM part")
def xml_text(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("<p><n>"), "p_name", F.lit("</n> tail <b>"), "p_brand", F.lit("</b></p>")).alias("x"))
    return files.xml_text(p, "p_partkey", "x")


#: A form configuration: the keys of each entity type, nested, and those of all others.
_FORMS = '{"BUILDING":{"name":"","permit":{"id":"","site":{"city":""}}},"default":{"name":"","email":""}}'


@query("schema_for_type", "WITH o AS (SELECT DISTINCT c_mktsegment AS entity_type FROM customer), d AS (SELECT unnest(['name', 'email']) AS key), s AS (SELECT 'BUILDING' AS entity_type, unnest(['name', 'permit.id', 'permit.site.city']) AS key) SELECT o.entity_type, s.key FROM o JOIN s USING (entity_type) UNION ALL SELECT o.entity_type, d.key FROM o, d WHERE o.entity_type <> 'BUILDING'")
def schema_for_type(spark, sf):
    types = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("entity_type")).distinct()
    return va.schema_for_type(types, spark.createDataFrame([(_FORMS,)], "config string"), "config")


@query("sink_partitioned", ORACLES["metric_series"].replace("SELECT level, identifier, count(*) AS entries, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(total_fields) AS BIGINT) AS fields FROM s GROUP BY ALL", "SELECT level, count(*) AS n FROM s GROUP BY ALL"))
def sink_partitioned(spark, sf):
    from formlode.operators.metrics import metric_series

    from .core import metrics

    path = scratch(spark, "series")
    kept = written(metrics(spark, sf).select("pdf_hash", "category", "sub_category", "document_type", "ts", "submission_id", "total_fields", "coverage_ensemble"), "metrics")
    series = metric_series(kept).withColumn("category", F.substring_index("identifier", "/", 1))
    write_partitioned(series, path, ["level", "category"], "submission_id")
    return spark.read.parquet(path).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("result_layout", W + "SELECT user_id, count(DISTINCT submission_id) AS forms, count(*) AS fields, count(*) FILTER (submission_id % 2 = 0) AS revised, max(selected_conf) FILTER (submission_id % 2 = 1) AS first_conf FROM fin GROUP BY user_id")
def result_layout(spark, sf):
    """Every form is saved once and half of them again, the second batch twice."""
    path = scratch(spark, "results")
    rows = finals(spark, sf).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("session_id"), F.col("submission_id").alias("pdf_id"), "field_id", "selected_conf")
    write_results(rows.withColumn("revised", F.lit(False)), path, 1)
    # What is saved again is read from where it lies, so that predictions are joined once and not for each batch.
    stored = read_batch(spark, path, 1)
    for _ in range(2):
        write_results(stored.filter("pdf_id % 2 = 0").withColumns({"revised": F.lit(True), "selected_conf": F.lit(None).cast("double")}), path, 2)
    return read_results(spark, path).groupBy("user_id").agg(F.count_distinct("pdf_id").alias("forms"), F.count(F.lit(1)).alias("fields"), F.count_if("revised").alias("revised"), F.max("selected_conf").alias("first_conf"))


@query("validate_csv", ORACLES["validate_by_type"])
def validate_csv(spark, sf):
    from .core import validate_by_type

    path, rows = scratch(spark, "csv"), validate_by_type(spark, sf)
    rows.coalesce(1).write.option("header", True).csv(path)  # a handful of rows, one for each widget type
    return spark.read.option("header", True).schema(rows.schema).csv(path)


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")


@query("telemetry_ingest", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def telemetry_ingest(spark, sf):
    path = scratch(spark, "ingest")
    running = te.envelope(event_stream(spark, sf)).writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_hash").alias("users"))


_TYPED_EVENTS = """WITH e AS (SELECT event_id, ts, user_id, event_id % 1500 AS document_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value,
    CASE WHEN event_id % 41 = 0 THEN 'heartbeat' WHEN event_type IN ('view', 'click') THEN 'extraction_result' WHEN event_type IN ('signup', 'purchase') THEN 'state_transition' ELSE 'session_complete' END AS of FROM events),
    r AS (SELECT *, CASE WHEN ts IS NULL THEN 'time' WHEN of = 'heartbeat' THEN 'type' WHEN event_id % 37 = 0 THEN 'json' WHEN k IS NULL OR value IS NULL OR event_id % 43 = 0 THEN 'field' END AS reason FROM e),
    d AS (SELECT doc_id AS document_id, min((source, lang)) AS c FROM documents GROUP BY doc_id),
    t AS (SELECT CASE WHEN reason IS NULL THEN of ELSE 'quarantine' END AS kind, reason, c[1] AS source, user_id, CASE WHEN reason IS NULL THEN k END AS k, CASE WHEN reason IS NULL THEN value END AS value FROM r LEFT JOIN d USING (document_id))
    """


def typed_raw(spark, sf):
    """Raw telemetry from the event table, with rows of every reason to be set apart."""
    k, value, change = F.get_json_object("props", "$.k").cast("long"), F.col("value"), F.when(F.col("event_id") % 43 != 0, F.get_json_object("props", "$.k").cast("long"))
    of = F.when(F.col("event_id") % 41 == 0, "heartbeat").when(F.col("event_type").isin("view", "click"), "extraction_result").when(F.col("event_type").isin("signup", "purchase"), "state_transition").otherwise("session_complete")
    body = {
        "extraction_result": {"fields_extracted": change, "fields_attempted": k + 1, "latency": value, "method": F.lit("rule")},
        "state_transition": {"from_state": F.lit("start"), "to_state": F.lit("form"), "turn_number": change, "latency": value},
        "session_complete": {"total_turns": change, "duration_seconds": value, "mandatory_pct": k.cast("double"), "optional_pct": F.lit(0.0)},
    }
    payload = F.coalesce(*[F.when(of == kind, F.to_json(F.struct(*[x.alias(c) for c, x in fields.items()]))) for kind, fields in body.items()], F.lit("{}"))
    cut = F.when(F.col("event_id") % 37 == 0, F.substring(payload, 1, 9)).otherwise(payload)
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf, "events").select("event_id", "ts", F.col("user_id").cast("string").alias("user_id"), day.alias("session_id"), (F.col("event_id") % 1500).alias("document_id"), of.alias("event_type"), cut.alias("payload"))


@query("telemetry_typed", _TYPED_EVENTS + f"""SELECT kind, reason, source, count(*) AS n, count(DISTINCT user_id) AS users,
    sum(CASE WHEN kind IN ('extraction_result', 'state_transition') THEN CAST(trunc(value * 1000) AS BIGINT) END)::BIGINT AS latency_ms, sum(CASE WHEN kind = 'extraction_result' THEN k END)::BIGINT AS fields_extracted,
    sum(CASE WHEN kind = 'state_transition' THEN k END)::BIGINT AS turns, {r4("sum(CASE WHEN kind = 'session_complete' THEN " + r4("value", 1) + " END)", 1)} AS seconds FROM t GROUP BY kind, reason, source""")
def telemetry_typed(spark, sf):
    path, raw, contexts = scratch(spark, "typed"), typed_raw(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "source", "lang")
    parts, keep = [raw.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == i) for i in range(2)], ingest.typed_sink(f"{path}/typed")
    live.replayed(parts, lambda rows: ingest.typed_events(rows, contexts), path, "append", 4, sink=keep)
    keep(ingest.typed_events(parts[1], contexts), 1)  # comes again
    got = ingest.ingested(spark, f"{path}/typed", "source string, lang string").groupBy("kind", "reason", "source")
    seconds = half_up(F.sum("duration_seconds"), 1)
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id_hash").alias("users"), F.sum("latency_ms").alias("latency_ms"), F.sum("fields_extracted").alias("fields_extracted"), F.sum("turn_number").alias("turns"), seconds.alias("seconds"))


@query("confidence_stream", _FOLD + "SELECT vector_id, arg_max(c, n) AS confidence, CAST(max(n) AS INTEGER) AS steps FROM walk GROUP BY vector_id")
def confidence_stream(spark, sf):
    events = event_stream(spark, sf).select(F.col("user_id").alias("vector_id"), "ts", "event_id", (F.col("event_type") != "error").alias("positive"))
    learned = te.confidence_stream(events, le.START, le.BOOST, le.DECAY, le.TOP, le.BOTTOM)
    out = te.streamed(learned, scratch(spark, "confidence"), "update")
    return out.groupBy("vector_id").agg(F.max_by("confidence", "steps").alias("confidence"), F.max("steps").alias("steps"))


#: Slices of a replay: equal spans of time; late rows come two slices after their own.
_SLICES = 4


def slices(spark, sf, late=None):
    """The events in the slices in which they arrive, and how many partitions their state is dealt to."""
    events = table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    at = events.agg(F.min(us).alias("low"), F.max(us).alias("high"), F.count(F.lit(1)).alias("n")).first()
    own = F.floor(_SLICES * (us - F.lit(at.low)) / F.lit((at.high or 0) - (at.low or 0) + 1)).cast("int")
    arrives = own if late is None else F.when(late & (own < _SLICES - 2), own + 2).otherwise(own)
    rows = events.withColumn("_slice", arrives)
    return [rows.filter(F.col("_slice") == i).drop("_slice") for i in range(_SLICES)], max(4, -(-at.n // 500_000))


@query("quota_stream", ORACLES["quota_violations"])
def quota_stream(spark, sf):
    parts, partitions = slices(spark, sf)

    def build(events):
        rows = events.select("event_id", "user_id", "ts", F.concat(F.lit("s"), F.col("event_id") % 5).alias("session_id"), (F.col("event_type") == "click").alias("is_call"))
        return live.quota_stream(rows, 12, 1, 2)

    return live.replayed(parts, build, scratch(spark, "quotas"), "append", partitions).select("event_id", "violated")


@query("telemetry_live", f"""WITH b AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events),
    e AS (SELECT event_id, event_type, ts, value, epoch_us(ts) AS us, ({_SLICES} * (epoch_us(ts) - low)) // (high - low + 1) AS own FROM events, b),
    d AS (SELECT *, date_trunc('hour', ts) AS start, CASE WHEN event_id % 50 = 0 AND own < {_SLICES - 2} THEN own + 2 ELSE own END AS arrives FROM e),
    w AS (SELECT arrives, max(max(us)) OVER (ORDER BY arrives ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 - 7200000000 AS mark FROM d GROUP BY arrives)
    SELECT start, event_type, count(*) AS n, {r4('sum(value)', 2)} AS total FROM d JOIN w USING (arrives), b
    WHERE (mark IS NULL OR epoch_us(start) + 3600000000 > mark) AND epoch_us(start) + 3600000000 <= high // 1000 * 1000 - 7200000000 GROUP BY ALL""")
def telemetry_live(spark, sf):
    parts, partitions = slices(spark, sf, late=F.col("event_id") % 50 == 0)
    out = live.replayed(parts, lambda events: live.live_rollup(events, "1 hour", "2 hours"), scratch(spark, "live"), "append", partitions)
    return out.withColumn("total", half_up(F.col("total"), 2))


@query("session_resume", f"SELECT user_id, {_SES} AS session_id, min(ts) AS created_at, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS updated_at, count(*) AS saves FROM events GROUP BY ALL")
def session_resume(spark, sf):
    parts, partitions = slices(spark, sf)
    build = lambda events: events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("session_id"), "ts", "event_id", F.col("event_type").alias("state"))
    path = scratch(spark, "sessions")
    live.replayed([*parts[:2], parts[1], *parts[2:], parts[0]], build, f"{path}/stream", "append", partitions, sink=live.save_sessions(f"{path}/saved"))
    return live.saved_sessions(spark, f"{path}/saved", "user_id long, session_id string")


@query("series_append", ORACLES["metric_series"])
def series_append(spark, sf):
    from .core import metrics

    path, rows = scratch(spark, "series"), metrics(spark, sf).withColumn("_part", F.pmod(F.xxhash64("submission_id"), F.lit(2)))
    rows.write.partitionBy("_part").parquet(f"{path}/metrics")
    parts = [spark.read.parquet(f"{path}/metrics").filter(F.col("_part") == i).drop("_part") for i in range(2)]
    keep = live.append_series(path)
    live.replayed(parts, lambda metrics: metrics, f"{path}/stream", "append", 4, sink=keep)
    keep(parts[1], 1)  # comes again
    return live.series_totals(spark, path)


@query("udf_correct", "SELECT p_partkey, translate(lower(trim(p_name)), ' -', '__') AS name, 0.6::DOUBLE AS confidence, 'reported name in snake case' AS reasoning FROM part")
def udf_correct(spark, sf):
    @F.pandas_udf("name string, confidence double, reasoning string")
    def correct(names: pd.Series) -> pd.DataFrame:
        fixed = names.fillna("").str.strip().str.lower().str.replace("[ -]", "_", regex=True)
        return pd.DataFrame({"name": fixed, "confidence": 0.6, "reasoning": "reported name in snake case"})

    return table(spark, sf, "part").select("p_partkey", correct("p_name").alias("c")).select("p_partkey", "c.*")


@query("transform_hooks", "SELECT p_partkey, 'words' AS key, CAST(len(string_split(p_name, ' ')) AS VARCHAR) AS value, CASE WHEN len(string_split(p_name, ' ')) > 4 THEN 'long' END AS problem FROM part")
def transform_hooks(spark, sf):
    def extract(df):
        return df.select("p_partkey", F.split("p_name", " ").alias("words"))

    def transform(df):
        return df.select("p_partkey", F.size("words").alias("n"))

    def mapped(df):
        return df.select("p_partkey", F.lit("words").alias("key"), F.col("n").cast("string").alias("value"))

    def validated(df):
        return df.withColumn("problem", F.when(F.col("value").cast("int") > 4, "long"))

    shape = "p_partkey long, key string, value string"
    steps = [(extract, "p_partkey long, words array<string>"), (transform, "p_partkey long, n int"), (mapped, shape), (validated, shape + ", problem string")]
    return hooked(table(spark, sf, "part"), *steps)


@query("udtf_chunk", "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, CAST(c AS INTEGER) AS chunk, array_to_string(w[c * 200 + 1 : c * 200 + 200], ' ') AS part FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 200.0) AS BIGINT))) AS c FROM w)")
def udtf_chunk(spark, sf):
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk int, part string")
    class Chunks:
        def eval(self, text: str, size: int):
            words = (text or "").split()
            for i in range(0, len(words), size):
                yield i // size, " ".join(words[i : i + size])

    name = "chunks_" + uuid.uuid4().hex[:8]  # sessions are shared
    spark.udtf.register(name, Chunks)
    return spark.sql(f"SELECT doc_id, chunk, part FROM {{docs}}, LATERAL {name}(text, 200)", docs=table(spark, sf, "documents"))


