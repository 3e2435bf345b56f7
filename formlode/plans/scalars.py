"""Queries of projections, parsing and validation over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from formlode.functions import json as js
from formlode.functions import text as tx
from formlode.functions.rounding import half_up

from .adapters import table
from .registry import query, r4
from .vectors import _NORM


def n_rows(df, *by):
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


@query("field_text", "SELECT p_partkey, concat_ws(' ', nullif(trim(p_name), ''), CASE WHEN p_size % 5 <> 0 THEN p_brand END, nullif(trim(p_type), '')) AS text FROM part")
def field_text(spark, sf):
    section = F.when(F.col("p_size") % 5 == 0, "  ").otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", tx.joined(F.col("p_name"), section, headers=F.array("p_type", F.lit(""))).alias("text"))


@query("field_context", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END AS context, CASE WHEN p_size % 4 = 0 THEN 2 ELSE 3 END AS headers, CAST(floor(p_retailprice + 0.5::DOUBLE) AS BIGINT) AS left_px FROM part")
def field_context(spark, sf):
    p = table(spark, sf, "part").withColumns({"h1": F.when(F.col("p_size") % 4 != 0, F.lit("h")).otherwise(""), "h2": F.col("p_name"), "h3": F.col("p_brand"), "h4": F.col("p_type")})
    headers = F.filter(F.array("h1", "h2", "h3"), lambda x: x != "")
    return p.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("h4")).otherwise(F.col("h3")).alias("context"), F.size(headers).alias("headers"), F.floor(F.col("p_retailprice") + 0.5).alias("left_px"))


@query("norm_text", f"SELECT doc_id, md5({_NORM.format('text')}) AS digest FROM documents")
def norm_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.normalised(F.col("text"))).alias("digest"))


_BOX = "l_quantity * 10 AS l, (l_partkey % 700)::DOUBLE AS t, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 10 + l_suppkey % 90 END AS r, (20 + l_linenumber)::DOUBLE AS w, 14.0::DOUBLE AS h"


@query("bbox_norm", f"SELECT l_orderkey, l_linenumber, count(*) AS n, {r4('sum(l / 612)', 3)} AS x, {r4('sum(coalesce(r, l + w) / 612)', 3)} AS x2, {r4('sum((t + h) / 792)', 3)} AS y2 FROM (SELECT l_orderkey, l_linenumber, {_BOX} FROM lineitem) GROUP BY ALL")
def bbox_norm(spark, sf):
    from formlode.operators.layout import normalised_box

    boxes = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity * 10 AS l", "CAST(l_partkey % 700 AS DOUBLE) AS t", "CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 10 + l_suppkey % 90 END AS r", "CAST(20 + l_linenumber AS DOUBLE) AS w", "14.0D AS h", "CAST(NULL AS DOUBLE) AS b")
    done = boxes.withColumn("box", normalised_box("l", "t", "r", "b", "w", "h", 612.0, 792.0, None))
    return done.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), half_up(F.sum("box.x"), 3).alias("x"), half_up(F.sum("box.x2"), 3).alias("x2"), half_up(F.sum("box.y2"), 3).alias("y2"))


@query("spatial_thirds", "SELECT CASE WHEN ((l_partkey % 700) + 7) / 792::DOUBLE < 0.33::DOUBLE THEN 'top' WHEN ((l_partkey % 700) + 7) / 792::DOUBLE < 0.67::DOUBLE THEN 'middle' ELSE 'bottom' END AS third, count(*) AS n FROM lineitem GROUP BY ALL")
def spatial_thirds(spark, sf):
    from formlode.operators.layout import third

    return n_rows(table(spark, sf, "lineitem").select(third(((F.col("l_partkey") % 700) + 7) / 792.0).alias("third")), "third")


@query("correct_names", "SELECT p_partkey, translate(lower(trim(p_name)), ' -', '__') AS name, 0.6::DOUBLE AS confidence FROM part")
def correct_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.snake(F.col("p_name")).alias("name"), F.lit(0.6).alias("confidence"))


@query("flatten_json", "SELECT event_id, 'a.k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'b' AS path, event_type AS value FROM events UNION ALL SELECT event_id, 'c.d.e' AS path, '[1,2]' AS value FROM events UNION ALL SELECT event_id, 'c.g.h.i.j.k' AS path, event_type AS value FROM events UNION ALL SELECT event_id, 's' AS path, '{' || event_type AS value FROM events UNION ALL SELECT event_id, 'q' AS path, '{\"k\":1}' AS value FROM events")
def flatten_json(spark, sf):
    deep = F.concat(F.lit('"g":{"h":{"i":{"j":{"k":"'), "event_type", F.lit('"}}}}}}'))
    nested = F.concat(F.lit('{"a":'), "props", F.lit(',"b":"'), "event_type", F.lit('","s":"{'), "event_type", F.lit('","q":"{\\"k\\":1}","c":{"d":{"e":[1,2],"f":{}},'), deep)
    return js.flatten_json(table(spark, sf, "events").select("event_id", nested.alias("t")), "event_id", "t")


@query("unflatten_json", """WITH r AS (SELECT user_id, event_type, max(props) AS value FROM events GROUP BY ALL), i AS (SELECT user_id, '{' || string_agg(to_json(event_type) || ':' || to_json(value), ',' ORDER BY event_type) || '}' AS j FROM r GROUP BY ALL)
    SELECT user_id, '{"name":"u' || user_id || '","section_' || (user_id % 3) || '":{"part":' || j || '}}' AS json FROM i""")
def unflatten_json(spark, sf):
    path = F.concat(F.lit("section_"), F.col("user_id") % 3, F.lit(".part."), "event_type").alias("path")
    rows = table(spark, sf, "events").groupBy("user_id", path).agg(F.max("props").alias("value"))
    names = rows.select("user_id", F.lit("name").alias("path"), F.concat(F.lit("u"), "user_id").alias("value")).distinct()
    return js.unflatten_json(rows.unionByName(names), "user_id")


@query("parse_replies", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'f1' END AS field_id, CASE WHEN event_id % 9 = 0 OR event_id % 4 = 0 THEN NULL ELSE event_type END AS name, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0.0::DOUBLE WHEN event_id % 5 = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence, event_id % 9 = 0 AS bad FROM events")
def parse_replies(spark, sf):
    conf = F.when(F.col("event_id") % 5 == 0, '"x"').when(F.col("event_id") % 5 == 1, "7").otherwise("0.5")
    body = F.concat(F.lit('```json\n{"f1":{"key":"'), F.when(F.col("event_id") % 4 == 0, "null").otherwise(F.col("event_type")), F.lit('","con":'), conf, F.lit("}}\n```"))
    return js.reply_matches(table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, "no reply").otherwise(body).alias("t")), "event_id", "t")


@query("mapping_shapes", "SELECT event_id, 'f' || (event_id % 7) AS field_id, CASE WHEN event_id % 6 <> 0 THEN event_type END AS name, CASE WHEN event_id % 6 <> 0 THEN (event_id % 10) / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM events")
def mapping_shapes(spark, sf):
    name, conf = F.when(F.col("event_id") % 6 == 0, "").otherwise(F.col("event_type")), ((F.col("event_id") % 10) / 10.0).cast("string")
    listed = F.concat(F.lit('["'), name, F.lit('","v",'), conf, F.lit("]"))
    named = F.concat(F.lit('{"predicted_field_name":"'), name, F.lit('","confidence":'), conf, F.lit("}"))
    entry = F.concat(F.lit('{"f'), F.col("event_id") % 7, F.lit('":'), F.when(F.col("event_id") % 2 == 0, listed).otherwise(named), F.lit("}"))
    return js.mapping_rows(table(spark, sf, "events").select("event_id", entry.alias("t")), "event_id", "t")


@query("enforce_schema", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, false AS agreed, '' AS note FROM events")
def enforce_schema(spark, sf):
    return table(spark, sf, "events").select("event_id", js.enforced(F.col("props"), {"k": "string", "agreed": "boolean", "note": "string"}).alias("s")).select("event_id", "s.*")


@query("address_split", "WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents) SELECT doc_id, array_to_string(p[1:2], ', ') AS line1, coalesce(array_to_string(p[3:], ', '), '') AS line2 FROM p")
def address_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.address_lines(F.col("text")).alias("a")).select("doc_id", "a.*")


@query("phone_parts", "SELECT c_custkey, '1' AS country, lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS area, '555' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS number FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, '' AS country, lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS area, '5551234' AS number FROM customer WHERE c_custkey % 2 = 1")
def phone_parts(spark, sf):
    area, tail = F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    phone = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("+1 ("), area, F.lit(") 555-"), tail)).otherwise(F.concat(F.lit("("), area, F.lit(") 555-1234")))
    return table(spark, sf, "customer").select("c_custkey", tx.phone_parts(phone).alias("p")).select("c_custkey", "p.*")


@query("extract_contacts", f"SELECT doc_id, nullif(regexp_extract(text, '{tx.EMAIL_IN}', 0), '') AS email, nullif(regexp_extract(text, '{tx.PHONE_IN}', 0), '') AS phone, nullif(regexp_extract(text, '\\b[0-9]{{5}}\\b', 0), '') AS zip FROM documents")
def extract_contacts(spark, sf):
    first = lambda p: F.nullif(F.regexp_extract("text", p, 0), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", first(tx.EMAIL_IN).alias("email"), first(tx.PHONE_IN).alias("phone"), first(tx.ZIP_IN).alias("zip"))


@query("validate_values", """WITH kv AS (SELECT CASE event_id % 4 WHEN 0 THEN 'contact_email' WHEN 1 THEN 'telephone' WHEN 2 THEN 'us_check' ELSE 'name' END AS key,
    CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'a@b.com' ELSE 'a@b' END WHEN event_id % 4 = 1 THEN CASE WHEN event_id % 3 = 0 THEN '+1 212 555 1234' WHEN event_id % 3 = 1 THEN '+44 20 555 1234' ELSE '555 1234' END WHEN event_id % 4 = 2 THEN CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'maybe' END ELSE 'x' END AS value FROM events)
    SELECT rule, count(*) AS n FROM (SELECT CASE WHEN value = '' THEN 'empty' WHEN key = 'contact_email' AND value = 'a@b' THEN 'email' WHEN key = 'telephone' AND value <> '+1 212 555 1234' THEN 'phone' WHEN key = 'us_check' AND value = 'maybe' THEN 'boolean' END AS rule FROM kv) WHERE rule IS NOT NULL GROUP BY ALL""")
def validate_values(spark, sf):
    i = F.col("event_id")
    key = F.element_at(F.array(*map(F.lit, ("contact_email", "telephone", "us_check", "name"))), (i % 4 + 1).cast("int"))
    mail = F.when(i % 3 == 0, "a@b.com").otherwise("a@b")
    phone = F.when(i % 3 == 0, "+1 212 555 1234").when(i % 3 == 1, "+44 20 555 1234").otherwise("555 1234")
    value = F.when(i % 11 == 0, "").when(i % 4 == 0, mail).when(i % 4 == 1, phone).when(i % 4 == 2, F.when(i % 3 == 0, "true").otherwise("maybe")).otherwise("x")
    return n_rows(table(spark, sf, "events").select(F.explode(tx.rule_errors(key, value)).alias("rule")), "rule")


@query("pseudonymise", "SELECT event_id, left(sha256(user_id::VARCHAR), 16) AS user_hash, event_type FROM events")
def pseudonymise(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.pseudonym(F.col("user_id")).alias("user_hash"), "event_type")


REPLIES = ("yes", "no", "skip", "exit", "1, 3", "n/a", "ok", "other")
_REPLY = f"list_extract([{', '.join(repr(r) for r in REPLIES)}], CAST(event_id % 8 + 1 AS INTEGER))"


def replies(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("event_id") % 8 + 1).cast("int")).alias("reply"))


@query("turn_intents", f"SELECT event_type, CASE {_REPLY} WHEN 'yes' THEN 'affirmative' WHEN 'ok' THEN 'affirmative' WHEN 'no' THEN 'negative' WHEN 'skip' THEN 'skip' WHEN 'n/a' THEN 'skip' WHEN 'exit' THEN 'exit' ELSE 'other' END AS intent, count(*) AS n FROM events GROUP BY ALL")
def turn_intents(spark, sf):
    return n_rows(replies(spark, sf).select("event_type", tx.intent(F.col("reply")).alias("intent")), "event_type", "intent")


@query("choice_answers", f"SELECT event_id, CASE {_REPLY} WHEN 'yes' THEN '1,2,3,4' WHEN 'no' THEN '' WHEN '1, 3' THEN '1,3' END AS chosen FROM events")
def choice_answers(spark, sf):
    return replies(spark, sf).select("event_id", F.array_join(tx.chosen_options(F.col("reply"), 4), ",").alias("chosen"))


@query("batch_estimate", "WITH e AS (SELECT lang, greatest(1, n_chars // 4) AS tokens, greatest(1, CAST(ceil(ceil(n_chars / 2000.0::DOUBLE) / 5.0::DOUBLE) AS BIGINT)) AS chunks FROM documents) SELECT lang, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(greatest(1, CAST(ceil(chunks / 4.0::DOUBLE) AS BIGINT))) AS BIGINT) AS cycles, CAST(sum(greatest(1, CAST(ceil(1.3::DOUBLE * greatest(1, CAST(ceil(chunks / 4.0::DOUBLE) AS BIGINT)) * 44.0::DOUBLE) AS BIGINT))) AS BIGINT) AS seconds FROM e GROUP BY ALL")
def batch_estimate(spark, sf):
    up = lambda a, b: F.greatest(F.lit(1), F.ceil(a / F.lit(float(b))))
    e = table(spark, sf, "documents").select("lang", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).alias("tokens"), up(F.ceil(F.col("n_chars") / 2000.0), 5).alias("chunks"))
    return e.groupBy("lang").agg(F.sum("tokens").alias("tokens"), F.sum("chunks").alias("chunks"), F.sum(up(F.col("chunks"), 4)).alias("cycles"), F.sum(up(1.3 * up(F.col("chunks"), 4) * 44.0, 1)).alias("seconds"))


@query("entity_flags", "SELECT c_custkey, lower(c_mktsegment) || '_check' AS key, c_mktsegment <> 'MACHINERY' AS value FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def entity_flags(spark, sf):
    known = table(spark, sf, "customer").select("c_mktsegment").distinct().filter("c_mktsegment <> 'MACHINERY'")
    schema = known.select(F.concat(F.lower("c_mktsegment"), F.lit("_check")).alias("key"))
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.lower("c_mktsegment"), F.lit("_check")).alias("key"))
    return rows.filter(~F.col("key").startswith("_")).join(schema, "key", "left_semi").select("c_custkey", "key", F.lit(True).alias("value"))


_PATHS = ("address_registered.address_registered_city_id", "address_mailing.address_mailing_zip_id", "wiring_details.wiring_address.wiring_address_street", "investor.name_id")


@query("address_groups", "SELECT g AS grp, part, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'registered' WHEN 1 THEN 'mailing' WHEN 2 THEN 'wiring' END AS g, CASE event_id % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'zip' WHEN 2 THEN 'street' END AS part FROM events) WHERE g IS NOT NULL GROUP BY ALL")
def address_groups(spark, sf):
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf, "events").select(tx.address_group(path).alias("grp"), tx.address_part(path).alias("part"))
    return n_rows(rows.filter("grp IS NOT NULL"), "grp", "part")


@query("exact_dups", "SELECT sha256(text) AS digest, md5(text) AS md5, sha1(text) AS sha1, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def exact_dups(spark, sf):
    rows = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"), F.md5("text").alias("md5"), F.sha1("text").alias("sha1"))
    return rows.groupBy("digest", "md5", "sha1").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("widget_types", "SELECT CASE WHEN p_size % 2 = 0 THEN CASE WHEN (p_size * 16) & 128 > 0 THEN 'combo' ELSE 'list' END ELSE CASE WHEN (p_size * 16) & 256 > 0 THEN 'radio' ELSE 'checkbox' END END AS kind, count(*) AS n FROM part GROUP BY ALL")
def widget_types(spark, sf):
    flags = F.col("p_size") * 16
    kind = F.when(F.col("p_size") % 2 == 0, F.when(flags.bitwiseAND(0x80) > 0, "combo").otherwise("list")).otherwise(F.when(flags.bitwiseAND(0x100) > 0, "radio").otherwise("checkbox"))
    return n_rows(table(spark, sf, "part").select(kind.alias("kind")), "kind")


@query("usable_fields", "SELECT p_partkey FROM part WHERE p_size % 4 <> 0 OR p_size % 3 = 0")
def usable_fields(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_name")).otherwise(" ").alias("context"), F.array(F.lit(""), F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))).alias("headers"))
    return p.filter((F.trim("context") != "") | F.coalesce(F.exists("headers", lambda h: F.trim(h) != ""), F.lit(False))).select("p_partkey")


@query("country_filter", "SELECT c_custkey, key FROM (SELECT c_custkey, n_name, unnest(['form_pf_a', 'name']) AS key FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE key = 'name' OR n_name = 'NATION_1' OR c_custkey % 5 = 0")
def country_filter(spark, sf):
    from formlode.operators.values import country_filtered

    base = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    country = F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("n_name") == "NATION_1", "USA").otherwise(F.col("n_name"))
    keyed = base.select(F.col("c_custkey").alias("session_id"), F.explode(F.create_map(F.lit("form_pf_a"), F.lit("1"), F.lit("name"), F.lit("x"), F.lit("registered_country"), country)).alias("key", "value"))
    return country_filtered(keyed).filter("key <> 'registered_country'").select(F.col("session_id").alias("c_custkey"), "key")


