"""Nested answers and model replies held as JSON text."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlode.shared import written

FENCE = "```"


def flatten_json(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value): leaves of JSON objects of any depth under dot paths; arrays stay leaves, empty objects vanish.

    Values keep their JSON type, so a text that looks like an object stays a leaf. Each level is stored before the next is taken
    from its objects, so it is parsed once. A null or broken text, and one that is no object, has no leaves.
    """
    entries = "map<string,variant>"
    found = rows.select(F.col(key), F.lit("").alias("path"), F.try_parse_json(F.col(text)).alias("value"))
    is_object = F.schema_of_variant("value").startswith("OBJECT")
    nested, done = found.filter(is_object), []
    while not done or not nested.isEmpty():
        inner = nested.select(key, "path", F.explode(F.try_variant_get("value", "$", entries)).alias("k", "v"))
        level = inner.select(key, F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "k").alias("path"), F.col("v").alias("value"))
        level = written(level, "level")
        done.append(level.filter(F.coalesce(~is_object, F.lit(True))).select(key, "path", F.try_variant_get("value", "$", "string").alias("value")))
        nested = level.filter(is_object)
    return functools.reduce(DataFrame.unionByName, done)


def quoted(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").otherwise(listed.substr(F.lit(2), F.length(listed) - 2))


def unflatten_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): nested objects of any depth from (key, path, value) rows with dot paths, keys in order, values as strings.

    The deepest level is folded into objects first and the rest stored, then the next. Where a path is both a leaf and an object, the object stays.
    """
    steps = F.split("path", r"\.")
    level = rows.select(key, steps.alias("steps"), quoted(F.col("value")).alias("part"), F.lit(0).alias("is_object"))
    deepest = level.agg(F.max(F.size("steps"))).first()[0] or 0
    for depth in range(deepest, 0, -1):
        own = level.filter(F.size("steps") == depth).groupBy(key, "steps").agg(F.max_by("part", F.struct("is_object", "part")).alias("part"))
        entry = F.concat(quoted(F.element_at("steps", -1)), F.lit(":"), "part")
        listed = F.transform(F.array_sort(F.collect_list(F.struct(F.element_at("steps", -1).alias("name"), entry.alias("entry")))), lambda x: x["entry"])
        made = own.groupBy(key, F.slice("steps", 1, depth - 1).alias("steps")).agg(F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}")).alias("part"))
        level = written(level.filter(F.size("steps") < depth).unionByName(made.withColumn("is_object", F.lit(1))), "level")
    return level.select(key, F.col("part").alias("json"))


def reply_body(text: Column) -> Column:
    """A reply without its fences, or its first {..} block; null if there is none."""
    bare = F.trim(F.regexp_replace(text, FENCE + "(json)?", ""))
    block = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(block == "", None).otherwise(block)


def reply_matches(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, field_id, name, confidence, bad): "" and "null" names are null, confidences are clamped to [0, 1], bad ones 0."""
    shape = "map<string,struct<key:string,con:string>>"
    parsed = rows.select(key, F.from_json(reply_body(F.col(text)), shape).alias("m"))
    good = parsed.filter("m IS NOT NULL").select(key, F.explode("m").alias("field_id", "v"))
    name = F.when(~F.col("v.key").isin("", "null"), F.col("v.key"))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("v.con").try_cast("double"), F.lit(0.0))))
    bad = parsed.filter("m IS NULL").select(key, F.lit(None).cast("string").alias("field_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("bad"))
    return good.select(key, "field_id", name.alias("name"), conf.alias("confidence"), F.lit(False).alias("bad")).unionByName(bad)


def mapping_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, field_id, name, confidence) of mappings whose entries are [name, value, confidence] or an object."""
    entries = rows.select(key, F.explode(F.from_json(text, "map<string,string>")).alias("field_id", "entry"))
    listed, named = F.from_json("entry", "array<string>"), F.from_json("entry", "struct<predicted_field_name:string,confidence:double>")
    is_list = F.col("entry").startswith("[")
    name = F.when(is_list, F.get(listed, F.lit(0))).otherwise(named["predicted_field_name"])
    conf = F.when(is_list, F.get(listed, F.lit(2)).try_cast("double")).otherwise(named["confidence"])
    named_ = F.when((name != "") & (name != "null"), name)
    return entries.select(key, "field_id", named_.alias("name"), F.when(named_.isNotNull(), F.coalesce(conf, F.lit(0.0))).otherwise(0.0).alias("confidence"))


def enforced(text: Column, schema: dict[str, str]) -> Column:
    """A struct with every key: booleans else false, strings else empty."""
    parsed = F.from_json(text, "map<string,string>")
    fields = []
    for name, kind in schema.items():
        value = F.get(F.array(parsed[name]), F.lit(0))
        fields.append((F.coalesce(value == "true", F.lit(False)) if kind == "boolean" else F.coalesce(value, F.lit(""))).alias(name))
    return F.struct(*fields)
