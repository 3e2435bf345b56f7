"""Views of the test tables in the shapes that the operators take, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlode.functions.rounding import half_up


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUB: one row a submission and field, with both predictions."""
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    lines = lines.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rag, llm = F.col("l_partkey") % 7 != 0, F.col("l_suppkey") % 5 != 0
    return rows.select(
        F.col("l_orderkey").alias("submission_id"),
        F.col("l_linenumber").alias("field_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("h"), F.col("l_orderkey") % 97).alias("pdf_hash"),
        F.col("r_name").alias("category"),
        F.col("n_name").alias("sub_category"),
        F.col("c_mktsegment").alias("document_type"),
        F.when(rag, F.concat(F.lit("f"), F.col("l_partkey") % 3)).alias("rag_name"),
        F.when(rag, half_up(0.5 + F.col("l_quantity") / 100)).alias("rag_conf"),
        F.when(llm, F.concat(F.lit("f"), F.col("l_suppkey") % 3)).alias("llm_name"),
        F.when(llm, half_up(0.5 + F.col("l_discount") * 5)).alias("llm_conf"),
    )


#: SQL form of submissions().
SUB = """sub AS (
    SELECT l_orderkey AS submission_id, l_linenumber AS field_id, o_custkey AS user_id, o_orderdate AS ts,
           'h' || (l_orderkey % 97) AS pdf_hash, r_name AS category, n_name AS sub_category, c_mktsegment AS document_type,
           CASE WHEN l_partkey % 7 <> 0 THEN 'f' || (l_partkey % 3) END AS rag_name,
           CASE WHEN l_partkey % 7 <> 0 THEN floor((0.5::DOUBLE + l_quantity / 100) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE END AS rag_conf,
           CASE WHEN l_suppkey % 5 <> 0 THEN 'f' || (l_suppkey % 3) END AS llm_name,
           CASE WHEN l_suppkey % 5 <> 0 THEN floor((0.5::DOUBLE + l_discount * 5) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE END AS llm_conf
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem)
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n = 1)"""

#: SQL forms of ensemble.select_ensemble() and ensemble.classify_cases() over sub.
ENS = """ens AS (
    SELECT *, CASE WHEN rag_name IS NOT NULL AND llm_name IS NOT NULL THEN CASE WHEN rag_name = llm_name OR coalesce(rag_conf, 0) >= llm_conf THEN 'rag' ELSE 'llm' END
                   WHEN rag_name IS NOT NULL THEN 'rag' WHEN llm_name IS NOT NULL THEN 'llm' END AS selected_from,
           CASE WHEN rag_name IS NOT NULL AND llm_name IS NOT NULL THEN CASE WHEN rag_name = llm_name THEN 'agreed' WHEN coalesce(rag_conf, 0) >= llm_conf THEN 'rag_higher' ELSE 'llm_higher' END
                WHEN rag_name IS NOT NULL THEN 'only_rag' WHEN llm_name IS NOT NULL THEN 'only_llm' ELSE 'none' END AS reason
    FROM sub), fin AS (
    SELECT *, CASE selected_from WHEN 'rag' THEN rag_name WHEN 'llm' THEN llm_name END AS selected_field_name,
           CASE selected_from WHEN 'rag' THEN rag_conf WHEN 'llm' THEN llm_conf END AS selected_conf,
           CASE WHEN rag_name IS NOT NULL AND rag_conf >= 0.75::DOUBLE AND llm_name IS NOT NULL AND llm_conf >= 0.75::DOUBLE THEN CASE WHEN rag_name = llm_name THEN 'A' ELSE 'B' END
                WHEN llm_name IS NOT NULL AND llm_conf >= 0.75::DOUBLE THEN 'C' WHEN rag_name IS NOT NULL AND rag_conf >= 0.75::DOUBLE THEN 'D' ELSE 'E' END AS case_type
    FROM ens)"""
