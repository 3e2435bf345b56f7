"""Every query with an SQL counterpart gives the same rows as DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from formlode.operators import learning as le
from formlode.plans import ORACLES, QUERIES
from formlode.plans.core import learning_events
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=str)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    theirs = duck.execute(ORACLES[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    assert rows(ours.columns, ours.collect()) == rows(names, theirs.fetchall())


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_stream_replays_the_fold(spark):
    batch = {r.vector_id: (r.confidence, r.steps) for r in le.confidence_fold(learning_events(spark, DATA)).collect()}
    stream = {r.vector_id: (r.confidence, r.steps) for r in QUERIES["confidence_stream"](spark, DATA).collect()}
    assert batch.keys() == stream.keys()
    assert all(abs(batch[k][0] - stream[k][0]) < 1e-9 and batch[k][1] == stream[k][1] for k in batch)


def test_cases_sum_to_total(spark):
    m = QUERIES["submission_metrics"](spark, DATA)
    assert m.filter("case_a + case_b + case_c + case_d + case_e <> total_fields").count() == 0
    assert m.filter("coverage_llm > 1 OR agreement_rate > 1 OR ambiguity_rate > 1").count() == 0


def test_confidence_stays_in_bounds(spark):
    events = spark.range(200).select(F.lit(1).alias("vector_id"), F.col("id").alias("ts"), F.col("id").alias("event_id"), (F.col("id") < 100).alias("positive"))
    history = [r.confidence for r in le.confidence_history(events).collect()]
    assert max(history) == 0.99 and le.confidence_fold(events).first().confidence == 0.5 and len(history) == 200


def test_ann_finds_most_neighbours(spark):
    exact = {(r.query_id, r.vector_id) for r in QUERIES["cosine_topk"](spark, DATA).collect()}
    near = {(r.query_id, r.vector_id) for r in QUERIES["ann_topk"](spark, DATA).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
