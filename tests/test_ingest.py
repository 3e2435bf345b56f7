"""Typed telemetry: every reason to set a row apart, context, repeated batches and bounded ones."""

import datetime
import json

import pytest

from formlode.functions.text import pseudonym
from formlode.streaming import ingest, live
from pyspark.sql import functions as F

TS = datetime.datetime(2024, 3, 1)
GOOD = {
    "extraction_result": {"fields_extracted": 3, "fields_attempted": 5, "latency": 0.0129, "method": "rule"},
    "state_transition": {"from_state": "a", "to_state": "b", "turn_number": 4, "latency": 1.5},
    "session_complete": {"total_turns": 9, "duration_seconds": 12.25, "mandatory_pct": 66.666, "optional_pct": 0.0},
}


def raw(spark, rows):
    return spark.createDataFrame([(i, ts, user, "s", doc, kind, body) for i, (ts, user, doc, kind, body) in enumerate(rows)], ingest.RAW)


def case(kind, change=None, user="u", doc=1, ts=TS):
    return (ts, user, doc, kind, json.dumps({**GOOD[kind], **(change or {})}))


CASES = [
    (case("extraction_result"), None), (case("state_transition"), None), (case("session_complete"), None),
    (case("extraction_result", {"more": [1], "prompt_version": "v2", "hallucination_detected": True}, user="", doc=None), None),
    (case("state_transition", ts=None), "time"), ((TS, None, 9, "other", "{}"), "type"), ((TS, "u", 1, None, "{}"), "type"),
    ((TS, "u", 1, "state_transition", None), "json"), ((TS, "u", 1, "state_transition", "{\"from_state\": "), "json"),
    ((TS, "u", 1, "state_transition", "[1]"), "json"), ((TS, "u", 1, "state_transition", ""), "json"), ((TS, "u", 1, "state_transition", "{}"), "field"),
    (case("state_transition", {"turn_number": "four"}), "field"), (case("state_transition", {"turn_number": None}), "field"),
    (case("session_complete", {"duration_seconds": float("nan")}), "json"), (case("extraction_result", {"latency": None}), "field"),
]


def test_every_reason(spark):
    contexts = spark.createDataFrame([(1, "z"), (1, "b"), (None, "n"), (2, "c")], "document_id long, origin string")
    got = {r.event_id: r for r in ingest.typed_events(raw(spark, [c for c, _ in CASES]), contexts).collect()}
    assert [got[i].reason for i in range(len(CASES))] == [want for _, want in CASES]
    assert (got[0].latency_ms, got[0].prompt_version, got[0].hallucination_detected, got[0].origin, got[0].payload) == (12, "v1", False, "b", None)
    assert (got[3].prompt_version, got[3].hallucination_detected, got[3].user_id_hash, got[3].origin) == ("v2", True, None, None)
    assert (got[1].turn_number, got[1].latency_ms, got[1].prompt_version) == (4, 1500, None)
    assert (got[2].duration_seconds, got[2].mandatory_completion_pct) == (12.3, 66.67)
    assert got[0].user_id_hash == spark.range(1).select(pseudonym(F.lit("u"))).first()[0]
    assert got[12].payload == CASES[12][0][4] and got[12].turn_number is None


def test_clashing_context_and_no_rows(spark):
    empty = raw(spark, [CASES[0][0]]).limit(0)
    assert ingest.typed_events(empty).count() == 0 and ingest.typed_events(empty).schema.names == [c.split()[0] for c in ingest.TYPED.split(", ")]
    with pytest.raises(ValueError):
        ingest.typed_events(empty, spark.createDataFrame([(1, "x")], "document_id long, kind string"))


def test_repeated_batch_and_folders_by_kind(spark, tmp_path):
    parts = [raw(spark, [c for c, _ in CASES[:6]]), raw(spark, [c for c, _ in CASES[6:]])]
    keep = ingest.typed_sink(f"{tmp_path}/out")
    live.replayed(parts, ingest.typed_events, str(tmp_path), "append", 2, sink=keep)
    keep(ingest.typed_events(parts[1]), 1)  # comes again
    got = ingest.ingested(spark, f"{tmp_path}/out")
    assert got.count() == len(CASES) and got.filter(F.col("kind") == "quarantine").count() == sum(want is not None for _, want in CASES)
    plan = got.filter(F.col("kind") == "state_transition")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan


def test_batches_are_bounded(spark, tmp_path):
    raw(spark, [c for c, _ in CASES]).repartition(4).write.parquet(f"{tmp_path}/in")
    running = ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", most_bytes="1", every=None)
    running.awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=*"))) == 4 and ingest.ingested(spark, f"{tmp_path}/out").count() == len(CASES)
