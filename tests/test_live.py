"""Streams with state: planted late rows, repeated batches, sessions that resume, limits that expire."""

import datetime

import pytest

from formlode.streaming import live
from formlode.streaming.telemetry import quota_violations
from pyspark.sql import functions as F

DAY = datetime.datetime(2024, 3, 1)


def at(hours):
    return DAY + datetime.timedelta(hours=hours)


def events(spark, rows, extra="is_call boolean"):
    return spark.createDataFrame(rows, f"user_id long, session_id string, ts timestamp, event_id long, {extra}")


def test_quotas_over_slices_as_in_batch(spark, tmp_path):
    rows = [(1, f"s{i % 3}", at(i * 2), i, i % 4 == 0) for i in range(40)] + [(2, "a", at(5), 100 + i, True) for i in range(4)] + [(None, "a", at(6), 200, False), (3, "b", None, 201, False)]
    parts = [events(spark, [r for r in rows if r[2] is None or lo <= (r[2] - DAY).total_seconds() / 3600 < hi]) for lo, hi in ((0, 20), (20, 60), (60, 90))]
    got = live.replayed(parts, lambda e: live.quota_stream(e, 6, 1, 2), str(tmp_path), "append", 2)
    whole = events(spark, rows).filter("ts IS NOT NULL AND user_id IS NOT NULL").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    want = {(r.event_id, r.violated) for r in quota_violations(whole, 6, 1, 2).collect()}
    assert {(r.event_id, r.violated) for r in got.collect()} == want
    assert {v for _, v in want} == {None, "messages", "calls", "sessions"}


def test_idle_session_starts_anew_and_late_events_go(spark, tmp_path):
    parts = [events(spark, [(1, "s", at(0), 1, False), (1, "s", at(1), 2, False)]), events(spark, [(9, "x", at(80), 3, False)]), events(spark, [(1, "s", at(81), 4, False), (1, "s", at(2), 5, False)])]
    got = live.replayed(parts, lambda e: live.quota_stream(e, 2, 9, 9, late="1 hour", idle_days=2), str(tmp_path), "append", 2)
    assert {r.event_id: r.violated for r in got.collect()} == {1: None, 2: None, 3: None, 4: None}


def test_sessions_under_repeats_and_late_saves(spark, tmp_path):
    first = [(1, "s", at(1), 1, "new"), (1, "s", at(2), 2, "form"), (2, "t", at(1), 3, "new"), (2, "t", None, 4, "lost")]
    second = [(1, "s", at(3), 5, "done"), (1, "s", at(3), 5, "done"), (2, "t", at(0), 6, "older")]
    parts = [events(spark, x, "state string") for x in (first, first, second, second, first)]
    got = live.session_table(live.replayed(parts, live.session_store, str(tmp_path), "update", 2))
    assert {(r.user_id, r.session_id): (r.created_at, r.state, r.updated_at, r.saves) for r in got.collect()} == {(1, "s"): (at(1), "done", at(3), 3), (2, "t"): (at(1), "new", at(1), 1)}


@pytest.mark.parametrize("merged", [2, 16])
def test_sessions_saved_by_joins_as_by_state(spark, tmp_path, monkeypatch, merged):
    monkeypatch.setattr(live, "MERGED", merged)
    first = [(1, "s", at(1), 1, "new"), (1, "s", at(2), 2, "form"), (2, "t", at(1), 3, "new"), (2, "t", None, 4, "lost"), (None, "t", at(1), 9, "lost")]
    second = [(1, "s", at(3), 5, "done"), (1, "s", at(3), 5, "done"), (2, "t", at(0), 6, "older")]
    third = [(1, "s", at(3), 7, None), (3, "u", at(9), 8, "new")]
    parts = [events(spark, x, "state string") for x in (first, first, second, second, first, third)]
    keep = live.save_sessions(f"{tmp_path}/saved")
    live.replayed(parts, lambda e: e, f"{tmp_path}/stream", "append", 2, sink=keep)
    keep(parts[-1], len(parts) - 1)  # comes again
    got = live.saved_sessions(spark, f"{tmp_path}/saved", "user_id long, session_id string")
    assert {(r.user_id, r.session_id): (r.created_at, r.state, r.updated_at, r.saves) for r in got.collect()} == {(1, "s"): (at(1), None, at(3), 4), (2, "t"): (at(1), "new", at(1), 1), (3, "u"): (at(9), "new", at(9), 1)}


def test_late_rows_are_dropped_and_open_windows_wait(spark, tmp_path):
    shape = "ts timestamp, event_type string, value double"
    parts = [[(at(0.5), "a", 1.0), (at(5.5), "a", 2.0)], [(at(0.6), "a", 99.0), (at(4.9), "a", 4.0), (at(9.1), "a", 8.0)], [(at(2.0), "a", 99.0)]]
    out = live.replayed([spark.createDataFrame(p, shape) for p in parts], lambda e: live.live_rollup(e, "1 hour", "1 hour"), str(tmp_path), "append", 2)
    assert sorted((r.start, r.n, r.total) for r in out.collect()) == [(at(0), 1, 1.0), (at(4), 1, 4.0), (at(5), 1, 2.0)]


@pytest.mark.parametrize("again", [(), (0,), (1, 0, 1)])
def test_series_grow_by_appending(spark, tmp_path, again):
    shape = "pdf_hash string, category string, sub_category string, document_type string, ts timestamp, submission_id long, total_fields long, coverage_ensemble double"
    parts = [spark.createDataFrame([(f"h{i % 2}", "c", "s", "d", at(i), i, 10, 0.5) for i in ids], shape) for ids in ((0, 1, 2), (3, 4))]
    keep = live.append_series(str(tmp_path))
    for number in (0, 1, *again):
        keep(parts[number], number)
    got = {(r.level, r.identifier): (r.entries, r.first_ts, r.last_ts, r.fields) for r in live.series_totals(spark, str(tmp_path)).collect()}
    assert got["global", "global"] == got["category", "c"] == (5, at(0), at(4), 50)
    assert got["hash", "h1"] == (2, at(1), at(3), 20) and len(got) == 6
    own = live.series_entries(spark, str(tmp_path), "hash")
    assert own.count() == 5
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan


class Held:
    """One value of a state, in place of the store."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getValueState(self, name, schema):
        return self


def test_one_call_saves_all_sessions_of_a_group():
    import pandas as pd

    shape = ["user_id", "session_id", "us", "event_id", "state"]
    store = live.SessionStore()
    store.init(Held())
    first = pd.DataFrame([(1, "s", 10, 1, "a"), (2, "s", 11, 2, None), (1, "s", 12, 2**60 + 1, "b")], columns=shape)
    got = pd.concat(store.handleInputRows((0,), iter([first]), None))
    assert sorted(got.values.tolist()) == [[1, "s", 10, "b", 12, 2], [2, "s", 11, None, 11, 1]]
    again = pd.DataFrame([(1, "s", 12, 2**60 + 1, "b"), (1, "s", 12, 2**60 + 2, "c"), (2, "s", 5, 9, "old"), (3, "t", 1, 1, "new")], columns=shape)
    got = pd.concat(store.handleInputRows((0,), iter([again]), None))
    assert sorted(got.values.tolist()) == [[1, "s", 10, "c", 12, 3], [3, "t", 1, "new", 1, 1]]
    assert list(store.handleInputRows((0,), iter([first, again]), None)) == []


def test_global_series_is_written_by_all_tasks(spark, tmp_path):
    shape = "pdf_hash string, category string, sub_category string, document_type string, ts timestamp, submission_id long, total_fields long, coverage_ensemble double"
    rows = spark.createDataFrame([("h", "c", "s", "d", at(i), i, 10, 0.5) for i in range(40)], shape).repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream
    try:
        live.append_series(str(tmp_path))(rows, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((tmp_path / "entries/batch=0/level=global").glob("*.parquet"))) == 4
