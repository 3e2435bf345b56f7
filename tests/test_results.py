"""Stored results: repeated batches, forms that are saved again, pruned reading."""

from formlode.shared import scratch
from formlode.sources.results import read_results, write_results


def test_batches_replace_and_reads_are_pruned(spark):
    path = scratch(spark, "results")
    frame = lambda rows: spark.createDataFrame(rows, "user_id long, session_id string, pdf_id string, field string, value int")
    first = [(u, "s", p, f, 1) for u in range(30) for p in "ab" for f in ("x", "y")] + [(None, None, "a", "x", 1)]
    again = [(3, "s", "a", "x", 2), (40, "t", "a", "x", 2)]
    write_results(frame(first), path, 1)
    write_results(frame([(3, "s", "b", "x", 9), *again]), path, 2)
    write_results(frame(again), path, 2)  # the batch is repeated with fewer rows
    got = {(r.user_id, r.session_id, r.pdf_id, r.field): r.value for r in read_results(spark, path).collect()}
    want = {r[:4]: r[4] for r in first if r[:3] != (3, "s", "a")} | {r[:4]: r[4] for r in again}
    assert got == want
    one = read_results(spark, path, 3)
    assert {(r.pdf_id, r.field, r.value, r.batch) for r in one.collect()} == {("a", "x", 2, 2), ("b", "x", 1, 1), ("b", "y", 1, 1)}
    plan = one._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters") :]
    assert "user_bucket" in scan[: scan.index("PushedFilters")] and "EqualTo(user_id,3)" in scan


def test_a_large_folder_is_cut_by_its_rows(spark, tmp_path):
    from formlode.sources.results import write_partitioned

    rows = spark.range(100).selectExpr("id", "if(id < 90, 'global', 'small') AS level")
    write_partitioned(rows, str(tmp_path / "out"), ["level"], "id", most=20)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.level) for r in got.collect()) == [(r.id, r.level) for r in rows.collect()]
    assert len(list((tmp_path / "out/level=global").glob("*.parquet"))) > 1 == len(list((tmp_path / "out/level=small").glob("*.parquet")))


def test_forms_saved_again_are_read_from_the_first_batch(spark, monkeypatch):
    from formlode.plans import values

    plans = []

    def watched(rows, path, batch):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        write_results(rows, path, batch)

    monkeypatch.setattr(values, "write_results", watched)
    values.result_layout(spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and "Join" in plans[0] and not any("Join" in p for p in plans[1:])
