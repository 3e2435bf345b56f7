"""outline_match: no line within a title is left out, however short."""

import duckdb
import pytest

from formlode.operators import layout as la
from formlode.plans import ORACLES, QUERIES

TITLES = [(7, "Alpha beta  gamma\tdelta"), (3, "annual report of 2023"), (5, "short"), (12, "été à Paris, 10:30"), (9, "\U0001d400\U0001d401\U0001d402 mathematical"), (4, "annual review 2024"), (2, " 0123456789 "), (8, "0123456789a"), (1, None)]
TEXTS = [
    (1, "A\nreport\nREPORT OF \n annual\nre\n?\n?mathe\nshort\nshor\n"),
    (2, "\U0001d401\n\U0001d402 m\n\U0001d400\U0001d401\U0001d402 mathem\n\U0001d400\U0001d401\U0001d402 mathe\nà p\nETÉ\n10:30\n0:30 \n"),
    (3, "0123456789\n123456789\n0123456789A\n123456789a\n  gamma\nbeta  gam\na\tdelta\n \n\nannual report of 2023 and more\nnot there"),
    (4, None),
    (2, "e\nnone of it"),  # a document's id again
    (None, "review 2\nannual rep\nannual repo"),
]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(TITLES, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def by_comparing_all():
    titles = [(i, t.strip(" ").lower()) for i, t in TITLES if t]
    lines = [(d, i, line.strip(" ").lower()) for d, text in TEXTS if text for i, line in enumerate(text.split("\n"))]
    same, near = {}, {}
    for d, i, line in filter(lambda x: x[2], lines):
        for title_id, title in titles:
            if line == title:
                same.setdefault((d, i), []).append(title_id)
            elif len(title) > 10 and (line in title or title in line):
                near.setdefault((d, i), []).append(title_id)
    # An id that is null is equal to no other, so its lines count both ways.
    found = [(*k, min(v), "exact") for k, v in same.items()] + [(*k, min(v), "partial") for k, v in near.items() if k not in same or k[0] is None]
    return sorted(((d, i, t, f"h{min(t % 5 + 1, 3)}", kind) for d, i, t, kind in found), key=str)


def test_short_lines_within_titles_are_found(spark, folder):
    want = by_comparing_all()
    assert {(1, 1), (1, 4), (2, 0), (2, 1), (3, 1), (3, 4)} <= {r[:2] for r in want} and (1, 5) not in {r[:2] for r in want}
    got = [(r.doc_id, r.line_no, r.title_id, r.heading, r.kind) for r in QUERIES["outline_match"](spark, folder).collect()]
    assert sorted(got, key=str) == want
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    rows = con.execute(f"SELECT doc_id, line_no, title_id, heading, kind FROM ({ORACLES['outline_match']})").fetchall()
    assert sorted(rows, key=str) == want


def test_short_lines_make_no_pairs(spark):
    lines = spark.createDataFrame([(1, i, "and") for i in range(5)], "doc_id long, line_no int, text string")
    titles = spark.createDataFrame([(i, f"this and that {i}") for i in range(7)], "title_id long, title string")
    assert {(r.line_no, r.title_id) for r in la.outline_match(lines, titles, short_lines=True).collect()} == {(i, 0) for i in range(5)}
    plan = la.outline_match(lines, titles, short_lines=True)._jdf.queryExecution().optimizedPlan().toString()
    # Pieces of titles come to one row each before they meet a line.
    assert "Aggregate [line" in plan
