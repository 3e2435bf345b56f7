"""Fingerprints of forms: the order of widgets doesn't count, each of their traits does."""

from formlode.operators import layout as la
from pyspark.sql import functions as F


def test_every_widget_trait_counts(spark):
    lines = spark.createDataFrame([(d, 0, i, f"line {i}", i * 18) for d in range(8) for i in range(4)], "doc_id int, page int, line_no int, text string, top int")
    base = [(0, "TEXT", 100, 50, 80, 12), (0, None, 100, 90, 12, 12), (1, "TEXT", 100, 50, 80, 12)]
    other = {
        1: base[::-1],
        2: [(0, "CHOICE", 100, 50, 80, 12), *base[1:]],
        3: [(0, "TEXT", 101, 50, 80, 12), *base[1:]],
        4: [(0, "TEXT", 100, 50, 81, 12), *base[1:]],
        5: [*base, base[0]],
        6: [(1, *base[0][1:]), *base[1:]],
    }
    rows = [(d, *w) for d, ws in ({0: base} | other).items() for w in ws] + [(9, *base[0])]
    widgets = spark.createDataFrame(rows, "doc_id int, page int, kind string, left int, top int, width int, height int")
    found = la.form_fingerprint(lines.withColumn("zone", F.lit("top")), widgets, 600.0, 800.0).collect()
    prints = {r.doc_id: r.fingerprint for r in found}
    assert prints.keys() == set(range(8)) and prints[0] == prints[1]
    assert len(set(prints.values())) == 7  # 0 and 1 agree; 7 has no widgets
    parts = {r.doc_id: (r.widgets, r.kinds, r.page_kinds, r.thirds) for r in found}
    assert parts[0] == (3, "TEXT=2,UNKNOWN=1", "0:TEXT=1,UNKNOWN=1|1:TEXT=1", "0:2/0/0|1:1/0/0") and parts[7] == (0, "", "", "")
