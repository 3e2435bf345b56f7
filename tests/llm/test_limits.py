"""Beyond former limits, and corner cases of learning, scores and column names."""

import random

import numpy as np
import pytest

from formlode.llm import langid, near_dup, packing, presence, quality_classifier, toxicity
from formlode.llm.quality_rules import FLOORS, SHARE, minimum_determinant, quality_rules
from formlode.llm.topk import exact_top_k
from formlode.llm.training import bounded_sample
from pyspark.sql import functions as F

from .test_operators import prose, syllables


def concentrated(x, rows):
    m, c = x[rows].mean(axis=0), np.cov(x[rows].T, bias=True) + np.diag(np.square(FLOORS))
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    return np.sort(np.argsort(d, kind="stable")[: int(np.ceil(SHARE * len(x)))]), np.linalg.slogdet(c)[1]


def least_determinant(x, starts=40):
    draw, best = np.random.default_rng(1), np.inf
    for _ in range(starts):
        rows, last = draw.choice(len(x), 8, replace=False), np.inf
        for _ in range(60):
            rows, det = concentrated(x, rows)
            if last - det < 1e-9:
                break
            last = det
        best = min(best, concentrated(x, rows)[1])
    return best


def test_minimum_determinant_as_by_brute_force(spark):
    draw = np.random.default_rng(5)
    sets = {}
    for name, far in (("near", 3.0), ("far", 12.0), ("none", 0.0)):
        x = draw.normal(size=(400, 4)) @ np.array([[1, 0.4, 0, 0], [0, 1, 0.2, 0], [0, 0, 1, 0], [0, 0, 0.5, 1]])
        x[:90] += far
        sets[name] = x
    rows = [(g, *map(float, r)) for g, x in sets.items() for r in x]
    got = {r.grp: r for r in minimum_determinant(spark.createDataFrame(rows, "grp string, f1 double, f2 double, f3 double, f4 double")).collect()}
    for g, x in sets.items():
        assert got[g].log_det == pytest.approx(least_determinant(x), abs=0.15)
        assert np.abs(np.array([got[g][f"m{i}"] for i in range(1, 5)])).max() < (0.4 if g != "near" else 1.0)


def test_quality_rules_carry_any_column_and_judge_small_groups(spark):
    rows = [(i, prose(i, 100), "en", "s", float(i), i, "x") for i in range(120)]
    rows += [(500 + i, prose(i, 100), "xx", f"s{i}", 0.0, 0, "y") for i in range(5)]
    rows.append((600, prose(7, 100).replace(" ", "### "), "xx", "s0", 0.0, 0, "y"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, f1 double, grp int, _w string")
    got = {r.doc_id: r for r in quality_rules(df.withColumns({"m1": F.lit(1), "c0": F.lit(2), "x0": F.lit(3), "_distance": F.lit(4)})).collect()}
    assert {i for i, r in got.items() if not r.kept} == {600}
    assert (got[7].f1, got[7].grp, got[7]["_w"], got[7].m1, got[7].c0, got[7].x0, got[7]["_distance"]) == (7.0, 7, "x", 1, 2, 3, 4)


def test_more_languages_than_bits_of_a_mask(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    parts = {f"l{n:02}": [letters[n % 26] + letters[(n * 7 + k) % 26] + letters[(n // 26 + 3 * k) % 26] for k in range(4)] for n in range(70)}
    rows = [(100 * n + i, syllables(100 * n + i, 40, own), lang) for n, (lang, own) in enumerate(parts.items()) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.learned(df.filter("doc_id % 6 <> 0").withColumnRenamed("doc_id", "id"))
    assert len(filters.tables) == 2
    right = langid.identified(df, filters).join(df, "doc_id").filter("lang_pred = lang").count()
    assert right >= 0.95 * len(rows)


def test_scores_beyond_a_long(spark):
    rows = [(0, [1e308, 1.0]), (1, [-1e308, 2.0]), (2, [1e200, 0.5]), (3, [0.5, 1e13]), (4, [-1e13, 1.0]), (5, [2.0**60 + 2.0**10, 0.0])]
    got = [(r.query_id, r.vec_id, r.score) for r in exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 3 == 0, k=9).collect()]
    whole = {i: [int(x * 256) if abs(x) < 2**52 else int(x) * 256 for x in v] for i, v in rows}
    for q in (0, 3):
        exact = {i: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))) for i, v in whole.items() if i != q}
        assert [(i, s) for a, i, s in got if a == q] == sorted(exact.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("asked", [1, 7])
def test_queries_in_several_shards(spark, monkeypatch, asked):
    from formlode.llm import topk

    monkeypatch.setattr(topk, "SHARD", 20)
    monkeypatch.setattr(topk, "ASKED", asked)
    draw = np.random.default_rng(3)
    vectors = draw.integers(-8, 9, (90, 3)) / 8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_top_k(df, F.col("vec_id") % 4 == 0, k=5).collect()}
    whole = np.floor(256 * vectors).astype(int)
    for q in range(0, 90, 4):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(90) if i != q)[:5]
        assert [got[q, n] for n in range(1, 6)] == [(i, -s) for s, i in best]


def test_learning_where_texts_of_one_label_are_missing(spark):
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(20)], "id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(20)] + [(99, 1)], "id long, label int")
    for learn in (toxicity.learned, quality_classifier.learned):
        for some in (labels, labels.filter("id < 0"), labels.filter("label = 1")):
            for own in (docs, docs.filter("id < 0")):
                scores = {r.score for r in toxicity.scored(docs, learn(own, some), id_col="id").collect()}
                assert len(scores) == 1 and 0 < min(scores) < 1
    twice = docs.union(docs).union(docs)
    texts, size, total = presence.labelled_texts(twice, labels.union(spark.createDataFrame([(3, 1)], labels.schema)), 1000)
    assert (texts.count(), size, total) == (21, {0: 20, 1: 1}, {0: 20, 1: 2})


def test_sample_of_a_label_that_most_rows_bear(spark):
    ids = spark.range(20_000).selectExpr("id", "if(id % 50 = 0, 1, 0) AS label")
    got = bounded_sample(ids, "label", 300, {0: 19_600, 1: 400})
    by = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert by == {0: 300, 1: 300}
    least = sorted(r.h for r in ids.filter("label = 0").select(F.xxhash64("id").alias("h")).collect())[:300]
    assert sorted(r.h for r in got.filter("label = 0").select(F.xxhash64("id").alias("h")).collect()) == least
    assert bounded_sample(ids, "label", 300, {}).count() == 0


@pytest.mark.parametrize("capacity, sizes", [(64, (1, 64)), (100, (34, 60)), (2048, (20, 21)), (1, (1, 1))])
def test_sweeps_fill_sequences(spark, capacity, sizes):
    draw = random.Random(capacity)
    own = [draw.randint(*sizes) for _ in range(700)]
    got = packing.placed(spark.createDataFrame(list(enumerate(own)), "id long, size long"), capacity).collect()
    assert sorted(r.id for r in got) == list(range(700))
    by = {}
    for r in got:
        by.setdefault(r.sequence, []).append((r.offset, own[r.id]))
    for places in by.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= capacity
    # Against best fit with decreasing sizes, one after the other.
    gaps = []
    for size in sorted(own, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= size]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= size
        else:
            gaps.append(capacity - size)
    assert len(by) <= 1.02 * len(gaps) + 1


def test_texts_of_one_template(spark, monkeypatch):
    """Many texts a little below the threshold: few rows are joined for each, and pairs above it are still found."""
    draw, base, rows = random.Random(3), prose(77, 400, 4000).split(), []
    for i in range(300):
        own = list(base)
        for at in draw.sample(range(400), 8):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    twin = rows[17][1].split()
    twin[5] = "twin"
    rows.append((900, " ".join(twin)))
    joined = []
    found = near_dup._across
    monkeypatch.setattr(near_dup, "_across", lambda rest, percent: joined.append(out := found(rest, percent)) or out)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5).collect()}
    assert got[900] == got[17]
    sets = {i: {tuple(t.split()[a : a + 5]) for a in range(396)} for i, t in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    for a, b in linked:
        assert got[a] == got[b]
    assert len(set(got.values())) >= 301 - len(linked)


def test_repeated_ids_are_hashed_once_a_row(spark):
    base = prose(3, 60).split()
    rows = [(None if i % 2 else 7, " ".join(base[:-1] + [f"w{i}"])) for i in range(2000)] + [(8, prose(99, 60)), (7, prose(98, 60))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == 7 for r in got if r.doc_id != 8)
    assert [r.component_id for r in got if r.doc_id == 8] == [8]
