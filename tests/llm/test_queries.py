"""The registered corpus queries and the pipeline on the smallest tables, against SQL or brute force."""

import collections
import hashlib
import re
from pathlib import Path

import corpus_pipeline
import duckdb
import pytest

from formlode.llm.queries import ORACLES, QUERIES

from .test_operators import WORD, groups_by_brute_force, removed_by_brute_force

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    theirs = con.execute(ORACLES[name])
    names = [d[0] for d in theirs.description]
    assert sorted(tuple(r[n] for n in names) for r in QUERIES[name](spark, DATA).collect()) == sorted(map(tuple, theirs.fetchall()))


def test_op1(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_substring_dedup"](spark, DATA).collect()}
    assert got == {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in removed_by_brute_force(texts, 35).items()}


def test_op6(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op6_near_dup"](spark, DATA).collect()}
    assert got == groups_by_brute_force(texts, 4)


def test_op9_base_counts(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op9_quality_rules"](spark, DATA).collect()}
    for i, t in texts:
        w = WORD.findall(t or "")
        windows = [tuple(w[a : a + 3]) for a in range(len(w) - 2)]
        seen = collections.Counter(windows)
        inside = {a + k for a, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))


@pytest.mark.parametrize("name", ["op3_mixing", "op4_langid", "op5_toxicity", "op7_best_fit_packing", "op10_quality_classifier"])
def test_every_document_is_covered(spark, texts, name):
    assert {r.doc_id for r in QUERIES[name](spark, DATA).select("doc_id").collect()} == {i for i, _ in texts}


def test_held_out_languages_are_right(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_langid"](spark, DATA).filter("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_pipeline_stages(spark, texts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    shape = docs.columns
    by_name = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == shape
        by_name[name] = (before, docs)
    before, after = by_name["near duplicates"]
    pairs = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {i for i, (_, _, kept) in groups_by_brute_force(pairs, 5).items() if kept}
    before, after = by_name["repeated passages"]
    own = {r.doc_id: r.text for r in before.collect()}
    cut = removed_by_brute_force(list(own.items()), 50)
    assert {r.doc_id: r.text for r in after.collect()} == {i: (t if k else own[i]) for i, (n, k, t) in cut.items() if k < n or n == 0}
    before, after = by_name["mixing"]
    times = collections.Counter(r.doc_id for r in after.collect())
    assert set(times) == {r.doc_id for r in before.collect()} and min(times.values()) >= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == times
    places = collections.defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= corpus_pipeline.CAPACITY
