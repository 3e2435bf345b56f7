"""Periodic runs, whitening and the n-gram join against brute force, on small cases and on the smallest tables."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from formlode.llm import jaccard_join, whitening
from formlode.llm.jaccard_join import ngram_components
from formlode.llm.periodic_runs import WaveletTree, maximal_runs, periodic_runs
from formlode.llm.queries import QUERIES
from formlode.llm.whitening import whitened

from .test_operators import WORD, groups_by_brute_force, prose

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def runs_by_brute_force(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        at = 0
        while at < len(w) - q:
            begin = at
            while at < len(w) - q and w[at] == w[at + q]:
                at += 1
            size = at - begin + q
            if at > begin and size >= max(least, times * q) and not any(w[begin : begin + size - p] == w[begin + p : begin + size] for p in range(1, q)):
                out.append((begin, size, q))
            at += at == begin
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for start, size, q in found for i in range(start + q, start + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_range_successor():
    draw = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        values = draw.permutation(n)
        low, high, least = draw.integers(0, n + 1, 300), draw.integers(0, n + 1, 300), draw.integers(0, 2 * n, 300)
        low, high = np.minimum(low, high), np.maximum(low, high)
        want = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(low, high, least, strict=True)]
        assert WaveletTree(values).successor(low, high, least).tolist() == want


def test_maximal_runs():
    for seed in range(400):
        draw = random.Random(seed)
        w = [draw.randrange(draw.choice([1, 2, 3, 9])) for _ in range(draw.randrange(160))]
        for _ in range(draw.randrange(4) if w else 0):
            at, q = draw.randrange(len(w)), draw.randrange(1, 40)
            for i in range(at + q, draw.randrange(at, len(w) + 1)):
                w[i] = w[i - q]
        found = maximal_runs(np.array([-1, *w, -2]), 6, 4)
        assert [(a - 1, n, q) for a, n, q in zip(*map(np.ndarray.tolist, found), strict=True)] == runs_by_brute_force(w)


def test_runs_of_odd_texts(spark):
    long = " ".join([prose(1, 700)] * 60)
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "x y\ty y y\n\ny y y z", "é ü é ü é ü é ü é", long, long, prose(2, 3000)]
    docs = spark.createDataFrame([(None if i == 3 else i % 9, t, -1, "r") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, runs string")
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in periodic_runs(docs).collect())
    want = []
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        found = [(0, len(w), 700)] if t == long else runs_by_brute_force(w)
        want.append((i == 3, None if i == 3 else i % 9, len(w), found, collapsed(w, found)))
    assert got == sorted(want)
    assert periodic_runs(docs.filter("n_words > 0")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, times=3)


@needs_tables
def test_op13(spark):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for r in docs:
        w, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
            some += 1
        found = runs_by_brute_force(w)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digest = hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
        assert got[r.doc_id] == (len(found), *row, digest, hashlib.sha256(collapsed(w, found).encode()).hexdigest())
    assert some > 5


def against_numpy(rows, model_rows):
    """Rows (id, vector) against the rows of ``whitened``, with eigenvectors by NumPy."""
    x = {i: np.floor(256 * np.array(v, float)) for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, centre = len(fit), fit.mean(axis=0)
    values, basis = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, basis = values[::-1], basis[:, ::-1]
    got = {(r.vec_id, r.component): r for r in model_rows}
    for j in range(4):
        first = next(iter(x))
        sign = np.sign((x[first] - centre) @ basis[:, j] * got[first, j + 1].whitened)
        for i, v in x.items():
            r = got[i, j + 1]
            assert r.whitened == pytest.approx(sign * ((v - centre) @ basis[:, j]) / np.sqrt(values[j]), abs=1e-8)
            assert r.explained == pytest.approx(values[j] / values.sum(), rel=1e-10) and r.identity_error < 1e-9
            assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, fit.sum(axis=0), strict=True))
    assert len(got) == 4 * len(x)


@needs_tables
def test_op11(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    against_numpy(rows, QUERIES["op11_embedding_whitening"](spark, DATA).collect())


def test_whitening_of_odd_tables(spark):
    shape = "vec_id long, embedding array<float>, x int, n string"
    draw = np.random.default_rng(4)
    good = [(i, [float(a) for a in draw.normal(size=6) * [3, 2, 1.5, 1, 1, 1]]) for i in range(80)]
    rows = [(i, v, 1, "") for i, v in good] + [(90 + i, v, 2, "") for i, v in good[:30]]
    odd = [(200, None, 0, ""), (201, [], 0, ""), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, ""), (203, [float("nan")] * 6, 0, ""), (204, [1.0] * 5 + [float("inf")], 0, ""), (205, [1.0, 2.0], 0, "")]
    df = spark.createDataFrame(rows + odd, shape)
    against_numpy([r[:2] for r in rows], whitened(df).collect())
    assert whitened(df.filter("vec_id < 0")).count() == 0
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")], shape)).count() == 0
    two = whitened(spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [3.0, 2.0], 0, ""), (None, [3.0, 2.0], 0, "")], shape)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation, round(abs(r.whitened), 9), round(r.explained, 9)) for r in two) == [(i, 1, 2, 512**2, 1.0, 1.0) for i in (0, 1, 2)]


def test_whitening_of_equal_variances(spark):
    cross = [[float(s * (j == i)) for j in range(3)] for i in range(3) for s in (-1, 1)]
    flat = [[2 * a, 2 * b, c] for a, b, c in cross]
    for rows in (cross, flat):
        df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
        model = whitening.fit(whitening.usable_rows(df))
        values = np.linalg.eigvalsh(np.cov(256 * np.array(rows).T, bias=True))[::-1]
        assert model.variances == pytest.approx(values) and model.identity_error < 1e-12


def test_deviations_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [1e308, 1.0]), (2, [2.0, 1.0]), (3, [3.0, 3.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitened(df).collect()} == {2**63 - 1}


def near_copies(n, size=300, seed=3, most=8):
    draw, base = random.Random(seed), prose(seed, size, 5000).split()
    for i in range(n):
        own = list(base)
        for at in draw.sample(range(size), draw.randint(1, most)):
            own[at] = f"x{i}_{at}"
        yield " ".join(own)


@pytest.mark.parametrize("size, percent, turns", [(5, 80, 2), (2, 60, 2), (5, 80, 0)])
def test_ngram_components(spark, monkeypatch, size, percent, turns):
    monkeypatch.setattr(jaccard_join, "TURNS", turns)
    texts = [None, "", " \t", "a b", "A b", "a  b", "a b c", prose(1, 50), prose(1, 50).upper().replace("É", "é"), *near_copies(60), *near_copies(60, seed=4), prose(9, 20_000), prose(9, 20_000) + " end"]
    rows = [(i, t, i, "x", 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, k string, id int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(df, size=size, percent=percent).collect()}
    if percent == 80 and size == 5:
        assert got == {i: x[:2] for i, x in groups_by_brute_force(list(enumerate(texts)), size).items()}
    sets = {i: {tuple(w[a : a + size]) for a in range(len(w) - size + 1)} or ({tuple(w)} if w else set()) for i, t in enumerate(texts) for w in [WORD.findall((t or "").lower())]}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    assert got == {i: (len(sets[i]), label[i]) for i in sets}
    assert ngram_components(df.filter("doc_id < 0")).count() == 0


def test_ngram_components_with_null_and_repeated_ids(spark):
    a, b, c = (prose(i, 60) for i in (1, 2, 3))
    rows = [(None, a), (None, a), (7, a), (5, b), (5, c), (5, b), (None, "q w e"), (8, None)] + [(None, t) for t in near_copies(40)]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.n_shingles > 3, str(r.component_id)) for r in got.collect()) == sorted([("None", True, "7")] * 2 + [("7", True, "7")] + [("5", True, "5")] * 3 + [("None", False, "None"), ("8", False, "8")] + [("None", True, "None")] * 40)


def test_no_pairs_within_a_group(spark, monkeypatch):
    """A group's pairs are not listed: candidates stay a small multiple of its texts, also beside texts that share a part of them."""
    counts = []
    found = jaccard_join._linked_pairs
    monkeypatch.setattr(jaccard_join, "_linked_pairs", lambda pairs, *rest: counts.append(pairs.count()) or found(pairs, *rest))
    group = list(near_copies(400, most=3))
    apart = [" ".join([*t.split()[:230], *prose(i, 60, 9000).split()]) for i, t in enumerate(group[:40])]
    got = ngram_components(spark.createDataFrame(list(enumerate(group + apart)), "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id < 400} == {0}
    assert sum(counts) < 20 * len(got)


@needs_tables
def test_op12(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op12_ngram_jaccard"](spark, DATA).collect()}
    assert got == {i: x[:2] for i, x in groups_by_brute_force(texts, 5).items()}


def test_hashes_of_long_texts(monkeypatch):
    from formlode.llm import arrays

    text = prose(5, 4000) + " " + "y" * 9000 + " " + prose(6, 100)
    column = pa.array([text, None, text])
    whole = arrays.Words(arrays.Texts(column)).hash
    monkeypatch.setattr(arrays, "SLICE_BYTES", 300)
    assert (arrays.Words(arrays.Texts(column)).hash == whole).all() and (whole[: len(whole) // 2] == whole[len(whole) // 2 :]).all()


@needs_tables
def test_empty_tables(spark, tmp_path):
    for t in ("documents", "embeddings"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("op11_embedding_whitening", "op12_ngram_jaccard", "op13_periodic_runs"):
        empty = QUERIES[name](spark, str(tmp_path))
        assert empty.count() == 0 and empty.dtypes == QUERIES[name](spark, DATA).dtypes
