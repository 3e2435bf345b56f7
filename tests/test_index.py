"""The inverted-file index against the exact search."""

import numpy as np

from formlode.operators import index as ix
from formlode.operators.retrieval import ann_topk, cosine_topk


def table(spark, vectors, key="vector_id"):
    return spark.createDataFrame([(i, f"f{i % 3}", None if v is None else [float(x) for x in v]) for i, v in vectors], f"{key} long, field_name string, embedding array<float>")


def clustered(groups, each, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, 16))
    return [(g * each + i, centres[g] + 0.15 * draw.normal(size=16)) for g in range(groups) for i in range(each)]


def test_clusters_need_few_lists(spark, tmp_path):
    vectors = clustered(20, 40)
    corpus = table(spark, vectors)
    index = ix.build_index(corpus, str(tmp_path), lists=20)
    probes = ix.probes_for(index, 0.95)
    assert probes <= 5 and index.rows.count() == len(vectors)
    queries = table(spark, [v for v in vectors if v[0] % 7 == 0], "query_id")
    exact = {(r.query_id, r.vector_id): r.similarity for r in cosine_topk(queries, corpus).collect()}
    near = {(r.query_id, r.vector_id): r.similarity for r in ix.index_topk(index, queries, probes=probes).collect()}
    assert sum(near.get(k) == v for k, v in exact.items()) >= 0.9 * len(exact)
    whole = {(r.query_id, r.vector_id): r.similarity for r in ix.index_topk(index, queries, probes=99).collect()}
    assert whole == exact


def test_large_lists_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "SHARD", 30)
    vectors = clustered(2, 100)
    corpus, queries = table(spark, vectors), table(spark, vectors[::9], "query_id")
    index = ix.build_index(corpus, str(tmp_path), lists=2)
    assert index.parts >= 3
    assert {tuple(r) for r in ix.index_topk(index, queries, probes=2).collect()} == {tuple(r) for r in cosine_topk(queries, corpus).collect()}


def test_odd_vectors(spark, tmp_path):
    odd = [(100, None), (101, []), (102, [0.0] * 16), (103, [float("nan")] * 16), (104, [1.0, 2.0]), (105, [2.0, 4.5]), (106, [float("inf")] + [1.0] * 15)]
    good = clustered(3, 10)
    corpus, queries = table(spark, good + odd), table(spark, good[:4] + odd, "query_id")
    index = ix.build_index(corpus, str(tmp_path))
    found = ix.index_topk(index, queries, probes=99).collect()
    assert {r.query_id for r in found} == {0, 1, 2, 3} and all(r.vector_id < 100 for r in found)
    exact = [r for r in cosine_topk(queries, corpus).collect() if r.query_id >= 100]
    assert [(r.query_id, r.vector_id) for r in sorted(exact, key=lambda r: r.query_id)] == [(104, 105), (105, 104)]
    single = ix.build_index(table(spark, good[:1]), f"{tmp_path}/one")
    assert ix.index_topk(single, queries.filter("query_id < 100"), probes=1).count() == 3


def test_bucket_search_stores_no_pairs_and_ranks_as_the_exact_one(spark):
    rows = spark.createDataFrame([(i, f"n{i}", v.tolist()) for i, v in enumerate(np.random.default_rng(2).normal(size=(600, 16)))], "vector_id long, field_name string, embedding array<double>")
    asked = rows.filter("vector_id % 50 = 0").withColumnRenamed("vector_id", "query_id")
    near = ann_topk(asked, rows)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    exact = {(r.query_id, r.vector_id): r.similarity for r in cosine_topk(asked, rows, 600).collect()}
    got = near.collect()
    assert got and all(exact[r.query_id, r.vector_id] == r.similarity for r in got)
    assert not {(r.query_id, r.vector_id) for r in ann_topk(asked, rows, bucket=1e-3, tables=1).collect()} & {(i, i) for i in range(600)}
    assert ann_topk(asked, rows, bucket=1e-6, tables=1).count() < len(got)  # pairs without a common bucket are not found


def test_workers_hold_few_distances_and_copies():
    import pyarrow as pa

    draw = np.random.default_rng(3)
    centres, x = draw.normal(size=(2048, 8)), draw.normal(size=(3000, 8))
    rows = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(x.tolist())], ["query_id", "embedding"])
    near = list(ix._nearest(centres, 512)(iter([rows])))
    assert max(len(b) * len(centres) for b in near) <= ix.CELLS and sum(map(len, near)) == 3000
    blocks = list(ix._by_list(iter([pa.Table.from_batches(near).combine_chunks().to_batches()[0]])))
    assert max(sum(len(v) for v in b.column(2).to_pylist()) for b in blocks) <= 8 * ix.CELLS
    pairs = [(int(i), n) for b in blocks for n, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i in np.frombuffer(own, np.int64)]
    want = [(int(i), n) for b in near for i, own in zip(b.column(0).to_pylist(), b.column(2).to_pylist()) for n in own]
    assert sorted(pairs) == sorted(want)


def test_a_lists_queries_are_cut(spark, tmp_path, monkeypatch):
    tiles = ix._tiles

    def watched(*args, **kwargs):
        run = tiles(*args, **kwargs)

        def checked(shard, blocks):
            n = sum(len(x) // 8 for x in blocks.column("ids").to_pylist())
            assert n <= 200, n
            return run(shard, blocks)

        return checked

    vectors = clustered(2, 200)
    corpus, queries = table(spark, vectors), table(spark, vectors, "query_id").repartition(40)
    index = ix.build_index(corpus, str(tmp_path), lists=2)
    monkeypatch.setattr(ix, "SHARD", 60)
    monkeypatch.setattr(ix, "_tiles", watched)
    assert {tuple(r) for r in ix.index_topk(index, queries, probes=2).collect()} == {tuple(r) for r in cosine_topk(queries, corpus).collect()}


def test_tiles_hold_few_similarities():
    import tracemalloc

    import pyarrow as pa

    from formlode.operators import retrieval as re

    draw = np.random.default_rng(5)
    x, asked = draw.integers(-3, 4, (5000, 4)) + 0.5, draw.integers(-3, 4, (4000, 4)) + 0.5
    ids, own = np.arange(5000)[::-1], np.arange(4000)
    shard = pa.table({"vector_id": ids, "embedding": pa.array(x.tolist()), "field_name": [f"n{i}" for i in ids]})
    blocks = pa.table({"ids": [own[:3990].tobytes(), *[own[i : i + 1].tobytes() for i in range(3990, 4000)]], "body": [asked[:3990].tobytes(), *[asked[i : i + 1].tobytes() for i in range(3990, 4000)]]})
    tracemalloc.start()
    got = re._tiles(5, own_too=False)(shard, blocks)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert got.num_rows == 20_000 and peak < 40, peak
    found = got.to_pydict()
    for q in (0, 7, 3989, 3999):
        s = np.floor(re._unit(asked[q : q + 1]) @ re._unit(x).T * 1e6 + 0.5)[0] / 1e6
        want = sorted((-v, i) for v, i in zip(s.tolist(), ids.tolist(), strict=True) if i != q)[:5]
        at = [i for i, n in enumerate(found["query_id"]) if n == q]
        assert [(-found["similarity"][i], found["vector_id"][i]) for i in at] == want and all(found["field_name"][i] == f"n{found['vector_id'][i]}" for i in at)
