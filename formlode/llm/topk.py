"""Exact inner-product top-k: tiled matrix products of query blocks and candidate shards, merged in a tree.

Queries and candidates are both cut into shards of bounded size, and each pair of shards is one task's work: blocks of queries
times tiles of candidates, whose scores are reduced to the best k of each query at once, so a tile never leaves its task.
Lists are then merged in two levels. The query set is stated by the caller.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a query block and of a tile's candidates, which bound a tile to 16 MB of scores.
BLOCK, TILE = 512, 4096
#: Candidates of a shard and queries of a shard, about.
SHARD, ASKED = 16_384, 16_384
LEAST, MOST = -(2**63), 2**63 - 1


def usable(vector: Column) -> Column:
    """Neither null nor empty, and without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(pa.chunked_array(column).combine_chunks().flatten(), np.float64).reshape(-1, dim)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries of one partition, packed by length and shard into blocks."""
    open_blocks: dict[tuple[int, int], list[tuple[int, list[float]]]] = {}

    def packed(key: tuple[int, int]) -> pa.RecordBatch:
        rows = open_blocks.pop(key)
        ids = np.array([r[0] for r in rows], np.int64)
        body = np.array([r[1] for r in rows], np.float64)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([ids.tobytes()]), pa.array([body.tobytes()])], ["dim", "part", "ids", "body"])

    for batch in batches:
        for i, vector, part in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            key = (len(vector), part)
            rows = open_blocks.setdefault(key, [])
            rows.append((i, vector))
            if len(rows) == BLOCK:
                yield packed(key)
    for key in list(open_blocks):
        yield packed(key)


def _whole(x: np.ndarray) -> list[list[int]]:
    """floor(256 * x) of each component, exactly."""
    return [[int(v) * 256 if abs(v) >= 2.0**52 else math.floor(256 * v) for v in row] for row in x.tolist()]


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of floor(256 * x): by doubles while every partial sum is below 2**53, else by Python's integers.

    A product beyond the range of a long becomes the end of that range.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        q, r = np.floor(256.0 * queries), np.floor(256.0 * rows)
        if np.abs(q).max() * np.abs(r).max() * q.shape[1] < 2.0**53:
            return q @ r.T
    whole = _whole(rows)
    return np.array([[min(MOST, max(LEAST, sum(a * b for a, b in zip(x, y, strict=True)))) for y in whole] for x in _whole(queries)], np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores without the query's own row, ties to smaller ids."""
    keep = np.flatnonzero(ids != own)
    scores, ids = scores[keep], ids[keep]
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
        scores, ids = scores[near], ids[near]
    order = sorted(range(len(ids)), key=lambda i: (-int(scores[i]), int(ids[i])))[:k]
    return scores[order], ids[order]


def _tiles(k: int):
    def run(shard: pa.Table, blocks: pa.Table) -> pa.Table:
        out: dict[int, list[tuple[int, int]]] = {}
        if shard.num_rows and blocks.num_rows:
            dim = shard.column("dim")[0].as_py()
            ids = np.asarray(shard.column("vec_id"), np.int64)
            rows = _matrix(shard.column("embedding"), dim)
            for packed_ids, body in zip(blocks.column("ids").to_pylist(), blocks.column("body").to_pylist(), strict=True):
                own = np.frombuffer(packed_ids, np.int64)
                queries = np.frombuffer(body, np.float64).reshape(-1, dim)
                for at in range(0, len(rows), TILE):
                    scores = _products(queries, rows[at : at + TILE])
                    for q, line in zip(own.tolist(), scores, strict=True):
                        best, which = _best(line, ids[at : at + TILE], k, q)
                        out.setdefault(q, []).extend((int(s), int(i)) for s, i in zip(best, which, strict=True))
        top = {q: sorted(v, key=lambda x: (-x[0], x[1]))[:k] for q, v in out.items()}
        s = shard.column("shard")[0].as_py() if shard.num_rows else 0
        lists = [[{"score": a, "vec_id": b} for a, b in v] for v in top.values()]
        return pa.table([pa.array(list(top), pa.int64()), pa.array([s] * len(top), pa.int32()), pa.array(lists, pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())])))], names=["query_id", "shard", "top"])

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k highest integer inner products of floor(256 * x).

    Candidates are all usable rows but those that carry the query's own id; only vectors of equal length are compared.
    Ties go to the smaller id. A vector that is null or empty or holds a null or non-finite component takes no part, nor
    does a row with a null id. Rows that repeat an id count as one vector each as candidates; as queries, equal rows count
    once and differing rows of one id share their list. Fewer than k candidates give fewer rows, an empty table none. A score
    beyond the range of a long is the end of that range, and such scores tie. Other columns are ignored.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("dim", F.size("embedding"))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked"))
    most = sizes.agg(F.max("n"), F.max("asked")).first()
    shards, parts = max(1, -(-(most[0] or 0) // SHARD)), max(1, -(-(most[1] or 0) // ASKED))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int")).withColumn("part", every(parts))
    asked = rows.filter("asks").select("vec_id", "embedding").dropDuplicates(["vec_id", "embedding"])
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    blocks = asked.mapInArrow(_blocks, "dim int, part int, ids binary, body binary")
    sent = blocks.withColumn("shard", every(shards))
    by = ["dim", "shard", "part"]
    lists = mine.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(_tiles(k), "query_id long, shard int, top array<struct<score:long,vec_id:long>>")

    def order(a: Column, b: Column) -> Column:
        first = (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["vec_id"] < b["vec_id"]))
        return F.when(first, -1).when((a["score"] == b["score"]) & (a["vec_id"] == b["vec_id"]), 0).otherwise(1)

    def merged(df: DataFrame, *by: str) -> DataFrame:
        best = F.slice(F.array_sort(F.flatten(F.collect_list("top")), order), 1, k)
        return df.groupBy(*by).agg(best.alias("top"))

    fan = max(2, int(shards**0.5))
    near = merged(lists.withColumn("branch", F.pmod("shard", F.lit(fan))), "query_id", "branch")
    final = merged(near, "query_id").select("query_id", F.posexplode("top").alias("pos", "hit"))
    return final.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
