"""An inverted-file index of vectors: stored lists around centres, of which a search reads the nearest few.

Centres are learned by Spark's k-means on a bounded sample; every vector is then put into the list of its nearest centre. How many lists
a search must read for a wanted recall is measured, not assumed: for sampled vectors with known neighbours, by the place of the
neighbours' lists in the order of the nearest centres.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import BLOCK, FOUND, SHARD, TOP, _tiles, _unit, _usable, cosine_topk, ranked

#: Vectors from which centres are learned, and those by which probes are chosen, at most.
SAMPLE, ASKED = 100_000, 500
#: Distances, and numbers of packed queries, that a Python worker holds at once: 4 MB of doubles.
CELLS = 1 << 19


@dataclasses.dataclass(frozen=True)
class Index:
    """A stored index: its folder, the centres (one row a list) and into how many parts each list is cut."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    parts: int

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")


def _sampled(rows: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """About ``most`` rows, chosen by hash of the key."""
    share = min(1.0, most / max(1, total))
    return rows.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)


def _nearest(centres: np.ndarray, many: int):
    """For each (id, vector) its ``many`` nearest lists, nearest first; as many rows at once as keep their distances to all centres small."""
    step = max(1, CELLS // len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                x = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(batch), -1)
                order = np.argsort(-(_unit(x) @ centres.T), axis=1, kind="stable")[:, :many].astype(np.int32)
                offsets = pa.array(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(order.ravel()))], [*batch.schema.names, "lists"])

    return run


def build_index(corpus: DataFrame, path: str, lists: int | None = None, rounds: int = 12) -> Index:
    """Learn ``lists`` centres (else about the root of the rows) and store each usable vector of the commonest length in a list below ``path``.

    corpus: vector_id, field_name, embedding. Lists are cut into as many parts as keep the largest one's within a tile's shard.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark, usable = corpus.sparkSession, _usable(corpus, "vector_id", "field_name")
    common = usable.groupBy("dim").count().agg(F.max(F.struct("count", "dim")).alias("m")).first().m
    if common is None:
        raise ValueError("no usable vector to index")
    usable, total = usable.filter(F.col("dim") == common.dim), common["count"]
    k = min(total, lists or max(1, round(total**0.5)))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    sample = _sampled(usable, "vector_id", SAMPLE, total).select(array_to_vector(F.transform("embedding", lambda x: x / norm)).alias("features"))
    # With one centre, or a sample without spread, k-means has nothing to do.
    model = KMeans(k=k, maxIter=rounds, seed=7, distanceMeasure="cosine").fit(sample) if k > 1 else None
    found = np.array(model.clusterCenters()) if model else np.ones((1, common.dim))
    centres = _unit(found[np.linalg.norm(found, axis=1) > 0])
    shape = "vector_id long, embedding array<double>, field_name string, dim int, lists array<int>"
    named = usable.select("vector_id", "embedding", "field_name", "dim").mapInArrow(_nearest(centres, 1), shape).withColumn("list", F.col("lists")[0]).drop("lists")
    largest = named.groupBy("list").count().agg(F.max("count")).first()[0]
    parts = max(1, -(-largest // SHARD))
    part = F.pmod(F.xxhash64("vector_id"), F.lit(parts))
    named.withColumn("part", part.cast("int")).repartition("list", "part").write.mode("overwrite").partitionBy("list", "part").parquet(f"{path}/lists")
    return Index(spark, path, centres, parts)


def probes_for(index: Index, recall: float = 0.95, top: int = TOP) -> int:
    """How many lists to read so that, of the true neighbours of some stored vectors (ASKED at most), this part lies in them."""
    rows = index.rows
    asked = _sampled(rows, "vector_id", ASKED, rows.count()).select(F.col("vector_id").alias("query_id"), "embedding")
    truth = cosine_topk(asked, rows, top).select("query_id", "vector_id").join(rows.select("vector_id", "list"), "vector_id")
    order = asked.mapInArrow(_nearest(index.centres, len(index.centres)), "query_id long, embedding array<double>, lists array<int>").select("query_id", "lists")
    places = truth.join(order, "query_id").select(F.array_position("lists", F.col("list")).alias("place"))
    found = places.agg(F.percentile("place", recall).alias("p")).first().p
    return len(index.centres) if found is None else max(1, int(np.ceil(found)))


def _by_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (id, vector, lists) packed by the lists that they ask; a query's vector is repeated for each, so few go at once."""
    for whole in batches:
        width, lists = (len(whole.column(i).flatten()) // max(1, len(whole)) for i in (1, 2))
        step = max(1, min(BLOCK, CELLS // max(1, width * lists)))
        for at in range(0, len(whole), step):
            yield _packed_by_list(whole.slice(at, step))


def _packed_by_list(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = np.asarray(batch.column(0), np.int64)
    x = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(ids), -1)
    lists = np.asarray(batch.column(2).flatten(), np.int32)
    owner = np.repeat(np.arange(len(ids)), len(lists) // max(1, len(ids)))
    order = np.argsort(lists, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(lists[order]) > 0][: len(lists)])
    groups = np.split(owner[order], first[1:]) if len(lists) else []
    arrays = [pa.array(lists[order][first], pa.int32()), pa.array([ids[g].tobytes() for g in groups], pa.binary()), pa.array([x[g].tobytes() for g in groups], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["list", "ids", "body"])


def _asking(centres: np.ndarray, many: int):
    """Queries (id, vector) packed by their ``many`` nearest lists, in one pass, so that a task has one Python worker."""
    nearest = _nearest(centres, many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_list(nearest(batches))

    return run


def index_topk(index: Index, queries: DataFrame, top: int = TOP, probes: int = 8) -> DataFrame:
    """(query_id, rank, vector_id, field_name, similarity): the nearest of what lies in each query's ``probes`` nearest lists.

    Exact within these lists and ranked as by cosine_topk(), without the query's own id. Queries of another length than the index's, or
    without direction, find nothing.
    """
    asked = _usable(queries, "query_id").filter(F.col("dim") == index.centres.shape[1]).select("query_id", "embedding")
    many, cuts = min(probes, len(index.centres)), max(1, -(-asked.count() // SHARD))
    blocks = asked.mapInArrow(_asking(index.centres, many), "list int, ids binary, body binary")
    # A list's queries are cut too: a list that many ask for would else gather them all in one task.
    sent = blocks.withColumn("cut", F.pmod(F.xxhash64("ids"), F.lit(cuts)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(index.parts - 1))))
    stored = index.rows.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    by = ["list", "part", "cut"]
    found = stored.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(_tiles(top, own_too=False), FOUND)
    return ranked(found, top)
