"""Vector retrieval: exact and approximate cosine candidates, match decisions, upserts and embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD, TOP = 0.75, 5
#: Queries of a block and vectors of a tile, which bound a tile's similarities to 8 MB.
BLOCK, TILE, SHARD = 512, 2048, 16_384


def normalise(vector: Column, digits: int = 8) -> Column:
    """Unit vector, rounded; null for a vector of length zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: F.round(x / norm, digits)))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


FOUND = "query_id long, vector_id long, field_name string, similarity double"


def _joined(blocks: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The packed queries (ids, vectors) in runs of at most BLOCK: small blocks are put together, large ones are cut."""
    ids, rows, n = [], [], 0
    for i, (own, body) in enumerate(zip(blocks.column("ids"), blocks.column("body"), strict=True), 1):
        ids.append(np.frombuffer(own.as_buffer(), np.int64))
        rows.append(np.frombuffer(body.as_buffer(), np.float64).reshape(len(ids[-1]), -1))
        n += len(ids[-1])
        if n >= BLOCK or i == blocks.num_rows:
            own, body = np.concatenate(ids), np.concatenate(rows)
            for at in range(0, n, BLOCK):
                yield own[at : at + BLOCK], body[at : at + BLOCK]
            ids, rows, n = [], [], 0


def _tiles(top: int, own_too: bool, tables: int = 0):
    """The best ``top`` of each query in a shard. The last ``tables`` entries of a vector are buckets, of which a pair must share one."""

    def run(shard: pa.Table, blocks: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        ids = np.asarray(shard.column("vector_id"), np.int64)
        if shard.num_rows and blocks.num_rows:
            rows = np.asarray(shard.column("embedding").combine_chunks().flatten(), np.float64).reshape(shard.num_rows, -1)
            width = rows.shape[1] - tables
            vectors, buckets = _unit(rows[:, :width]), rows[:, width:]
            for own, asked in _joined(blocks):
                queries = _unit(asked[:, :width])
                best: list[list] = [[] for _ in own]
                for at in range(0, len(vectors), TILE):
                    scores = queries @ vectors[at : at + TILE].T
                    scores *= 1e6
                    scores += 0.5
                    np.floor(scores, out=scores)
                    scores /= 1e6
                    if tables:
                        met = np.zeros(scores.shape, bool)
                        for t in range(tables):
                            met |= asked[:, width + t, None] == buckets[None, at : at + TILE, t]
                        scores[~met] = -2.0
                    for place, (q, line) in enumerate(zip(own.tolist(), scores, strict=True)):
                        if not own_too:
                            line = np.where(ids[at : at + TILE] == q, -2.0, line)
                        near = np.flatnonzero(line >= np.partition(line, -top)[-top]) if len(line) > top else np.arange(len(line))
                        # Below -1 is the query's own, or what it has not met.
                        best[place] = sorted(best[place] + [(-line[i], ids[at + i], at + i) for i in near if line[i] >= -1])[:top]
                found = [(q, at, -s) for q, own_best in zip(own.tolist(), best, strict=True) for s, _, at in own_best]
                out.append(tuple(np.array([f[i] for f in found], kind) for i, kind in enumerate((np.int64, np.int64, np.float64))))
        asked_by, places, similarity = (np.concatenate(x) for x in zip(*out, strict=True))
        names = shard.column("field_name").cast(pa.string()).take(pa.array(places))
        return pa.table([pa.array(asked_by), pa.array(ids[places]), names, pa.array(similarity)], names=["query_id", "vector_id", "field_name", "similarity"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (id, vector) in blocks of one length."""
    open_blocks: dict[int, tuple[list, list]] = {}

    def block(dim: int) -> pa.RecordBatch:
        ids, rows = open_blocks.pop(dim)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([np.concatenate(rows).tobytes()])], ["dim", "ids", "body"])

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids, rows = open_blocks.setdefault(len(v), ([], []))
            ids.append(i)
            rows.append(np.asarray(v.values, np.float64))
            if len(ids) == BLOCK:
                yield block(len(v))
    for dim in list(open_blocks):
        yield block(dim)


def _nonzero(vector: Column) -> Column:
    """Has a direction: some entry is not zero, and all are finite."""
    some = F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    return some & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def _usable(vectors: DataFrame, key: str, *names: str) -> DataFrame:
    """The vectors that have a direction, and their length dim."""
    rows = vectors.filter(_nonzero(F.col("embedding"))).select(F.col(key).cast("long").alias(key), *names, F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.withColumn("dim", F.size("embedding"))


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each query's (query_id, vector_id, field_name, similarity), ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vector_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vector_id", "field_name", "similarity")


def cosine_topk(queries: DataFrame, corpus: DataFrame, top: int = TOP, own_too: bool = False) -> DataFrame:
    """(query_id, rank, vector_id, field_name, similarity): the nearest ``top`` of the corpus for each query.

    Shards of queries meet shards of the corpus in matrix products; each tile keeps its best of every query, and these are
    ranked. A vector with the query's id is left out unless ``own_too``. Null, empty and zero vectors are skipped and so are those
    with a null or non-finite entry; only vectors of equal length are compared. Similarities are rounded to 6 digits, ties go to
    the smaller id.
    """
    return _searched(_usable(corpus, "vector_id", "field_name"), _usable(queries, "query_id"), top, _tiles(top, own_too))


def _searched(usable: DataFrame, asked: DataFrame, top: int, tiles: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """The ranked best of all shards of queries (query_id, embedding) and corpus (vector_id, field_name, embedding, dim)."""
    shards, parts = (max(1, -(-rows.count() // SHARD)) for rows in (usable, asked))
    dealt = usable.withColumn("shard", F.pmod(F.xxhash64("vector_id"), F.lit(shards)).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # Packed blocks bear random parts, so that queries and corpus are both cut into shards of bounded size.
    blocks = asked.select("query_id", "embedding").mapInArrow(_packed, "dim int, ids binary, body binary").withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    by = ["dim", "shard", "part"]
    found = dealt.groupBy(*by).cogroup(blocks.groupBy(*by)).applyInArrow(tiles, FOUND)
    return ranked(found, top)


def match_decision(queries: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Matched from the threshold on, else the best candidate only; the margin to the second is 0 if there is none."""
    ranked = candidates.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.struct("field_name", "similarity", "vector_id"))).alias("one"), F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("two"))
    rows = queries.select("query_id").join(ranked, "query_id", "left")
    hit = F.coalesce(F.col("one.similarity") >= threshold, F.lit(False))
    margin = F.coalesce(F.round(F.col("one.similarity") - F.col("two"), 6), F.lit(0.0))
    return rows.select("query_id", hit.alias("matched"), F.when(hit, F.col("one.field_name")).alias("name"), F.when(~hit, F.col("one.field_name")).alias("best_candidate"), F.col("one.similarity").alias("confidence"), margin.alias("margin"))


def self_retrieval(sample: DataFrame, corpus: DataFrame, least: float = 0.99) -> DataFrame:
    """Whether each sampled vector's own nearest is itself."""
    best = cosine_topk(sample.select(F.col("vector_id").alias("query_id"), "embedding"), corpus, 1, own_too=True)
    return best.select(F.col("query_id").alias("vector_id"), ((F.col("query_id") == F.col("vector_id")) & (F.col("similarity") >= least)).alias("found"))


def vector_upsert(runtime: DataFrame, source: DataFrame, described: list[str], learned: dict[str, object], key: str = "vector_id") -> DataFrame:
    """Source refreshes descriptive columns, runtime keeps learned ones; new ids start from the given values."""
    a = runtime.select(key, F.lit(True).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in [*described, *learned]])
    b = source.select(key, F.lit(True).alias("_s"), *[F.col(c).alias(f"_s_{c}") for c in described])
    rows = a.join(b, key, "full")
    kept = [F.when(F.col("_s"), F.col(f"_s_{c}")).otherwise(F.col(f"_r_{c}")).alias(c) for c in described]
    state = [F.when(F.col("_r"), F.col(f"_r_{c}")).otherwise(F.lit(v)).alias(c) for c, v in learned.items()]
    return rows.select(key, *kept, *state, F.col("_r").isNull().alias("added"))


def vector_source(files: DataFrame, content: str, schema: str) -> DataFrame:
    """The vectors of JSON documents that hold a list of them, or an object with such a list under ``vectors``."""
    body = F.trim(F.col(content))
    listed = F.when(body.startswith("{"), F.get_json_object(body, "$.vectors")).otherwise(body)
    return files.select(F.explode(F.from_json(listed, f"array<struct<{', '.join(':'.join(x.split()) for x in schema.split(','))}>>")).alias("v")).select("v.*")


def source_check(vectors: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Each row with the first of the required columns that it lacks, or null."""
    missing = F.coalesce(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in required])
    return vectors.withColumn("missing", missing)


#: Digits that embeddings are kept to.
DIGITS = 8


def hashed_embedding(texts: list[str], width: int = 64) -> np.ndarray:
    """A deterministic bag-of-words embedding: words are hashed to signed places, rows have unit length.

    Each distinct word of a batch is hashed once; a text without words gives zeros.
    """
    import zlib

    words = [text.lower().split() for text in texts]
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    code, distinct = pd.factorize(np.array([w for own in words for w in own], object))
    h = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in distinct], np.int64)
    out = np.zeros((len(texts), width))
    if len(code):
        np.add.at(out, (owner, (h % width)[code]), np.where(h >> 31, 1.0, -1.0)[code])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1.0, norm)


def embedder(model: Callable[[list[str]], np.ndarray] = hashed_embedding, batch_texts: int = 1024):
    """An iterator pandas UDF of the model, to be used on columns or registered by name; the model gets ``batch_texts`` texts at most.

    Values are doubles of DIGITS digits; a null text is embedded as an empty one.
    """

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, rows = batch.fillna("").tolist(), []
            for at in range(0, len(texts), batch_texts):
                rows.extend(np.round(np.asarray(model(texts[at : at + batch_texts]), np.float64), DIGITS) + 0.0)
            yield pd.Series(rows, dtype=object)

    return embed


def embed_missing(rows: DataFrame, text: str, model: Callable[[list[str]], np.ndarray] = hashed_embedding) -> DataFrame:
    """Embeds only rows without a usable embedding; the others pass through."""
    usable = F.coalesce(F.size("embedding") > 0, F.lit(False)) & _nonzero(F.col("embedding"))
    have, lack = rows.filter(usable), rows.filter(~usable)
    return have.unionByName(lack.withColumn("embedding", embedder(model)(F.col(text)).cast(rows.schema["embedding"].dataType)))


def reembed_corrected(vectors: DataFrame, corrections: DataFrame, model: Callable[[list[str]], np.ndarray] = hashed_embedding) -> DataFrame:
    """Vectors that were corrected, embedded anew from their text and the corrected name."""
    fixed = vectors.join(corrections, "vector_id").withColumn("text", F.concat("text", F.lit(" corrected:"), "corrected_to"))
    return fixed.withColumn("embedding", embedder(model)(F.col("text")))


def ann_topk(queries: DataFrame, corpus: DataFrame, top: int = TOP, bucket: float = 0.6, tables: int = 8) -> DataFrame:
    """Approximate nearest, without the query's own id: of the vectors that share a random-projection bucket, ranked exactly by cosine.

    Buckets travel with their vectors as further entries, and pairs are matched in the tiles of the exact search: no pair and no copy of
    a vector for each of its buckets is stored. Vectors have one length.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    usable, asked = _usable(corpus, "vector_id", F.lit(None).cast("string").alias("field_name")), _usable(queries, "query_id")
    unit = lambda df: df.withColumn("v", array_to_vector(normalise(F.col("embedding"))))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=5).fit(unit(usable))
    buckets = F.concat(*[vector_to_array(F.col("h")[t]) for t in range(tables)])
    # ``dim`` keys the shards and is also the length of what they hold.
    marked = lambda df: model.transform(unit(df)).withColumn("embedding", F.concat("embedding", buckets)).withColumn("dim", F.size("embedding")).drop("v", "h")
    return _searched(marked(usable), marked(asked), top, _tiles(top, own_too=False, tables=tables)).drop("field_name")
