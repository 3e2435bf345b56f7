"""Best-fit packing of tokenised documents into sequences of fixed capacity, in bulk-synchronous sweeps.

Pieces are worked off from the largest sizes down, one range of sizes after the other. A sweep range-sorts the range's pieces
together with all gaps, so that every piece stands behind the gaps that can hold it, and hands out gaps by rank: where several
pieces have the same successor gap, the larger one gets it and the next goes to the next wider gap that is left, as brackets
match. Ranks come from a running count of gaps less pieces, carried over the sorted partitions by their totals; a piece and
its gap are neighbours among the rows of one count. Gaps then shrink by what they took and the sweep repeats while it places a
good share of the pieces. What remains is sorted again and opens new sequences with as many consecutive pieces as fit.

Every sweep is a distributed sort and a window over groups of at most two rows for each size; the driver holds only totals of
partitions and of sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import slices
from .storage import written
from .tokens import token_ids

#: Rows of a range-sorted partition, about.
SORTED_ROWS = 1 << 20
#: A sweep is repeated while it places at least one of so many pieces.
WORTH = 4


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than the capacity."""
    head = length % capacity
    return ([(0, head)] if head else []) + [(at, capacity) for at in range(head, length, capacity)]


def _pieces(capacity: int, end_id: int, with_ids: bool, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, column in slices(batch.column(1)):
                ids, bounds = token_ids(column, folder)
                rows, piece, start, length, crc, own = [], [], [], [], [], []
                for i in range(len(column)):
                    doc = np.r_[ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)].astype("<u4")
                    for n, (at, size) in enumerate(cut(len(doc), capacity)):
                        rows.append(a + i)
                        piece.append(n)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(doc[at : at + size].tobytes()))
                        if with_ids:
                            own.append(doc[at : at + size])
                made = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    made.append(pa.array(own, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(made, names)

    return run


def size_ranges(capacity: int) -> list[tuple[int, int]]:
    """(low, high]: sizes of which one, two, three, .. fit a sequence, finer for large sizes."""
    parts, most = [1, 2, 3, 4, 6, 8, 12], 16
    while most <= capacity:
        parts.append(most)
        most *= 2
    edges = sorted({capacity // n for n in parts} | {0}, reverse=True)
    return [(low, high) for high, low in zip(edges, edges[1:], strict=False)]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a sorted partition; depth: gaps before a gap, or up to a piece, less the pieces taken off."""
    part, at, depth = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        piece = np.asarray(batch.column(2), np.int64)
        after = depth + np.cumsum(1 - 2 * piece)
        own = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(after - (1 - piece))]
        at, depth = at + n, int(after[-1]) if n else depth
        yield pa.RecordBatch.from_arrays([*batch.columns, *own], ["id", "size", "piece", "part", "at", "depth"])


def _parts(n: int) -> int:
    return max(4, -(-n // SORTED_ROWS))


def _ordered(rows: DataFrame, n: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``rows`` (id, size, piece) from the largest size down, gaps before pieces; for each partition rows and depth before it."""
    order = [F.desc("size"), F.asc("piece"), F.asc("id")]
    dealt = rows.select("id", "size", "piece").repartitionByRange(_parts(n), *order).sortWithinPartitions(*order)
    done = written(dealt.mapInArrow(_numbered, "id long, size long, piece int, part int, at long, depth long"), "ordered")
    sums = {r.part: (r.n, r.gain) for r in done.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - 2 * F.col("piece")).alias("gain")).collect()}
    before, passed, depth = [], 0, 0
    for part in range(max(sums, default=-1) + 1):
        before.append((passed, depth))
        n, gain = sums.get(part, (0, 0))
        passed, depth = passed + n, depth + gain
    return done, before


def _of_part(values: list[int]) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("part"))


def _swept(pieces: DataFrame, gaps: DataFrame, n: int) -> DataFrame:
    """One sweep: every row with the row that it is matched with, if any (mate, mate_size)."""
    done, before = _ordered(gaps.withColumn("piece", F.lit(0)).unionByName(pieces.withColumn("piece", F.lit(1))), n)
    level = (F.col("depth") + _of_part([depth for _, depth in before])).alias("level")
    order = Window.partitionBy("level").orderBy("part", "at")
    me = F.struct("id", "size")
    mate = F.when(F.col("piece") == 1, F.lag(me).over(order)).otherwise(F.lead(me).over(order))
    matched = done.select("id", "size", "piece", "part", "at", level).withColumn("mate", mate)
    # Few rows are written as few files, which many sweeps would else multiply.
    return written(matched.select("id", "size", "piece", F.col("mate.id").alias("mate"), F.col("mate.size").alias("mate_size")).coalesce(_parts(n)), "swept")


def segments(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int]], int, int]:
    """How pieces, so many of each size and in descending order, are cut into sequences of consecutive pieces.

    (rank, pieces a sequence, number of the first sequence) of each stretch; then the full sequences and the pieces left over.
    """
    cuts, rank, opened, end = [], 0, 0, 0
    for size in sorted(counts, reverse=True):
        end += counts[size]
        if rank < end:
            fit = capacity // size
            n = -(-(end - rank) // fit)
            cuts.append((rank, fit, opened))
            rank, opened = rank + n * fit, opened + n
    if rank > end:  # the last sequence would not be full
        opened -= 1
        return cuts, opened, end - (rank - cuts[-1][1])
    return cuts, opened, 0


def _opened(cuts: list[tuple[int, int, int]], before: list[int]):
    """(id, size, sequence, place) by rank, sequences from 0."""
    rank, fit, first = (np.array([c[i] for c in cuts], np.int64) for i in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(3), np.int64) + np.array(before, np.int64)[np.asarray(batch.column(2))]
            cut_ = np.searchsorted(rank, own, side="right") - 1
            made = [batch.column(0), batch.column(1), pa.array(first[cut_] + (own - rank[cut_]) // fit[cut_]), pa.array((own - rank[cut_]) % fit[cut_])]
            yield pa.RecordBatch.from_arrays(made, ["id", "size", "sequence", "place"])

    return run


def placed(loads: DataFrame, capacity: int) -> DataFrame:
    """(id, sequence, offset) of every row of ``loads`` (id, size), whose ids differ and whose sizes are 1 to the capacity."""
    shape = "id long, sequence long, offset long"
    sizes = {r.size: r["count"] for r in loads.groupBy("size").count().collect()}  # at most one row for each size
    out = [loads.sparkSession.createDataFrame([], shape)]
    none = loads.sparkSession.createDataFrame([], "id long, size long")
    gaps, rest, n_rest, sequences, ranges = none, none, 0, 0, size_ranges(capacity)
    ranges = [r for r in ranges if any(r[0] < s <= r[1] for s in sizes)]
    for low, high in ranges:
        pieces = rest.unionByName(loads.select("id", "size").filter((F.col("size") > low) & (F.col("size") <= high)))
        n = n_rest + sum(c for s, c in sizes.items() if low < s <= high)
        while n and sequences:
            swept = _swept(pieces, gaps, n + sequences)
            took = swept.filter("piece = 1 AND mate IS NOT NULL")
            out.append(took.select("id", F.col("mate").alias("sequence"), (capacity - F.col("mate_size")).alias("offset")))
            gaps = swept.filter("piece = 0").select("id", (F.col("size") - F.coalesce("mate_size", F.lit(0))).alias("size")).filter("size > 0")
            pieces = swept.filter("piece = 1 AND mate IS NULL").select("id", "size")
            found = took.count()
            n -= found
            if found * WORTH < n + found:
                break
        rest, n_rest = none, 0
        if not n:
            continue
        done, before = _ordered(pieces.withColumn("piece", F.lit(1)), n)
        counts = {r.size: r["count"] for r in done.groupBy("size").count().collect()}
        cuts, opened, left = segments(counts, capacity)
        if (low, high) == ranges[-1] and left:
            opened, left = opened + 1, 0
        made = done.select("id", "size", "part", "at").mapInArrow(_opened(cuts, [passed for passed, _ in before]), "id long, size long, sequence long, place long")
        own = Window.partitionBy("sequence").orderBy("place")
        made = made.withColumns({"offset": F.sum("size").over(own) - F.col("size"), "total": F.sum("size").over(Window.partitionBy("sequence"))})
        made = written(made.coalesce(_parts(n)), "opened")
        full = made.filter(F.col("sequence") < opened).withColumn("sequence", F.col("sequence") + sequences)
        out.append(full.select("id", "sequence", "offset"))
        gaps = gaps.unionByName(full.filter("place = 0").select(F.col("sequence").alias("id"), (capacity - F.col("total")).alias("size")).filter("size > 0"))
        rest, n_rest = made.filter(F.col("sequence") >= opened).select("id", "size"), left
        sequences += opened
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def pack_sequences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False, folder: str | None = None) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A document is its token ids and ``end_id``; a null or empty text is ``end_id`` alone. Only documents longer than the
    capacity are cut, into pieces of the capacity of which the first may be shorter. Sequences are gapless from offset 0.
    Repeated rows are packed as often as they occur, rows with a null id too; an empty table gives no rows; columns beside the id
    and the text are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    shape = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = source.mapInArrow(_pieces(capacity, end_id, with_ids, folder), shape)
    # Written once, so that the keys stay the same.
    pieces = written(pieces.withColumn("key", F.monotonically_increasing_id()), "pieces")
    places = placed(pieces.select(F.col("key").alias("id"), F.col("length").alias("size")), capacity).withColumnRenamed("id", "key")
    both = pieces.join(places, "key")
    return both.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), "offset", *["ids"] * with_ids)
