"""Features by presence in whole texts: counts of hash slots for each label, the choice of slots, and blocks of rows to fit on.

A ``present`` function of a slice of texts gives (text, slot) pairs, each once, for 2**BITS slots; with a table, (text, feature)
for those slots that are features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import runs, slices
from .storage import written
from .training import bounded_sample

#: Hash slots, as a power of two.
BITS = 20
Present = Callable[..., tuple[np.ndarray, np.ndarray]]


def distinct_pairs(owners: list[np.ndarray], slots: list[np.ndarray], table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each (owner, slot) once; with a table, each (owner, feature)."""
    owner, slot = np.concatenate(owners), np.concatenate(slots)
    if table is not None:
        feature = table[slot]
        owner, slot = owner[feature >= 0], feature[feature >= 0]
    pair = np.sort((owner.astype(np.int64) << BITS) | slot.astype(np.int64))
    pair = pair[runs(pair)]
    return pair >> BITS, pair & ((1 << BITS) - 1)


#: Bits by which documents are told to have no label, for each labelled id, and at most: 8 MB.
EACH, MOST = 16, 1 << 26


def likely(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """The documents whose id is among the ``n`` ids of ``known``, and a few others: of about 1 in EACH, more beyond MOST / EACH ids.

    One bit, by hash, stands for each known id, so that of the other documents few texts are shuffled to be joined. Ids of two
    types are left to the join.
    """
    if docs.schema["id"].dataType != known.schema["id"].dataType:
        return docs
    size = min(MOST, 1 << max(15, (EACH * n - 1).bit_length()))
    place = F.pmod(F.xxhash64("id", F.lit("bit")), F.lit(size))
    of, at = F.shiftright(place, 15), F.pmod(place, F.lit(1 << 15))
    bits = known.groupBy(of.alias("_of")).agg(F.bitmap_construct_agg(at).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1
    return docs.join(F.broadcast(bits), (of == F.col("_of")) & held, "left_semi")


def labelled_texts(docs: DataFrame, labels: DataFrame, rows: int | None = None) -> tuple[DataFrame | None, dict[int, int], dict[int, int]]:
    """(label, text, key) of each id with a label, the labels' counts among these, and among all labelled ids; key is a hash of the id.

    docs: (id, text); labels: (id, label), of which labels 0 and 1 with an id count. An id that several documents bear stands for
    the least of their texts, null being the empty one. The texts are None where no two labels are known. With ``rows``, at most so
    many ids of each label.
    """
    known = labels.filter("label IN (0, 1) AND id IS NOT NULL").select("id", F.col("label").cast("int").alias("label")).distinct()
    total = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(total) < 2:
        return None, {}, total
    chosen = known if rows is None else bounded_sample(known, "label", rows, total)
    texts = likely(docs, chosen, sum(total.values())).join(chosen, "id").groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    texts = written(texts.select("label", "text", F.xxhash64("id").alias("key")), "labelled")
    return texts, {r.label: r["count"] for r in texts.groupBy("label").count().collect()}, total


def _counted(present: Present):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(label, slot, times): in how many texts of the partition each slot occurs."""
        times = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            labels = np.asarray(batch.column(0))
            for a, b, column in slices(batch.column(1)):
                owner, slot = present(column)
                for label in (0, 1):
                    times[label] += np.bincount(slot[labels[a:b][owner] == label], minlength=1 << BITS).astype(np.int32)
        for label in (0, 1):
            slot = np.flatnonzero(times[label])
            made = [pa.array(np.full(len(slot), label, np.int32)), pa.array(slot), pa.array(times[label][slot].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(made, ["label", "slot", "times"])

    return run


def chosen_features(texts: DataFrame, size: dict[int, int], present: Present, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Which feature each slot is (-1: none), and the features' log-count ratios; the slots whose presence differs most."""
    n = [F.sum(F.when(F.col("label") == c, F.col("times")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    counted = texts.mapInArrow(_counted(present), "label int, slot long, times long").groupBy("slot").agg(*n)
    rated = counted.filter("n0 + n1 > 2").withColumns({f"rate{c}": (F.col(f"n{c}") + 1) / (size[c] + 2) for c in (0, 1)})
    both = (F.col("n0") + F.col("n1") + 1) / (sum(size.values()) + 2)
    apart = F.abs(F.col("rate1") - F.col("rate0")) / F.sqrt(both * (1 - both) + 1e-12)
    best = rated.orderBy(F.desc(apart), "slot").limit(features).select("slot", F.log(F.col("rate1") / F.col("rate0")).alias("ratio")).collect()
    table = np.full(1 << BITS, -1, np.int32)
    table[np.array([r.slot for r in best], np.int64)] = np.arange(len(best))
    return table, np.array([r.ratio for r in best], np.float64)


def _featured(present: Present, table: np.ndarray, more: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, column in slices(batch.column(1)):
                owner, feature = present(column, table)
                counts = np.bincount(owner, minlength=b - a)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(feature.astype(np.int16)))
                rows = more(column) if more else np.zeros((b - a, 0))
                stats = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), lists, stats], ["label", "key", "features", "stats"])

    return run


def featured(texts: DataFrame, present: Present, table: np.ndarray, more: Callable | None = None) -> DataFrame:
    """(label, key, features, stats) of every labelled text, stored: its features in order and further statistics."""
    rows = texts.select("label", "text", "key").mapInArrow(_featured(present, table, more), "label int, key long, features array<short>, stats array<double>")
    return written(rows, "features")


def unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The (row, value) pairs of a column of lists."""
    return np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists))), np.asarray(lists.flatten())


def _block(rows: pa.Table) -> pa.Table:
    # In the order of the keys, so that sums of doubles don't depend on how rows arrive.
    rows = rows.sort_by([("key", "ascending"), ("label", "ascending")])
    y = np.asarray(rows.column("label"), np.int8)
    lists = rows.column("features").combine_chunks()
    counts = np.asarray(pc.list_value_length(lists), np.int32)
    stats = np.asarray(rows.column("stats").combine_chunks().flatten(), np.float64)
    made = [[x.tobytes()] for x in (y, counts, np.asarray(lists.flatten(), np.int16), stats)]
    return pa.table([pa.array([int((y == 1).sum()) * int((y == 0).sum())], pa.int64()), *[pa.array(x, pa.binary()) for x in made]], names=["pairs", "y", "counts", "features", "stats"])


def blocks(rows: DataFrame, size: dict[int, int], paired: bool) -> DataFrame:
    """Rows of featured() in blocks by hash of the key, one packed row a block; all rows lie in one.

    paired: every block is to hold rows of both labels. Where one is rare, blocks are fewer and so larger; those that would grow
    beyond LARGEST rows are cut, and each part gets the block's rare rows.
    """
    rare = min(size, key=lambda c: (size[c], c))
    n = sum(size.values())
    many = max(1, -(-n // BLOCK))
    if paired:
        many = max(1, min(many, size[rare] // RARE))
    parts = max(1, -(-n // (many * LARGEST))) if paired else 1
    block = F.pmod(F.xxhash64("key", F.lit("block")), F.lit(many))
    part = F.explode(F.when(F.col("label") == rare, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts)).cast("int"))))
    dealt = rows.withColumn("block", block).withColumn("part", part)
    return written(dealt.groupBy("block", "part").applyInArrow(_block, "pairs long, y binary, counts binary, features binary, stats binary"), "blocks")


#: Rows of a block, about; rows of a rare label in a block with pairs, about; rows of one label in a part of a block, about.
BLOCK, RARE, LARGEST = 512, 16, 8192
#: Sums of gradients are whole numbers of this part of one, so that they don't depend on the order of blocks.
UNIT = 2.0**-50


def _sloped(gradient: Callable, w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sum of the gradients of a partition's blocks."""
        total = np.zeros(len(w), np.int64)
        for batch in batches:
            for y, counts, features, stats in zip(*(batch.column(i) for i in range(4)), strict=True):
                read = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
                label, n = read(y, np.int8), read(counts, np.int32)
                owner = np.repeat(np.arange(len(n)), n)
                found = gradient(w, label, owner, read(features, np.int16).astype(np.int64), read(stats, np.float64).reshape(len(n), -1))
                total += np.rint(found / UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return run


def descended(packed: DataFrame, gradient: Callable, width: int, decay: np.ndarray, steps: int, pace: float = 0.1) -> np.ndarray:
    """``width`` weights after so many steps of Adam over all blocks; each step is a job, whose tasks give one sum of gradients each.

    gradient: a function of the weights and a block's labels, (row, feature) pairs and statistics, so small that the sum over all
    blocks stays below 2000.
    """
    rows = packed.select("y", "counts", "features", "stats")
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for step in range(1, steps + 1):
        sums = rows.mapInArrow(_sloped(gradient, w), "total binary").collect()
        g = np.sum([np.frombuffer(r.total, np.int64) for r in sums], axis=0) * UNIT + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w
