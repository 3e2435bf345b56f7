"""Near-duplicate groups: one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

Texts with equal shingle sets form one class; only classes are compared. A bucket of n classes gives n - 1 candidate
edges, from its smallest class to each other one, and every candidate is confirmed on the full shingle sets. Confirmed
links give components. Buckets that still hold different components get further stars around other members. What stars
alone would lose is then settled exactly: classes from buckets that are still mixed are compared across components, with
candidates by exact prefix filtering on their rarest shared shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Texts, U, Words, mix, powers, runs, slices
from .graph import components
from .storage import written

#: 42 bands of 6 of the 256 bins: a pair of similarity 0.8 shares no band with a probability of 3 in a million.
BINS, ROWS, BANDS = 256, 6, 42
#: Rounds of stars around other members, for buckets that the first round did not join; they keep the exact rest small.
TURNS = 2
_BAND_BASE = 0xE7037ED1A0B428DB


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin (one more entry)."""
    count = words.last - words.first
    at = words.windows(size)
    hashes = words.window_hash(at, size)
    place = np.searchsorted(at, words.first)
    stop = np.searchsorted(at, words.last)
    short = np.flatnonzero((count > 0) & (count < size))
    whole = words.window_hash(words.first[short], count[short]) if len(short) else np.zeros(0, U)
    alone = dict(zip(short.tolist(), whole, strict=True))
    parts, bounds = [], [0]
    for i in range(len(count)):
        if i in alone:
            own = np.array([alone[i]], U)
        else:
            own = np.sort(hashes[place[i] : stop[i]])
            own = own[runs(own)]
        parts.append(own)
        bounds.append(bounds[-1] + len(own))
    return np.concatenate(parts) if parts else np.zeros(0, U), np.array(bounds)


def _probes() -> tuple[np.ndarray, np.ndarray]:
    at = mix(np.arange(BINS, dtype=U) + U(1))
    return (at % U(BINS)).astype(np.int64), (mix(at) % U(BINS) | U(1)).astype(np.int64)


def band_keys(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each non-empty set its band keys, as signed integers.

    The top bits of a hash are its bin, so the first hash of each bin in sorted order is the bin's minimum. An empty bin
    copies the first filled bin of a probe sequence that depends on the bin alone.
    """
    sets = np.flatnonzero(np.diff(bounds) > 0)
    owner = np.repeat(np.arange(len(sets)), np.diff(bounds)[sets])
    cell = owner * BINS + (((hashes >> U(32)) * U(BINS)) >> U(32)).astype(np.int64)
    first = runs(cell)
    filled = np.zeros(len(sets) * BINS, bool)
    value = np.zeros(len(sets) * BINS, U)
    filled[cell[first]] = True
    value[cell[first]] = hashes[first]
    start, step = _probes()
    open_cells = np.flatnonzero(~filled)
    for attempt in range(BINS):
        if not len(open_cells):
            break
        own_bin = open_cells % BINS
        source = open_cells - own_bin + (start[own_bin] + attempt * step[own_bin]) % BINS
        hit = filled[source]
        value[open_cells[hit]] = value[source[hit]]
        open_cells = open_cells[~hit]
    used = value.reshape(-1, BINS)[:, : ROWS * BANDS].reshape(-1, BANDS, ROWS)
    keys = mix((used * powers(_BAND_BASE, ROWS)).sum(axis=2, dtype=U))
    return mix(keys + np.arange(BANDS, dtype=U)).view(np.int64)


def _names(hashes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A 64-bit name of each set; null if it is empty."""
    n = np.diff(bounds)
    total = np.r_[U(0), np.cumsum(mix(hashes))]
    return pa.array(mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(U)).view(np.int64), mask=n == 0)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, column in slices(batch.column(1)):
                hashes, bounds = shingle_hashes(Words(Texts(column, lower=True)), size)
                n = np.diff(bounds)
                keys = band_keys(hashes, bounds)
                offsets = np.r_[0, np.cumsum(np.where(n > 0, BANDS, 0))].astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), _names(hashes, bounds), bands], ["id", "n", "k", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, column in slices(batch.column(0)):
                hashes, bounds = shingle_hashes(Words(Texts(column, lower=True)), size)
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([_names(hashes, bounds), sets], ["k", "members"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough."""
    left = sets.select(F.col("k").alias("a"), F.col("members").alias("sa"))
    right = sets.select(F.col("k").alias("b"), F.col("members").alias("sb"))
    na, nb = F.size("sa"), F.size("sb")
    near = pairs.join(right, "b").join(left, "a").filter(100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return near.filter(100 * both >= percent * (na + nb - both)).select("a", "b")


def _unsettled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, k, label) of the buckets whose members bear different labels."""
    named = buckets.join(labels, "k", "left").select("band", "k", F.coalesce("label", "k").alias("label"))
    mixed = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return named.join(mixed.select("band"), "band")


def _across(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels among (k, members, label) that can be similar enough, by prefix filtering.

    Shingles that only one label has cannot be shared across labels. Two similar sets share one of the rarest of the others: at
    most as many as may be missing, and one more. For the larger set of a pair that is percent of its own size, for the smaller
    one more is asked, as the larger counts as well; so a shingle brings together the short prefixes of smaller sets and the
    longer ones of larger sets. The first shingle that two sets share also bounds how many can follow.
    """
    each = rest.select("k", "label", F.explode("members").alias("s"))
    shared = each.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("uses")).filter("low < high").select("s", "uses")
    own = each.select("k", "s").join(shared, "s").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("uses", "s"))).alias("shared"))
    sized = rest.select("k", "label", F.size("members").cast("long").alias("n")).join(own, "k").withColumn("c", F.size("shared").cast("long"))
    room = F.col("c") - F.ceil(F.col("n") * percent / 100) + 1
    short = F.col("c") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    rare = F.posexplode(F.slice("shared", F.lit(1), room.cast("int"))).alias("at", "rare")
    prefix = sized.filter(room > 0).select("k", "label", "n", "c", short.alias("short"), rare)
    prefix = written(prefix.select("k", "label", "n", "c", "at", "rare.s", (F.col("at") < F.col("short")).alias("small")), "prefix")
    other = prefix.drop("small").toDF("b", "other", "m", "d", "to", "s")
    least = percent * (F.col("n") + F.col("m"))
    most = F.least(F.col("c") - F.col("at"), F.col("d") - F.col("to"))
    ordered = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))
    near = ordered & (F.col("label") != F.col("other")) & (100 * F.col("n") >= percent * F.col("m")) & ((100 + percent) * most >= least)
    found = prefix.filter("small").drop("small").withColumnRenamed("k", "a").join(other, "s").filter(near)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``.

    Texts are lower-cased (A-Z) and cut into words; a text's set holds its distinct shingles of ``shingle`` words, or its whole
    word sequence if that is shorter. Two texts are linked if 100 * intersection >= percent * union. component_id is the
    smallest id that can be reached, kept is whether the id is that one. A null or empty text has no shingles and is
    linked with nothing: its component is its own id. Rows with the same id are separate documents of one name. A null id never
    is a component's id unless all its ids are null; its row is then not kept. Sets are known by 64 bits of hash.
    """
    body = F.col(f"`{text}`").cast("string").alias("text")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), body)
    signed = written(source.mapInArrow(_signatures(shingle), "id long, n long, k long, bands array<long>"), "signatures")
    classes = signed.filter("n > 0").groupBy("k").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    banded = classes.select("k", F.explode("bands").alias("band"))
    stars = banded.groupBy("band").agg(F.min("k").alias("a"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = written(banded.join(stars, "band").select("band", "a", "k"), "buckets")
    pairs = written(buckets.filter("a <> k").select("a", F.col("k").alias("b")).distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b"))).distinct()
    chosen = classes.join(ends, "k", "left_semi").select("k", "id")
    texts = source.join(chosen.select(F.col("id").alias("own")), F.col("id").eqNullSafe(F.col("own")), "left_semi").select("text")
    # An id may name several rows, of other texts or of the same one: each is hashed once, and only the classes asked for stay.
    sets = texts.mapInArrow(_sets(shingle), "k long, members array<long>").join(chosen.select("k"), "k", "left_semi")
    sets = sets.groupBy("k").agg(F.first("members").alias("members"))
    sets = written(sets, "sets")
    links = written(_confirmed(pairs, sets, percent), "links")
    labels = components(links)

    for turn in range(TURNS):
        rest = written(_unsettled(buckets, labels), "unsettled")
        by = F.col("k").bitwiseXOR(F.xxhash64("band", F.lit(turn)))
        centres = rest.groupBy("band").agg(F.min_by("k", by).alias("a"), F.min_by("label", by).alias("other"))
        tried = rest.join(centres, "band").filter("label <> other").select(F.least("a", "k").alias("a"), F.greatest("a", "k").alias("b")).distinct()
        more = written(_confirmed(tried, sets, percent), "links")
        if more.isEmpty():
            break
        links = links.union(more)
        labels = components(links)
    rest = written(_unsettled(buckets, labels).select("k", "label").distinct(), "unsettled")
    across = written(_across(sets.join(rest, "k"), percent), "across")
    if not across.isEmpty():
        more = written(_confirmed(across, sets, percent), "links")
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links)

    joined = classes.select("k", "id").join(labels, "k")
    least = joined.groupBy("label").agg(F.min("id").alias("component"))
    by_class = classes.select("k", "id").join(joined.select("k", "label"), "k", "left").join(least, "label", "left")
    by_class = by_class.select("k", F.coalesce("component", "id").alias("component"))
    out = signed.select("id", "n", "k").join(by_class, "k", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
