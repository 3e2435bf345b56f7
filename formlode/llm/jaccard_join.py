"""Exact Jaccard join of texts on word n-grams, by prefixes under several global token orders.

Of two sets similar enough, each may miss only a few of its tokens, so under any order of all tokens the two share one within their
first few, their prefixes. Tokens are ordered in three ways: from rare to common with ties broken by hash, the same with ties broken
otherwise, and by hash alone. Two sets are a candidate pair only if their prefixes meet under all three orders; the first order finds pairs,
the others are intersected with it before any full set is read, and what is left is verified on full sets.

How many texts hold a token is counted exactly, in packed rows: texts are dealt to bins, a bin sends each distinct token once to its hash
group, and the group answers with a code of the count for tokens that occur elsewhere too. A token of one text alone can't be
shared, so texts with too few others take no further part.

Texts with equal sets are one class. Classes with a common prefix token are compared with the smallest of them (a star), links give
components, buckets that still hold several components get further stars, and pairs of different components that remain are then
compared one by one. So the pairs within a group of near copies are never listed, and no link between two components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Texts, U, Words, mix, run_ends, runs, slices
from .graph import components
from .near_dup import _names, shingle_hashes
from .storage import written
from .substring_dedup import _bytes, _joined, _packed, _short, _table, bucket_counts

#: Rounds of stars around other members, for buckets that the first round did not join; they keep the pairwise rest small.
TURNS = 2
#: Steps of a token's code for each doubling of its count; counts from 2 to 2^31 have codes 8 to 248.
STEPS = 8
_SECOND, _THIRD = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)

SENT = pa.schema([("p", pa.int32()), ("b", pa.int32()), ("h", pa.binary()), ("times", pa.binary())])
CODED = pa.schema([("b", pa.int32()), ("p", pa.int32()), ("h", pa.binary()), ("code", pa.binary())])
ARRAYS = ["first", "second", "third", "members"]
SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ARRAYS]])


def _tokens(groups: int, size: int):
    """Each distinct token of a bin, and in how many of its texts it lies (255: or more)."""

    def run(table: pa.Table) -> pa.Table:
        parts = [shingle_hashes(Words(Texts(column, lower=True)), size)[0] for _, _, column in slices(table.column("_text"))]
        h = np.sort(_joined(parts, U))
        first = runs(h)
        times = np.minimum(run_ends(first, len(h)) - first, 255).astype(np.uint8)
        key = _short(h[first], groups)
        return _table(table.column("_b")[0].as_py(), _packed(key >> U(32), h=key.astype(np.uint32), times=times), SENT)

    return run


def _counted(table: pa.Table) -> pa.Table:
    """Of one hash group: the codes of tokens with two texts or more, back to each bin that sent them."""
    sent = _bytes(table, "h", np.uint32)
    h, times = _joined(sent, np.uint32), _joined(_bytes(table, "times", np.uint8), np.uint8)
    order = np.argsort(h, kind="stable")
    first = runs(h[order])
    total = np.add.reduceat(times[order].astype(np.int64), first)
    code = np.empty(len(h), np.uint8)
    code[order] = np.repeat(np.minimum(255, np.floor(STEPS * np.log2(total))).astype(np.uint8), run_ends(first, len(h)) - first)
    rows, at = [], 0
    for b, p, own in zip(table.column("b").to_pylist(), table.column("p").to_pylist(), sent, strict=True):
        some = at + np.flatnonzero(code[at : at + len(own)])
        at += len(own)
        if len(some):
            rows.append((b, p, h[some].tobytes(), code[some].tobytes()))
    return pa.table([pa.array([r[i] for r in rows], CODED.field(i).type) for i in range(4)], schema=CODED)


def _prefixes(own: np.ndarray, code: np.ndarray, least: int) -> list[np.ndarray]:
    """Of one set's tokens, those that others have too, in its prefix under each order, and all of them."""
    common = own[code > 0]
    rare = code[code > 0]
    room = len(own) - least + 1
    left = room - (len(own) - len(common))  # tokens of this text alone come first where rare ones do
    one = common[np.lexsort([common, rare])[:left]]
    two = common[np.lexsort([mix(common ^ _SECOND), rare])[:left]]
    at = np.argsort(mix(own ^ _THIRD))[:room]
    return [one, two, own[at[code[at] > 0]], common]


def _filtered(groups: int, size: int, percent: int):
    """(id, n, k) of each text; where it can have a partner, the prefixes and tokens of its set, once for each set of a bin."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        keys = _joined([(U(p) << U(32)) | h.astype(U) for p, h in zip(found.column("p").to_pylist(), _bytes(found, "h", np.uint32), strict=True)], U)
        codes = _joined(_bytes(found, "code", np.uint8), np.uint8)
        order = np.argsort(keys)
        keys, codes = keys[order], codes[order]
        out, met = [], set()
        for a, b, column in slices(table.column("_text")):
            hashes, bounds = shingle_hashes(Words(Texts(column, lower=True)), size)
            n = np.diff(bounds)
            code = np.zeros(len(hashes), np.uint8)
            if len(keys):
                key = _short(hashes, groups)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                code = np.where(keys[at] == key, codes[at], 0).astype(np.uint8)
            total = np.r_[0, np.cumsum(code > 0)]
            common = total[bounds[1:]] - total[bounds[:-1]]
            least = -(-n * percent // 100)
            names = _names(hashes, bounds)
            sets: list[list[np.ndarray] | None] = [None] * len(n)
            for i, k in enumerate(names.to_pylist()):
                if k is not None and common[i] >= least[i] and k not in met:
                    met.add(k)
                    own = slice(bounds[i], bounds[i + 1])
                    parts = _prefixes(hashes[own], code[own], int(least[i]))
                    if all(len(x) for x in parts):
                        sets[i] = parts
            lists = [pa.array([None if s is None else s[j].view(np.int64) for s in sets], pa.list_(pa.int64())) for j in range(len(ARRAYS))]
            out.append(pa.RecordBatch.from_arrays([table.column("_id").combine_chunks().slice(a, b - a), pa.array(n, pa.int64()), names, *lists], schema=SETS))
        return pa.Table.from_batches(out, schema=SETS)

    return run


def _linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sizes allow a link, whose prefixes meet under the other orders too, and whose full sets are similar enough.

    The three are asked in this order. Filters travel with the sets: most pairs that share a rare token pass them, so a pass of their
    own would move more than it saves.
    """
    side = lambda k: sets.select(F.col("k").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "second", "third", "members")])
    near = pairs.join(side("b"), "b").join(side("a"), "a").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    near = near.filter(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b"))
    both = F.size(F.array_intersect("members_a", "members_b")).cast("long")
    return near.filter(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets whose members bear different labels, with their label."""
    named = buckets.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
    several = named.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return named.join(several.select("s"), "s", "left_semi")


def _between(rest: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different labels that share a prefix token and, from there on, can share enough.

    Rows of a bucket's commonest label meet those of other labels only, so a large group costs no pairs of its own.
    """
    main = rest.groupBy("s", "label").count().groupBy("s").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    some = rest.join(main, "s").filter("label <> main").select("s", F.col("k").alias("a"), F.col("label").alias("of"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"))
    every = rest.select("s", F.col("k").alias("b"), "label", "n", "rest")
    most = F.least("rest_a", "rest")
    able = (F.col("of") != F.col("label")) & ((100 + percent) * most >= percent * (F.col("n") + F.col("n_a")))
    return some.join(every, "s").filter(able).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _linked(sets: DataFrame, percent: int) -> DataFrame:
    """(k, label): components of the classes in ``sets`` that have a link."""
    each = sets.select("k", "n", F.size("members").cast("long").alias("size"), F.posexplode("first").alias("at", "s"))
    tokens = each.select("s", "k", "n", (F.col("size") - F.col("at")).alias("rest"))
    stars = tokens.groupBy("s").agg(F.min("k").alias("a"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("s", "a")
    buckets = written(tokens.join(stars, "s"), "buckets")

    links = written(_linked_pairs(buckets.filter("a <> k").select("a", F.col("k").alias("b")).distinct(), sets, percent), "links")
    labels = components(links)
    for turn in range(TURNS + 1):
        rest = written(_mixed(buckets.drop("a"), labels), "unsettled")
        if not turn:  # only these are read again
            sets = written(sets.join(rest.select("k").distinct(), "k", "left_semi"), "sets")
        if turn < TURNS:
            by: Column = F.col("k").bitwiseXOR(F.xxhash64("s", F.lit(turn)))
            centres = rest.groupBy("s").agg(F.min_by("k", by).alias("c"), F.min_by("label", by).alias("other"))
            tried = rest.join(centres, "s").filter("label <> other").select(F.least("c", "k").alias("a"), F.greatest("c", "k").alias("b")).distinct()
        else:
            tried = _between(rest, percent)
        more = written(_linked_pairs(tried, sets, percent), "links")
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links)
    return labels


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``.

    Texts are lower-cased (A-Z) and cut into words; a text's set holds its distinct n-grams of ``size`` words, or its whole word
    sequence if that is shorter. Two texts are linked if 100 * intersection >= percent * union. component_id is the smallest id that
    can be reached by links. A null or empty text has no n-grams and is linked with nothing: its component is its own id. Rows
    with the same id are separate documents of one name; a null id is a component's only if all its ids are null. Other columns
    are ignored, an empty table gives an empty one. Sets and tokens are known by 64 bits of hash.
    """
    if not 0 < percent <= 100 or size < 1:
        raise ValueError("percent must be from 1 to 100, and size 1 at least")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    total = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bins, groups = bucket_counts(total)
    # Rows that repeat whole go to different bins, too.
    dealt = source.withColumn("_b", F.pmod(F.xxhash64("_id", "_text", F.monotonically_increasing_id()), F.lit(bins)).cast("int"))
    by_bin = dealt.groupBy("_b")
    sent = by_bin.applyInArrow(_tokens(groups, size), "p int, b int, h binary, times binary")
    coded = sent.groupBy("p").applyInArrow(_counted, "b int, p int, h binary, code binary")
    shape = "id long, n long, k long, " + ", ".join(f"{c} array<long>" for c in ARRAYS)
    signed = written(by_bin.cogroup(coded.groupBy("b")).applyInArrow(_filtered(groups, size, percent), shape), "texts")
    kept = [F.first(c).alias(c) for c in ["n", *ARRAYS]]
    sets = written(signed.filter("members IS NOT NULL").groupBy("k").agg(*kept), "sets")
    labels = _linked(sets, percent)

    classes = signed.filter("n > 0").groupBy("k").agg(F.min("id").alias("id"))
    named = classes.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
    least = named.groupBy("label").agg(F.min("id").alias("component"))
    by_class = named.join(least, "label").select("k", "component")
    out = signed.select("id", "n", "k").join(by_class, "k", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
