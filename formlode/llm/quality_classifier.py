"""Quality scores by Bradley-Terry pairwise ranking.

Preference pairs put a good document above a bad one. The probability that one wins is the logistic function of the
difference of their scores, which are linear in the words and word pairs that a document holds and in statistics of its text, so
the fit is logistic on feature differences. All labelled documents are dealt to blocks, and all pairs of a block are taken. A score quantile, that of the share of bad documents among the labelled ones, becomes
the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Texts, U, Words, runs
from .presence import BITS, blocks, chosen_features, descended, distinct_pairs, featured, labelled_texts, unpacked
from .storage import written
from .training import sigmoid

#: Words and word pairs kept as features.
FEATURES = 4096
#: Different scores among which the threshold is looked up on the driver, at most.
FEW = 20_000
#: The score that the threshold quantile is mapped to.
THRESHOLD = 0.3
NAMES = ("upper", "digit", "symbol", "exclaim", "stop", "comma", "line", "wide", "word_length", "word_spread", "words", "new_words", "new_lines", "one_letter")

_CLASSES = np.full(256, 0, np.uint8)
for _n, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>=_~^\\{}[]@+", b"!?", b".", b",;:", b"\n", bytes(range(128, 192))), 1):
    _CLASSES[list(_set)] = _n


def statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text, in the order of NAMES; an empty text's are zero."""
    texts = Texts(column)
    bytes_ = np.maximum(1, texts.ends - texts.starts)
    kind = _CLASSES[texts.data]
    out = np.zeros((len(texts), len(NAMES)))
    for i in range(1, 9):
        total = np.r_[0, np.cumsum(kind == i)]
        out[:, i - 1] = np.sqrt((total[texts.ends] - total[texts.starts]) / bytes_)
    words = Words(texts)
    n = np.maximum(1, words.last - words.first)
    size = (words.ends - words.starts).astype(np.float64)
    owner = np.repeat(np.arange(len(texts)), words.last - words.first)
    mean = np.bincount(owner, weights=size, minlength=len(texts)) / n
    square = np.bincount(owner, weights=size * size, minlength=len(texts)) / n
    out[:, 8], out[:, 9], out[:, 10] = np.log1p(mean), np.log1p(np.sqrt(np.maximum(0, square - mean * mean))), np.log1p(words.last - words.first)
    for i in range(len(texts)):
        own = np.sort(words.hash[words.first[i] : words.last[i]])
        lines = [x for x in texts.raw(i).split(b"\n") if x.strip()]
        out[i, 11] = len(runs(own)) / n[i] if len(own) else 0.0
        out[i, 12] = len(set(lines)) / len(lines) if lines else 0.0
    out[:, 13] = np.sqrt(np.bincount(owner, weights=size == 1, minlength=len(texts)) / n)
    return out


def present(column: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words and word pairs of each text in lower case: (text, slot) or, with a table, (text, feature), each once."""
    words = Words(Texts(column, lower=True))
    owner = np.repeat(np.arange(len(column)), words.last - words.first)
    at = words.windows(2)
    slots = [(h >> U(64 - BITS)).astype(np.int64) for h in (words.hash, words.window_hash(at, 2))]
    return distinct_pairs([owner, owner[at]], slots, table)


class Model:
    """The features' table and weights, centres, scales and weights of the statistics, and the threshold."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray, slopes: np.ndarray, threshold: float):
        self.table, self.weights, self.centre, self.scale, self.slopes, self.threshold = table, weights, centre, scale, slopes, threshold

    def scores(self, column: pa.Array) -> np.ndarray:
        owner, feature = present(column, self.table)
        z = np.clip((statistics(column) - self.centre) / self.scale, -6, 6)
        strength = _strength(owner, feature, len(column), self.weights) + z @ self.slopes
        return sigmoid(strength - self.threshold + np.log(THRESHOLD / (1 - THRESHOLD)))


def _values(owner: np.ndarray, n: int) -> np.ndarray:
    """What each (text, feature) pair counts: less in a text that has many."""
    return 1.0 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=n)))[owner]


def _strength(owner: np.ndarray, feature: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    return np.bincount(owner, weights=_values(owner, n) * w[feature], minlength=n)


def _scaled(stats: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((stats - centre) / scale, -6, 6)


def _gradient(width: int, centre: np.ndarray, scale: np.ndarray, pairs: int):
    """The slope of the mean loss of pairs over a block: each pair's error times the difference of its rows' features, row by row."""

    def run(w: np.ndarray, y: np.ndarray, owner: np.ndarray, feature: np.ndarray, stats: np.ndarray) -> np.ndarray:
        z = _scaled(stats, centre, scale)
        strength = _strength(owner, feature, len(y), w[:width]) + z @ w[width:]
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        error = (sigmoid(strength[good, None] - strength[None, bad]) - 1) / pairs
        each = np.zeros(len(y))
        each[good], each[bad] = error.sum(1), -error.sum(0)
        return np.r_[np.bincount(feature, weights=_values(owner, len(y)) * each[owner], minlength=width), z.T @ each]

    return run


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each statistic, from sums of millionths, which don't depend on the order of rows."""
    stat = [F.get("stats", F.lit(i)) for i in range(len(NAMES))]
    sums = rows.agg(F.count(F.lit(1)), *[F.sum(F.round(x * 1e6).cast("long")) for x in stat], *[F.sum(F.round(x * x * 1e6).cast("long")) for x in stat]).first()
    mean, square = (np.array(sums[a : a + len(NAMES)], np.float64) / 1e6 / sums[0] for a in (1, 1 + len(NAMES)))
    return mean, np.maximum(np.sqrt(np.maximum(0, square - mean * mean)), 1e-3)


def _strengths(weights: np.ndarray, slopes: np.ndarray, centre: np.ndarray, scale: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, feature = unpacked(batch.column(1))
            stats = np.asarray(batch.column(2).flatten(), np.float64).reshape(len(batch), -1)
            strength = _strength(owner, feature.astype(np.int64), len(batch), weights) + _scaled(stats, centre, scale) @ slopes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(strength)], ["label", "strength"])

    return run


def weighted_quantile(rows: DataFrame, weight: dict[int, float], share: float, few: int = FEW) -> float:
    """The middle between the (label, strength) at which ``share`` of the labels' weight is reached and the next larger strength.

    Exact: the range is narrowed by counts in a thousand bins until few different strengths are left.
    """
    rows = written(rows.groupBy("strength", "label").count(), "strengths")
    w = F.when(F.col("label") == 1, weight[1]).otherwise(weight[0]) * F.col("count")
    all_ = rows.agg(F.min("strength").alias("low"), F.max("strength").alias("high"), F.count(F.lit(1)).alias("n"), F.sum(F.col("count") * (F.col("label") == 1).cast("int")).alias("ones"), F.sum("count").alias("rows")).first()
    goal = share * (weight[1] * all_.ones + weight[0] * (all_.rows - all_.ones))
    low, high, n, below = all_.low, all_.high, all_.n, 0.0
    inside = lambda a, b: F.col("strength").between(a, b)
    while n > few and low < high:
        at = F.least(F.lit(999), F.floor((F.col("strength") - low) / ((high - low) / 1000)).cast("int"))
        bins = rows.filter(inside(low, high)).groupBy(at.alias("at")).agg(F.sum(w).alias("w"), F.min("strength").alias("low"), F.max("strength").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()
        for i, b in enumerate(bins):
            if below + b.w >= goal or i == len(bins) - 1:
                break
            below += b.w
        if (b.low, b.high) == (low, high):
            break
        low, high, n = b.low, b.high, b.n
    left = sorted((r.strength, r.w) for r in rows.filter(inside(low, high)).groupBy("strength").agg(F.sum(w).alias("w")).collect())
    reached = below + np.cumsum([x for _, x in left])
    found = left[min(int(np.searchsorted(reached, goal)), len(left) - 1)][0]
    after = rows.filter(F.col("strength") > found).agg(F.min("strength")).first()[0]
    return (found + (found if after is None else after)) / 2


def learned(docs: DataFrame, labels: DataFrame, features: int = FEATURES, decay: float = 1e-3, steps: int = 120) -> Model:
    """A model from (id, text) and (id, label) rows with labels 0 and 1: from the texts of all labelled ids.

    The threshold is the score quantile at the share of label 0 among all labelled ids, the labels weighted to that share. Without
    texts of both labels all scores are equal. Null texts are empty, rows of one id count as one, texts of any length are read whole.
    """
    texts, size, total = labelled_texts(docs, labels)
    if len(size) < 2:
        zero = np.zeros(len(NAMES))
        return Model(np.full(1 << BITS, -1, np.int32), np.zeros(1), zero, zero + 1, zero, 0.0)
    table, ratio = chosen_features(texts, size, present, features)
    rows, width = featured(texts, present, table, statistics), max(1, len(ratio))
    centre, scale = _moments(rows)
    packed = blocks(rows, size, paired=True)
    pairs = packed.agg(F.sum("pairs")).first()[0]
    w = descended(packed, _gradient(width, centre, scale, max(1, pairs)), width + len(NAMES), np.full(width + len(NAMES), decay), steps)
    strength = rows.select("label", "features", "stats").mapInArrow(_strengths(w[:width], w[width:], centre, scale), "label int, strength double")
    threshold = weighted_quantile(strength, {c: total[c] / size[c] for c in (0, 1)}, total[0] / (total[0] + total[1]))
    return Model(table, w[:width], centre, scale, w[width:], float(threshold))
