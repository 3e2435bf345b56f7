"""Bounded, reproducible samples of labelled rows, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; null for a null id."""
    return F.crc32(id_column.cast("string")) % modulus


def bounded_sample(ids: DataFrame, label: str, most: int, totals: dict) -> DataFrame:
    """At most ``most`` distinct (id, label) of each label, those of the smallest hash.

    totals: the rows of each label. Only ids whose hash lies below a share of its range that lets through half as many again as
    are wanted go on to be ranked, so that ranking sees few rows of each label, however many rows bear it. Labels without a
    total are left out. Repeated rows count once.
    """
    limits = []
    for name, n in totals.items():
        share = min(1.0, (1.5 * most + 100) / max(1, n))
        limits += [F.lit(name), F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1)).cast("long")]
    if not limits:
        return ids.select("id", label).limit(0)
    h = F.xxhash64("id")
    low = ids.filter(h <= F.element_at(F.create_map(*limits), F.col(label))).select("id", label).distinct()
    order = Window.partitionBy(label).orderBy(h, "id")
    return low.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).drop("_rank")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def sparse_logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, decay: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-penalised logistic model of sparse rows, by full-batch Adam."""
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=values * w[columns], minlength=len(y)) + b
        error = (sigmoid(z) - y) / max(1, len(y))
        g = np.r_[np.bincount(columns, weights=values * error[rows], minlength=width) + decay * w, error.sum()]
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b
