"""Toxicity scores by a character n-gram linear classifier with naive Bayes log-count ratios as feature scales.

The n-grams of each class are counted over whole texts, by presence; an n-gram's feature value is its log-count ratio between
the classes, and a penalised logistic model is fitted on those values. Only n-grams whose presence differs most between the
classes are kept as features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Grams, Texts, slices
from .presence import BITS, blocks, chosen_features, descended, distinct_pairs, featured, labelled_texts
from .training import sigmoid

SIZES = (4, 6)
#: Features kept.
FEATURES = 4096


def present(column: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The character n-grams of each text: (text, slot) or, with a table, (text, feature), each once."""
    texts = Texts(column, lower=True)
    owners, slots = [], []
    for n in SIZES:
        grams = Grams(texts, n)
        slot = grams.slot(BITS)
        at = np.arange(len(slot)) if table is None else np.flatnonzero(table[slot] >= 0)
        owners.append(np.searchsorted(grams.bounds, at, side="right") - 1)
        slots.append(slot[at])
    return distinct_pairs(owners, slots, table)


class Model:
    """Which slots are features, the weight of each, and the intercept."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, intercept: float):
        self.table, self.weights, self.intercept = table, weights, intercept

    def scores(self, column: pa.Array) -> np.ndarray:
        owner, feature = present(column, self.table)
        return sigmoid(np.bincount(owner, weights=self.weights[feature], minlength=len(column)) + self.intercept)


def _gradient(ratio: np.ndarray, rows: int):
    def run(w: np.ndarray, y: np.ndarray, owner: np.ndarray, feature: np.ndarray, _) -> np.ndarray:
        z = np.bincount(owner, weights=ratio[feature] * w[feature], minlength=len(y)) + w[-1]
        error = (sigmoid(z) - y) / rows
        return np.r_[np.bincount(feature, weights=ratio[feature] * error[owner], minlength=len(ratio)), error.sum()]

    return run


def learned(docs: DataFrame, labels: DataFrame, features: int = FEATURES, decay: float = 1e-4, steps: int = 150) -> Model:
    """A model from (id, text) and (id, label) rows with labels 0 and 1: from the texts of all labelled ids.

    The intercept is set for the share of label 1 among all labelled ids, also those without a text. Without texts of both
    labels every score is that share (0.5 without any label). Null texts are empty, rows of one id count as one, texts of any
    length are read whole.
    """
    texts, size, total = labelled_texts(docs, labels)
    prior = (total.get(1, 0) + 0.5) / (sum(total.values()) + 1)
    logit = float(np.log(prior / (1 - prior)))
    table, ratio = np.full(1 << BITS, -1, np.int32), np.zeros(0)
    if len(size) == 2:
        table, ratio = chosen_features(texts, size, present, features)
    if not len(ratio):
        return Model(table, np.zeros(1), logit)
    packed = blocks(featured(texts, present, table), size, paired=False)
    w = descended(packed, _gradient(ratio, sum(size.values())), len(ratio) + 1, np.r_[np.full(len(ratio), decay), 0.0], steps)
    return Model(table, w[:-1] * ratio, w[-1] + logit - float(np.log(size[1] / size[0])))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.scores(column) for _, _, column in slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["id", "score"])

    return run


def scored(docs: DataFrame, model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of each row, from its whole text, however long; a null text scores as the empty one.

    Each row is scored by itself, so repeated rows have equal scores; columns beside the id and the text are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(_score(model), f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.withColumnRenamed("id", id_col)
