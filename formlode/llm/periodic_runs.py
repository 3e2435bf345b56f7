"""Maximal periodic runs of words, by internal pattern matching.

Texts are cut into words and many texts are handled as one sequence, each between words that occur nowhere else. Dyadic blocks
of 2^k words start at every multiple of 2^(k-1) words. A block's occurrences are an interval of the suffix array; a wavelet tree
over the suffix array answers where in the neighbouring window the block occurs next (range successor). Blocks whose next
occurrences lie at one distance p form a progression, and p is a candidate period: a run of at least four periods q holds a
block of between q and 2q words and its next occurrence, which is q words away, as the block is longer than the period. So
each period is looked for at one size of blocks only, and no run is missed. Progressions are then extended word by word.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Texts, Words, covered, runs, slices, texts_of

#: Words compared at once where a run is extended.
STEP = 32
RUNS = "array<struct<start:long,length:long,period:long>>"


class WaveletTree:
    """A permutation of 0..n-1, bit by bit from the highest: smallest value of a range of places that is not below a given one."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.bits = max(1, int(n - 1).bit_length()) if n else 1
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            before = np.zeros(n + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[~one], values[one]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each range [low, high) of places, the smallest value of at least ``least``; -1 where there is none."""
        left, right, smaller = low.astype(np.int32), high.astype(np.int32), np.zeros(len(low), np.int32)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = zeros[left], zeros[right]
            one = (least >> bit & 1).astype(bool)
            smaller += np.where(one, b - a, 0)
            left, right = np.where(one, zeros[-1] + left - a, a), np.where(one, zeros[-1] + right - b, b)
        some = np.flatnonzero((smaller < high - low) & (least >> self.bits == 0))
        out = np.full(len(low), -1, np.int64)
        left, right, rest, value = low[some].astype(np.int32), high[some].astype(np.int32), smaller[some], np.zeros(len(some), np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = zeros[left], zeros[right]
            one = rest >= b - a
            rest = np.where(one, rest - (b - a), rest)
            value |= one.astype(np.int64) << bit
            left, right = np.where(one, zeros[-1] + left - a, a), np.where(one, zeros[-1] + right - b, b)
        out[some] = value
        return out


def _blocks(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, block starts, block sizes, where each block's interval begins and ends), of blocks that occur twice or more.

    Prefix doubling sorts only what still has equal beginnings; what differs within its first words keeps its place. The last
    name must be unique.
    """
    order = np.argsort(names)
    first = runs(names[order])
    many = np.diff(np.r_[first, len(order)])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.repeat(first, many)
    size = np.empty(len(order), np.int64)
    size[first] = many
    open_at = np.flatnonzero(np.repeat(many, many) > 1)
    found, length = [], 1
    while len(open_at):
        at = order[open_at]
        key = rank[at] * len(order) + rank[at + length]
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[open_at] = at
        first = runs(key)
        many = np.diff(np.r_[first, len(key)])
        begin = open_at[first]
        rank[at] = np.repeat(begin, many)
        size[begin] = many
        open_at = open_at[np.repeat(many, many) > 1]
        length *= 2
        starts = order[open_at]
        starts = starts[starts % (length // 2) == 0]
        found.append((starts, np.full(len(starts), length), rank[starts], rank[starts] + size[rank[starts]]))
    parts = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
    return order, *parts


def _reach(names: np.ndarray, at: np.ndarray, period: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from ``at`` on, in one direction, equal those a period further on; the ends of ``names`` are unique."""
    total, todo, step = np.zeros(len(at), np.int64), np.arange(len(at)), np.arange(STEP)
    while len(todo):
        if forward:
            to = np.minimum((at[todo] + period[todo] + total[todo])[:, None] + step, len(names) - 1)
            same = names[to] == names[to - period[todo, None]]
        else:
            to = np.maximum((at[todo] - total[todo])[:, None] - step, 0)
            same = names[to] == names[to + period[todo, None]]
        n = np.where(same.all(axis=1), STEP, same.argmin(axis=1))
        total[todo] += n
        todo = todo[n == STEP]
    return total


def maximal_runs(names: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of at least ``least`` names and ``times`` (four or more) periods, by start and period.

    Both ends of ``names`` must be unique.
    """
    order, at, size, low, high = _blocks(names)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    following = WaveletTree(order).successor(low, high, at + 1)
    period = following - at
    good = (following >= 0) & (2 * period >= size) & (period < size)
    at, size, period = at[good], size[good], period[good]
    by = np.lexsort([at, period])
    at, size, period = at[by], size[by], period[by]
    if not len(at):
        return none, none, none
    # The words from at to at + size equal those a period further on; stretches that touch are one.
    opens = np.r_[True, (period[1:] != period[:-1]) | (at[1:] > at[:-1] + size[:-1])]
    first = np.flatnonzero(opens)
    last = np.r_[first[1:], len(at)] - 1
    begin, end, period = at[first], at[last] + size[last], period[first]
    begin = begin - _reach(names, begin - 1, period, forward=False)
    length = end + _reach(names, end, period, forward=True) - begin + period
    good = length >= np.maximum(least, times * period)
    found = np.unique(np.stack([begin[good], period[good], length[good]], axis=1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def _collapsed(texts: Texts, words: Words, dropped: np.ndarray) -> list[bytes]:
    out = []
    for i in range(len(texts)):
        mask, own = dropped[words.first[i] : words.last[i]], texts.raw(i).split()
        out.append(b" ".join(itertools.compress(own, ~mask) if mask.any() else own))
    return out


def _found(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, column in slices(batch.column(batch.num_columns - 1)):
                texts = Texts(column)
                words = Words(texts)
                # Each text between names that occur once: word w of text i stands at w + i + 1.
                text_of = np.repeat(np.arange(len(texts)), words.last - words.first)
                place = np.arange(len(words)) + text_of + 1
                names = np.empty(len(words) + len(texts) + 1, np.int64)
                _, name = np.unique(words.hash, return_inverse=True)
                names[:] = -1 - np.arange(len(names))
                names[place] = name
                start, length, period = maximal_runs(names, least, times)
                owner = np.searchsorted(words.first + np.arange(len(texts)) + 1, start, side="right") - 1
                word = start - owner - 1
                dropped = covered(word + period, word + length, len(words))
                offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                fields = [pa.array(x.astype(np.int64)) for x in (word - words.first[owner], length, period)]
                found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                made = [pa.array(words.last - words.first, pa.int64()), found, texts_of(_collapsed(texts, words, dropped))]
                kept = [c.slice(a, b - a) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays(kept + made, [*batch.schema.names[:-1], "n_words", "runs", "collapsed_text"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed_text) for each row of ``docs``.

    Words are maximal stretches of characters other than ASCII white space, numbered from 0. A run is a stretch of words with smallest
    period q (words q apart are equal) of at least ``least`` words and ``times`` * q words, which can't be extended on either
    side with that period. runs holds (start, length, period) of all of them, by start and then period; collapsed_text the words that
    no run contains after its first period, joined by one space. ``times`` must be 4 or more.

    A null or empty text has no words, no runs and the empty string; rows that repeat are judged one by one, and no run goes from
    one text to the next. Other columns of ``docs`` are ignored, an empty table gives an empty one. Words are told apart by 64
    bits of hash. A slice of texts is held at a time, or one longer text.
    """
    if times < 4 or least < 2:
        raise ValueError("runs of fewer than 4 periods, or of single words, are not looked for")
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = source.mapInArrow(_found(least, times), f"_id {kind}, n_words long, runs {RUNS}, collapsed_text string")
    return out.withColumnRenamed("_id", id_col)
