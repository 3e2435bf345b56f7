"""Mixing to target weights with soft membership.

A classifier learned from a labelled table gives every document a posterior over the domains. Each document gets a rate, its
expected number of copies, such that for every domain the expected tokens, rate times tokens times posterior summed over
all documents, match the target. The rates are the projected-gradient solution of the least squares problem that starts at
rate 1, so they stay close to the corpus as it is. A step needs from the corpus only one expected total for each domain,
summed by the executors; between steps a document's rate is replayed from the last totals, and stored every REPLAY steps.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Grams, Texts, Words, slices
from .storage import written
from .training import bounded_sample

#: Bytes of an n-gram, hash slots (as a power of two), documents learned from, of each domain at most.
SIZE, BITS, DOCUMENTS = 4, 16, 1500
#: How sharply the mean log-likelihood of a document's n-grams separates domains.
SHARPNESS = 12.0
#: Steps between two tables of rates. The search ends if all targets are met to TOLERANCE, or if the largest miss has fallen by
#: less than GAIN over so many steps, as it does where targets can't be met.
REPLAY, TOLERANCE, GAIN = 8, 1e-3, 0.02
UNKNOWN = "und"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).to_pylist()
        for a, b, column in slices(batch.column(1)):
            grams = Grams(Texts(column, lower=True), SIZE)
            slot, own = grams.slot(BITS), np.array(names[a:b], object)
            for domain in dict.fromkeys(own):
                times = np.bincount(slot[(own == domain)[grams.owner]], minlength=1 << BITS)
                at = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays([pa.array([domain] * len(at), pa.string()), pa.array(at), pa.array(times[at])], ["domain", "slot", "times"])


class Posterior:
    """Domains and, for each hash slot, the log-likelihood of each domain against their mean."""

    def __init__(self, domains: list[str], table: np.ndarray, prior: np.ndarray):
        self.domains, self.table, self.prior = domains, table, prior

    def of(self, texts: Texts) -> np.ndarray:
        """One row of posteriors for each text; the domains' shares for a text without n-grams."""
        grams = Grams(texts, SIZE)
        mean = grams.sums(self.table[grams.slot(BITS)]) / np.maximum(1, grams.count)[:, None]
        logit = SHARPNESS * mean
        logit[grams.count == 0] = np.log(self.prior)
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def learned(labelled: DataFrame, documents: int = DOCUMENTS) -> Posterior:
    """A posterior from (id, text, domain) rows, from at most ``documents`` rows of each domain; rows without either are skipped.

    If no row is left, all texts belong to the one domain UNKNOWN.
    """
    known = labelled.filter("domain IS NOT NULL AND text IS NOT NULL")
    shares = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    if not shares:
        return Posterior([UNKNOWN], np.zeros((1 << BITS, 1), np.float32), np.ones(1))
    # Bounded: at most ``documents`` ids of each domain.
    chosen = F.broadcast(bounded_sample(known.select("id", "domain"), "domain", documents, shares))
    texts = known.join(chosen, ["id", "domain"], "left_semi").select("domain", "text")
    counts = texts.mapInArrow(_counted, "domain string, slot long, times long").groupBy("domain", "slot").agg(F.sum("times").alias("times"))
    domains = sorted(shares)
    place = {d: i for i, d in enumerate(domains)}
    table = np.ones((1 << BITS, len(domains)))
    for r in counts.toLocalIterator():  # bounded: a row for each domain and slot
        table[r.slot, place[r.domain]] += r.times
    table = np.log(table / table.sum(axis=0))
    total = sum(shares.values())
    return Posterior(domains, (table - table.mean(axis=1, keepdims=True)).astype(np.float32), np.array([shares[d] / total for d in domains]))


def _memberships(posterior: Posterior):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, column in slices(batch.column(1)):
                words = Words(Texts(column))
                p = posterior.of(Texts(column, lower=True))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.last - words.first), lists], ["id", "tokens", "posterior"])

    return run


def replayed(rate: np.ndarray, p: np.ndarray, history: list[np.ndarray], least: float) -> np.ndarray:
    """Each document's rate after the steps whose errors are given."""
    for error in history:
        rate = np.maximum(least, rate - p @ error)
    return rate


def _totals(history: list[np.ndarray], least: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            p = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, width)
            rate = replayed(np.asarray(batch.column(2), np.float64), p, history, least)
            total += (rate * np.asarray(batch.column(0), np.float64)) @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["domain", "tokens"])

    return run


def _rates(history: list[np.ndarray], least: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column(2).flatten(), np.float64).reshape(-1, width)
            rate = replayed(np.asarray(batch.column(3), np.float64), p, history, least)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rate)], ["id", "tokens", "posterior", "rate"])

    return run


def tempered(supply: dict[str, float], temperature: float, keep_all: bool) -> dict[str, float]:
    """Token targets in proportion to supply ** temperature; they sum to the supply or, with keep_all, fall below no domain's supply."""
    flat = {d: s**temperature if s > 0 else 0.0 for d, s in supply.items()}
    ratio = [s / flat[d] for d, s in supply.items() if s > 0]
    scale = max(ratio, default=0.0) if keep_all else sum(supply.values()) / max(1e-300, sum(flat.values()))
    return {d: x * scale for d, x in flat.items()}


class Mix:
    """Memberships with fitted rates, the domains, and expected tokens against targets."""

    def __init__(self, rows: DataFrame, domains: list[str], targets: np.ndarray, reached: np.ndarray, miss: float):
        self.rows, self.domains, self.targets, self.reached, self.miss = rows, domains, targets, reached, miss

    @property
    def met(self) -> bool:
        """Whether every target is met: the largest error, against the larger of target and supply, is within TOLERANCE."""
        return self.miss <= TOLERANCE


def mixed(docs: DataFrame, posterior: Posterior, id_col: str = "doc_id", text: str = "text", targets: dict[str, float] | None = None, temperature: float = 0.7, least: float = 0.0) -> Mix:
    """Rates for every row of ``docs``: ``rows`` has id, tokens (words), posterior and rate.

    targets: tokens wanted of each domain; None: in proportion to supply ** temperature. No rate falls below ``least``; with 1,
    targets by temperature fall below no domain's supply. A null or empty text has no tokens and no influence; its rate follows
    from the domains' shares. Texts of any length are counted whole. Repeated rows count as often as they occur. An empty table
    gives no rows, and columns beside the id and the text are ignored. Targets that can't be met, such as tokens of a domain that no
    document may belong to, are approached as far as possible; ``met`` and ``miss`` tell, and a warning is given.
    """
    width = len(posterior.domains)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    members = rows.mapInArrow(_memberships(posterior), f"id {kind}, tokens long, posterior array<double>")
    members = written(members.withColumn("rate", F.lit(max(1.0, least))), "memberships")
    shape = f"id {kind}, tokens long, posterior array<double>, rate double"

    def totals(history: list[np.ndarray]) -> np.ndarray:
        narrow = members.select("tokens", "posterior", "rate")
        sums = narrow.mapInArrow(_totals(history, least, width), "domain int, tokens double").groupBy("domain").agg(F.sum("tokens").alias("tokens"))
        out = np.zeros(width)
        for r in sums.collect():  # one row for each domain
            out[r.domain] = r.tokens
        return out

    supply = totals([])  # at rate 1, or at ``least`` if that is more
    if targets is None:
        targets = tempered(dict(zip(posterior.domains, supply / max(1.0, least), strict=True)), temperature, least >= 1)
    goal = np.array([float(targets.get(d, 0.0)) for d in posterior.domains])
    # Errors are taken against the larger of target and supply, so that a step of 1 never overshoots.
    scale = np.maximum(np.maximum(goal, supply), 1e-9)
    history: list[np.ndarray] = []
    error = (supply - goal) / scale
    reached, misses = supply, [float(np.abs(error).max())]
    while misses[-1] > TOLERANCE and (len(misses) <= REPLAY or misses[-1] < (1 - GAIN) * misses[-1 - REPLAY]):
        history.append(error)
        reached = totals(history)
        error = (reached - goal) / scale
        misses.append(float(np.abs(error).max()))
        if len(history) == REPLAY:
            members, history = written(members.mapInArrow(_rates(history, least, width), shape), "rates"), []
    if misses[-1] > TOLERANCE:
        warnings.warn(f"targets are missed by up to {misses[-1]:.2g} of target or supply", stacklevel=2)
    return Mix(members.mapInArrow(_rates(history, least, width), shape), posterior.domains, goal, reached, misses[-1])


def copies(rate: Column, *key: Column) -> Column:
    """The whole number of copies whose expectation is the rate; the fraction is settled by a hash of the key."""
    share = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + share).cast("int")
