"""Exact repeated passages, by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of ``(window + 1) // 2`` words, so each window of ``window`` words
holds one whole block of its text. All rolling windows of block length probe the index of block hashes; hits are extended
to every full window around them, and full windows that start in two places mark their words. Consecutive marked windows
join to maximal repeats.

Texts are dealt to buckets once and that one shuffle serves the three passes over them. A bucket sends each distinct
hash once, whatever the number of its copies, in one packed row per hash group: no passage, however common, makes a group
large, and no pairs are formed. Hash groups answer per bucket, so no positions or document ids travel.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Texts, U, Words, covered, member, mix, run_ends, runs, slices, texts_of

#: Buckets grow with the root of the input up to this many bytes of text, so that packed rows stay large.
LARGEST_BUCKET = 64 << 20


def bucket_counts(total_bytes: int) -> tuple[int, int]:
    """Number of text buckets and of hash groups for so many bytes of text."""
    each = min(max(1 << 20, int(math.sqrt(total_bytes * 19_000))), LARGEST_BUCKET)
    buckets = max(16, -(-total_bytes // each))
    return buckets, max(40, buckets // 2)


def _short(h: np.ndarray, groups: int) -> np.ndarray:
    """Hash group above 32 bits of hash."""
    return (((h >> U(40)) % U(groups)) << U(32)) | (h & U(0xFFFFFFFF))


def _packed(group: np.ndarray, **columns: np.ndarray) -> dict[str, list]:
    """One row per group; the columns' values as bytes."""
    order = np.argsort(group, kind="stable")
    first = runs(group[order])
    ends = run_ends(first, len(group))
    out: dict[str, list] = {"p": group[order][first].astype(np.int32).tolist()}
    for name, values in columns.items():
        values = values[order]
        out[name] = [values[a:b].tobytes() for a, b in zip(first, ends, strict=True)]
    return out


def _table(b: int | None, out: dict[str, list], schema: pa.Schema) -> pa.Table:
    n = len(out["p"])
    return pa.table({f.name: pa.array(out[f.name] if f.name in out else [b] * n, f.type) for f in schema}, schema=schema)


def _bytes(table: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


SENT = pa.schema([("p", pa.int32()), ("b", pa.int32()), ("h", pa.binary()), ("flags", pa.binary())])
FOUND = pa.schema([("b", pa.int32()), ("p", pa.int32()), ("h", pa.binary())])
FULL = pa.schema([("p", pa.int32()), ("b", pa.int32()), ("h", pa.binary()), ("g", pa.binary()), ("flags", pa.binary())])


def _probe(groups: int, block: int):
    """Every rolling window of block length of a bucket; flag 1: it is a reference block, 2: the bucket holds it twice."""

    def run(table: pa.Table) -> pa.Table:
        hashes, anchors = [], []
        for _, _, column in slices(table.column("_text")):
            words = Words(Texts(column))
            at = words.windows(block)
            hashes.append(words.window_hash(at, block))
            anchors.append((at - words.begin[at]) % block == 0)
        h, anchor = _joined(hashes, U), _joined(anchors, bool)
        order = np.argsort(h)
        h = h[order]
        first = runs(h)
        flags = np.zeros(len(first), np.uint8)
        if len(first):
            flags |= np.maximum.reduceat(anchor[order].astype(np.uint8), first)
            flags |= 2 * (np.diff(np.r_[first, len(h)]) > 1).astype(np.uint8)
        key = _short(h[first], groups)
        out = _packed(key >> U(32), h=key.astype(np.uint32), flags=flags)
        return _table(table.column("_b")[0].as_py() if table.num_rows else None, out, SENT)

    return run


def _repeated_blocks(table: pa.Table) -> pa.Table:
    """Of one hash group: hashes of reference blocks that occur in two places, back to each bucket that sent them."""
    sent, flags = _bytes(table, "h", np.uint32), _joined(_bytes(table, "flags", np.uint8), np.uint8)
    h = _joined(sent, np.uint32)
    sender = np.repeat(np.arange(len(sent)), [len(x) for x in sent])
    return _answers(table, h, sender, flags, lambda any_of: any_of & 1 > 0, [h])


def _repeated_windows(table: pa.Table) -> pa.Table:
    """Of one hash group: full windows that start in two places, back to each bucket that sent them."""
    sent, flags = _bytes(table, "h", U), _joined(_bytes(table, "flags", np.uint8), np.uint8)
    h, g = _joined(sent, U), _joined(_bytes(table, "g", U), U)
    sender = np.repeat(np.arange(len(sent)), [len(x) for x in sent])
    return _answers(table, h, sender, flags, lambda any_of: any_of >= 0, [g, h])


def _answers(table: pa.Table, h: np.ndarray, sender: np.ndarray, flags: np.ndarray, wanted, keys: list[np.ndarray]) -> pa.Table:
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(h)
    changes = np.zeros(len(h), bool)
    for k in keys:
        k = k[order]
        changes |= np.r_[True, k[1:] != k[:-1]][: len(h)]
    first = np.flatnonzero(changes)
    hot = np.zeros(len(h), bool)
    if len(first):
        length = np.diff(np.r_[first, len(h)])
        any_of = np.bitwise_or.reduceat(flags[order], first)
        hot[order] = np.repeat(((length > 1) | (any_of & 2 > 0)) & wanted(any_of), length)
    senders, groups = table.column("b").to_pylist(), table.column("p").to_pylist()
    which = np.flatnonzero(hot)
    owner = sender[which]
    first = runs(owner)
    ends = run_ends(first, len(owner))
    rows = [(senders[owner[a]], groups[owner[a]], h[which[a:b]].tobytes()) for a, b in zip(first, ends, strict=True)]
    return pa.table([pa.array([r[i] for r in rows], FOUND.field(i).type) for i in range(3)], schema=FOUND)


def _extend(groups: int, window: int, block: int):
    """All full windows around the hits of a bucket, with 128 bits of hash; flag 2: the bucket holds it twice."""

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        keys = [(U(p) << U(32)) | h.astype(U) for p, h in zip(found.column("p").to_pylist(), _bytes(found, "h", np.uint32), strict=True)]
        hot = np.sort(_joined(keys, U))
        hashes, seconds = [], []
        for _, _, column in slices(table.column("_text")) if len(hot) else ():
            words = Words(Texts(column))
            at = words.windows(block)
            hits = at[member(_short(words.window_hash(at, block), groups), hot)]
            near = covered(np.maximum(hits - (window - block), words.begin[hits]), hits + 1, len(words))
            full = words.windows(window)
            full = full[near[full]]
            hashes.append(words.window_hash(full, window))
            seconds.append(words.window_hash(full, window, second=True))
        h, g = _joined(hashes, U), _joined(seconds, U)
        order = np.lexsort([g, h])
        h, g = h[order], g[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])][: len(h)])
        flags = 2 * (np.diff(np.r_[first, len(h)]) > 1).astype(np.uint8)
        h, g = h[first], g[first]
        out = _packed(h % U(groups), h=h, g=g, flags=flags)
        return _table(table.column("_b")[0].as_py() if table.num_rows else None, out, FULL)

    return run


def _remove(window: int, schema: pa.Schema):
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        repeated = np.sort(_joined(_bytes(found, "h", U), U))
        n_words, n_removed, kept, spans = [], [], [], []
        for _, _, column in slices(table.column("_text")):
            texts = Texts(column)
            words = Words(texts)
            gone = np.zeros(len(words), bool)
            if len(repeated):
                at = words.windows(window)
                at = at[member(words.window_hash(at, window), repeated)]
                gone = covered(at, at + window, len(words))
            for i in range(len(texts)):
                mask = gone[words.first[i] : words.last[i]]
                own = texts.raw(i).split()
                removed = int(mask.sum())
                n_words.append(len(own))
                n_removed.append(removed)
                kept.append(b" ".join(itertools.compress(own, ~mask) if removed else own))
                edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        made = {"n_words": n_words, "n_removed": n_removed, "removed_spans": spans}
        own = {f.name: pa.array(made[f.name], f.type) if f.name in made else texts_of(kept) if f.name == "kept_text" else table.column(f.name).cast(f.type) for f in schema}
        return pa.table(own, schema=schema)

    return run


def substring_dedup(docs: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """Remove every word that lies in a window of ``window`` words which also starts elsewhere, in any text.

    Adds n_words, n_removed, kept_text (the words left, joined by one space) and removed_spans (maximal repeats, as word
    ranges [start, end)) to the columns of ``docs``; columns of these names in ``docs`` are replaced. Windows are judged on
    the input. A null or empty text has no words and keeps the empty string; texts shorter than the window lose nothing; equal
    rows are separate texts, so they remove each other's windows. One row comes out for each row that goes in.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if window < 2:
        raise ValueError("window must be at least 2 words")
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text", "removed_spans")]
    block = (window + 1) // 2
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    buckets, groups = bucket_counts(total)

    kinds = dict(docs.dtypes)
    salt = [F.col(f"`{c}`") for c in docs.columns if c == text or kinds[c] in ("bigint", "int", "string")]
    body = F.col(f"`{text}`").cast("string").alias("_text")
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text]
    dealt = docs.select(*kept, body, F.pmod(F.xxhash64(*salt), F.lit(buckets)).cast("int").alias("_b"))
    by_bucket = dealt.groupBy("_b")
    sent = by_bucket.applyInArrow(_probe(groups, block), "p int, b int, h binary, flags binary")
    hot = sent.groupBy("p").applyInArrow(_repeated_blocks, "b int, p int, h binary")
    full = by_bucket.cogroup(hot.groupBy("b")).applyInArrow(_extend(groups, window, block), "p int, b int, h binary, g binary, flags binary")
    twice = full.groupBy("p").applyInArrow(_repeated_windows, "b int, p int, h binary")
    types = dealt.drop("_b").schema
    shape = types.simpleString()[len("struct<") : -1]
    spark = docs.sparkSession
    empty = spark.createDataFrame([], f"struct<{shape},n_words:bigint,n_removed:bigint,kept_text:string,removed_spans:array<struct<start:bigint,end:bigint>>>")
    out = by_bucket.cogroup(twice.groupBy("b")).applyInArrow(_remove(window, to_arrow_schema(empty.schema)), empty.schema)
    back = [F.col("_text" if c == text else f"c{i}").cast(docs.schema[c].dataType).alias(c) for i, c in enumerate(names)]
    return out.select(*back, "n_words", "n_removed", "kept_text", "removed_spans")
