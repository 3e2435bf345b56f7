"""Token ids of whole texts by the public 50k byte-level vocabulary, encoding each distinct chunk about once a worker.

A chunk is a run of white space with the word that follows. No token of this vocabulary's pattern crosses from a word into
white space, so a text's ids are those of its chunks in order. Chunks that the worker has not met are joined and encoded
in one call; token lengths tell where each chunk's ids end. Texts in which this doesn't hold (white space beyond ASCII, or a
special token's name) are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa

from .arrays import _BYTE_BASE, SEPARATOR, Texts, U, mix, rolling, runs

SPECIAL = b"<|endoftext|>"
_ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(\x9a\x80|\xa0\x8e)|\xe2(\x80[\x80-\x8f\xa8-\xaf]|\x81[\x9f\xa0])|\xe3\x80\x80|\xef\xbb\xbf")
#: Bytes that open one of the above.
_MAY_BE_ODD = np.zeros(256, bool)
_MAY_BE_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


@functools.cache
def _encoders(folder: str | None):
    """The encoder by ranks, the byte length of each id, and the encoder by vocabulary file."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    place = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
    with open(place("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(max(ranks.values()) + 2, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return quick, sizes, Tokenizer.from_file(place("byte_bpe_50k.json"))


def _whole(text: bytes, folder: str | None) -> np.ndarray:
    return np.array(_encoders(folder)[2].encode(text.decode(), add_special_tokens=False).ids, np.uint32)


class _Cache:
    """Ids of chunks that this worker has met, by hash: a direct-mapped table of fixed size over a pool of bounded size."""

    BITS, MOST_IDS = 20, 12_000_000

    def __init__(self):
        self.key = np.zeros(1 << self.BITS, U)
        self.place = np.zeros(1 << self.BITS, np.int64)
        self.size = np.zeros(1 << self.BITS, np.int64)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def add(self, ids: np.ndarray) -> int:
        """Where the pool now holds these ids."""
        if self.used + len(ids) > len(self.pool):
            if self.used > self.MOST_IDS:
                self.key[:] = 0
                self.used = 0
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(ids), self.used, 1 << 20), np.uint32)])
        at = self.used
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at


@functools.cache
def _cache(folder: str | None) -> _Cache:
    return _Cache()


def _encoded(raw: bytes, starts: np.ndarray, ends: np.ndarray, joint: np.ndarray, folder: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of these chunks, one after the other, and how many each has; chunks that are not joint come last.

    A chunk without leading white space would grow together with the one before it, and one that ends in white space with the
    one after it, so these are encoded on their own.
    """
    quick, sizes, _ = _encoders(folder)
    ids = np.array(quick.encode_ordinary(b"".join([raw[a:b] for a, b in zip(starts[joint].tolist(), ends[joint].tolist(), strict=True)]).decode()), np.int64)
    stop = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum((ends - starts)[joint]), side="right")
    alone = [np.array(quick.encode_ordinary(raw[a:b].decode()), np.int64) for a, b in zip(starts[~joint].tolist(), ends[~joint].tolist(), strict=True)]
    n = np.empty(len(starts), np.int64)
    n[joint] = np.diff(np.r_[0, stop])
    n[~joint] = [len(x) for x in alone]
    return np.concatenate([ids, *alone]), n


def token_ids(column: pa.Array, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and where each text's ids begin (one more entry).

    folder: where the vocabulary files lie; None: where the installed package has them.
    """
    texts = Texts(column)
    data = texts.data
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    space = SEPARATOR[data]
    opens = np.zeros(len(data), bool)
    opens[1:] = space[1:] & ~space[:-1]
    opens[texts.starts[texts.ends > texts.starts]] = True
    starts = np.flatnonzero(opens)
    ends = np.r_[starts[1:], len(data)]
    h = mix(rolling(data.astype(U) + U(1), starts, ends, _BYTE_BASE) ^ (ends - starts).astype(U))
    cache = _cache(folder)
    slot = (h >> U(64 - cache.BITS)).astype(np.int64)
    n, source = cache.size[slot], cache.place[slot]
    missed = np.flatnonzero(cache.key[slot] != h)
    raw = data.tobytes()
    if len(missed):
        order = missed[np.argsort(h[missed])]
        first = runs(h[order])
        sample = order[first]
        joint = space[starts[sample]] & ~space[ends[sample] - 1]
        ids, own = _encoded(raw, starts[sample], ends[sample], joint, folder)
        before = cache.used
        at = cache.add(ids)
        if at < before:  # the pool was emptied, so what other chunks were found there is gone; all are added anew, whatever their number
            cache.used = 0
            return token_ids(column, folder)
        where = np.empty(len(sample), np.int64)
        where[joint] = at + np.cumsum(own[joint]) - own[joint]
        where[~joint] = at + own[joint].sum() + np.cumsum(own[~joint]) - own[~joint]
        each = np.diff(np.r_[first, len(order)])
        n[order], source[order] = np.repeat(own, each), np.repeat(where, each)
        to = slot[sample]
        cache.key[to], cache.place[to], cache.size[to] = h[sample], where, own
    total = np.r_[0, np.cumsum(n)]
    out = cache.pool[np.repeat(source - total[:-1], n) + np.arange(total[-1])]
    bounds = total[np.searchsorted(starts, np.r_[texts.starts, len(data)])]
    if _MAY_BE_ODD[data].any() or SPECIAL in raw:
        odd = [i for i in range(len(texts)) if _odd(texts.raw(i))]
        if odd:
            own_ids = [out[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            for i in odd:
                own_ids[i] = _whole(texts.raw(i), folder)
            out, bounds = np.concatenate(own_ids), np.r_[0, np.cumsum([len(x) for x in own_ids])]
    return out, bounds


def _odd(raw: bytes) -> bool:
    return SPECIAL in raw or _ODD_SPACE.search(raw) is not None
