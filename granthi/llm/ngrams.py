"""Words, n-grams and their 64-bit hashes over whole batches of texts, by numpy.

A word is a run of bytes other than ASCII white space, A-Z taken as lower case. Its hash is a polynomial
over random 64-bit values of its bytes, mixed; an n-gram's hash is a mix of its words' hashes. Equal
words have equal hashes on every machine; different ones meet with a probability of about 2^-61.
"""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
SLICE = 1 << 18  # bytes hashed at once, so that the arrays stay in the processor's cache


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
    values[65:91] = values[97:123]
    values[SPACES] = 0
    return values


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = int(_BASE), pow(int(_BASE), -1, 1 << 64)
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n, b, U)])) for b in (base, inverse))


VALUES = _byte_values()
_UP, _DOWN = _powers(SLICE)


def join_texts(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a line end after each, and the offsets of the texts (one more than texts)."""
    raw = [x if isinstance(x, bytes) else (x or "").encode() for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]).astype(np.int64)
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.empty(0, np.uint8), offsets


def _slice_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~SPACES[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, U)
    np.cumsum(VALUES[data] * _UP[: len(data)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * _DOWN[starts] + (ends - starts).astype(U))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word in the bytes; a word longer than SLICE is hashed by its slices' hashes."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        if end < len(data):
            stop = np.flatnonzero(SPACES[data[at:end]][::-1][:4096])
            if not len(stop):
                stop = np.flatnonzero(SPACES[data[at:end]][::-1])
            if len(stop):
                end -= int(stop[0])
            else:  # one word fills the slice
                to = end
                while to < len(data) and not SPACES[data[to]]:
                    to += 1
                h = np.zeros(1, U)
                for k in range(at, to, SLICE):
                    h = mix(h * U(3) + _slice_words(data[k : min(k + SLICE, to)])[2])
                hashes.append(h)
                starts.append(np.array([at]))
                at = to
                continue
        s, _, h = _slice_words(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.empty(0, U), np.empty(0, np.int64))


def text_words(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the offsets of the texts' words."""
    data, offsets = join_texts(texts)
    hashes, starts = words(data)
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: list[str | bytes | None], n: int, lot: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-word shingles of each text, one text after another, and the texts' offsets.

    A text of fewer words has its whole sequence as one shingle; one without words has none. ``lot``:
    bytes or characters of text that are worked on at once.
    """
    parts, sizes, begin, held = [], [np.zeros(1, np.int64)], 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= lot or k == len(texts) - 1:
            grams, at = _shingle_sets(texts[begin : k + 1], n)
            parts.append(grams)
            sizes.append(np.diff(at))
            begin, held = k + 1, 0
    return np.concatenate(parts) if parts else np.empty(0, U), np.cumsum(np.concatenate(sizes))


def _shingle_sets(texts: list[str | bytes | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = text_words(texts)
    count = np.diff(at)
    have = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    ends = np.cumsum(have)
    owner = np.repeat(np.arange(len(count)), have)
    first = np.arange(len(owner)) - np.repeat(ends - have, have) + at[:-1][owner]
    grams = np.zeros(len(owner), U)
    last = at[1:][owner]
    for k in range(n):
        there = first + k < last
        word = hashes[np.minimum(first + k, max(len(hashes) - 1, 0))] if len(hashes) else np.empty(0, U)
        grams = np.where(there, mix(grams * U(3) + word + U(k)), grams)
    for a, b in zip(ends - have, ends, strict=True):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(count)))]).astype(np.int64)
