"""Vectorised 64-bit hashes of words, word windows and byte anchors (numpy, inside tasks).

A sequence hashes to the sum of its items' random 64-bit values times powers of an odd
base, divided by the power at its start, then mixed; so equal sequences hash alike
wherever they stand, and a window needs two look-ups in a running sum. Work goes in
blocks of about a quarter of a megabyte, whatever the length of a text.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 18
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
WORD_SPACED = ~SPACES                      # [^\x20\x09-\x0D]
WORD_ALNUM = np.ones(256, bool)            # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
WORD_ALNUM[:128] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    WORD_ALNUM[_a:_b] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(int(n).bit_length(), 10)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


def sequence_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[starts[i]:ends[i]] for each i (uint64)."""
    up, down = _powers(len(values) + 1)
    run = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def joined(texts: list, sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array with ``sep`` between, and where each starts (one more: the end)."""
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + len(sep)
    return np.frombuffer(sep.join(texts) + sep, np.uint8), np.concatenate(([0], np.cumsum(lens)))


def words(buf: np.ndarray, doc_starts: np.ndarray, is_word: np.ndarray, lower: bool):
    """(starts, ends, document index, hash) of every word of the joined texts."""
    value = _BYTE[LOWER] if lower else _BYTE
    out, at, n = [], 0, len(buf)
    while at < n:
        end = min(n, at + BLOCK)
        while end < n and is_word[buf[end - 1]] and is_word[buf[end]]:  # cut between words only
            stop = np.flatnonzero(~is_word[buf[end:end + BLOCK]])
            end = end + int(stop[0]) if len(stop) else min(n, end + BLOCK)
        block = buf[at:end]
        flags = np.zeros(len(block) + 2, np.int8)
        flags[1:-1] = is_word[block]
        edges = np.flatnonzero(np.diff(flags))
        s, e = edges[0::2], edges[1::2]
        out.append((s + at, e + at, sequence_hash(value[block], s, e)))
        at = end
    s, e, h = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, t)
               for k, t in enumerate((np.int64, np.int64, np.uint64)))
    return s, e, np.searchsorted(doc_starts, s, "right") - 1, h


def windows(word_hash: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of all windows of k consecutive words within a document."""
    first = np.flatnonzero(doc[:max(len(doc) - k + 1, 0)] == doc[k - 1:]) if len(doc) >= k else np.zeros(0, np.int64)
    return first, sequence_hash(mix(word_hash), first, first + k)


def _sliding(h: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over h[i:i+w] for each i."""
    m, size = h, 1
    while size * 2 <= w:
        m, size = pick(m[:len(m) - size], m[size:]), size * 2
    return pick(m[:len(h) - w + 1], m[w - size:w - size + len(h) - w + 1]) if size < w else m


def anchors(buf: np.ndarray, gram: int = 8, w: int = 96) -> np.ndarray:
    """Places whose 8-byte gram hashes lowest in some window of ``w`` places that holds
    it. Any ``w + 7`` bytes hold one, and equal stretches have theirs at equal places."""
    out, n = [], len(buf) - gram + 1
    if n < w:
        return np.zeros(0, np.int64)
    for at in range(0, n, BLOCK):
        low, high = max(0, at - w + 1), min(n, at + BLOCK + w - 1)
        if high - low < w:
            low = max(0, high - w)
        g = buf[low:high + gram - 1].astype(np.uint64)
        for k in (1, 2, 4):
            g = g[:len(g) - k] | (g[k:] << np.uint64(8 * k))
        h = mix(g * np.uint64(_BASE))
        least = _sliding(h, w, np.minimum)
        pad = np.zeros(w - 1, np.uint64)
        best = _sliding(np.concatenate((pad, least, pad)), w, np.maximum)  # over the windows that hold each place
        found = np.flatnonzero(best[:len(h)] == h) + low
        out.append(found[(found >= at) & (found < at + BLOCK)])
    return np.concatenate(out)


def stretch_hash(buf: np.ndarray, starts: np.ndarray, length: int, lower: bool = False) -> np.ndarray:
    """Hash of ``length`` bytes from each start (ascending)."""
    out, value = [], _BYTE[LOWER] if lower else _BYTE
    for at in range(0, len(buf), BLOCK):
        a, b = np.searchsorted(starts, (at, at + BLOCK))
        if b > a:
            s = starts[a:b] - at
            out.append(sequence_hash(value[buf[at:at + BLOCK + length]], s, s + length))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
