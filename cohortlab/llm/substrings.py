"""Substring dedup by level-wise doubling.

A window of ``target`` words is removed where its word sequence also starts in a
document with a smaller id. Windows of a short length come first; only those found in
two documents are extended to twice that length, level by level, up to ``target`` (the
last extension overlaps where ``target`` is no power-of-two multiple). A window of
length 2k can only repeat if both of its halves do, so nothing is lost; what survives
the last level is decided by each window's smallest document id.

Levels below the last compare 48-bit hashes (a clash only keeps a candidate), the last
one 64-bit hashes.

Defined cases: a null text has no words; a null document id is smaller than none, so its
row loses nothing and removes nothing; rows that share an id leave each other's copies;
other columns are ignored; each row gets a row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import bucket_count, chunk_table, chunk_texts, exchange, pack, pack_sorted, per_row, slices, unpack, unpack_sorted, with_answers
from .hashing import WORD_SPACED, joined, words, windows

BITS = 48


def levels(target: int, first: int) -> list[int]:
    """first, 2 first, ... up to target."""
    out = [min(first, target)]
    while out[-1] < target:
        out.append(min(2 * out[-1], target))
    return out


def _parsed(row):
    texts = chunk_texts(row["lens"], row["blob"])
    buf, starts = joined(texts)
    ws, we, doc, wh = words(buf, starts, WORD_SPACED, False)
    return texts, buf, starts, ws, we, doc, wh


def _groups(h: np.ndarray, ids: np.ndarray):
    """Distinct hashes ascending, the smallest and largest id of each, and each window's place among them."""
    u, where = np.unique(h, return_inverse=True)
    low = np.full(len(u), np.iinfo(np.int64).max)
    high = np.full(len(u), np.iinfo(np.int64).min)
    np.minimum.at(low, where, ids)
    np.maximum.at(high, where, ids)
    return u, low, high, where


def _window_ids(row, doc, first):
    ids = row["ids"]
    known = np.array([i is not None for i in ids], bool)
    value = np.array([0 if i is None else i for i in ids], np.int64)
    keep = known[doc[first]]
    return keep, value[doc[first]]


def _candidates(row, doc, wh, lens: list[int], level: int):
    """(first words, hashes, ids) of the windows that level ``level`` looks at, given
    the answers of the levels before."""
    first, h = windows(wh, doc, lens[0])
    keep, ids = _window_ids(row, doc, first)
    first, h, ids = first[keep], h[keep], ids[keep]
    for k in range(level):
        u, low, high, where = _groups(h >> np.uint64(64 - BITS), ids)
        flags = np.concatenate([np.unpackbits(np.frombuffer(unpack(a["data"]), np.uint8)) for a in row[f"level{k}"]]) \
            if row[f"level{k}"] else np.zeros(0, np.uint8)
        alive = np.zeros(len(wh) + lens[k + 1], bool)
        alive[first] = _aligned(flags, u, row[f"n_buckets"])[where] if len(u) else False
        step = lens[k + 1] - lens[k]
        nxt, hn = windows(wh, doc, lens[k + 1])
        keep, ids = _window_ids(row, doc, nxt)
        keep &= alive[nxt] & alive[nxt + step]
        first, h, ids = nxt[keep], hn[keep], ids[keep]
    return first, h, ids


def _aligned(bits: np.ndarray, u: np.ndarray, n_buckets: int, width: int = BITS) -> np.ndarray:
    """One flag for each hash, from answers padded to whole bytes bucket by bucket."""
    cuts = slices(u, n_buckets, width)
    out, at = np.zeros(len(u), bool), 0
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            out[a:b] = bits[at:at + b - a]
            at += -(-(b - a) // 8) * 8
    return out


def _seen_twice(messages: list[bytes]) -> list[bytes]:
    """Level answer: which hashes stand in two documents."""
    parts = []
    for m in messages:
        n = int.from_bytes(m[:8], "little")
        parts.append((unpack_sorted(m[8:8 + n]), np.unpackbits(np.frombuffer(unpack(m[8 + n:]), np.uint8))))
    parts = [(h, f[:len(h)]) for h, f in parts]
    u, count = np.unique(np.concatenate([h for h, _ in parts]), return_counts=True)
    count[np.searchsorted(u, np.concatenate([h[f == 1] for h, f in parts]))] = 2
    return [pack(np.packbits(count[np.searchsorted(u, h)] > 1).tobytes()) for h, _ in parts]


def _smaller_elsewhere(messages: list[bytes]) -> list[bytes]:
    """Last answer: for which hashes a smaller id than the chunk's own smallest exists."""
    parts = []
    for m in messages:
        n = int.from_bytes(m[:8], "little")
        parts.append((unpack_sorted(m[8:8 + n]), np.frombuffer(unpack(m[8 + n:]), "<i8")))
    all_h, all_id = np.concatenate([h for h, _ in parts]), np.concatenate([i for _, i in parts])
    order = np.argsort(all_h, kind="stable")
    starts = np.flatnonzero(np.diff(all_h[order], prepend=all_h[order][:1] ^ np.uint64(1)))
    u, low = all_h[order][starts], np.minimum.reduceat(all_id[order], starts)
    return [pack(np.packbits(low[np.searchsorted(u, h)] < i).tobytes()) for h, i in parts]


def _emit(lens: list[int], level: int, n_buckets: int):
    last = level == len(lens) - 1

    def emit(row):
        row["n_buckets"] = n_buckets
        _, _, _, _, _, doc, wh = _parsed(row)
        first, h, ids = _candidates(row, doc, wh, lens, level)
        if not len(first):
            return
        u, low, high, _ = _groups(h if last else h >> np.uint64(64 - BITS), ids)
        cuts = slices(u, n_buckets, 64 if last else BITS)
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
            if j > i:
                head = pack_sorted(u[i:j])
                rest = low[i:j].astype("<i8").tobytes() if last else np.packbits(high[i:j] > low[i:j]).tobytes()
                yield b, len(head).to_bytes(8, "little") + head + pack(rest)
    return emit


def _apply(lens: list[int], n_buckets: int, keep_text: bool):
    target, level = lens[-1], len(lens) - 1

    def apply(row):
        row["n_buckets"] = n_buckets
        texts, buf, starts, ws, we, doc, wh = _parsed(row)
        first, h, ids = _candidates(row, doc, wh, lens, level)
        mark = np.zeros(len(wh) + 1, np.int64)
        if len(first):
            u, low, _, where = _groups(h, ids)
            bits = np.concatenate([np.unpackbits(np.frombuffer(unpack(a["data"]), np.uint8)) for a in row["last"]])
            hit = first[(ids > low[where]) | _aligned(bits, u, n_buckets, 64)[where]]
            np.add.at(mark, hit, 1)
            np.add.at(mark, hit + target, -1)
        gone = np.cumsum(mark[:-1]) > 0
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        for k, i in enumerate(row["ids"]):
            a, b = edge[k], edge[k + 1]
            out = gone[a:b]
            if out.any():
                base, t = starts[k], texts[k]
                left = np.flatnonzero(~out) + a
                kept = b" ".join([t[x:y] for x, y in zip((ws[left] - base).tolist(), (we[left] - base).tolist())])
            else:
                kept = b" ".join(texts[k].split())
            digest = hashlib.sha256(kept).hexdigest()
            yield (i, int(b - a), int(out.sum()), digest, kept.decode("utf-8", "replace") if keep_text else None)
    return apply


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                    ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def dedup_substrings(docs: DataFrame, target: int = 50, first: int = 25, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (if wanted) kept_text for each row of ``docs``."""
    lens = levels(target, first)
    rows = chunk_table(docs)
    n_buckets = bucket_count(rows)
    for level in range(len(lens)):
        last = level == len(lens) - 1
        answers = exchange(rows, _emit(lens, level, n_buckets), _smaller_elsewhere if last else _seen_twice,
                           "last" if last else f"level{level}")
        rows = with_answers(rows, answers)
    out = rows.mapInArrow(per_row(_apply(lens, n_buckets, keep_text), rows.columns, SCHEMA),
                          "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if keep_text else out.drop("kept_text")
