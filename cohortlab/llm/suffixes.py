"""Suffix-array dedup: bytes covered by a long string that starts elsewhere too.

1. Anchors are content-defined places, one at least in any ``SPAN`` bytes, the same in
   every copy of a stretch. A repeated ``length``-byte string holds an anchor in its
   first ``SPAN`` bytes, so only anchors whose next ``length - SPAN + 1`` bytes occur
   twice matter; a hash exchange finds them (a clash only keeps a candidate).
2. Each chunk sorts the suffixes at its candidate anchors and sends them, front-coded,
   in one run per bucket. A reducer merges the runs with a loser tree that keeps each
   contender's common prefix with the last winner, so known prefixes are never compared
   again; the merge yields the sorted suffixes and their common-prefix lengths.
3. A string that starts o bytes before an anchor repeats if another anchor has the same
   o bytes before it and the same length - o bytes after it: equal classes in the sorted
   suffixes and in the sorted reversed prefixes. All o are decided exactly, and each
   anchor is told the smallest and largest o, whose strings overlap into one stretch.

A suffix with equal surroundings in one chunk is sent once. Defined cases: a null text is
empty; texts shorter than ``length`` lose nothing; repeated rows lose what they share; ids
may be null or repeat; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import bucket_count, chunk_table, chunk_texts, exchange, pack, pack_sorted, per_row, slices, unpack, unpack_sorted, with_answers
from .hashing import anchors, stretch_hash
from .substrings import _aligned

BITS = 48
GRAM, WINDOW = 8, 89
SPAN = WINDOW + GRAM - 1  # any so many bytes hold an anchor
NONE = 255


def _places(row, length: int):
    """Anchors with room behind them: (buffer, document starts, places, their documents, hashes)."""
    buf = np.frombuffer(unpack(row["blob"]), np.uint8)
    starts = np.concatenate(([0], np.cumsum(row["lens"]))).astype(np.int64)
    need = length - SPAN + 1
    at = anchors(buf, GRAM, WINDOW)
    doc = np.searchsorted(starts, at, "right") - 1
    room = at + need <= starts[doc + 1]
    at, doc = at[room], doc[room]
    return buf, starts, at, doc, stretch_hash(buf, at, need) >> np.uint64(64 - BITS)


def _emit_hashes(length: int, n_buckets: int):
    def emit(row):
        _, _, at, _, h = _places(row, length)
        if not len(at):
            return
        u, count = np.unique(h, return_counts=True)
        cuts = slices(u, n_buckets, BITS)
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
            if j > i:
                head = pack_sorted(u[i:j])
                yield b, len(head).to_bytes(8, "little") + head + pack(np.packbits(count[i:j] > 1).tobytes())
    return emit


def _contexts(row, length: int, n_buckets: int):
    """Candidate anchors and their distinct surroundings: (buffer, starts, places, number
    of each place's surroundings, [(bucket, suffix, reversed prefix, times)] in order)."""
    buf, starts, at, doc, h = _places(row, length)
    if not row["twice"]:
        return buf, starts, at[:0], [], []
    u, where = np.unique(h, return_inverse=True)
    bits = np.concatenate([np.unpackbits(np.frombuffer(unpack(a["data"]), np.uint8)) for a in row["twice"]])
    keep = _aligned(bits, u, n_buckets, BITS)[where]
    at, doc, h = at[keep], doc[keep], h[keep]
    data = buf.tobytes()
    bucket = [(x * n_buckets) >> BITS for x in h.tolist()]
    low, high = np.maximum(starts[doc], at - SPAN + 1).tolist(), np.minimum(starts[doc + 1], at + length).tolist()
    keys = [(b, data[a:e], data[s:a][::-1]) for b, a, s, e in zip(bucket, at.tolist(), low, high)]
    times: dict = {}
    for k in keys:
        times[k] = times.get(k, 0) + 1
    order = sorted(times)
    number = {k: i for i, k in enumerate(order)}
    return buf, starts, at, [number[k] for k in keys], [(*k, times[k]) for k in order]


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    end = min(len(a), len(b))
    while known + 16 <= end and a[known:known + 16] == b[known:known + 16]:
        known += 16
    while known < end and a[known] == b[known]:
        known += 1
    return known


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted strings: what each shares with the one before, and the rest of it."""
    shared = [0] + [common(a, b) for a, b in zip(strings, strings[1:])]
    return shared, [s[n:] for s, n in zip(strings, shared)]


def _emit_runs(length: int, n_buckets: int):
    def emit(row):
        found = _contexts(row, length, n_buckets)[4]
        at = 0
        while at < len(found):
            b, end = found[at][0], at
            while end < len(found) and found[end][0] == b:
                end += 1
            run = found[at:end]
            shared, rest = front_code([r[1] for r in run])
            head = np.array([shared, [len(x) for x in rest], [len(r[2]) for r in run], [min(r[3], 2) for r in run]], "<u4")
            yield b, pack(len(run).to_bytes(8, "little") + head.tobytes() + b"".join(rest) + b"".join(r[2] for r in run))
            at = end
    return emit


def _decode(message: bytes):
    data = unpack(message)
    n = int.from_bytes(data[:8], "little")
    head = np.frombuffer(data[8:8 + 16 * n], "<u4").reshape(4, n)
    shared, lens, lefts, times = head.tolist()
    at, last, strings = 8 + 16 * n, b"", []
    for s, k in zip(shared, lens):
        last = last[:s] + data[at:at + k]
        strings.append(last)
        at += k
    prefixes = []
    for k in lefts:
        prefixes.append(data[at:at + k])
        at += k
    return strings, shared, prefixes, times


def merge_runs(runs: list[tuple[list[bytes], list[int]]]):
    """Merge sorted runs (strings, shared with the one before): yields (run, index,
    shared with the string yielded before)."""
    size = 1
    while size < len(runs):
        size *= 2
    n = [len(r[0]) for r in runs] + [0] * (size - len(runs))
    at = [0] * size
    known = [0] * size  # common prefix of a run's current string with the last string it lost to, or the last winner
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); both prefixes are known against the same string."""
        if at[a] >= n[a] or at[b] >= n[b]:
            return (a, b) if at[b] >= n[b] else (b, a)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = runs[a][0][at[a]], runs[b][0][at[b]]
        k = common(x, y, known[a])
        if x[k:k + 1] <= y[k:k + 1]:
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        for i in range(level):
            winners[i], loser[level + i] = play(winners[2 * i], winners[2 * i + 1])
    best = winners[0]
    while at[best] < n[best]:
        yield best, at[best], known[best]
        at[best] += 1
        if at[best] < n[best]:
            known[best] = runs[best][1][at[best]]
        node = (size + best) // 2
        while node:
            best, loser[node] = play(best, loser[node])
            node //= 2


def _bounds(length: int):
    """Reducer: for each suffix of each run, the smallest and largest o (``NONE``: none)."""
    def bounds(messages: list[bytes]) -> list[bytes]:
        runs = [_decode(m) for m in messages]
        merged = list(merge_runs([(r[0], r[1]) for r in runs]))
        total = len(merged)
        lcp = np.array([m[2] for m in merged], np.int32)
        right = np.array([len(runs[r][0][i]) for r, i, _ in merged], np.int32)
        prefixes = [runs[r][2][i] for r, i, _ in merged]
        weight = np.array([runs[r][3][i] for r, i, _ in merged], np.int64)
        left = np.array([len(p) for p in prefixes], np.int32)
        by_left = np.array(sorted(range(total), key=prefixes.__getitem__), np.int64)
        table = np.zeros((total, SPAN), np.uint8)
        for i, k in enumerate(by_left.tolist()):
            table[i, :left[k]] = np.frombuffer(prefixes[k], np.uint8)
        differ = table[1:] != table[:-1]
        first = np.where(differ.any(1), differ.argmax(1), SPAN) if total > 1 else np.zeros(0, np.int64)
        lcp_left = np.concatenate(([0], np.minimum(first, np.minimum(left[by_left][1:], left[by_left][:-1]))))
        low, high = np.full(total, NONE, np.uint8), np.full(total, NONE, np.uint8)
        for o in range(min(SPAN, length + 1)):
            depth = length - o
            fits = np.flatnonzero((right >= depth) & (left >= o))
            if not len(fits):
                continue
            after = np.cumsum(lcp < depth)
            before = np.empty(total, np.int64)
            before[by_left] = np.cumsum(lcp_left < o) if o else 0
            _, group = np.unique(after[fits] * (total + 1) + before[fits], return_inverse=True)
            again = fits[np.bincount(group, weight[fits])[group] > 1]
            low[again] = np.minimum(low[again], o)
            high[again] = o
        out = [np.full((2, len(r[0])), NONE, np.uint8) for r in runs]
        for k, (r, i, _) in enumerate(merged):
            out[r][:, i] = low[k], high[k]
        return [pack(o.tobytes()) for o in out]
    return bounds


def _apply(length: int, n_buckets: int, keep_text: bool):
    def apply(row):
        buf, starts, at, number, found = _contexts(row, length, n_buckets)
        mark = np.zeros(len(buf) + 1, np.int64)
        if len(at):
            parts = [np.frombuffer(unpack(a["data"]), np.uint8).reshape(2, -1) for a in row["bounds"]]
            low, high = np.concatenate(parts, axis=1)[:, number].astype(np.int64)
            hit = high != NONE
            np.add.at(mark, at[hit] - high[hit], 1)
            np.add.at(mark, at[hit] - low[hit] + length, -1)
        gone = np.cumsum(mark[:-1]) > 0
        for k, i in enumerate(row["ids"]):
            a, b = starts[k], starts[k + 1]
            out = gone[a:b]
            kept = buf[a:b][~out].tobytes()
            runs = int((np.diff(np.concatenate(([0], out.astype(np.int8)))) == 1).sum())
            yield (i, int(b - a), int(out.sum()), runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None)
    return apply


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                    ("kept_sha256", pa.string()), ("kept", pa.binary())])


def dedup_suffixes(docs: DataFrame, length: int = 200, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (if wanted) the kept bytes, for each row."""
    from .substrings import _seen_twice
    rows = chunk_table(docs)
    n_buckets = bucket_count(rows)
    rows = with_answers(rows, exchange(rows, _emit_hashes(length, n_buckets), _seen_twice, "twice"))
    rows = with_answers(rows, exchange(rows, _emit_runs(length, n_buckets), _bounds(length), "bounds"))
    out = rows.mapInArrow(per_row(_apply(length, n_buckets, keep_text), rows.columns, SCHEMA),
                          "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")
