"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores postings of all training tokens, chunk by chunk: terms ascending, and
for each term its positions. ``search`` sends the benchmark's windows to every index row; a
window's lists are taken rarest term first, shifted by the term's place in the window, and
intersected; what is left are exact phrase matches. The same lists, unshifted, give proximity
matches: all terms of a window within ``SLOP`` words around its rarest one.

The benchmark goes to the tasks in blocks of at most ``block_bytes`` of text, one pass over
the index for each, and passes are merged by document; the usual benchmark is one block.

Defined cases: null texts have no words; items without words occur nowhere; items with a null
id mark words and are not listed; items that share an id count once; document ids may be null
or repeat; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import chunk_texts, chunk_table, pack, pack_sorted, per_row, unpack, unpack_sorted
from .hashing import WORD_ALNUM, joined, words
from .stage import stage

WINDOW = 10
SLOP = 20
BLOCK_BYTES = 16 << 20

INDEX = pa.schema([("chunk_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())),
                   ("terms", pa.binary()), ("counts", pa.binary()), ("positions", pa.binary())])


def _index_row(row):
    buf, starts = joined(chunk_texts(row["lens"], row["blob"]))
    _, _, doc, wh = words(buf, starts, WORD_ALNUM, True)
    order = np.argsort(wh, kind="stable")
    terms, counts = np.unique(wh, return_counts=True)
    n_words = np.bincount(doc, minlength=len(row["ids"])).tolist()
    yield (row["chunk_id"], row["ids"], n_words, pack_sorted(terms), pack(counts.astype("<u4").tobytes()),
           pack(order.astype("<u4").tobytes()))


def build_index(docs: DataFrame) -> DataFrame:
    """Stage table of index rows: document ids, their word counts, and the postings."""
    rows = chunk_table(docs)
    return stage(rows.mapInArrow(per_row(_index_row, rows.columns, INDEX),
                                 "chunk_id long, ids array<long>, n_words array<long>, terms binary, counts binary, positions binary"), "index")


def item_windows(items: list[tuple], window: int = WINDOW) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (term hashes, one row a window; the items' numbers) of (id, text) items."""
    buf, starts = joined([(t or "").encode() for _, t in items])
    _, _, doc, wh = words(buf, starts, WORD_ALNUM, True)
    edge = np.searchsorted(doc, np.arange(len(items) + 1))
    rows: dict[int, list] = {}
    for k in range(len(items)):
        a, b = int(edge[k]), int(edge[k + 1])
        m = min(window, b - a)
        for i in range(a, b - m + 1) if m else ():
            rows.setdefault(m, []).append((wh[i:i + m], k))
    return {m: (np.array([r[0] for r in v], np.uint64), np.array([r[1] for r in v])) for m, v in rows.items()}


class Postings:
    """One index row, ready for look-ups: postings sorted by (term, position)."""

    def __init__(self, row):
        self.terms = unpack_sorted(row["terms"])
        self.counts = np.frombuffer(unpack(row["counts"]), "<u4").astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.positions = np.frombuffer(unpack(row["positions"]), "<u4").astype(np.int64)
        self.edge = np.concatenate(([0], np.cumsum(row["n_words"]))).astype(np.int64)
        self.wide = int(self.edge[-1]) + 1
        self.key = np.repeat(np.arange(len(self.terms)), self.counts) * self.wide + self.positions

    def seeds(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``term``, position) of all postings of the given term numbers."""
        n = self.counts[term]
        which = np.repeat(np.arange(len(term)), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, self.positions[self.first[term][which] + step]

    def next(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Each term's first posting at ``position`` or after (a key; beyond the last: a huge one)."""
        at = np.searchsorted(self.key, term * self.wide + position)
        return np.append(self.key, np.iinfo(np.int64).max)[at]

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edge, position, "right") - 1


def matches(index: Postings, windows: dict, slop: int = SLOP):
    """Exact (item, first position, length) and near (item, position) matches, concatenated."""
    exact, near = [], []
    for m, (terms, item) in windows.items():
        if not len(index.terms):
            continue
        at = np.minimum(np.searchsorted(index.terms, terms), len(index.terms) - 1)
        held = (index.terms[at] == terms).all(1)
        at, owner = at[held], item[held]
        if not len(at):
            continue
        order = np.argsort(index.counts[at], axis=1, kind="stable")  # rarest first
        rows = np.arange(len(at))
        which, position = index.seeds(at[rows, order[:, 0]])
        start, w = position - order[which, 0], which
        doc = index.doc(position)
        inside = (start >= index.edge[doc]) & (start + m <= index.edge[doc + 1])
        start, w = start[inside], w[inside]
        for k in range(1, m):
            term = at[w, order[w, k]]
            want = start + order[w, k]
            hit = index.next(term, want) == term * index.wide + want
            start, w = start[hit], w[hit]
        exact.append(np.stack([owner[w], start, np.full(len(w), m)]))
        low, high = np.maximum(position - slop, index.edge[doc]), np.minimum(position + slop, index.edge[doc + 1] - 1)
        w = which
        for k in range(1, m):
            term = at[w, order[w, k]]
            hit = index.next(term, low) <= term * index.wide + high
            position, low, high, w = position[hit], low[hit], high[hit], w[hit]
        near.append(np.stack([owner[w], position]))
    join = lambda parts, n: np.concatenate(parts, axis=1) if parts else np.zeros((n, 0), np.int64)
    return join(exact, 3), join(near, 2)


def _found(windows: dict, names: list):
    """Rows (chunk_id, place, doc_id, n_words, hits, items, near) of an index row's documents:
    hits is a bitmap over the document's words."""
    def found(row):
        index = Postings(row)
        exact, near = matches(index, windows)
        mark = np.zeros(int(index.edge[-1]) + 1, np.int64)
        np.add.at(mark, exact[1], 1)
        np.add.at(mark, exact[1] + exact[2], -1)
        hit = np.cumsum(mark[:-1]) > 0
        lists = []
        for part in (exact, near):
            own: dict[int, set] = {}
            for d, i in zip(index.doc(part[1]).tolist(), part[0].tolist()):
                own.setdefault(d, set()).add(names[i])
            lists.append(own)
        for k, i in enumerate(row["ids"]):
            a, b = index.edge[k], index.edge[k + 1]
            own = hit[a:b]
            yield (row["chunk_id"], k, i, int(b - a), pack(np.packbits(own).tobytes()) if own.any() else None,
                   sorted(x for x in lists[0].get(k, ()) if x is not None), sorted(x for x in lists[1].get(k, ()) if x is not None))
    return found


FOUND = pa.schema([("chunk_id", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                   ("hits", pa.binary()), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])
FOUND_DDL = "chunk_id long, place long, doc_id long, n_words long, hits binary, items array<string>, near array<string>"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                    ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("n_near_items", pa.int64())])
RESULT_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long"


def _result(doc_id, n_words, hits, items, near):
    n = sum(int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) for h in hits)
    return (doc_id, n_words, n, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n > 0, len(near))


def search(index: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items for each indexed document."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    passes = []
    for b in range(blocks):
        block = [(r["id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()]
        passes.append((item_windows(block), [i for i, _ in block]))
    if blocks == 1:
        one = _found(*passes[0])

        def final(row):
            for _, _, i, n, hits, own, near in one(row):
                yield _result(i, n, [unpack(hits)] if hits else [], own, near)
        return index.mapInArrow(per_row(final, index.columns, RESULT), RESULT_DDL)
    rows = None
    for windows, names in passes:
        part = index.mapInArrow(per_row(_found(windows, names), index.columns, FOUND), FOUND_DDL)
        rows = part if rows is None else rows.unionByName(part)
    merged = stage(rows, "hits").groupBy("chunk_id", "place", "doc_id", "n_words").agg(
        F.collect_list("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def merge(row):
        maps = [np.frombuffer(unpack(h), np.uint8) for h in row["hits"]]
        either = np.bitwise_or.reduce(maps).tobytes() if maps else b""
        yield _result(row["doc_id"], row["n_words"], [either], sorted(row["items"]), row["near"])
    return merged.mapInArrow(per_row(merge, merged.columns, RESULT), RESULT_DDL)


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    return search(build_index(docs), benchmark, block_bytes)
