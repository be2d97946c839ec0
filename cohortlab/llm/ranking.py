"""Ranked lexical search over a length-stratified index.

Each document keeps its length n and the counts tf of the query terms it holds (a stage
table). Its normaliser m follows from n and two sums over the corpus. Documents meet by m
(``repartitionByRange`` on m and a hash, so that a common m is spread over tasks). A task
builds strata of equal m; in a stratum postings lie by term and falling tf, and the impact
of a tf is computed once for the stratum. A term's first posting gives its bound there; the
sum of an item's bounds is the most that a document of the stratum can score. An item
visits strata by falling bound until its 50th best score is above the next bound.

Items come in blocks of bounded size, one at a time, each with its own stage tables. The
best of each task are merged in two steps, so no group grows with the number of tasks.

Defined cases: a null text has no terms; equal rows are documents (or items) of their own,
an item's rows share nothing but its id; null document ids rank after others of equal score;
other columns are ignored; without documents, items or common terms the result is empty.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import texts_of
from .stage import ship, stage

TOP = 50
BLOCK_ITEMS = 4096
BLOCK_BYTES = 4 << 20      # item text on the driver and in a task at a time
TASK_POSTINGS = 2_000_000  # postings a task reads
MERGE_WAYS = 256

# [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+ over UTF-8 bytes, A-Z lower-cased, the rest spaces
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


@dataclass
class Block:
    """Some items: their ids, the term numbers of each, and the terms' numbers."""
    ids: list
    items: list[np.ndarray]
    vocabulary: dict[bytes, int]


def item_blocks(items: DataFrame) -> Iterator[Block]:
    """The items in blocks; the driver holds one block."""
    ids, texts, size = [], [], 0

    def block() -> Block:
        vocabulary: dict[bytes, int] = {}
        rows = [np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(x)}), np.int64) for x in texts]
        return Block(ids, rows, vocabulary)

    for item_id, text in items.select("item_id", F.encode("text", "UTF-8")).toLocalIterator():
        text = bytes(text or b"")
        if ids and (len(ids) == BLOCK_ITEMS or size + len(text) > BLOCK_BYTES):
            yield block()
            ids, texts, size = [], [], 0
        ids.append(item_id)
        texts.append(text)
        size += len(text)
    if ids:
        yield block()


def term_counts(docs: DataFrame, block: Block) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: its length and, as
    little-endian 32-bit numbers, the block's terms in it and their counts."""
    vocabulary = block.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, terms, tfs = [], [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                words = terms_of(text)
                if not words:
                    continue
                held = Counter(filter(None.__ne__, map(vocabulary.get, words)))
                ids.append(i)
                ns.append(len(words))
                terms.append(np.fromiter(held.keys(), "<i4", len(held)).tobytes())
                tfs.append(np.fromiter(held.values(), "<i4", len(held)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())],
                names=["doc_id", "n", "terms", "tfs"])

    ship(docs.sparkSession)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def term_weights(counted: DataFrame, size: int, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each of the block's terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    df = np.zeros(size, np.int64)
    rows = counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in rows.collect():  # at most the block's terms
        df[r["term"]] = r["df"]
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Strata:
    """Documents of one task in strata of equal m."""

    def __init__(self, m: np.ndarray, docs: np.ndarray, null: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray]):
        order = np.argsort(m, kind="stable")
        self.docs, self.null = docs[order], null[order]
        value, self.first = np.unique(m[order], return_index=True)
        self.last = np.append(self.first[1:], len(m))
        place = np.empty(len(m), np.int64)
        place[order] = np.arange(len(m))
        row = place[np.repeat(np.arange(len(m)), [len(t) for t in terms])]
        term, tf = np.concatenate(terms).astype(np.int64), np.concatenate(tfs).astype(np.int64)
        stratum = np.searchsorted(self.first, row, "right") - 1
        by = np.lexsort((row, -tf, stratum, term))
        self.row, term, tf, stratum = row[by], term[by], tf[by], stratum[by]
        # runs of equal (term, stratum, tf): one impact each
        new = np.ones(len(term), bool)
        new[1:] = (np.diff(term) != 0) | (np.diff(stratum) != 0) | (np.diff(tf) != 0)
        at = np.flatnonzero(new)
        impact = 1_000_000_000 * tf[at] // (1000 * tf[at] + 20 * value[stratum[at]])
        self.impact = np.repeat(impact, np.diff(np.append(at, len(term))))
        # lists of equal (term, stratum): where each starts, and its bound, the impact of its largest tf
        head = np.ones(len(at), bool)
        head[1:] = (np.diff(term[at]) != 0) | (np.diff(stratum[at]) != 0)
        self.list_at = at[head]
        self.list_end = np.append(self.list_at[1:], len(term))
        self.list_term, self.list_stratum, self.list_bound = term[self.list_at], stratum[self.list_at], impact[head]

    def search(self, item: np.ndarray, weight: np.ndarray, best: list[tuple[int, int, int]], top: int) -> list[tuple[int, int, int]]:
        """``best`` (-score, null id, doc) with this task's documents merged in, the ``top`` first."""
        a, b = np.searchsorted(self.list_term, item), np.searchsorted(self.list_term, item, "right")
        lists = np.concatenate([np.arange(x, y) for x, y in zip(a, b)]) if len(item) else np.zeros(0, np.int64)
        w = np.repeat(weight[item], b - a)
        lists, w = lists[w > 0], w[w > 0]
        if not len(lists):
            return best
        by = np.argsort(self.list_stratum[lists], kind="stable")
        lists, w = lists[by], w[by]
        strata, start = np.unique(self.list_stratum[lists], return_index=True)
        end = np.append(start[1:], len(lists))
        bound = np.add.reduceat(w * self.list_bound[lists], start)
        for k in np.argsort(-bound, kind="stable"):
            if len(best) == top and bound[k] < -best[-1][0]:
                break
            mine, s = lists[start[k]:end[k]], strata[k]
            size = self.list_end[mine] - self.list_at[mine]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.list_at[mine], size)
            # sums stay below 2^53, so doubles are exact
            gain = (np.repeat(w[start[k]:end[k]], size) * self.impact[step]).astype(np.float64)
            low = self.first[s]
            score = np.bincount(self.row[step] - low, gain, self.last[s] - low).astype(np.int64)
            floor = -best[-1][0] if len(best) == top else 1
            hit = np.flatnonzero(score >= floor)
            if len(hit) > top:  # of the stratum's hits only its own best can be among the best
                hit = hit[np.lexsort((self.docs[low + hit], self.null[low + hit], -score[hit]))[:top]]
            if len(hit):
                new = zip((-score[hit]).tolist(), self.null[low + hit].tolist(), self.docs[low + hit].tolist())
                best = sorted([*best, *new])[:top]
        return best


def search_block(counted: DataFrame, block: Block, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of each item of the block (by its place)."""
    items = block.items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in items]
        held: list[tuple] = []
        size = 0

        def search() -> None:
            ids = [h[1] for h in held]
            strata = Strata(np.array([h[0] for h in held], np.int64), np.array([0 if i is None else i for i in ids], np.int64),
                            np.array([i is None for i in ids], np.int64), [h[2] for h in held], [h[3] for h in held])
            for k, item in enumerate(items):
                best[k] = strata.search(item, weight, best[k], top)

        for batch in batches:
            for m, i, terms, tfs in zip(*(batch.column(c).to_pylist() for c in ("m", "doc_id", "terms", "tfs"))):
                held.append((m, i, np.frombuffer(terms, "<i4"), np.frombuffer(tfs, "<i4")))
                size += len(terms) // 4
                if size > 2 * TASK_POSTINGS:  # a larger task goes in parts
                    search()
                    held, size = [], 0
        if held:
            search()
        rows = [(k, None if null else i, -score) for k, found in enumerate(best) for score, null, i in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))],
                                             names=["item", "doc_id", "score"])

    postings = counted.select((F.sum(F.length("terms")) / 4).cast("long")).first()[0] or 0
    parts = max(8, -(-postings // TASK_POSTINGS))
    m = (F.lit(50) + F.expr(f"(50L * n * {n_docs}L) div {max(n_terms, 1)}L")).alias("m")
    strata = counted.where(F.length("terms") > 0).select("doc_id", "terms", "tfs", m) \
        .repartitionByRange(parts, "m", F.xxhash64("doc_id", "terms"))
    return strata.mapInArrow(run, "item int, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each row of ``items``
    (item_id, text) with a score above 0, by falling score, then document id."""
    id_type = items.schema["item_id"].dataType
    out, spark = None, docs.sparkSession
    for block in item_blocks(items):
        counted = stage(term_counts(docs, block), "term-counts")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = term_weights(counted, len(block.vocabulary), n_docs)
        found = search_block(counted, block, weight, n_docs, n_terms, top)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        way = F.pmod(F.spark_partition_id(), F.lit(MERGE_WAYS))
        for keys in (["item", "_way"], ["item"]):
            found = found.withColumn("_way", way) if "_way" in keys else found
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))) \
                .where(F.col("rank") <= top)
        ids = spark.createDataFrame(list(enumerate(block.ids)), f"_item int, item_id {id_type.simpleString()}")
        found = stage(found.join(F.broadcast(ids), F.col("item") == F.col("_item"))  # at most BLOCK_ITEMS rows
                      .select("item_id", "rank", "doc_id", "score"), "ranked")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return items.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return out
