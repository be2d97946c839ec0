"""Exact nearest rows in many columns (PS4, J13) by a tree of cells.

The study built a ball tree over all controls on the driver. Here a binary tree of median cuts
deals the controls' distinct vectors to cells, and each node has the box that its vectors fill:
no vector of a node is nearer to a query than its box. Each query

1. looks through the cell that it reaches by the nearer box at each node, which gives it a
   distance;
2. then looks through those other cells whose box is not above that distance, and no others.
   What it finds is the nearest vector: no cell that could hold a nearer or equal one is left
   out.

Cells meet queries in a cogroup on the cell, whose distances are computed in blocks (numpy, on
Arrow). The cuts come from a hash sample of both sides, which decides only how even the cells
are; every vector is dealt. Cells hold CELL_ROWS vectors, until there are CELLS of them: the
tree is a table of at most 2 x CELLS boxes, whatever the number of controls. Equal vectors are
one row on either side, so copies cost nothing.

How many cells a query must visit depends on how well distances tell vectors apart: few in a
handful of columns, many in dozens (``examined`` counts the pairs).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CELLS = 1 << 13
CELL_ROWS = 64      # vectors a cell is cut to, as far as the number of cells allows
SAMPLED = 16        # vectors a cell that its cuts are placed by
PAIRS = 1 << 20     # distances computed at a time
SLACK = 1e-9        # relative: bounds are rounded, distances are not trusted to the last bit


def scales(both: DataFrame, features: list[str]) -> list[float]:
    """1 / variance (population) of each feature over both arms; a constant one counts as it is."""
    row = both.agg(*[F.var_pop(f).alias(f) for f in features]).first()
    return [1.0 / v if v else 1.0 for v in row]


def _vectors(rows: DataFrame, features: list[str], key: list[str]) -> DataFrame:
    """(v, k): each distinct vector with its lowest key. Rows without a value in some feature
    have no distance to any other and take no part."""
    values = [F.col(f).cast("double") for f in features]
    whole = reduce(lambda a, b: a & b, [v.isNotNull() & ~F.isnan(v) for v in values])
    return rows.filter(whole).groupBy(F.array(*[v + 0.0 for v in values]).alias("v")) \
        .agg(F.min(F.struct(*key)).alias("k"))


def _cuts(sample: np.ndarray, weights: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(dims, values) of the inner nodes 1 .. 2^levels - 1 (the children of i are 2i and 2i + 1):
    the median of the widest column; values up to it go left."""
    dims, values = np.zeros(1 << levels, np.int64), np.full(1 << levels, np.inf)
    held = {1: sample}
    for node in range(1, 1 << levels):
        x = held.pop(node)
        if len(x):
            wide = weights * (x.max(axis=0) - x.min(axis=0)) ** 2
            dim = int(np.argmax(wide))
            cut = np.partition(x[:, dim], (len(x) - 1) // 2)[(len(x) - 1) // 2]
            dims[node], values[node] = dim, cut
        left = x[:, dims[node]] <= values[node]
        held[2 * node], held[2 * node + 1] = x[left], x[~left]
    return dims, values


class MetricIndex:
    """The pool's distinct vectors in cells. ``near``: rows that will ask, for even cells."""

    def __init__(self, pool: DataFrame, features: list[str], key: list[str], weights: list[float],
                 pivots: int | None = None, rings: int | None = None, near: DataFrame | None = None):
        self.weights, k = np.array(weights, float), len(features)
        vectors = cut_lineage(_vectors(pool, features, key))
        self.n = vectors.count()
        cells = (pivots or 1) * (rings or 1) if pivots or rings else max(1, min(CELLS, self.n // CELL_ROWS))
        self.levels = levels = max(0, int(np.ceil(np.log2(cells))))
        one_in = max(1, self.n // (SAMPLED << levels))
        sides = [vectors.select("v")] + ([near.select("v")] if near is not None else [])
        hashed = reduce(DataFrame.unionByName, sides).where(F.pmod(F.xxhash64("v"), F.lit(one_in)) == 0)
        # about SAMPLED rows a cell of either side, at most as many as the pool's
        taken = np.array([r[0] for r in hashed.limit(2 * SAMPLED << levels).collect()], float).reshape(-1, k)
        dims, values = _cuts(taken, self.weights, levels)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k)
                node, row = np.ones(len(x), np.int64), np.arange(len(x))
                for _ in range(levels):
                    node = 2 * node + (x[row, dims[node]] > values[node])
                yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("k"), pa.array((node - (1 << levels)).astype(np.int32))],
                                                 names=["v", "k", "cell"])

        self.key_type = vectors.schema["k"].dataType.simpleString()
        self.vectors = cut_lineage(vectors.mapInArrow(place, f"v array<double>, k {self.key_type}, cell int"))
        at = [F.get("v", F.lit(i)) for i in range(k)]
        boxes = self.vectors.groupBy("cell").agg(F.count(F.lit(1)), *[F.min(x) for x in at], *[F.max(x) for x in at])
        self.low, self.high = np.full((2 << levels, k), np.inf), np.full((2 << levels, k), -np.inf)
        self.sizes = np.zeros(1 << levels, np.int64)
        for r in boxes.collect():  # one row a cell
            self.sizes[r[0]], self.low[(1 << levels) + r[0]], self.high[(1 << levels) + r[0]] = r[1], r[2:2 + k], r[2 + k:]
        for node in range((1 << levels) - 1, 0, -1):
            self.low[node] = np.minimum(self.low[2 * node], self.low[2 * node + 1])
            self.high[node] = np.maximum(self.high[2 * node], self.high[2 * node + 1])

    def _bound(self):
        """For tasks: the least squared distance of vectors to the boxes of nodes."""
        low, high, weights = self.low, self.high, self.weights

        def bound(x: np.ndarray, node: np.ndarray) -> np.ndarray:
            out = np.maximum(np.maximum(low[node] - x, x - high[node]), 0.0)
            return (weights * out * out).sum(axis=1)

        return bound

    def _first(self, queries: DataFrame) -> DataFrame:
        """Each query's first cell."""
        bound, sizes, levels, k = self._bound(), self.sizes, self.levels, len(self.weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k)
                node = np.ones(len(x), np.int64)
                for _ in range(levels):
                    node = 2 * node + (bound(x, 2 * node + 1) < bound(x, 2 * node))
                cell = node - (1 << levels)
                yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(sizes[cell])], names=["v", "cell", "n"])

        return queries.select("v").mapInArrow(run, "v array<double>, cell int, n long")

    def _others(self, found: DataFrame) -> DataFrame:
        """The other cells that may hold a vector as near as the one found (v, cell, d2)."""
        bound, sizes, levels, k = self._bound(), self.sizes, self.levels, len(self.weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                    x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, k)
                    reach = part.column("d2").to_numpy() * (1 + SLACK)
                    row, node = np.arange(len(x)), np.ones(len(x), np.int64)
                    for _ in range(levels):
                        row, node = np.repeat(row, 2), np.stack((2 * node, 2 * node + 1), axis=1).ravel()
                        held = bound(x[row], node) <= reach[row]
                        row, node = row[held], node[held]
                    cell = node - (1 << levels)
                    other = cell != part.column("cell").to_numpy()[row]
                    row, cell = row[other], cell[other]
                    yield pa.RecordBatch.from_arrays([part.column("v").take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(sizes[cell])],
                                                     names=["v", "cell", "n"])

        return found.select("v", "cell", "d2").mapInArrow(run, "v array<double>, cell int, n long")

    def _nearest(self, probes: DataFrame) -> DataFrame:
        """(v, cell, d2, k, m): the nearest vector m of each probed cell, ties by key."""
        weights, k = self.weights, len(self.weights)
        names = ["v", "cell", "d2", "k", "m"]

        def search(held: pa.Table, asked: pa.Table) -> pa.Table:
            held, asked = held.combine_chunks(), asked.combine_chunks()
            if not held.num_rows or not asked.num_rows:
                return pa.table([asked.column("v").slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.float64()),
                                 held.column("k").slice(0, 0), held.column("v").slice(0, 0)], names=names)
            keys = pa.Table.from_struct_array(held.column("k"))
            keys = keys.rename_columns([str(i) for i in range(keys.num_columns)])
            held = held.take(pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names]))  # the first of equals is the lowest
            p = held.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            q = asked.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            best, d2 = np.empty(len(q), np.int64), np.empty(len(q))
            step = max(1, PAIRS // len(p))
            for at in range(0, len(q), step):
                total = None
                for i in range(k):  # summed in the features' order
                    gap = q[at:at + step, i, None] - p[None, :, i]
                    term = weights[i] * gap * gap
                    total = term if total is None else total + term
                best[at:at + step] = total.argmin(axis=1)
                d2[at:at + step] = total.min(axis=1)
            rows = pa.array(best)
            return pa.table([asked.column("v"), asked.column("cell"), pa.array(d2), held.column("k").take(rows), held.column("v").take(rows)], names=names)

        return self.vectors.groupBy("cell").cogroup(probes.select("v", "cell").groupBy("cell")).applyInArrow(
            search, f"v array<double>, cell int, d2 double, k {self.key_type}, m array<double>")

    def probes(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """For ``queries`` (v): the first probes, what they found, and the further probes."""
        first = self._first(queries)
        found = cut_lineage(self._nearest(first))
        return first, found, self._others(found)

    def nearest(self, queries: DataFrame) -> DataFrame:
        """(v, k, m): each query vector's nearest vector m of the pool and its lowest key; of
        several as near the one with the lowest key."""
        _, found, other = self.probes(queries)
        best = found.unionByName(self._nearest(other)).groupBy("v").agg(F.min(F.struct("d2", "k", "m")).alias("best"))
        return best.select("v", F.col("best.k").alias("k"), F.col("best.m").alias("m"))

    def examined(self, queries: DataFrame) -> int:
        """Pairs whose distance ``nearest`` computes."""
        first, _, other = self.probes(queries)
        return first.select("n").unionByName(other.select("n")).agg(F.sum("n")).first()[0] or 0


def nearest_rows(query: DataFrame, pool: DataFrame, features: list[str], key: list[str],
                 scaled: bool = True, pivots: int | None = None, rings: int | None = None) -> DataFrame:
    """Each ``query`` row (its key columns) with its nearest ``pool`` row, as ``m_<key>`` and
    ``m_<feature>``: Euclidean, on features standardised over both (``scaled``) or as they are;
    ties go to the lowest pool key. Rows with a missing feature are in no pair."""
    columns = [*key, *features]
    values = lambda df: df.select(*[F.col(f).cast("double").alias(f) for f in features])
    weights = scales(values(query).unionByName(values(pool)), features) if scaled else [1.0] * len(features)
    asked = cut_lineage(_vectors(query, features, key))
    index = MetricIndex(pool.select(*columns), features, key, weights, pivots, rings, asked)
    q = query.select(*columns).withColumn("v", F.array(*[F.col(f).cast("double") + 0.0 for f in features]))
    if not index.n:
        return q.limit(0).select(*key, *[F.col(k).alias(f"m_{k}") for k in key], *[F.col(f).cast("double").alias(f"m_{f}") for f in features])
    found = index.nearest(asked)
    return q.join(found, "v").select(*key, *[F.col(f"k.{k}").alias(f"m_{k}") for k in key], *[
        F.get("m", F.lit(i)).alias(f"m_{f}") for i, f in enumerate(features)])
