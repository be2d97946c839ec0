"""Connected components: union-find inside parts of the edges, contraction across parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import enter
from .stage import ship, stage

EDGES_A_PART = 500_000  # what one task's union-find holds; parts follow the edges' number

STARS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a part as stars: each node with the smallest node it is joined to."""
    enter("chunks")
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    up = list(range(len(nodes)))
    for x, y in zip(ends[:len(a)].tolist(), ends[len(a):].tolist()):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x < y:
            up[y] = x
        else:
            up[x] = y
    for i, x in enumerate(up):  # parents are smaller, so theirs are final
        up[i] = up[x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[np.array(up)])], schema=STARS)


def components(edges: DataFrame) -> DataFrame:
    """Stage table (node, comp) for the nodes of ``edges`` (a, b: longs, a is not b).

    Each round turns the parts of the remaining edges into stars. Once all edges fit one
    part its stars are the result. Else every node moves to the first node next to it, by id
    in even rounds and in random order in odd ones, and the edges between moved nodes remain."""
    ship(edges.sparkSession)
    left, labels, turn = stage(edges.where(F.col("a") != F.col("b")).distinct(), "edges"), None, 0
    while True:
        parts = max(1, -(-left.count() // EDGES_A_PART))
        stars = stage(left.coalesce(parts).mapInArrow(_stars, "a long, b long"), "stars")
        last = parts == 1
        if last:
            moves = stars.withColumnsRenamed({"a": "was", "b": "to"})
        else:
            order = (lambda c: F.struct(c.alias("o"), c.alias("n"))) if turn % 2 == 0 else \
                (lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("o"), c.alias("n")))
            both = stars.union(stars.select("b", "a"))
            moves = stage(both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
                          .select(F.col("a").alias("was"), F.least("m", order(F.col("a")))["n"].alias("to")), "moves")
        if labels is None:
            labels = moves.select(F.col("was").alias("node"), F.col("to").alias("comp"))
        else:
            labels = stage(labels.join(moves, F.col("comp") == F.col("was"), "left")
                           .select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        if last:
            return labels
        ends = stars.join(moves, F.col("a") == F.col("was")).select(F.col("to").alias("a"), "b") \
            .join(moves, F.col("b") == F.col("was")).select("a", F.col("to").alias("b"))
        left = stage(ends.where(F.col("a") != F.col("b")).distinct(), "edges")
        turn += 1
