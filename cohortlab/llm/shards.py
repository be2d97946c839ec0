"""Proportional stratified interleaving (DataFrame functions only).

Rows of each source are put in a seeded random order and given the fractional rank
(rank + 1/2) / source rows; sorted by it, every stretch of the sequence holds each
source in its share. The sequence is cut into shards whose row counts differ by one
at most. Both ranks are computed over buckets of a uniform key (the random key, then
the fractional rank itself), so neither a hot source nor the whole table meets in
one task; the text never takes part in a shuffle unless the caller carries it.

Defined cases: a null source is a stratum; rows that are equal in all columns take
neighbouring places in any order; an empty table gives an empty result; other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import distributed_rank, fresh, shielded

ROWS_A_BUCKET = 256
MOST_BUCKETS = 1 << 16  # bounds the running sums; parts grow beyond that, and stay sortable


def interleave(docs: DataFrame, n_shards: int, source: str = "source", tie: tuple[str, ...] = ("doc_id",),
               seed: int = 7) -> DataFrame:
    """``docs`` plus ``shard`` (0..n_shards-1) and ``slot`` (0-based place in the shard).
    ``tie`` names the columns that identify a row; they seed its random key."""
    docs, restore = shielded(docs, source, *tie)
    n = docs.count()
    buckets = max(1, min(MOST_BUCKETS, n // ROWS_A_BUCKET))
    u, m, r, f, g = fresh(docs, "_u", "_m", "_r", "_f", "_g")
    part = lambda x: F.least(F.floor(x * buckets), F.lit(buckets - 1)).cast("int")
    rows = docs.withColumn(u, F.xxhash64(F.lit(seed), *tie))
    unit = (F.shiftrightunsigned(u, 11)).cast("double") / float(1 << 53)
    rows = distributed_rank(rows, [source], [F.shiftrightunsigned(u, 11), F.col(u), *tie], part(unit), buckets, r)
    sizes = docs.groupBy(source).agg(F.count(F.lit(1)).alias(m)).withColumnRenamed(source, "_src")
    rows = rows.join(sizes, F.col(source).eqNullSafe(F.col("_src"))).drop("_src")
    rows = rows.withColumn(f, (2 * F.col(r) + 1) / (2 * F.col(m)))
    rows = distributed_rank(rows, [], [f, source, u, *tie], part(F.col(f)), buckets, g)
    rows = rows.withColumn("shard", F.expr(f"cast({g} * {n_shards} div {max(n, 1)} as int)"))
    first = F.expr(f"(shard * {max(n, 1)}L + {n_shards - 1}) div {n_shards}")  # ceil(shard * n / n_shards)
    return restore(rows.withColumn("slot", F.col(g) - first).drop(u, m, r, f, g))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, its rows in slot order over several files of slot ranges."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)
