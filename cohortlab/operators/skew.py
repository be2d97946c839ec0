"""A full outer join in one shuffle of each side, hot keys spread.

AQE splits a skewed shuffle partition of inner, semi, anti and one-sided outer joins, but not
of a FULL OUTER join: there, one key holding a third of the rows would be joined in a single
task. ``full_outer_join`` therefore decides the spread before its one join:

1. Both sides are tagged and united in a stage table, so each source is scanned once.
2. Each side's rows are counted per hash of the key (``SLOTS`` of them, so a task sends at
   most that many small rows), and per key only in slots that hold more than ``split_rows``
   rows, which most data has none of. Keys with more than ``split_rows`` rows on a side are
   kept: at most rows / split_rows of them. Such a key has as many parts as its larger side
   fills.
3. A hot key's rows on the larger side are dealt to its parts by their place in the stage
   table, those on the other side are repeated in each part, and the join is on (key, part).
4. A key that stands on both sides has a partner for each of its rows. A part may have got
   none of the larger side's rows, so a repeated row that stays alone there is dropped.

Rows with a NULL key never match: they go round the join. The plan is the same at every size,
and nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SPLIT_ROWS = 1 << 20
SLOTS = 1 << 16


def full_outer_join(left: DataFrame, right: DataFrame, keys: list[str],
                    split_rows: int = SPLIT_ROWS, distinct: bool = False) -> DataFrame:
    """FULL OUTER JOIN USING ``keys`` (keys merged, NULL keys never match).
    Same rows as the plain join or, with ``distinct``, its distinct rows, for sides that hold
    distinct rows: as a pair holds all columns of its two rows, and a lone row's key is on one
    side, only lone rows with a NULL key can then be equal."""
    lcols = [c for c in left.columns if c not in keys]
    rcols = [c for c in right.columns if c not in keys]
    side, part, parts, deal_left, both = "__side__", "__part__", "__parts__", "__deal_left__", "__both__"
    tagged = cut_lineage(left.select(*keys, *lcols, F.lit(True).alias(side)).unionByName(
        right.select(*keys, *rcols, F.lit(False).alias(side)), allowMissingColumns=True))

    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    keyed = tagged.where(~no_key)
    counts = [F.count(F.when(F.col(side), 1)).alias("__l__"), F.count(F.when(~F.col(side), 1)).alias("__r__")]
    many = F.greatest("__l__", "__r__") > split_rows
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).alias("__slot__")
    full = cut_lineage(keyed.groupBy(slot).agg(*counts).where(many).select("__slot__"))
    hot = cut_lineage(keyed.withColumn("__slot__", slot).join(full, "__slot__", "left_semi")
                      .groupBy(*keys).agg(*counts).where(many).select(
        *keys, F.ceil(F.greatest("__l__", "__r__") / split_rows).cast("long").alias(parts),
        (F.col("__l__") >= F.col("__r__")).alias(deal_left),
        (F.least("__l__", "__r__") > 0).alias(both)))

    place = F.monotonically_increasing_id()
    numbered = keyed.withColumn(part, place).join(hot, keys, "left")
    dealt = F.array(F.pmod(F.col(part), F.col(parts)))
    where = F.when(F.col(parts).isNull(), F.array(F.lit(0).cast("long"))) \
             .when(F.col(side) == F.col(deal_left), dealt) \
             .otherwise(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    spread = numbered.withColumn(part, F.explode(where))

    repeated = F.col(parts).isNotNull() & F.col(both) & (F.col(side) != F.col(deal_left))
    l = spread.where(side).select(*keys, part, *lcols, F.lit(True).alias("__in_l__"), repeated.alias("__rep_l__"))
    r = spread.where(~F.col(side)).select(*keys, part, *rcols, F.lit(True).alias("__in_r__"), repeated.alias("__rep_r__"))
    lonely = (F.col("__in_r__").isNull() & F.col("__rep_l__")) | (F.col("__in_l__").isNull() & F.col("__rep_r__"))
    joined = l.join(r, [*keys, part], "full_outer").where(~F.coalesce(lonely, F.lit(False))).select(*keys, *lcols, *rcols)
    alone = tagged.where(no_key).select(*keys, *lcols, *rcols)
    return joined.unionByName(alone.distinct() if distinct else alone)
