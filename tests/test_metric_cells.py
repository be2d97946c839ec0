"""The tree of cells behind many-column matching."""

import numpy as np
from pyspark.sql import functions as F

from cohortlab.operators import metric
from cohortlab.session import cut_lineage

KEY = ["p", "id"]


def _columns(spark, n, seed):
    return spark.range(n).select(F.lit(0).alias("p"), F.col("id").cast("int").alias("id"),
                                 *[F.rand(seed + i).alias(f) for i, f in enumerate("xyz")])


def test_work_of_a_query_hardly_grows_with_the_pool(spark):
    """Cells keep their size, so eight times the pool is far from eight times the pairs, and a
    probe is a row of its cell, without the distances to every pivot."""
    q = cut_lineage(metric._vectors(_columns(spark, 400, 50), ["x", "y", "z"], KEY))
    work = {}
    for n in (5_000, 40_000):
        index = metric.MetricIndex(_columns(spark, n, 70), ["x", "y", "z"], KEY, [1.0] * 3)
        assert index.sizes.sum() == n and index.sizes.max() < 4 * metric.CELL_ROWS
        work[n] = index.examined(q)
        assert index.probes(q)[0].columns == ["v", "cell", "n"]
    assert work[40_000] < 2 * work[5_000]


def test_cells_of_one_value_and_cuts(spark):
    dims, values = metric._cuts(np.array([[0.0, 1.0], [0.0, 5.0], [0.0, 9.0], [0.0, 9.0]]), np.ones(2), 2)
    assert list(dims[1:]) == [1, 1, 0] and list(values[1:]) == [5.0, 1.0, 0.0]  # equal rows are not cut
    same = spark.createDataFrame([(0, i, 2.0, 3.0) for i in range(200)] + [(0, 900, 2.0, 4.0)], "p int, id int, x double, y double")
    got = metric.nearest_rows(same, same, ["x", "y"], KEY, False, 8, 4).collect()
    assert len(got) == 201 and {(r.m_id, r.m_y) for r in got} == {(0, 3.0), (900, 4.0)}
