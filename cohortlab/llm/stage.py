"""Stage tables: intermediate results written as Parquet where every executor sees them."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_STEPS: list[list[str]] = []  # stage tables made by each step of a pipeline, see ``pipeline_step``
_MAKING: list[list[str]] = []  # those of the step that is being built
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a plain
    ``local`` session (one process, as in tests) gets a scratch folder of its
    own; any other session is refused, as its executors would not see one."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) \
        or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="llm-stages-")
    return _LOCAL[app]


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_DEFAULT, BATCH_BYTES = "67108864b", "4194304b"


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session (once), and rows in batches of
    4 MB where the session has Spark's 64 MB: a batch of texts is held several times over,
    by the executor and by its workers."""
    if spark.conf.get(BATCH, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(here)
    path = os.path.join(tempfile.mkdtemp(prefix="llm-package-"), f"llm-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.write(os.path.join(top, "__init__.py"), "cohortlab/__init__.py")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"cohortlab/llm/{name}")
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back. A lost
    executor then costs the rerun of tasks from this table on, not from the
    sources. Each call has a folder of its own; a pipeline step's are removed after it
    (``pipeline_step``), others the caller's cluster expires."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    if _MAKING:
        _MAKING[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def pipeline_step(fn):
    """A step (spark, docs, sf_dir) -> DataFrame whose result is written and read again as
    the next one's ``docs``. The stage tables of a step are removed when the next one starts
    from ``docs`` that do not read them any more, or when ``end_steps`` is called."""
    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _STEPS else []
        for made in list(_STEPS):
            # a local folder's files are listed as file:///..., so folder names are compared, not whole paths
            if not any(p.rsplit("/", 1)[1] in f for p in made for f in read):
                remove(spark, made)
                _STEPS.remove(made)
        made: list[str] = []
        _STEPS.append(made)
        _MAKING.append(made)
        try:
            return fn(spark, docs, sf_dir)
        finally:
            _MAKING.pop()
    return run


def end_steps(spark: SparkSession) -> None:
    """Remove the stage tables of all steps: the last one's result is written."""
    for made in _STEPS:
        remove(spark, made)
    _STEPS.clear()


def shielded(docs: DataFrame, *needed: str):
    """``docs`` with all but the ``needed`` columns under names that no helper column has, and
    the function that gives them their names back. A column that the operator adds replaces
    one of the same name."""
    away = {c: f"__in{i}__" for i, c in enumerate(docs.columns) if c not in needed}

    def restore(out: DataFrame) -> DataFrame:
        added = {c.lower() for c in out.columns}
        lost = [new for old, new in away.items() if old.lower() in added]
        return out.drop(*lost).withColumnsRenamed({new: old for old, new in away.items() if new not in lost})

    return docs.withColumnsRenamed(away), restore


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that start with ``names`` and clash with none of ``df``'s."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def distributed_rank(df: DataFrame, group: list[str], order: list, bucket, n_buckets: int,
                     rank: str, ordered_buckets: bool = True) -> DataFrame:
    """0-based rank of each row within ``group`` without a task that holds the group.

    ``bucket`` (a Column, 0..n_buckets-1) cuts every group into parts; a row's rank
    is its place in its part plus the sizes of the parts before. Ranks follow
    ``order`` inside a part and the part number across parts, so with an
    ``ordered_buckets`` bucket (one that never decreases along ``order``) the rank
    is that of the whole order. The running sum reads at most ``n_buckets`` rows
    a group."""
    from pyspark.sql import Window
    b, k, r, before = fresh(df, "_rank_bucket", "_rank_k", "_rank_r", "_rank_before")
    df = df.withColumn(b, bucket)
    sizes = df.groupBy(*group, b).agg(F.count(F.lit(1)).alias(k))
    run = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(b).alias("_gb"),
                         F.coalesce(F.sum(k).over(run), F.lit(0)).alias(before))
    local = df.withColumn(r, F.row_number().over(Window.partitionBy(*group, b).orderBy(*order)) - 1)
    on = F.col(b) == F.col("_gb")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(sizes, on).withColumn(rank, (F.col(r) + F.col(before)).cast("long")) \
        .drop(b, r, before, "_gb", *[f"_g{i}" for i in range(len(group))])
