"""Session defaults and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings applied only when the session does not set them already.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Wide covariate projections generate methods above the JVM's 8000-byte
    # JIT limit, which then run uncompiled; at this limit Spark falls back to
    # per-operator code for such a stage instead (3x faster here).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_spark(master: str | None = None, app: str = "cohortlab",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create or reuse a session. ``master`` and ``shuffle_partitions`` are for
    local runs and tests; on a cluster leave them unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("COHORTLAB_DRIVER_MEM", "8g"))
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``. Where it is unset, a plain
    ``local`` session (one process: tests, bench) gets a scratch folder; any other
    session is refused, as its executors would not see one."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="cohortlab-stages-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return shared.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet stage table in the shared folder and read it back, so
    that a lost executor recomputes from here and later stages read only the columns
    they use."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    with free_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def free_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written within go when it is written. Else they stay on the
    executors' disks until the driver happens to collect its garbage, so that the disks hold
    those of all stages of a query at once."""
    old = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE) if old is None else spark.conf.set(FREE, old)


def split_hot_keys(spark: SparkSession) -> None:
    """Let the adaptive planner split a hot key's partition even where an aggregate above
    reuses the join's partitioning (it then adds a shuffle). Set on the caller's session,
    as the default is to leave such joins unsplit."""
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


TASK_BYTES = {  # setting: (Spark's default, what it is replaced by)
    "spark.sql.files.maxPartitionBytes": ("134217728b", "16777216b"),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864b", "8388608b"),
}
SCAN_FACTOR = ("spark.sql.sources.fileCompressionFactor", "1.0", "20.0")  # setting, Spark's default, what it is replaced by
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PARTITION_BYTES = 4 << 20  # of (compressed) input a shuffle partition


def fit_tasks(spark: SparkSession, folder: str) -> None:
    """Keep a task's rows, and so its sorts and hash tables, as many at any size of the tables:
    files are read in splits of 16 MB where the session has Spark's 128 MB (key columns are
    ten times that in memory), and shuffles start with a partition for each 4 MB of the
    folder's largest table, which adaptive execution joins to 8 MB, not to Spark's 64 MB.

    A scan counts as 20 times its compressed bytes, about what its rows are in memory. By the
    bytes of its files, a column of millions of keys is under the limit of a broadcast, and the
    driver would hold it in hash tables of hundreds of MB. Adaptive execution still broadcasts
    what it has measured to be small."""
    for name, (default, value) in [*TASK_BYTES.items(), (SCAN_FACTOR[0], SCAN_FACTOR[1:])]:
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, value)
    if spark.conf.get(INITIAL, None) is None or _INITIAL_SET.get(spark.sparkContext.applicationId) == spark.conf.get(INITIAL):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        size = max([files.getContentSummary(x.getPath()).getLength() for x in files.listStatus(path)], default=0)
        wanted = -(-size // PARTITION_BYTES)
        if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set(INITIAL, str(wanted))
            _INITIAL_SET[spark.sparkContext.applicationId] = str(wanted)
        else:
            spark.conf.unset(INITIAL)


_INITIAL_SET: dict[str, str] = {}  # what was set here, which a folder of another size changes
