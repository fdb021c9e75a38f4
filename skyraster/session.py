"""Session settings and lineage cuts shared by the iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: Removes the shuffle files of a query as soon as it has ended.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Settings the plans are written for.  All of them can be changed at run time.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "skyraster", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; keyword arguments override them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_dirs: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests, a laptop) gets a folder of its own: on
    a cluster a machine-local folder would be lost with its executor, so there it is an error.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="skyraster-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the file system Spark resolves it to, for code that opens files itself."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lineage cut with real statistics."""
    return materialize_counted(df, name, partition_by=partition_by)[0]


def materialize_counted(
    df: DataFrame, name: str, metrics: dict | None = None, partition_by: list[str] | None = None
) -> tuple[DataFrame, dict]:
    """Like :func:`materialize`; row count and extra ``metrics`` are observed in the same job."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    exprs = [F.count(F.lit(1)).alias("rows")]
    exprs += [column.alias(key) for key, column in (metrics or {}).items()]
    writer = df.observe(seen, *exprs).write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    # What was shuffled for a written table is not read again; without this it stays until the driver collects garbage.
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path), seen.get
