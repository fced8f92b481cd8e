"""Session helpers: settings the operators rely on, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: without call-site capture for every column expression, wide plans are built several times faster
QUICK_BUILD = ("spark.python.sql.dataFrameDebugging.enabled", "false")
#: shuffle files go as soon as what they were made for is written, and not when the driver next collects its garbage
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session settings that change results (wall-clock arithmetic is UTC)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.isModifiable(QUICK_BUILD[0]):
        spark.conf.set(*QUICK_BUILD)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session for tests and the benchmark."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scintlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config(*QUICK_BUILD)
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def stage_root(spark: SparkSession) -> str:
    """Shared folder for written stages: ``spark.checkpoint.dir``; a new scratch folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage of iterative work, survives the loss of executors, and gives the planner the real size of
    the table, so that a following join is broadcast only when the size is below the session's threshold. Nothing reads the
    shuffle files of a written stage again, so they are removed with it.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    if compression:
        w = w.option("compression", compression)
    before = spark.conf.get(CLEAN_UP, None) if spark.conf.isModifiable(CLEAN_UP) else "true"
    if before != "true":
        spark.conf.set(CLEAN_UP, "true")
    try:
        w.parquet(path)
    finally:
        if before != "true":
            spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


def used_up(*stages: DataFrame) -> None:
    """Remove the files of stages whose last use is a stage that is written already; other tables are left alone."""
    for df in stages:
        path = vars(df).get("_stage")
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            del df._stage
