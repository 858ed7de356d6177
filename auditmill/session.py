"""Session set-up and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Limits of Arrow batches of long texts: few rows and bytes, so that a task holds some megabytes at a time.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def build_session(cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("auditmill")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a table scan over all cores, for work that is heavy per row.

    A small table may be a single split and would be worked on by one task. A table with
    enough splits is left as it is, so at scale nothing is shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def bound_batches(spark: SparkSession) -> None:
    """Set the limits of Arrow batches that the session leaves open."""
    for name, value in BATCH_LIMITS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder for stored stages that driver and executors share.

    `spark.checkpoint.dir` names it, or the checkpoint folder of the session. A local session
    without either gets a folder of its own; on a cluster that would lose rows, so it raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="auditmill-stages-"))
    return spark.sparkContext.getCheckpointDir()


def store(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and go on from the stored columns.

    Cuts the lineage, survives lost executors, and later scans read only the columns they name."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/auditmill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
