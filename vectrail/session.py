"""Session defaults and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vectrail")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VECTRAIL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; Spark prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task sorts and groups.
TASK_ROWS = 250_000


def parts_for(rows: DataFrame) -> int:
    """Partitions that hold about ``TASK_ROWS`` of these rows each, so that a task's memory does not grow with them; at least one a core.

    Counts the rows, which of a Parquet table takes its footers only. A number given
    to ``repartition`` is kept by adaptive execution, which would join small partitions.
    """
    spark = rows.sparkSession
    cores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(cores, -(-rows.count() // TASK_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where none is named, a local session, as in tests, gets a temporary one; on a
    cluster that raises, as executors would not see a folder of the driver's.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; survives lost executors.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes it once
    nothing refers to it.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _stored_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stored-{spark.sparkContext.applicationId}"


def stored_path(spark: SparkSession) -> str:
    """A new place in the shared folder, which ``clear_stored`` deletes."""
    return f"{_stored_dir(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Columnar, so later readers take only the columns that they use.
    ``clear_stored`` deletes what an application stored.
    """
    spark = df.sparkSession
    path = stored_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> None:
    """Deletes all that ``stored`` wrote in this application; frames that read it are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stored_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
