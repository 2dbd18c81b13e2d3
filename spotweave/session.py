"""Session set-up for local runs, and the shared working folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHUFFLES_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # at the end of a query, from Spark 4.1 on
ROWS_A_TASK = 500_000  # that meet in one task of a join or of groups, about


def local_session(app: str = "spotweave", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks. A cluster brings its own session and settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPOTWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; on one machine too, as workers start anywhere."""
    context = spark.sparkContext
    if getattr(context, "_spotweave_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spotweave-")) / "spotweave.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._spotweave_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session whose master is local may go without that setting: it gets a temporary folder, which is
    then the checkpoint folder of the session. On a cluster such a folder would be another one on each machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spotweave-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, for one written table or stream checkpoint."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder once and continue from the files.

    For a costly intermediate that one plan reads several times: lost executors re-read files instead of
    recomputing, and nothing is held in memory. What was shuffled for it is removed once it is written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(SHUFFLES_REMOVED, "false")
    spark.conf.set(SHUFFLES_REMOVED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_REMOVED, before)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(*written: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once whatever was made of them is written too."""
    for df in written:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The frame with its rows dealt by the keys to so many tasks that each gets about ROWS_A_TASK of them.

    A session's own number of shuffle partitions, and what adaptive execution joins to one task by bytes of compressed rows, let
    the sorts and hash tables of a task grow with the table. Few rows pass through without a shuffle.
    """
    spark = df.sparkSession
    tasks = -(-rows // ROWS_A_TASK)
    enough = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df if tasks <= enough else df.repartition(tasks, *keys)
