"""Session settings and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own.

    ``shared`` is the folder for written intermediate tables, which the caller may delete.
    """
    builder = SparkSession.builder if shared is None else SparkSession.builder.config("spark.checkpoint.dir", shared)
    return (
        builder.master(f"local[{cores}]")
        .appName("creditloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        # The JVM never compiles methods above this size; split them instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local-mode session may fall back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    fallback = tempfile.mkdtemp(prefix="creditloom-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def use_checkpoints(spark: SparkSession) -> None:
    """Make sure iterative fits can cut their lineage."""
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(stored: DataFrame) -> None:
    """Delete the table that ``materialise`` wrote for a frame, once nobody reads it any more."""
    spark = stored.sparkSession
    folders = {file.rsplit("/", 1)[0] for file in stored.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        shared = system.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)))
        if path.getParent().equals(shared):
            system.delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage for good: what follows neither repeats the work behind the
    frame nor depends on the executors that did it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
