"""Session, tables and shared folders for all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("clausemill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt over all cores by a key if it lies in fewer splits than there are cores, as one small file does; large tables
    stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """A new folder, not yet there, that the driver and all executors share.

    It lies below spark.checkpoint.dir, or else below the folder given to setCheckpointDir(). Only where neither is set and
    Spark runs in this one process is it a temporary one, which then also becomes the session's; a cluster without is an error.
    """
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not top:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="clausemill-")
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/clausemill-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read again, with its lineage cut."""
    shared_folder(df.sparkSession)  # sets a checkpoint folder, or fails
    return df.checkpoint()


def written(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """`df` as a Parquet table in a shared folder (a new one, or path): a checkpoint in columns, for larger results."""
    path = path or shared_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
