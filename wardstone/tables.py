"""Reading the Parquet tables of a data folder, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt_out(df: DataFrame, key: str) -> DataFrame:
    """df over all cores where its scan has few tasks for them: a small table's row groups may lie in one task.

    Larger tables have tasks enough and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < 2 * cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local folder of its own only where that is unset and
    the master is local (tests); on a cluster an unset folder is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(shared_dir, "own", None)
        if not folder:
            folder = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="wardstone-")
    return folder.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: lineage is cut and lost executors lose nothing."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.shared_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete shared tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.shared_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
