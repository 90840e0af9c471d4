"""Tables written to the shared folder of the cluster, to fix results that must not change on recompute."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, else the checkpoint folder already set.

    Only a session that runs in one process may do without either; it gets a temporary folder. On a cluster every
    executor would write to a disk of its own, and what is read back would be incomplete, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowlib-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cleanup(spark: SparkSession) -> bool:
    """Delete all tables that this application has stored; DataFrames that read them can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/flowlib-{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below one folder per application, which may be deleted when the application has ended."""
    return f"{scratch_root(spark)}/flowlib-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def small_side(df: DataFrame, name: str = "small") -> DataFrame:
    """A table meant for the small side of a join, stored so that the planner knows its size.

    An aggregate has no known size before it runs, so a join with it would shuffle the large side first.
    Read back from files, it is broadcast if it is under ``spark.sql.autoBroadcastJoinThreshold`` and
    shuffled otherwise.
    """
    return stored(df, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet and read it back: later plans see one fixed table, even after lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
