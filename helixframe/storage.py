"""Lineage cuts: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.sparkContext.setCheckpointDir(root)
    return root if ":" in root else f"file://{root}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended; the folder then stays in the shared root
        return


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared root, removed when the driver ends."""
    path = f"{shared_root(spark)}/helixframe-{name}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared folder and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._helixframe_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove the files of tables that ``materialize`` gave and that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_helixframe_path", None)
        if path:
            remove(t.sparkSession, path)
