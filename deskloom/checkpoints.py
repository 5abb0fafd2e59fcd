"""Cutting lineage by tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that all executors share: below spark.checkpoint.dir, by application.

    Without that setting, a session of one machine gets a temporary folder; on a cluster it is an error, as executors do
    not see each other's folders. The application's folder is deleted when its driver ends.
    """
    context = spark.sparkContext
    root = _own.get(context.applicationId)
    if root is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        root = _own[context.applicationId] = f"{shared.rstrip('/')}/deskloom-{context.applicationId}"
        path, files = _path(spark, root)
        files.deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of shared_folder() that nothing reads any more."""
    path, files = _path(spark, folder)
    files.delete(path, True)


class Written:
    """A table that was computed once and written to the shared folder, so that its lineage is cut there."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.folder = shared_folder(self.spark, "table")
        df.write.parquet(self.folder)
        self.df = self.spark.read.schema(df.schema).parquet(self.folder)

    def remove(self) -> None:
        removed(self.spark, self.folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the folder that all executors share; its lineage is cut there."""
    return Written(df).df
