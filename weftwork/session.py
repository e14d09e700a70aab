"""A session with the settings the jobs expect, and the folder that its machines share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "weftwork", **conf: str) -> SparkSession:
    """UTC, adaptive plans; settings given as keywords use _ for . and come last."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from spark.checkpoint.dir.

    Only a local session may go without that setting; it then gets a folder of its own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="weftwork-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def path_exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def free_shuffles(spark: SparkSession) -> None:
    """Lets go of the shuffle files of jobs that are over, which stay on disk until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


class Steps:
    """Tables that a job of several rounds writes to the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.at: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = self.path(str(self.n))
        df.write.parquet(path)
        free_shuffles(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._step = path
        self.at.add(path)
        return out

    def keep(self, *dfs: DataFrame) -> None:
        """Deletes all other tables written here."""
        for path in self.at - {df._step for df in dfs}:
            self._delete(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table written here that nothing reads any more."""
        self._delete(df._step)

    def _delete(self, path: str) -> None:
        self.at.discard(path)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
