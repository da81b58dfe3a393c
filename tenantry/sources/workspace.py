"""Folders that driver and executors share, for tables that are written and read again within a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset, a temporary folder. Elsewhere it must be set."""
    global _own
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="tenantry-domain-")
    return _own


def new_dir(spark: SparkSession) -> str:
    """The path of a folder that nothing else uses."""
    return f"{shared_dir(spark)}/domain-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(path, its file system) of Hadoop, so that any store that Spark reads will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


class Workspace:
    """Written tables of one job. They cut lineage, survive lost executors and go with drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, new_dir(spark), 0

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            remove(self.spark, t.workspace_path)
