"""Folders of tables on the cluster's file system, through Hadoop's own client."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
WAREHOUSE_SETTING = "spark.sql.warehouse.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the checkpoint folder, else one in the warehouse.

    Nothing here is removed by the library, as results may be read from it until
    the session ends; whoever runs the session clears the folder afterwards.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    warehouse = spark.conf.get(WAREHOUSE_SETTING, None)
    if not warehouse:
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
    return f"{warehouse}/_work"


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder name under the shared one."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


class Folder:
    """One folder: what is in it, and removing it."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path
        self._new_path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = self._new_path(path)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def make(self) -> None:
        self._fs.mkdirs(self._path)

    def remove(self) -> None:
        self._fs.delete(self._path, True)

    def move_to(self, path: str) -> None:
        if not self._fs.rename(self._path, self._new_path(path)):
            raise OSError(f"could not move {self._path.toString()} to {path}")

    def names(self) -> list[str]:
        """Names directly inside; none when the folder does not exist."""
        if not self.exists():
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(self._path))

    def partition_values(self, column: str) -> list[str]:
        """Values of the top partition column, from folder names alone: no file is opened."""
        prefix = f"{column}="
        return [unquote(name[len(prefix):]) for name in self.names() if name.startswith(prefix)]

    def partition(self, column: str, value: object) -> Folder | None:
        """The folder of one partition; its name spells some characters in another way."""
        for name in self.names():
            if name.startswith(f"{column}=") and unquote(name[len(column) + 1:]) == str(value):
                return Folder(self._spark, f"{self.path}/{name}")
        return None


def literal_path(path: str) -> str:
    """The path as a literal for Spark's readers, which take glob patterns."""
    return "".join(f"\\{c}" if c in "*?[]{}\\" else c for c in path)


def qualified_path(spark: SparkSession, path: str) -> str:
    """The path with its file system's scheme, as readers name files."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(file).toString()


def path_of_url(spark: SparkSession, url: str) -> str:
    """The path that a reader's ``_metadata.file_path``, which is a URL, stands for."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(url)).toString()


def first_line(spark: SparkSession, path: str, encoding: str) -> str | None:
    """The first line of a text file; None if it is empty."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    try:
        java_io = spark._jvm.java.io
        return java_io.BufferedReader(java_io.InputStreamReader(stream, encoding)).readLine()
    finally:
        stream.close()


def count_rows(df: DataFrame, observation) -> DataFrame:
    """Count rows while they are written; ``observation.get['rows']`` after the action.

    Put it after the last shuffle, so that it counts in the writing stage: there
    a task that is run again for a lost one does not count twice.
    """
    return df.observe(observation, F.count(F.lit(1)).alias("rows"))
