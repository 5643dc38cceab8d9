"""Lineage cuts that survive lost executors, and the folder of a run's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set and the master is local (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder of all tables that this application cuts its plans with."""
    return f"{shared_folder(spark)}/strandline/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove the run's tables, once nothing reads its results any more. What is asked for later is written anew."""
    remove(spark, run_folder(spark))


def remove(spark: SparkSession, folder: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, folder: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: computed once, with a plan that starts anew."""
    path = f"{run_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Replaced:
    """A cut that a loop makes again and again: the table before is removed once the next one is whole, and rows are
    counted while they are written."""

    def __init__(self):
        self._path: str | None = None

    def __call__(self, df: DataFrame, counted: str = "true") -> tuple[DataFrame, int]:
        """(the table, the number of its rows that `counted` holds for)."""
        spark, seen = df.sparkSession, Observation()
        path = f"{run_folder(spark)}/cut-{uuid.uuid4().hex}"
        df.observe(seen, F.count_if(F.expr(counted)).alias("n")).write.parquet(path)
        if self._path:
            remove(spark, self._path)
        self._path = path
        return spark.read.schema(df.schema).parquet(path), seen.get["n"]
