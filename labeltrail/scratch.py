"""Lineage cuts: intermediate tables written to the shared checkpoint folder.

A written table survives the loss of executors, keeps column pruning and size
statistics, and pins values that depend on how rows were partitioned.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, tables go below the warehouse, which is shared too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def _session_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark).rstrip('/')}/labeltrail/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; frames built on them end here."""
    _delete(spark, _session_folder(spark))


class Rounds:
    """Tables of a loop: those of a round are deleted once the next round's are written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.before: list[str] = []
        self.now: list[str] = []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.now.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def end(self) -> None:
        """The round is over and nothing built on the tables before it is needed any more."""
        for path in self.before:
            _delete(self.spark, path)
        self.before, self.now = self.now, []


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
