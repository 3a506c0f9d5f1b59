"""Where a loop of joins would double its plan each round, the result of a round is written and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder, ``name`` beginning its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """The table of the last round of a loop: writing a round removes the one before, which nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.path = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", None

    def settle(self, df: DataFrame) -> DataFrame:
        before, self.path = self.path, f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        if before:
            there = self.spark._jvm.org.apache.hadoop.fs.Path(before)
            there.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)
        return self.spark.read.schema(df.schema).parquet(self.path)
