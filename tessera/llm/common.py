"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: ASCII white space: the separators of words in texts.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Where the session names none, a local session gets one of this machine; on a cluster that is an error, since executors
    would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


class Scratch:
    """Tables written once and read again, so that lineage ends there and lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, scratch_dir(spark), 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}-{name}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.scratch_path = path
        return table

    def drop(self, table: DataFrame) -> None:
        """Removes a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns of ``docs`` as one struct, so that no name of theirs meets one of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns])


def unpacked(row: str, columns: list[str]) -> list[Column]:
    return [F.col(row)[c].alias(c) for c in columns]


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; null stays null."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
