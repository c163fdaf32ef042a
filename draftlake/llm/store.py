"""Intermediate tables in the folder that all executors share, and other helpers of the operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; a folder of our own only where it is unset on one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="draftlake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Written tables of one operator call: they cut lineage, survive the loss of executors and are read again as Parquet.

    A table lives until ``drop`` or the end of the Python process: results are lazy and may read it at any later time.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/draftlake-{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._remove, self.at)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._remove(df._scratch_path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass


def vocabulary_files(spark: SparkSession, names: tuple[str, ...] = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")) -> list[str]:
    """Files of ranks in the folder that ``spark.draftlake.tokenizers`` names; they are read on the driver alone."""
    folder = spark.conf.get("spark.draftlake.tokenizers", "/opt/tokenizers")
    return [os.path.join(folder, n) for n in names]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(text: Column) -> Column:
    """Tells apart rows that share a doc_id but not the text."""
    return F.xxhash64(text)
