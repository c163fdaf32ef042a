"""Intermediate results that survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only where it is unset on one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="draftlake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Keeper:
    """Tables computed once and written as Parquet to the shared folder, where their lineage ends; all go with ``close``.

    A column that a later step doesn't need isn't read again. What isn't closed goes at the end of the process.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/draftlake-kept-{uuid.uuid4().hex}", 0
        atexit.register(self.close)

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass

    def __enter__(self) -> Keeper:
        return self

    def __exit__(self, *_) -> None:
        self.close()


_KEEPERS: dict[str, Keeper] = {}


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder until the end of the process; a ``Keeper`` of one's own goes earlier."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _KEEPERS:
        _KEEPERS[app] = Keeper(spark)
    return _KEEPERS[app](df)
