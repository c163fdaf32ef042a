"""A folder of drawings as a stream: each batch of new files is analysed on its own, as drawings don't depend on each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.analysis import Analysis, analyse
from ..plans.store import Keeper


def watch(
    spark: SparkSession, entities: str, schema: str, checkpoint: str, sink: Callable[[Analysis, int], None], available_now: bool = True
) -> StreamingQuery:
    """Analyses of the entity tables (Parquet) that arrive in a folder; ``sink(analysis, batch)`` writes them.

    What an analysis is made of is kept in the shared folder until its sink returns. A sink that replaces what it wrote for the
    same batch makes the stream exactly-once. No state is kept between batches.
    """

    def each(batch: DataFrame, number: int) -> None:
        with Keeper(batch.sparkSession) as keep:
            sink(analyse(keep(batch), keep=keep), number)

    writer = spark.readStream.schema(schema).parquet(entities).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
