"""Running streams to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Fixed value: the store that state with timers, lists and maps needs.
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, at: str, sink: str | Callable[[DataFrame, int], None] = "parquet", schema: str | None = None) -> DataFrame | None:
    """Run a stream over all that its source holds, batch by batch; what it wrote, read again.

    Results and progress lie below `at`, so a run that breaks off goes on where it stopped.
    sink may be a function of a micro-batch and its number instead; then nothing is read.
    """
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{at}/progress").trigger(availableNow=True)
        writer = writer.foreachBatch(sink) if callable(sink) else writer.format(sink).option("path", f"{at}/out")
        writer.start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    if callable(sink):
        return None
    return spark.read.schema(schema or stream.schema).parquet(f"{at}/out")
