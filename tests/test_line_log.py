"""The line log: whatever fails and runs again, a line is there once."""

import pytest
from pyspark.sql import functions as F

from quern.sources.line_log import LineLog, Written, _Place, _StreamWriter


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    spark.dataSource.register(LineLog)


def read(spark, path):
    return sorted(r.value for r in spark.read.format("line_log").load(path).collect())


def test_batches_append_and_a_failed_one_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read(spark, path) == []
    lines = spark.createDataFrame([("a\nb",), ("é|,",), (None,), ("",)], "value string").repartition(3)
    lines.write.format("line_log").mode("append").save(path)
    lines.write.format("line_log").mode("append").save(path)
    assert read(spark, path) == sorted(["a\nb", "é|,", ""] * 2)
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="no"):
        broken.write.format("line_log").mode("append").save(path)
    assert read(spark, path) == sorted(["a\nb", "é|,", ""] * 2)


def test_a_batch_that_is_repeated_after_a_kill_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    writer = _StreamWriter(_Place(path), "s")
    once = [writer.write(iter([("x",), ("y",)])), writer.write(iter([("z",)]))]
    writer.write(iter([("lost",)]))  # a task whose executor died after it had written
    writer.commit(once, 7)
    again = [writer.write(iter([("x",), ("y",)])), writer.write(iter([("z",)])), None, Written("never-there", 1)]
    writer.commit(again, 7)  # the driver died between commit and progress, and the batch ran again
    assert read(spark, path) == ["x", "y", "z"]
    writer.abort([writer.write(iter([("w",)])), None], 8)
    assert read(spark, path) == ["x", "y", "z"]


def test_streams_in_and_out(spark, tmp_path):
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    spark.range(3).selectExpr("concat('l', id) AS value").write.format("line_log").mode("append").save(first)

    def run():
        stream = spark.readStream.format("line_log").option("path", first).load().select(F.upper("value").alias("value"))
        stream.writeStream.format("line_log").option("path", second).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start().awaitTermination()

    run()
    assert read(spark, second) == ["L0", "L1", "L2"]
    run()
    spark.range(3, 5).selectExpr("concat('l', id) AS value").write.format("line_log").mode("append").save(first)
    run()
    run()
    assert read(spark, second) == ["L0", "L1", "L2", "L3", "L4"]
