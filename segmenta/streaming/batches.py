"""Restartable batches: a file stream that runs until nothing is left and writes each unit once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_available(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: list[str]) -> None:
    """Process the files that have not been processed yet.

    The checkpoint remembers files, so a run after a failure goes on where the last ended. A batch that is run again after a
    loss leaves out the units that its earlier run already wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = work(batch)
        f = spark._jvm.org.apache.hadoop.fs.Path(sink)
        if f.getFileSystem(spark._jsc.hadoopConfiguration()).exists(f):
            done = done.join(spark.read.schema(done.schema).parquet(sink).select(*key), key, "left_anti")
        done.write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
