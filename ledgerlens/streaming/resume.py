"""Streams that may be killed and run again: a sink that writes a batch over itself, and progress beside it."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def idempotent_sink(path: str, run: str, work: Callable[[DataFrame], DataFrame] | None = None, clock: Callable[[], float] = time.time) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes each batch to path/rows/run=.../batch=..., and a row to path/progress.

    A stream that was killed between a batch's write and its commit gets the same rows again under the same number; they
    take the place of what was written, so nothing stands twice and nothing is lost. The same holds for the progress row,
    which is written last: a batch with one is whole. work is applied to the batch before. Other runs are not touched.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark, began = rows.sparkSession, clock()
        own = lambda df: df.withColumn("run", F.lit(run)).withColumn("batch", F.lit(batch))
        save = lambda df, name: own(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch").parquet(f"{path}/{name}")
        given = rows.count()
        save(work(rows) if work else rows, "rows")
        # an empty batch leaves no partition behind, and so nothing to write over
        save(spark.createDataFrame([(given, clock() - began)], "given long, seconds double"), "progress")

    return write


def run_to_end(stream: DataFrame, path: str, run: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process all that has arrived, from where an earlier call of the same run left off, and stop. checkpoint: a folder of
    this run in storage that all executors share."""
    query = stream.writeStream.foreachBatch(idempotent_sink(path, run, work)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def results_of(spark: SparkSession, path: str, run: str) -> DataFrame:
    """What a run has written: batches that have a progress row."""
    done = spark.read.parquet(f"{path}/progress").where(F.col("run") == run).select("run", "batch")
    return spark.read.parquet(f"{path}/rows").where(F.col("run") == run).join(done, ["run", "batch"], "left_semi")


def progress_of(spark: SparkSession, path: str, run: str) -> DataFrame:
    """(batch, given, so_far, seconds) of a run, in order of batches: the checkpoint that a user looks at."""
    from pyspark.sql import Window

    upto = Window.partitionBy("run").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    rows = spark.read.parquet(f"{path}/progress").where(F.col("run") == run)
    return rows.select("batch", "given", F.sum("given").over(upto).alias("so_far"), "seconds")
