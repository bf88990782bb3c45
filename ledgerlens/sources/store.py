"""Where tables that outlive one plan are kept: the shared folder of the cluster, and cuts in long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share. Where it is unset, a temporary folder in
    local mode; on a cluster an error, as executors would not see such a folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, sized: bool = True) -> DataFrame:
    """df, written to the shared folder by checkpoint(), so that no plan grows from round to round and a lost executor loses
    nothing. The files go with the reference where spark.cleaner.referenceTracking.cleanCheckpoints is set.

    checkpoint() hands on Spark's estimate of df's size, a whole number of any length. Where each round joins what the last
    one left with itself, its digits double every round: some 4 MB after 20 rounds, 4 GB after 30, all on the driver. A loop of
    many rounds asks for a frame of unknown size (sized=False); joins are then chosen by the sizes that are met on the way."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    out = df.checkpoint()
    if sized:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().logical().rdd(), out._jdf.schema(), False), spark)
