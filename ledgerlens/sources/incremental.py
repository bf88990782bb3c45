"""An incremental document store: files that changed are read again, the rest stays, files that went are gone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Refresh:
    """What a refresh did: files by what happened to them, and the store's generation."""

    generation: int
    added: int
    changed: int
    removed: int
    kept: int

    @property
    def read(self) -> int:
        return self.added + self.changed


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, state): the files below a folder and what tells one state of a file from another, its size and time of change.
    Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    m = F.col("_metadata")
    return files.select(m["file_path"].alias("file"), "path", F.concat_ws("-", m["file_size"], F.unix_micros(m["file_modification_time"])).alias("state"))


def _manifest(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.schema("file string, state string, generation int").parquet(f"{store}/manifest")
    except AnalysisException:
        return None


def refresh(spark: SparkSession, folder: str, store: str, read: Callable[[list[str]], DataFrame], pattern: str = "*") -> Refresh:
    """Bring a store up to date with a folder of files.

    read(paths) gives the rows of some files (a table, documents, chunks, index entries), with a column `file`, which is
    _metadata.file_path. It is called with files that are new or have changed, and with no others. Their rows are
    appended as a new generation, and a manifest with the state of every file is written last: a refresh that is killed
    leaves the store as it was, and the next one does the work again. Nothing is rewritten; compact() drops old rows.
    """
    now = list_files(spark, folder, pattern)
    before = _manifest(spark, store)
    last = before.agg(F.max("generation")).first()[0] if before is not None else None
    known = before.where(F.col("generation") == last).select("file", F.col("state").alias("old")) if last is not None else spark.createDataFrame([], "file string, old string")
    both = now.join(known, "file", "full").select("file", "path", "state", F.when(F.col("old").isNull(), "added").when(F.col("state").isNull(), "removed").when(F.col("old") != F.col("state"), "changed").otherwise("kept").alias("what"))
    both = both.cache()
    counts = {r["what"]: r["count"] for r in both.groupBy("what").count().collect()}
    generation = (last or 0) + 1
    todo = both.where(F.col("what").isin("added", "changed"))
    files = [r["path"] for r in todo.select("path").collect()]  # the paths of changed files, as any reader is given them
    if files:
        # the state goes with the rows: rows of a state that the manifest doesn't name are not seen
        rows = read(files).join(todo.select("file", "state"), "file")
        rows.withColumn("generation", F.lit(generation)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation").parquet(f"{store}/rows")
    if files or counts.get("removed") or last is None:
        both.where(F.col("what") != "removed").select("file", "state").withColumn("generation", F.lit(generation)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation").parquet(f"{store}/manifest")
    else:
        generation = last
    both.unpersist()
    return Refresh(generation, *(counts.get(k, 0) for k in ("added", "changed", "removed", "kept")))


def current(spark: SparkSession, store: str) -> DataFrame:
    """The rows of all files as they were at the last refresh."""
    manifest = _manifest(spark, store)
    if manifest is None:
        raise FileNotFoundError(f"no store at {store}")
    last = manifest.agg(F.max("generation")).first()[0]
    rows = spark.read.parquet(f"{store}/rows")
    return rows.join(manifest.where(F.col("generation") == last).select("file", "state"), ["file", "state"], "left_semi").drop("state", "generation")


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Write the store anew, without rows of files that changed or went, to another path."""
    manifest = _manifest(spark, store)
    last = manifest.agg(F.max("generation")).first()[0]
    now = manifest.where(F.col("generation") == last)
    rows = spark.read.parquet(f"{store}/rows").join(now.select("file", "state"), ["file", "state"], "left_semi")
    rows.withColumn("generation", F.lit(last)).write.mode("overwrite").partitionBy("generation").parquet(f"{target}/rows")
    now.write.mode("overwrite").partitionBy("generation").parquet(f"{target}/manifest")
