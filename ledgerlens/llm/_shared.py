"""What the operators of this subpackage have in common: shared scratch tables and null-safe text."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a set of characters for trim().
SPACES = " \t\n\x0b\f\r"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where the setting is missing, a temporary folder of this machine in local
    mode, where all tasks see it; on a cluster an error, as executors would not."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stash(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df to a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    Operators drop what they have read; a table that their result still reads goes when the application ends.
    """
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(where)
    give_back()  # shuffle files of what has been written go once the driver has let go of their plans
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_stash(spark: SparkSession, path: str) -> None:
    """Remove a table that stash() wrote, through Spark's own file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_of(column: str = "text"):
    """A text column as a string, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text):
    """A-Z lower-cased, all else unchanged. lower() has a fast way for pure ASCII, where it means the same."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def without(df: DataFrame, names) -> list[str]:
    """df's columns but for those an operator writes itself; names compare as Spark compares them."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own, changed until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where it isn't installed on the executors."""
    import os
    import zipfile
    from pathlib import Path

    sc, top = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(sc, "_ledgerlens_shipped", False):
        return
    where = os.path.join(tempfile.mkdtemp(prefix="ship-"), "ledgerlens-package.zip")
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(where)
    sc._ledgerlens_shipped = True


def give_back() -> None:
    """Return what this process has freed to the system. Python workers live on from task to task, and what an earlier one
    let go of counts as memory of the executor until then."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library has no such call everywhere
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most about `most` bytes of one column (or one row)."""
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
