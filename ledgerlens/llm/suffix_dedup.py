"""Suffix-array dedup over bytes: external induced sorting finds every long string that starts more than once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship, without
from .repeats import SPANS, Units, covered, keyed, repeated_spans, with_spans
from .suffix_sort import repeated_windows

#: Bytes of a repeated string, and of the stretch whose hash is minimised to deal strings to shards.
WINDOW, K = 400, 32
#: Bytes that one sort takes at least, where a task has so many; strings of one bucket are sorted together.
SHARD = 3 << 20
#: Distinct strings of one minimiser beyond which they are dealt again by another one.
BUCKET = 3000
OUT = ("n_bytes", "n_removed", "n_spans", "kept")


def _compare(window: int, shard: int):
    def sort(items: list[tuple]) -> pa.RecordBatch:
        """items: (mini, h, n, packed). Suffix-sort all their bytes; spans of each that stands once itself."""
        sizes = np.array([len(x[3]) for x in items])
        text = np.zeros(int(sizes.sum()) + len(items), np.uint8)  # 0 parts the strings; no byte of UTF-8 is 255
        usable = np.zeros(len(text), bool)
        at = np.cumsum(sizes + 1) - sizes - 1
        for p, (_, _, _, packed) in zip(at.tolist(), items):
            text[p : p + len(packed)] = np.frombuffer(packed, np.uint8)
            text[p : p + len(packed)] += 1
            usable[p : p + len(packed) - window + 1] = True
        hit = repeated_windows(text, window, usable)
        out = []
        for p, n, (mini, h, count, _) in zip(at.tolist(), sizes.tolist(), items):
            if count == 1 and (o := np.flatnonzero(hit[p : p + n])).size:
                first = np.concatenate(([0], np.flatnonzero(np.diff(o) > window) + 1))
                last = np.append(first[1:], len(o)) - 1
                out.append((mini, h, [{"s": a, "e": b + window} for a, b in zip(o[first].tolist(), o[last].tolist())]))
        cols = list(zip(*out)) or [[], [], []]
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], ["mini", "h", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for item in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if size >= shard and held[-1][0] != item[0]:
                    yield sort(held)
                    held, size = [], 0
                held.append(item)
                size += len(item[3])
        if held:
            yield sort(held)

    def compare(rows: DataFrame) -> DataFrame:
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.select("mini", "h", "n", "packed").repartition(n, "mini").sortWithinPartitions("mini", "h")
        return rows.mapInArrow(run, f"mini long, h long, runs {SPANS}")

    return compare


def suffix_dedup(docs: DataFrame, window: int = WINDOW, k: int = K, shard: int = SHARD, bucket: int = BUCKET) -> DataFrame:
    """Return docs plus n_bytes, n_removed, n_spans and kept (binary): each text's UTF-8 bytes less every byte under a
    `window`-byte string that also starts anywhere else, in this document or another.

    Matches never cross documents; overlaps count; strings are judged on the input. The bytes kept are in order; they need
    not be valid UTF-8.

    Strings that share a minimiser are dealt to one shard, and shards are suffix-sorted by external induced sorting, whose
    queues lie in files of the executor's own temporary folder while the task runs (a lost task starts its shard anew). A
    minimiser of more than `bucket` distinct strings is dealt again by minimisers of another order, some times over.

    Defined results: null and empty texts have no bytes; texts shorter than the window stay whole; repeated rows are
    places of their own, so both lose what they share; null doc_ids are documents like others; columns of the four names
    are replaced; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    spans, _ = repeated_spans(keyed(docs), Units(False, window, k), False, _compare(window, shard), bucket)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gone in parts:
            out = []
            for t, g in zip(texts, gone):
                raw = t.encode()
                if g is None or not len(g):
                    out.append((len(raw), 0, 0, raw))
                else:
                    mask = covered(g, len(raw))
                    runs = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    out.append((len(raw), int(mask.sum()), runs, np.frombuffer(raw, np.uint8)[~mask].tobytes()))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    rows = with_spans(docs, spans, list(OUT)).withColumn("cut", cut("text", "spans"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in without(docs, OUT)], *[f"cut.{c}" for c in OUT])


def op3_suffix_dedup(spark, sf_dir):
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
