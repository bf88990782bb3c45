"""Substring dedup over words: super-k-mers travel as packed strings to their minimiser's bucket, where sorting compares windows."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship, without
from .repeats import SPANS, Units, covered, keyed, repeated_spans, with_spans

#: Words of a window and of the stretch whose hash is minimised.
WINDOW, K = 50, 8
#: Distinct super-k-mers of one minimiser beyond which they are dealt again by another one.
BUCKET = 3000
#: Super-k-mers sorted at a time, and windows in memory before a sorted run goes to a file.
SORTED, HELD = 4000, 400_000
OUT = ("n_words", "n_removed", "kept")


class Runs:
    """Rows in sorted order, sorted runs of which lie in files once they are many."""

    def __init__(self, held: int):
        self.limit, self.rows, self.files = held, [], []

    def add(self, rows: list[tuple]) -> None:
        self.rows += rows
        if len(self.rows) > self.limit:
            self.rows.sort()
            f = tempfile.TemporaryFile(prefix="windows-")
            for lo in range(0, len(self.rows), 1000):
                pickle.dump(self.rows[lo : lo + 1000], f)
            f.seek(0)
            self.files.append(f)
            self.rows = []

    def merged(self) -> Iterator[tuple]:
        def read(f) -> Iterator[tuple]:
            with f:
                while True:
                    try:
                        yield from pickle.load(f)
                    except EOFError:
                        return

        self.rows.sort()
        return heapq.merge(self.rows, *map(read, self.files)) if self.files else iter(self.rows)


def _sorted_windows(items: list[tuple], window: int, held: int = HELD) -> list[tuple]:
    """items: (mini, h, first, packed). Sort all their windows; per item the word spans whose windows stand in a smaller first."""
    runs = Runs(held)
    for i, (_, _, first, packed) in enumerate(items):
        words = packed.split(b" ")
        at = [0]
        for w in words:
            at.append(at[-1] + len(w) + 1)
        runs.add([(packed[at[o] : at[o + window] - 1], first, i, o) for o in range(len(words) - window + 1)])
    hits: dict[int, list[int]] = {}
    text, least = None, 0
    for w, first, i, o in runs.merged():
        if w != text:
            text, least = w, first
        elif first > least:
            hits.setdefault(i, []).append(o)
    out = []
    for i, at in hits.items():
        at.sort()
        spans = []
        for o in at:
            if spans and o <= spans[-1]["e"]:
                spans[-1]["e"] = o + window
            else:
                spans.append({"s": o, "e": o + window})
        out.append((items[i][0], items[i][1], spans))
    return out


def _compare(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def table(items) -> pa.RecordBatch:
            found = _sorted_windows(items, window)
            cols = list(zip(*found)) or [[], [], []]
            kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], ["mini", "h", "runs"])

        for batch in batches:
            for item in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if len(held) >= SORTED and held[-1][0] != item[0]:
                    yield table(held)
                    held = []
                held.append(item)
        if held:
            yield table(held)

    def compare(rows: DataFrame) -> DataFrame:
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.select("mini", "h", "first", "packed").repartition(n, "mini").sortWithinPartitions("mini", "h")
        return rows.mapInArrow(run, f"mini long, h long, runs {SPANS}")

    return compare


def substring_dedup(docs: DataFrame, window: int = WINDOW, k: int = K, bucket: int = BUCKET) -> DataFrame:
    r"""Return docs plus n_words, n_removed and kept: each text less every word that lies in a window of `window` words
    whose sequence also starts in a document with a smaller doc_id, joined by single spaces.

    Words are runs of anything but `[\x20\x09-\x0D]`, unchanged; windows lie in one document and are judged on the input.

    A minimiser of more than `bucket` distinct super-k-mers is dealt again by minimisers of another order, some times over, so
    windows are compared by sorting in every bucket; what still is a large one is sorted in runs that lie in files.

    Defined results: null and empty texts have no words and keep the empty text; texts shorter than a window stay whole;
    rows that share a doc_id are one document, among which nothing is removed; null doc_ids come after all others and are
    one document; columns named n_words, n_removed or kept are replaced; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    spans, _ = repeated_spans(keyed(docs), Units(True, window, k), True, _compare(window), bucket)

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, gone in parts:
            out = []
            for t, g in zip(texts, gone):
                words = t.encode().split()
                if g is None or not len(g):
                    out.append((len(words), 0, b" ".join(words).decode()))
                else:
                    mask = covered(g, len(words))
                    out.append((len(words), int(mask.sum()), b" ".join([w for w, m in zip(words, mask.tolist()) if not m]).decode()))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    rows = with_spans(docs, spans, list(OUT)).withColumn("cut", cut("text", "spans"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in without(docs, OUT)], *[f"cut.{c}" for c in OUT])


def op8_substring_dedup(spark, sf_dir):
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), e AS (
  SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w
), x AS (
  SELECT doc_id, i, md5(array_to_string(ws[i : i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})
), m AS (
  SELECT h, min(doc_id) AS first FROM x GROUP BY h
), r AS (
  SELECT x.doc_id, x.i FROM x JOIN m USING (h) WHERE first < doc_id
), c AS (
  SELECT e.doc_id, e.i, e.word, coalesce(e.i - max(r.i) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS UNBOUNDED PRECEDING) < {WINDOW}, false) AS gone
  FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND e.i = r.i
), g AS (
  SELECT doc_id, count(*) AS n_words, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_removed, string_agg(CASE WHEN gone THEN NULL ELSE word END, ' ' ORDER BY i) AS kept FROM c GROUP BY 1
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM (SELECT doc_id FROM documents) LEFT JOIN g USING (doc_id)
"""
