"""Python tasks turn a bounded part of a batch into objects at a time, with the same rows."""

import numpy as np
import pyarrow as pa

from ledgerlens.functions import text as X
from ledgerlens.operators import chunks as C
from ledgerlens.operators import routing as G


def test_parts_are_bounded():
    texts = ["x" * n for n in (5, 0, 30, 3, 3, 3, 9)] + [None, "é" * 4]
    batch = pa.record_batch([pa.array(range(9)), pa.array(texts)], ["id", "text"])
    parts = list(X.in_parts([batch, batch.slice(0, 0)], 1, 10))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(9))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 10 for p in parts)


def test_chunks_and_names_in_parts(spark):
    texts = [(i, 0, f"ﬁrst part {i}. " + "word " * (40 * i) + "; tail, 年报") for i in range(30)] + [(40, 0, ""), (41, 0, None)]
    rows = spark.createDataFrame(texts, "doc_id long, parent int, text string").coalesce(1)
    got = sorted((r.doc_id, r.child, r.text) for r in C.child_chunks(rows, 50, 10).collect())
    want = [(d, i, p) for d, _, t in texts if t for i, p in enumerate(C.split_text(t, 50, 10, C.SEPARATORS_CJK))]
    assert got == sorted(want)
    names = spark.createDataFrame([("first part 7",), ("tail",)], "alias string")
    hit = G.alias_matches(rows.select("doc_id", "text"), names, "doc_id").collect()
    assert {(r.doc_id, r.alias) for r in hit} == {(i, "tail") for i in range(30)} | {(7, "first part 7")}
    assert not np.isnan([r.position for r in hit]).any()
