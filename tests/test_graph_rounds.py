"""Pairs that no list of neighbours would take in don't leave the task where they meet."""

import numpy as np
import pyarrow as pa

from ledgerlens.operators import vector_index as V


def test_far_pairs_stay():
    x = np.random.default_rng(0).normal(size=(12, 8)).astype(np.float32)
    model = V.Quantiser(np.zeros((1, 8), np.float32), np.stack([x[:, :4], x[:, 4:]]))
    code = pa.array([bytes([i, i]) for i in range(12)], pa.binary())

    def met(least):
        cols = [pa.array(np.zeros(12, np.int64)), pa.array(np.arange(12)), pa.array(np.zeros(12, np.int32)), code, pa.array(np.full(12, least, np.float32))]
        out = V._met(model, 5)(iter([pa.RecordBatch.from_arrays(cols, ["g", "node", "cell", "code", "least"])]))
        return [(r["src"], r["dst"], r["near"]) for b in out for r in b.to_pylist()]

    every = met(-np.inf)
    assert len(every) == 60
    assert met(1.0) == [r for r in every if r[2] >= 1.0] and len(met(1.0)) < 60
