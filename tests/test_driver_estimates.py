"""What the driver holds for a graph's walk doesn't grow with its rounds, nor for a quantiser with the table."""

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import vector_index as V


def vectors(spark, n):
    x = np.random.default_rng(3).normal(size=(n, 8))
    return spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<float>")


def test_estimated_sizes_stay_short(spark, tmp_path, monkeypatch):
    """Each round's estimate was the product of two that held the last round's: its digits doubled, 40 times by default."""
    bits, cut = [], V.cut

    def watched(df, **how):
        out = cut(df, **how)
        bits.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return out

    monkeypatch.setattr(V, "cut", watched)
    v, path = vectors(spark, 300), str(tmp_path / "ix")
    V.write_index(v, path)
    V.write_graph(V.read_index(spark, path), path, degree=6, rounds=4, group=16)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    assert V.graph_topk(V.read_index(spark, path, graph=True), q, 5, beam=40, step=2, starts=1, rounds=7, short=40).count() == 15
    assert len(bits) >= 12 and max(bits) <= 64


def test_sample_of_a_large_table(spark):
    """Of a table of over four times the sample, rows with a large hash are dropped before they are ordered; the sample is the same."""
    v = vectors(spark, 1000)
    first = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(50)
    one, other = V.fit_quantiser(v, cells=4, codes=16, sample=50), V.fit_quantiser(first, cells=4, codes=16, sample=50)
    assert np.array_equal(one.centres, other.centres) and np.array_equal(one.books, other.books)
    assert len(V.fit_quantiser(v.where("vec_id < 3"), sample=50).centres) == 3
