"""Stored vector indexes: recall against brute force, what is read, copies, empty tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import retrieval as R
from ledgerlens.operators import vector_index as V
from ledgerlens.plans import search


def pairs(df):
    return {(r.qid, r.vec_id) for r in df.select("qid", "vec_id").collect()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_codes_and_graph(spark, sf):
    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    true = pairs(search.dense_topk_cosine(spark, d))
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    assert search._short(n) <= n / 10  # whole vectors read for a question
    assert len(true & pairs(search.dense_topk_by_cell(spark, d))) >= 0.9 * len(true)
    walked = search.dense_topk_by_graph(spark, d).cache()
    assert len(true & pairs(walked)) >= 0.9 * len(true)
    # the walk counts what it compares; these vectors are noise, in which any walk sees much of a small table
    print(sf, "compared", walked.agg(F.avg("compared")).first()[0], "of", n)


def test_graph_of_clusters_compares_little(spark, tmp_path):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 16))
    x = centres[np.repeat(np.arange(60), 50)] + 0.2 * rng.normal(size=(3000, 16))
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    V.write_index(v, str(tmp_path / "ix"))
    V.write_graph(V.read_index(spark, str(tmp_path / "ix")), str(tmp_path / "ix"))
    index = V.read_index(spark, str(tmp_path / "ix"), graph=True)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    true = pairs(R.dense_topk(q, v, 5))
    got = V.graph_topk(index, q, 5, beam=48, step=16, short=48).cache()
    assert len(true & pairs(got)) >= 0.9 * len(true)
    assert got.agg(F.max("compared")).first()[0] < 0.5 * 3000
    # a few probes are enough where vectors cluster
    assert len(true & pairs(V.pq_topk(index, q, 5, short=60, probes=4))) >= 0.9 * len(true)


def test_copies_and_edges(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 10))  # a dimension that no stretch divides
    rows = [(i, x[i].tolist()) for i in range(90)] + [(i, x[0].tolist()) for i in range(100, 160)] + [(200, None), (201, [0.0] * 10)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    V.write_index(v, str(tmp_path / "ix"))
    V.write_graph(V.read_index(spark, str(tmp_path / "ix")), str(tmp_path / "ix"))
    index = V.read_index(spark, str(tmp_path / "ix"), graph=True)
    assert index.rows == 151
    q = v.where("vec_id in (0, 7, 201)").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    true = {(r.qid, r.rank): (r.vec_id, r.score) for r in R.dense_topk(q.where("qid < 200"), v.where("vec_id < 200"), 5).collect()}
    for found in (V.pq_topk(index, q, 5, short=150), V.graph_topk(index, q, 5, short=150)):
        got = {(r.qid, r.rank): (r.vec_id, round(r.score, 3)) for r in found.collect() if r.qid < 200}
        assert got == {k: (i, round(s, 3)) for k, (i, s) in true.items()}  # copies: the least ids, none twice
    V.write_index(v.where("false"), str(tmp_path / "none"))
    none = V.read_index(spark, str(tmp_path / "none"))
    assert none.rows == 0 and V.pq_topk(none, q, 5).count() == 0
    with pytest.raises(ValueError):
        V.graph_topk(none, q, 5)
