"""Configurations: what they name is used, what they don't is never touched, what makes no sense is refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import backends as K
from ledgerlens.operators import retrieval as R


def refuse(top):
    raise AssertionError("a backend that is off was asked")


def test_settings():
    assert K.Settings.of({"unknown": 1, "use_tag_db": False, "vector_index_type": " HNSW "}).vector_index_type == "hnsw"
    assert K.Settings().active == ["vector", "tag"] and K.Settings(vector_search_k=7).depth(3) == 7 and K.Settings().depth(3) == 6
    for bad in ({"vector_index_type": "tree"}, {"use_vector_dbs": False, "use_tag_db": False}, {"fusion_method": "sum"}):
        with pytest.raises(ValueError):
            K.Settings.of(bad)
    assert K.Settings(use_vector_dbs=False, use_tag_db=False, full_context=True).active == []


def test_only_what_is_on(spark):
    lists = {n: spark.createDataFrame(rows, "q int, k int, score double, rank int") for n, rows in {"bm25": [(1, 5, 9.0, 1), (1, 6, 3.0, 2), (2, 7, 1.0, 1)], "tag": [(1, 6, 0.9, 1), (1, 8, 0.1, 2)]}.items()}
    backends = {"bm25": lambda k: lists["bm25"].where(F.col("rank") <= k), "tag": lambda k: lists["tag"].where(F.col("rank") <= k), "vector": refuse, "sparse": refuse}
    one = K.retrieve(K.Settings(use_vector_dbs=False, use_tag_db=False, use_bm25_db=True, top_n_retrieval=1), backends, ["q"], "k").collect()
    assert sorted(tuple(r) for r in one) == [(1, 5, 9.0, "bm25", 1), (2, 7, 1.0, "bm25", 1)]
    both = K.retrieve(K.Settings(use_vector_dbs=False, use_bm25_db=True, fusion_method="average"), backends, ["q"], "k").collect()
    assert sorted((r.q, r.k, r.score, r.sources) for r in both) == [(1, 5, 0.5, "bm25"), (1, 6, 0.5, "bm25,tag"), (1, 8, 0.0, "tag"), (2, 7, 0.5, "bm25")]
    with pytest.raises(ValueError):
        K.retrieve(K.Settings(), {"tag": backends["tag"]}, ["q"], "k")
    pages = spark.createDataFrame([(1, 3, 1)], "q int, k int, rank int")
    assert [tuple(r) for r in K.retrieve(K.Settings(full_context=True), {"vector": refuse}, ["q"], "k", lambda: pages).collect()] == [(1, 3, 0.5, "full", 1)]


@pytest.mark.parametrize("kind", ["flat", "ivf", "hnsw"])
def test_index_types(spark, tmp_path, kind):
    x = np.random.default_rng(0).normal(size=(200, 12))
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    q = v.where("vec_id % 40 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    s = K.Settings(use_tag_db=False, vector_index_type=kind, vector_ivf_nlist=8, vector_ivf_nprobe=8, vector_hnsw_m=16, vector_hnsw_ef_search=128, top_n_retrieval=5)
    got = K.retrieve(s, {"vector": K.vector_backend(s, v, q, str(tmp_path / "ix"))}, ["qid"], "vec_id").collect()
    true = {(r.qid, r.vec_id) for r in R.dense_topk(q, v, 5).collect()}
    assert len({(r.qid, r.vec_id) for r in got} & true) >= 0.9 * len(true)
