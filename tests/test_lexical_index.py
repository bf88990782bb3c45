"""The stored lexical index against scores without an index, and what it leaves unread."""

import random

from pyspark.sql import functions as F

from ledgerlens.functions import text as X
from ledgerlens.operators import lexical_index as L
from ledgerlens.operators import retrieval as R

SF = "/root/testdata/sf0.01"


def unindexed(docs, queries, top):
    tokens = F.split("text", " ")
    index = R.postings(docs, tokens)
    size = docs.select(F.size(F.array_distinct(tokens)).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("k").alias("avg_size"))
    return {tuple(r) for r in R.bm25(index, queries, size, top).select("item_id", "doc_id", "score", "rank").collect()}


def test_as_without_index(spark, tmp_path, monkeypatch):
    rnd = random.Random(4)
    words = [f"w{int(rnd.paretovariate(0.6)) % 300}" for _ in range(4000)]
    for block, k in ((4096, 3), (3, 1), (3, 7)):
        monkeypatch.setattr(L, "BLOCK", block)
        docs = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 10, 40, 120])))) for i in range(150)], "doc_id long, text string")
        asked = spark.createDataFrame([(q, rnd.choice(words + ["absent"])) for q in range(25) for _ in range(rnd.randint(1, 12))] + [(99, "absent")], "item_id long, term string")
        L.write_lexical_index(docs, F.split("text", " "), str(tmp_path / f"ix{block}{k}"))
        hits, read = L.search(L.read_lexical_index(spark, str(tmp_path / f"ix{block}{k}")), asked, k)
        got = {tuple(r) for r in hits.select("item_id", "doc_id", "score", "rank").collect()}
        assert got == unindexed(docs, asked, k)
        assert read.count() == asked.where("term <> 'absent'").select("item_id").distinct().count()


def test_most_postings_stay_unread(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    L.write_lexical_index(docs, X.index_tokens(F.col("text")), str(tmp_path / "ix"))
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", F.explode(X.index_tokens(F.col("text"))).alias("term"))
    _, read = L.search(L.read_lexical_index(spark, str(tmp_path / "ix")), asked, 5)
    r = read.agg(F.sum("postings"), F.sum("opened")).first()
    assert r[1] < 0.2 * r[0]


def test_one_index_for_one_state(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string").write.parquet(path)
    first = L.lexical_index(spark.read.parquet(path), F.split("text", " "), "test")
    again = L.lexical_index(spark.read.parquet(path), F.split("text", " "), "test")
    assert first.docs == again.docs == 2 and sorted(first.blocks.inputFiles()) == sorted(again.blocks.inputFiles())
    spark.createDataFrame([(3, "c d")], "doc_id long, text string").write.mode("append").parquet(path)
    assert L.lexical_index(spark.read.parquet(path), F.split("text", " "), "test").docs == 3
    empty = spark.read.parquet(path).where("false")
    L.write_lexical_index(empty, F.split("text", " "), str(tmp_path / "none"))
    none = L.read_lexical_index(spark, str(tmp_path / "none"))
    hits, read = L.search(none, spark.createDataFrame([(1, "a")], "item_id long, term string"), 3)
    assert none.docs == 0 and hits.count() == 0 and read.count() == 0
