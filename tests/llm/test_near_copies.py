"""Near copies by five-word shingles: linked sets against all pairs, and what the pipeline's stage keeps."""

import numpy as np
import pytest

import corpus_pipeline
from ledgerlens.llm import near_copies

WORDS = [f"w{i}x" for i in range(500)]


def variants(seed, copies, words=300):
    """Texts of random words, near copies of each with 0 to 14 words changed, and a passage that all share."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(6):
        base = list(rng.choice(WORDS, words)) + WORDS[:40]
        out.append(" ".join(base))
        for k in range(copies):
            new = list(base)
            for at in rng.choice(words, k % 15, replace=False):
                new[at] = f"n{rng.integers(10**6)}"
            out.append(" ".join(new))
    return out + [None, "", "two words", "Two  WORDS"]


def groups_of(texts, least=0.8):
    sets = [set(near_copies.shingle_set(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= least * len(a | sets[j]) - 1e-9:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("hot", [64, 3])
def test_stage_keeps_one_of_each_group(spark, monkeypatch, hot):
    monkeypatch.setattr(near_copies, "HOT", hot)
    texts = variants(hot, 12)
    want = groups_of(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(set(want)) < len(texts) - 30
    assert sorted(r.doc_id for r in corpus_pipeline.near_copy_stage(spark, df, "").collect()) == sorted(set(want))


def test_edges(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "other words stand in this row"), (5, None), (None, "alone is this one text here"), (7, "z"), (7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies.near_copy_dedup(df)
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([rows[i] for i in (1, 2, 3, 4, 5)], df.schema).collect()))
    assert near_copies.near_copy_dedup(df.where("false")).count() == 0
