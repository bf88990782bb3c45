"""The pipeline links near copies by their SimHash first; what fingerprints miss is found by likeness."""

import numpy as np

import corpus_pipeline
from ledgerlens.llm import near_copies, simhash


def texts():
    """A text; one that repeats a passage so often that its shingle set is far from the text's and its fingerprint the same;
    a near copy; and another text."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
    hot = " ".join(words[:101])
    return [" ".join([hot] * 60), " ".join([hot] * 60 + words[101:161]), " ".join(words[200:300]), " ".join([*words[200:299], "new"]), " ".join(words[300:])]


def test_stage_links_by_fingerprint(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    fps = {r.doc_id: r.fp for r in simhash.fingerprints(df, 5).select("doc_id", "fp").collect()}
    assert (fps[0] ^ fps[1]).bit_count() <= simhash.MAX_BITS
    kept = lambda out: sorted(r.doc_id for r in out.collect())
    assert kept(near_copies.near_copy_dedup(df)) == [0, 1, 2, 4]  # by likeness alone
    assert kept(corpus_pipeline.near_copy_stage(spark, df, "")) == [0, 2, 4]
