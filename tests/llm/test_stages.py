"""Each pipeline stage on odd rows and clashing columns; naive forms of the classifiers' scores and of the walk."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import edit_embedding, quality, textcnn, toxicity

#: Without digits, which decontamination takes for slots.
WORDS = ["q" + "".join("abcdefghij"[int(d)] for d in f"{i:03d}") for i in range(400)]
LINE = "This very line stands in many of the documents."
#: Names that operators use or used for columns of their own.
CLASH = ("y", "labelled_id", "__id", "key", "root", "sid", "text_bytes_of", "keep_doc", "bad_doc", "row", "spans", "n_lines", "toxic", "label", "a.b")


def words(lo, hi):
    return " ".join(WORDS[lo:hi])


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small training set: toxic texts shout; and a benchmark with a null and a repeat."""
    home = str(tmp_path_factory.mktemp("sf"))
    rng = np.random.default_rng(0)
    made = [" ".join(rng.choice(WORDS, 40)) + (" vilest vilely vile" if i % 3 == 0 else "") for i in range(240)]
    spark.createDataFrame([(1000 + i, t) for i, t in enumerate(made)], "doc_id long, text string").write.parquet(f"{home}/train.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i % 3 == 0)) for i in range(240)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    item = words(300, 330)
    spark.createDataFrame([(1, item), (2, item), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return home


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = [
        (1, words(0, 60)), (2, words(0, 60)), (2, words(0, 60)), (3, None), (4, ""), (5, "  \n "), (None, words(60, 130)), (6, "a " * 20_000), (7, "x " + words(300, 330) + " y"),
        (8, f"{LINE}\n{words(130, 160)}"), (9, f"{LINE}\n{words(160, 190)}"), (10, f"{LINE}\n{words(190, 220)}"), (11, "vilest vilely vile vilest"),
    ]
    train = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/train.parquet").collect()]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + train], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


def kept(out):
    return sorted((r[0], r[1]) for r in out.select("doc_id", "text").where("doc_id is null or doc_id < 1000").collect() if r[0] is not None)


def rows_of(docs):
    return sorted((r[0], r[1]) for r in docs.select("doc_id", "text").where("doc_id < 1000").collect())


def same_columns(out, docs):
    assert out.columns == docs.columns
    one = out.where("doc_id = 1").first()
    assert all(one[c] == "clash" for c in CLASH)


def by(rows):
    return sorted(rows, key=repr)


def test_toxicity_stage(spark, docs, sf):
    out = corpus_pipeline.toxicity_stage(spark, docs, sf)
    same_columns(out, docs)
    assert by(kept(out)) == by([r for r in rows_of(docs) if r[0] != 11])  # null, empty, long, repeated ones stay
    assert out.where("doc_id is null").count() == 1
    assert corpus_pipeline.toxicity_stage(spark, docs.where("false"), sf).count() == 0


def test_line_stage(spark, docs, sf):
    out = corpus_pipeline.line_dedup_stage(spark, docs, sf)
    same_columns(out, docs)
    want = [(i, t if i == 10 or t is None else t.replace(f"{LINE}\n", "")) for i, t in rows_of(docs)]
    assert by(kept(out)) == by([(i, t or "") for i, t in want])
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0
    assert corpus_pipeline.line_dedup_stage(spark, docs.where("false"), sf).count() == 0


def test_near_copy_stage(spark, docs, sf):
    out = corpus_pipeline.near_copy_stage(spark, docs, sf)
    same_columns(out, docs)
    ids = [i for i, _ in kept(out)]
    assert ids == [1, 3, 6, 7, 8, 9, 10, 11]  # 2 is a copy of 1; null, empty and blank are copies
    assert corpus_pipeline.near_copy_stage(spark, docs.where("false"), sf).count() == 0


def test_decontamination_stage(spark, docs, sf):
    out = corpus_pipeline.decontamination_stage(spark, docs, sf)
    same_columns(out, docs)
    assert by(kept(out)) == by([r for r in rows_of(docs) if r[0] != 7])
    assert out.where("doc_id is null").count() == 1
    assert corpus_pipeline.decontamination_stage(spark, docs.where("false"), sf).count() == 0


def test_packing_stage(spark, docs, sf):
    out = corpus_pipeline.packing_stage(spark, docs, sf)
    per = {r.doc_id: (r.n, r.tokens) for r in out.groupBy("doc_id").agg(F.countDistinct("piece").alias("n"), F.sum("length").alias("tokens")).collect()}
    assert per[3] == per[4] == per[5] == (1, 1) and per[2][1] == 2 * per[1][1] and per[6][0] > 1 and None in per
    assert corpus_pipeline.packing_stage(spark, docs.where("false"), sf).count() == 0


def test_classifiers_with_clashing_columns(spark, docs, sf):
    """Scores are those of the same table without the other columns, for null, empty, repeated and long texts too."""
    labels, plain = spark.read.parquet(f"{sf}/labels.parquet"), docs.select("doc_id", "text", "lang")
    m, q = toxicity.fit_toxicity(docs, labels), quality.fit_quality(docs, labels)
    for many, few, name in ((toxicity.toxicity(docs, m), toxicity.toxicity(plain, toxicity.fit_toxicity(plain, labels)), "toxicity"), (quality.quality_scores(docs, q), quality.quality_scores(plain, quality.fit_quality(plain, labels)), "quality_score")):
        get = lambda df: sorted((repr(r.doc_id), repr(r.text), round(r[name], 9)) for r in df.select("doc_id", "text", name).collect())  # noqa: E731, B023
        assert get(many) == get(few)
        score = {i: {s for j, _, s in get(many) if j == repr(i)} for i in (1, 2, 3, 4)}
        assert score[1] == score[2] and score[3] == score[4] and all(0 <= s <= 1 for x in score.values() for s in x)


# ---- naive forms


def test_forward_pass_position_by_position():
    net = textcnn.TextCNN(buckets=64, dim=5, filters=4)
    net._start(np.random.default_rng(1))
    net.p["E"] = np.vstack([net.p["E"], np.zeros((1, net.dim), np.float32)])  # as fit() leaves it: the last is no word
    ens = textcnn.Ensemble([net])
    for text in ("", "one", "Two words!", "a b c d e f g a b", "!!! ...", "internationally inter"):
        ws = textcnn.words_of(text) or [""]
        vec = [np.sum([net.p["E"][u] for u in net.units(w)], 0) if w else np.zeros(net.dim) for w in ws]
        vec += [np.zeros(net.dim)] * (max(net.widths) - 1)
        z = float(net.p["b"][0])
        for n, k in enumerate(net.widths):
            for f in range(net.filters):
                best = max(sum(float(vec[i + j] @ net.p[f"W{k}"].reshape(k, net.dim, net.filters)[j, :, f]) for j in range(k)) for i in range(len(ws))) + float(net.p[f"c{k}"][f])
                z += max(0.0, best) * float(net.p["w"][n * net.filters + f])
        assert math.isclose(float(ens.logits([text])[0]), z, rel_tol=1e-4, abs_tol=1e-5)


def test_density_by_solving():
    """Cached factors give what solving against the covariances gives."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    m = quality.Discriminant.fit(x, y, 0.5)
    z = np.clip((x - m.centre) / m.scale, -6, 6)
    want = []
    for row in z:
        logs = []
        for c in (0, 1):
            cov = np.linalg.inv(m.inverse[c].T @ m.inverse[c])
            d = row - m.means[c]
            logs.append(-0.5 * (d @ np.linalg.solve(cov, d) + np.linalg.slogdet(cov)[1]))
        want.append(logs[1] - logs[0])
    assert np.allclose(m.margin(x), want, atol=1e-6)
    assert ((m.margin(x) > 0) == y).mean() > 0.9


def test_walk_step_by_step():
    """The first step on every character, by moving on one random bit at a time."""
    walk, rng = edit_embedding.Walk(), np.random.default_rng(5)
    bits = np.random.default_rng(11).integers(0, 2, (edit_embedding.CLASSES, edit_embedding.PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    sizes = [0, 1, 7, 300, 40, 2000] + [30] * 30  # many short ones walk side by side, the longest on by itself
    parts = [rng.integers(0, edit_embedding.CLASSES, n) for n in sizes]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    got = walk.steps(np.concatenate(parts), bounds, np.zeros(len(sizes), np.int64))
    for k, part in enumerate(parts):
        step, want = 0, []
        for c in part:
            want.append(step)
            while not bits[c, step % edit_embedding.PERIOD]:
                step += 1
            step += 1
        assert got[bounds[k] : bounds[k + 1]].tolist() == want
