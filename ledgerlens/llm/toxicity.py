"""Toxicity: a convolutional text classifier with thresholds calibrated by language."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import held_out, training_sample
from ._shared import give_back, ship, text_of, without
from .textcnn import Ensemble, TextCNN, words_of

#: Bounds of the training sample: about so many labelled rows per class, of texts up to so many characters.
TRAIN_PER_CLASS, TRAIN_CHARS = 1800, 12_000
OUT = ("toxicity", "toxicity_threshold", "toxic")


@dataclass
class ToxicityModel:
    net: Ensemble | None
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] | None = None
    threshold: float = 0.5

    def score(self, texts: list[str]) -> np.ndarray:
        if self.net is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.net.logits(texts) + self.shift, -30, 30)))


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated logit: weighted logistic regression, pulled towards (0.7, 0)."""
    a, b = 0.7, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, h = w * (p - y), w * p * (1 - p) + 1e-9
        g = np.array([(r * z).sum() + 2 * (a - 0.7), r.sum() + 0.5 * b])
        H = np.array([[(h * z * z).sum() + 2, (h * z).sum()], [(h * z).sum(), h.sum() + 0.5]])
        s = np.clip(np.linalg.solve(H, g), -0.5, 0.5)
        a, b = a - s[0], b - s[1]
        if np.abs(s).max() < 1e-7:
            break
    return max(float(a), 0.05), float(b)


def _best_cut(p: np.ndarray, y: np.ndarray, w: np.ndarray, least: int = 8, pull: float = 20.0) -> float | None:
    """Threshold of the largest F1, drawn towards 0.5 while rows are few; None where a class is too rare to tell."""
    if y.sum() < least or (1 - y).sum() < least:
        return None
    order = np.argsort(-p, kind="stable")
    s, hit = p[order], np.cumsum((w * y)[order])
    f1 = 2 * hit / (np.cumsum(w[order]) + hit[-1])
    good = np.flatnonzero(f1 >= f1.max() - 1e-3)  # of cuts as good as the best, the middle one
    cut = (s[good[0]] + s[min(good[-1] + 1, len(s) - 1)]) / 2
    n = float(y.sum())
    return float(np.clip((n * cut + pull * 0.5) / (n + pull), 0.02, 0.98))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, folds: int = 3) -> ToxicityModel:
    """Train one network per fold on the other folds of a bounded sample; calibrate score and thresholds on what each left out.

    The sample (at most about 2 * per_class texts of at most TRAIN_CHARS characters) is brought to the driver, where
    numpy trains; its size does not grow with the corpus. The score is shifted so that 0.5 is the cut of the largest F1
    over all languages, at the classes' true shares; each language with enough rows of both classes has its own cut.

    Defined results: labels of unknown or held-out documents, and null or other labels, are left out; null texts are empty
    ones; rows that repeat a doc_id all count; without rows of both classes the model scores 0; other columns of docs, of
    whatever name, are ignored.
    """
    ship(docs.sparkSession)
    rows, shares, label = training_sample(docs.where(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS), labels, "toxic", per_class)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y"), lang.alias("lang"), text_of().alias("text")).toPandas()
    got = got.sort_values(["doc_id", "text"], kind="stable")
    y, texts = got["y"].to_numpy(), got["text"].tolist()
    if len(got) < 2 or y.min() == y.max():
        return ToxicityModel(None)
    fold = np.array([zlib.crc32(b"fold%d" % i) % folds for i in got["doc_id"]])
    words, nets, z = [words_of(t) for t in texts], [], np.zeros(len(y))
    for k in range(folds):
        fit = np.flatnonzero(fold != k)
        if not len(fit) or y[fit].min() == y[fit].max():
            fit = np.arange(len(y))
        nets.append(TextCNN(seed=7 + k).fit([words[i] for i in fit], y[fit]))
        rest = np.flatnonzero(fold == k)
        z[rest] = Ensemble(nets[-1:]).logits([texts[i] for i in rest])
    weight = np.array([shares[c] / max(1e-9, (y == c).mean()) for c in y])
    slope, shift = _platt(z, y, weight)
    p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
    if (cut := _best_cut(p, y, weight)) is not None:
        shift -= float(np.log(cut / (1 - cut)))
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
    langs = got["lang"].to_numpy()
    by = {name: cut for name in sorted(set(langs)) if (cut := _best_cut(p[langs == name], y[langs == name], weight[langs == name])) is not None}
    del got, texts, words
    give_back()  # what training took would stay with the driver through all that follows
    return ToxicityModel(Ensemble(nets), slope, shift, by)


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs plus toxicity (0 to 1), toxicity_threshold (of the row's lang) and toxic (score at or above it).

    The score reads nothing but the whole text; lang only chooses the threshold, and a language that training rows don't
    cover takes the threshold of all languages together.

    Defined results: a null or empty text is scored as one empty word; without labelled rows of both classes every score
    is 0 and nothing is toxic; repeated rows are scored alike; a null lang takes the common threshold; columns of the
    three names are replaced; an empty table gives an empty table.
    """

    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        give_back()
        for part in texts:
            yield pd.Series(model.score(part.tolist()))
        give_back()

    cut = F.lit(model.threshold)
    if "lang" in docs.columns:
        for name, value in (model.thresholds or {}).items():
            cut = F.when(F.col("lang") == name, F.lit(value)).otherwise(cut)
    out = docs.select(*[F.col(f"`{c}`") for c in without(docs, OUT)], score(text_of()).alias("toxicity"), cut.alias("toxicity_threshold"))
    return out.withColumn("toxic", (F.col("toxicity") >= F.col("toxicity_threshold")) & F.lit(model.net is not None))


def op1_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxicity_threshold", "toxic")
