"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import text_of, without

#: Labelled rows to learn from, about so many per class: the bound of the training sample.
TRAIN_PER_CLASS = 6000

_KIND = np.zeros(256, np.int64)
for _kind, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"'\"()-"), 1):
    _KIND[list(_chars)] = _kind
_KIND[128:192], _KIND[192:] = 10, 9  # bytes that continue and that begin other code points


def statistics(text: str) -> list[float]:
    """Document statistics, each transformed towards a bell shape: logits of shares, logarithms of sizes."""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=11)
    other, upper, lower, digit, space, line, stop, shout, quote, wide, _ = kinds.tolist()
    chars, n = len(text), len(words)
    letters = upper + lower + wide
    logit = lambda a, b: float(np.log((a + 0.5) / (b - a + 0.5))) if b >= a else float(np.log((a + 0.5) / 0.5))
    seen = Counter(words)
    sizes = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    lines = text.split("\n")
    held = Counter(lines)
    top = seen.most_common(1)[0][1] if n else 0
    again = sum(c for c in seen.values() if c > 2)
    return [
        np.log1p(n),
        np.log(sizes.mean() + 0.5),
        np.log(sizes.std() + 0.1),
        np.log1p(sizes.max()),
        logit(upper, letters),
        logit(digit, chars),
        logit(other, chars),
        logit(shout, chars),
        logit(stop, chars),
        logit(quote, chars),
        logit(wide, letters),
        logit(len(seen), n),
        logit(top, n),
        logit(again, n),
        logit(len(lines) - len(held), len(lines)),
        np.log1p(chars / len(lines)),
        logit(sum(1 for w in words if len(w) < 4), n),
        float(len(zlib.compress(raw[:], 1))) / (len(raw) + 20),
    ]


@dataclass
class Discriminant:
    """Two Gaussians with shrinkage covariances; scores from Mahalanobis log-density differences by cached factors."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse: np.ndarray  # inverse Cholesky factors, one per class
    logdet: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, prior: float, own: float = 0.7, ridge: float = 0.05) -> Discriminant:
        """Class covariances shrink towards the pooled one (the more the fewer rows) and then towards its diagonal."""
        centre, scale = x.mean(0), x.std(0) + 1e-6
        z = np.clip((x - centre) / scale, -6, 6)
        groups = [z[y == c] if (y == c).sum() > 1 else z for c in (0, 1)]
        pooled = sum((len(g) - 1) * np.cov(g.T) for g in groups) / max(1, sum(len(g) - 1 for g in groups))
        means, inverse, logdet = [], [], []
        for g in groups:
            share = own * len(g) / (len(g) + 3 * x.shape[1])
            cov = share * np.cov(g.T) + (1 - share) * pooled
            cov = (1 - ridge) * cov + ridge * np.diag(np.diag(cov)) + 1e-2 * np.eye(len(cov))
            low = np.linalg.cholesky(cov)
            means.append(g.mean(0))
            inverse.append(np.linalg.inv(low))
            logdet.append(2 * np.log(np.diag(low)).sum())
        return cls(centre, scale, np.array(means), np.array(inverse), np.array(logdet), prior)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        d = [((z - m) @ inv.T) ** 2 for m, inv in zip(self.means, self.inverse)]
        return 0.5 * (d[0].sum(1) + self.logdet[0] - d[1].sum(1) - self.logdet[1])

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression of the label on the margin, by Newton's method, slightly regularised."""
        m, a, b = self.margin(x), 0.3, 0.0
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            r, h = weight * (p - y), weight * p * (1 - p) + 1e-9
            g = np.array([(r * m).sum() + 0.1 * (a - 0.3), r.sum() + 0.1 * b])
            H = np.array([[(h * m * m).sum() + 0.1, (h * m).sum()], [(h * m).sum(), h.sum() + 0.1]])
            step = np.linalg.solve(H, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -3, 3)
            if np.abs(step).max() < 1e-7:
                break
        self.slope, self.shift = max(float(a), 0.01), float(b)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Discriminant | None:
    """Learn from a bounded sample; only its statistics, a few numbers a document, reach the driver. None: nothing to learn from.

    Defined results: as fit_toxicity(): unknown, held-out and null labels are left out, null texts are empty ones, rows that
    repeat count each, other columns are ignored.
    """
    from ._labels import training_sample

    rows, shares, label = training_sample(docs.select("doc_id", "text"), labels, "quality", per_class)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [statistics(t) for t in b["text"]]})

    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y"), text_of().alias("text")).mapInPandas(run, "doc_id long, y int, x array<double>").toPandas()
    if not len(got):
        return None
    got = got.sort_values("doc_id", kind="stable")
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    model = Discriminant.fit(x, y, shares[1])
    model.calibrate(x, y, np.array([shares[c] / max(1e-9, (y == c).mean()) for c in y]))
    return model


def quality_scores(docs: DataFrame, model: Discriminant | None) -> DataFrame:
    """docs plus quality_score (0 to 1, higher: better). Whole texts are read; labels, lang, source and ids are not.

    Defined results: a null or empty text is scored by its statistics, all at their least; without a model (no labelled
    row) every score is 0.5; repeated rows are scored alike; a column named quality_score is replaced; an empty table
    gives an empty table.
    """

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            if model is None or not len(part):
                yield pd.Series(np.full(len(part), 0.5))
            else:
                yield pd.Series(model.score(np.array([statistics(t) for t in part])))

    return docs.select(*[F.col(f"`{c}`") for c in without(docs, ["quality_score"])], score(text_of()).alias("quality_score"))


def op4_quality(spark, sf_dir):
    from ._labels import held_out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality_scores(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
