"""A bounded sample of labelled rows to learn from, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh


def held_out(doc_id="doc_id"):
    """The fold that no label is learnt from: crc32 of doc_id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, float], str]:
    """Labelled rows of docs outside the held-out fold, about per_class of each class, each class's share of all labelled
    rows, and the name of the column that holds the label: "y", or what docs leave free of it.

    Classes larger than that are thinned by a hash of doc_id, so the sample is the same on every run and its size does
    not grow with the corpus; at most a few times 2 * per_class ids are broadcast. Null or other labels are left out; of
    repeated labels of a document the largest counts.
    """
    own, y = fresh(docs, "labelled_id", "y")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").alias(own)).agg(F.max(label).cast("int").alias(y))
    sizes = {r[y]: r["count"] for r in known.groupBy(y).count().collect()}  # two rows
    total = max(1, sum(sizes.values()))
    share = F.lit(0.0)
    for c, n in sizes.items():
        share = F.when(F.col(y) == c, min(1.0, per_class / n)).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64(F.lit("sample"), own), F.lit(1_000_000)) < share * 1_000_000)
    rows = docs.join(F.broadcast(chosen), docs["doc_id"].cast("long") == F.col(own).cast("long"), "inner").drop(own)
    return rows, {c: sizes.get(c, 0) / total for c in (0, 1)}, y
