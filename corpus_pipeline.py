"""Training-corpus pipeline: documents pass five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm._shared import drop_stash, fresh, ship, stash
from ledgerlens.llm.decontamination import decontaminate
from ledgerlens.llm.line_dedup import line_dedup
from ledgerlens.llm.near_copies import near_copy_dedup
from ledgerlens.llm.packing import best_fit_pack
from ledgerlens.llm.simhash import MAX_BITS
from ledgerlens.llm.toxicity import OUT, fit_toxicity, toxicity


def apart(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs), with docs' columns, for an operator that writes columns of the given names: docs' own columns of these
    names step aside meanwhile."""
    own = [c for c in docs.columns if c.lower() in names]
    aside = dict(zip(own, fresh(docs, *[f"own_{c}" for c in own])))
    out = work(docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in docs.columns]))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, at the threshold of their language, go.

    Null and empty texts are scored like any other; rows that repeat share their fate; without labels of both classes all
    documents stay; an empty table stays empty. Columns may have any name.
    """
    ship(spark)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apart(docs, OUT, lambda rows: toxicity(rows, model).where(~F.col("toxic")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one of them; n_chars follows the text.

    Every row stays: a null text becomes an empty one, rows that repeat keep their lines alike. Columns may have any name,
    and those named text and n_chars are written anew.
    """
    return apart(docs, ("n_lines", "n_dropped"), lambda rows: line_dedup(rows).withColumn("n_chars", F.length("text").cast("long")))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays: texts are linked whose SimHash fingerprints of
    five-word shingles differ in three bits at most, and then those of likeness 0.8 or more that fingerprints miss.

    Null and empty texts are copies of each other; a row without an id stays only where its group has none with one; of
    rows that repeat one stays. Columns may have any name.
    """
    ship(spark)
    return near_copy_dedup(docs, bits=MAX_BITS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, quoted or re-parameterised, go.

    Null and empty texts hold none; rows that repeat an id go together; empty tables are fine. Columns may have any name.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens get a place in a sequence of 4096.

    Null and empty texts are their end token; rows that repeat are packed each.
    """
    import public_tokenizers

    ship(spark)
    return best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_copy_dedup", near_copy_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_pack", packing_stage),
]

#: A trained classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each but the last is written to the shared folder and read again, and removed once the
    next one has been written."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if old:
            drop_stash(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
