"""Line dedup: lines that many documents share stay only in the document with the largest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import SPACES, ascii_lower, text_of, without

OUT = ("n_lines", "n_dropped")
#: Tasks that the lines of one key are dealt to.
SALTS = 8


def _hashes(text):
    """Two chained 64-bit hashes: 128 bits, so that different keys stay apart at any size of corpus."""
    return F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit(7), text).alias("__h2")


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that can be dropped: document, identity of its text, position, hashes of the key."""
    text = text_of()
    rows = docs.select(F.col("doc_id").alias("__doc"), F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(7), text).alias("__t2"), F.posexplode(F.split(text, "\n", -1)).alias("__pos", "__line"))
    rows = rows.withColumn("__key", F.btrim("__line", F.lit(SPACES))).where(F.length("__key") >= min_chars)
    return rows.select("__doc", "__t1", "__t2", "__pos", *_hashes(ascii_lower(F.col("__key"))))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    r"""Return docs with `text` less its dropped lines, plus n_lines and n_dropped.

    A line's key is the line without white space at its ends, A-Z in lower case. A key of at least `min_chars` code
    points found in at least `min_docs` documents goes everywhere but in the largest doc_id that holds it.

    Defined results: a null or empty text is one empty line; rows that share a doc_id count as one document and keep
    or lose the same lines; null doc_ids together count as one document, below all others; an empty table gives an
    empty table; other columns pass through, columns named n_lines or n_dropped are replaced; a text that loses all
    its lines becomes empty.

    Plan: hashes, never texts, are shuffled to count documents (map-side combined, so a line in every document costs
    one row per task); the shared keys join the lines again, each key salted over several tasks; positions to
    drop are gathered per document and the texts are shuffled once.
    """
    keys = _lines(docs, min_chars).select("__h1", "__h2", "__doc").distinct().groupBy("__h1", "__h2")
    keys = keys.agg(F.count(F.lit(1)).alias("__n"), F.max("__doc").alias("__last")).where(F.col("__n") >= min_docs).select("__h1", "__h2", "__last")
    # a shared key, one row, is repeated for every salt; the lines that meet it are dealt out
    keys = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = _lines(docs, min_chars).withColumn("__salt", F.pmod(F.xxhash64("__doc", "__t1", "__pos"), F.lit(SALTS)).cast("int"))
    hit = lines.join(keys, ["__h1", "__h2", "__salt"]).where(~F.col("__doc").eqNullSafe(F.col("__last")))
    drops = hit.groupBy(F.col("__doc").alias("__d"), F.col("__t1").alias("__u1"), F.col("__t2").alias("__u2")).agg(F.collect_set("__pos").alias("__drop"))
    text, kept = text_of(), [c for c in without(docs, OUT) if c.lower() != "text"]
    row = F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in kept])  # the table's own columns, whatever their names
    rows = docs.select(row.alias("__row"), F.col("doc_id").alias("__doc"), F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(7), text).alias("__t2"), F.split(text, "\n", -1).alias("__lines"))
    rows = rows.join(drops, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__t1") == F.col("__u1")) & (F.col("__t2") == F.col("__u2")), "left")
    n = F.size("__lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__drop"))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    out = {"text": F.when(F.col("__drop").isNull(), F.array_join("__lines", "\n")).otherwise(left)}
    return rows.select(*[out[c.lower()].alias(c) if c.lower() in out else F.col(f"__row.`{c}`").alias(c) for c in without(docs, OUT)], n.cast("long").alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"))


def op2_line_dedup(spark, sf_dir):
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH s AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s
), c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), d AS (
  SELECT k.doc_id, k.pos, k.line, (c.key IS NOT NULL AND k.doc_id <> c.last) AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
