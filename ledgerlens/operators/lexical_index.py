"""Stored lexical index: texts are tokenised once; postings lie in blocks with bounds, and blocks that can't matter are skipped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import ranked

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Goes up with every change of what is stored.
LAYOUT = 1
#: Documents of one block at most, about; the ratio of sizes within a level.
BLOCK, RATIO = 4096, 1.15
#: What a level's number is multiplied by to number its parts: more parts than this would need 4096 million documents of a level.
PARTS = 1_000_000
#: Documents whose forward rows are picked by a broadcast of their numbers, at most.
LOOKED = 500_000
#: Rounding of scores: what a bound must fall short of to be skipped.
SLACK = 1e-3


@dataclass
class LexicalIndex:
    """A stored index.

    forward: (doc, size, terms), one row per document. terms: (no, df, idf). blocks: (no, place, n, docs): the documents of
    one term in one place, a size level and one of its parts.
    """

    forward: DataFrame
    terms: DataFrame
    blocks: DataFrame
    docs: int
    avg_size: float
    counts: DataFrame | None = None


def level_of(size: Column) -> Column:
    """Documents of one level have sizes within RATIO of each other, so one bound fits them all."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(RATIO))).cast("int")


def least_size(place: Column) -> Column:
    """A size that no document of a place falls below: that of its level."""
    return F.greatest(F.floor(F.pow(F.lit(RATIO), F.floor(place / PARTS)) - 1e-6), F.lit(1)).cast("int")


def length_factor(size: Column, avg_size: float) -> Column:
    """What a term's weight is multiplied by in a document of so many distinct terms (every frequency is 1)."""
    return F.lit(K1 + 1) / (1 + F.lit(K1) * (1 - B + B * size / F.lit(avg_size)))


def write_lexical_index(docs: DataFrame, tokens: Column, path: str, key: str = "doc_id") -> None:
    """Tokenise docs (key unique, long; null texts are left out before) and store their index at path.

    tokens: array of terms, taken as a set. Only this pass reads the texts; everything else derives from the stored forward
    table. Impacts fall with a document's size alone, so postings are cut by size levels, and within a level by a hash of
    the key into parts of about BLOCK documents: no term's postings are one row, and the same document is in the same place
    for every term, so bounds of several terms add up. Terms are their 64-bit hashes: of v terms two share one with a
    probability of v * v / 2 ** 65, one in three million for ten million terms.
    """
    spark = docs.sparkSession
    save = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.array_sort(F.transform(F.array_distinct(tokens), lambda w: F.xxhash64(w))).alias("terms"))
    save(rows.select("doc", F.size("terms").alias("size"), "terms"), "forward")
    forward = spark.read.schema("doc long, size int, terms array<long>").parquet(f"{path}/forward")
    # parts by level: a row per level, of which there are fewer than a hundred or two
    save(forward.groupBy(level_of(F.col("size")).alias("level")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("sizes")).coalesce(1), "levels")
    levels = spark.read.schema("level int, parts int, n long, sizes long").parquet(f"{path}/levels")
    n = levels.agg(F.sum("n"), F.sum("sizes")).first()
    n_docs = n[0] or 0
    part = F.pmod(F.xxhash64("doc"), F.col("parts"))
    placed = forward.withColumn("level", level_of(F.col("size"))).join(F.broadcast(levels.select("level", "parts")), "level")
    post = placed.select("doc", (F.col("level") * PARTS + part).cast("int").alias("place"), F.explode("terms").alias("no"))
    # most terms of a task stand in one document, so gathering them before they move would only add to what moves
    block = post.repartition("no", "place").groupBy("no", "place").agg(F.collect_list("doc").alias("docs"))
    save(block.select("no", "place", F.size("docs").cast("long").alias("n"), "docs"), "blocks")
    blocks = spark.read.schema("no long, place int, n long").parquet(f"{path}/blocks")
    df = blocks.groupBy("no").agg(F.sum("n").alias("df"))
    save(df.withColumn("idf", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "terms")
    # the mean weight of the vocabulary is what a term in over half the documents gets a share of. Written last: an index
    # without counts is not whole
    mean = spark.read.schema("no long, df long, idf double").parquet(f"{path}/terms").agg(F.avg("idf").alias("mean_idf"))
    save(mean.select("mean_idf", F.lit(n_docs).cast("long").alias("docs"), F.lit((n[1] or 0) / n_docs if n_docs else 1.0).alias("avg_size")).coalesce(1), "counts")


def read_lexical_index(spark: SparkSession, path: str) -> LexicalIndex:
    counts = spark.read.schema("mean_idf double, docs long, avg_size double").parquet(f"{path}/counts")
    one = counts.first()
    return LexicalIndex(
        spark.read.schema("doc long, size int, terms array<long>").parquet(f"{path}/forward"),
        spark.read.schema("no long, df long, idf double").parquet(f"{path}/terms"),
        spark.read.schema("no long, place int, n long, docs array<long>").parquet(f"{path}/blocks"),
        int(one["docs"] or 0), float(one["avg_size"]), counts,
    )


def lexical_index(docs: DataFrame, tokens: Column, name: str, key: str = "doc_id") -> LexicalIndex:
    """The index of docs, a table read from files, in the shared folder: built once for one state of these files.

    The state is the files' names, sizes and times of change, so a table that was appended to or written anew gets an index
    of its own. name tells apart indexes of one table by other tokens.
    """
    from pyspark.errors import AnalysisException

    from ..sources.store import shared_dir

    spark = docs.sparkSession
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)")).alias("sum")).first()
    path = f"{shared_dir(spark)}/lexical-{LAYOUT}-{name}-{state['n']}-{state['sum'] or 0}"
    try:
        return read_lexical_index(spark, path)
    except AnalysisException:
        write_lexical_index(docs, tokens, path, key)
        return read_lexical_index(spark, path)


def asked_terms(index: LexicalIndex, queries: DataFrame, query: str) -> DataFrame:
    """(query, no, idf) of the questions' distinct terms that the index holds."""
    mean = index.counts.select("mean_idf")  # one row
    weight = F.when(F.col("idf") < 0, F.lit(FLOOR) * F.col("mean_idf")).otherwise(F.col("idf"))
    return queries.select(query, F.xxhash64("term").alias("no")).distinct().join(index.terms, "no").crossJoin(F.broadcast(mean)).select(query, "no", weight.alias("idf"))


def _heads(index: LexicalIndex, asked: DataFrame, query: str) -> DataFrame:
    """(query, no, place, n, idf, least, bound, upto, whole): bound is the block's own, upto that of it and all lighter terms in
    the same place, whole that of all terms there. Only the blocks' heads are read, not their documents."""
    rows = index.blocks.select("no", "place", "n").join(asked, "no").withColumn("least", least_size(F.col("place")))
    bound = F.greatest(F.col("idf"), F.lit(0.0)) * length_factor(F.col("least"), index.avg_size)
    place = Window.partitionBy(query, "place")
    rows = rows.withColumn("bound", bound)
    lighter = place.orderBy("idf", "no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(query, "no", "place", "n", "idf", "least", "bound", F.sum("bound").over(lighter).alias("upto"), F.sum("bound").over(place).alias("whole"))


def _scored(index: LexicalIndex, candidates: DataFrame, bags: DataFrame, query: str) -> DataFrame:
    """(query, doc, score) of candidates, from their rows of the forward table alone. Up to LOOKED documents, which are counted
    first, pick these rows where they are read; the rows of more meet them by a shuffle."""
    docs = candidates.select("doc").distinct()
    forward = index.forward.select("doc", "size", "terms")
    if docs.count() <= LOOKED:
        forward = forward.join(F.broadcast(docs), "doc", "left_semi")
    rows = candidates.join(forward, "doc").join(bags, query)
    both = F.aggregate(F.array_intersect("terms", "nos"), F.lit(0.0), lambda s, t: s + F.element_at("weights", t))
    return rows.select(query, "doc", F.round(both * length_factor(F.col("size"), index.avg_size), 4).alias("score"))


def search(index: LexicalIndex, queries: DataFrame, top: int, query: str = "item_id", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(hits, read): the `top` documents of each question, as retrieval.bm25() gives them, and what was read for it.

    queries: (query, term). Three steps, every one over all questions at once:

    * Threshold: the blocks of each question's few heaviest terms give documents; the best of these by what was seen are
      scored whole, and the `top`-th score is one that every hit must reach.
    * Blocks: in each place a question's terms are ordered by weight. If all of them together stay below the
      threshold, nothing there is read. Otherwise the light ones that together stay below it are left out, since a
      document with these alone can't be a hit; the rest are opened.
    * Scores: the best documents of opened blocks raise the threshold once more; those that can still reach it, counting
      what was left out at its bound, are scored from their forward rows.

    Bounds are never below a score, so hits are exact. read: (query, postings, opened, candidates), postings being all those
    of the question's terms. A question with no term in the index has no hit.
    """
    from ..sources.store import cut

    asked = cut(asked_terms(index, queries, query))
    heads = cut(_heads(index, asked, query))
    bags = asked.groupBy(query).agg(F.collect_set("no").alias("nos"), F.map_from_entries(F.collect_list(F.struct("no", "idf"))).alias("weights"))
    bags = cut(bags)

    def opened(some: DataFrame) -> DataFrame:
        """(query, doc, seen, size, left): documents of blocks, the weight seen of each at the least size of its place, and the
        bound of what was not opened."""
        rows = some.select(query, "no", "place", "idf", "left", F.col("least").alias("size")).join(index.blocks.select("no", "place", "docs"), ["no", "place"])
        rows = rows.select(query, "idf", "size", "left", F.explode("docs").alias("doc"))
        return rows.groupBy(query, "doc").agg(F.sum("idf").alias("seen"), F.first("size").alias("size"), F.min("left").alias("left"))

    # the heaviest terms, until they have several times as many postings as are asked for
    sizes = asked.join(index.terms.select("no", "df"), "no")
    heavy = Window.partitionBy(query).orderBy(F.col("idf").desc(), "no").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("before", F.coalesce(F.sum("df").over(heavy), F.lit(0))).where(F.col("before") < 8 * top).select(query, "no")
    some = heads.join(first, [query, "no"]).withColumn("left", F.lit(0.0))
    names = asked.select(query).distinct()

    def reached(documents: DataFrame) -> DataFrame:
        """(query, least): what the `top`-th of some documents scores, and so every hit at least; no bound where they are fewer."""
        known = ranked(_scored(index, cut(documents), bags, query), [query], F.col("score").desc(), F.col("doc"), top=top)
        least = known.groupBy(query).agg(F.when(F.count(F.lit(1)) >= top, F.min("score")).alias("least"))
        return cut(names.join(least, query, "left").select(query, (F.coalesce("least", F.lit(float("-inf"))) - SLACK).alias("least")))

    shown = F.col("seen") * length_factor(F.col("size"), index.avg_size)
    best = lambda rows, k: ranked(rows, [query], shown.desc(), F.col("doc"), top=k).select(query, "doc")
    least = reached(best(opened(some), 4 * top))
    # blocks that may hold a hit, and of these the terms that a hit must hold one of
    needed = heads.withColumnRenamed("least", "lowest").join(least, query).where((F.col("whole") >= F.col("least")) & (F.col("upto") >= F.col("least")))
    place = Window.partitionBy(query, "place")
    needed = needed.withColumn("left", F.max("whole").over(place) - F.sum("bound").over(place))
    needed = cut(needed.select(query, "no", "place", "n", "idf", F.col("lowest").alias("least"), "left"))
    may = cut(opened(needed).join(least, query).where(shown + F.col("left") >= F.col("least")).select(query, "doc", "seen", "size", "left"))
    # the best of what was seen now raise the threshold, before the rest is scored
    least = reached(best(may, 8 * top))
    may = cut(may.join(least, query).where(shown + F.col("left") >= F.col("least")).select(query, "doc"))
    hits = ranked(_scored(index, may, bags, query), [query], F.col("score").desc(), F.col("doc"), top=top)
    count = lambda rows, name: rows.groupBy(query).agg(F.sum("n").alias(name))
    read = count(heads, "postings").join(count(some.select(query, "n").unionByName(needed.select(query, "n")), "opened"), query, "left").join(may.groupBy(query).agg(F.count(F.lit(1)).alias("candidates")), query, "left")
    return hits.withColumnRenamed("doc", key), read.fillna(0)
