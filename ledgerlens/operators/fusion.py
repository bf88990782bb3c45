"""Merging ranked lists: fusion, parents and pages, several queries, cascades of rerankers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import ranked


#: Added before rounding, so that what is half a unit but for the last bit goes up.
HALF = 1e-9


def minmax(score: Column, by: list[str], digits: int | None = 4) -> Column:
    """Scaled to 0..1 within `by`; where all are equal, 1 if positive, else 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    out = F.when(high > low, (score - low) / (high - low)).otherwise(F.when(score > 0, 1.0).otherwise(0.0))
    return out if digits is None else F.round(out, digits)


def _united(column: str) -> Column:
    """Distinct items of arrays, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(column, F.array().cast("array<string>"))))))


def _lists(df: DataFrame) -> list[Column]:
    """What merged rows keep of their parts' child and tag lists, where they have any."""
    return [_united(c).alias(c) for c in ("children", "tags") if c in df.columns]


def rrf(lists: DataFrame, by: list[str], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (by, source, key, rank): sum of 1 / (k + rank), with the sources in name order and, where the
    lists have them, the children and tags of all."""
    out = lists.groupBy(*by, key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), *_lists(lists))
    return ranked(out, by, F.col("score").desc(), F.col(key))


def average_fusion(lists: DataFrame, by: list[str], key: str) -> DataFrame:
    """Mean of the sources' min-max scores; a source that returned something counts for every key, missing ones as 0."""
    scaled = lists.withColumn("s", minmax(F.col("score"), [*by, "source"]))
    active = lists.groupBy(*by).agg(F.countDistinct("source").alias("active"))
    best = scaled.groupBy(*by, key, "source").agg(F.max("s").alias("s"))
    out = best.groupBy(*by, key).agg(F.sum("s").alias("total")).join(active, by)
    out = out.select(*by, key, F.round(F.col("total") / F.col("active") + HALF, 4).alias("score"))
    return ranked(out, by, F.col("score").desc(), F.col(key))


def hybrid(lists: DataFrame, by: list[str], key: str, queries: DataFrame, text: str, top: int, scope: str = "all") -> DataFrame:
    """Candidates of all backends (or of "vector" alone) fused; blank questions have none."""
    if scope not in ("all", "vector_only"):
        raise ValueError("scope must be all or vector_only")
    asked = queries.where(F.trim(F.coalesce(text, F.lit(""))) != "").select(*by)
    rows = lists.join(asked, by, "left_semi")
    return fuse(rows if scope == "all" else rows.where("source = 'vector'"), by, key).where(F.col("rank") <= top)


def fuse(lists: DataFrame, by: list[str], key: str, k: int = 60) -> DataFrame:
    """RRF, but a question that only one source answered keeps that source's own scores."""
    alone = lists.groupBy(*by).agg(F.countDistinct("source").alias("n"))
    raw = lists.join(alone.where("n = 1"), by).select(*by, key, F.col("score").cast("double").alias("score"), F.col("source").alias("sources"), F.col("rank").cast("int").alias("rank"))
    many = rrf(lists.join(alone.where("n > 1").select(*by), by, "left_semi"), by, key, k)
    return many.unionByName(raw)


def parents_of(children: DataFrame, by: list[str], top: int) -> DataFrame:
    """First `top` parents in order of their best child, from children (by, rank, parent, chunk, score) and, where there is a
    column tags, with the tags of all counted children.

    The scan stops at the first child of one parent more: what kept parents have after that is not counted. Children meet
    a row of their group that lists its first parents, so they move by group alone, and not at all where they lie so already.
    """
    first = children.groupBy(*by, "parent").agg(F.min("rank").alias("first"))
    order = ranked(first, by, F.col("first"), top=top + 1, name="parent_rank")
    lists = order.groupBy(*by).agg(F.collect_list(F.when(F.col("parent_rank") <= top, F.struct("parent", "parent_rank"))).alias("__tops"), F.min(F.when(F.col("parent_rank") == top + 1, F.col("first"))).alias("__stop"))
    kept = children.join(lists, by).where(F.col("__stop").isNull() | (F.col("rank") < F.col("__stop")))
    kept = kept.withColumn("parent_rank", F.get(F.filter("__tops", lambda t: t["parent"] == F.col("parent")), F.lit(0))["parent_rank"]).where("parent_rank is not null").drop("__tops", "__stop")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"].cast("string")), ",")
    tags = [_united("tags").alias("tags")] if "tags" in children.columns else []
    return kept.groupBy(*by, "parent", "parent_rank").agg(F.max("score").alias("score"), ids.alias("children"), F.count(F.lit(1)).alias("n_children"), *tags)


def best_per_page(rows: DataFrame, by: list[str], page: str, top: int) -> DataFrame:
    """The best row of each page, then the first `top` pages."""
    best = ranked(rows, [*by, page], F.col("rank"), top=1, name="__in_page").drop("__in_page")
    return ranked(best, by, F.col("rank"), top=top, name="page_rank")


def multi_query(lists: DataFrame, by: list[str], key: str, cap: int) -> DataFrame:
    """Merge several queries' candidates (by, query_no, key, score and, where there are any, source, children, tags): best
    score, the queries that found it and their number, the sources; by hits, score and number of sources."""
    sources = [F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.countDistinct("source").alias("n_sources")] if "source" in lists.columns else []
    merged = lists.groupBy(*by, key).agg(F.max("score").alias("score"), F.array_join(F.transform(F.array_sort(F.collect_set("query_no")), lambda q: q.cast("string")), ",").alias("queries"), F.countDistinct("query_no").alias("hits"), *sources, *_lists(lists))
    more = [F.col("n_sources").desc()] if sources else []
    return ranked(merged, by, F.col("hits").desc(), F.col("score").desc(), *more, F.col(key), top=cap)


def merge_queries(lists: DataFrame, by: list[str], key: str, top: int) -> DataFrame:
    """The same without reranking: the best score of each candidate alone decides."""
    merged = lists.groupBy(*by, key).agg(F.max("score").alias("score"), *_lists(lists))
    return ranked(merged, by, F.col("score").desc(), F.col(key), top=top)


def reports_of(rows: DataFrame, by: list[str], report: str, bonus: float = 0.02) -> DataFrame:
    """Group results by report: best score plus a bonus per further piece of evidence, the first three chunks, and the tags of
    all where there are any."""
    tags = [_united("tags").alias("tags")] if "tags" in rows.columns else []
    out = rows.groupBy(*by, report).agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("evidence"), *tags)
    few = ranked(rows.select(*by, report, "rank", "chunk"), [*by, report], F.col("rank"), top=3, name="__k")
    few = few.groupBy(*by, report).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "chunk"))), lambda x: x["chunk"].cast("string")), ",").alias("chunks"))
    out = out.join(few, [*by, report]).withColumn("score", F.round(F.col("best") + bonus * (F.col("evidence") - 1), 4))
    return ranked(out, by, F.col("score").desc(), F.col(report))


def blend(relevance: Column, distance: Column, weight: float = 0.7) -> Column:
    """Rerank score: relevance and distance, 0.7 to 0.3."""
    return F.round(weight * relevance + (1 - weight) * distance + HALF, 4)


def remote_scores(score: Column, by: list[str]) -> Column:
    """Scores of a remote scorer: as they are if all lie in 0..1, else scaled; what it left out is 0."""
    w = Window.partitionBy(*by)
    inside = (F.min(score).over(w) >= 0) & (F.max(score).over(w) <= 1)
    return F.coalesce(F.when(inside, score).otherwise(minmax(score, by, None)), F.lit(0.0))


def cascade(rows: DataFrame, by: list[str], key: str, cap: int, middle: Column, keep: int, final: Column) -> DataFrame:
    """Cut to `cap` by distance, score with `middle`, scale, keep `keep`, then blend `final` with the scaled score."""
    pool = ranked(rows, by, F.col("distance").desc(), F.col(key), top=cap, name="pool_rank")
    pool = pool.withColumn("late", minmax(middle, by))
    pool = ranked(pool, by, F.col("late").desc(), F.col("pool_rank"), top=keep, name="late_rank")
    pool = pool.withColumn("score", blend(final, F.col("late")))
    return ranked(pool, by, F.col("score").desc(), F.col("late_rank"))


def hyde_trigger(rows: DataFrame, questions: DataFrame, by: str, low: float = 0.55, margin: float = 0.05) -> DataFrame:
    """Questions that deserve a hypothetical answer: nothing found, a weak best, or a close race of single hits."""
    two = ranked(rows, [by], F.col("score").desc(), top=2)
    top = two.groupBy(by).agg(F.max("score").alias("best"), F.min("score").alias("second"), F.count(F.lit(1)).alias("n"))
    hits = rows.groupBy(by).agg(F.max("hits").alias("hits"))
    out = questions.select(by).join(top, by, "left").join(hits, by, "left")
    go = F.col("best").isNull() | (F.col("best") < low) | ((F.col("n") > 1) & (F.col("best") - F.col("second") < margin) & (F.col("hits") <= 1))
    return out.select(by, F.coalesce(go, F.lit(True)).alias("trigger"))
