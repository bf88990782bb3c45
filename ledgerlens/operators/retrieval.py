"""Retrieval: lexical, dense, sparse, tag and late-interaction ranking of many questions at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], *order: Column, top: int | None = None, name: str = "rank") -> DataFrame:
    """Number rows within `by` by a total order; `top` keeps the first ones (Spark limits each group before the shuffle)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if top is None else out.where(F.col(name) <= top)


def tasks_for(rows: DataFrame, per: int = 250_000) -> int:
    """How many tasks keep about `per` of the rows each: it grows with them, which a fixed number of partitions does not."""
    return max(1, -(-rows.count() // per))


def dealt(rows: DataFrame, *by: str, tasks: int | None = None) -> DataFrame:
    """rows dealt by columns to so many tasks (None: tasks_for()); one task's worth is left to Spark."""
    tasks = tasks or tasks_for(rows)
    return rows.repartition(tasks, *by) if tasks > 1 else rows


def postings(chunks: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """(key, size, term): every distinct term of every chunk, with the chunk's number of distinct terms."""
    return chunks.select(F.col(key), F.array_distinct(tokens).alias("terms")).select(key, F.size("terms").alias("size"), F.explode("terms").alias("term"))


def bm25(index: DataFrame, queries: DataFrame, n_docs: DataFrame, top: int, key: str = "doc_id", query: str = "item_id", k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """Okapi scores over distinct terms (every term frequency is 1). queries: (query, term); n_docs: one row (n, avg_size).

    A term in over half the documents has a negative weight, which becomes `floor` times the vocabulary's mean weight.
    The questions' terms are joined first, so only their postings are weighted and moved; the vocabulary's mean needs one
    map-side combined count per term.
    """
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(n_docs)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    wanted = queries.select(query, "term").distinct()
    idf = idf.join(wanted.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(mean))
    idf = idf.select("term", "avg_size", F.when(F.col("idf") < 0, floor * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    hits = index.join(wanted.join(idf, "term"), "term")
    part = F.col("idf") * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("size") / F.col("avg_size")))
    scored = hits.groupBy(query, key).agg(F.round(F.sum(part), 4).alias("score"))
    return ranked(scored, [query], F.col("score").desc(), F.col(key), top=top)


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def per_document_top(scored: DataFrame, by: list[str], doc: str, top: int, *ties: Column) -> DataFrame:
    """The best results of each document (at least three), then the best of all: a document fills at most max(top, 3) places."""
    best = ranked(scored, [*by, doc], F.col("score").desc(), *ties, top=max(top, 3), name="doc_rank")
    return ranked(best, by, F.col("score").desc(), F.col(doc), *ties, top=top)


#: Questions and items that meet in one block at a time.
ASKED, HELD = 2048, 20_000


def blocked_topk(queries: DataFrame, items: DataFrame, key: str, scores: Callable, top: int, value: str) -> DataFrame:
    """(qid, key, score, rank): the `top` items of the largest score of every question, ties by key, a question's own key left
    out. Exact: every question meets every item, in blocks.

    Questions are dealt to blocks of about ASKED, items to blocks of about HELD; every pair of blocks is one group of a
    cogrouped map, whose size is bounded whatever the tables' sizes, and which returns `top` rows a question. Nothing is
    broadcast. scores(list of query values, list of item values) gives a matrix.
    """
    spark = items.sparkSession
    nq, ni = queries.count(), items.count()
    q_blocks, i_blocks = max(1, -(-nq // ASKED)), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ni // HELD))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.select("qid", F.col(value).alias("v"), deal("qid", q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(i_blocks - 1))).alias("ib"))
    i = items.select(F.col(key).cast("long").alias("item"), F.col(value).alias("v"), deal(key, i_blocks).alias("ib"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"qid": [], "item": [], "score": []}).astype({"qid": "int64", "item": "int64"})
        ids = held["item"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, parts = ids[order], []
        s = np.round(scores(asked["v"].tolist(), held["v"].iloc[order].tolist()), 4)
        for row, qid in zip(s, asked["qid"].tolist()):
            row = np.where(ids == qid, -np.inf, row)
            keep = np.argsort(-row, kind="stable")[:top]  # ids rise, so ties go to the least
            keep = keep[row[keep] > -np.inf]
            parts.append(pd.DataFrame({"qid": qid, "item": ids[keep], "score": row[keep]}))
        return pd.concat(parts)

    got = q.groupBy("qb", "ib").cogroup(i.groupBy("qb", "ib")).applyInPandas(best, "qid long, item long, score double")
    return ranked(got.withColumnRenamed("item", key), ["qid"], F.col("score").desc(), F.col(key), top=top)


def cosine_scores(queries: list, items: list) -> np.ndarray:
    q, x = np.asarray(queries, float).reshape(len(queries), -1), np.asarray(items, float).reshape(len(items), -1)
    return (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None])


def maxsim_scores(queries: list, items: list) -> np.ndarray:
    """Late interaction of token matrices: per query token the best inner product with an item's token, summed."""
    sizes = np.array([len(t) for t in items])
    tokens = np.concatenate([np.stack([np.asarray(v, float) for v in t]) for t in items])
    begin = np.cumsum(sizes) - sizes
    return np.stack([np.maximum.reduceat(np.stack([np.asarray(v, float) for v in q]) @ tokens.T, begin, axis=1).sum(0) for q in queries])


def dense_topk(queries: DataFrame, vectors: DataFrame, top: int) -> DataFrame:
    """Exact cosine top-k of (qid, qv) over (vec_id, embedding); ties go to the lower vec_id."""
    return blocked_topk(queries.select("qid", F.col("qv").alias("embedding")), vectors, "vec_id", cosine_scores, top, "embedding")


def late_topk(queries: DataFrame, documents: DataFrame, key: str, top: int) -> DataFrame:
    """Exact late-interaction top-k of (qid, tokens) over (key, tokens), tokens being arrays of vectors."""
    return blocked_topk(queries, documents, key, maxsim_scores, top, "tokens")


def content_tokens(tokens: Column, mask: Column) -> Column:
    """Token vectors without those that a mask (array of 0 and 1) takes out: special and padding tokens."""
    return F.filter(tokens, lambda _, i: F.coalesce(F.get(mask, i) == 1, F.lit(False)))


def fit_cells(vectors: DataFrame, cells: int, sample: int = 4096, rounds: int = 10) -> list[list[float]]:
    """Centroids by k-means on the `sample` vectors whose ids have the least hashes: what reaches the driver is bounded."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    x = np.array([r[0] for r in rows], float)
    centres = x[:cells].copy()
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres.tolist()


def assign_cells(vectors: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """Inverted-file cell of each vector: its nearest centroid (a small literal table), for pruning by partition."""
    cells = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    far = F.transform(cells, lambda c, i: F.struct(F.aggregate(F.zip_with(F.col("embedding"), c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x).alias("d"), i.alias("cell")))
    return vectors.withColumn("cell", F.array_min(far)["cell"])


def dense_topk_cells(queries: DataFrame, vectors: DataFrame, centroids: list[list[float]], probes: int, top: int) -> DataFrame:
    """Approximate top-k: each question looks only into the cells of its `probes` nearest centroids."""
    index = assign_cells(vectors, centroids)
    cells = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    near = F.transform(cells, lambda c, i: F.struct(F.aggregate(F.zip_with(F.col("qv"), c, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x).alias("d"), i.alias("cell")))
    q = queries.select("qid", "qv", F.explode(F.slice(F.array_sort(near), 1, probes)).alias("n")).select("qid", "qv", F.col("n.cell").alias("cell"))
    hit = index.join(q, "cell").where(F.col("vec_id") != F.col("qid"))
    scored = hit.select("qid", "vec_id", F.round(dot(F.col("qv"), F.col("embedding")) / (norm(F.col("qv")) * norm(F.col("embedding"))), 4).alias("score"))
    return ranked(scored, ["qid"], F.col("score").desc(), F.col("vec_id"), top=top)


#: Terms of queries that every task may hold, counted first; and documents of one task.
TERMS, DOCUMENTS = 200_000, 2_000


def sparse_topk(weights: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """Sparse inner product: weights (doc_id, term, w) and queries (qid, term, qw) meet on the term. Up to TERMS rows of
    queries go to every task, so that documents stay where they are."""
    if queries.count() <= TERMS:
        queries = F.broadcast(queries)
    scored = weights.join(queries, "term").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 4).alias("score"))
    return ranked(scored, ["qid"], F.col("score").desc(), F.col("doc_id"), top=top)


def wanted_terms(docs: DataFrame, tokens: Column, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, tf) of the terms that some question holds; others are dropped before anything is counted. Documents are
    dealt by key, whole, to tasks of DOCUMENTS each, and counted there."""
    terms = queries.select("term").distinct()
    if terms.count() <= TERMS:
        terms = F.broadcast(terms)
    rows = dealt(docs, key, tasks=tasks_for(docs, DOCUMENTS)).select(key, F.explode(tokens).alias("term")).join(terms, "term", "left_semi")
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tag_topk(tags: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """Tag overlap: share of a chunk's tags that some query term contains or is contained in.

    tags: (doc_id, tag), queries: (qid, term). Distinct tags and distinct terms, two vocabularies, are matched first, both
    ways, by pieces that they share. A document's score depends on its set of tags alone, so questions meet the distinct sets,
    and of each set only the `top` least doc_ids.
    """
    from .routing import alias_matches

    terms, vocabulary = queries.select("term").distinct(), tags.select("tag").where("tag <> ''").distinct()
    inside = alias_matches(vocabulary.select(F.col("tag").alias("tag"), F.col("tag").alias("text")), terms.select(F.col("term").alias("alias")), "tag", fold=False).select("tag", F.col("alias").alias("term"))
    around = alias_matches(terms.select("term", F.col("term").alias("text")), vocabulary.select(F.col("tag").alias("alias")), "term", fold=False).select(F.col("alias").alias("tag"), "term")
    match = inside.unionByName(around).distinct().join(queries.select("qid", "term").distinct(), "term")
    own = tags.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    first = ranked(own, ["tags"], F.col("doc_id"), top=top, name="place").drop("place")
    sets = first.select("tags").distinct()
    hits = sets.withColumn("tag", F.explode("tags")).join(match, "tag").groupBy("qid", "tags").agg(F.countDistinct("term").alias("hits"))
    score = F.round(F.col("hits") / F.greatest(F.size("tags"), F.lit(1)), 4)
    scored = hits.select("qid", "tags", score.alias("score")).join(first, "tags").select("qid", "doc_id", "score")
    return ranked(scored, ["qid"], F.col("score").desc(), F.col("doc_id"), top=top)


def full_context(pages: DataFrame, questions: DataFrame, doc: str = "doc") -> DataFrame:
    """Every page of a question's documents, in order, each with the constant score 0.5. questions: (qid, doc)."""
    rows = pages.join(questions.select("qid", doc), doc).withColumn("score", F.lit(0.5))
    return ranked(rows, ["qid"], F.col(doc), F.col("page"))


def maxsim(query_tokens: Column, doc_tokens: Column) -> Column:
    """Late interaction: for each query token the best inner product with a document token, summed."""
    best = F.transform(query_tokens, lambda q: F.array_max(F.transform(doc_tokens, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def search_depth(top: int, chunks: int, child: bool) -> int:
    """How many neighbours are fetched before grouping."""
    return min(chunks, max(4 * top, 16) if child else max(8 * top, 32))
