"""Stored vector indexes: product-quantised codes in cells, and a neighbour graph over these codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import cut
from .retrieval import ASKED, dot, norm, ranked

#: Vectors that cells and codebooks are fitted on, at most; what reaches the driver doesn't grow with the table.
SAMPLE = 8192
#: Codes that meet a block of questions at a time.
BLOCK = 40_000


@dataclass
class Quantiser:
    """Cells (k-means centres of unit vectors) and, for what a cell's centre leaves, a codebook per stretch of dimensions."""

    centres: np.ndarray  # cells x dimensions
    books: np.ndarray  # stretches x codes x dimensions of a stretch

    @property
    def code_bytes(self) -> int:
        return len(self.books)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of each vector; vectors are scaled to length 1, a zero vector stays."""
        x = unit(x)
        cell = nearest(x, self.centres)
        rest = self._stretches(x - self.centres[cell])
        return cell, np.stack([nearest(rest[:, k], book) for k, book in enumerate(self.books)], 1).astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        parts = self.books[np.arange(len(self.books))[None], codes]
        return self.centres[cell] + parts.reshape(len(codes), self.books.shape[0] * self.books.shape[2])[:, : self.centres.shape[1]]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Per question, stretch and code the inner product: a code's score is a sum of look-ups."""
        return np.einsum("qkd,kcd->qkc", self._stretches(unit(q)), self.books)

    def _stretches(self, x: np.ndarray) -> np.ndarray:
        k, _, d = self.books.shape
        return np.pad(x, ((0, 0), (0, k * d - x.shape[1]))).reshape(len(x), k, d)


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float32)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres by Lloyd's rounds from distinct points; fewer than k where there are fewer points. Empty ones stay where they are."""
    points = np.unique(x, axis=0)
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
    return centres


def fit_quantiser(vectors: DataFrame, cells: int = 16, stretches: int = 16, codes: int = 256, sample: int = SAMPLE, rounds: int = 12) -> Quantiser:
    """A quantiser from the `sample` vectors whose ids have the least hashes: the same on every run, bounded on the driver."""
    held, place = vectors.where(F.col("embedding").isNotNull()), F.xxhash64("vec_id")
    # every task sends the driver as many rows as are asked for: of a large table all but about twice the sample are dropped first
    n = held.count()
    few = held.where(place < F.lit(2 * sample * 2**64 // n - 2**63)) if n > 4 * sample else held
    least = lambda rows: rows.orderBy(place, "vec_id").limit(sample).select("embedding").toPandas()
    rows = least(few)
    if len(rows) < min(sample, n):
        rows = least(held)
    if not len(rows):
        return Quantiser(np.zeros((1, 1), np.float32), np.zeros((1, 1, 1), np.float32))
    x = unit(np.stack(rows["embedding"].to_list()))
    centres = k_means(x, cells, rounds, 1)
    rest = x - centres[nearest(x, centres)]
    d = -(-x.shape[1] // stretches)
    rest = np.pad(rest, ((0, 0), (0, -x.shape[1] % d)))
    books = [k_means(rest[:, lo : lo + d], codes, rounds, lo) for lo in range(0, rest.shape[1], d)]
    most = max(map(len, books))
    return Quantiser(centres, np.stack([np.pad(b, ((0, most - len(b)), (0, 0)), mode="edge") for b in books]))


def encoded(vectors: DataFrame, model: Quantiser) -> DataFrame:
    """(vec_id, cell, code): each vector as one byte per stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                cell, code = model.encode(x)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], ["vec_id", "cell", "code"])

    rows = vectors.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, cell int, code binary")


@dataclass
class VectorIndex:
    """A stored index: codes by cell, whole vectors in order of id, and the quantiser."""

    model: Quantiser
    codes: DataFrame
    vectors: DataFrame
    sizes: dict[int, int]  # rows by cell
    graph: DataFrame | None = None

    @property
    def rows(self) -> int:
        return sum(self.sizes.values())


def write_index(vectors: DataFrame, path: str, model: Quantiser | None = None) -> None:
    """Store vectors (vec_id unique, embedding) at path: `codes` partitioned by cell, `vectors` in ranges of vec_id, so that a
    short list reads few row groups, and `model`. Vectors without an embedding are not stored; all have one dimension."""
    spark = vectors.sparkSession
    model = model or fit_quantiser(vectors)
    # a large cell is dealt to several tasks, so that none writes it alone
    encoded(vectors, model).repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")
    rows = vectors.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id").write.mode("overwrite").parquet(f"{path}/vectors")
    spark.createDataFrame([(model.centres.tolist(), model.books.tolist())], "centres array<array<float>>, books array<array<array<float>>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def read_index(spark: SparkSession, path: str, graph: bool = False) -> VectorIndex:
    """The index that write_index() stored, with the graph of write_graph() if asked for."""
    m = spark.read.parquet(f"{path}/model").first()
    codes = spark.read.schema("vec_id long, code binary, cell int").parquet(f"{path}/codes")
    sizes = {r["cell"]: r["count"] for r in codes.groupBy("cell").count().collect()}  # one row a cell
    found = VectorIndex(Quantiser(np.array(m["centres"], np.float32), np.array(m["books"], np.float32)), codes, spark.read.schema("vec_id long, embedding array<float>").parquet(f"{path}/vectors"), sizes)
    if graph:
        found.graph = spark.read.schema("node long, near array<long>, codes binary, cells array<int>").parquet(f"{path}/graph")
    return found


def exact_top(candidates: DataFrame, index: VectorIndex, queries: DataFrame, top: int) -> DataFrame:
    """Candidates (qid, vec_id) by the cosine of their whole vectors; only these are read."""
    own = candidates.where(F.col("vec_id") != F.col("qid")).join(index.vectors, "vec_id").join(queries.select("qid", "qv"), "qid")
    length = norm(F.col("qv")) * norm(F.col("embedding"))
    scored = own.select("qid", "vec_id", F.round(F.when(length > 0, dot(F.col("qv"), F.col("embedding")) / length).otherwise(0.0), 4).alias("score"))
    return ranked(scored, ["qid"], F.col("score").desc(), F.col("vec_id"), top=top)


def short_lists(index: VectorIndex, queries: DataFrame, short: int, probes: int | None = None) -> DataFrame:
    """(qid, vec_id, rank): the `short` stored codes nearest to each question, from its `probes` nearest cells (None: all).

    Questions, in blocks, meet codes, in blocks of a cell: a cogrouped map whose groups are bounded whatever the tables'
    sizes. Ties go to the least vec_id, so of equal vectors the ones that a result would show come first.
    """
    model, sizes = index.model, index.sizes
    if not sizes:
        return queries.select("qid", F.lit(0).cast("long").alias("vec_id"), F.lit(0).alias("rank")).where("false")
    probes = min(probes or len(model.centres), len(model.centres))
    q_blocks = max(1, -(-queries.count() // ASKED))
    blocks = {c: max(1, -(-n // BLOCK)) for c, n in sizes.items()}

    @F.pandas_udf("array<int>")
    def cells_of(qv: pd.Series) -> pd.Series:
        near = unit(np.stack(qv.to_list())) @ model.centres.T
        return pd.Series([[int(c) for c in row if int(c) in sizes] for row in np.argsort(-near, kind="stable", axis=1)[:, :probes]])

    per_cell = F.create_map(*[F.lit(int(v)) for pair in blocks.items() for v in pair])
    q = queries.select("qid", F.col("qv").cast("array<float>").alias("qv"), F.pmod(F.xxhash64("qid"), F.lit(q_blocks)).cast("int").alias("qb"))
    q = q.withColumn("cell", F.explode(cells_of("qv"))).withColumn("ib", F.explode(F.sequence(F.lit(0), per_cell[F.col("cell")] - 1)))
    i = index.codes.select("vec_id", "code", "cell", F.pmod(F.xxhash64("vec_id"), per_cell[F.col("cell")]).cast("int").alias("ib"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))

    def best(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        if len(asked) and len(held):
            held = held.sort_values("vec_id", kind="stable")
            ids = held["vec_id"].to_numpy()
            codes = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(ids), -1)
            qv = np.stack(asked["qv"].to_list())
            whole = unit(qv) @ model.centres[key[1]]
            tables = (t for lo in range(0, len(qv), 64) for t in model.tables(qv[lo : lo + 64]))  # of few questions at a time
            for qid, base, table in zip(asked["qid"].tolist(), whole, tables):
                s = base + sum(table[k][codes[:, k]] for k in range(codes.shape[1]))
                s[ids == qid] = -np.inf
                if len(s) > 4 * short:  # all that reach the short-th score, so ties are kept for the stable order below
                    some = np.flatnonzero(s >= np.partition(s, len(s) - short)[len(s) - short])
                else:
                    some = np.arange(len(s))
                keep = some[np.argsort(-s[some], kind="stable")[:short]]
                keep = keep[s[keep] > -np.inf]
                found.append((np.full(len(keep), qid, np.int64), ids[keep], s[keep].astype(np.float32)))
        qids, vec_ids, near = (np.concatenate(c) for c in zip(*found))
        return pd.DataFrame({"qid": qids, "vec_id": vec_ids, "near": near})

    got = q.groupBy("qb", "cell", "ib").cogroup(i.groupBy("qb", "cell", "ib")).applyInPandas(best, "qid long, vec_id long, near float")
    return ranked(got, ["qid"], F.col("near").desc(), F.col("vec_id"), top=short)


def pq_topk(index: VectorIndex, queries: DataFrame, top: int, short: int = 200, probes: int | None = None) -> DataFrame:
    """Approximate cosine top-k of (qid, qv): codes give a short list, whole vectors of the short list its order."""
    return exact_top(short_lists(index, queries, short, probes).select("qid", "vec_id"), index, queries, top)


# ---- neighbour graph


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, size) of the stretches of equal keys."""
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(keys)))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that rows of one key (the first column, in order) are never apart."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        begin, _ = _groups(b.column(0).to_numpy(zero_copy_only=False))
        if begin[-1]:
            yield b.slice(0, int(begin[-1]))
        held = b.slice(int(begin[-1]))
    if held is not None:
        yield held


def _met(model: Quantiser, degree: int):
    """Of rows (group, node, cell, code, least) in order of group: for each member its `degree` nearest fellow members, without
    those farther than `least`, which its list would not take in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_groups(batches):
            node, cell, least = (b.column(k).to_numpy() for k in (1, 2, 4))
            x = model.decode(cell, np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(node), -1))
            begin, size = _groups(b.column(0).to_numpy())
            src, dst, near, need = [], [], [], []
            for n in np.unique(size).tolist():  # groups of one size are one stack of matrices
                if n < 2:
                    continue
                rows = begin[size == n][:, None] + np.arange(n)
                for lo in range(0, len(rows), max(1, 400_000 // (n * n))):
                    some = rows[lo : lo + max(1, 400_000 // (n * n))]
                    v = x[some]
                    s = v @ v.transpose(0, 2, 1)
                    ids = node[some]
                    s[ids[:, :, None] == ids[:, None, :]] = -np.inf
                    k = min(degree, n - 1)
                    order = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
                    src.append(np.repeat(ids, k, axis=1).ravel())
                    dst.append(np.take_along_axis(np.broadcast_to(ids[:, None, :], s.shape), order, 2).ravel())
                    near.append(np.take_along_axis(s, order, 2).ravel())
                    need.append(np.repeat(least[some], k, axis=1).ravel())
            if src:
                s = np.concatenate(near)
                real = (s > -np.inf) & (s >= np.concatenate(need))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)[real]), pa.array(np.concatenate(dst)[real]), pa.array(s[real].astype(np.float32))], ["src", "dst", "near"])

    return run


def build_graph(codes: DataFrame, model: Quantiser, degree: int = 24, rounds: int = 5, group: int = 64) -> DataFrame:
    """Neighbour graph of codes (vec_id, cell, code): (node, near, codes, cells), `near` being up to 3 * degree neighbours, less than twice
    the degree on average.

    Equal codes are one node, the least vec_id of them, so copies in any number don't crowd each other's lists. Nodes first
    meet in random groups of about `group`, a few times over; then, round by round, the neighbours of each node (those it
    names and the nearest that name it) meet each other, and each keeps the `degree` nearest it has met. A round moves one
    code per neighbour, and of the pairs that meet those near enough for a list; groups have at most 2 * degree members. Rounds are cut by checkpoints in the shared folder.
    """
    nodes = cut(codes.groupBy("cell", "code").agg(F.min("vec_id").alias("node")).select("node", "cell", "code", F.lit(float("-inf")).cast("float").alias("least")), sized=False)
    n = nodes.count()
    meet = lambda rows: rows.select("g", "node", "cell", "code", "least").repartition("g").sortWithinPartitions("g").mapInArrow(_met(model, degree), "src long, dst long, near float")
    best = lambda rows: ranked(rows.groupBy("src", "dst").agg(F.max("near").alias("near")), ["src"], F.col("near").desc(), F.col("dst"), top=degree).drop("rank")
    at_random = [nodes.withColumn("g", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(max(1, n // group)))) for seed in range(3)]
    by_cell = nodes.withColumn("g", F.xxhash64("cell", F.pmod(F.xxhash64("node", F.lit(9)), F.lit(max(1, n // (group * len(model.centres)))))))
    edges = cut(best(meet(at_random[0]).unionByName(meet(at_random[1])).unionByName(meet(at_random[2])).unionByName(meet(by_cell))), sized=False)

    def around(edges: DataFrame) -> DataFrame:
        """(g, node): whom each node names, and the nearest that name it."""
        back = ranked(edges, ["dst"], F.col("near").desc(), F.col("src"), top=degree).select(F.col("dst").alias("g"), F.col("src").alias("node"), "near")
        return edges.select(F.col("src").alias("g"), F.col("dst").alias("node"), "near").unionByName(back).groupBy("g", "node").agg(F.max("near").alias("near"))

    for _ in range(rounds):
        # a list that is full takes in nothing farther than its last: such pairs need not leave the task where they meet
        full = edges.groupBy(F.col("src").alias("node")).agg(F.min("near").alias("last"), F.count(F.lit(1)).alias("held")).where(F.col("held") >= degree)
        known = nodes.drop("least").join(full, "node", "left").select("node", "cell", "code", F.coalesce("last", F.lit(float("-inf"))).cast("float").alias("least"))
        met = meet(around(edges).join(known, "node"))
        edges = cut(best(edges.unionByName(met)), sized=False)
    # who names a node for want of nearer ones comes first: else nothing would lead to nodes that are in nobody's list
    own = ranked(edges, ["src"], F.col("near").desc(), F.col("dst"), name="place")
    back = ranked(own, ["dst"], F.col("place"), F.col("near").desc(), F.col("src"), top=2 * degree).select(F.col("dst").alias("g"), F.col("src").alias("node"), "near")
    rows = edges.select(F.col("src").alias("g"), F.col("dst").alias("node"), "near").unionByName(back).groupBy("g", "node").agg(F.max("near").alias("near"))
    rows = rows.join(nodes, "node").groupBy("g").agg(F.collect_list(F.struct((-F.col("near")).alias("far"), "node", "cell", "code")).alias("m"))
    m = F.array_sort("m")
    return rows.select(F.col("g").alias("node"), m["node"].alias("near"), F.aggregate(m["code"], F.lit(b""), lambda a, c: F.concat(a, c)).alias("codes"), m["cell"].alias("cells"))


def write_graph(index: VectorIndex, path: str, **how) -> None:
    """Build the graph of a stored index and store it beside it, dealt to files by node."""
    build_graph(index.codes, index.model, **how).repartition("node").sortWithinPartitions("node").write.mode("overwrite").parquet(f"{path}/graph")


def graph_topk(index: VectorIndex, queries: DataFrame, top: int, beam: int = 512, step: int = 64, starts: int = 8, rounds: int = 40, short: int = 200) -> DataFrame:
    """Approximate cosine top-k of (qid, qv) by a walk over the graph, for all questions at once; adds `compared`, the codes
    that each question was compared with.

    A question's beam holds the best `beam` nodes it has met. A round opens the best `step` of them that were not opened:
    their neighbours, which are stored with their codes, join by equality, are scored and may enter the beam. It ends when
    no beam has a node left to open. Beams start from `starts` nodes of every cell. The best `short` of each beam are
    ordered by their whole vectors; a node stands for all vectors of its code.
    """
    model = index.model
    if index.graph is None:
        raise ValueError("the index has no graph: write_graph() it, and read it with graph=True")
    some = ranked(index.codes.groupBy("cell", "code").agg(F.min("vec_id").alias("vec_id")), ["cell"], F.xxhash64("vec_id"), F.col("vec_id"), top=starts).drop("rank")
    first = some.toPandas()  # cells * starts rows
    if not len(first):
        return exact_top(queries.select("qid", F.lit(0).cast("long").alias("vec_id")).where("false"), index, queries, top).withColumn("compared", F.lit(0).cast("long"))
    ids0 = first["vec_id"].to_numpy()
    x0 = model.decode(first["cell"].to_numpy(), np.frombuffer(b"".join(first["code"]), np.uint8).reshape(len(first), -1))
    kind = "qid long, qv array<float>, ids array<long>, scores array<float>, opened array<boolean>, compared long"
    names = ["qid", "qv", "ids", "scores", "opened", "compared"]

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = unit(np.stack(b["qv"].to_list())) @ x0.T
                order = np.argsort(-s, axis=1, kind="stable")[:, :beam]
                yield pd.DataFrame({"qid": b["qid"], "qv": b["qv"], "ids": [ids0[o] for o in order], "scores": [r[o] for r, o in zip(s, order)], "opened": [np.zeros(len(o), bool) for o in order], "compared": len(ids0)})

    def to_open(state: DataFrame) -> DataFrame:
        closed = F.filter(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: ~F.get("opened", i))
        return state.select("qid", F.explode(F.transform(F.slice(closed, 1, step), lambda i: F.get("ids", i))).alias("node"))

    def grown(state: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return pd.DataFrame({c: [] for c in names})
        r = state.iloc[0]
        ids, scores, opened, compared = np.asarray(r["ids"]), np.asarray(r["scores"], np.float32), np.asarray(r["opened"], bool), int(r["compared"])
        opened = opened.copy()
        opened[np.flatnonzero(~opened)[:step]] = True
        if len(met):
            new, at = np.unique(np.concatenate(met["near"].to_list()), return_index=True)
            codes = np.frombuffer(b"".join(met["codes"]), np.uint8).reshape(-1, model.code_bytes)[at]
            cells = np.concatenate(met["cells"].to_list())[at]
            fresh = ~np.isin(new, ids)
            new, codes, cells = new[fresh], codes[fresh], cells[fresh]
            compared += len(new)
            s = model.decode(cells, codes) @ unit(np.asarray(r["qv"])[None])[0]
            ids, scores, opened = np.concatenate((ids, new)), np.concatenate((scores, s)), np.concatenate((opened, np.zeros(len(new), bool)))
            order = np.lexsort((ids, -scores))[:beam]
            ids, scores, opened = ids[order], scores[order], opened[order]
        return pd.DataFrame({"qid": [r["qid"]], "qv": [r["qv"]], "ids": [ids], "scores": [scores], "opened": [opened], "compared": [compared]})

    state = cut(queries.select("qid", F.col("qv").cast("array<float>").alias("qv")).mapInPandas(begin, kind), sized=False)
    for _ in range(rounds):
        opening = to_open(state)
        if opening.isEmpty():
            break
        met = opening.join(index.graph, "node").select(F.col("qid").alias("asked"), "near", "codes", "cells")
        state = cut(state.groupBy("qid").cogroup(met.groupBy("asked")).applyInPandas(grown, kind), sized=False)
    found = state.select("qid", F.explode(F.slice("ids", 1, short)).alias("node"))
    # a node's fellows of the same code: more than a result shows are never needed, and each task drops them before they move
    own = index.codes.join(found.select(F.col("node").alias("vec_id")).distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("node"), "cell", "code")
    fellow = ranked(own.join(index.codes, ["cell", "code"]).select("node", "vec_id"), ["node"], F.col("vec_id"), top=top + 1)
    found = found.join(fellow.select("node", "vec_id"), "node").select("qid", "vec_id")
    return exact_top(found, index, queries, top).join(state.select("qid", "compared"), "qid")


def late_pq_topk(index: VectorIndex, tokens: DataFrame, questions: DataFrame, top: int, short: int = 200) -> DataFrame:
    """Late interaction over candidates: (qid, doc, score, rank) of documents that hold a token near one of the question's.

    index: of token vectors, by vec_id. tokens: (doc, vec_id, embedding). questions: (qid, vec_id, qv), one row per token.
    Each token's short list of codes names documents; only these are compared, token by token, on whole vectors. A
    question's own document (doc = qid) is left out.
    """
    near = short_lists(index, questions.select(F.col("vec_id").alias("qid"), "qv"), short).select(F.col("qid").alias("token"), "vec_id")
    pairs = near.join(tokens.select("vec_id", "doc"), "vec_id").join(questions.select(F.col("vec_id").alias("token"), "qid"), "token")
    pairs = pairs.where(F.col("doc") != F.col("qid")).select("qid", "doc").distinct()
    hit = pairs.join(tokens.select("doc", "embedding"), "doc").join(questions.select("qid", F.col("vec_id").alias("token"), "qv"), "qid")
    best = hit.groupBy("qid", "doc", "token").agg(F.max(dot(F.col("qv"), F.col("embedding"))).alias("best"))
    scored = best.groupBy("qid", "doc").agg(F.round(F.sum("best"), 4).alias("score"))
    return ranked(scored, ["qid"], F.col("score").desc(), F.col("doc"), top=top)
