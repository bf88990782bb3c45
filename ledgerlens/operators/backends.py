"""Which retrieval a configuration asks for: backends, index types, fusion; only what is asked for is built or read."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fusion as U
from . import vector_index as V
from .retrieval import dense_topk, ranked

#: Backends in the order in which a configuration names them, and the types of a vector index (fixed values).
BACKENDS = ("vector", "bm25", "sparse", "tag")
INDEX_TYPES = ("flat", "ivf", "hnsw")


@dataclass(frozen=True)
class Settings:
    """How questions are answered with results; the defaults are a configuration's own (fixed values)."""

    use_vector_dbs: bool = True
    use_bm25_db: bool = False
    use_sparse_lexical_db: bool = False
    use_tag_db: bool = True
    full_context: bool = False
    vector_index_type: str = "flat"
    vector_search_k: int = 0
    vector_ivf_nlist: int = 32
    vector_ivf_nprobe: int = 8
    vector_hnsw_m: int = 32
    vector_hnsw_ef_search: int = 64
    top_n_retrieval: int = 10
    fusion_method: str = "rrf"

    def __post_init__(self):
        kind = (self.vector_index_type or "flat").strip().lower()
        if kind not in INDEX_TYPES:
            raise ValueError(f"vector_index_type must be one of {', '.join(INDEX_TYPES)}, not {self.vector_index_type!r}")
        object.__setattr__(self, "vector_index_type", kind)
        if self.fusion_method not in ("rrf", "average"):
            raise ValueError("fusion_method must be rrf or average")
        if not self.full_context and not self.active:
            raise ValueError("a configuration needs a backend")

    @classmethod
    def of(cls, given: Mapping) -> Settings:
        """From a mapping, as a configuration file gives it; names that mean nothing here are left out."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})

    @property
    def active(self) -> list[str]:
        on = {"vector": self.use_vector_dbs, "bm25": self.use_bm25_db, "sparse": self.use_sparse_lexical_db, "tag": self.use_tag_db}
        return [b for b in BACKENDS if on[b]]

    def depth(self, top: int) -> int:
        """How many results a backend gives before they are fused."""
        return self.vector_search_k or 2 * top


def vector_backend(settings: Settings, vectors: DataFrame, queries: DataFrame, path: str) -> Callable[[int], DataFrame]:
    """The vector backend of a configuration over vectors (vec_id, embedding) for queries (qid, qv): every vector (flat), the
    nearest cells (ivf), or a walk over a graph (hnsw). The last two are stored at path and read from there."""
    spark = vectors.sparkSession

    def index(graph: bool) -> V.VectorIndex:
        V.write_index(vectors, path, V.fit_quantiser(vectors, cells=settings.vector_ivf_nlist))
        if graph:
            V.write_graph(V.read_index(spark, path), path, degree=max(2, settings.vector_hnsw_m))
        return V.read_index(spark, path, graph=graph)

    def search(top: int) -> DataFrame:
        if settings.vector_index_type == "flat":
            return dense_topk(queries, vectors, top)
        if settings.vector_index_type == "ivf":
            return V.pq_topk(index(False), queries, top, 20 * top, settings.vector_ivf_nprobe)
        return V.graph_topk(index(True), queries, top, beam=max(settings.vector_hnsw_ef_search, top), short=20 * top).drop("compared")

    return search


def retrieve(settings: Settings, backends: Mapping[str, Callable[[int], DataFrame]], by: list[str], key: str, full: Callable[[], DataFrame] | None = None) -> DataFrame:
    """(by, key, score, sources, rank): the results that a configuration gives.

    backends: by name, what gives (by, key, score, rank) to a depth; those that are off are never called, so what they would
    build or read costs nothing. One backend alone keeps its own scores and ranks; several are fused by rank or by the
    average of their scaled scores over all that are on, and fetch more than is asked for. full_context gives every page
    (full()) with one score and asks no backend. A backend that is on and missing is an error.
    """
    top = settings.top_n_retrieval
    if settings.full_context:
        if full is None:
            raise ValueError("full_context needs the pages")
        return full().select(*by, key, F.lit(0.5).alias("score"), F.lit("full").alias("sources"), "rank")
    missing = [b for b in settings.active if b not in backends]
    if missing:
        raise ValueError(f"no such backend: {', '.join(missing)}")
    if len(settings.active) == 1:
        (name,) = settings.active
        return backends[name](top).select(*by, key, "score", F.lit(name).alias("sources"), "rank")
    lists = None
    for name in settings.active:
        one = backends[name](settings.depth(top)).select(*by, key, "score", "rank", F.lit(name).alias("source"))
        lists = one if lists is None else lists.unionByName(one)
    if settings.fusion_method == "rrf":
        out = U.rrf(lists, by, key)
        return out.where(F.col("rank") <= top).select(*by, key, "score", "sources", "rank")
    # a backend without a result for a question counts all the same: the average is over those that are on
    scaled = lists.withColumn("s", U.minmax(F.col("score"), [*by, "source"]))
    out = scaled.groupBy(*by, key).agg(F.round(F.sum("s") / len(settings.active) + 1e-9, 4).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return ranked(out, by, F.col("score").desc(), F.col(key), top=top).select(*by, key, "score", "sources", "rank")
