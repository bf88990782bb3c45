"""Queries: retrieval, fusion, routing and filters over the driver's tables, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import backends as K
from ..operators import chunks as C
from ..operators import filters as P
from ..operators import fusion as U
from ..operators import grounding as N
from ..operators import lexical_index as I
from ..operators import retrieval as R
from ..operators import routing as G
from ..operators import vector_index as V
from ..sources.store import cut, new_path
from ._tables import table

QUERIES, SQL = {}, {}


def register(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def norm_sql(x):
    """normalize_text() for texts that the compatibility normal form leaves alone."""
    flat = f"translate(coalesce({x}, ''), '’–—（）：；，' || chr(160), chr(39) || '--():;, ')"
    commas = f"regexp_replace(regexp_replace({flat}, '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g')"
    return f"trim(regexp_replace(replace(lower({commas}), '%', ' % '), '[\\s\\x1c-\\x1f]+', ' ', 'g'))"


INDEX = f"list_distinct(regexp_extract_all({norm_sql('text')}, '[a-z0-9]+(?:[./_-][a-z0-9]+)?'))"
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

BM25 = rf"""
ix AS (SELECT doc_id, {INDEX} AS terms FROM documents WHERE text IS NOT NULL),
po AS (SELECT doc_id, len(terms) AS size, unnest(terms) AS term FROM ix),
st AS (SELECT count(*) AS n, avg(len(terms)) AS avg_size FROM ix),
qt AS (SELECT DISTINCT item_id, unnest({INDEX}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
i0 AS (SELECT term, avg_size, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st),
mi AS (SELECT avg(idf) AS m FROM i0),
i1 AS (SELECT term, avg_size, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM i0, mi),
sc AS (SELECT item_id, doc_id, round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * size / avg_size))), 4) AS score
       FROM qt JOIN i1 USING (term) JOIN po USING (term) GROUP BY item_id, doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


def _bm25(spark, d, top):
    docs, items = table(spark, d, "documents").where("text is not null"), table(spark, d, "benchmark")
    # texts are tokenised once for all queries over this state of the table; postings are read in blocks that may hold a hit
    index = I.lexical_index(docs, X.index_tokens(F.col("text")), "index-tokens")
    terms = items.select("item_id", F.explode(X.index_tokens(F.col("text"))).alias("term"))
    return I.search(index, terms, top)[0]


@register(f"WITH {BM25} SELECT item_id, doc_id, score, rank FROM rk WHERE rank <= 5")
def bm25_topk(spark, d):
    return _bm25(spark, d, 5).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


TAGS = rf"""
tg AS (SELECT doc_id, lower(lang) AS tag FROM documents UNION SELECT doc_id, lower(source) FROM documents),
tq AS (SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'src1' ELSE 'de' END AS term FROM benchmark),
ma AS (SELECT DISTINCT qid, tag, term FROM (SELECT DISTINCT tag FROM tg) v, tq WHERE contains(tag, term) OR contains(term, tag)),
sz AS (SELECT doc_id, count(DISTINCT tag) AS n FROM tg GROUP BY doc_id),
ts AS (SELECT qid, tg.doc_id, count(DISTINCT term) AS hits FROM tg JOIN ma ON tg.tag = ma.tag GROUP BY qid, tg.doc_id),
tr AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
       FROM (SELECT qid, doc_id, round(hits / greatest(n, 1), 4) AS score FROM ts JOIN sz USING (doc_id)))"""


def _tags(spark, d, top):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    tags = docs.select("doc_id", F.explode(F.array(F.lower("lang"), F.lower("source"))).alias("tag"))
    term = F.expr("CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'src1' ELSE 'de' END")
    return R.tag_topk(tags, items.select(F.col("item_id").alias("qid"), term.alias("term")), top)


@register(f"WITH {TAGS} SELECT qid, doc_id, score, rank FROM tr WHERE rank <= 10")
def tag_overlap_topk(spark, d):
    return _tags(spark, d, 10).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@register(f"""WITH {BM25}, {TAGS},
li AS (SELECT item_id AS qid, 'bm25' AS source, doc_id, rank FROM rk WHERE rank <= 20
       UNION ALL SELECT qid, 'tag', doc_id, rank FROM tr WHERE rank <= 20),
fu AS (SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM li GROUP BY qid, doc_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM fu)
SELECT qid, doc_id, score, sources, rank FROM fr WHERE rank <= 5""")
def rrf_fusion(spark, d):
    """Flagship: which documents best answer each question, by lexical and tag evidence fused."""
    a = _bm25(spark, d, 20).select(F.col("item_id").alias("qid"), F.lit("bm25").alias("source"), "doc_id", "rank")
    b = _tags(spark, d, 20).select("qid", F.lit("tag").alias("source"), "doc_id", "rank")
    out = U.rrf(a.unionByName(b), ["qid"], "doc_id").where("rank <= 5")
    return out.select("qid", "doc_id", F.col("score").cast("double").alias("score"), "sources", F.col("rank").cast("long").alias("rank"))


def _once(search, most):
    """search(k) for any k up to `most`, from one list of that depth: made when first asked for, kept in the shared folder."""
    held = []

    def first(k):
        if k > most:
            return search(k)
        if not held:
            held.append(cut(search(most)))
        return held[0].where(F.col("rank") <= k)

    return first


@register(f"""WITH {BM25}, {TAGS},
li AS (SELECT item_id AS qid, 'bm25' AS source, doc_id, score, rank FROM rk WHERE rank <= 10 UNION ALL SELECT qid, 'tag', doc_id, score, rank FROM tr WHERE rank <= 10),
fu AS (SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM li GROUP BY qid, doc_id),
mm AS (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM li WINDOW w AS (PARTITION BY qid, source)),
av AS (SELECT qid, doc_id, round(sum(round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN score > 0 THEN 1.0 ELSE 0.0 END, 4)) / 2 + 1e-9, 4) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM mm GROUP BY qid, doc_id),
al AS (SELECT 'both by rank' AS settings, *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM fu
 UNION ALL SELECT 'both by score', *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) FROM av
 UNION ALL SELECT 'words alone', item_id, doc_id, score, 'bm25', rank FROM rk UNION ALL SELECT 'tags alone', qid, doc_id, score, 'tag', rank FROM tr)
SELECT settings, qid, doc_id, CAST(score AS DOUBLE) AS score, sources, rank FROM al WHERE rank <= 5""")
def configured_retrieval(spark, d):
    """Four configurations, each with the backends and the fusion that it names."""
    base, out = {"use_vector_dbs": False, "top_n_retrieval": 5, "answering_model": "any"}, None
    wanted = (("both by rank", {"use_bm25_db": True}), ("both by score", {"use_bm25_db": True, "fusion_method": "average"}), ("words alone", {"use_bm25_db": True, "use_tag_db": False}), ("tags alone", {}))
    wanted = [(name, K.Settings.of(base | more)) for name, more in wanted]
    most = max(s.depth(s.top_n_retrieval) for _, s in wanted)
    backends = {"bm25": _once(lambda k: _bm25(spark, d, k).withColumnRenamed("item_id", "qid"), most), "tag": _once(lambda k: _tags(spark, d, k), most)}
    for name, settings in wanted:
        got = K.retrieve(settings, backends, ["qid"], "doc_id").select(F.lit(name).alias("settings"), "qid", "doc_id", F.col("score").cast("double").alias("score"), "sources", F.col("rank").cast("long").alias("rank"))
        out = got if out is None else out.unionByName(got)
    return out


LISTS = """
li AS (SELECT o_orderstatus AS qid, 'price' AS source, o_custkey AS key, max(o_totalprice) AS score FROM orders GROUP BY 1, 3
       UNION ALL SELECT o_orderstatus, 'count', o_custkey, CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 3),
rl AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, key) AS rank FROM li),
tl AS (SELECT * FROM rl WHERE rank <= 30),
mm AS (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM tl WINDOW w AS (PARTITION BY qid, source)),
sc AS (SELECT qid, source, key, rank, score, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN score > 0 THEN 1.0 ELSE 0.0 END, 4) AS s FROM mm)"""


def _lists(spark, d):
    o = table(spark, d, "orders")
    a = o.groupBy(F.col("o_orderstatus").alias("qid"), F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("score")).withColumn("source", F.lit("price"))
    b = o.where("o_orderstatus <> 'P'").groupBy(F.col("o_orderstatus").alias("qid"), F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("score")).withColumn("source", F.lit("count"))
    return R.ranked(a.unionByName(b), ["qid", "source"], F.col("score").desc(), F.col("key"), top=30)


@register(f"WITH {LISTS} SELECT qid, source, key, s FROM sc")
def minmax_scores(spark, d):
    return _lists(spark, d).withColumn("s", U.minmax(F.col("score"), ["qid", "source"])).select("qid", "source", "key", "s")


@register(f"""WITH {LISTS}, ac AS (SELECT qid, count(DISTINCT source) AS n FROM sc GROUP BY qid),
av AS (SELECT qid, key, round(sum(s) / n + 1e-9, 4) AS score FROM sc JOIN ac USING (qid) GROUP BY qid, key, n)
SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM av""")
def avg_fusion(spark, d):
    out = U.average_fusion(_lists(spark, d), ["qid"], "key")
    return out.select("qid", "key", "score", F.col("rank").cast("long").alias("rank"))


@register(f"""WITH {LISTS}, ac AS (SELECT qid, count(DISTINCT source) AS n FROM tl GROUP BY qid),
fu AS (SELECT qid, key, round(sum(1.0 / (60 + rank)), 6) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
       FROM tl JOIN ac USING (qid) WHERE n > 1 GROUP BY qid, key)
SELECT qid, key, score, sources, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM fu
UNION ALL SELECT qid, key, score, source, rank FROM tl JOIN ac USING (qid) WHERE n = 1""")
def single_backend_bypass(spark, d):
    out = U.fuse(_lists(spark, d), ["qid"], "key")
    return out.select("qid", "key", F.col("score").cast("double").alias("score"), "sources", F.col("rank").cast("long").alias("rank"))


@register("""WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, v.vec_id, round(list_dot_product(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])) /
  (sqrt(list_dot_product(CAST(qv AS DOUBLE[]), CAST(qv AS DOUBLE[]))) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 4) AS score
  FROM q, embeddings v WHERE v.vec_id <> qid)
SELECT qid, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def dense_topk_cosine(spark, d):
    v = table(spark, d, "embeddings")
    out = R.dense_topk(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), v, 10)
    return out.select("qid", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def _asked(v):
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def _short(n, top=10):
    """How long a short list is: twenty times what is asked for, a tenth of a small table."""
    return max(4 * top, min(20 * top, n // 10))


@register()
def dense_topk_by_cell(spark, d):
    """Product-quantised codes in cells, stored and read again; whole vectors of a short list order it. Approximate, so it has
    no exact SQL; recall is tested."""
    v, path = table(spark, d, "embeddings"), new_path(spark, "vectors")
    V.write_index(v, path)
    index = V.read_index(spark, path)
    return V.pq_topk(index, _asked(v), 10, _short(index.rows)).select("qid", "vec_id", "score", "rank")


@register()
def dense_topk_by_graph(spark, d):
    """A neighbour graph over the codes, stored and walked for all questions at once; recall is tested."""
    v, path = table(spark, d, "embeddings"), new_path(spark, "vectors")
    V.write_index(v, path)
    V.write_graph(V.read_index(spark, path), path)
    index = V.read_index(spark, path, graph=True)
    return V.graph_topk(index, _asked(v), 10, short=_short(index.rows)).select("qid", "vec_id", "score", "rank", "compared")


@register("""WITH g AS (SELECT vec_id // 4 AS gid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
q AS (SELECT * FROM g WHERE gid % 25 = 0),
b AS (SELECT q.gid AS qid, g.gid AS doc, q.vec_id, max(list_dot_product(q.e, g.e)) AS best FROM q, g WHERE g.gid <> q.gid GROUP BY 1, 2, 3),
s AS (SELECT qid, doc, round(sum(best), 4) AS score FROM b GROUP BY qid, doc)
SELECT qid, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 5""")
def late_interaction_maxsim(spark, d):
    """Documents of four token vectors; questions are the documents that hold a vector whose id is divisible by 100."""
    g = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("gid"), "vec_id", "embedding").groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("m"))
    g = g.select(F.col("gid").alias("doc"), F.col("m.embedding").alias("tokens"))
    out = R.late_topk(g.where("doc % 25 = 0").withColumnRenamed("doc", "qid"), g, "doc", 5)
    return out.select("qid", "doc", "score", F.col("rank").cast("long").alias("rank"))


@register(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
q AS (SELECT item_id AS qid, term, count(*) AS qw FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT qid, doc_id, round(sum(ln(1 + tf) * qw), 4) AS score FROM t JOIN q USING (term) GROUP BY 1, 2)
SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def sparse_topk(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qw"))
    w = R.wanted_terms(table(spark, d, "documents"), X.tokens(F.col("text")), q).withColumn("w", F.log1p("tf"))
    return R.sparse_topk(w, q, 5).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


CHILD = """
c AS (SELECT l_suppkey AS qid, l_orderkey AS parent, l_linenumber AS chunk, round(l_extendedprice, 2) AS score FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, parent, chunk) AS rank FROM c)"""


def _children(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("qid"), F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("chunk"), F.round("l_extendedprice", 2).alias("score"))
    return R.ranked(R.dealt(c, "qid"), ["qid"], F.col("score").desc(), F.col("parent"), F.col("chunk"))


@register(f"""WITH {CHILD}, f AS (SELECT qid, parent, min(rank) AS first FROM r GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first) AS parent_rank FROM f)
SELECT r.qid, r.parent, o.parent_rank, max(r.score) AS score, string_agg(CAST(r.chunk AS VARCHAR), ',' ORDER BY r.rank) AS children, count(*) AS n_children
FROM r JOIN o ON r.qid = o.qid AND r.parent = o.parent LEFT JOIN o s ON s.qid = r.qid AND s.parent_rank = 4
WHERE o.parent_rank <= 3 AND (s.first IS NULL OR r.rank < s.first) GROUP BY 1, 2, 3""")
def parent_aggregation(spark, d):
    out = U.parents_of(_children(spark, d), ["qid"], 3)
    return out.select("qid", "parent", F.col("parent_rank").cast("long").alias("parent_rank"), "score", "children", F.col("n_children").cast("long").alias("n_children"))


@register(f"""WITH {CHILD}, p AS (SELECT *, row_number() OVER (PARTITION BY qid, parent ORDER BY rank) AS k FROM r)
SELECT qid, parent, chunk, page_rank FROM (SELECT qid, parent, chunk, row_number() OVER (PARTITION BY qid ORDER BY rank) AS page_rank FROM p WHERE k = 1) WHERE page_rank <= 4""")
def page_dedup(spark, d):
    return U.best_per_page(_children(spark, d), ["qid"], "parent", 4).select("qid", "parent", "chunk", F.col("page_rank").cast("long").alias("page_rank"))


@register(f"""WITH {CHILD}, t AS (SELECT * FROM r),
g AS (SELECT qid, parent, max(score) AS best, count(*) AS evidence, list(chunk ORDER BY rank) AS cs FROM t GROUP BY 1, 2),
s AS (SELECT qid, parent, best, evidence, round(best + 0.02 * (evidence - 1), 4) AS score, array_to_string(cs[1:3], ',') AS chunks FROM g)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, parent) AS rank FROM s""")
def report_aggregation(spark, d):
    out = U.reports_of(_children(spark, d), ["qid"], "parent")
    return out.select("qid", "parent", "best", F.col("evidence").cast("long").alias("evidence"), "score", "chunks", F.col("rank").cast("long").alias("rank"))


@register("""WITH q AS (SELECT l_returnflag AS qid, l_linestatus AS query_no, l_partkey AS key, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT qid, key, max(score) AS score, string_agg(DISTINCT query_no, ',' ORDER BY query_no) AS queries, count(DISTINCT query_no) AS hits FROM q GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, score DESC, key) AS rank FROM g) WHERE rank <= 24""")
def multi_query_merge(spark, d):
    q = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("qid"), F.col("l_linestatus").alias("query_no"), F.col("l_partkey").alias("key")).agg(F.max("l_extendedprice").alias("score"))
    out = U.multi_query(q, ["qid"], "key", 24)
    return out.select("qid", "key", "score", "queries", F.col("hits").cast("long").alias("hits"), F.col("rank").cast("long").alias("rank"))


@register("""WITH p AS (SELECT p_brand AS qid, p_partkey AS key, p_retailprice / 3000 AS distance, p_size / 50.0 AS m FROM part),
a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance DESC, key) AS pool_rank FROM p),
b AS (SELECT * FROM a WHERE pool_rank <= 24),
c AS (SELECT *, max(m) OVER w AS hi, min(m) OVER w AS lo FROM b WINDOW w AS (PARTITION BY qid)),
e AS (SELECT *, round(CASE WHEN hi > lo THEN (m - lo) / (hi - lo) WHEN m > 0 THEN 1.0 ELSE 0.0 END, 4) AS late FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY late DESC, pool_rank) AS late_rank FROM e),
g AS (SELECT qid, key, late_rank, round(0.7 * distance + (1 - 0.7) * late + 1e-9, 4) AS score FROM f WHERE late_rank <= 8)
SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, late_rank) AS rank FROM g""")
def rerank_cascade(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("qid"), F.col("p_partkey").alias("key"), (F.col("p_retailprice") / 3000).alias("distance"), (F.col("p_size") / 50.0).alias("m"))
    out = U.cascade(p, ["qid"], "key", 24, F.col("m"), 8, F.col("distance"))
    return out.select("qid", "key", "score", F.col("rank").cast("long").alias("rank"))


@register("""WITH r AS (SELECT o_custkey % 40 AS qid, o_orderkey AS key, o_totalprice / 600000 AS score, 1 AS hits FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC) AS n FROM r),
t AS (SELECT qid, max(score) AS best, min(score) AS second, count(*) AS n FROM k WHERE n <= 2 GROUP BY qid),
q AS (SELECT CAST(range AS BIGINT) AS qid FROM range(60))
SELECT q.qid, coalesce(best IS NULL OR best < 0.55 OR (n > 1 AND best - second < 0.05), true) AS trigger FROM q LEFT JOIN t ON q.qid = t.qid""")
def hyde_trigger(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("qid"), F.col("o_orderkey").alias("key"), (F.col("o_totalprice") / 600000).alias("score"), F.lit(1).alias("hits"))
    return U.hyde_trigger(rows, spark.range(60).withColumnRenamed("id", "qid"), "qid")


@register("SELECT p_partkey, p_name FROM part WHERE (CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END IS NULL OR CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END = (SELECT min(p_brand) FROM part))")
def null_permissive_filter(spark, d):
    p = table(spark, d, "part")
    brand = F.when(F.col("p_size") % 7 != 0, F.col("p_brand"))
    low = p.agg(F.min("p_brand").alias("low"))  # one row
    return p.crossJoin(F.broadcast(low)).where(P.permissive(brand, F.col("low"))).select("p_partkey", "p_name")


NAME, TYPE = norm_sql("p_name"), norm_sql("p_type")


@register(f"""WITH t AS (SELECT p_partkey, contains({NAME}, 'red') OR contains('red', {NAME}) AS by_name, p_size % 5 = 0 OR contains({TYPE}, 'small') OR contains('small', {TYPE}) AS by_type FROM part)
SELECT * FROM t WHERE by_name OR by_type""")
def bi_contains_filter(spark, d):
    by_name, by_type = P.bi_contains(F.lit(" RED "), F.col("p_name")), P.bi_contains(F.lit("Small"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")))
    return table(spark, d, "part").select("p_partkey", by_name.alias("by_name"), by_type.alias("by_type")).where("by_name or by_type")


@register("""WITH t AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN [] ELSE list_append(string_split(lower(p_name), ' '), lower(p_type)) END AS seen FROM part)
SELECT p_partkey FROM t WHERE len(list_filter(seen, lambda x: contains(x, 'bolt') OR contains('bolt', x))) > 0 AND len(list_filter(seen, lambda x: contains(x, 'small') OR contains('small', x))) > 0""")
def tag_list_filter(spark, d):
    seen = F.when(F.col("p_size") % 9 != 0, F.concat(F.split("p_name", " "), F.array("p_type")))
    return table(spark, d, "part").where(P.tags_match(seen, F.array(F.lit("Bolt"), F.lit("small")))).select("p_partkey")


@register("""SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE (r_name = 'ASIA' OR r_name IS NULL) AND (contains(lower(c_mktsegment), 'a') OR contains('a', lower(c_mktsegment)))
 AND (c_custkey % 3 = 0 OR 2020 + c_custkey % 4 = 2021) AND (contains(lower(n_name), '1') OR contains('1', lower(n_name))) AND c_acctbal > 0""")
def metadata_filter(spark, d):
    """The whole conjunction: an equal scalar, a text both ways, a year that may be unknown, a section, a topic flag."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    year = F.when(F.col("c_custkey") % 3 != 0, (2020 + F.col("c_custkey") % 4).cast("int"))
    rows = rows.select("c_custkey", F.col("r_name").alias("company_name"), F.col("c_mktsegment").alias("board"), year.alias("report_year"), F.col("n_name").alias("section_name"), F.when(F.col("c_acctbal") > 0, F.array(F.lit("has_funds"))).alias("topic_flags"))
    return rows.where(P.matches(rows, P.Filters(company_name="ASIA", board="A", year=2021, section_name="1", required_topic_flags=["has_funds"]))).select("c_custkey")


@register("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'year_filter_match,' ELSE '' END || 'board_filter_match,listing_tags:a,doc_source_type_filter_match' AS reasons FROM customer
WHERE (c_custkey % 3 = 0 OR 2020 + c_custkey % 4 = 2021) AND contains(lower(c_mktsegment), 'furn') AND c_acctbal > 0 AND c_custkey % 2 = 1""")
def catalog_filter(spark, d):
    year = F.when(F.col("c_custkey") % 3 != 0, (2020 + F.col("c_custkey") % 4).cast("string"))
    rows = table(spark, d, "customer").select("c_custkey", year.alias("fiscal_year"), F.col("c_mktsegment").alias("board"), F.when(F.col("c_acctbal") > 0, F.array(F.lit("A"), F.lit("b"))).alias("listing_tags"), F.when(F.col("c_custkey") % 2 == 1, "annual_report").otherwise("other").alias("doc_source_type"))
    passes, why = P.catalog_matches(rows, P.Filters(year=2021, board="Furn", listing_tags=["a"], doc_source_type="annual_report"))
    return rows.where(passes).select("c_custkey", F.array_join(why, ",").alias("reasons"))


@register("""WITH r AS (SELECT o_custkey AS qid, o_orderkey AS key, round(o_totalprice / 600000, 4) AS score, CASE o_orderkey % 4 WHEN 0 THEN 'serialized_table' WHEN 1 THEN 'table' WHEN 2 THEN 'chart_to_table' ELSE 'content' END AS kind FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY score DESC, key) AS k FROM r),
b AS (SELECT qid, key, CAST(CASE kind WHEN 'serialized_table' THEN 0.12 WHEN 'table' THEN 0.1 WHEN 'chart_to_table' THEN 0.08 ELSE 0.0 END AS DOUBLE) AS filter_bonus, score FROM t WHERE k <= 3)
SELECT qid, key, filter_bonus, ranking_score, rank FROM (SELECT *, round(score + filter_bonus, 4) AS ranking_score, row_number() OVER (PARTITION BY qid ORDER BY round(score + filter_bonus, 4) DESC, key) AS rank FROM b) WHERE rank <= 3""")
def kind_bonus_rerank(spark, d):
    """The bonus of a question's kind comes after the best of each document, and orders them again."""
    kind = F.when(F.col("o_orderkey") % 4 == 0, "serialized_table").when(F.col("o_orderkey") % 4 == 1, "table").when(F.col("o_orderkey") % 4 == 2, "chart_to_table").otherwise("content")
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("key"), F.round(F.col("o_totalprice") / 600000, 4).alias("score"), kind.alias("kind"))
    best = R.ranked(r, ["qid", "kind"], F.col("score").desc(), F.col("key"), top=3).drop("rank")
    out = R.ranked(P.with_bonus(best, F.lit("number"), F.col("kind")), ["qid"], F.col("ranking_score").desc(), F.col("key"), top=3)
    return out.select("qid", "key", "filter_bonus", "ranking_score", F.col("rank").cast("long").alias("rank"))


@register("""WITH p AS (SELECT c_custkey, s.seg AS qid, c_acctbal,
  round(CASE WHEN c_mktsegment = s.seg THEN 6.0 ELSE 0.0 END + CASE WHEN r_name = 'ASIA' THEN 2.5 ELSE 0.0 END + CASE WHEN c_acctbal > 5000 THEN 2.0 ELSE 0.0 END, 4) AS score
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, (SELECT DISTINCT c_mktsegment AS seg FROM customer) s)
SELECT qid, c_custkey, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, c_acctbal DESC, c_custkey DESC) AS rank FROM p WHERE score > 0) WHERE rank <= 10""")
def catalog_score_topk(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    # without its name a customer scores the same for every segment, so only the best of each segment can be among anyone's best
    rows = rows.withColumn("base", G.catalog_score(doc_type=F.col("r_name") == "ASIA", year=F.col("c_acctbal") > 5000))
    rows = R.ranked(rows, ["c_mktsegment"], F.col("base").desc(), F.col("c_acctbal").desc(), F.col("c_custkey").desc(), top=10).drop("rank")
    names = rows.groupBy(F.lit(1).alias("one")).agg(F.collect_set("c_mktsegment").alias("segments"))  # one row, a name per segment
    rows = rows.withColumn("one", F.lit(1)).join(names, "one").withColumn("qid", F.explode("segments"))
    rows = rows.withColumn("score", G.catalog_score(name=F.col("c_mktsegment") == F.col("qid"), doc_type=F.col("r_name") == "ASIA", year=F.col("c_acctbal") > 5000))
    return G.catalog_topk(rows, ["qid"], 10, F.col("c_acctbal").desc(), F.col("c_custkey").desc()).select("qid", "c_custkey", "score", F.col("rank").cast("long").alias("rank"))


ALIASES = f"""a AS (SELECT DISTINCT item_id, alias FROM (SELECT item_id, array_to_string(string_split({norm_sql('text')}, ' ')[1:2], ' ') AS alias FROM benchmark UNION ALL SELECT item_id, substr(text, 3, 7) FROM benchmark) WHERE alias IS NOT NULL),
n AS (SELECT DISTINCT alias, {norm_sql('alias')} AS name FROM a WHERE {norm_sql('alias')} <> ''), d AS (SELECT doc_id, {norm_sql('text')} AS low FROM documents),
m AS (SELECT doc_id, alias, CAST(instr(low, name) AS BIGINT) AS position FROM d JOIN n ON contains(low, name))"""


def _aliases(spark, d):
    b = table(spark, d, "benchmark")
    head = F.array_join(F.slice(F.split(X.normalize_text(F.col("text")), " "), 1, 2), " ")
    return b.select("item_id", F.explode(F.array(head, F.substring("text", 3, 7))).alias("alias")).distinct()


@register(f"WITH {ALIASES} SELECT doc_id, alias, position FROM m")
def alias_theta_join(spark, d):
    """Every item's first two words, and seven characters out of it, found anywhere in any document."""
    return G.alias_matches(table(spark, d, "documents").select("doc_id", "text"), _aliases(spark, d).select("alias").distinct(), "doc_id")


@register(f"""WITH {ALIASES}, f AS (SELECT doc_id, item_id AS company, min(position) AS position FROM m JOIN a USING (alias) GROUP BY 1, 2)
SELECT doc_id, company, position, row_number() OVER (PARTITION BY doc_id ORDER BY position, company) AS place FROM f""")
def companies_by_position(spark, d):
    a = _aliases(spark, d)
    m = G.alias_matches(table(spark, d, "documents").select("doc_id", "text"), a.select("alias").distinct(), "doc_id")
    return G.companies_in_order(m, a.withColumnRenamed("item_id", "company"), "doc_id").select("doc_id", "company", "position", F.col("place").cast("long").alias("place"))


@register(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
c AS (SELECT doc_id, words, unnest(range(0, 1 + CAST(floor(greatest(len(words) - 50 - 1, 0) / 270) AS INT))) AS chunk FROM w WHERE len(words) > 0)
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(floor(chunk / 4) AS BIGINT) AS parent, length(array_to_string(words[chunk * 270 + 1 : chunk * 270 + 320], ' ')) AS chars FROM c""")
def parent_child_window(spark, d):
    out = C.windows(table(spark, d, "documents"), 320, 50)
    return out.select("doc_id", "chunk", "parent", F.length("text").cast("long").alias("chars"))


@register(r"""WITH p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, CASE o_orderkey % 5 WHEN 0 THEN 1985 WHEN 1 THEN 2050 ELSE year(o_orderdate) END AS y FROM orders),
c AS (SELECT doc_id, y, count(*) AS n, min(page) AS first FROM p WHERE page <= 5 AND y BETWEEN 1990 AND 2100 GROUP BY 1, 2)
SELECT doc_id, CAST(y AS INT) AS year, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM c) WHERE k = 1""")
def infer_year_mode(spark, d):
    o = table(spark, d, "orders")
    year = F.when(F.col("o_orderkey") % 5 == 0, 1985).when(F.col("o_orderkey") % 5 == 1, 2050).otherwise(F.year("o_orderdate"))
    text = F.concat(F.lit("in "), year.cast("string"), F.lit(", not x2001 or 2001年."))
    pages = o.select(F.col("o_custkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"), text.alias("text"))
    return C.year_mode(pages, "doc_id").select("doc_id", "year", F.col("n").cast("long").alias("n"))


@register(r"""WITH q AS (SELECT item_id % 10 AS qid, item_id AS pos, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS print FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 1000000, upper(text) || ' !' FROM benchmark)),
f AS (SELECT *, row_number() OVER (PARTITION BY qid, print ORDER BY pos) AS n FROM q WHERE print <> '')
SELECT qid, pos, query_no FROM (SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY pos) AS query_no FROM f WHERE n = 1) WHERE query_no <= 4""")
def dedupe_fingerprint(spark, d):
    """Every item's whole text, and once more in capitals with another sign: the two are one query."""
    b = table(spark, d, "benchmark")
    both = b.select("item_id", "text").unionByName(b.select((F.col("item_id") + 1_000_000).alias("item_id"), F.concat(F.upper("text"), F.lit(" !")).alias("text")))
    q = both.select((F.col("item_id") % 10).alias("qid"), F.col("item_id").alias("pos"), F.col("text").alias("query"))
    return G.limit_queries(q, "qid", "pos", 4).select("qid", "pos", F.col("query_no").cast("long").alias("query_no"))


ASKED = "'Is ' || text || ' about 科创板 上交所 digital 数字化 in a ' || CASE doc_id % 3 WHEN 0 THEN '2024 年报 with dividend policy, CNY' WHEN 1 THEN 'guidance of Q3, $' ELSE '电子行业 上游 outlook' END"
MONEY = r"regexp_extract(t, '\b(?:USD|EUR|GBP|JPY|CNY|RMB|AUD|CAD|CHF|HKD)\b|[$€£¥￥]')"


@register(rf"""WITH q AS (SELECT doc_id, {ASKED} AS t FROM documents), n AS (SELECT *, {norm_sql('t')} AS f FROM q WHERE t IS NOT NULL)
SELECT doc_id, CAST(list_aggregate(list_transform(regexp_extract_all(t, '(?:19|20)\d{{2}}'), lambda y: CAST(y AS INT)), 'max') AS INT) AS year,
 CASE {MONEY} WHEN '' THEN NULL WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN 'RMB' THEN 'CNY' ELSE {MONEY} END AS currency,
 CASE WHEN regexp_matches(f, '年报|年度报告|annual report') THEN 'annual_report' WHEN regexp_matches(f, '中报|半年报|季报|q1|q2|q3|q4') THEN 'interim_report' END AS doc_source_type, '上海证券交易所' AS exchange, '科创板' AS board,
 CASE WHEN regexp_matches(f, '上游') THEN '上游资源' END AS chain,
 array_to_string(list_filter(['has_dividend_policy_changes', 'has_guidance_updates'], lambda x: CASE x WHEN 'has_guidance_updates' THEN regexp_matches(f, 'guidance|outlook|forecast') ELSE regexp_matches(f, 'dividend policy') END), ',') AS topics,
 CASE WHEN contains(f, 'ai') THEN '数字化转型,人工智能' ELSE '数字化转型' END AS tags FROM n""")
def query_rewrite(spark, d):
    """What is read out of questions about documents, whole texts included."""
    q = table(spark, d, "documents").select("doc_id", F.expr(ASKED).alias("t")).where("t is not null")
    q = N.fixed(q, f=X.normalize_text(F.col("t")))  # thirty patterns read it
    r = G.rewrite(F.col("t"), F.col("f"))
    topics = F.array_intersect(r["topic_flags"], F.array(F.lit("has_dividend_policy_changes"), F.lit("has_guidance_updates")))
    names = {"year": "year", "currency": "currency", "doc_source_type": "doc_source_type", "exchange": "exchange", "board": "board", "chain_position_major": "chain"}
    return q.select("doc_id", *[r[k].alias(n) for k, n in names.items()], F.array_join(topics, ",").alias("topics"), F.array_join(r["strategy_tags"], ",").alias("tags"))


@register("""WITH r AS (SELECT doc_id, source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, CASE WHEN length(text) > 2500 THEN 2508 ELSE length(text) END AS p FROM documents),
b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
c AS (SELECT *, CASE WHEN p > 8000 - before THEN 8000 - before + 8 ELSE p END AS q FROM b WHERE before < 8000)
SELECT source, CAST(sum(q) + 2 * (count(*) - 1) AS BIGINT) AS chars FROM c GROUP BY source""")
def context_budget(spark, d):
    return C.context(table(spark, d, "documents").select("doc_id", "source", "text"), ["source"], order="doc_id").select("source", F.length("context").cast("long").alias("chars"))
