"""Queries: tables, answers, evaluation, curation, sources and streams, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
from ..operators import curate as K
from ..operators import evaluate as E
from ..operators import filters as P
from ..operators import retrieval as R
from ..operators import sft as L
from ..operators import tables as T
from ..sources import manifests as M
from ..streaming import events as S
from ._tables import table

QUERIES, SQL = {}, {}


def register(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CELLS = """cells AS (SELECT l_orderkey AS doc, CAST(round(l_linenumber * 1e9 + l_extendedprice * 100) AS BIGINT) AS ordinal, CAST((l_linenumber + 1) // 2 AS INT) AS page, l_quantity AS value,
  round(CASE WHEN l_returnflag = 'R' THEN 4.0 WHEN l_returnflag = 'A' THEN 2.5 ELSE 1.0 END + CASE WHEN l_discount > 0.05 THEN 1.5 ELSE 0.0 END, 4) AS score FROM lineitem),
best AS (SELECT doc, ordinal, page, value, score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, ordinal) AS k FROM cells WHERE score >= 2.2) WHERE k = 1)"""


def _place():
    """A total order within an order, whose line numbers repeat."""
    return F.round(F.col("l_linenumber") * 1e9 + F.col("l_extendedprice") * 100).cast("long")


def _cells(spark, d):
    score = F.when(F.col("l_returnflag") == "R", 4.0).when(F.col("l_returnflag") == "A", 2.5).otherwise(1.0) + F.when(F.col("l_discount") > 0.05, 1.5).otherwise(0.0)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), _place().alias("ordinal"), F.floor((F.col("l_linenumber") + 1) / 2).cast("int").alias("page"), F.col("l_quantity").alias("value"), F.round(score, 4).alias("score"))


@register(f"WITH {CELLS} SELECT doc, ordinal, page, value, score FROM best")
def cell_grounding_argmax(spark, d):
    return T.best_cell(_cells(spark, d), ["doc"])


@register(f"""WITH {CELLS}, h AS (SELECT c.*, row_number() OVER (PARTITION BY c.doc, c.page ORDER BY c.score DESC, c.ordinal) AS k
  FROM cells c JOIN best b ON c.doc = b.doc AND abs(c.value - b.value) <= greatest(1.0, abs(b.value) * 1e-6) AND c.ordinal <> b.ordinal)
SELECT doc, ordinal, page, support_rank FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) AS support_rank FROM h WHERE k = 1) WHERE support_rank <= 2""")
def same_value_support(spark, d):
    cells = _cells(spark, d)
    return T.same_value_support(T.best_cell(cells, ["doc"]), cells, "doc").select("doc", "ordinal", "page", F.col("support_rank").cast("long").alias("support_rank"))


@register("""WITH p AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey % 12 AS page FROM lineitem),
c AS (SELECT *, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS chain FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, chain ORDER BY page) AS place, count(*) OVER (PARTITION BY doc, chain) AS size FROM c)
SELECT doc, page, place, size, CASE WHEN size = 1 THEN 'single' WHEN place = 1 THEN 'head' WHEN place = size THEN 'tail' ELSE 'middle' END AS role FROM r""")
def adjacent_page_chains(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 12).alias("page")).distinct()
    return T.page_chains(p, "doc").select("doc", "page", F.col("place").cast("long").alias("place"), F.col("size").cast("long").alias("size"), "role")


PARTS = """li AS (SELECT l_orderkey AS doc, CAST(round(l_linenumber * 1e9 + l_extendedprice * 100) AS BIGINT) AS table_id, l_linenumber AS page, l_returnflag, l_linestatus, l_discount, l_tax, l_quantity FROM lineitem),
e AS (SELECT a.doc, a.page, a.table_id AS "left", b.table_id AS "right", greatest(0.0, least(1.0, 0.18
  + CASE WHEN 0.6 + a.l_quantity / 100 >= 0.78 AND b.l_tax * 5 <= 0.22 THEN 0.12 WHEN 0.6 + a.l_quantity / 100 >= 0.68 AND b.l_tax * 5 <= 0.30 THEN 0.07 ELSE 0.0 END
  + CASE WHEN a.l_linestatus = b.l_linestatus THEN 0.14 ELSE 0.0 END
  + CASE WHEN a.l_returnflag = b.l_returnflag THEN 0.18 ELSE 0.10 END
  + CASE WHEN a.l_discount > 0.05 AND b.l_discount > 0.05 THEN 0.08 WHEN a.l_discount > 0.05 THEN 0.06 ELSE 0.0 END
  + CASE WHEN b.l_tax > 0.06 THEN 0.18 ELSE 0.0 END
  + CASE WHEN a.l_returnflag = 'R' THEN -0.22 WHEN a.l_returnflag <> b.l_returnflag THEN 0.10 ELSE 0.06 END)) AS score
 FROM li a JOIN li b ON a.doc = b.doc AND b.page = a.page + 1)"""


def _parts(spark, d):
    """Line items as tables: pages are line numbers, boxes, sections, heads and units come from their other columns."""
    c = F.col
    last = F.when(c("l_returnflag") == "R", "合计 R").otherwise(c("l_returnflag"))
    return table(spark, d, "lineitem").select(
        c("l_orderkey").alias("doc"), _place().alias("table_id"), c("l_linenumber").alias("page"), F.array(F.lit(0.0), c("l_tax") * 5, F.lit(1.0), F.lit(0.6) + c("l_quantity") / 100).alias("bbox"),
        c("l_linestatus").alias("section_name"), F.lit(None).cast("string").alias("report_section"), F.lit("").alias("section_title"), F.lit(2).alias("ncols"), F.array(F.lit("item"), c("l_returnflag")).alias("col_heads"),
        F.when(c("l_discount") > 0.05, "万元").alias("unit_hint"), F.when(c("l_tax") > 0.06, "表 （续表）").alias("caption"), F.lit("").alias("markdown"), last.alias("last_row"), last.alias("first_row"), c("l_quantity"),
    )


@register(f"""WITH {PARTS} SELECT doc, "left", "right", round(score, 4) AS score, CASE WHEN round(score, 4) >= 0.62 THEN 'confirmed' ELSE 'candidate' END AS state FROM e WHERE round(score, 4) >= 0.42""")
def table_edge_scores(spark, d):
    return T.table_edges(_parts(spark, d), "doc").drop("page")


@register()
def table_greedy_matching(spark, d):
    """Greedy one-to-one choice over scored links, page by page; SQL has no form for it, a test compares it with brute force."""
    return T.greedy_pairs(T.table_edges(_parts(spark, d), "doc"), "doc").drop("page")


@register()
def logical_tables(spark, d):
    """Chains of chosen links with their members' roles; a test compares them with brute force."""
    parts = _parts(spark, d)
    out = T.link_tables(parts, "doc").where("logical_table_id is not null")
    return out.select("doc", "table_id", "logical_table_id", "place", "role", "continuation_of", "merge_confidence", "materializable")


@register("""WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS table_id, CAST(l_suppkey % 5 AS INT) AS row_idx, CAST(l_partkey % 3 AS INT) AS col_idx, CASE WHEN l_discount > 0.07 THEN l_shipmode ELSE NULL END AS u FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) WHERE l_linenumber <= 3),
k AS (SELECT DISTINCT doc, table_id FROM c), m AS (SELECT doc, table_id, max(row_idx) AS most, arg_min(u, row_idx * 10 + col_idx) FILTER (WHERE u IS NOT NULL) AS cu FROM (SELECT doc, table_id, row_idx, col_idx, min(u) AS u FROM c GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
o AS (SELECT *, coalesce(sum(most + 1) OVER w, 0) AS row_offset, CASE WHEN table_id = 2 THEN 'T2' END AS tu FROM m WINDOW w AS (PARTITION BY doc ORDER BY table_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, coalesce(max(tu) OVER (PARTITION BY doc), first_value(cu IGNORE NULLS) OVER (PARTITION BY doc ORDER BY table_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS any_unit FROM o)
SELECT DISTINCT c.doc, c.table_id, c.row_idx, c.col_idx, CAST(c.row_idx + row_offset AS BIGINT) AS logical_row_idx, coalesce(c.u, tu, any_unit) AS unit_hint FROM (SELECT doc, table_id, row_idx, col_idx, min(u) AS u FROM c GROUP BY 1, 2, 3, 4) c JOIN a ON a.doc = c.doc AND a.table_id = c.table_id""")
def logical_table_rows(spark, d):
    """Rows of chained tables counted on, units inherited."""
    c = F.col
    cells = table(spark, d, "lineitem").where("l_linenumber <= 3").select(c("l_orderkey").alias("doc"), c("l_linenumber").alias("table_id"), (c("l_suppkey") % 5).cast("int").alias("row_idx"), (c("l_partkey") % 3).cast("int").alias("col_idx"), F.when(c("l_discount") > 0.07, c("l_returnflag")).alias("u"))
    cells = cells.groupBy("doc", "table_id", "row_idx", "col_idx").agg(F.min("u").alias("unit_hint")).withColumn("period", F.lit(None).cast("string")).withColumn("col_head", F.lit("h"))
    tables = cells.select("doc", "table_id").distinct().select("doc", "table_id", F.lit("logical").alias("logical_table_id"), c("table_id").alias("place"), F.lit(True).alias("materializable"), F.when(c("table_id") == 2, "T2").alias("unit_hint"), F.lit("").alias("period"), F.array(F.lit("h")).alias("col_heads"))
    out = T.materialize(cells, tables, "doc")
    return out.select("doc", "table_id", "row_idx", "col_idx", c("logical_row_idx").cast("long").alias("logical_row_idx"), "unit_hint")


@register("""WITH li AS (SELECT *, CAST(round(l_linenumber * 1e9 + l_extendedprice * 100) AS BIGINT) AS part FROM lineitem) SELECT l_orderkey AS doc, part, CAST(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_offset,
 last_value(CASE WHEN l_discount > 0.05 THEN l_returnflag END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY part ROWS UNBOUNDED PRECEDING) AS head FROM li""")
def header_inheritance(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), _place().alias("part"), "l_quantity", F.when(F.col("l_discount") > 0.05, F.col("l_returnflag")).alias("h"))
    order = ["part", "l_quantity", "h"]  # lines of one place in a total order, so that every run gives the same rows
    return T.row_offsets(li, ["doc"], order, "l_quantity").select("doc", "part", F.col("row_offset").cast("long").alias("row_offset"), T.inherited(F.col("h"), ["doc"], order).alias("head"))


@register("""SELECT p_partkey AS key, s.series, p_brand AS x, CASE s.series WHEN 'size' THEN CAST(p_size AS VARCHAR) ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) END AS raw,
 CASE s.series WHEN 'size' THEN CAST(p_size AS DOUBLE) ELSE floor(p_retailprice) END * CASE WHEN p_partkey % 2 = 0 THEN 1e4 ELSE 1.0 END AS value, CASE WHEN p_partkey % 2 = 0 THEN '万元' END AS unit,
 round(least(0.95, 0.35 + 0.2 + 0.2 + CASE WHEN p_partkey % 2 = 0 THEN 0.15 + 0.05 ELSE 0.0 END + CASE WHEN regexp_matches(CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR), '20[0-9]{2}') THEN 0.05 ELSE 0.0 END + 0.05), 4) AS confidence
FROM part, (VALUES ('size'), ('price')) s(series)""")
def chart_unpivot(spark, d):
    raw = F.concat(F.lit("| x | size | price |<0x0A>|---|---|---|\\n| "), F.col("p_brand"), F.lit(" | "), F.col("p_size").cast("string"), F.lit(" | "), F.floor("p_retailprice").cast("string"), F.lit(" |"))
    charts = table(spark, d, "part").select(F.col("p_partkey").alias("key"), raw.alias("raw"), F.when(F.col("p_partkey") % 2 == 0, "单位：万元").alias("said"))
    return T.chart_records(charts, "key", around="said").drop("row", "col")


@register("""WITH t AS (SELECT o_custkey AS doc, o_orderkey AS table_id, CAST(month(o_orderdate) AS INT) AS page FROM orders),
n AS (SELECT t.doc, t.table_id, substr(string_agg('[' || c.page || '] ' || c.table_id, chr(10) ORDER BY c.page, c.table_id), 1, 40) AS near FROM t JOIN t c ON t.doc = c.doc AND c.page BETWEEN t.page - 1 AND t.page + 1 GROUP BY 1, 2)
SELECT doc, table_id, 'm' || table_id || chr(10) || 'page ' || page || chr(10) || near AS context FROM n JOIN t USING (doc, table_id)""")
def nearby_pages(spark, d):
    """What is read around a table: its markdown, its page, and the chunks of the pages beside it, so many characters of them."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("table_id"), F.month("o_orderdate").alias("page"))
    tables = o.select("doc", "table_id", F.concat(F.lit("m"), F.col("table_id").cast("string")).alias("markdown"), F.lit("").alias("caption"), *[F.lit(None).cast("string").alias(c) for c in ("section_title", "section_name", "report_section")], F.array("page").alias("member_pages"))
    pages = o.select("doc", "page").distinct().withColumn("text", F.concat(F.lit("page "), F.col("page").cast("string")))
    chunks = o.select("doc", "page", F.col("table_id").alias("chunk"), F.lit("").alias("section_title"), F.concat(F.lit("["), F.col("page").cast("string"), F.lit("] "), F.col("table_id").cast("string")).alias("text"))
    return T.table_context(tables, pages, chunks, "doc", 40).select("doc", "table_id", "context")


NUMBER = r"""CASE WHEN regexp_matches(p, '^\s*[(\-]|[(\-]\s*\d') AND CAST(nullif(regexp_extract(p, '-?\d+(?:\.\d+)?'), '') AS DOUBLE) > 0 THEN -1 ELSE 1 END * CAST(nullif(regexp_extract(p, '-?\d+(?:\.\d+)?'), '') AS DOUBLE)"""


@register(rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([0-9])[,，]([0-9])', '\1\2', 'g'), '([0-9])[,，]([0-9])', '\1\2', 'g') AS p FROM documents),
v AS (SELECT doc_id, p, {NUMBER} AS v FROM t)
SELECT doc_id, v AS value, v * CASE WHEN regexp_matches(p, '%|百分点') THEN 1.0 WHEN doc_id % 4 = 0 THEN 1e4 WHEN doc_id % 4 = 1 OR doc_id % 12 = 3 THEN 1e8 WHEN doc_id % 12 = 7 THEN 1e8 WHEN doc_id % 12 = 11 THEN 1e4 ELSE 1.0 END AS in_yuan FROM v""")
def numeric_parse_units(spark, d):
    """The first number of every text, by itself and with a unit, or two, that a table would give."""
    hint = F.expr("CASE doc_id % 4 WHEN 0 THEN '人民币 万元' WHEN 1 THEN '亿港元' WHEN 2 THEN '%' ELSE CASE doc_id % 12 WHEN 3 THEN '万元 亿元' WHEN 7 THEN '百万元 亿港元' ELSE '亿元 万元人民币' END END")
    return table(spark, d, "documents").select("doc_id", X.parse_numeric(F.col("text")).alias("value"), X.parse_numeric(F.col("text"), hint).alias("in_yuan"))


@register("""WITH a AS (SELECT c_mktsegment AS seg, count(DISTINCT CASE WHEN n_name LIKE '%A' AND c_acctbal > 9900 THEN c_custkey END) AS strict, count(DISTINCT CASE WHEN c_acctbal > 9000 THEN c_custkey END) AS relaxed
 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT seg, CASE WHEN strict > 0 THEN strict WHEN relaxed > 0 THEN relaxed ELSE 0 END AS answer, CASE WHEN strict > 0 THEN 'strict' WHEN relaxed > 0 THEN 'relaxed' ELSE 'none' END AS attempt FROM a""")
def metadata_count(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("c_mktsegment", "seg")
    return A.count_with_fallback(rows, ["seg"], "c_custkey", {"strict": F.col("n_name").like("%A") & (F.col("c_acctbal") > 9900), "relaxed": F.col("c_acctbal") > 9000})


@register("""WITH q AS (SELECT DISTINCT lower(c_mktsegment) AS label FROM customer), m AS (SELECT label AS question_id, c_custkey AS doc, c_name AS company FROM q JOIN customer ON lower(c_mktsegment) = label
 UNION SELECT label, c_custkey, c_name FROM q JOIN customer ON c_custkey % 11 = 3 AND contains('big ' || lower(c_mktsegment), label))
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY CAST(doc AS VARCHAR), company) AS place, doc, company FROM m""")
def metadata_names(spark, d):
    """Names questions: companies whose tags, or label evidence, carry the question's label, one row each."""
    c = table(spark, d, "customer")
    questions = c.select(F.lower("c_mktsegment").alias("question_id")).distinct().withColumn("labels", F.array("question_id"))
    reports = c.select(F.col("c_custkey").alias("doc"), F.col("c_name").alias("company"), F.lit(None).cast("string").alias("code"), F.array("c_mktsegment").alias("tags"))
    evidence = c.where("c_custkey % 11 = 3").select(F.col("c_custkey").alias("doc"), F.concat(F.lit("big "), F.col("c_mktsegment")).alias("label"))
    return A.names_of(A.label_matches(questions, reports, evidence)).select("question_id", F.col("place").cast("long").alias("place"), "doc", "company")


@register("SELECT c_custkey, o_custkey IS NOT NULL AS member FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def metadata_membership(spark, d):
    m = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey").distinct()
    return table(spark, d, "customer").join(m, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("member"))


@register("""SELECT o_custkey AS question, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'high' WHEN bool_or(o_orderstatus IN ('F', 'O')) THEN 'medium' ELSE 'low' END AS confidence FROM orders GROUP BY 1""")
def confidence_from_parts(spark, d):
    c = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    return A.confidence_of_parts(table(spark, d, "orders").select(F.col("o_custkey").alias("question"), c.alias("confidence")), "question")


@register("""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'N/A' ELSE 'x' END AS answer, o_totalprice / 600000 AS best, o_totalprice / 600000 - (o_totalprice % 1000) / 5000 AS second, o_custkey % 4 AS pages, o_custkey % 3 AS cites,
 o_orderstatus = 'F' AS tab, o_orderpriority LIKE '1%' AS chart, o_orderkey % 5 = 0 AS flagged, o_orderkey % 17 = 0 AS none FROM orders)
SELECT o_orderkey, CASE WHEN answer = 'N/A' OR none THEN 'low' WHEN tab AND best >= 0.45 AND pages >= 1 AND NOT flagged THEN 'high' WHEN chart AND best >= 0.45 AND pages >= 1 AND NOT flagged THEN 'medium'
 WHEN best >= 0.8 AND best - second >= 0.08 AND pages >= 1 AND cites >= pages THEN 'high' WHEN best >= 0.45 AND pages >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM b""")
def answer_confidence(spark, d):
    c = F.col
    best = c("o_totalprice") / 600000
    scores = F.when(c("o_orderkey") % 17 != 0, F.array(best, best - (c("o_totalprice") % 1000) / 5000)).otherwise(F.array().cast("array<double>"))
    level = A.confidence(F.when(c("o_orderkey") % 13 == 0, "N/A").otherwise("x"), scores, c("o_custkey") % 4, c("o_custkey") % 3, c("o_orderstatus") == "F", c("o_orderpriority").like("1%"), F.when(c("o_orderkey") % 5 == 0, 1).otherwise(0))
    return table(spark, d, "orders").select("o_orderkey", level.alias("confidence"))


@register("SELECT l_orderkey, l_suppkey, max_by(l_quantity, CAST(round(l_linenumber * 1e9 + l_extendedprice * 100) AS BIGINT)) AS l_quantity, min(CAST(round(l_linenumber * 1e9 + l_extendedprice * 100) AS BIGINT)) AS place FROM lineitem GROUP BY 1, 2")
def citation_dedupe(spark, d):
    return A.dedupe_last(table(spark, d, "lineitem").withColumn("place", _place()), ["l_orderkey", "l_suppkey"], "place", "l_quantity")


@register("""WITH s AS (SELECT s_suppkey AS a, s_nationkey, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b FROM supplier)
SELECT a, b, CASE WHEN x.s_acctbal >= y.s_acctbal THEN x.s_name ELSE y.s_name END AS higher, x.s_acctbal > 5000 AS over FROM s JOIN supplier x ON a = x.s_suppkey JOIN supplier y ON b = y.s_suppkey""")
def structured_comparison(spark, d):
    s = table(spark, d, "supplier")
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    p = s.select(F.col("s_suppkey").alias("a"), F.lead("s_suppkey").over(w).alias("b"), F.col("s_name").alias("na"), F.col("s_acctbal").alias("va"), F.lead("s_name").over(w).alias("nb"), F.lead("s_acctbal").over(w).alias("vb")).where("b is not null")
    return p.select("a", "b", A.compare_values(F.col("va"), F.col("vb"), F.col("na"), F.col("nb")).alias("higher"), A.exceeds(F.col("va"), F.lit(5000)).alias("over"))


@register("""WITH f AS (SELECT l_orderkey AS q, list(l_partkey % 9 ORDER BY CAST(round(l_linenumber * 1e9 + l_extendedprice * 100) AS BIGINT)) AS r FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey AS q, list(l_suppkey % 9 ORDER BY CAST(round(l_linenumber * 1e9 + l_extendedprice * 100) AS BIGINT)) AS c FROM lineitem GROUP BY 1),
g AS (SELECT q, r, list_filter(c, lambda p: list_contains(r, p)) AS good FROM f JOIN c USING (q))
SELECT q, array_to_string(CASE WHEN len(good) < 1 THEN r[1:1] ELSE good[1:8] END, ',') AS pages FROM g""")
def page_repair(spark, d):
    """Claimed pages that were retrieved, repeats and all; the best retrieved one where none is."""
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(_place().alias("p"), (F.col(c) % 9).alias("v")))), lambda x: x["v"])
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(order("l_partkey").alias("r"), order("l_suppkey").alias("c"))
    return g.select("q", F.array_join(A.repair_pages(F.col("c"), F.col("r")).cast("array<string>"), ",").alias("pages"))


@register("""SELECT coalesce(lang, 'all') AS kind, count(*) AS n, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END), 4) AS long_rate, round(avg(CAST(quality AS DOUBLE)), 4) AS quality
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def answer_summary_rollup(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumnRenamed("lang", "kind")
    return E.summary_by_kind(rows, "kind", {"long_rate": F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.0), "quality": F.col("quality").cast("double")})


RANKED = """q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qv, label FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, v.vec_id, round(list_dot_product(qv, CAST(embedding AS DOUBLE[])) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 4) AS score FROM q, embeddings v WHERE v.vec_id <> qid),
r AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s),
g AS (SELECT qid, v.vec_id FROM q JOIN embeddings v ON q.label = v.label AND v.vec_id <> qid)"""


def _ranked_gold(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), "label")
    return R.dense_topk(q, v, 10), q, v


@register(f"""WITH {RANKED}, h AS (SELECT r.qid, count(*) AS hits FROM r JOIN g ON r.qid = g.qid AND r.vec_id = g.vec_id WHERE rank <= 10 GROUP BY 1),
n AS (SELECT qid, count(*) AS gold FROM g GROUP BY 1)
SELECT n.qid, round(coalesce(hits, 0) / gold, 4) AS recall, round(coalesce(hits, 0) / 10, 4) AS precision, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit FROM n LEFT JOIN h USING (qid)""")
def recall_precision_at_k(spark, d):
    """A question's gold is every other vector of its label: it is counted by label, never listed."""
    found, hits, gold = _hits(spark, d)
    out = gold.join(hits, "qid", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.where("gold > 0").select("qid", F.round(F.col("hits") / F.col("gold"), 4).alias("recall"), F.round(F.col("hits") / 10, 4).alias("precision"), F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"))


def _hits(spark, d):
    found, q, v = _ranked_gold(spark, d)
    near = found.select("qid", "vec_id").join(v.select("vec_id", F.col("label").alias("l")), "vec_id").join(q.select("qid", "label"), "qid")
    hits = near.where("l = label").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    gold = q.select("qid", "label").join(v.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").select("qid", (F.col("n") - 1).alias("gold"))
    return found, hits, gold


@register(f"""WITH {RANKED} SELECT count(*) AS gold, count(r.vec_id) AS hits, round(count(r.vec_id) / count(*), 4) AS micro_recall
FROM g LEFT JOIN (SELECT * FROM r WHERE rank <= 10) r ON r.qid = g.qid AND r.vec_id = g.vec_id""")
def micro_recall_levels(spark, d):
    found, hits, gold = _hits(spark, d)
    total = gold.join(hits, "qid", "left").agg(F.sum("gold").alias("gold"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    return total.select("gold", "hits", E.ratio(F.col("hits"), F.col("gold")).alias("micro_recall"))


PAIRS = r"dealt AS (SELECT doc_id, text, doc_id % n AS item_id FROM documents, (SELECT count(*) AS n FROM benchmark)), p AS (SELECT doc_id, item_id, dealt.text AS a, b.text AS b FROM dealt JOIN benchmark b USING (item_id))"
WORDS = r"list_filter(regexp_split_to_array(trim(regexp_replace(lower({}), '[\s\x1c-\x1f]+', ' ', 'g')), '[\s,;|/]+'), lambda t: t <> '')"


def _pairs(spark, d):
    """Every document with an item, every item with documents: items are dealt out by number."""
    b = table(spark, d, "benchmark")
    n = b.count()
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("a")).join(b.select("item_id", F.col("text").alias("b")), F.col("doc_id") % n == F.col("item_id"))


@register(rf"""WITH {PAIRS}, l AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({WORDS.format('a')}) AS t FROM p) GROUP BY 1, 2),
r AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({WORDS.format('b')}) AS t FROM p) GROUP BY 1, 2),
s AS (SELECT doc_id, sum(least(l.n, r.n)) AS same FROM l JOIN r USING (doc_id, t) GROUP BY 1),
z AS (SELECT doc_id, len({WORDS.format('a')}) + len({WORDS.format('b')}) AS n FROM p)
SELECT doc_id, round(CASE WHEN n > 0 THEN 2 * coalesce(same, 0) / n ELSE 1.0 END, 4) AS f1 FROM z LEFT JOIN s USING (doc_id)""")
def token_f1(spark, d):
    """Answers of any length against short ones: both sides' tokens are sorted lists, compared within the row."""
    rows = _pairs(spark, d).select("doc_id", E.token_list(F.col("a")).alias("x"), E.token_list(F.col("b")).alias("y"))
    return rows.select("doc_id", E.multiset_f1(F.col("x"), F.col("y")).alias("f1"))


#: Distinct neighbours in a list of characters; a lone character stands for itself.
GRAMS = "list_distinct(CASE WHEN len({0}) > 1 THEN list_transform(range(1, len({0})), lambda i: {0}[i] || {0}[i + 1]) ELSE list_filter({0}, lambda t: t <> '') END)"
FREE = r"regexp_replace(trim(regexp_replace(lower({}), '[\s\x1c-\x1f]+', ' ', 'g')), '[^\p{{L}}\p{{M}}\p{{N}}_]+', '', 'g')"


@register(rf"""WITH {PAIRS}, f AS (SELECT doc_id, {FREE.format('a')} AS a, {FREE.format('b')} AS b FROM p),
h AS (SELECT doc_id, string_split(a, '') AS a, string_split(b, '') AS b FROM f),
x AS (SELECT doc_id, {GRAMS.format('a')} AS x, {GRAMS.format('b')} AS y FROM h),
c AS (SELECT doc_id, len(x) AS nx, len(y) AS ny, len(list_intersect(x, y)) AS nb FROM x)
SELECT doc_id, round(CASE WHEN nx + ny > nb THEN nb / (nx + ny - nb) ELSE 0.0 END, 4) AS jaccard, round(CASE WHEN least(nx, ny) > 0 THEN nb / least(nx, ny) ELSE 0.0 END, 4) AS containment FROM c""")
def ngram_jaccard(spark, d):
    """Character bigrams of whole texts without signs: one linear pass a text, sets compared within the row."""
    rows = _pairs(spark, d).select("doc_id", E.free_text(F.col("a")).alias("a"), E.free_text(F.col("b")).alias("b"))
    rows = rows.select("doc_id", F.array_distinct(X.char_ngrams(F.col("a"), 2)).alias("x"), F.array_distinct(X.char_ngrams(F.col("b"), 2)).alias("y"))
    return rows.select("doc_id", F.round(X.jaccard(F.col("x"), F.col("y")), 4).alias("jaccard"), F.round(X.containment(F.col("x"), F.col("y")), 4).alias("containment"))


@register()
def sequence_similarity(spark, d):
    """Ratcliff-Obershelp ratios of whole documents and items; no SQL form, a test compares it with the library's."""
    return _pairs(spark, d).select("doc_id", E.sequence_similarity(F.col("a"), F.col("b")).alias("ratio"))


@register(rf"""WITH {PAIRS}, k AS (SELECT doc_id, regexp_replace(lower(a), '\s+', '', 'g') AS a, list_distinct(list_concat([lower(regexp_replace(substr(b, 1, 9), '\s+', '', 'g')), CAST(2000 + item_id % 30 AS VARCHAR), '万元'], CASE item_id % 2 WHEN 0 THEN ['cny', '人民币', 'rmb'] ELSE ['usd', '美元'] END)) AS kw FROM p)
SELECT doc_id, round(len(list_filter(list_filter(kw, lambda w: length(w) > 1), lambda w: contains(a, w))) / len(list_filter(kw, lambda w: length(w) > 1)), 4) AS coverage FROM k""")
def keyword_coverage(spark, d):
    """Keywords built from what an item is about (name, year, unit, currency and its other names), sought in whole texts."""
    none = F.lit(None).cast("string")
    kw = E.expected_keywords(F.substring("b", 1, 9), none, (2000 + F.col("item_id") % 30).cast("string"), none, none, F.lit("万元"), none, F.when(F.col("item_id") % 2 == 0, "CNY").otherwise("USD"))
    rows = _pairs(spark, d).select("doc_id", E.joined_text(F.col("a")).alias("a"), kw.alias("kw"))
    return rows.select("doc_id", E.coverage(F.col("a"), F.col("kw")).alias("coverage"))


@register("""SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN abs(a.p_retailprice - b.p_retailprice) <= greatest(1e-9 * greatest(abs(a.p_retailprice), abs(b.p_retailprice)), 1e-9) THEN 1.0 ELSE round(greatest(0.0, 1 - abs(a.p_retailprice - b.p_retailprice) / greatest(abs(b.p_retailprice), 1.0)), 4) END AS similarity
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def numeric_similarity(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b"), F.col("p_retailprice").alias("v"))
    return p.join(q, "p_partkey").select(F.col("p_partkey").alias("a"), "b", X.numeric_similarity(F.col("p_retailprice"), F.col("v")).alias("similarity"))


@register("""WITH j AS (SELECT doc_id, CAST(quality AS DOUBLE) AS q, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(1 - toxic AS DOUBLE) END AS t, CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.5 END AS l FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, round((coalesce(q * 0.5, 0) + coalesce(t * 0.3, 0) + l * 0.2) / (CASE WHEN q IS NULL THEN 0.0 ELSE 0.5 END + CASE WHEN t IS NULL THEN 0.0 ELSE 0.3 END + 0.2), 4) AS score FROM j""")
def weighted_score_null_skip(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    parts = {"q": (F.col("quality").cast("double"), 0.5), "t": (F.when(F.col("doc_id") % 3 != 0, (1 - F.col("toxic")).cast("double")), 0.3), "l": (F.when(F.col("n_chars") > 1000, 1.0).otherwise(0.5), 0.2)}
    return rows.select("doc_id", E.weighted_score(parts).alias("score"))


@register("""SELECT event_type, count(value) AS n, round(min(value), 4) AS least, round(max(value), 4) AS most, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0.0), 4) AS stdev,
 round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1""")
def latency_percentiles(spark, d):
    return E.latency_summary(table(spark, d, "events"), ["event_type"], "value")


@register("""WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'routing' WHEN 1 THEN 'parse' ELSE 'generation' END WHEN event_id % 7 = 0 THEN 'validation' WHEN event_id % 5 = 0 OR user_id % 4 = 0 THEN 'retrieval' WHEN lower(trim(event_type)) <> 'view' THEN 'generation' ELSE 'correct' END AS stage FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY event_id) AS k FROM s)
SELECT stage, count(*) AS n, string_agg(CASE WHEN k <= 3 AND stage <> 'correct' THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id) AS examples FROM f GROUP BY 1""")
def error_stage_counts(spark, d):
    """Where cases went wrong, by the classifier's rules, with first examples."""
    c = F.col
    error = F.when(c("event_type") == "error", F.element_at(F.array(F.lit("No Company name found"), F.lit("could not parse the PDF"), F.lit("timeout")), (c("event_id") % 3 + 1).cast("int")))
    stage = E.error_stage(error, F.when(c("event_id") % 7 == 0, F.array(F.lit("currency_mismatch"))), F.when(c("event_id") % 5 == 0, 0).otherwise(2), c("user_id") % 4, c("event_type"), F.lit(" View"))
    return E.error_stages(table(spark, d, "events"), stage, "event_id")


@register("""WITH s AS (SELECT unnest(['all', 'lang/' || lang, 'source/' || source]) AS stratum FROM documents) SELECT stratum, count(*) AS n FROM s WHERE stratum IS NOT NULL GROUP BY 1""")
def strata_histogram(spark, d):
    return E.strata(table(spark, d, "documents"), lang=F.col("lang"), source=F.col("source"))


@register("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'answer_only' WHEN l.doc_id IS NULL THEN 'question_only' ELSE 'both' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT doc_id FROM labels UNION SELECT -1 - doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id""")
def dataset_alignment(spark, d):
    known = table(spark, d, "labels")
    extra = known.select("doc_id").unionByName(known.where("toxic = 1").select((-1 - F.col("doc_id")).alias("doc_id")))
    return E.alignment(table(spark, d, "documents"), extra, "doc_id")


@register("""WITH n AS (SELECT item_id, substr(text, 5, 14) AS name, substr(text, 2, 4) AS code FROM benchmark),
h AS (SELECT item_id FROM n JOIN documents d ON contains(d.text, n.name) OR contains(d.text, n.code) GROUP BY 1)
SELECT item_id FROM n WHERE item_id NOT IN (SELECT item_id FROM h)""".replace("substr(text, 2, 4) AS code", "CASE WHEN item_id % 2 = 0 THEN substr(text, 3, 9) ELSE '' END AS code").replace("contains(d.text, n.code)", "(n.code <> '' AND contains(d.text, n.code))"))
def holdout_anti_join(spark, d):
    """Items neither whose name nor whose code any document holds, inside words too."""
    names = table(spark, d, "benchmark").select("item_id", F.substring("text", 5, 14).alias("name"), F.when(F.col("item_id") % 2 == 0, F.substring("text", 3, 9)).alias("code"))
    return K.holdout(names, table(spark, d, "documents"), "item_id", ["name", "code"]).select("item_id")


@register("""WITH h AS (SELECT doc_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(sha1('v1::' || doc_id), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT))), lambda s, x: (s * 16 + x) % 1000000) AS h FROM documents)
SELECT doc_id, CASE WHEN h < 100000 THEN 'test' WHEN h < 200000 THEN 'dev' ELSE 'train' END AS split FROM h""")
def hash_split(spark, d):
    return table(spark, d, "documents").select("doc_id", K.split(F.col("doc_id").cast("string"), "v1").alias("split"))


@register("""WITH r AS (SELECT lang AS grp, source, doc_id FROM documents),
h AS (SELECT *, sha256('mix' || doc_id) AS h FROM r) SELECT grp, doc_id, pick FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY h) AS pick FROM h) WHERE pick <= 20""")
def stratified_mix(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("grp"), "doc_id")
    return K.mix(rows, "grp", "doc_id", 20).select("grp", "doc_id", F.col("pick").cast("long").alias("pick"))


@register("""WITH t AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents) SELECT lang, doc_id, turn, row_number() OVER (ORDER BY turn, lang) AS place FROM t""")
def round_robin(spark, d):
    out = K.round_robin(table(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id")
    return out.select("lang", "doc_id", F.col("turn").cast("long").alias("turn"), F.col("place").cast("long").alias("place"))


@register("""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
t AS (SELECT *, ((i - o_custkey % n) % n + n) % n AS turn FROM n) SELECT o_custkey, o_orderkey, CAST(turn AS BIGINT) AS turn FROM t WHERE turn < 3""")
def rotated_take(spark, d):
    out = K.rotated_take(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", F.col("o_custkey"), 3)
    return out.select("o_custkey", "o_orderkey", F.col("turn").cast("long").alias("turn"))


@register("""WITH g AS (SELECT s_nationkey % 5 AS region, s_nationkey, s_suppkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
a AS (SELECT i // 2 AS pair, min(s_suppkey) AS first, max(s_suppkey) AS second, 0 AS level FROM g WHERE NOT (n % 2 = 1 AND i = n - 1) GROUP BY region, s_nationkey, i // 2),
l AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY s_suppkey) - 1 AS j, count(*) OVER (PARTITION BY region) AS m FROM g WHERE n % 2 = 1 AND i = n - 1)
SELECT first, second, level FROM a UNION ALL SELECT min(s_suppkey), max(s_suppkey), 1 FROM l WHERE NOT (m % 2 = 1 AND j = m - 1) GROUP BY region, j // 2""")
def pair_reports(spark, d):
    """Neighbours within a nation, then those left over within a coarser group."""
    s = table(spark, d, "supplier").withColumn("region", F.col("s_nationkey") % 5)
    return K.pair_up(s, ["region", "s_nationkey"], ["s_suppkey"], "s_suppkey", ["region"]).select("first", "second", "level")


LABELLED = """c AS (SELECT l_orderkey AS q, l_suppkey % 4 AS doc, l_linenumber AS page, l_extendedprice / 100000 AS score, CAST(l_partkey % 6 AS INT) AS rnk, CAST(round(l_linenumber * 1e9 + l_extendedprice * 100) AS BIGINT) AS cand FROM lineitem),
e AS (SELECT o_orderkey AS q, o_custkey % 4 AS doc, CAST(1 + o_custkey % 7 AS INT) AS page, CASE o_orderkey % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'citation' ELSE 'grounding' END AS kind FROM orders),
f AS (SELECT c.*, e.kind, e.doc = c.doc AND e.page = c.page AS hit, e.kind <> 'citation' AND e.doc = c.doc AND abs(e.page - c.page) <= 1 AS near, e.doc = c.doc AND e.kind <> 'citation' OR c.doc = 0 AS own FROM c LEFT JOIN e USING (q)),
g AS (SELECT q, cand, score, rnk, coalesce(hit, false) AS two, coalesce(hit AND kind <> 'citation', false) AS ans, coalesce(hit AND kind = 'citation', false) AS cit, coalesce(hit AND kind = 'grounding', false) AS gr, coalesce(near, false) AND NOT coalesce(hit, false) AS one, coalesce(own, doc = 0) AS own, doc FROM f),
lb AS (SELECT q, cand, CASE WHEN two THEN 2 WHEN one OR (score >= 0.85 AND rnk <= 3) OR score >= 0.55 THEN 1 ELSE 0 END AS label,
 concat_ws(',', CASE WHEN ans THEN 'answer_relevant_page' END, CASE WHEN cit THEN 'citation_hit' END, CASE WHEN gr THEN 'table_grounding_hit' END, CASE WHEN one THEN 'answer_neighbor_page' END,
  CASE WHEN NOT two AND ((score >= 0.85 AND rnk <= 3) OR (NOT one AND score >= 0.55)) THEN 'teacher_reranker' END, CASE WHEN NOT two AND NOT one AND score < 0.55 AND own THEN 'hard_negative_same_report' END, CASE WHEN NOT two AND NOT one AND score < 0.55 THEN 'teacher_reranker_low' END) AS sources FROM g)"""


def _labelled(spark, d):
    c = F.col
    cand = table(spark, d, "lineitem").select(c("l_orderkey").alias("query_id"), (c("l_suppkey") % 4).alias("doc"), c("l_linenumber").alias("page"), (c("l_extendedprice") / 100000).alias("teacher_score"), (c("l_partkey") % 6).cast("int").alias("teacher_rank"), F.lit("number").alias("schema"), _place().alias("cand"))
    kind = F.when(c("o_orderkey") % 3 == 0, "answer").when(c("o_orderkey") % 3 == 1, "citation").otherwise("grounding")
    evidence = table(spark, d, "orders").select(c("o_orderkey").alias("query_id"), kind.alias("kind"), (c("o_custkey") % 4).alias("doc"), (1 + c("o_custkey") % 7).cast("int").alias("page"))
    about = cand.select("query_id").distinct().withColumn("doc", F.lit(0).cast("long"))
    return L.hard_labels(cand, evidence, about).select(c("query_id").alias("q"), "cand", "label", F.array_join("label_source", ",").alias("sources"))


@register(f"WITH {LABELLED} SELECT q, cand, label, sources FROM lb")
def hard_labels(spark, d):
    """Candidates labelled by evidence, pages beside it, and the teacher."""
    return _labelled(spark, d)


@register(f"""WITH {LABELLED}, good AS (SELECT q FROM lb GROUP BY q HAVING sum(CASE WHEN label = 2 THEN 1 ELSE 0 END) >= 1 AND sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) >= 3)
SELECT q, cand, label FROM lb JOIN good USING (q)""")
def quality_gate(spark, d):
    return K.quality_gate(_labelled(spark, d), "q").select("q", "cand", "label")


@register("SELECT l_orderkey AS q, l_linenumber AS cand, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS teacher_rank FROM lineitem")
def teacher_rank(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("cand"), "l_extendedprice", "l_partkey")
    return R.ranked(li, ["q"], F.col("l_extendedprice").desc(), F.col("cand"), F.col("l_partkey"), name="teacher_rank").select("q", "cand", F.col("teacher_rank").cast("long").alias("teacher_rank"))


@register("""SELECT conv_id, count(*) AS n_messages, length(string_agg('{"role":"' || role || '","content":"' || replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"}', ',' ORDER BY turn)) + 2 AS chars FROM conversations GROUP BY 1""".replace("\\\\", "\\"))
def chat_records(spark, d):
    out = K.chat_record(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return out.select("conv_id", F.col("n_messages").cast("long").alias("n_messages"), F.length("messages").cast("long").alias("chars"))


@register("""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN n_chars > 20000 THEN 'long' END AS reason FROM documents""")
def acceptance_gates(spark, d):
    rows = table(spark, d, "documents")
    return K.accept(rows, empty=F.coalesce(F.trim("text") == "", F.lit(True)), short=F.col("n_chars") < 200, long=F.col("n_chars") > 20000).select("doc_id", "reason")


@register("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM c)
SELECT source, lang, n, round(n / total, 4) AS share FROM t WHERE k = 1""")
def dominant_share(spark, d):
    return K.dominant_share(table(spark, d, "documents"), ["source"], "lang").select("source", "lang", F.col("n").cast("long").alias("n"), "share")


@register("""WITH r AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer), o AS (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS last FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(nullif(trim(last), ''), c_mktsegment) AS segment FROM r LEFT JOIN o ON c_custkey = o_custkey""")
def manifest_merge(spark, d):
    o = M.last_wins(table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("segment"), "o_orderkey"), "doc_id", "o_orderkey").drop("o_orderkey")
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("segment"))
    return M.merge_meta(m, o).select(F.col("doc_id").alias("c_custkey"), "segment")


@register("SELECT l_partkey AS part, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def manifest_conflicts(spark, d):
    return M.conflicts(table(spark, d, "lineitem").withColumnRenamed("l_partkey", "part"), "part", "l_returnflag")


@register("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 0.0 FROM orders WHERE o_orderkey % 3 = 0""")
def upsert_latest(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return M.upsert(o, o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"])


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def resume_pending(spark, d):
    done = table(spark, d, "labels").select(F.col("doc_id").alias("question_id"), (F.col("toxic") == 1).alias("error"))
    return M.resume(table(spark, d, "documents").select(F.col("doc_id").alias("question_id")), done).select(F.col("question_id").alias("doc_id"))


@register()
def html_text(spark, d):
    """Title and text of raw pages; an HTML parser is beyond SQL."""
    return T.html_text(table(spark, d, "pages").select("page_id", "html"))


@register("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return S.tumbling(table(spark, d, "events")).select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@register("""WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') AS b FROM events), s AS (SELECT b AS start FROM w UNION ALL SELECT b - INTERVAL 30 MINUTE FROM w)
SELECT CAST(start AS VARCHAR) AS start, count(*) AS n FROM s GROUP BY 1""")
def events_sliding(spark, d):
    return S.sliding(table(spark, d, "events")).select(F.col("start").cast("string").alias("start"), "n")


@register("""WITH l AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k""")
def events_session(spark, d):
    return S.sessions(table(spark, d, "events")).select("user_id", F.col("start").cast("string").alias("start"), "n", F.round("total", 2).alias("total"))


@register("SELECT doc_id, regexp_matches(text, '[一-鿿]') AS cjk, length(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')) AS chars FROM documents".replace("\\\\", "\\"))
def text_normal_forms(spark, d):
    return table(spark, d, "documents").select("doc_id", X.contains_cjk(F.col("text")).alias("cjk"), F.length(X.compact_text(F.col("text"))).cast("long").alias("chars"))


@register(r"""WITH t AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '(' || c_acctbal || ')' WHEN 1 THEN c_acctbal || ' 万元' WHEN 2 THEN c_acctbal || '%' WHEN 3 THEN '2024年' WHEN 4 THEN c_name ELSE '1,234.5，' END AS raw FROM customer)
SELECT c_custkey, c_custkey % 6 IN (0, 1) AS plain, c_custkey % 6 IN (0, 1, 2) AS percent FROM t""".replace("c_custkey % 6 IN (0, 1) AS plain", r"regexp_matches(raw, '^\s*\(?\s*[-+]?\d[\d,，]*(?:\.\d+)?\s*\)?\s*(?:元|万元)?\s*$') AND NOT contains(raw, '年') AS plain").replace("c_custkey % 6 IN (0, 1, 2) AS percent", r"regexp_matches(raw, '^\s*\(?\s*[-+]?\d[\d,，]*(?:\.\d+)?\s*\)?\s*(?:%|元|万元)?\s*$') AND NOT contains(raw, '年') AS percent"))
def numeric_cell_predicate(spark, d):
    raw = F.expr("CASE c_custkey % 6 WHEN 0 THEN '(' || c_acctbal || ')' WHEN 1 THEN c_acctbal || ' 万元' WHEN 2 THEN c_acctbal || '%' WHEN 3 THEN '2024年' WHEN 4 THEN c_name ELSE '1,234.5，' END")
    return table(spark, d, "customer").select("c_custkey", P.is_numeric_cell(raw).alias("plain"), P.is_numeric_cell(raw, F.lit("占比%")).alias("percent"))
