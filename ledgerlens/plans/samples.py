"""Queries: answers and their checks, evaluation, and training samples, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import curate as K
from ..operators import evaluate as E
from ..operators import external as Y
from ..operators import filters as P
from ..operators import fusion as U
from ..operators import retrieval as R
from ..operators import routing as G
from ..operators import sft as L
from ..operators import templates as Q
from ..functions import text as X
from ..sources import manifests as M
from ._tables import table

QUERIES, SQL = {}, {}
c = F.col


def register(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _place():
    return F.round(c("l_linenumber") * 1e9 + c("l_extendedprice") * 100).cast("long")


PLACE = "CAST(round(l_linenumber * 1e9 + l_extendedprice * 100) AS BIGINT)"


@register("""WITH s AS (SELECT l_orderkey AS q, list_distinct(list(CASE WHEN l_discount > 0.02 THEN CASE l_returnflag WHEN 'A' THEN 'CNY' ELSE 'USD' END END)) AS cur, list_distinct(list(2020 + l_linenumber % 4)) AS ys, list_distinct(list(CASE WHEN l_tax > 0.03 THEN l_linestatus END)) AS kinds FROM lineitem GROUP BY 1),
a AS (SELECT o_orderkey AS q, o_custkey % 7 = 0 AS no_cite, o_custkey % 11 = 0 AS no_page, o_orderkey % 3 = 0 AS num, o_orderkey % 9 = 0 AS tab, o_custkey % 5 = 0 AS valueless, o_orderkey % 13 = 0 AS na, CASE o_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS conf, s.*  FROM orders LEFT JOIN s ON s.q = o_orderkey),
f AS (SELECT o_orderkey, list_filter([CASE WHEN no_cite AND NOT na THEN 'missing_citations' END, CASE WHEN no_page AND NOT na THEN 'missing_relevant_pages' END, CASE WHEN len(list_filter(cur, lambda x: x IS NOT NULL)) > 0 AND NOT list_contains(cur, 'CNY') THEN 'currency_mismatch' END,
  CASE WHEN ys IS NOT NULL AND NOT list_contains(ys, 2021) THEN 'report_year_mismatch' END, CASE WHEN len(list_filter(kinds, lambda x: x IS NOT NULL)) > 0 AND NOT list_contains(kinds, 'F') THEN 'doc_source_type_mismatch' END, CASE WHEN num AND NOT na AND tab AND valueless THEN 'numeric_grounding_missing_value' END,
  CASE WHEN num AND NOT na AND NOT tab AND no_cite THEN 'numeric_answer_without_structured_grounding' END, CASE WHEN ys IS NULL THEN 'no_retrieval_results' END], lambda x: x IS NOT NULL) AS flags, na, conf FROM (SELECT o_orderkey, a.* FROM a JOIN orders ON a.q_1 = o_orderkey))
SELECT o_orderkey, array_to_string(flags, ',') AS flags, CASE WHEN na OR len(list_intersect(flags, ['currency_mismatch', 'report_year_mismatch', 'numeric_grounding_missing_value', 'no_retrieval_results'])) > 0 THEN 'low' ELSE CASE greatest(0, CASE conf WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END - len(flags)) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END END AS confidence,
 CASE WHEN na OR len(list_intersect(flags, ['currency_mismatch', 'report_year_mismatch', 'numeric_grounding_missing_value'])) > 0 THEN 'N/A' ELSE 'x' END AS final_answer FROM f""".replace("a AS (SELECT o_orderkey AS q,", "a AS (SELECT o_orderkey AS q_1,").replace("s.*  FROM orders", "s.cur, s.ys, s.kinds FROM orders"))
def answer_validation(spark, d):
    """All checks of an answer against what its results say of themselves, and what failing costs."""
    none, o = F.lit(None), table(spark, d, "orders")
    na, cite = c("o_orderkey") % 13 == 0, F.when(c("o_custkey") % 7 == 0, 0).otherwise(2)
    answers = o.select(
        c("o_orderkey").alias("question_id"), F.lit("q").alias("question"), F.when(na, "N/A").otherwise("x").alias("final_answer"), F.when(c("o_custkey") % 3 == 0, "High").when(c("o_custkey") % 3 == 1, "medium").otherwise("odd").alias("confidence"),
        F.when(c("o_custkey") % 11 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("relevant_pages"), cite.alias("n_citations"), F.when(cite > 0, F.array(F.lit("table"))).alias("citation_types"), (c("o_orderkey") % 3 == 0).alias("numeric"),
        F.lit("CNY").alias("f_currency"), F.lit(2021).alias("f_year"), F.lit("F").alias("f_doc_source_type"), none.cast("string").alias("f_period"), none.cast("array<string>").alias("f_topics"), (c("o_orderkey") % 9 == 0).alias("has_table"), F.when(c("o_custkey") % 5 != 0, 1.0).alias("table_value"),
        none.cast("string").alias("table_period"), none.cast("string").alias("table_unit"), F.lit(False).alias("has_chart"), none.cast("double").alias("chart_value"), none.cast("string").alias("chart_period"), none.cast("string").alias("chart_unit"), none.cast("double").alias("chart_confidence"),
    )
    results = table(spark, d, "lineitem").select(c("l_orderkey").alias("question_id"), F.when(c("l_discount") > 0.02, F.when(c("l_returnflag") == "A", "CNY").otherwise("USD")).alias("currency"), (2020 + c("l_linenumber") % 4).alias("report_year"), F.when(c("l_tax") > 0.03, c("l_linestatus")).otherwise("").alias("doc_source_type"), none.cast("string").alias("period"), none.cast("array<string>").alias("topic_flags"))
    out = A.validate(answers, results)
    return out.select(c("question_id").alias("o_orderkey"), F.array_join("validation_flags", ",").alias("flags"), "confidence", "final_answer")


@register(f"""WITH r AS (SELECT l_orderkey AS q, l_suppkey % 5 AS doc, l_linenumber AS page, {PLACE} AS rank, 'found' AS source, 0 AS part FROM lineitem), g AS (SELECT o_orderkey AS q, o_custkey % 5 AS doc, CAST(3 AS INT) AS page FROM orders),
n AS (SELECT q, doc, page, 0 AS rank, 'grounding' AS source, -1 AS part FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.q = g.q AND r.doc = g.doc AND r.page = g.page)),
s AS (SELECT o_orderkey AS q, (o_custkey + 1) % 5 AS doc, CAST(4 AS INT) AS page, 1 AS rank, 'support' AS source, 1 AS part FROM orders), m AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.q = s.q AND r.doc = s.doc AND r.page = s.page))
SELECT q, doc, page, source, row_number() OVER (PARTITION BY q ORDER BY part, rank, doc, page) AS rank FROM (SELECT * FROM r UNION ALL SELECT * FROM n UNION ALL SELECT * FROM m)""")
def grounding_injection(spark, d):
    """Grounded pages that were not retrieved come first, support pages last."""
    rows = table(spark, d, "lineitem").select(c("l_orderkey").alias("q"), (c("l_suppkey") % 5).alias("doc"), c("l_linenumber").alias("page"), _place().alias("rank"), F.lit("found").alias("source"))
    o = table(spark, d, "orders")
    out = A.inject_missing(rows, o.select(c("o_orderkey").alias("q"), (c("o_custkey") % 5).alias("doc"), F.lit(3).alias("page")), "q", ["doc", "page"], o.select(c("o_orderkey").alias("q"), ((c("o_custkey") + 1) % 5).alias("doc"), F.lit(4).alias("page"), F.lit(1).alias("rank")))
    return out.select("q", "doc", "page", "source", c("rank").cast("long").alias("rank"))


@register(f"""WITH r AS (SELECT l_orderkey AS q, l_suppkey % 5 AS doc, l_linenumber AS page, min({PLACE}) AS first FROM lineitem WHERE l_linenumber IN (2, 3) GROUP BY 1, 2, 3) SELECT q, doc, page, row_number() OVER (PARTITION BY q ORDER BY first, doc, page) AS place FROM r""")
def answer_references(spark, d):
    li = table(spark, d, "lineitem").select(c("l_orderkey").alias("q"), (c("l_suppkey") % 5).alias("doc"), c("l_linenumber").alias("page"), _place().alias("rank"))
    pages = li.select("q").distinct().select("q", F.explode(F.array(F.lit(2), F.lit(3))).alias("page"))
    return A.references(pages, li, "q").select("q", "doc", "page", c("place").cast("long").alias("place"))


@register("""WITH r AS (SELECT o_custkey AS company, o_orderkey AS doc, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE year(o_orderdate) END AS y FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY y DESC NULLS LAST, doc DESC) AS k FROM r) WHERE k = 1)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 's' || c_custkey WHEN c_custkey % 3 = 1 THEN 'only' ELSE CAST(doc AS VARCHAR) END AS doc FROM customer LEFT JOIN n ON company = c_custkey""")
def document_selection(spark, d):
    """The selected report, else the sole candidate, else the company's newest."""
    reports = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(c("o_custkey").alias("company"), c("o_orderkey").alias("doc"), F.when(c("o_orderkey") % 4 != 0, F.year("o_orderdate")).alias("report_year"), F.lit(None).cast("string").alias("doc_source_type"))
    rows = table(spark, d, "customer").join(A.newest_report(reports, "company"), c("company") == c("c_custkey"), "left")
    chosen = A.selected_document(F.when(c("c_custkey") % 3 == 0, F.concat(F.lit("s"), c("c_custkey").cast("string"))).otherwise(""), F.when(c("c_custkey") % 3 == 1, F.array(F.lit("only"))).otherwise(F.array(F.lit("a"), F.lit("b"))), c("doc"))
    return rows.select("c_custkey", chosen.alias("doc"))


@register("""SELECT o_custkey AS report, coalesce(min(CASE WHEN o_orderkey % 9 BETWEEN 1 AND 3 THEN o_orderkey % 9 END), 2) AS page FROM orders GROUP BY 1""")
def label_citation_page(spark, d):
    g = table(spark, d, "orders").groupBy(c("o_custkey").alias("report")).agg(F.collect_list(c("o_orderkey") % 9).alias("p"))
    return g.select("report", A.citation_page(c("p")).cast("long").alias("page"))


@register("""WITH p AS (SELECT o_custkey AS doc, CAST(o_orderkey % 30 AS INT) AS page, CASE o_orderkey % 5 WHEN 0 THEN '拟 现金分红' WHEN 1 THEN '利润分配预案 派发现金红利' ELSE o_orderstatus END AS t FROM orders), s AS (SELECT doc, page, min(t) AS t FROM p GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN contains(t, '现金分红') THEN '现金分红' WHEN contains(t, '现金红利') THEN '现金红利' END AS term, 50.0 + CASE WHEN page <= 5 THEN 20.0 ELSE 0.0 END + CASE WHEN contains(t, '利润分配') THEN 10.0 ELSE 0.0 END AS score FROM s)
SELECT doc, page, term, score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, page) AS k FROM x WHERE term IS NOT NULL) WHERE k = 1""")
def dividend_mention(spark, d):
    text = F.when(c("o_orderkey") % 5 == 0, "拟 现金分红").when(c("o_orderkey") % 5 == 1, "利润分配预案 派发现金红利").otherwise(c("o_orderstatus"))
    pages = table(spark, d, "orders").groupBy(c("o_custkey").alias("doc"), (c("o_orderkey") % 30).cast("int").alias("page")).agg(F.min(text).alias("text"))
    return A.dividend_mention(pages).select("doc", "page", "term", "score")


@register("""WITH p AS (SELECT o_custkey AS doc, CAST(o_orderkey % 40 AS INT) AS page, min(CASE o_orderkey % 6 WHEN 0 THEN 'x' || chr(10) || '公司法定代表人：张三先生，男' WHEN 1 THEN '李四 法定代表人' WHEN 2 THEN '公司负责人 王五' WHEN 3 THEN '原法定代表人：赵六' ELSE '公司简介' END) AS t FROM orders GROUP BY 1, 2),
x AS (SELECT doc, page, CASE WHEN contains(t, '张三') THEN '张三' WHEN contains(t, '李四') THEN '李四' WHEN contains(t, '王五') THEN '王五' END AS name, CASE WHEN contains(t, '张三') THEN 100.0 WHEN contains(t, '李四') THEN 84.0 ELSE 62.0 END + CASE WHEN page <= 20 THEN 18.0 ELSE 0.0 END AS score FROM p)
SELECT doc, name, page, score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, page) AS k FROM x WHERE name IS NOT NULL) WHERE k = 1""")
def legal_representative(spark, d):
    k = c("o_orderkey") % 6
    text = F.when(k == 0, "x\n公司法定代表人：张三先生，男").when(k == 1, "李四 法定代表人").when(k == 2, "公司负责人 王五").when(k == 3, "原法定代表人：赵六").otherwise("公司简介")
    pages = table(spark, d, "orders").groupBy(c("o_custkey").alias("doc"), (c("o_orderkey") % 40).cast("int").alias("page")).agg(F.min(text).alias("text"))
    return A.legal_representative(pages).select("doc", "name", "page", "score")


SAID = """CASE event_id % 6 WHEN 0 THEN '{"final_answer": "' || event_type || '", "relevant_pages": [3, ' || user_id || ', 3]}' WHEN 1 THEN 'The final answer is ' || user_id || '.5 on page 7' WHEN 2 THEN '"answer": true and pages 4, 5' WHEN 3 THEN '故返回 N/A' WHEN 4 THEN '{"answer": 1} no, {"answer": ' || event_id || '} 第 9 页' ELSE 'nothing' END"""


@register("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN user_id || '.5' WHEN 2 THEN 'true' WHEN 3 THEN 'N/A' WHEN 4 THEN event_id || '.0' END AS value,
 CASE event_id % 6 WHEN 0 THEN CASE WHEN user_id IN (0, 3) THEN '3' ELSE '3,' || user_id END WHEN 1 THEN '7' WHEN 2 THEN '4,5' WHEN 4 THEN '9' ELSE '' END AS pages FROM events""")
def text_answers(spark, d):
    """Answers and pages read out of free text, by the question's kind."""
    kind = F.element_at(F.array(*map(F.lit, ("name", "number", "boolean", "name", "number", "number"))), (c("event_id") % 6 + 1).cast("int"))
    out = A.structured_answer(F.expr(SAID), kind)
    return table(spark, d, "events").select("event_id", out["value"].alias("value"), F.array_join(out["pages"].cast("array<string>"), ",").alias("pages"))


@register("""WITH m AS (SELECT l_returnflag AS kind, l_linestatus AS confidence, CAST(l_partkey % 5 AS VARCHAR) AS v, CAST(o_custkey % 5 AS VARCHAR) AS g, [l_linenumber, CAST(l_suppkey % 7 AS INT)] AS p, CASE WHEN l_tax > 0.06 THEN [] ELSE [CAST(o_custkey % 7 AS INT), 3] END AS gp FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
x AS (SELECT kind, confidence, CASE WHEN v = g THEN 1.0 ELSE 0.0 END AS e, CASE WHEN len(list_intersect(p, gp)) > 0 THEN 1.0 ELSE 0.0 END AS h, len(list_intersect(p, gp)) / len(list_distinct(p)) AS pr FROM m)
SELECT CASE WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(confidence) = 0 THEN 'confidence' ELSE 'all' END AS part, coalesce(kind, confidence, 'all') AS name, count(*) AS total, round(avg(e), 4) AS exact_match, round(avg(h), 4) AS reference_page_hit, round(avg(pr), 4) AS reference_page_precision FROM x GROUP BY GROUPING SETS ((), (kind), (confidence))""")
def answer_accuracy(spark, d):
    """Predictions against the last gold row of their question: match, page hits, precision, by kind and confidence."""
    o = table(spark, d, "orders")
    gold = o.select(c("o_orderkey").alias("key"), (c("o_custkey") % 5).cast("string").alias("value"), (c("o_custkey") % 7).cast("int").alias("p"), F.lit(2).alias("pos")).unionByName(o.select(c("o_orderkey").alias("key"), F.lit("early").alias("value"), F.lit(0).alias("p"), F.lit(1).alias("pos")))
    pred = table(spark, d, "lineitem").select(c("l_orderkey").alias("key"), c("l_returnflag").alias("kind"), c("l_linestatus").alias("confidence"), (c("l_partkey") % 5).cast("string").alias("value"), F.array(c("l_linenumber"), (c("l_suppkey") % 7).cast("int")).alias("pages"), F.array().cast("array<int>").alias("citation_pages"), F.array().cast("array<int>").alias("retrieval_pages"), "l_tax")
    m = E.matched_gold(pred, gold, "key", "pos")
    m = m.withColumn("gold_pages", F.when(c("l_tax") > 0.06, F.array().cast("array<int>")).otherwise(F.array("gold_p", F.lit(3))))
    return E.accuracy(m).select("part", "name", "total", "exact_match", "reference_page_hit", "reference_page_precision")


@register(f"""WITH q AS (SELECT l_orderkey AS q, list(l_linenumber ORDER BY {PLACE} DESC) AS r FROM lineitem GROUP BY 1), d AS (SELECT q, list_filter(r, lambda x, i: list_position(r, x) = i) AS r FROM q), g AS (SELECT o_orderkey AS q, CASE WHEN o_custkey % 6 = 0 THEN [] ELSE [CAST(1 + o_custkey % 7 AS INT), 2] END AS g FROM orders),
x AS (SELECT list_distinct(g) AS g, r FROM g LEFT JOIN d USING (q)), e AS (SELECT *, len(list_intersect(coalesce(r, [])[1:4], g)) AS a, len(list_intersect(coalesce(r, [])[1:2], g)) AS b FROM x)
SELECT count(*) AS matched_questions, count(*) FILTER (WHERE len(g) > 0) AS eligible_questions, count(*) FILTER (WHERE len(g) = 0) AS without_reference_pages, count(*) FILTER (WHERE len(g) > 0 AND r IS NULL) AS missing_details, count(*) FILTER (WHERE len(g) > 0 AND len(coalesce(r, [])) < 4) AS fewer_than_recall_k,
 round(avg(CASE WHEN len(g) > 0 THEN round(a / len(g), 4) END), 4) AS macro_recall, round(avg(CASE WHEN len(g) > 0 THEN round(b / 2, 4) END), 4) AS macro_precision, round(avg(CASE WHEN len(g) > 0 THEN CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END END), 4) AS hit FROM e""")
def ranked_retrieval_summary(spark, d):
    r = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("q")).agg(F.transform(F.sort_array(F.collect_list(F.struct(_place().alias("p"), "l_linenumber")), False), lambda x: x["l_linenumber"]).alias("ranked_pages"))
    gold = F.when(c("o_custkey") % 6 == 0, F.array().cast("array<int>")).otherwise(F.array((1 + c("o_custkey") % 7).cast("int"), F.lit(2)))
    rows = table(spark, d, "orders").select(c("o_orderkey").alias("q"), gold.alias("reference_pages")).join(r, "q", "left")
    return E.ranked_summary(rows, 4, 2).drop("no_ranked_pages", "fewer_than_precision_k")


@register("""WITH a AS (SELECT lang AS kind, CASE WHEN toxic = 1 THEN 'low' WHEN quality = 1 THEN 'high' ELSE 'unknown' END AS confidence, CASE WHEN doc_id % 5 = 0 THEN 'N/A' WHEN doc_id % 7 = 0 THEN NULL ELSE 'x' END AS value, doc_id % 3 AS nc, doc_id % 4 AS nr FROM documents LEFT JOIN labels USING (doc_id))
SELECT CASE WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(confidence) = 0 THEN 'confidence' ELSE 'all' END AS part, coalesce(kind, confidence, 'all') AS name, count(*) AS total, round(avg(CASE WHEN value IS NOT NULL AND value <> 'N/A' THEN 1.0 ELSE 0.0 END), 4) AS answer_rate, round(avg(CASE WHEN value = 'N/A' THEN 1.0 ELSE 0.0 END), 4) AS na_rate,
 round(avg(CASE WHEN nc > 0 THEN 1.0 ELSE 0.0 END), 4) AS citation_coverage, round(avg(nr), 4) AS avg_references FROM a GROUP BY GROUPING SETS ((), (kind), (confidence))""")
def answer_summary(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    value = F.when(c("doc_id") % 5 == 0, "N/A").when(c("doc_id") % 7 != 0, "x")
    return E.answer_summary(rows.select(c("lang").alias("kind"), F.when(c("toxic") == 1, "low").when(c("quality") == 1, "high").alias("confidence"), value.alias("value"), (c("doc_id") % 3).alias("n_citations"), (c("doc_id") % 4).alias("n_references")))


@register("""SELECT count(*) AS matched_predictions, round(avg(l_discount), 4) AS mean_entity_score, round(avg(CASE WHEN l_tax > 0.02 THEN l_quantity / 50 END), 4) AS mean_answer_score, round(avg(CASE WHEN l_tax > 0.02 THEN CASE WHEN l_quantity / 50 >= 0.8 THEN 1.0 ELSE 0.0 END END), 4) AS answer_score_pass_rate FROM lineitem""")
def finance_summary(spark, d):
    rows = table(spark, d, "lineitem").select(c("l_discount").alias("entity_score"), F.when(c("l_tax") > 0.02, c("l_quantity") / 50).alias("answer_score"))
    return E.finance_summary(rows, ["entity_score", "answer_score"], ("answer_score",))


@register("""SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE user_id % 5 = 0) AS not_available, count(*) - count(*) FILTER (WHERE event_type = 'error') - count(*) FILTER (WHERE user_id % 5 = 0) AS successes FROM events""")
def question_statistics(spark, d):
    rows = table(spark, d, "events").select(F.when(c("event_type") == "error", "failed").alias("error"), F.when(c("user_id") % 5 == 0, "N/A").otherwise("x").alias("value"))
    return E.question_statistics(rows)


@register("""WITH x AS (SELECT c_custkey, c_mktsegment, n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT c_custkey, contains('machinery co', lower(c_mktsegment)) OR contains(lower(c_mktsegment), 'machineryco') OR lower(c_mktsegment) = 'machinery' AS n, c_custkey % 2 = 0 AS code, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal > 0 END AS cur, c_custkey % 3 = 1 AS y FROM x)
SELECT c_custkey, round((CASE WHEN n THEN 0.2 ELSE 0.0 END + CASE WHEN code THEN 0.1 ELSE 0.0 END + CASE WHEN cur THEN 0.1 ELSE 0.0 END + CASE WHEN y THEN 0.15 ELSE 0.0 END) / (0.2 + 0.1 + 0.15 + CASE WHEN cur IS NULL THEN 0.0 ELSE 0.1 END), 4) AS score FROM m""")
def entity_scores(spark, d):
    """Fields of an answer's evidence against what is expected, weighted over those that are."""
    one = lambda x: F.array(x)
    observed = {"company_name": one(c("c_mktsegment")), "stock_code": one(F.when(c("c_custkey") % 2 == 0, "SZ 000123").otherwise("9")), "currency": one(F.when(c("c_acctbal") > 0, "人民币").otherwise("usd")), "report_year": one(2020 + c("c_custkey") % 3)}
    expected = {"company_name": F.lit("Machinery Co"), "stock_code": F.lit("000123"), "currency": F.when(c("c_custkey") % 5 != 0, "RMB"), "report_year": F.lit(2021)}
    return table(spark, d, "customer").select("c_custkey", E.entity_score(E.entity_matches(observed, expected)).alias("score"))


@register(f"""WITH g AS (SELECT DISTINCT l_orderkey AS q, CASE WHEN l_orderkey % 2 = 0 THEN 'table' ELSE 'page' END AS level, l_suppkey % 6 AS unit FROM lineitem UNION SELECT DISTINCT l_orderkey, 'doc', l_suppkey % 2 FROM lineitem),
f AS (SELECT q, level, unit FROM g WHERE level <> 'doc'), s AS (SELECT l_orderkey AS q, l_suppkey % 6 AS unit, bool_or(l_discount > 0.03) AS final, bool_or(l_tax > 0.03) AS top, bool_or(l_returnflag = 'A') AS bm, bool_or(l_returnflag = 'N') AS ve FROM lineitem GROUP BY 1, 2)
SELECT level, CASE WHEN NOT final THEN 'Not_recalled' WHEN NOT top THEN 'Reranker_rescue' WHEN bm AND ve THEN 'Both' WHEN bm THEN 'BM25_only' WHEN ve THEN 'Dense_only' ELSE 'Unknown' END AS attribution, count(*) AS n FROM f JOIN s USING (q, unit) GROUP BY 1, 2""")
def recall_attribution(spark, d):
    """What found each gold unit of the finest level that a question has."""
    li = table(spark, d, "lineitem").withColumn("level", F.when(c("l_orderkey") % 2 == 0, "table").otherwise("page"))
    gold = li.select(c("l_orderkey").alias("question_id"), "level", (c("l_suppkey") % 6).alias("unit")).unionByName(li.select(c("l_orderkey").alias("question_id"), F.lit("doc").alias("level"), (c("l_suppkey") % 2).alias("unit")))
    stages = F.array_compact(F.array(F.lit("candidate"), F.when(c("l_tax") > 0.03, "top"), F.when(c("l_discount") > 0.03, "final")))
    source = F.when(c("l_returnflag") == "A", F.array(F.lit("bm25"))).when(c("l_returnflag") == "N", F.array(F.lit("vector")))
    found = li.select(c("l_orderkey").alias("question_id"), "level", (c("l_suppkey") % 6).alias("unit"), F.explode(stages).alias("stage"), source.alias("sources"))
    return E.attribution(gold, found).groupBy("level", "attribution").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized_exact' WHEN 2 THEN 'alias_exact' WHEN 3 THEN 'mismatch' ELSE 'missing_value' END AS tier FROM customer""")
def name_tiers(spark, d):
    """Names that agree as they are, but for case, but for a company's ending, or not."""
    other = F.element_at(F.array(c("c_name"), F.upper("c_name"), F.concat("c_name", F.lit(" 股份有限公司")), F.lit("乙"), F.lit(" ")), (c("c_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", L.same_name(c("c_name"), other).alias("tier"))


@register("""WITH i AS (SELECT o_custkey AS q, CAST(month(o_orderdate) AS INT) AS page, o_orderkey % 4 AS k FROM orders), h AS (SELECT q, bool_or(k = 0) AS e, bool_or(k IN (0, 1)) AS a FROM i GROUP BY 1)
SELECT c_custkey AS q, CASE WHEN e THEN 'explicit_field_hit' WHEN a THEN 'answer_text_only' ELSE 'none' END AS support_type FROM customer LEFT JOIN h ON q = c_custkey""")
def name_support(spark, d):
    k = c("o_orderkey") % 4
    text = F.when(k == 0, "董事长：\n张 三 Co").when(k == 1, "张三co\n。\n董事长").when(k == 2, "董事长：李四").otherwise("x")
    items = table(spark, d, "orders").select(c("o_custkey").alias("q"), F.month("o_orderdate").alias("page"), text.alias("text"))
    answers = table(spark, d, "customer").select(c("c_custkey").alias("q"), F.lit("张三 co").alias("value"), F.array().cast("array<string>").alias("aliases"), F.array(F.lit("董事长")).alias("labels"))
    return L.name_support(items, answers, "q").select("q", "support_type")


@register("""WITH w(t, yes, no, words) AS (VALUES (0, '拟派发现金红利。', '现金分红：不进行现金分红', '利润分配预案'), (1, '公司拟回购社会公众股', '股份回购：未实施回购', '回购报告书'), (2, '出具了保留意见', '审计意见类型：标准无保留意见', '审计意见'), (3, '实际控制人发生变更', '控制权变更：控制权未发生变更', '控制权'), (4, '设有子公司', '无子公司', '-')),
h AS (SELECT o_custkey AS q, bool_or(o_orderkey % 5 = 0) AS yes, bool_or(o_orderkey % 5 = 1) AS no FROM orders GROUP BY 1)
SELECT c_custkey AS q, CASE WHEN yes AND no THEN CASE WHEN c_custkey % 5 IN (1, 2, 3) OR (c_custkey % 5 = 0 AND c_custkey % 2 = 0) THEN 'explicit_negative' ELSE 'conflict' END
 WHEN no THEN 'explicit_negative' WHEN yes THEN 'explicit_positive' ELSE 'insufficient_evidence' END AS classification FROM customer LEFT JOIN h ON q = c_custkey""")
def boolean_context(spark, d):
    """Questions about each known target and one that names its own; of the first target every other one speaks of its plan."""
    t = c("t")
    pick = lambda *said: F.element_at(F.array(*map(F.lit, said)), t + 1)
    orders = table(spark, d, "orders").withColumn("t", (c("o_custkey") % 5).cast("int"))
    yes = pick("拟派发现金红利。", "公司拟回购社会公众股", "出具了保留意见", "实际控制人发生变更", "设有子公司")
    no = F.concat(F.lit("x\n"), pick("现金分红：不进行现金分红", "股份回购：未实施回购", "审计意见类型：标准无保留意见", "控制权变更：控制权未发生变更", "无子公司"))
    k = c("o_orderkey") % 5
    items = orders.select(c("o_custkey").alias("q"), F.month("o_orderdate").alias("page"), F.when(k == 0, yes).when(k == 1, no).otherwise("其他").alias("text"))
    customers = table(spark, d, "customer").withColumn("t", (c("c_custkey") % 5).cast("int"))
    asked = pick("是否提到现金分红？", "是否披露股份回购？", "是否存在非标审计意见？", "是否有控制权变更？", "是否有子公司？")
    questions = customers.select(c("c_custkey").alias("q"), F.concat(F.when((t == 0) & (c("c_custkey") % 2 == 0), "利润分配预案").otherwise(""), asked).alias("question"))
    return L.boolean_context(items, questions, "q").select("q", "classification")


@register("""WITH i AS (SELECT o_custkey AS q, o_orderkey % 4 AS k FROM orders), h AS (SELECT q, bool_or(k = 0) AS e, bool_or(k IN (0, 1)) AS a FROM i GROUP BY 1),
r AS (SELECT c_custkey AS q, c_custkey % 12 AS m, c_custkey % 2 = 0 AS labelled, e, a FROM customer LEFT JOIN h ON q = c_custkey),
w AS (SELECT q, CASE WHEN m IN (0, 1) THEN 'name_query_not_single_doc' WHEN m = 2 THEN 'name_anchor_positive_but_refused' WHEN m IN (3, 4) THEN 'name_refusal_without_positive_anchor'
 WHEN m = 5 THEN 'name_final_answer_not_string' WHEN m IN (6, 7) THEN 'name_anchor_value_mismatch' WHEN e AND labelled THEN 'name_explicit_field_hit'
 WHEN a AND NOT labelled THEN 'name_answer_text_only' ELSE 'name_missing_explicit_grounding' END AS reason FROM r)
SELECT q, reason IN ('name_refusal_without_positive_anchor', 'name_explicit_field_hit', 'name_answer_text_only') AS accepted, reason FROM w""")
def name_verdicts(spark, d):
    """Name answers against their anchors, refusals included, and against what the evidence says."""
    k, m = c("o_orderkey") % 4, c("c_custkey") % 12
    text = F.when(k == 0, "董事长：\n张 三 Co").when(k == 1, "张三co\n。\n董事长").when(k == 2, "董事长：李四").otherwise("x")
    items = table(spark, d, "orders").select(c("o_custkey").alias("q"), F.month("o_orderdate").alias("page"), text.alias("text"))
    labels = F.when(c("c_custkey") % 2 == 0, F.array(F.lit("董事长"))).otherwise(F.array().cast("array<string>"))
    answer = F.when(m.isin(2, 3, 4), "N/A").when(m == 5, "  ").otherwise("张三 co")
    anchor = F.when(m == 2, "张三").when(m == 3, "N/A").when(m == 6, "李四").when(m == 8, "张 三 co")
    rows = table(spark, d, "customer").select(
        c("c_custkey").alias("q"), F.when(m == 0, "谁的董事长更高？").otherwise("董事长是谁？").alias("question"), F.when(m == 1, 2).otherwise(1).alias("n_docs"),
        answer.alias("final_answer"), labels.alias("labels"), m.isin(2, 3, 6, 7, 8).alias("has_anchor"), anchor.alias("anchor"), F.array().cast("array<string>").alias("aliases"),
    )
    support = L.name_support(items, rows.select("q", c("final_answer").alias("value"), "aliases", "labels"), "q")
    return L.name_verdict(rows, support, "q")


@register("""SELECT l_orderkey, place, CASE WHEN f = 'A' AND p % 7 = 0 THEN 'no_retrieval' WHEN l_linestatus = 'O' AND p % 5 = 0 THEN 'number_grounding_missing_normalized_value' WHEN l_linestatus = 'O' AND p % 5 = 1 THEN 'number_final_answer_grounding_mismatch' WHEN p % 11 = 0 THEN 'missing_relevant_pages' WHEN p % 13 = 0 THEN 'hallucinated_pages' WHEN l_tax > 0.07 THEN 'severe_validation_flags' END AS reason
FROM (SELECT l_orderkey, CAST(round(l_linenumber * 1e9 + l_extendedprice * 100) AS BIGINT) AS place, l_returnflag AS f, l_partkey AS p, l_linestatus, l_tax FROM lineitem)""")
def sample_gates(spark, d):
    """The first gate that a sample fails; numbers compare as decimals."""
    p, number = c("l_partkey"), c("l_linestatus") == "O"
    value = F.concat(c("l_linenumber").cast("string"), F.lit(",000"))
    grounded = F.when(number & (p % 5 == 0), None).when(number & (p % 5 == 1), "7.5").otherwise(F.concat(c("l_linenumber").cast("string"), F.lit("000.00")))
    pages = F.when(p % 11 == 0, F.array().cast("array<int>")).when(p % 13 == 0, F.array(F.lit(99))).otherwise(F.array(F.lit(1)))
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", _place().alias("place"), F.lit("q").alias("query_id"), F.lit("what").alias("question"), F.when(number, "number").otherwise("names").alias("schema"), F.lit("ctx").alias("context"), F.when((c("l_returnflag") == "A") & (p % 7 == 0), 0).otherwise(3).alias("n_results"),
        value.alias("final_answer"), grounded.alias("grounded_value"), pages.alias("relevant_pages"), F.array(F.lit(1), F.lit(2)).alias("retrieval_pages"), F.when(c("l_tax") > 0.07, F.array(F.lit("currency_mismatch"))).alias("flags"), F.lit("none").alias("name_support"), F.lit(None).cast("string").alias("boolean_class"),
    )
    return L.acceptance(rows).select("l_orderkey", "place", "reason")


@register(f"""WITH k AS (SELECT l_orderkey AS query_id, l_suppkey % 5 AS doc, l_linenumber AS page, l_partkey % 50 AS chunk, l_extendedprice AS s, l_orderkey % 5 AS pd FROM lineitem), u AS (SELECT DISTINCT query_id, doc, page, chunk FROM k WHERE chunk % 10 = 0),
a AS (SELECT k.* FROM k WHERE chunk % 10 <> 0), o AS (SELECT query_id, doc, page, chunk, max(s) AS s, pd FROM a GROUP BY 1, 2, 3, 4, 6), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN doc = pd THEN 0 ELSE 1 END, s DESC, doc, page, chunk) AS n FROM o), e AS (SELECT query_id FROM r GROUP BY 1 HAVING count(*) >= 2)
SELECT query_id, doc, page, chunk, n AS distractor_rank FROM r JOIN e USING (query_id) WHERE n <= 3""")
def distractors(spark, d):
    """The best candidates that are no support, those of the query's own document first."""
    k = table(spark, d, "lineitem").select(c("l_orderkey").alias("query_id"), (c("l_suppkey") % 5).alias("doc"), c("l_linenumber").alias("page"), (c("l_partkey") % 50).alias("chunk"), F.lit("t").alias("text"), c("l_extendedprice").alias("base_score"), F.lit(1).alias("hits"), (c("l_orderkey") % 5).alias("primary_doc"))
    out = L.distractors(k, k.where("chunk % 10 = 0"), 3, 2)
    return out.select("query_id", "doc", "page", "chunk", c("distractor_rank").cast("long").alias("distractor_rank"))


@register(f"""WITH k AS (SELECT l_orderkey AS query_id, l_linenumber AS page, l_partkey % 50 AS chunk, l_returnflag AS section, min({PLACE}) AS rank FROM lineitem WHERE l_suppkey % 3 = l_orderkey % 3 GROUP BY 1, 2, 3, 4), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, page, chunk ORDER BY rank) AS n FROM k) WHERE n = 1 AND chunk % 10 <> 0),
s AS (SELECT DISTINCT query_id, section FROM k WHERE chunk % 10 = 0)
SELECT f.query_id, page, chunk, source FROM f LEFT JOIN s ON s.query_id = f.query_id AND s.section = f.section, LATERAL (SELECT unnest(['support_replaced_high_similarity_non_support', CASE WHEN s.section IS NOT NULL THEN 'same_metric_wrong_page' ELSE 'same_company_wrong_section' END]) AS source)""")
def wrong_contexts(spark, d):
    """Candidates of the own document that are no support, by whether their section is one of the support's."""
    k = table(spark, d, "lineitem").select(c("l_orderkey").alias("query_id"), (c("l_suppkey") % 3).alias("doc"), c("l_linenumber").alias("page"), (c("l_partkey") % 50).alias("chunk"), F.lit("t").alias("text"), c("l_returnflag").alias("section"), (c("l_orderkey") % 3).alias("primary_doc"), _place().alias("rank"))
    return L.wrong_contexts(k, k.where("chunk % 10 = 0 and doc = primary_doc")).select("query_id", "page", "chunk", "source")


@register("""WITH r AS (SELECT o_orderkey AS doc, o_custkey AS company, year(o_orderdate) AS y, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderstatus END AS kind FROM orders), q AS (SELECT c_custkey AS q, c_custkey AS company, 1995 + c_custkey % 3 AS y, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'F' END AS kind FROM customer)
SELECT q, doc, place FROM (SELECT q, r.doc, row_number() OVER (PARTITION BY q ORDER BY r.doc) AS place FROM q JOIN r ON r.y = q.y AND r.company <> q.company AND (q.kind = '' OR r.kind = '' OR r.kind = q.kind)) WHERE place <= 4""")
def other_companies(spark, d):
    """Reports of the same year of other companies, the first few of each query."""
    reports = table(spark, d, "orders").select(c("o_orderkey").alias("doc"), c("o_custkey").alias("company"), F.year("o_orderdate").alias("year"), F.when(c("o_orderkey") % 6 == 0, "").otherwise(c("o_orderstatus")).alias("kind"))
    queries = table(spark, d, "customer").select(c("c_custkey").alias("q"), F.lit(-1).cast("long").alias("doc"), c("c_custkey").alias("company"), (1995 + c("c_custkey") % 3).cast("int").alias("year"), F.when(c("c_custkey") % 4 == 0, "").otherwise("F").alias("kind"))
    return L.other_companies(queries, reports, 4, "q").select("q", "doc", c("place").cast("long").alias("place"))


@register("""SELECT o_custkey AS key, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS splits, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1""")
def split_overlap(spark, d):
    return K.overlap_of_splits(table(spark, d, "orders").withColumnRenamed("o_custkey", "key"), "o_orderstatus", "key")


@register(f"""WITH k AS (SELECT l_orderkey AS q, CASE l_suppkey % 4 WHEN 0 THEN 'same_company_wrong_section' WHEN 1 THEN 'same_metric_wrong_page' WHEN 2 THEN 'support_replaced_high_similarity_non_support' ELSE 'same_year_wrong_company' END AS source, l_suppkey % 4 AS o, l_partkey % 20 AS item, min({PLACE}) AS rank FROM lineitem GROUP BY 1, 2, 3, 4),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, item ORDER BY o, rank) AS n FROM k) WHERE n = 1), p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o, rank, item) AS place FROM f), l AS (SELECT q, min(o) AS last FROM (SELECT q, o, max(place) AS m FROM p GROUP BY 1, 2) WHERE m >= 2 GROUP BY 1)
SELECT q, source, item, place FROM p JOIN l USING (q) WHERE o <= last AND place <= 3""")
def composed_contexts(spark, d):
    """Wrong contexts from their primary source and, while that has too little, from those that stand in for it."""
    names = ("same_company_wrong_section", "same_metric_wrong_page", "support_replaced_high_similarity_non_support", "same_year_wrong_company")
    k = table(spark, d, "lineitem").select(c("l_orderkey").alias("q"), F.element_at(F.array(*map(F.lit, names)), (c("l_suppkey") % 4 + 1).cast("int")).alias("source"), (c("l_partkey") % 20).alias("item"), _place().alias("rank"))
    k = k.groupBy("q", "source", "item").agg(F.min("rank").alias("rank"))
    out = L.compose_sources(k, k.select("q").distinct().withColumn("primary_source", F.lit(names[0])), 2, 3, "q")
    return out.select("q", "source", "item", c("place").cast("long").alias("place"))


@register(f"""WITH r AS (SELECT l_orderkey AS q, l_linenumber AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY {PLACE}) AS rank, l_partkey % 9 AS v FROM lineitem), a AS (SELECT q, 3 AS p, 4 AS v FROM (SELECT DISTINCT q FROM r)),
x AS (SELECT 'top1_truncation' AS variant, r.* FROM r WHERE rank <= 1 UNION ALL SELECT 'top2_truncation', r.* FROM r WHERE rank <= 2 UNION ALL SELECT 'key_page_removed', q, page, rank, v FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) AS n FROM r WHERE page <> 3) WHERE n <= 3
 UNION ALL SELECT 'table_support_truncated', q, page, rank, CASE WHEN page = 3 THEN -1 ELSE v END FROM r WHERE rank <= 3)
SELECT q, variant, CASE WHEN bool_or(v = 4) THEN 'number_anchor_value_still_present' WHEN bool_or(page = 3) THEN 'number_anchor_pages_still_present' END AS reason, count(*) AS n FROM x GROUP BY 1, 2""")
def truncated_refusals(spark, d):
    """Variants of a context without what answers the question, and why some may still be answered."""
    r = R.ranked(table(spark, d, "lineitem").select(c("l_orderkey").alias("q"), c("l_linenumber").alias("page"), _place().alias("p"), (c("l_partkey") % 9).alias("v")), ["q"], c("p"))
    r = r.select("q", "rank", "page", F.lit("d").alias("doc"), F.concat(F.lit("keep\nvalue <"), c("v").cast("string"), F.lit(">")).alias("text"))
    a = r.select("q").distinct().select("q", F.array(F.lit(3)).alias("pages"), F.lit("<4>").alias("value"), F.lit("value").alias("table_id"))
    v = L.truncation_variants(r, a, 3, "q")
    return L.refusal_check(v, a, "q").join(v.groupBy("q", "variant").agg(F.count(F.lit(1)).alias("n")), ["q", "variant"])


@register(f"""WITH o AS (SELECT l_orderkey AS query_id, l_suppkey % 4 AS doc, l_linenumber AS page, CASE WHEN l_partkey % 6 = 0 THEN 10000 ELSE l_partkey % 6 END AS tr, l_extendedprice AS ts, {PLACE} AS cand FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc, page ORDER BY tr, ts DESC, CAST(cand AS VARCHAR)) AS k FROM o) SELECT query_id, cand, evidence_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tr, ts DESC, CAST(cand AS VARCHAR)) AS evidence_rank FROM f WHERE k = 1) WHERE evidence_rank <= 2""")
def positive_evidence(spark, d):
    rows = table(spark, d, "lineitem").select(c("l_orderkey").alias("query_id"), (c("l_suppkey") % 4).alias("doc"), c("l_linenumber").alias("page"), F.when(c("l_partkey") % 6 != 0, c("l_partkey") % 6).alias("teacher_rank"), c("l_extendedprice").alias("teacher_score"), _place().alias("candidate_id"))
    return L.positive_evidence(rows).select("query_id", c("candidate_id").alias("cand"), c("evidence_rank").cast("long").alias("evidence_rank"))


@register("""WITH r AS (SELECT DISTINCT s_suppkey AS doc, 2000 + s_nationkey % 2 AS year, CAST(s_nationkey % 3 AS VARCHAR) AS industry, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'b' || s_suppkey % 2 END AS board, unnest(['x', 'y' || s_suppkey % 3]) AS tag FROM supplier),
w AS (SELECT year, industry, tag, count(*) AS n FROM r GROUP BY 1, 2, 3), b AS (SELECT year, industry, tag, board, count(*) AS n FROM r WHERE board IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT year, industry, tag, NULL AS board, n, (SELECT md5(string_agg(doc, ',' ORDER BY doc)) FROM r WHERE r.year = w.year AND r.industry = w.industry AND r.tag = w.tag) AS docs FROM w WHERE n BETWEEN 3 AND 12
UNION ALL SELECT b.year, b.industry, b.tag, b.board, b.n, (SELECT md5(string_agg(doc, ',' ORDER BY doc)) FROM r WHERE r.year = b.year AND r.industry = b.industry AND r.tag = b.tag AND r.board = b.board) FROM b JOIN w USING (year, industry, tag) WHERE w.n > 12 AND b.n BETWEEN 3 AND 12""")
def bucket_entries(spark, d):
    """Buckets of documents by year, industry and tag, and by board where those are too large."""
    rows = table(spark, d, "supplier").select(c("s_suppkey").alias("doc"), (2000 + c("s_nationkey") % 2).cast("int").alias("year"), (c("s_nationkey") % 3).cast("string").alias("industry"), F.when(c("s_suppkey") % 7 != 0, F.concat(F.lit("b"), (c("s_suppkey") % 2).cast("string"))).otherwise("").alias("board"), F.array(F.lit("x"), F.concat(F.lit("y"), (c("s_suppkey") % 3).cast("string"))).alias("tags"))
    out = K.bucket_entries(rows, 3, 12)
    return out.select("year", "industry", "tag", "board", c("n").cast("long").alias("n"), F.md5(F.array_join(c("docs").cast("array<string>"), ",")).alias("docs"))


@register("""WITH t AS (SELECT 'name' AS schema, p_brand AS v, count(*) AS n FROM part GROUP BY 2), m AS (SELECT *, sum(n) OVER () AS total, row_number() OVER (ORDER BY n DESC, v) AS k FROM (SELECT p_type AS v, count(*) AS n FROM part WHERE p_size < 20 GROUP BY 1))
SELECT 'question_text_dominance' AS warning_type, 'boolean' AS schema, v AS value, n, round(n / total, 4) AS share FROM m WHERE k = 1 AND n / total > 0.12""")
def catalog_imbalance(spark, d):
    """Kinds of questions in which one text, or one target, is too common."""
    p = table(spark, d, "part")
    rows = p.select(F.lit("name").alias("schema"), c("p_partkey").cast("string").alias("question_text"), c("p_brand").alias("target_key")).unionByName(p.where("p_size < 20").select(F.lit("boolean").alias("schema"), c("p_type").alias("question_text"), c("p_name").alias("target_key")))
    return K.imbalance_warnings(rows)


@register("""WITH s AS (SELECT DISTINCT o_custkey % 50 AS q, l_linenumber AS page, 3 * (CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) + CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END - CASE WHEN l_linenumber <= 5 THEN 1 ELSE 0 END AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 50 < 25),
b AS (SELECT q, page, max(score) AS score FROM s WHERE score > 0 GROUP BY 1, 2) SELECT q, page, place FROM (SELECT q, page, row_number() OVER (PARTITION BY q ORDER BY score DESC, page) AS place FROM b) WHERE place <= 4 UNION ALL SELECT range, 2, 1 FROM range(25, 30)""")
def page_picking(spark, d):
    """The pages that say most of a question's keywords."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c("o_orderkey") == c("l_orderkey"))
    chunks = li.select((c("o_custkey") % 50).alias("doc"), c("l_linenumber").alias("page"), F.concat(F.lit("<"), "l_returnflag", F.lit(">"), F.lit("("), "l_linestatus", F.lit(")")).alias("text"), (c("l_tax") > 0.04).alias("has_table"))
    asks = spark.range(30).select(c("id").alias("q"), F.when(c("id") < 25, c("id")).otherwise(-1).alias("doc"), F.array(F.lit("<A>"), F.lit("(F)")).alias("keywords"))
    return L.pick_pages(chunks, asks, "q").select("q", "page", c("place").cast("long").alias("place"))


@register("""WITH v AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT o_orderkey, ((cents + 50) // 100) / 1e4 AS wan, CAST(CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN greatest(1, cents // 10000000) * 10000000 >= cents THEN greatest(1, greatest(1, cents // 10000000) - 1) ELSE greatest(1, cents // 10000000) END ELSE CASE WHEN greatest(1, (cents + 9999999) // 10000000) * 10000000 <= cents THEN greatest(1, (cents + 9999999) // 10000000) + 1 ELSE greatest(1, (cents + 9999999) // 10000000) END END AS BIGINT) AS threshold,
 o_orderkey % 2 = 0 AS verdict, CASE WHEN o_custkey % 2 = 1 THEN CASE WHEN o_orderkey % 7 IN (1, 3, 5) THEN 'dev' ELSE 'test' END ELSE CASE WHEN o_orderkey % 7 IN (2, 4, 6) THEN 'dev' ELSE 'test' END END AS split FROM v JOIN orders USING (o_orderkey)""")
def question_variants(spark, d):
    """Questions about an amount in other units, and against thresholds whose verdict is known, with their split."""
    threshold, verdict = L.threshold_variant((c("o_totalprice") * 1000).cast("decimal(38,6)"), c("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", L.unit_variant(F.round(c("o_totalprice").cast("decimal(20,6)"), 2), "万元").alias("wan"), threshold.alias("threshold"), verdict.alias("verdict"), K.parity_split(c("o_custkey"), c("o_orderkey") % 7).alias("split"))


@register("""SELECT item_id, '2024年年报里' || substr(text, 1, 5) || CASE WHEN item_id % 3 = 0 THEN '是多少？' ELSE '有几家？' END AS question, '' AS more FROM benchmark""".replace("'' AS more", "CASE WHEN item_id % 3 = 0 THEN 0 ELSE 1 END AS kind"))
def surface_forms(spark, d):
    """Templates whose placeholders are known, rendered; with one renderable form the hash has no choice."""
    unit = F.when(c("item_id") % 3 == 0, F.substring("text", 1, 5))
    other = F.when(c("item_id") % 3 != 0, F.substring("text", 1, 5))
    form = K.surface_form(["{year}年年报里{metric}是多少？", "{year}年年报里{company}有几家？", "{year} {unknown}"], c("item_id").cast("string"), "v", year=F.lit(2024), metric=unit, company=other)
    return table(spark, d, "benchmark").select("item_id", form["text"].alias("question"), form["variant"].cast("int").alias("kind"))


@register("""WITH q AS (SELECT o_orderkey AS question_id, 'text ' || o_orderkey AS question_text FROM orders), a AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS a_id, 'text ' || o_orderkey AS a_text, o_orderstatus AS value FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT -c_custkey - 1, 'other', c_mktsegment FROM customer)
SELECT q.question_id, q.question_text, coalesce(i.value, t.value, 'N/A') AS value, CASE WHEN i.value IS NULL AND t.value IS NULL THEN 'missing' ELSE 'answered' END AS status FROM q LEFT JOIN a i ON i.a_id = q.question_id LEFT JOIN a t ON i.a_id IS NULL AND t.a_text = q.question_text AND t.a_text <> 'other'
UNION ALL SELECT -c_custkey - 1, 'other', c_mktsegment, 'unmatched' FROM customer""")
def bundle_export(spark, d):
    """One answer per question, by id or by text, "N/A" where there is none; what nobody asked for is listed."""
    o = table(spark, d, "orders").select(c("o_orderkey").alias("question_id"), F.concat(F.lit("text "), c("o_orderkey").cast("string")).alias("question_text"), c("o_orderstatus").alias("value"))
    extra = table(spark, d, "customer").select((-c("c_custkey") - 1).alias("question_id"), F.lit("other").alias("question_text"), c("c_mktsegment").alias("value"))
    answers = o.where("question_id % 5 <> 0").withColumn("question_id", F.when(c("question_id") % 3 != 0, c("question_id"))).unionByName(extra)
    return E.export_bundle(o.drop("value"), answers)


@register("""SELECT c_custkey AS q, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE c_mktsegment END AS board, CASE WHEN c_custkey % 3 = 0 THEN 2024 WHEN c_custkey % 2 = 0 THEN 2020 END AS year, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'a' END AS tags FROM customer""".replace("WHEN c_custkey % 2 = 0 THEN 2020 END", "ELSE 2020 END"))
def filter_overlay(spark, d):
    """Expected filters laid over a plan's: empty lists replace too, what is not expected stays."""
    cust = table(spark, d, "customer")
    plan = cust.select(c("c_custkey").alias("q"), c("c_mktsegment").alias("board"), F.lit(2020).alias("year"), F.array(F.lit("a")).alias("tags"))
    expected = cust.select(c("c_custkey").alias("q"), F.when(c("c_custkey") % 2 == 0, "x").alias("board"), F.when(c("c_custkey") % 3 == 0, 2024).alias("report_year"), F.when(c("c_custkey") % 4 == 0, F.array(F.lit(""))).alias("tags"))
    return L.overlay(plan, expected, "q").select("q", "board", "year", F.array_join("tags", ",").alias("tags"))


@register("""SELECT event_id, event_id % 4 = 0 AS count, event_id % 4 = 1 AS names, event_id % 4 = 2 AS membership, event_id % 4 = 3 AS dividend FROM events""")
def question_kinds(spark, d):
    k = (c("event_id") % 4 + 1).cast("int")
    text = F.element_at(F.array(*map(F.lit, ("提到出海的公司共有几家？", "哪些公司提到了出海？", "甲是否属于出海公司名单？", "年报是否提到现金分红？"))), k)
    schema = F.element_at(F.array(*map(F.lit, ("Number", "names", "boolean", "boolean"))), k)
    out = G.question_kinds(text, schema)
    return table(spark, d, "events").select("event_id", *[out[n].alias(n) for n in ("count", "names", "membership", "dividend")])


@register("""SELECT doc_id, source FROM documents WHERE lang IN ('en', 'fr') AND source NOT IN ('src1')""")
def mix_selection(spark, d):
    rows = table(spark, d, "documents")
    return rows.where(P.mix_select(rows, {"lang": ["en", "fr"]}, {"source": "src1"})).select("doc_id", "source")


@register("""WITH l AS (SELECT o_custkey AS q, 'vector' AS source, o_orderkey AS key, o_totalprice AS score FROM orders UNION ALL SELECT o_custkey, 'bm25', o_orderkey, o_totalprice / 2 FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT *, row_number() OVER (PARTITION BY q, source ORDER BY score DESC, key) AS rank FROM l WHERE q % 7 <> 0), n AS (SELECT q, count(DISTINCT source) AS n FROM r GROUP BY 1),
f AS (SELECT q, key, round(sum(1.0 / (60 + rank)), 6) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM r JOIN n USING (q) WHERE n > 1 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS rank FROM f)
SELECT q, key, score, sources, rank FROM k WHERE rank <= 5 UNION ALL SELECT q, key, score, source, rank FROM r JOIN n USING (q) WHERE n = 1 AND rank <= 5""")
def hybrid_retrieval(spark, d):
    """All backends fused; a question that one alone answered keeps its scores; blank questions have nothing."""
    o = table(spark, d, "orders")
    lists = o.select(c("o_custkey").alias("q"), F.lit("vector").alias("source"), c("o_orderkey").alias("key"), c("o_totalprice").alias("score")).unionByName(o.where("o_orderstatus = 'F'").select(c("o_custkey").alias("q"), F.lit("bm25").alias("source"), c("o_orderkey").alias("key"), (c("o_totalprice") / 2).alias("score")))
    asks = table(spark, d, "customer").select(c("c_custkey").alias("q"), F.when(c("c_custkey") % 7 != 0, c("c_name")).otherwise("  ").alias("text"))
    out = U.hybrid(R.ranked(lists, ["q", "source"], c("score").desc(), c("key")), ["q"], "key", asks, "text", 5)
    return out.select("q", "key", c("score").cast("double").alias("score"), "sources", c("rank").cast("long").alias("rank"))


@register("""SELECT * FROM (SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM (SELECT l_returnflag AS qid, l_partkey AS key, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2)) WHERE rank <= 24""")
def merge_without_rerank(spark, d):
    q = table(spark, d, "lineitem").groupBy(c("l_returnflag").alias("qid"), c("l_linestatus").alias("query_no"), c("l_partkey").alias("key")).agg(F.max("l_extendedprice").alias("score"))
    return U.merge_queries(q, ["qid"], "key", 24).select("qid", "key", "score", c("rank").cast("long").alias("rank"))


@register("""WITH s AS (SELECT l_suppkey % 20 AS qid, l_orderkey % 50 AS doc, l_partkey AS chunk, max(round(l_extendedprice, 2)) AS score FROM lineitem GROUP BY 1, 2, 3), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY score DESC, chunk) AS k FROM s) WHERE k <= 5)
SELECT qid, doc, chunk, rank FROM (SELECT qid, doc, chunk, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc, chunk) AS rank FROM d) WHERE rank <= 5""")
def per_document_top(spark, d):
    """The best of each document first, then the best of all."""
    s = table(spark, d, "lineitem").groupBy((c("l_suppkey") % 20).alias("qid"), (c("l_orderkey") % 50).alias("doc"), c("l_partkey").alias("chunk")).agg(F.max(F.round("l_extendedprice", 2)).alias("score"))
    return R.per_document_top(s, ["qid"], "doc", 5, c("chunk")).select("qid", "doc", "chunk", c("rank").cast("long").alias("rank"))


@register("""SELECT c_custkey AS qid, o_orderkey AS page, 0.5 AS score, row_number() OVER (PARTITION BY c_custkey ORDER BY o_custkey, o_orderkey) AS rank FROM customer JOIN orders ON o_custkey = c_custkey""".replace("0.5 AS score", "CAST(0.5 AS DOUBLE) AS score"))
def full_context_scan(spark, d):
    pages = table(spark, d, "orders").select(c("o_custkey").alias("doc"), c("o_orderkey").alias("page"))
    out = R.full_context(pages, table(spark, d, "customer").select(c("c_custkey").alias("qid"), c("c_custkey").alias("doc")))
    return out.select("qid", "page", "score", c("rank").cast("long").alias("rank"))


@register("""WITH s AS (SELECT p_brand AS q, p_partkey, p_retailprice / 3000 AS distance, CASE WHEN p_size % 6 = 0 THEN 0.0 ELSE length(p_name) / 20.0 END AS rel, p_name || ' ' || p_partkey AS text FROM part)
SELECT q, p_partkey, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, distance DESC, text) AS rank FROM (SELECT *, round(0.7 * rel + (1 - 0.7) * distance + 1e-9, 4) AS score FROM s)""")
def batched_rerank(spark, d):
    """An injected scorer, called in batches; batches that come back short are filled one by one, failures count as 0."""

    def score(texts):
        out = [None if t.split("\n\n")[0] == "bad" else len(t.split("\n\n")[1].rsplit(" ", 1)[0]) / 20.0 for t in texts]
        return out[:-1] if len(out) > 1 else out

    rows = table(spark, d, "part").select(c("p_brand").alias("q"), "p_partkey", F.when(c("p_size") % 6 == 0, "bad").otherwise("good").alias("query"), F.concat_ws(" ", "p_name", c("p_partkey").cast("string")).alias("text"), (c("p_retailprice") / 3000).alias("distance"))
    return Y.rerank(rows, ["q"], score).select("q", "p_partkey", "score", c("rank").cast("long").alias("rank"))


@register("""WITH q AS (SELECT o_orderkey AS question_id, o_orderpriority AS t, o_orderstatus AS k FROM orders), a AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS question_id, o_orderpriority AS t, o_orderstatus AS k, o_orderkey % 10 = 9 AS error FROM orders WHERE o_orderkey % 3 = 0),
d AS (SELECT * FROM a WHERE NOT error), l AS (SELECT q.*, row_number() OVER (PARTITION BY t, k ORDER BY question_id) AS n FROM q WHERE question_id NOT IN (SELECT question_id FROM d)), h AS (SELECT t, k, row_number() OVER (PARTITION BY t, k ORDER BY question_id) AS n FROM d WHERE question_id < 0)
SELECT l.question_id FROM l LEFT JOIN h ON h.t = l.t AND h.k = l.k AND h.n = l.n WHERE h.n IS NULL""")
def resume_by_text(spark, d):
    """Answers meet questions by id, else by text and kind, each question once."""
    o = table(spark, d, "orders").select(c("o_orderkey").alias("question_id"), c("o_orderpriority").alias("t"), c("o_orderstatus").alias("k"))
    done = o.where("question_id % 3 = 0").withColumn("error", c("question_id") % 10 == 9).withColumn("question_id", F.when(c("question_id") % 4 == 0, -c("question_id") - 1).otherwise(c("question_id")))
    return M.resume(o, done, "question_id", "t", "k").select("question_id")


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 100000 * 1e4 AS DOUBLE) WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey % 100000 * 1e8 AS DOUBLE) ELSE CAST(o_custkey % 100000 AS DOUBLE) END AS yuan, CASE o_orderkey % 3 WHEN 0 THEN '万元' WHEN 1 THEN '亿元' ELSE '元' END AS unit, CASE WHEN o_orderkey % 3 < 2 THEN NULL ELSE CAST(o_custkey % 100000 AS DOUBLE) END AS metric FROM orders""")
def threshold_questions(spark, d):
    """Thresholds and units that questions name; a number for metrics loses 元 before longer units, and then is none."""
    from ..operators import grounding as N

    unit = F.element_at(F.array(*map(F.lit, ("万元", "亿元", "元"))), (c("o_orderkey") % 3 + 1).cast("int"))
    amount = F.concat((c("o_custkey") % 100000).cast("string"), unit)
    question = F.concat(F.lit("营业收入是否超过 "), amount, F.lit("？"))
    return table(spark, d, "orders").select("o_orderkey", N.threshold_yuan(question).alias("yuan"), N.target_unit(question).alias("unit"), E.metric_number(amount).alias("metric"))


@register("""WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' sz300' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ' and 600519' WHEN 1 THEN '2023年度报告' WHEN 2 THEN '2024 q2 update' ELSE 'US$' END AS t FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 1000 = -1 THEN '' ELSE '300' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ',600519' END ELSE '' END AS codes, CASE c_custkey % 4 WHEN 1 THEN '2023年报' WHEN 2 THEN '2024Q2' END AS period, CASE WHEN c_custkey % 4 = 3 THEN 'USD' END AS currency FROM t""")
def token_extraction(spark, d):
    """Security codes, periods and currencies in texts."""
    t = F.expr("CASE c_custkey % 4 WHEN 0 THEN ' sz300' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || ' and 600519' WHEN 1 THEN '2023年度报告' WHEN 2 THEN '2024 q2 update' ELSE 'US$' END")
    rows = table(spark, d, "customer").select("c_custkey", t.alias("t"))
    return rows.select("c_custkey", F.array_join(X.security_codes(c("t")), ",").alias("codes"), X.period_token(c("t")).alias("period"), F.when(c("c_custkey") % 4 == 3, X.currency_token(c("t"))).alias("currency"))


#: A catalogue for the tables here: two templates of numbers, of which a report takes one, and one of pairs.
CATALOGUE = [
    dict(template_id=i, template_family="f", schema=schema, task_type="single_doc_fact", generation_mode=mode, target_key=target, surface_forms=forms, section_hints=hints, split_pool="train", answer_policy="cite", validator_target="v", max_per_doc=1, **more)
    for i, schema, mode, target, forms, hints, more in (
        ("n1", "number", "per_doc", "revenue", ["{company_name} revenue in {report_year}", "{company_name}, {section_name}: revenue"], ["Summary", "Income", "Notes"], {}),
        ("n2", "number", "per_doc", "basic_eps", ["{field_label} of {company_name}", "{missing} of {company_name}", "{report_year} {field_label}, {company_name}", "Tell the {field_label} of {company_name}"], [], {"field_label": "earnings"}),
        ("p1", "comparative", "per_pair", "revenue", ["{company_a} or {company_b}, {metric_label} in {year}?", "Whose {metric_label}: {company_a}, {company_b}?", "{year}: {company_b} against {company_a}"], [], {"metric_label": "revenue"}),
    )
]


def _choice_sql(key, n):
    digits = f"list_transform(string_split(sha1({key}), ''), lambda x: CAST(instr('0123456789abcdef', x) - 1 AS BIGINT))"
    return f"(list_reduce(list_prepend(CAST(0 AS BIGINT), {digits}), lambda s, x: (s * 16 + x) % 720720) % {n})"


@register(f"""WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS name, 2000 + c_custkey % 20 AS y FROM customer WHERE c_custkey % 20 <> 7),
h AS (SELECT *, {_choice_sql("'number:v1::' || k", 2)} AS start, {_choice_sql("'n1:surface::' || k", 2)} AS f1, {_choice_sql("'n1:section::' || k", 3)} AS s1, {_choice_sql("'n2:surface::' || k", 3)} AS f2 FROM r)
SELECT k AS doc_id, CASE start WHEN 0 THEN 'n1' ELSE 'n2' END AS template_id, CASE WHEN start = 0 THEN 'seed-v2-number-revenue-0' || f1 || '-' || k ELSE 'seed-v2-number-basic_eps-' || CASE f2 WHEN 0 THEN '00' WHEN 1 THEN '02' ELSE '03' END || '-' || k END AS query_id,
 CASE WHEN start = 0 THEN CASE f1 WHEN 0 THEN name || ' revenue in ' || y ELSE name || ', ' || ['Summary', 'Income', 'Notes'][s1 + 1] || ': revenue' END
  ELSE CASE f2 WHEN 0 THEN 'earnings of ' || name WHEN 1 THEN y || ' earnings, ' || name ELSE 'Tell the earnings of ' || name END END AS question_text,
 CASE WHEN start = 0 AND f1 = 1 THEN 'section_filter' ELSE 'single_doc_fact' END AS task_type, CASE WHEN start = 0 AND f1 = 1 THEN ['Summary', 'Income', 'Notes'][s1 + 1] END AS section_name FROM h""")
def seed_questions(spark, d):
    """A question for every report out of a catalogue that was looked over first; reports without a year have none."""
    assert not Q.catalog_faults(CATALOGUE, ["chairman"])
    k = c("c_custkey")
    reports = table(spark, d, "customer").select(k.cast("string").alias("doc_id"), c("c_name").alias("company_name"), F.when(k % 20 == 7, 0).otherwise(2000 + k % 20).alias("report_year"))
    return Q.per_document(reports, CATALOGUE, "v1").select("doc_id", "template_id", "query_id", "question_text", "task_type", "section_name")


@register(f"""WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS doc_a, CAST(c_custkey + 1 AS VARCHAR) AS doc_b, c_name AS na FROM customer WHERE c_custkey % 2 = 0), p AS (SELECT doc_a, doc_b, na, c_name AS nb FROM a JOIN customer ON doc_b = CAST(c_custkey AS VARCHAR)),
h AS (SELECT *, {_choice_sql("'p1:surface::{\"doc_ids\": [\"' || doc_a || '\", \"' || doc_b || '\"], \"template_id\": \"p1\"}'", 3)} AS f FROM p)
SELECT doc_a, doc_b, 'seed-v2-comparative-revenue-' || doc_a || '-' || doc_b AS query_id, CASE f WHEN 0 THEN na || ' or ' || nb || ', revenue in 2024?' WHEN 1 THEN 'Whose revenue: ' || na || ', ' || nb || '?' ELSE '2024: ' || nb || ' against ' || na END AS question_text, 'cross_doc_compare' AS task_type FROM h""")
def pair_questions(spark, d):
    """A comparing question for every pair of neighbours."""
    n = table(spark, d, "customer").select(c("c_custkey").alias("k"), c("c_name").alias("name"))
    a = n.where("k % 2 = 0").select(c("k").cast("string").alias("doc_a"), (c("k") + 1).alias("next"), c("name").alias("company_a"))
    pairs = a.join(n, c("next") == c("k")).select("doc_a", c("k").cast("string").alias("doc_b"), "company_a", c("name").alias("company_b"), F.lit(2024).alias("year"))
    return Q.per_pair(pairs, CATALOGUE).select("doc_a", "doc_b", "query_id", "question_text", "task_type")
