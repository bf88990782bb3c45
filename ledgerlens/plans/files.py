"""Queries through files and stores, and of operators that only others called: what is written comes back as it was."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
from ..operators import chunks as C
from ..operators import curate as K
from ..operators import filters as P
from ..operators import fusion as U
from ..operators import routing as G
from ..operators import sft as L
from ..operators import tables as T
from ..sources import manifests as M
from ..sources import metadata as B
from ..sources.store import new_path
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


@register("""SELECT 'c' || c_custkey AS doc_id, c_name AS company_name, 2000 + c_custkey % 25 AS report_year, CASE c_custkey % 3 WHEN 0 THEN 'annual_report' WHEN 1 THEN 'announcement' ELSE 'other' END AS doc_type,
 CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'zh' END AS language, c_name || CASE WHEN c_custkey % 4 = 0 THEN ',Alias ' || c_custkey ELSE '' END AS aliases FROM customer""")
def manifest_files(spark, d):
    """Customers as a manifest in CSV, found in its folder and read: canonical names, classes, languages, aliases."""
    k, home = c("c_custkey"), new_path(spark, "manifest")
    rows = table(spark, d, "customer").select(
        F.concat(F.lit(" c"), k).alias("doc_id"), c("c_name").alias("company_name"), (2000 + k % 25).alias("report_year"), F.when(k % 3 == 0, "Annual filing").when(k % 3 == 1, "公告 x").otherwise("memo").alias("doc_type"),
        F.when(k % 2 == 0, "English").otherwise("zh-CN").alias("language"), F.when(k % 4 == 0, F.concat(F.lit("Alias "), k, F.lit("；"), "c_name", F.lit("| "))).alias("aliases"), F.lit("").alias("status"),
    )
    rows.write.option("header", True).csv(f"{home}/manifest.csv")
    out = M.normalize_manifest(M.read_manifest(spark, home))
    return out.select("doc_id", "company_name", "report_year", "doc_type", "language", F.array_join("aliases", ",").alias("aliases"))


@register("SELECT p_partkey, p_name, p_size FROM part")
def manifest_json_to_csv(spark, d):
    """A JSON manifest with its rows under a name, as CSV with a head, read again."""
    home = new_path(spark, "json")
    schema = "p_partkey long, p_name string, p_size int"
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    # a file holds one document, of which a reader takes the first alone: each has its own folder, wherever its row lies
    whole = p.groupBy(F.expr("p_partkey div 10000").alias("file")).agg(F.to_json(F.struct(F.collect_list(F.struct(*p.columns)).alias("items"))).alias("value"))
    whole.write.partitionBy("file").text(f"{home}/in")
    M.json_to_csv(spark, f"{home}/in", f"{home}/out", schema)
    return M.read_manifest_csv(spark, f"{home}/out", schema).select("p_partkey", "p_name", "p_size")


@register("SELECT event_id, user_id, event_type, value FROM events")
def json_lines(spark, d):
    """Events written as JSON lines, half of them appended later, and read back by a schema."""
    home = new_path(spark, "lines")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    M.write_jsonl(e.where("event_id % 2 = 0"), home)
    M.write_jsonl(e.where("event_id % 2 = 1"), home, append=True)
    return M.require_unique(M.read_jsonl(spark, home, "event_id long, user_id long, event_type string, value double"), ["event_id"])


@register("""WITH o AS (SELECT o_custkey AS k, month(o_orderdate) AS page, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY month(o_orderdate), o_orderkey) AS n FROM orders),
f AS (SELECT o_custkey AS k, month(o_orderdate) AS page, min(o_orderkey) AS first FROM orders GROUP BY 1, 2), m AS (SELECT k, min(page) AS page FROM f GROUP BY 1)
SELECT 'r' || k AS report_id, 'company ' || k AS company_name, first % 30 + 1990 AS report_year FROM f JOIN m USING (k, page)""")
def bundle_summaries(spark, d):
    """A metadata bundle beside a manifest: page records from its files, and what each report's first page says."""
    home = new_path(spark, "bundle")
    o = table(spark, d, "orders")
    first = o.groupBy("o_custkey", F.month("o_orderdate").alias("page")).agg(F.min("o_orderkey").alias("first"))
    pages = first.select(F.concat(F.lit("r"), "o_custkey").alias("report_id"), "page", F.concat(F.lit("company "), "o_custkey").alias("company_name"), (c("first") % 30 + 1990).cast("int").alias("report_year"))
    pages.write.json(f"{home}/metadata.jsonl")
    bundle = B.load_bundle(spark, [home], "required")
    return B.report_summaries(B.page_records(bundle["pages"])).select("report_id", "company_name", "report_year")


@register("""SELECT 'orders' AS entity, year(o_orderdate) AS report_year, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'customers', NULL, count(*) FROM customer""")
def metadata_store(spark, d):
    """Entities written to a store, those with a year by year, and read back as one snapshot."""
    home = new_path(spark, "entities")
    M.write_store({"orders": table(spark, d, "orders").withColumn("report_year", F.year("o_orderdate")), "customers": table(spark, d, "customer")}, home)
    got = M.read_store(spark, home, ["orders", "customers"])
    count = F.count(F.lit(1)).alias("n")
    a = got["orders"].groupBy("report_year").agg(count).select(F.lit("orders").alias("entity"), c("report_year").cast("long").alias("report_year"), "n")
    return a.unionByName(got["customers"].agg(count).select(F.lit("customers").alias("entity"), F.lit(None).cast("long").alias("report_year"), "n"))


@register("""SELECT CASE o_orderkey % 3 WHEN 0 THEN 'answers' WHEN 1 THEN 'answers_01' ELSE 'answers_02' END AS run, CAST(o_orderkey AS VARCHAR) AS question_id, o_orderpriority AS value, CASE WHEN o_orderkey % 3 = 2 THEN 'answers_02' END AS latest FROM orders""")
def answer_runs(spark, d):
    """Answers of three runs beside each other, each under a name that was not taken, and the last of them."""
    home, o = new_path(spark, "runs"), table(spark, d, "orders")
    for k in range(3):
        M.write_run(o.where(c("o_orderkey") % 3 == k).select(c("o_orderkey").cast("string").alias("question_id"), c("o_orderpriority").alias("value")), home, M.next_run(spark, home, "answers"))
    last = M.latest_run(spark, home, "answers")
    return spark.read.parquet(home).select("run", "question_id", "value", F.when(c("run") == last, c("run")).alias("latest"))


@register("""SELECT CAST(o_orderkey AS VARCHAR) AS question_id, 'question ' || o_orderkey AS question_text, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS value FROM orders""")
def answer_bundles(spark, d):
    """Answers in bundles of three shapes: an object with answers, one with questions, a list."""
    home = new_path(spark, "bundles")
    a = F.struct(c("o_orderkey").cast("string").alias("question_id"), F.concat(F.lit("question "), "o_orderkey").alias("question_text"), F.when(c("o_orderkey") % 4 != 0, c("o_orderpriority")).alias("value"))
    lists = table(spark, d, "orders").groupBy((c("o_orderkey") % 30).alias("file")).agg(F.collect_list(a).alias("xs"))
    said = F.when(c("file") % 3 == 0, F.to_json(F.struct(c("xs").alias("answers")))).when(c("file") % 3 == 1, F.to_json(F.struct(c("xs").alias("questions")))).otherwise(F.to_json("xs"))
    lists.select(said.alias("value"), "file").repartition(30, "file").write.partitionBy("file").text(home)  # a file each
    return M.read_answers(spark, f"{home}/*/*").select("question_id", "question_text", "value")


@register("""SELECT question_text, detail FROM (SELECT 'question ' || o_orderkey AS question_text, o_orderpriority AS detail FROM orders) WHERE question_text IS NOT NULL""")
def debug_details(spark, d):
    """What a debug bundle says of each question, found by the question's text."""
    q = F.struct(F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("question "), "o_orderkey")).alias("question_text"), F.when(c("o_orderkey") % 2 == 1, F.concat(F.lit("question "), "o_orderkey")).alias("question"))
    bundles = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", q.alias("q"), c("o_orderpriority").alias("a")))).alias("m"))
    return M.debug_index(bundles.select(c("m.q").alias("questions"), c("m.a").alias("answer_details")))


@register("""SELECT CAST(o_orderkey AS VARCHAR) AS question_id, o_orderpriority AS value, coalesce(CAST(year(o_orderdate) AS VARCHAR) || ';' || CAST(month(o_orderdate) AS VARCHAR), '') AS pages, '' AS reviewed FROM orders""")
def review_lists(spark, d):
    """What reviewers tick off, as CSV in order of questions, read back."""
    home, o = new_path(spark, "review"), table(spark, d, "orders")
    M.review_checklist(o.select(c("o_orderkey").cast("string").alias("question_id"), F.lit("number").alias("kind"), F.lit("how, \"much\"?").alias("question_text"), c("o_orderpriority").alias("value"), F.array(F.year("o_orderdate"), F.month("o_orderdate")).alias("pages")), home)
    return spark.read.option("header", True).schema("question_id string, kind string, question_text string, value string, pages string, reviewed string, correct string, comment string").csv(home).select("question_id", "value", "pages", F.coalesce("reviewed", F.lit("")).alias("reviewed"))


@register("""WITH p AS (SELECT DISTINCT o_custkey AS doc, month(o_orderdate) AS page FROM orders WHERE o_orderkey % 3 = 0) SELECT o_orderkey, 'page ' || page AS page_text FROM orders JOIN p ON doc = o_custkey AND page = month(o_orderdate)""")
def child_pages(spark, d):
    """Chunks with the text of the page that they stand on; those of unknown pages go."""
    o = table(spark, d, "orders").select("o_orderkey", c("o_custkey").alias("doc"), F.month("o_orderdate").alias("page"))
    pages = o.where("o_orderkey % 3 = 0").select("doc", "page").distinct().withColumn("text", F.concat(F.lit("page "), "page"))
    return C.with_pages(o, pages, "doc").select("o_orderkey", "page_text")


@register("""SELECT o_custkey AS doc, month(o_orderdate) AS page, o_orderkey AS table_id, o_orderstatus || chr(10) || o_orderpriority AS text, 'page' || month(o_orderdate) || '_table' || o_orderkey AS parent_block_id FROM orders WHERE o_orderkey % 5 <> 0""")
def serialized_table_chunks(spark, d):
    """Serialized tables as chunks of their page."""
    infos = F.when(c("o_orderkey") % 5 != 0, F.array("o_orderstatus", "o_orderpriority"))
    rows = table(spark, d, "orders").select(c("o_custkey").alias("doc"), F.month("o_orderdate").alias("page"), c("o_orderkey").alias("table_id"), infos.alias("infos"))
    return T.serialized_by_page(rows, "doc").select("doc", "page", "table_id", "text", "parent_block_id")


@register("""WITH l AS (SELECT l_orderkey AS q, l_suppkey AS doc, l_linenumber AS page, l_linenumber % 2 = 0 AS relevant FROM lineitem), s AS (SELECT DISTINCT q, doc, page FROM l WHERE relevant), a AS (SELECT q, count(*) FILTER (relevant) > 0 AS shown FROM l GROUP BY q)
SELECT q AS query_id, 'answer' AS kind, doc, page FROM s UNION ALL SELECT DISTINCT q, 'citation', doc, page FROM l WHERE page = 1
UNION ALL SELECT q, 'grounding', min(doc), 7 FROM l WHERE q % 2 = 0 GROUP BY q""")
def evidence_of_answers(spark, d):
    """Which pages an answer's record shows: relevant ones that were retrieved, cited ones, the grounded one."""
    at = F.struct(c("l_suppkey").alias("doc"), c("l_linenumber").alias("page"))
    rows = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("query_id")).agg(F.collect_set(at).alias("retrieved"), F.collect_set(F.when(c("l_linenumber") == 1, at)).alias("cited"), F.collect_set(F.when(c("l_linenumber") % 2 == 0, c("l_linenumber"))).alias("relevant_pages"), F.array_sort(F.collect_set("l_suppkey")).alias("docs"), F.min("l_suppkey").alias("grounding_doc"))
    rows = rows.withColumn("grounding_page", F.when(c("query_id") % 2 == 0, 7)).withColumn("relevant_pages", F.when(F.size("relevant_pages") > 0, c("relevant_pages")).otherwise(F.array().cast("array<int>")))
    return L.evidence_summary(rows)


@register("""WITH r AS (SELECT o_orderkey AS q FROM orders WHERE o_orderkey % 4 IN (0, 1) AND o_orderstatus <> 'P' AND o_orderkey % 3 <> 0)
SELECT l_orderkey AS query_id, l_suppkey AS doc, count(*) AS n, max(l_discount) AS final_score FROM lineitem JOIN r ON q = l_orderkey GROUP BY 1, 2""")
def backfilled_results(spark, d):
    """Records about several documents that lost their results get them from their citations."""
    k = c("o_orderkey")
    records = table(spark, d, "orders").select(k.alias("query_id"), F.when(k % 4 < 2, 2).otherwise(1).alias("n_docs"), F.when(k % 3 == 0, 1).otherwise(0).alias("n_results"), F.lit("").alias("context"), F.when(c("o_orderstatus") == "P", "N/A").otherwise("x").alias("final_answer"))
    cites = table(spark, d, "lineitem").select(c("l_orderkey").alias("query_id"), c("l_suppkey").alias("doc"), c("l_linenumber").alias("page"), c("l_discount").alias("score"))
    return L.backfill(records, cites).select("query_id", "doc", "n", "final_score")


@register("""SELECT o_orderkey AS question_id, CASE o_orderkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'name' ELSE 'boolean' END AS schema, CASE o_orderkey % 3 WHEN 0 THEN 'table_grounding_result' WHEN 1 THEN 'name_explicit_field_hit' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'explicit_positive' ELSE 'explicit_negative' END END AS source_detail,
 CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'name ' || o_custkey ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END END AS value FROM orders WHERE o_orderstatus <> 'P' AND (o_orderkey % 3 <> 1 OR o_orderkey % 2 = 0)""")
def anchored_answers(spark, d):
    """Answers that are borne out beyond doubt, by the kind of question."""
    k = c("o_orderkey")
    o = table(spark, d, "orders").withColumn("schema", F.when(k % 3 == 0, "number").when(k % 3 == 1, "name").otherwise("boolean"))
    none, pages = c("o_orderstatus") == "P", F.array(F.month("o_orderdate")).alias("pages")
    answers = o.select(k.alias("question_id"), "schema", F.when(none, "N/A").otherwise(F.concat(F.lit("name "), "o_custkey")).alias("final_answer"), c("o_custkey").alias("grounded_value"), F.month("o_orderdate").alias("grounding_page"))
    names = o.select(k.alias("question_id"), F.when(k % 2 == 0, "explicit_field_hit").otherwise("answer_text_only").alias("support_type"), pages)
    booleans = o.select(k.alias("question_id"), F.when(none, "conflict").when(k % 2 == 0, "explicit_positive").otherwise("explicit_negative").alias("classification"), pages)
    return L.anchors(answers, names, booleans).select("question_id", "schema", "source_detail", "value")


@register("""WITH s AS (SELECT o_custkey AS q, o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN o_totalprice / 600000 ELSE o_totalprice END AS v FROM orders), m AS (SELECT *, max(v) OVER (PARTITION BY q) AS hi, min(v) OVER (PARTITION BY q) AS lo FROM s)
SELECT q, k, round(coalesce(CASE WHEN lo >= 0 AND hi <= 1 THEN v WHEN hi > lo THEN (v - lo) / (hi - lo) WHEN v > 0 THEN 1.0 WHEN v IS NOT NULL THEN 0.0 END, 0.0), 6) AS score FROM m""")
def remote_score_scale(spark, d):
    """Scores of a remote scorer, some in 0..1 and some not, some left out."""
    v = F.when(c("o_custkey") % 2 == 0, c("o_totalprice") / 600000).otherwise(c("o_totalprice"))
    rows = table(spark, d, "orders").select(c("o_custkey").alias("q"), c("o_orderkey").alias("k"), F.when(c("o_orderkey") % 7 != 0, v).alias("v"))
    return rows.select("q", "k", F.round(U.remote_scores(c("v"), ["q"]), 6).alias("score"))


@register("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, month(o_orderdate) ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def record_dedupe(spark, d):
    """The first record of every key."""
    return K.dedupe(table(spark, d, "orders"), [c("o_custkey"), F.month("o_orderdate")], "o_orderkey").select("o_orderkey")


@register("""SELECT p_partkey, (p_size % 3 = 0 OR p_partkey % 2 = 0) AS member, CASE WHEN p_size > 25 THEN 'has_size' ELSE '' END || CASE WHEN p_size > 25 AND p_retailprice > 1000 THEN ',' ELSE '' END || CASE WHEN p_retailprice > 1000 THEN 'mentions_price' ELSE '' END AS flags,
 CASE WHEN p_size % 5 = 0 THEN p_size END AS whole, 'tools' AS industry FROM part""")
def flags_and_lists(spark, d):
    """Candidate documents, topic flags out of columns, whole numbers and industries out of texts."""
    p = table(spark, d, "part").withColumn("has_size", F.when(c("p_size") > 25, " Yes").otherwise("no")).withColumn("mentions_price", (c("p_retailprice") > 1000).cast("int"))
    allowed = F.when(c("p_size") % 3 == 0, F.array().cast("array<long>")).otherwise(F.array(F.when(c("p_partkey") % 2 == 0, c("p_partkey")).otherwise(-1)))
    size = F.when(c("p_size") % 5 == 0, F.concat(F.lit(" "), "p_size")).otherwise(F.concat("p_size", F.lit(".5")))
    return p.select("p_partkey", P.member(c("p_partkey"), allowed).alias("member"), F.array_join(P.topic_flags(p), ",").alias("flags"), X.to_int(size).alias("whole"), G.clean_industry(F.concat(F.lit(" 属于tools_"), (2000 + c("p_size")).cast("string"))).alias("industry"))


@register("""SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AS borne_out, CASE o_orderkey % 4 WHEN 0 THEN '万元' WHEN 3 THEN '%' END AS unit FROM orders""")
def literal_tags(spark, d):
    """Whether a text bears out a tag, by itself or by an alias of it, and the unit that it names."""
    k = c("o_orderkey") % 4
    text = F.when(k == 0, "业务在海外 12万元").when(k == 1, "our ai works").when(k == 2, "nothing").otherwise("5 %")
    tag = F.when(k == 0, "出海").when(k == 1, "人工智能").otherwise("信创")
    return table(spark, d, "orders").select("o_orderkey", A.literal_evidence(tag, text).alias("borne_out"), X.unit_hint(text).alias("unit"))


@register("""WITH l AS (SELECT l_orderkey AS q, l_linenumber AS n, l_linenumber % 2 = 0 AS support, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_suppkey, l_partkey) AS rank FROM lineitem),
o AS (SELECT *, CASE WHEN support THEN 1 WHEN rank = 1 THEN 0 ELSE 2 END AS part FROM l)
SELECT q AS query_id, CASE WHEN support THEN 'support' ELSE 'distractor' END AS role, rank, row_number() OVER (PARTITION BY q ORDER BY part, rank) AS place FROM o""")
def interleaved_context(spark, d):
    """The first distractor, all support, the other distractors."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey", c("l_linenumber") % 2).orderBy("l_linenumber", "l_suppkey", "l_partkey"))
    rows = table(spark, d, "lineitem").select(c("l_orderkey").alias("query_id"), (c("l_linenumber") % 2 == 0).alias("support"), rank.alias("rank"))
    out = L.interleave(rows.where("support").drop("support"), rows.where("not support").drop("support"))
    return out.select("query_id", "role", c("rank").cast("long").alias("rank"), c("place").cast("long").alias("place"))


@register("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '营业收入' WHEN 1 THEN '比较题' WHEN 2 THEN '布尔判断' END AS metric, CASE WHEN o_orderkey % 4 = 0 THEN '期末' END AS period, CASE WHEN o_orderkey % 4 = 0 THEN 'CNY' END AS currency,
 CASE o_orderkey % 4 WHEN 0 THEN 'single_doc_fact' WHEN 1 THEN 'cross_doc_compare' WHEN 2 THEN 'single_doc_boolean' ELSE 'metadata_tag_retrieval' END AS capability FROM orders""")
def question_facts(spark, d):
    """Metric, period, currency and capability that a benchmark question is about."""
    k = c("o_orderkey") % 4
    text = F.when(k == 0, "年末营业收入是多少元").when(k == 1, "谁的利润更高").when(k == 2, "是否盈利").otherwise("有哪些公司")
    kind = F.when(k == 0, "number").when(k == 1, "name").when(k == 2, "boolean").otherwise("names")
    capability = G.capability_of(F.lit(""), F.when(k == 1, 2).otherwise(1), kind, text)
    m = G.metric_of(text, capability, kind)
    return table(spark, d, "orders").select("o_orderkey", m["metric"].alias("metric"), m["period"].alias("period"), m["currency"].alias("currency"), capability.alias("capability"))
