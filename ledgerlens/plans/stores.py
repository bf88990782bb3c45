"""Queries: stored results, assembled reports, streams that resume, incremental stores, quotas, table functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.tables import register_functions
from ..operators import assembly as A
from ..operators import results as S
from ..operators import vector_index as V
from ..sources import incremental as I
from ..sources.store import new_path
from ..streaming import pacing as P
from ..streaming import resume as E
from ..streaming.events import read_stream
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


@register("""SELECT l_orderkey, l_linenumber, l_linenumber AS page, CASE WHEN l_quantity > 40 THEN '' ELSE l_returnflag || ' ' || l_linestatus END AS text, CASE WHEN l_linenumber % 3 = 0 THEN 2 WHEN l_tax > 0.05 THEN 9 ELSE 1 END AS hits,
 'company ' || l_suppkey AS company, CASE WHEN l_linenumber % 2 = 0 THEN 1990 + l_linenumber END AS year, l_linestatus AS flags, l_quantity AS novel, l_linenumber % 3 = 0 AS older,
 CASE WHEN l_linenumber % 3 = 0 THEN 'novel' ELSE 'distance,novel' END AS other FROM lineitem""")
def result_round_trip(spark, d):
    """Results stored as one variant each and read back, every third in the older shape, all with a field that no version knows."""
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", c("l_linenumber").alias("page"), F.when(c("l_quantity") <= 40, F.concat_ws(" ", "l_returnflag", "l_linestatus")).alias("text"), c("l_discount").alias("distance"), c("l_quantity").alias("novel"),
        F.when(c("l_linenumber") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("matched_queries"), F.when((c("l_linenumber") % 3 != 0) & (c("l_tax") > 0.05), 9).alias("query_hit_count"),
        F.struct(F.concat(F.lit("company "), "l_suppkey").alias("company_name"), F.when(c("l_linenumber") % 2 == 0, 1990 + c("l_linenumber")).alias("report_year"), F.array("l_linestatus").alias("topic_flags")).alias("metadata"),
    )
    new = S.serialised(rows.where("l_linenumber % 3 <> 0"), ["l_orderkey", "l_linenumber"])
    old = rows.where("l_linenumber % 3 = 0").select("l_orderkey", "l_linenumber", F.parse_json(F.to_json(F.struct("page", "text", "matched_queries", "novel", "metadata"))).alias("result"))
    out = S.inflated(new.unionByName(old), ["l_orderkey", "l_linenumber"], fields=("company_name", "report_year", "topic_flags"))
    return out.select(
        "l_orderkey", "l_linenumber", "page", "text", c("query_hit_count").alias("hits"), c("metadata.company_name").alias("company"), c("metadata.report_year").alias("year"),
        F.array_join("metadata.topic_flags", ",").alias("flags"), S.field(c("other"), "novel", "double").alias("novel"), "older", F.array_join(F.array_sort(F.map_keys("other")), ",").alias("other"),
    )


PARSED = """
o AS (SELECT o_custkey AS doc, o_orderkey AS no, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE month(o_orderdate) END AS page FROM orders),
i AS (SELECT doc, no, rn, page, CASE WHEN rn % 5 = 0 THEN 'tables' WHEN rn % 7 = 3 THEN 'pictures' ELSE 'texts' END AS kind, CASE WHEN no % 13 = 0 THEN 'footnote' ELSE 'paragraph' END AS label,
      CASE WHEN rn % 4 = 0 THEN NULL ELSE (rn // 4) % 6 END AS parent FROM o)"""


def _parsed(spark, d):
    """(refs, items, groups): each customer's orders as the blocks of a report, three of four in groups up to three deep."""
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    o = table(spark, d, "orders").select(c("o_custkey").alias("doc"), c("o_orderkey").alias("no"), F.when(c("o_orderkey") % 11 != 0, F.month("o_orderdate")).alias("page"), rn.alias("rn"))
    o = o.withColumn("kind", F.when(c("rn") % 5 == 0, "tables").when(c("rn") % 7 == 3, "pictures").otherwise("texts")).withColumn("label", F.when(c("no") % 13 == 0, "footnote").otherwise("paragraph"))
    own = o.select("doc", "kind", "no", F.when(c("rn") % 4 != 0, F.floor(c("rn") / 4) % 6).cast("long").alias("parent"), c("rn").cast("long").alias("pos"))
    number = F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<long>"))
    g = o.select("doc").distinct().select("doc", number.alias("no"))
    refs = g.select("doc", F.lit("groups").alias("kind"), "no", F.when(~c("no").isin(0, 3), c("no") - 1).alias("parent"), (c("no") + 1000).alias("pos"))
    items = o.select("doc", "kind", "no", "page", "label", F.concat(F.lit("order "), "no").alias("text"), F.lit(None).cast("string").alias("orig"))
    return own.unionByName(refs), items, g.select("doc", "no", F.concat(F.lit("group "), "no").alias("name"), F.lit("list").alias("label"))


@register(f"""WITH {PARSED}, p AS (SELECT *, CASE parent WHEN 0 THEN [1000] WHEN 1 THEN [1000, 1001] WHEN 2 THEN [1000, 1001, 1002] WHEN 3 THEN [1003] WHEN 4 THEN [1003, 1004] WHEN 5 THEN [1003, 1004, 1005] ELSE [] END || [rn] AS path FROM i WHERE page IS NOT NULL)
SELECT doc, CAST(page AS INT) AS page, row_number() OVER (PARTITION BY doc, page ORDER BY path) AS place, CASE kind WHEN 'tables' THEN 'table' WHEN 'pictures' THEN 'picture' ELSE label END AS type, no,
 CASE WHEN kind = 'texts' THEN 'order ' || no END AS text, parent AS group_id, 'group ' || parent AS group_name FROM p""")
def report_blocks(spark, d):
    refs, items, groups = _parsed(spark, d)
    out = A.block_stream(refs, items, groups)
    return out.select("doc", "page", c("place").cast("long").alias("place"), "type", "no", "text", "group_id", "group_name")


@register(f"""WITH {PARSED}, g AS (SELECT doc, count(DISTINCT page) AS pages_amount, count(*) FILTER (kind = 'texts') AS text_blocks_amount, count(*) FILTER (kind = 'tables') AS tables_amount, count(*) FILTER (kind = 'pictures') AS pictures_amount,
 count(*) FILTER (kind = 'texts' AND label = 'footnote') AS footnotes_amount FROM i GROUP BY doc)
SELECT *, text_blocks_amount <= greatest(1, pages_amount // 2) AS is_low_text_density FROM g""")
def report_facts(spark, d):
    _, items, _ = _parsed(spark, d)
    out = A.report_facts(items, items.where("page is not null").select("doc", "page").distinct())
    return out.drop("equations_amount")


@register("SELECT event_id, user_id, event_type, round(value * 2, 4) AS twice FROM events")
def resumable_stream(spark, d):
    """Events dealt to files and streamed into a sink by batches, twice: the second call finds nothing left to do."""
    home = new_path(spark, "stream")
    table(spark, d, "events").repartitionByRange(4, "event_id").write.parquet(f"{home}/in")
    stream = read_stream(spark, f"{home}/in", per_trigger=1)
    twice = lambda rows: rows.select("event_id", "user_id", "event_type", F.round(c("value") * 2, 4).alias("twice"))
    for _ in range(2):
        E.run_to_end(stream, f"{home}/out", "run", f"{home}/checkpoint", twice)
    return E.results_of(spark, f"{home}/out", "run").select("event_id", "user_id", "event_type", "twice")


@register("""SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS generation FROM documents""")
def incremental_store(spark, d):
    """A folder of documents grows after it was stored: the second refresh reads the new files alone."""
    home, docs = new_path(spark, "store"), table(spark, d, "documents")
    read = lambda files: spark.read.parquet(*files).select(c("_metadata.file_path").alias("file"), "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\\n")).cast("long").alias("n_lines"))
    for k in (0, 1):
        docs.where(F.pmod("doc_id", F.lit(2)) == k).write.mode("append").parquet(f"{home}/in")
        done = I.refresh(spark, f"{home}/in", f"{home}/store", lambda files, k=k: read(files).withColumn("read_in", F.lit(k + 1)), "*.parquet")
    assert done.changed == done.removed == 0 or done.kept
    return I.current(spark, f"{home}/store").select("doc_id", "n_lines", c("read_in").alias("generation"))


@register("""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, ts AS asked, epoch_us(ts) // 3600000000 AS slot, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth FROM events),
g AS (SELECT *, max(slot - nth // 2) OVER (PARTITION BY key, nth % 2 ORDER BY nth ROWS UNBOUNDED PRECEDING) + nth // 2 AS goes FROM r)
SELECT key, id, CASE WHEN goes > slot THEN make_timestamp(goes * 3600000000) ELSE asked END AS granted, goes - slot AS waited FROM g""")
def paced_requests(spark, d):
    """Two requests of a user an hour; the rest wait for a later hour."""
    rows = table(spark, d, "events").select(c("user_id").alias("key"), c("event_id").alias("id"), c("ts").alias("asked"))
    return P.paced(rows, 2, 3600).select("key", "id", "granted", "waited")


@register("""SELECT CAST(o_orderkey AS VARCHAR) AS key, n.n AS row, k.k AS col, CASE k.k WHEN 0 THEN 'priority' ELSE 'price' END AS head, CASE k.k WHEN 0 THEN o_orderpriority ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS cell
FROM orders, (SELECT unnest([1, 2]) AS n) n, (SELECT unnest([0, 1]) AS k) k""")
def markdown_cell_function(spark, d):
    """A table function in SQL: the cells of the markdown tables in texts, two tables a text."""
    register_functions(spark)
    one = F.concat(F.lit("x\n| priority | price |\n|---|---|\n| "), "o_orderpriority", F.lit(" | "), F.floor("o_totalprice").cast("string"), F.lit(" |\n\n"))
    table(spark, d, "orders").select(c("o_orderkey").cast("string").alias("key"), F.concat(one, one).alias("text")).createOrReplaceTempView("order_tables")
    return spark.sql("SELECT key, row, col, head, cell FROM markdown_cells(TABLE(order_tables))")


@register()
def chunk_function(spark, d):
    """child_chunks() as a table function in SQL; tested against it."""
    register_functions(spark)
    table(spark, d, "documents").select(c("doc_id").cast("string").alias("key"), F.lit(0).cast("long").alias("parent"), "text").createOrReplaceTempView("parent_texts")
    return spark.sql("SELECT key, parent, child, text FROM chunks(TABLE(parent_texts))")


@register()
def merged_line_function(spark, d):
    """Lines of a document joined in order by a table function that sees a partition row by row; tested against a loop."""
    register_functions(spark)
    table(spark, d, "documents").select(c("doc_id").alias("key"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text")).createOrReplaceTempView("document_lines")
    return spark.sql("SELECT key, first, last, length(text) AS chars, sha2(text, 256) AS digest FROM merged_pieces(TABLE(document_lines) PARTITION BY key ORDER BY pos)")


@register()
def late_candidates_topk(spark, d):
    """Late interaction on documents that the codes of single tokens name; recall is tested."""
    v, path = table(spark, d, "embeddings"), new_path(spark, "tokens")
    V.write_index(v, path)
    index = V.read_index(spark, path)
    tokens = index.vectors.select(F.floor(c("vec_id") / 4).alias("doc"), "vec_id", "embedding")
    asked = tokens.where("doc % 25 = 0").select(c("doc").alias("qid"), "vec_id", c("embedding").alias("qv"))
    return V.late_pq_topk(index, tokens, asked, 5, max(60, min(400, index.rows // 10))).select("qid", "doc", "score", c("rank").cast("long").alias("rank"))
