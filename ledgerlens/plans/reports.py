"""Queries: page texts, sections, chunks, metadata, tables and their grounding, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
from ..operators import chunks as C
from ..operators import grounding as N
from ..operators import retrieval as R
from ..operators import tables as T
from ..sources import manifests as M
from ..sources import metadata as B
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


GLYPHS = "replace(replace(coalesce(text, ''), ' the ', ' /one.pl.tnum '), 'on', 'glyph<c=3,f=1>/A.cap')"


@register(rf"""WITH t AS (SELECT doc_id, {GLYPHS} AS t FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '/one(?:\.pl\.tnum|\.tnum\.pl|\.pl|\.tnum|\.case|\.sups)', '1', 'g'), 'glyph<[^>]*>', '', 'g'), '/([A-Z])\.cap', '\1', 'g')) AS cleaned,
 len(regexp_extract_all(t, '/one\.pl\.tnum')) + 2 * len(regexp_extract_all(t, 'glyph<[^>]*>')) AS corrections FROM t""")
def glyph_cleaning(spark, d):
    """Whole texts with glyph commands put in, and taken out again."""
    rows = table(spark, d, "documents").select("doc_id", F.expr(GLYPHS).alias("t"))
    text, n = C.clean_glyphs(c("t"))
    return rows.select("doc_id", F.md5(text).alias("cleaned"), n.cast("long").alias("corrections"))


HEADED = "array_join(transform(split(coalesce(text, ''), '\n'), l -> CASE WHEN length(l) BETWEEN 1 AND 36 THEN concat(' ## ', l, ' ') ELSE l END), '\n')"


@register(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no, unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents),
h AS (SELECT doc_id, no, length(raw) BETWEEN 1 AND 36 AS head, CASE WHEN length(raw) BETWEEN 1 AND 36 THEN trim('## ' || raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) ELSE rtrim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) END AS line FROM l),
b AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS block FROM h),
g AS (SELECT doc_id, block, string_agg(line, chr(10) ORDER BY no) AS text, count(*) AS n_lines, bool_or(head) AS head, arg_min(line, no) AS first FROM b WHERE trim(line) <> '' GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS block, CASE WHEN head THEN trim(regexp_replace(first, '^#+', '')) ELSE 'Page 1' END AS section_title, length(trim(text, ' ' || chr(9) || chr(10))) AS chars, n_lines FROM g""")
def section_blocks(spark, d):
    """Documents whose short lines are made headings, in sections: nothing is shuffled."""
    pages = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), F.expr(HEADED).alias("text"))
    return C.sections(pages).select("doc_id", c("block").cast("long").alias("block"), "section_title", F.length("text").cast("long").alias("chars"), c("n_lines").cast("long").alias("n_lines"))


@register()
def page_assembly(spark, d):
    """Lines of documents as blocks of pages; the rendering rules are compared with fixed cases in a test."""
    lines = table(spark, d, "documents").select(c("doc_id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "text"))
    kind = F.element_at(F.array(*map(F.lit, ("text", "section_header", "list_item", "footnote", "page_footer", "paragraph"))), (F.pmod(F.xxhash64("text"), F.lit(6)) + 1).cast("int"))
    blocks = lines.select("doc", (c("no") / 8).cast("int").alias("page"), c("no").alias("pos"), kind.alias("type"), "text", F.lit(None).cast("int").alias("table_id"), F.lit(None).cast("int").alias("picture_id"))
    return C.page_texts(blocks).select("doc", "page", F.length("text").alias("chars"))


@register()
def parent_child_chunks(spark, d):
    """Parents and children of whole documents with what is embedded and searched; the splitter has tests of its own."""
    docs = table(spark, d, "documents")
    blocks = C.sections(docs.select("doc_id", F.lit(1).alias("page"), "text")).withColumn("part", F.lit(0)).withColumn("chunk_type", F.lit("content"))
    parents, children = C.build_chunks(blocks, docs.select("doc_id", c("source").alias("company_name"), c("lang").alias("language")))
    both = C.chunk_metadata(parents, C.with_parents(children, parents.select("doc_id", "chunk_id", "section_title")).drop("parent_section_title"))
    return both.select("doc_id", "node_type", "chunk_id", "parent_chunk_id", F.length("search_text").alias("search_chars"), F.length("embedding_text").alias("embedding_chars"))


@register("""WITH r AS (SELECT p_partkey, p_name, p_brand, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS size, p_type, p_partkey % 4 AS k, CASE WHEN p_partkey % 2 = 0 THEN [p_name, p_type] ELSE [] END AS tags FROM part)
SELECT p_partkey, '公司：' || p_brand || chr(10) || CASE WHEN size IS NULL THEN '' ELSE '代码：' || size || chr(10) END || '年份：' || (2000 + k) || '年年报' || chr(10)
 || CASE WHEN k = 0 THEN '' ELSE '市场：' || CASE WHEN k = 1 THEN p_type ELSE p_type || '、B' || k END || chr(10) END || '章节：' || p_name || CASE WHEN len(tags) > 0 THEN chr(10) || '业务主题：' || array_to_string(tags, '、') ELSE '' END || chr(10) || chr(10) || '正文：' || chr(10) || 'body ' || p_partkey AS embedding_text,
 p_brand || chr(10) || coalesce(size || chr(10), '') || (2000 + k) || chr(10) || 'annual_report' || chr(10) || CASE WHEN k > 1 THEN 'B' || k || chr(10) ELSE '' END || CASE WHEN k > 0 THEN p_type || chr(10) ELSE '' END || p_name || chr(10) || CASE WHEN len(tags) > 0 THEN array_to_string(tags, chr(10)) || chr(10) ELSE '' END || 'body ' || p_partkey AS search_text FROM r""")
def chunk_texts(spark, d):
    """What is embedded and what is searched of a chunk; missing values leave no line, strategy tags are not searched."""
    k = c("p_partkey") % 4
    tags = F.when(c("p_partkey") % 2 == 0, F.array("p_name", "p_type")).otherwise(F.array().cast("array<string>"))
    chunk = table(spark, d, "part").select(
        "p_partkey", c("p_brand").alias("company_name"), F.when(c("p_size") % 3 != 0, c("p_size").cast("string")).alias("stock_code"), (2000 + k).alias("report_year"), F.lit("annual_report").alias("doc_source_type"),
        F.when(k > 0, c("p_type")).otherwise("").alias("market_type"), F.when(k > 1, F.concat(F.lit("B"), k.cast("string"))).when(k == 1, "").alias("board"), c("p_name").alias("section_name"), tags.alias("business_tags"),
        F.array("p_brand").alias("strategy_tags"), F.concat(F.lit("body "), c("p_partkey").cast("string")).alias("text"),
    )
    return chunk.select("p_partkey", C.embedding_text(chunk).alias("embedding_text"), C.search_text(chunk).alias("search_text"))


@register("""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, min(CASE WHEN l_discount > 0.05 THEN l_returnflag ELSE '' END) AS section_name, max(CASE WHEN l_tax > 0.05 THEN l_linestatus END) AS board FROM lineitem GROUP BY 1, 2),
b AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber % 4 AS page FROM lineitem)
SELECT b.doc_id, CAST(b.page AS INT) AS page, coalesce(nullif(p.section_name, ''), CASE WHEN b.page % 2 = 0 THEN 'own' END, 'Page ' || b.page) AS section_name, coalesce(p.board, nullif(o_orderstatus, 'P')) AS board,
 coalesce(nullif(p.section_name, ''), CASE WHEN b.page % 2 = 0 THEN 'own' END, 'Page ' || b.page) AS section_path, CAST(o_custkey AS VARCHAR) AS stock_code, coalesce(p.page, b.page) AS page_start
FROM b LEFT JOIN p ON p.doc_id = b.doc_id AND p.page = b.page LEFT JOIN orders ON o_orderkey = b.doc_id""")
def page_metadata(spark, d):
    """Blocks left joined with page and report metadata: empty values count as missing."""
    li = table(spark, d, "lineitem")
    pages = li.groupBy(c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("page")).agg(F.min(F.when(c("l_discount") > 0.05, c("l_returnflag")).otherwise("")).alias("section_name"), F.max(F.when(c("l_tax") > 0.05, c("l_linestatus"))).alias("board"), F.first("l_linenumber").alias("page_start"))
    blocks = li.select(c("l_orderkey").alias("doc_id"), (c("l_linenumber") % 4).alias("page")).distinct().withColumn("section_name", F.when(c("page") % 2 == 0, "own").otherwise(""))
    reports = table(spark, d, "orders").select(c("o_orderkey").alias("doc_id"), F.when(c("o_orderstatus") != "P", c("o_orderstatus")).alias("board"), c("o_custkey").cast("string").alias("security_code"))
    out = C.apply_page_metadata(blocks, pages, reports)
    return out.select("doc_id", "page", "section_name", "board", "section_path", "stock_code", "page_start")


@register("""SELECT l_orderkey AS doc_id, CAST(round(l_linenumber * 1e9 + l_extendedprice * 100) AS BIGINT) AS chunk, CASE WHEN l_discount > 0.05 THEN l_returnflag END AS board, o_orderpriority AS company_name, CASE l_linenumber % 3 WHEN 0 THEN 'CNY' WHEN 1 THEN 'USD' ELSE 'XX' END AS currency,
 CASE WHEN l_quantity > 25 THEN 'q,' || l_linestatus ELSE 'd' END AS tags, CASE WHEN l_tax > 0.04 THEN 'page' WHEN l_linenumber % 2 = 0 THEN 'child' ELSE 'parent' END AS node_type
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""".replace("CASE l_linenumber % 3 WHEN 0 THEN 'CNY' WHEN 1 THEN 'USD' ELSE 'XX' END", "CASE o_custkey % 3 WHEN 0 THEN 'CNY' WHEN 1 THEN 'USD' ELSE 'XX' END"))
def result_metadata(spark, d):
    """A chunk's null hides the document's value, its empty list does not."""
    place = F.round(c("l_linenumber") * 1e9 + c("l_extendedprice") * 100).cast("long")
    chunks = table(spark, d, "lineitem").select(
        c("l_orderkey").alias("doc_id"), place.alias("chunk"), F.when(c("l_discount") > 0.05, c("l_returnflag")).alias("board"), F.when(c("l_quantity") > 25, F.array(F.lit("q"), F.lit(" "), c("l_linestatus"))).otherwise(F.array().cast("array<string>")).alias("business_tags"),
        F.when(c("l_tax") > 0.04, "page").otherwise("content").alias("chunk_type"), F.when(c("l_linenumber") % 2 == 0, 1).alias("parent_chunk_id"), F.array(F.lit(1)).alias("child_chunk_ids"),
    )
    money = F.when(c("o_custkey") % 3 == 0, "人民币").when(c("o_custkey") % 3 == 1, " us$ ").otherwise("xx")
    docs = table(spark, d, "orders").select(c("o_orderkey").alias("doc_id"), c("o_orderstatus").alias("board"), c("o_orderpriority").alias("company_name"), money.alias("currency"), F.array(F.lit("d")).alias("business_tags"))
    out = C.result_metadata(chunks.join(docs.select("doc_id"), "doc_id"), docs)
    return out.select("doc_id", "chunk", "board", "company_name", "currency", F.array_join("business_tags", ",").alias("tags"), "node_type")


@register("""SELECT l_orderkey AS doc_id, l_linenumber AS chunk, o_orderstatus AS parent_status, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3""")
def child_to_parent(spark, d):
    """Children with their parents' columns; a missing parent would fail the query."""
    parents = table(spark, d, "orders").select((c("o_orderkey") % 7).alias("doc_id"), c("o_orderkey").alias("chunk_id"), c("o_orderstatus").alias("status"))
    known = parents.select("chunk_id")
    li = table(spark, d, "lineitem").join(known, c("l_orderkey") == c("chunk_id"), "left_semi")
    children = li.select((c("l_orderkey") % 7).alias("doc_id"), c("l_orderkey").alias("parent_chunk_id"), c("l_linenumber").alias("chunk"))
    out = C.with_parents(children, parents)
    return out.groupBy(c("parent_chunk_id").alias("doc_id"), "chunk", "parent_status").agg(F.count(F.lit(1)).alias("n"))


CELLS = """h AS (SELECT l_orderkey AS doc, l_linenumber AS r, l_suppkey % 4 AS k, min(l_extendedprice) AS v, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2, 3)"""


@register(f"""WITH {CELLS} SELECT doc, r AS row_idx, k + 1 AS col_idx, CAST(CAST(floor(v) AS BIGINT) AS VARCHAR) AS raw_value, floor(v) * CASE WHEN doc % 2 = 0 THEN 1e4 ELSE 1.0 END AS normalized_value, 'row ' || r AS row_heads,
 CASE WHEN k < 2 THEN 'left,' ELSE 'right,' END || 'c' || (k + 1) AS col_heads, CASE WHEN doc % 2 = 0 THEN '万元' END AS unit_hint, '2024年报' AS period FROM h""")
def structured_cells(spark, d):
    """Numbers of parsed tables with the heads that span their rows and columns; words are no records."""
    tasks = R.tasks_for(table(spark, d, "lineitem"))
    li = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc"), c("l_linenumber").alias("r"), (c("l_suppkey") % 4).alias("k"), "l_extendedprice")
    h = R.dealt(li, "doc", tasks=tasks).groupBy("doc", "r", "k").agg(F.min("l_extendedprice").alias("v"))
    no, yes = F.lit(False), F.lit(True)
    cell = lambda rows, pos, r, r2, k, k2, text, top, side: rows.select("doc", F.lit(1).alias("table_id"), pos.alias("pos"), r.cast("int").alias("row"), r2.cast("int").alias("row_end"), k.cast("int").alias("col"), k2.cast("int").alias("col_end"), text.alias("text"), top.alias("column_header"), side.alias("row_header"))
    docs, zero, one = h.select("doc").distinct(), F.lit(0), F.lit(1)
    spans = [cell(docs, F.lit(i), zero, one, F.lit(1 + 2 * i), F.lit(3 + 2 * i), F.lit(t), yes, no) for i, t in enumerate(("left", "right"))]
    heads = [cell(docs, F.lit(10 + i), one, F.lit(2), F.lit(i), F.lit(i + 1), F.lit(f"c{i}"), yes, no) for i in range(1, 5)]
    labels = cell(h.select("doc", "r").distinct(), F.lit(20), c("r"), c("r") + 1, zero, one, F.concat(F.lit(" row "), c("r").cast("string")), no, no)
    body = cell(h, F.lit(30), c("r"), c("r") + 1, c("k") + 1, c("k") + 2, F.floor("v").cast("string"), no, no)
    words = cell(docs, F.lit(31), F.lit(99), F.lit(100), one, F.lit(2), F.lit("none"), no, no)
    cells = labels.unionByName(body).unionByName(words)
    for part in (*spans, *heads):
        cells = cells.unionByName(part)
    tables = docs.select("doc", one.alias("table_id"), one.alias("page"), F.when(c("doc") % 2 == 0, "2024年度报告 单位：万元").otherwise("2024 年报").alias("markdown"))
    out = T.structured_cells(cells, tables, tasks=tasks).where("col_idx > 0")
    return out.select("doc", "row_idx", c("col_idx").cast("long").alias("col_idx"), "raw_value", "normalized_value", F.array_join("row_heads", ",").alias("row_heads"), F.array_join("col_heads", ",").alias("col_heads"), "unit_hint", "period")


@register("""SELECT p_partkey, '| ' || p_name || ' | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || replace(p_brand, '#', chr(92) || '|') || ' | ' || p_size || ' |' AS markdown,
 CASE WHEN p_size % 2 = 0 THEN 'm' ELSE 'm' || chr(10) || 'Description of the table entities:' || chr(10) || p_name || chr(10) || p_type END AS described, CASE WHEN p_size % 2 = 0 THEN 'm' ELSE p_name || chr(10) || p_type END AS instead FROM part""")
def table_texts(spark, d):
    """Grids as markdown; tables with, or instead of it, their information blocks."""
    grid = F.array(F.array(c("p_name"), F.lit("size")), F.array(F.replace("p_brand", F.lit("#"), F.lit("|")), c("p_size").cast("string")))
    infos = F.when(c("p_size") % 2 != 0, F.array("p_name", "p_type"))
    return table(spark, d, "part").select("p_partkey", T.grid_markdown(grid).alias("markdown"), C.serialized_text(F.lit("m"), infos).alias("described"), C.serialized_text(F.lit("m"), infos, True).alias("instead"))


BLOCKS = """b AS (SELECT user_id AS doc, CAST(event_id // 1000 AS INT) AS page, event_id AS pos, CASE WHEN event_id % 9 = 4 THEN 'table' WHEN event_id % 11 = 2 THEN 'picture' ELSE 'text' END AS type, CASE WHEN event_id % 9 = 4 OR event_id % 13 = 1 THEN NULL ELSE event_type || event_id END AS text FROM events)"""


def _blocks(spark, d):
    kind = F.when(c("event_id") % 9 == 4, "table").when(c("event_id") % 11 == 2, "picture").otherwise("text")
    text = F.when((c("event_id") % 9 != 4) & (c("event_id") % 13 != 1), F.concat("event_type", c("event_id").cast("string")))
    return table(spark, d, "events").select(c("user_id").alias("doc"), F.floor(c("event_id") / 1000).cast("int").alias("page"), c("event_id").alias("pos"), kind.alias("type"), text.alias("text"), c("event_id").alias("table_id"), c("event_id").alias("picture_id"))


@register(f"""WITH {BLOCKS}, t AS (SELECT doc, page, pos AS table_id, coalesce(lag(pos) OVER w, -1) AS low, lead(pos) OVER w AS high FROM b WHERE type = 'table' WINDOW w AS (PARTITION BY doc, page ORDER BY pos)),
a AS (SELECT t.doc, t.page, table_id, b.pos, b.text, high, row_number() OVER (PARTITION BY t.doc, t.page, table_id ORDER BY b.pos) AS k, count(*) OVER (PARTITION BY t.doc, t.page, table_id) AS n FROM t JOIN b ON b.doc = t.doc AND b.page = t.page AND b.type <> 'table' AND b.pos > table_id AND (high IS NULL OR b.pos < high)),
x AS (SELECT doc, page, table_id, string_agg(text, chr(10) ORDER BY pos) AS after FROM a WHERE k <= CASE WHEN high IS NULL OR n > 3 THEN 3 ELSE n - 1 END GROUP BY 1, 2, 3),
y AS (SELECT t.doc, t.page, table_id, string_agg(b.text, chr(10) ORDER BY b.pos) AS before FROM t JOIN b ON b.doc = t.doc AND b.page = t.page AND b.pos > low AND b.pos < table_id AND b.type <> 'table' GROUP BY 1, 2, 3)
SELECT t.doc, t.page, t.table_id, coalesce(before, '') AS before, coalesce(after, '') AS after FROM t LEFT JOIN x USING (doc, page, table_id) LEFT JOIN y USING (doc, page, table_id)""")
def table_windows(spark, d):
    """What a describer reads before and after each table of a page, up to the tables beside it."""
    return C.table_windows(_blocks(spark, d))


@register(f"""WITH {BLOCKS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY pos) AS i FROM b)
SELECT p.doc, p.page, p.pos AS picture_id, coalesce(string_agg(x.text, chr(10) ORDER BY x.pos), '') AS context_text FROM n p LEFT JOIN n x ON x.doc = p.doc AND x.page = p.page AND x.i BETWEEN p.i - 2 AND p.i + 2 AND x.type <> 'picture' AND x.text IS NOT NULL WHERE p.type = 'picture' GROUP BY 1, 2, 3""")
def picture_context(spark, d):
    return C.picture_context(_blocks(spark, d))


@register("""WITH b AS (SELECT l_orderkey, CAST(round(l_linenumber * 1e9 + l_extendedprice * 100) AS BIGINT) AS place, l_quantity AS l, l_extendedprice / 1000 AS t, l_quantity + l_linenumber AS r, l_extendedprice / 900 - 20 AS u FROM lineitem),
y AS (SELECT *, t BETWEEN 0 AND 100 AND u BETWEEN 0 AND 100 AND t <= u AS down FROM b), z AS (SELECT *, CASE WHEN down THEN t ELSE 100 - greatest(t, u) END AS lo, CASE WHEN down THEN u ELSE 100 - least(t, u) END AS hi FROM y),
q AS (SELECT *, greatest(0, least(199, floor(least(l, r) * 2) - 3)) AS x0, greatest(0, least(199, floor(lo * 2) - 3)) AS y0 FROM z)
SELECT l_orderkey, place, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(greatest(x0 + 1, least(200, ceil(greatest(l, r) * 2) + 3)) AS INT) AS x1, CAST(greatest(y0 + 1, least(200, ceil(hi * 2) + 3)) AS INT) AS y1 FROM q""")
def pixel_boxes(spark, d):
    box = C.pixel_box(c("l_quantity"), c("l_extendedprice") / 1000, c("l_quantity") + c("l_linenumber"), c("l_extendedprice") / 900 - 20, F.lit(100.0), F.lit(200), F.lit(200), F.lit(2.0), 3)
    rows = table(spark, d, "lineitem").select("l_orderkey", F.round(c("l_linenumber") * 1e9 + c("l_extendedprice") * 100).cast("long").alias("place"), box.alias("b"))
    return rows.select("l_orderkey", "place", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


FLAT = r"trim(regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f]+', ' ', 'g'))"


@register(rf"""WITH f AS (SELECT doc_id, text, {FLAT} AS f, instr(lower(text), 'the') AS p FROM documents)
SELECT doc_id, md5(CASE WHEN length(f) > 220 THEN rtrim(substr(f, 1, 220)) || '...' ELSE f END) AS evidence, md5(CASE WHEN length(f) > 240 THEN rtrim(substr(f, 1, 237)) || '...' ELSE f END) AS compact,
 CASE WHEN p > 0 THEN trim(regexp_replace(substr(text, greatest(1, p - 80), p + 2 + 140 - greatest(0, p - 81)), '[\s\x1c-\x1f]+', ' ', 'g')) END AS around FROM f""")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.snippet(c("text"))).alias("evidence"), F.md5(X.short_snippet(c("text"))).alias("compact"), X.snippet_around(F.lit("The"), c("text")).alias("around"))


@register("""SELECT o_custkey AS doc, o_orderkey AS chart_id, '[Chart Evidence]' || chr(10) || '图表ID：' || o_orderkey || chr(10) || '页码：' || (o_custkey % 5) || chr(10) || '图片ID：7' || chr(10) || 'DePlot表格：' || chr(10) || '|' || o_orderstatus || '|' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '周边说明：' || chr(10) || o_orderpriority ELSE '' END AS text,
 o_orderkey % 2 = 0 AS has_chart_context, s.series_name, 'page' || (o_custkey % 5) || '_chart7' AS parent_block_id FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '、' ORDER BY l_returnflag) AS series_name FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'""")
def chart_chunks(spark, d):
    o = table(spark, d, "orders")
    charts = o.select(c("o_custkey").alias("doc"), c("o_orderkey").alias("chart_id"), (c("o_custkey") % 5).alias("page"), F.lit(7).alias("picture_id"), F.when(c("o_orderstatus") != "P", "ok").otherwise("error").alias("status"), F.concat(F.lit("|"), "o_orderstatus", F.lit("|")).alias("table_markdown"), F.lit("raw").alias("raw_output"), F.when(c("o_orderkey") % 2 == 0, c("o_orderpriority")).alias("context_text"))
    records = table(spark, d, "lineitem").join(o.select("o_orderkey", "o_custkey"), c("o_orderkey") == c("l_orderkey")).select(c("o_custkey").alias("doc"), c("o_orderkey").alias("chart_id"), F.ascii("l_returnflag").alias("ordinal"), c("l_returnflag").alias("series_name"), F.lit("").alias("x_label"))
    return C.chart_chunks(charts, records).select("doc", "chart_id", "text", "has_chart_context", "series_name", "parent_block_id")


@register("""WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS report_id, CAST(o_orderkey % 3 AS INT) AS page, o_orderkey AS pos, 'A' AS l1, CASE WHEN o_custkey % 4 = 0 THEN 'x' ELSE o_orderstatus END AS l2, nullif(o_orderpriority, '5-LOW') AS board, [o_orderstatus, 't'] AS tags FROM orders),
g AS (SELECT report_id, page, count(DISTINCT l2) AS n2, min(l2) AS l2, arg_min(board, pos) FILTER (WHERE board IS NOT NULL) AS board FROM r GROUP BY 1, 2),
t AS (SELECT report_id, page, tag, min(pos * 10 + i) AS first_at FROM (SELECT report_id, page, pos, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM r) GROUP BY 1, 2, 3)
SELECT g.report_id, g.page, report_id || '_page_' || lpad(CAST(page AS VARCHAR), 4, '0') AS chunk_id, CASE WHEN n2 = 1 THEN 'A > ' || l2 ELSE 'A' END AS section_path, CASE WHEN n2 = 1 THEN l2 ELSE 'A' END AS section_leaf, board, (SELECT string_agg(tag, ',' ORDER BY first_at) FROM t WHERE t.report_id = g.report_id AND t.page = g.page) AS tags FROM g""")
def page_records(spark, d):
    """Page records of reports: the section all share, first known values, lists in order."""
    o = table(spark, d, "orders")
    l2 = F.when(c("o_custkey") % 4 == 0, "x").otherwise(c("o_orderstatus"))
    rows = o.select(c("o_custkey").cast("string").alias("report_id"), (c("o_orderkey") % 3).cast("int").alias("page"), c("o_orderkey").alias("_pos"), F.concat(F.lit("A >"), l2).alias("section_path"), F.when(c("o_orderpriority") != "5-LOW", c("o_orderpriority")).otherwise(" ").alias("board"), F.array("o_orderstatus", F.lit("t")).alias("business_tags"))
    out = B.page_records(rows)
    return out.select("report_id", "page", "chunk_id", "section_path", "section_leaf", "board", F.array_join("business_tags", ",").alias("tags"))


@register("""WITH l AS (SELECT CAST(o_custkey AS VARCHAR) AS report_id, o_orderstatus AS board, o_orderkey AS pos FROM orders WHERE o_custkey % 3 = 0), p AS (SELECT CAST(o_custkey AS VARCHAR) AS report_id, o_orderpriority AS board, o_orderkey AS pos FROM orders)
SELECT report_id, arg_max(board, pos) AS board, 'company_labels.jsonl' AS label_source FROM l GROUP BY 1 UNION ALL SELECT report_id, arg_min(board, pos), 'metadata.jsonl' FROM p WHERE report_id NOT IN (SELECT report_id FROM l) GROUP BY 1""")
def label_snapshots(spark, d):
    """A report's last label row, else what its first page record says."""
    o = table(spark, d, "orders").select(c("o_custkey").cast("string").alias("report_id"), "o_orderstatus", "o_orderpriority", c("o_orderkey").alias("_pos"), "o_custkey")
    labels = o.where("o_custkey % 3 = 0").select("report_id", c("o_orderstatus").alias("board"), "_pos")
    return B.label_snapshots(labels, o.select("report_id", c("o_orderpriority").alias("board"), "_pos")).select("report_id", "board", "label_source")


@register("""SELECT o_orderkey AS chunk_id, coalesce(n, 0) AS n, coalesce(s, 0) AS total FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def parents_with_children(spark, d):
    parents = table(spark, d, "orders").select(F.lit(0).alias("doc_id"), c("o_orderkey").alias("chunk_id"))
    children = table(spark, d, "lineitem").select(F.lit(0).alias("doc_id"), c("l_orderkey").alias("parent_chunk_id"), c("l_linenumber").alias("chunk_id"))
    out = B.attach_children(parents, children, ["doc_id"])
    return out.select("chunk_id", F.size("child_chunk_ids").cast("long").alias("n"), F.aggregate("child_chunk_ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@register("""WITH m AS (SELECT o_custkey AS code, arg_max(o_orderstatus, o_orderkey) AS board, arg_max(o_orderpriority, o_orderkey) AS industry FROM orders GROUP BY 1)
SELECT CAST(code AS VARCHAR) AS code, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, board) AS board, industry FROM m LEFT JOIN customer ON c_custkey = code""")
def company_master(spark, d):
    """The manifest's last row of each company, with its profile's values where it has any."""
    manifest = table(spark, d, "orders").select(c("o_custkey").cast("string").alias("code"), c("o_orderstatus").alias("board"), c("o_orderpriority").alias("industry"), c("o_orderkey").alias("_pos"))
    profiles = table(spark, d, "customer").select(c("c_custkey").cast("string").alias("stock_code"), F.when(c("c_acctbal") > 0, c("c_mktsegment")).otherwise(" ").alias("board"))
    return B.company_master(manifest, profiles).select("code", "board", "industry")


@register("""SELECT c_custkey AS doc_id, CASE WHEN k.c IS NOT NULL THEN k.s ELSE c_mktsegment END AS board FROM customer LEFT JOIN (SELECT o_custkey AS c, max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS s FROM orders GROUP BY 1) k ON k.c = c_custkey""")
def snapshot_override(spark, d):
    """A snapshot overrides its report, even by null."""
    s = table(spark, d, "orders").groupBy(c("o_custkey").alias("doc_id")).agg(F.max(F.when(c("o_orderstatus") == "F", c("o_orderpriority"))).alias("board"))
    return B.override_snapshot(table(spark, d, "customer").select(c("c_custkey").alias("doc_id"), c("c_mktsegment").alias("board")), s)


LABEL = "CASE doc_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'LA' ELSE 'zzz' END"


@register(rf"""WITH l AS (SELECT doc_id AS doc, {LABEL} AS label FROM documents),
t AS (SELECT l.doc, label, i AS term_no, term FROM l, LATERAL (SELECT unnest([label, label || 'x', 'un']) AS term, unnest([1, 2, 3]) AS i)),
p AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) AS page, unnest(string_split(text, chr(10))) AS text FROM documents),
h AS (SELECT t.doc, label, term, page, row_number() OVER (PARTITION BY t.doc, label ORDER BY term_no, page) AS k FROM t JOIN p ON p.doc = t.doc AND contains(lower(text), lower(term)))
SELECT l.doc, l.label, term AS match_term, page AS evidence_page, term IS NOT NULL AS has_literal_evidence FROM l LEFT JOIN (SELECT * FROM h WHERE k = 1) h ON h.doc = l.doc""")
def label_evidence(spark, d):
    """The first term of each label that any page holds, on the first such page; lines of documents are their pages."""
    docs = table(spark, d, "documents")
    labels = docs.select(c("doc_id").alias("doc"), F.expr(LABEL).alias("label"))
    pages = docs.select(c("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("no", "text")).select("doc", (c("no") + 1).cast("long").alias("page"), "text")
    aliases = {n: [n + "x", "un"] for n in ("the", "LA", "zzz")}
    return A.label_evidence(labels, pages, aliases).select("doc", "label", "match_term", "evidence_page", "has_literal_evidence")


@register("""WITH p AS (SELECT o_custkey AS doc, o_orderkey AS page, o_orderstatus AS text FROM orders WHERE o_custkey % 3 <> 0), k AS (SELECT o_custkey AS doc, CAST(month(o_orderdate) AS BIGINT) AS page, o_orderkey AS chunk, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS t FROM orders)
SELECT * FROM p UNION ALL SELECT doc, page, string_agg(t, chr(10) ORDER BY chunk) FROM k WHERE doc % 3 = 0 GROUP BY 1, 2""")
def pages_or_chunks(spark, d):
    """Documents without page texts get pages from their chunks."""
    o = table(spark, d, "orders")
    pages = o.select(c("o_custkey").alias("doc"), c("o_orderkey").alias("page"), F.when(c("o_custkey") % 3 != 0, c("o_orderstatus")).otherwise("").alias("text"))
    chunks = o.select(c("o_custkey").alias("doc"), F.month("o_orderdate").cast("long").alias("page"), c("o_orderkey").alias("chunk_id"), F.when(c("o_orderkey") % 2 == 0, c("o_orderpriority")).otherwise("").alias("text"), c("o_orderstatus").alias("search_text"))
    return C.pages_or_chunks(pages, chunks)


@register("""WITH m AS (SELECT max(CAST(l_linenumber AS INT)) AS last, l_orderkey AS doc_id FROM lineitem GROUP BY 2), e AS (SELECT doc_id, unnest(range(1, last + 1)) AS page FROM m), p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, min(l_returnflag) AS text FROM lineitem GROUP BY 1, 2)
SELECT e.doc_id, CAST(e.page AS INT) AS page, coalesce(text, '') AS text FROM e LEFT JOIN p ON p.doc_id = e.doc_id AND p.page = e.page""")
def page_gaps(spark, d):
    pages = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("page")).agg(F.min("l_returnflag").alias("text"))
    return C.fill_pages(pages)


@register("""WITH p AS (SELECT o_custkey AS doc, o_orderkey AS page, o_orderstatus AS text FROM orders)
SELECT doc, md5(string_agg(chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# Page ' || page || chr(10) || chr(10) || text, '' ORDER BY page)) AS document FROM p GROUP BY 1""")
def markdown_export(spark, d):
    pages = table(spark, d, "orders").select(c("o_custkey").alias("doc"), c("o_orderkey").alias("page"), c("o_orderstatus").alias("text"))
    return C.markdown_export(pages).select("doc", F.md5("document").alias("document"))


@register("""SELECT 'kept' AS part, o_orderkey AS doc_id FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 5 <> 0 UNION ALL SELECT 'stale', o_orderkey FROM orders WHERE NOT (o_orderstatus IN ('F', 'O') AND o_orderkey % 5 <> 0)""")
def dataset_materialise(spark, d):
    """Rows that succeeded and whose file is there; what the dataset held before and holds no longer is stale."""
    o = table(spark, d, "orders")
    path = F.concat(F.lit("f"), c("o_orderkey").cast("string"))
    manifest = o.select(c("o_orderkey").alias("doc_id"), F.when(c("o_orderstatus") == "F", " Success ").when(c("o_orderstatus") == "O", "").otherwise("failed").alias("status"), path.alias("file_path"))
    kept, stale = M.materialise(manifest.unionByName(manifest), o.where("o_orderkey % 5 <> 0").select(path.alias("file_path")), o.select(c("o_orderkey").alias("doc_id")))
    return kept.select(F.lit("kept").alias("part"), "doc_id").unionByName(stale.select(F.lit("stale").alias("part"), "doc_id"))


@register("""WITH e AS (SELECT l_orderkey AS doc, l_linenumber AS table_id, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT doc, table_id, CASE WHEN table_id % 2 = 0 THEN 'L' || doc END AS logical_table_id, n FROM e""")
def logical_links(spark, d):
    """Serialized tables take their logical table's columns."""
    li = R.dealt(table(spark, d, "lineitem").select(c("l_orderkey").alias("doc"), c("l_linenumber").alias("table_id")), "doc", "table_id")
    links = li.distinct().where("table_id % 2 = 0").withColumn("logical_table_id", F.concat(F.lit("L"), c("doc").cast("string")))
    return T.with_logical_links(li, links, "doc").groupBy("doc", "table_id", "logical_table_id").agg(F.count(F.lit(1)).alias("n"))


# -- grounding -----------------------------------------------------------------------------------------------------------

GROUND = """x AS (SELECT l_orderkey AS doc, l_suppkey % 3 AS table_id, CAST(l_linenumber * 5 AS INT) AS page, CAST(round(l_linenumber * 1e9 + l_extendedprice * 100) AS BIGINT) AS ordinal,
  CASE l_partkey % 5 WHEN 0 THEN '营业收入' WHEN 1 THEN '营业总收入' WHEN 2 THEN '其中：营业收入' WHEN 3 THEN '营业收入比例' ELSE '净利润' END AS row_head, CASE l_returnflag WHEN 'A' THEN '2024年' WHEN 'N' THEN '本期 合计' ELSE '同比' END AS col_head,
  CASE WHEN l_discount > 0.08 THEN '12%' ELSE CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || '.5' END AS raw_value, l_quantity FROM lineitem),
ctx AS (SELECT *, CASE table_id WHEN 0 THEN '主要会计数据 单位：百万元 2024年 营业总收入' WHEN 1 THEN '合并利润表 人民币万元 营业总收入' ELSE '分部信息 单位：元' END AS context, CASE table_id WHEN 0 THEN '百万元' WHEN 1 THEN '人民币万元' ELSE '元' END AS unit FROM x),
ok AS (SELECT *, CASE WHEN doc % 2 = 0 THEN 2024 END AS y FROM ctx WHERE raw_value <> '12%' AND row_head NOT IN ('营业收入比例', '净利润') AND col_head <> '同比'),
sc AS (SELECT doc, page, ordinal, unit, context, row_head, col_head, y, round(
  CASE row_head WHEN '营业收入' THEN 8.0 WHEN '营业总收入' THEN 7.5 ELSE 4.0 END + CASE WHEN row_head <> '其中：营业收入' AND col_head = '本期 合计' THEN 2.0 ELSE 0.0 END
  + 2.2 * len(list_filter(tok, lambda t: contains(replace(row_head, '：', ':'), t))) + 1.8 * len(list_filter(tok, lambda t: contains(col_head, t))) + 0.8 * len(list_filter(tok, lambda t: contains(replace(context, '：', ':'), t)))
  + CASE table_id WHEN 0 THEN 5.0 WHEN 1 THEN 2.5 ELSE -3.0 END + CASE WHEN row_head = '其中：营业收入' AND table_id < 2 THEN 6.0 ELSE 0.0 END + CASE WHEN page <= 10 THEN 8.0 WHEN page <= 20 THEN 4.0 ELSE 0.0 END
  + CASE WHEN page = 15 THEN 1.5 ELSE 0.0 END + CASE WHEN y IS NOT NULL AND table_id = 0 THEN 1.5 ELSE 0.0 END + CASE WHEN table_id = 1 THEN 0.6 ELSE 0.0 END, 4) AS score,
  CAST(raw_value AS DOUBLE) * CASE table_id WHEN 0 THEN 1e6 WHEN 1 THEN 1e4 ELSE 1.0 END AS value
 FROM ok, (SELECT ['2024', '年营业收入是多少亿元', '年营', '营业', '业收', '收入', '入是', '是多', '多少', '少亿', '亿元', '营业收入'] AS tok)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, ordinal) AS k FROM sc WHERE score >= 2.2) WHERE k = 1)"""


def _ground(spark, d):
    head = F.element_at(F.array(*map(F.lit, ("营业收入", "营业总收入", "其中：营业收入", "营业收入比例", "净利润"))), (c("l_partkey") % 5 + 1).cast("int"))
    col = F.when(c("l_returnflag") == "A", "2024年").when(c("l_returnflag") == "N", "本期 合计").otherwise("同比")
    raw = F.when(c("l_discount") > 0.08, "12%").otherwise(F.concat(F.floor("l_quantity").cast("string"), F.lit(".5")))
    tid = c("l_suppkey") % 3
    hint = F.when(tid == 2, "元").when(tid == 0, "万元")
    place = F.round(c("l_linenumber") * 1e9 + c("l_extendedprice") * 100).cast("long")
    cells = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc"), tid.alias("table_id"), (c("l_linenumber") * 5).alias("page"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), raw.alias("raw_value"), head.alias("row_head"), col.alias("col_head"), hint.alias("unit_hint"), F.lit(None).cast("string").alias("period"), F.lit(None).cast("double").alias("normalized_value"), place.alias("ordinal"))
    text = F.when(c("table_id") == 0, "主要会计数据 单位：百万元 2024年 营业总收入").when(c("table_id") == 1, "合并利润表 人民币万元 营业总收入").otherwise("分部信息 单位：元")
    tables = cells.select("doc", "table_id").distinct().withColumn("context", text)
    questions = cells.select("doc").distinct().select(c("doc").alias("question_id"), F.lit("2024年营业收入是多少亿元？").alias("question"), F.array("doc").alias("docs"), F.array(F.lit(15)).alias("pages"), F.when(c("doc") % 2 == 0, 2024).alias("year"), F.lit(None).cast("string").alias("period"), F.lit("CNY").alias("currency"))
    return N.ground_numbers(questions, tables, cells)


@register(f"WITH {GROUND} SELECT doc AS question_id, page, ordinal, unit, score, value, value / 1e8 AS answer_value FROM best")
def number_grounding(spark, d):
    """Questions for revenue against cells of tables: validity, headers, surroundings, pages, units; the best cell each."""
    return N.best_matches(_ground(spark, d)).select("question_id", "page", "ordinal", "unit", "score", "value", "answer_value")


@register(f"""WITH {GROUND}, h AS (SELECT s.doc, s.page, s.ordinal, s.score, CASE WHEN contains(s.context, '主要会计数据') THEN 100 ELSE 0 END + CASE WHEN contains(s.context, '利润表') THEN 10 ELSE 0 END + CASE WHEN s.page <= 20 THEN 20 ELSE 0 END AS priority
  FROM sc s JOIN best b ON s.doc = b.doc AND s.ordinal <> b.ordinal AND s.page <> b.page AND abs(s.value - b.value) <= greatest(1.0, abs(b.value) * 1e-6) AND (s.y IS NULL OR contains(s.col_head || s.context, '2024'))),
o AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY priority DESC, score DESC, ordinal) AS k FROM h)
SELECT question_id, page, ordinal, priority, support_rank FROM (SELECT doc AS question_id, page, ordinal, priority, row_number() OVER (PARTITION BY doc ORDER BY priority DESC, page, score DESC, ordinal) AS support_rank FROM o WHERE k = 1) WHERE support_rank <= 2""")
def grounding_support(spark, d):
    """Other cells that hold the answer's value, one per page, by what their tables are."""
    out = N.supporting_matches(_ground(spark, d))
    return out.select("question_id", "page", "ordinal", c("priority").cast("long").alias("priority"), c("support_rank").cast("long").alias("support_rank"))


@register("""WITH r AS (SELECT l_orderkey AS doc, l_linenumber AS page, CAST(round(l_linenumber * 1e9 + l_extendedprice * 100) AS BIGINT) AS ordinal, CASE l_returnflag WHEN 'A' THEN 'sales of 2024' WHEN 'N' THEN 'profit' ELSE 'costs 2023' END AS s, l_discount * 8 AS conf, l_quantity AS v, CASE WHEN l_tax > 0.04 THEN '%' ELSE '万元' END AS unit FROM lineitem),
t AS (SELECT *, round(2.2 * len(list_filter(['what', 'sales', '2024', 'in'], lambda t: contains(s, t))) + 0.7 * len(list_filter(['what', 'sales', '2024', 'in'], lambda t: contains(s || ' ' || unit || ' shown in', t))) + CASE WHEN contains(s, '2024') THEN 1.5 ELSE 0.0 END + CASE WHEN page = 3 THEN 1.0 ELSE 0.0 END + 2.0 * least(1.0, conf), 4) AS score FROM r)
SELECT doc AS question_id, page, ordinal, score, value FROM (SELECT doc, page, ordinal, score, v * CASE WHEN unit = '%' THEN 1.0 ELSE 1e4 END AS value, row_number() OVER (PARTITION BY doc ORDER BY score DESC, ordinal) AS k FROM t WHERE score >= 1.5) WHERE k = 1""")
def chart_grounding(spark, d):
    place = F.round(c("l_linenumber") * 1e9 + c("l_extendedprice") * 100).cast("long")
    series = F.when(c("l_returnflag") == "A", "Sales of 2024").when(c("l_returnflag") == "N", "Profit").otherwise("Costs 2023")
    records = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc"), F.lit("k").alias("chart_id"), c("l_linenumber").alias("page"), series.alias("series_name"), F.lit("").alias("x_label"), F.when(c("l_tax") > 0.04, "%").otherwise("万元").alias("unit"), c("l_quantity").cast("string").alias("raw_value"), F.lit(None).cast("double").alias("normalized_value"), F.lit("shown in").alias("context_text"), F.lit(None).cast("string").alias("table_markdown"), (c("l_discount") * 8).alias("confidence"), place.alias("ordinal"))
    questions = records.select("doc").distinct().select(c("doc").alias("question_id"), F.lit("What sales in 2024").alias("question"), F.array("doc").alias("docs"), F.array(F.lit(3)).alias("pages"), F.lit(2024).alias("year"), F.lit(None).cast("string").alias("period"))
    return N.best_matches(N.ground_charts(questions, records), least=N.CHART_LEAST).select("question_id", "page", "ordinal", "score", "value")


@register("""SELECT o_orderkey, array_to_string(list_sort(list_concat(f, list_filter(s, lambda p: NOT list_contains(f, p))[1 : greatest(1, 3 - len(f))])), ',') AS pages, round(o_totalprice, 2) / 1e4 AS answer FROM (SELECT *, CASE WHEN o_custkey % 9 = o_custkey % 4 THEN [CAST(o_custkey % 9 AS INT)] ELSE [CAST(o_custkey % 9 AS INT), CAST(o_custkey % 4 AS INT)] END AS f, CASE WHEN o_orderkey % 9 = o_orderkey % 5 THEN [CAST(o_orderkey % 9 AS INT)] ELSE [CAST(o_orderkey % 9 AS INT), CAST(o_orderkey % 5 AS INT)] END AS s FROM orders)""".replace("round(o_totalprice, 2) / 1e4 AS answer", "((CAST(round(o_totalprice * 100) AS BIGINT) + 50) // 100) / 1e4 AS answer"))
def grounded_answers(spark, d):
    """Pages that a grounded answer shows, and its value in the unit asked for."""
    i = lambda col, n: (c(col) % n).cast("int")
    pages = N.grounded_pages(i("o_custkey", 9), F.array(i("o_custkey", 4)), F.array_distinct(F.array(i("o_orderkey", 9), i("o_orderkey", 5))))
    value = N.answer_value(N.to_target(c("o_totalprice"), F.lit("万元")), F.lit("万元"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(pages.cast("array<string>"), ",").alias("pages"), value.alias("answer"))


@register("""WITH x AS (SELECT l_orderkey AS doc, CAST(l_linenumber * 4 AS INT) AS page, CAST(round(l_linenumber * 1e9 + l_extendedprice * 100) AS BIGINT) AS ordinal, l_partkey % 4 AS r, l_suppkey % 4 AS k, l_returnflag AS f, l_quantity AS v FROM lineitem),
s AS (SELECT *, CASE r WHEN 0 THEN 20.0 WHEN 1 THEN 20.0 END + CASE k WHEN 0 THEN 5.0 WHEN 1 THEN 4.0 WHEN 2 THEN 1.0 END + CASE WHEN f = 'A' THEN 8.0 ELSE 0.0 END + CASE WHEN f = 'N' THEN -4.0 ELSE 0.0 END + CASE WHEN page <= 15 THEN 4.0 ELSE 0.0 END AS score FROM x)
SELECT doc, page, ordinal, score, v * 1e4 AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, ordinal) AS n FROM s WHERE score IS NOT NULL) WHERE n = 1""")
def metric_extraction(spark, d):
    """The cell that states a report's total assets."""
    pick = lambda col, *v: F.element_at(F.array(*map(F.lit, v)), (c(col) % len(v) + 1).cast("int"))
    place = F.round(c("l_linenumber") * 1e9 + c("l_extendedprice") * 100).cast("long")
    cells = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc"), c("l_returnflag").alias("table_id"), (c("l_linenumber") * 4).alias("page"), c("l_quantity").cast("string").alias("raw_value"), pick("l_partkey", "资产总额", "总 资产", "总资产收益率", "存货").alias("row_head"), pick("l_suppkey", "2024年12月31日余额".replace("年", "-"), "期末余额", "", "2023").alias("col_head"), F.lit("万元").alias("unit_hint"), place.alias("ordinal"))
    text = F.when(c("table_id") == "A", "主要会计数据").when(c("table_id") == "N", "母公司附注").otherwise("")
    return N.metric_cells(cells.select("doc", "table_id").distinct().withColumn("context", text), cells, "total_assets").select("doc", "page", "ordinal", "score", "value")
