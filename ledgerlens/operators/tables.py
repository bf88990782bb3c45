"""Tables and charts: cells, grounding of numbers, logical tables over pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_held, parse_numeric, period_token, squeezed, unit_hint
from .retrieval import dealt, ranked


def grid_markdown(rows: Column) -> Column:
    """A grid (array of arrays of strings) as a markdown table, the first row its head."""
    line = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit(""))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda c: F.lit(" --- ")), "|"), F.lit("|"))
    return F.array_join(F.concat(F.slice(line, 1, 1), F.array(rule), F.slice(line, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")


def best_cell(cells: DataFrame, by: list[str], least: float = 2.2) -> DataFrame:
    """Grounding: the cell of the largest score, first in scan order among equals, if it reaches the threshold."""
    return ranked(cells.where(F.col("score") >= least), by, F.col("score").desc(), F.col("ordinal"), top=1).drop("rank")


def same_value_support(best: DataFrame, cells: DataFrame, doc: str, top: int = 2) -> DataFrame:
    """Other cells of the document with the same value, within max(1, 1e-6 |value|); one per page, `top` pages in order.

    A band join, made an equi-join on the document: only its cells are compared.
    """
    b = best.select(doc, F.col("value").alias("__v"), F.col("ordinal").alias("__o"))
    near = F.abs(F.col("value") - F.col("__v")) <= F.greatest(F.lit(1.0), F.abs("__v") * 1e-6)
    hit = cells.join(b, doc).where(near & (F.col("ordinal") != F.col("__o"))).drop("__v", "__o")
    one = ranked(hit, [doc, "page"], F.col("score").desc(), F.col("ordinal"), top=1, name="__k").drop("__k")
    return ranked(one, [doc], F.col("page"), top=top, name="support_rank")


#: What stands for a line's end in the output of chart readers (fixed values).
NEWLINES = r"<0x0[Aa]>|<newline>|\\n|\r\n|\r"
#: Units that a chart's surroundings are searched for, in order (fixed values).
CHART_UNITS = "亿元 万元 亿股 万股 百万元 千万元 % 百分点 元".split()


def chart_rows(raw: Column) -> Column:
    """The rows (arrays of cells) of a chart's text: cells parted by bars, tabs, commas or wide gaps; rules and lines of one
    cell go; fewer than two rows are none."""
    trimmed = lambda cells: F.transform(cells, lambda c: F.trim(c))

    def cells(line):
        bars = F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|", -1)
        wide = F.filter(F.split(line, r"\s{2,}", -1), lambda c: F.trim(c) != "")
        return trimmed(F.when(F.contains(line, F.lit("|")), bars).when(F.contains(line, F.lit("\t")), F.split(line, "\t", -1)).when(F.contains(line, F.lit(",")), F.split(line, ",", -1)).otherwise(wide))

    lines = F.transform(F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), NEWLINES, "\n"), "\n"), lambda s: F.trim(s, F.lit(" \t\x0b\f")))
    rows = F.transform(F.filter(lines, lambda s: s != ""), cells)
    rows = F.filter(rows, lambda r: (F.size(r) >= 2) & ~F.forall(r, lambda c: c.rlike("^:?-{2,}:?$")))
    return F.when(F.size(rows) >= 2, rows).otherwise(F.array().cast("array<array<string>>"))


def chart_markdown(rows: Column) -> Column:
    """A chart's rows as a markdown table, short rows filled up."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    full = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    line = F.transform(full, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(line, 1, 1), F.array(rule), F.slice(line, F.lit(2), F.size(line))), "\n")).otherwise("")


def chart_confidence(rows: Column, raw: Column, context: Column, unit: Column) -> Column:
    """How far a chart's text can be trusted (fixed values)."""
    numeric = F.exists(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.exists(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), lambda c: c.rlike(r"\d")))
    year = F.array_join(F.flatten(rows), " ").rlike(r"20\d{2}")
    plus = lambda test, w: F.when(F.coalesce(test, F.lit(False)), w).otherwise(0.0)
    c = 0.35 + plus(F.size(F.get(rows, F.lit(0))) >= 2, 0.2) + plus(numeric, 0.2) + plus(unit.isNotNull(), 0.15) + plus(year, 0.05) + plus(F.trim(context) != "", 0.05) + plus(F.trim(raw) != "", 0.05)
    return F.when(F.size(rows) > 0, F.round(F.least(c, F.lit(0.95)), 4)).otherwise(0.0)


def chart_records(charts: DataFrame, key: str, raw: str = "raw", around: str | None = None, exact: bool = True) -> DataFrame:
    """Melt chart texts to (key, series, x, raw, value, unit, confidence, row, col), one row per number, all within a row:
    series from the head (or their number), labels from the first cells. Values next to a whole number are made whole."""
    said = F.coalesce(F.col(around), F.lit("")) if around else F.lit("")
    base = charts.select(key, F.col(raw).alias("__raw"), said.alias("__around"), chart_rows(F.col(raw)).alias("__rows"))
    unit = first_held(F.concat_ws("\n", "__around", F.coalesce("__raw", F.lit(""))), CHART_UNITS)
    base = base.withColumn("unit", unit).withColumn("confidence", chart_confidence(F.col("__rows"), F.col("__raw"), F.col("__around"), F.col("unit")))
    line = base.select(key, "unit", "confidence", F.get("__rows", F.lit(0)).alias("__head"), F.posexplode("__rows").alias("row", "__cells")).where("row > 0")
    cell = line.select(key, "unit", "confidence", "__head", "row", F.get("__cells", F.lit(0)).alias("x"), F.posexplode("__cells").alias("col", "raw")).where("col > 0")
    value = parse_numeric(F.col("raw"), F.col("unit"), exact)
    value = F.when(F.abs(value - F.rint(value)) <= 1e-4, F.rint(value)).otherwise(F.round(value, 6))
    cell = cell.withColumn("series", F.coalesce(F.get("__head", F.col("col")), F.concat(F.lit("series_"), F.col("col").cast("string")))).withColumn("value", value)
    return cell.where("value is not null").select(key, "series", "x", "raw", "value", "unit", "confidence", "row", "col")


#: Least scores of a confirmed link, a candidate, and a chain that is made one table.
CONFIRMED, CANDIDATE, MATERIAL = 0.62, 0.42, 0.72
#: Signs of a continued table and of a table's last row (fixed values).
CONTINUED, TERMINAL = "(?i)续表|续页|continued", "合计|小计|总计|本期末|期末余额|结束|合并"


def adjacent_pairs(tables: DataFrame, doc: str) -> DataFrame:
    """Candidates for one logical table: tables of one document on pages that follow each other, met by the left one's page,
    so that rows lie as the choice by page wants them."""
    a = tables.select(doc, F.col("table_id").alias("left"), "page", F.struct(*tables.columns).alias("l"))
    b = tables.select(doc, F.col("table_id").alias("right"), (F.col("page") - 1).alias("page"), F.struct(*tables.columns).alias("r"))
    return a.join(b, [doc, "page"])


def edge_score(geometry: Column, section: Column, columns: Column, unit: Column, marker: Column, continues: Column, row_continuity: Column | None = None) -> Column:
    """Evidence from 0 to 1 that two tables are one (fixed values): each part is a level from 0 (none) to the length of its
    list; `continues` is false where the left table ends in a last row, and only without one does row continuity add."""
    level = lambda c, *v: F.coalesce(F.element_at(F.array(F.lit(0.0), *map(F.lit, v)), c + 1), F.lit(0.0))
    follows = F.when(F.coalesce(row_continuity, F.lit(False)), 0.10).otherwise(0.06) if row_continuity is not None else F.lit(0.06)
    total = F.lit(0.18) + level(geometry, 0.07, 0.12) + level(section, 0.14) + level(columns, 0.06, 0.10, 0.18) + level(unit, 0.06, 0.08) + level(marker, 0.18) + F.when(continues, follows).otherwise(-0.22)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


#: Texts of a table that are compared in squeezed form.
FLAT = ("section_name", "report_section", "section_title", "unit_hint", "first_row", "last_row")


def edge_levels(l: str = "l", r: str = "r") -> dict[str, Column]:
    """The parts of edge_score() for two tables as structs with: bbox (left, top, right, bottom), section_name,
    report_section, section_title, ncols, col_heads (array), unit_hint, caption, markdown, first_row and last_row (heads), and
    flat, a struct of the squeezed forms of FLAT."""
    a, b = (lambda n: F.col(f"{l}.{n}")), (lambda n: F.col(f"{r}.{n}"))
    bottom, top = F.get(a("bbox"), F.lit(3)), F.get(b("bbox"), F.lit(1))
    boxed = (F.size(a("bbox")) == 4) & (F.size(b("bbox")) == 4)
    small = F.greatest(bottom, F.get(b("bbox"), F.lit(3)), F.lit(1.0)) <= 2.0
    low = lambda share, units: F.when(small, bottom >= share).otherwise(bottom >= units)
    high = lambda share, units: F.when(small, top <= share).otherwise(top <= units)
    geometry = F.when(~boxed, 0).when(low(0.78, 700) & high(0.22, 120), 2).when(low(0.68, 620) & high(0.30, 180), 1).otherwise(0)
    same = lambda n: F.coalesce((a(f"flat.{n}") != "") & (a(f"flat.{n}") == b(f"flat.{n}")), F.lit(False))
    section = F.when(same("section_name") | same("report_section") | same("section_title"), 1).otherwise(0)
    continued = F.concat_ws(" ", b("caption"), b("markdown"), b("section_title"), b("section_name"), b("report_section")).rlike(CONTINUED)
    heads = F.filter(F.transform(a("col_heads"), lambda h, i: (h != "") & h.eqNullSafe(F.get(b("col_heads"), i))), lambda x: F.coalesce(x, F.lit(False)))
    filled = F.size(F.filter(a("col_heads"), lambda h: F.coalesce(h != "", F.lit(False))))
    both = (filled > 0) & F.exists(b("col_heads"), lambda h: F.coalesce(h != "", F.lit(False)))
    columns = F.when(F.coalesce(a("ncols") != b("ncols"), F.lit(True)), 0).when(both & (F.size(heads) == filled), 3).when(both & (F.size(heads) > 0), 2).when(continued, 2).otherwise(1)
    lu, ru = a("flat.unit_hint"), b("flat.unit_hint")
    unit = F.when((lu != "") & (lu == ru), 2).when((lu != "") & (ru == ""), 1).otherwise(0)
    last, first = a("flat.last_row"), b("flat.first_row")
    return {
        "geometry": geometry, "section": section, "columns": columns, "unit": unit, "marker": F.when(continued, 1).otherwise(0), "continues": ~last.rlike(TERMINAL),
        "row_continuity": (first != "") & ((last == "") | (last != first)),
    }


def table_edges(tables: DataFrame, doc: str, exact: bool = True) -> DataFrame:
    """Scored links (doc, page of the left table, left, right, score, state) of tables on neighbouring pages.

    Texts are squeezed table by table, and a pair's score comes out of a generator, whose expression Spark doesn't copy into
    the filters that follow."""
    pairs = adjacent_pairs(tables.withColumn("flat", F.struct(*[squeezed(F.col(n), exact).alias(n) for n in FLAT])), doc)
    rows = pairs.select(doc, "page", "left", "right", F.explode(F.array(edge_score(**edge_levels()))).alias("score"))
    return rows.where(F.col("score") >= CANDIDATE).withColumn("state", F.when(F.col("score") >= CONFIRMED, "confirmed").otherwise("candidate"))


def greedy_pairs(edges: DataFrame, doc: str, least: float = CONFIRMED) -> DataFrame:
    """One-to-one choice by falling score, each table once on the left and once on the right; ties by ids.

    Edges that leave different pages share no table on either side, so where edges have a column `page` (of the left table)
    every page is chosen by itself, from the tables of two pages; else a document's edges are one group.
    """
    kind = dict(edges.dtypes)
    edge = F.struct((-F.col("score")).alias("o"), "left", "right", "score")
    by = [doc, "page"] if "page" in edges.columns else [doc]
    rows = edges.where(F.col("score") >= least).groupBy(*by).agg(F.array_sort(F.collect_list(edge)).alias("e"))
    kept = f"array<struct<o:double,left:{kind['left']},right:{kind['right']},score:{kind['score']}>>"
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["left"] == x["left"]) | (y["right"] == x["right"]))
    pick = F.aggregate("e", F.array().cast(kept), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x).cast(kept))).otherwise(acc))
    return rows.select(*by, F.explode(pick).alias("p")).select(*by, "p.left", "p.right", "p.score")


def table_chains(tables: DataFrame, chosen: DataFrame, doc: str) -> DataFrame:
    """Tables that chosen links join, with their chain: logical_table_id, place, role (head, middle, tail), continuation_of,
    page_span, merge_confidence (the weakest link's) and materializable. tables: (doc, table_id, page). A document's
    chosen links, at most one into and one out of a table, are followed in one group."""
    kinds = dict(tables.dtypes)
    side = lambda c: tables.select(doc, F.col("table_id").alias(c), F.col("page").alias(f"{c}_page"))
    links = chosen.select(doc, "left", "right", "score").join(side("left"), [doc, "left"]).join(side("right"), [doc, "right"])

    names = [doc, "table_id", "page", "logical_table_id", "place", "members", "role", "continuation_of", "page_span", "merge_confidence", "materializable"]

    def follow(key, group: list[tuple]) -> Iterator[tuple]:
        """group: (left, right, score, left_page, right_page) of one document."""
        after = {x[0]: x for x in group}
        for head in sorted(set(after) - {x[1] for x in group}):
            members, scores, at = [(head, after[head][3])], [], head
            while at in after:
                link = after[at]
                members.append((link[1], link[4]))
                scores.append(link[2])
                at = link[1]
            pages = [p for _, p in members]
            span, least = [min(pages), max(pages)], round(min(scores), 4)
            name = f"logical::{head}::p{span[0]}-{span[1]}"
            for i, (table, page) in enumerate(members):
                role = "head" if i == 0 else "tail" if i == len(members) - 1 else "middle"
                yield key, table, page, name, i, len(members), role, members[i - 1][0] if i else None, span, least, least >= MATERIAL

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_doc, held = None, []
        for b in batches:
            out = []
            for key, *link in b.itertuples(index=False):
                if held and key != open_doc:
                    out += follow(open_doc, held)
                    held = []
                open_doc = key
                held.append(link)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(follow(open_doc, held) if held else [], columns=names)

    t = kinds["table_id"]
    schema = f"{doc} {kinds[doc]}, table_id {t}, page {kinds['page']}, logical_table_id string, place int, members int, role string, continuation_of {t}, page_span array<int>, merge_confidence double, materializable boolean"
    rows = links.select(doc, "left", "right", "score", "left_page", "right_page").repartition(doc).sortWithinPartitions(doc)
    return rows.mapInPandas(run, schema)


def link_tables(tables: DataFrame, doc: str, exact: bool = True) -> DataFrame:
    """tables with the columns of table_chains(); those outside chains are singletons."""
    chains = table_chains(tables, greedy_pairs(table_edges(tables, doc, exact), doc), doc).drop("page")
    return tables.join(chains, [doc, "table_id"], "left").withColumn("role", F.coalesce("role", F.lit("singleton"))).withColumn("merge_confidence", F.coalesce("merge_confidence", F.lit(0.0)))


#: What a serialized table's chunk takes from its logical table (fixed values).
LINKS = ("logical_table_id", "continuation_of", "role", "page_span", "merge_confidence", "materializable")


def with_logical_links(chunks: DataFrame, tables: DataFrame, doc: str) -> DataFrame:
    """Chunks of serialized tables left joined with their table's place in a logical table."""
    links = tables.select(doc, "table_id", *[c for c in LINKS if c in tables.columns])
    return chunks.drop(*[c for c in LINKS if c in chunks.columns]).join(links, [doc, "table_id"], "left")


def serialized_by_page(tables: DataFrame, doc: str, infos: str = "infos") -> DataFrame:
    """Tables that were serialized (an array of information blocks), as chunks of their page: their blocks, a line each."""
    rows = tables.where(F.col(infos).isNotNull())
    return rows.select(doc, "page", "table_id", F.array_join(infos, "\n").alias("text"), F.lit("serialized_table").alias("chunk_type"), F.concat(F.lit("page"), F.col("page").cast("string"), F.lit("_table"), F.col("table_id").cast("string")).alias("parent_block_id"))


def materialize(cells: DataFrame, tables: DataFrame, doc: str) -> DataFrame:
    """Cells of materialisable chains as cells of one table: rows counted on from table to table, heads, units and periods
    that a cell or its table lacks taken from the chain's head, or from the first table or cell that has one.

    cells: doc, table_id, row_idx, col_idx, col_head, unit_hint, period. tables: doc, table_id, logical_table_id, place,
    materializable, unit_hint, period, col_heads (array by column).
    """
    filled = lambda c: F.when(F.trim(c) != "", c)
    t = tables.where(F.coalesce("materializable", F.lit(False))).select(doc, "table_id", "logical_table_id", "place", filled(F.col("unit_hint")).alias("t_unit"), filled(F.col("period")).alias("t_period"), "col_heads")
    most = cells.groupBy(doc, "table_id").agg(F.max(F.greatest("row_idx", F.lit(0))).alias("most"))
    first = cells.groupBy(doc, "table_id").agg(F.min_by(filled(F.col("unit_hint")), F.when(filled(F.col("unit_hint")).isNotNull(), F.struct("row_idx", "col_idx"))).alias("c_unit"), F.min_by(filled(F.col("period")), F.when(filled(F.col("period")).isNotNull(), F.struct("row_idx", "col_idx"))).alias("c_period"))
    t = t.join(most, [doc, "table_id"], "left").join(first, [doc, "table_id"], "left")
    w = Window.partitionBy(doc, "logical_table_id").orderBy("place")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = lambda a, b: F.coalesce(F.first(a, ignorenulls=True).over(whole), F.first(b, ignorenulls=True).over(whole))
    t = t.withColumn("row_offset", F.coalesce(F.sum(F.coalesce("most", F.lit(0)) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumns({"any_unit": pick(F.col("t_unit"), F.col("c_unit")), "any_period": pick(F.col("t_period"), F.col("c_period")), "first_heads": F.first("col_heads").over(whole)})
    rows = cells.join(t, [doc, "table_id"])
    head = F.coalesce(filled(F.col("col_head")), filled(F.get("col_heads", F.col("col_idx"))), filled(F.get("first_heads", F.col("col_idx"))))
    out = {"logical_row_idx": F.col("row_idx") + F.col("row_offset"), "col_head": head, "unit_hint": F.coalesce(filled(F.col("unit_hint")), "t_unit", "any_unit"), "period": F.coalesce(filled(F.col("period")), "t_period", "any_period")}
    return rows.withColumns(out).drop("t_unit", "t_period", "c_unit", "c_period", "any_unit", "any_period", "first_heads", "col_heads", "most")


def page_chains(pages: DataFrame, doc: str) -> DataFrame:
    """Runs of consecutive pages: chain number, place and role (single, head, middle, tail)."""
    w = Window.partitionBy(doc).orderBy("page")
    rows = pages.withColumn("chain", F.col("page") - F.row_number().over(w))
    c = Window.partitionBy(doc, "chain")
    rows = rows.withColumn("place", F.row_number().over(c.orderBy("page"))).withColumn("size", F.count(F.lit(1)).over(c))
    role = F.when(F.col("size") == 1, "single").when(F.col("place") == 1, "head").when(F.col("place") == F.col("size"), "tail").otherwise("middle")
    return rows.withColumn("role", role)


def row_offsets(parts: DataFrame, by: list[str], order: str | list[str], rows: str) -> DataFrame:
    """Where each part's rows begin in the whole: the sum of those before; head and unit are inherited from the part before.
    Parts of one place in `order` come in any order: name more columns where they repeat."""
    w = Window.partitionBy(*by).orderBy(order)
    return parts.withColumn("row_offset", F.coalesce(F.sum(rows).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def inherited(value: Column, by: list[str], order: str | list[str]) -> Column:
    """The last known value up to here; `order` as for row_offsets()."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def structured_cells(cells: DataFrame, tables: DataFrame, doc: str = "doc", exact: bool = True, tasks: int | None = None) -> DataFrame:
    """Numbers of parsed tables with the heads of their row and column.

    cells: doc, table_id, pos (reading order), row, row_end, col, col_end (ends excluded), text, column_header, row_header.
    tables: doc, table_id, page, markdown. Heads stand for every row or column that they span; the first column heads its
    rows; a cell's heads are distinct, in order. Only numbers that are no heads become records; the unit and period are
    those that the table's markdown names. tasks: to how many the cells are dealt; heads are so alike that Spark's own
    choice, by their packed size, would put them into one.
    """
    at = lambda df, *by: df if tasks is None else dealt(df, doc, "table_id", *by, tasks=tasks)
    rows = cells.withColumn("raw_value", F.trim("text")).where("raw_value <> ''")
    top, side = F.coalesce("column_header", F.lit(False)), F.coalesce("row_header", F.lit(False))
    spans = lambda lo, hi: F.explode(F.sequence(F.col(lo), F.greatest(F.col(hi) - 1, F.col(lo))))
    said = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw_value"))), lambda x: x["raw_value"]))
    heads = at(rows.where(top).select(doc, "table_id", "pos", "raw_value", spans("col", "col_end").alias("col_idx")), "col_idx").groupBy(doc, "table_id", "col_idx").agg(said.alias("col_heads"))
    labels = at(rows.where(side | ((F.col("col") == 0) & ~top)).select(doc, "table_id", "pos", "raw_value", spans("row", "row_end").alias("row_idx")), "row_idx").groupBy(doc, "table_id", "row_idx").agg(said.alias("row_heads"))
    known = tables.select(doc, "table_id", "page", unit_hint(F.coalesce("markdown", F.lit(""))).alias("unit_hint"), period_token(F.col("markdown"), exact).alias("period"))
    body = at(rows.where(~top & ~side).select(doc, "table_id", F.col("row").alias("row_idx"), F.col("col").alias("col_idx"), "raw_value")).join(at(known), [doc, "table_id"])
    body = body.withColumn("normalized_value", parse_numeric(F.col("raw_value"), F.col("unit_hint"), exact)).where("normalized_value is not null")
    body = at(body, "row_idx").join(labels, [doc, "table_id", "row_idx"], "left")
    body = at(body, "col_idx").join(heads, [doc, "table_id", "col_idx"], "left")
    none = F.array().cast("array<string>")
    return body.withColumn("row_heads", F.coalesce("row_heads", none)).withColumn("col_heads", F.coalesce("col_heads", none))


def table_context(tables: DataFrame, pages: DataFrame, chunks: DataFrame, doc: str, most: int = 1600) -> DataFrame:
    """What is read around each table: its markdown, caption and sections, then the text of each of its pages (member_pages)
    and the chunks within a page of it, `most` characters of them per page."""
    t = tables.select(doc, "table_id", F.posexplode(F.array_distinct("member_pages")).alias("at", "page"))
    near = t.select(doc, "table_id", "at", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page")).join(chunks.select(doc, "page", "chunk", F.concat_ws("\n", F.nullif("section_title", F.lit("")), F.nullif("text", F.lit(""))).alias("said")), [doc, "page"])
    joined = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["said"]), "\n")
    near = near.groupBy(doc, "table_id", "at").agg(F.substring(joined(F.struct("page", "chunk", "said")), 1, most).alias("near"))
    per = t.join(pages.select(doc, "page", F.col("text").alias("page_text")), [doc, "page"], "left").join(near, [doc, "table_id", "at"], "left")
    per = per.select(doc, "table_id", "at", F.concat_ws("\n", F.nullif("page_text", F.lit("")), F.nullif("near", F.lit(""))).alias("said"))
    per = per.groupBy(doc, "table_id").agg(joined(F.struct("at", "said")).alias("around"))
    own = [F.nullif(c, F.lit("")) for c in ("markdown", "caption", "section_title", "section_name", "report_section")]
    return tables.join(per, [doc, "table_id"], "left").withColumn("context", F.concat_ws("\n", *own, F.nullif("around", F.lit("")))).drop("around")


def nearby_text(tables: DataFrame, chunks: DataFrame, doc: str, most: int = 1600) -> DataFrame:
    """Text within a page of each table: an interval join made an equi-join over three pages."""
    t = tables.select(doc, "table_id", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page"))
    near = t.join(chunks, [doc, "page"]).groupBy(doc, "table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "chunk", "text"))), lambda x: x["text"]), "\n").alias("near"))
    return near.withColumn("near", F.substring("near", 1, most))


def html_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """Title and visible text of raw web pages, by the standard library's parser; broken markup never fails."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.title, self.skip, self.in_title = [], [], 0, False

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "noscript")
            self.in_title = tag == "title"

        def handle_endtag(self, tag):
            if tag in ("script", "style", "noscript"):
                self.skip = max(0, self.skip - 1)
            self.in_title = False
            if tag in ("p", "div", "li", "tr", "h1", "h2", "h3", "h4"):
                self.out.append("\n")

        def handle_data(self, data):
            if self.in_title:
                self.title.append(data)
            elif not self.skip:
                self.out.append(data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            titles, texts = [], []
            for html in b[column].fillna(""):
                p = Text()
                p.feed(html)
                titles.append("".join(p.title).strip())
                texts.append("\n".join(s for s in (" ".join(x.split()) for x in "".join(p.out).split("\n")) if s))
            yield b.drop(columns=[column]).assign(title=titles, text=texts)

    rest = [f"{n} {t}" for n, t in pages.dtypes if n != column]
    return pages.mapInPandas(run, ", ".join([*rest, "title string", "text string"]))
