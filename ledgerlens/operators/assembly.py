"""Reports from a parser's output: groups opened, blocks in reading order by page, and counts of what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut


def reading_order(refs: DataFrame, doc: str = "doc") -> DataFrame:
    """refs plus path, group and depth: the places from the document's body down to each item, and its innermost group.

    refs: doc, kind, no (what the reference names), parent (number of the group it stands in; null: the body), pos (place
    among the parent's children). Groups may stand in groups, to any depth: each round joins an item's outermost known
    group with that group's own reference and so doubles the known path, log2(depth) rounds in all. A reference into a
    group that nothing refers to, or into a cycle, has no path and is left out.
    """
    rows = refs.select(doc, "kind", "no", F.col("parent").alias("group"), F.col("parent").alias("above"), F.array("pos").alias("path"))
    groups = rows.where(F.col("kind") == "groups").select(doc, F.col("no").alias("above"), F.col("above").alias("next"), F.col("path").alias("before"))
    depth = 1
    while True:
        groups, rows = cut(groups), cut(rows)
        open_ = rows.where(F.col("above").isNotNull())
        # a path as long as there are groups comes from a cycle
        if open_.isEmpty() or depth > 2 * groups.count():
            break
        grown = open_.join(groups, [doc, "above"]).select(doc, "kind", "no", "group", F.col("next").alias("above"), F.concat("before", "path").alias("path"))
        rows = rows.where(F.col("above").isNull()).unionByName(grown)
        far = groups.select(doc, F.col("above").alias("next"), F.col("next").alias("further"), F.col("before").alias("earlier"))
        still = groups.where(F.col("next").isNotNull()).join(far, [doc, "next"]).select(doc, "above", F.col("further").alias("next"), F.concat("earlier", "before").alias("before"))
        groups = groups.where(F.col("next").isNull()).unionByName(still)
        depth *= 2
    return rows.where(F.col("above").isNull()).select(doc, "kind", "no", "group", "path", F.size("path").alias("depth"))


def block_stream(refs: DataFrame, items: DataFrame, groups: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, page, place, type, kind, no, text, orig, group_id, group_name, group_label): every text, table and picture that the
    body refers to, numbered within its page in reading order.

    items: doc, kind (texts, tables, pictures), no, page (null: nowhere, left out), label, text, orig. groups: doc, no, name,
    label. type is a text's label, or table or picture; orig stays only where it differs from the text. What is referred to
    twice stands twice.
    """
    at = reading_order(refs.where(F.col("kind").isin("texts", "tables", "pictures", "groups")), doc).where(F.col("kind") != "groups")
    rows = at.join(items.where(F.col("page").isNotNull()), [doc, "kind", "no"])
    g = groups.select(doc, F.col("no").alias("group"), F.coalesce("name", F.lit("")).alias("group_name"), F.coalesce("label", F.lit("")).alias("group_label"))
    rows = rows.join(g, [doc, "group"], "left")
    kind = F.when(F.col("kind") == "tables", "table").when(F.col("kind") == "pictures", "picture").otherwise(F.col("label"))
    place = F.row_number().over(Window.partitionBy(doc, "page").orderBy("path", "kind", "no"))
    said = F.when(F.col("kind") == "texts", F.coalesce("text", F.lit("")))
    orig = F.when(F.col("kind") == "texts", F.nullif(F.coalesce("orig", F.lit("")), F.coalesce("text", F.lit(""))))
    return rows.select(doc, "page", place.alias("place"), kind.alias("type"), "kind", "no", said.alias("text"), orig.alias("orig"), F.col("group").alias("group_id"), "group_name", "group_label")


def page_contents(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, page, content): a page's blocks as one ordered array."""
    one = F.struct("place", "type", "kind", "no", "text", "orig", "group_id", "group_name", "group_label")
    return blocks.groupBy(doc, "page").agg(F.array_sort(F.collect_list(one)).alias("content"))


def report_facts(items: DataFrame, pages: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, pages_amount, text_blocks_amount, tables_amount, pictures_amount, equations_amount, footnotes_amount,
    is_low_text_density): what a report holds; few texts for its pages hint at a scan.

    pages: doc, and a row per page. Documents without a page or without items are counted too.
    """
    n = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("long")
    kind = F.col("kind")
    held = items.groupBy(doc).agg(
        n(kind == "texts").alias("text_blocks_amount"), n(kind == "tables").alias("tables_amount"), n(kind == "pictures").alias("pictures_amount"),
        n(kind == "equations").alias("equations_amount"), n((kind == "texts") & (F.col("label") == "footnote")).alias("footnotes_amount"),
    )
    rows = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("pages_amount")).join(held, doc, "full")
    rows = rows.fillna(0, [c for c in rows.columns if c != doc])
    half = F.floor(F.col("pages_amount") / 2)
    return rows.withColumn("is_low_text_density", F.col("text_blocks_amount") <= F.greatest(half, F.lit(1)))
