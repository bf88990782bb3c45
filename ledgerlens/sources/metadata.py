"""Metadata bundles beside manifests: page records, label snapshots, chunk links, company masters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_scalar, first_present, section_segments

TAGS = ("business_tags", "strategy_tags", "factor_tags", "chain_position_minor", "listing_tags", "ownership_tags", "status_tags", "style_tags")
SCALARS = ("stock_code", "company_name", "report_year", "report_type", "exchange", "board", "market_type", "industry_l1", "industry_l2", "chain_position_major", "local_heading", "page_role", "file_path")
#: Files of a bundle and their columns.
PAGES = "report_id string, page int, stock_code string, company_name string, report_year int, report_type string, exchange string, board string, market_type string, industry_l1 string, industry_l2 string, chain_position_major string, section_path string, section_l1 string, section_l2 string, section_l3 string, section_leaf string, section_name string, local_heading string, page_role string, file_path string, " + ", ".join(f"{t} array<string>" for t in TAGS)
CHUNKS = "report_id string, chunk_id string, parent_chunk_id string, page int, chunk_kind string, text string"
LABELS = "report_id string, report_year int, stock_code string, company_name string, industry_l1 string, industry_l2 string, market_type string, exchange string, board string, chain_position_major string, " + ", ".join(f"{t} array<string>" for t in TAGS)
PROFILES = "stock_code string, company_name string, exchange string, board string, industry_l1 string, list_date string"
FILES = {"pages": ("metadata.jsonl", PAGES), "parents": ("chunks.jsonl", CHUNKS), "children": ("child_chunks.jsonl", CHUNKS), "labels": ("company_labels.jsonl", LABELS), "profiles": ("company_profiles.jsonl", PROFILES)}


def load_bundle(spark: SparkSession, roots: list[str], mode: str = "auto") -> dict[str, DataFrame]:
    """The five JSON line files beside manifests, each read over all folders that have it, in one scan; missing ones are empty.
    Modes: auto, required (page records must be there) and ignore (nothing is read)."""
    if mode not in ("auto", "required", "ignore"):
        raise ValueError("mode must be auto, required or ignore")
    out = {}
    for name, (file, schema) in FILES.items():
        paths = []
        for root in roots if mode != "ignore" else []:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{file}")
            if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
                paths.append(f"{root}/{file}")
        if name == "pages" and mode == "required" and not paths:
            raise FileNotFoundError("no metadata.jsonl beside the manifests")
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(paths) if paths else spark.createDataFrame([], schema)
        out[name] = rows.withColumn("_pos", F.monotonically_increasing_id())
    return out


def segments(rows: DataFrame) -> Column:
    """A record's section as a path: of section_path, else of its levels with the leaf where it differs, else its name."""
    col = lambda c: clean_scalar(F.col(c)) if c in rows.columns else F.lit(None).cast("string")
    levels = F.array_compact(F.array(col("section_l1"), col("section_l2"), col("section_l3")))
    last = F.element_at(F.when(F.size(levels) > 0, levels), -1)
    leaf = F.when(col("section_leaf").isNotNull() & ~col("section_leaf").eqNullSafe(last), F.array(col("section_leaf"))).otherwise(F.array().cast("array<string>"))
    both = F.concat(levels, leaf)
    named = F.when(F.size(both) > 0, both).otherwise(F.array_compact(F.array(col("section_name"))))
    path = section_segments(F.col("section_path")) if "section_path" in rows.columns else F.array().cast("array<string>")
    return F.when(F.size(path) > 0, path).otherwise(named)


def common_prefix(lists: Column) -> Column:
    """What all arrays of an array begin with."""
    first = F.get(lists, F.lit(0))
    same = lambda a, b: F.slice(a, F.lit(1), F.size(F.filter(F.transform(a, lambda x, i: F.forall(F.sequence(F.lit(0), i), lambda j: F.get(a, j).eqNullSafe(F.get(b, j)))), lambda ok: ok)))
    return F.when(F.size(lists) > 0, F.aggregate(lists, first, lambda acc, x: F.when(F.size(acc) > 0, same(acc, x)).otherwise(acc))).otherwise(F.array().cast("array<string>"))


def ordered_union(column: str, order: Column) -> Column:
    """Distinct items of the groups' arrays, in the order of rows and within them."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(column, F.array().cast("array<string>")).alias("x")))), lambda s: s["x"])))


def first_nonempty(column: str, order: Column) -> Column:
    value = clean_scalar(F.col(column))
    return F.min_by(value, F.when(value.isNotNull(), order))


def page_records(rows: DataFrame, order: str = "_pos") -> DataFrame:
    """One record per (report_id, page): the longest section that all its records share (else the first record's), the first
    value of every scalar, and the ordered union of every list."""
    at = F.col(order)
    have = set(rows.columns)
    good = rows.where(clean_scalar(F.col("report_id")).isNotNull() & F.col("page").isNotNull()).withColumn("__seg", segments(rows))
    paths = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("o"), F.col("__seg").alias("x")))), lambda s: s["x"]), lambda x: F.size(x) > 0)
    own = lambda *names: F.coalesce(*[F.min_by(clean_scalar(F.col(n)), at) for n in names if n in have], F.lit(None))
    aggs = [common_prefix(paths).alias("__c"), own("section_path", "section_name").alias("__path"), own("section_leaf", "section_name").alias("__leaf"), own("section_name").alias("__name"), *[own(f"section_l{i}").alias(f"__l{i}") for i in (1, 2, 3)]]
    aggs += [first_nonempty(c, at).alias(c) for c in SCALARS if c in have and c != "report_year"] + ([F.min_by("report_year", F.when(F.col("report_year").isNotNull(), at)).alias("report_year")] if "report_year" in have else [])
    aggs += [ordered_union(c, at).alias(c) for c in TAGS if c in have]
    out = good.groupBy("report_id", "page").agg(*aggs)
    shared, number = F.size("__c") > 0, F.concat(F.lit("Page "), F.col("page").cast("string"))
    last = F.element_at(F.when(shared, F.col("__c")), -1)
    leaf = F.coalesce(last, "__leaf", number)
    out = out.withColumns(
        {"section_path": F.when(shared, F.array_join("__c", " > ")).otherwise(F.coalesce("__path", number)), "section_leaf": leaf, "section_name": F.coalesce(last, "__name", leaf)}
        | {f"section_l{i}": F.when(shared, F.get("__c", F.lit(i - 1))).otherwise(F.col(f"__l{i}")) for i in (1, 2, 3)}
    )
    page_id = F.concat(F.col("report_id"), F.lit("_page_"), F.lpad(F.col("page").cast("string"), 4, "0"))
    return out.withColumn("chunk_id", page_id).drop("__c", "__path", "__leaf", "__name", "__l1", "__l2", "__l3")


def label_snapshots(labels: DataFrame, pages: DataFrame, order: str = "_pos") -> DataFrame:
    """One snapshot per report: the last of the label file, else derived from its page records (the first record's scalars and
    the ordered union of lists); label_source tells which."""
    scalars = [c for c in ("report_year", "stock_code", "company_name", "industry_l1", "industry_l2", "market_type", "exchange", "board", "chain_position_major") if c in labels.columns and c in pages.columns]
    tags = [c for c in TAGS if c in labels.columns and c in pages.columns]
    w = Window.partitionBy("report_id").orderBy(F.col(order).desc())
    last = labels.where("report_id is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").select("report_id", *scalars, *tags, F.lit("company_labels.jsonl").alias("label_source"))
    rest = pages.where("report_id is not null").join(last.select("report_id"), "report_id", "left_anti")
    derived = rest.groupBy("report_id").agg(*[F.min_by(c, order).alias(c) for c in scalars], *[ordered_union(c, F.col(order)).alias(c) for c in tags]).withColumn("label_source", F.lit("metadata.jsonl"))
    return last.unionByName(derived)


def attach_children(parents: DataFrame, children: DataFrame, key: list[str]) -> DataFrame:
    """Parents with the distinct ids of their children, in order of the ids; parents without any have an empty list."""
    kind = dict(children.dtypes)["chunk_id"]
    ids = children.where("parent_chunk_id is not null").groupBy(*key, F.col("parent_chunk_id").alias("chunk_id")).agg(F.array_sort(F.collect_set("chunk_id")).alias("child_chunk_ids"))
    return parents.join(ids, [*key, "chunk_id"], "left").withColumn("child_chunk_ids", F.coalesce("child_chunk_ids", F.array().cast(f"array<{kind}>")))


def report_summaries(pages: DataFrame) -> DataFrame:
    """What a report's first page record says of it."""
    cols = [c for c in ("exchange", "board", "market_type", "industry_l1", "industry_l2", "stock_code", "company_name", "report_year") if c in pages.columns]
    return pages.groupBy("report_id").agg(F.min_by(F.struct(*cols), "page").alias("s")).select("report_id", "s.*", F.lit(True).alias("has_metadata"))


def company_master(manifest: DataFrame, profiles: DataFrame, code: str = "code", order: str = "_pos") -> DataFrame:
    """One row per company code: the manifest's last row, with the profile's values where it has any."""
    w = Window.partitionBy(code).orderBy(F.col(order).desc())
    last = manifest.where(clean_scalar(F.col(code)).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", order)
    p = profiles.select(F.col("stock_code").alias("__k"), *[F.col(c).alias(f"__p_{c}") for c in profiles.columns if c not in ("stock_code", "_pos")])
    both = last.join(p, F.col(code) == F.col("__k"), "left")
    shared = [c for c in last.columns if f"__p_{c}" in both.columns]
    new = [c for c in profiles.columns if c not in ("stock_code", "_pos") and c not in last.columns]
    return both.select(*[first_present(F.col(f"__p_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in last.columns], *[F.col(f"__p_{c}").alias(c) for c in new])


def override_snapshot(reports: DataFrame, snapshots: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reports with the columns of their snapshot, which override even by null; reports without one keep their own."""
    s = snapshots.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__s_{c}") for c in snapshots.columns if c != key], F.lit(True).alias("__has"))
    both = reports.join(s, F.col(key) == F.col("__k"), "left")
    has = F.coalesce("__has", F.lit(False))
    cols = [(F.when(has, F.col(f"__s_{c}")).otherwise(F.col(c)) if f"__s_{c}" in both.columns else F.col(c)).alias(c) for c in reports.columns]
    return both.select(*cols, *[F.col(f"__s_{c}").alias(c) for c in snapshots.columns if c != key and c not in reports.columns])


def evidence_of(reports: DataFrame, evidence: DataFrame, field: str | None = None, labels: Column | None = None, literal_only: bool = False, key: str = "doc_id") -> DataFrame:
    """Label evidence of reports, 1 to n, by field, by normalised labels, and only where the text bears it out if asked."""
    from ..functions.text import normalize_text
    from ..operators.filters import normal_list

    rows = evidence
    if field is not None:
        rows = rows.where(F.col("label_field") == field)
    if literal_only:
        rows = rows.where(F.coalesce("has_literal_evidence", F.lit(False)))
    rows = reports.select(key, *([labels.alias("__want")] if labels is not None else [])).join(rows, key)
    if labels is not None:
        rows = rows.where(F.array_contains(normal_list(F.col("__want")), normalize_text(F.col("label")))).drop("__want")
    return rows
