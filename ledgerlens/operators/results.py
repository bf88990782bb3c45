"""Results as one variant column and back: what is stored may have any keys, what is read is typed, nothing is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a result and of its metadata, with the types they are read back as (fixed values).
RESULT = {
    "page": "int", "text": "string", "matched_child_chunk_ids": "array<int>", "matched_tags": "array<string>", "matched_queries": "array<string>", "query_hit_count": "int",
    "result_scope": "string", "retrieval_sources": "array<string>",
}
METADATA = {
    **dict.fromkeys(("chunk_id", "parent_chunk_id", "report_year"), "int"),
    **dict.fromkeys((
        "chunk_type", "node_type", "section_title", "section_name", "report_section", "company_name", "security_code", "stock_code", "broker_name", "currency", "exchange", "board", "market_type",
        "industry_l1", "industry_l2", "report_type", "doc_source_type", "report_date", "fiscal_year", "period", "unit_hint", "language", "chain_position_major", "table_id",
    ), "string"),
    **dict.fromkeys(("company_aliases", "topic_flags", "business_tags", "strategy_tags", "factor_tags", "chain_position_minor", "listing_tags", "ownership_tags", "status_tags", "style_tags"), "array<string>"),
}
#: What a stored result holds besides, worked out when it is stored.
DERIVED = ("score", "final_score", "text_preview")
LISTS = ("matched_child_chunk_ids", "matched_tags", "matched_queries", "retrieval_sources")
PREVIEW = 220


def serialised(results: DataFrame, keys: list[str], scores: tuple[str, ...] = ("combined_score", "ranking_score", "distance"), metadata: str = "metadata") -> DataFrame:
    """(keys, result): each row as one VARIANT object.

    All columns besides the keys are fields of the object; those of the struct `metadata` stand beside them, where a result
    has no field of that name. Added: score and final_score (the first of `scores` that is there, to 4 places),
    query_hit_count if missing (how many queries matched), and text_preview. Null fields are left out; a missing list is
    empty. Fields of any other name and type are kept as they are.
    """
    own = [c for c in results.columns if c not in keys and c != metadata]
    inside = [f.name for f in results.schema[metadata].dataType.fields] if metadata in results.columns else []
    score = F.round(F.coalesce(*[F.col(c).cast("double") for c in scores if c in own], F.lit(0.0)), 4)
    fields = {c: F.col(f"{metadata}.`{c}`") for c in inside} | {c: F.col(f"`{c}`") for c in own}
    for c in LISTS:
        fields[c] = F.coalesce(fields[c], F.array()) if c in fields else F.array().cast(RESULT[c])
    fields["query_hit_count"] = F.coalesce(*[fields[c] for c in ("query_hit_count",) if c in fields], F.size(fields["matched_queries"]))
    fields |= {"score": score, "final_score": score}
    if "text" in fields:
        fields["text_preview"] = F.substring(F.array_join(F.filter(F.split(F.coalesce(fields["text"], F.lit("")), r"\s+"), lambda w: w != ""), " "), 1, PREVIEW)
    # JSON text leaves null fields out, which a variant made from the struct itself would keep
    return results.select(*keys, F.parse_json(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))).alias("result"))


def inflated(stored: DataFrame, keys: list[str], result: str = "result", fields: tuple[str, ...] = tuple(METADATA)) -> DataFrame:
    """(keys, the fields of RESULT, metadata, other, older): stored results with their types.

    A result of the older shape has its metadata in an object of that name; the newer has them beside the other fields, and
    these win. A value that its type can't hold is null. Lists that are missing are empty, a missing query_hit_count is the
    number of queries, a missing text is empty. `other` is a map of what is neither known nor derived, as VARIANT, so that
    fields which later versions write survive a round trip; values that are no object have no fields at all.
    """
    v = F.col(result)
    get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)  # noqa: E731  # null where v is no object
    cols = {c: get(c, kind) for c, kind in RESULT.items()}
    for c in LISTS:
        cols[c] = F.coalesce(cols[c], F.array().cast(RESULT[c]))
    cols["query_hit_count"] = F.coalesce(cols["query_hit_count"], F.size(cols["matched_queries"]))
    cols["text"] = F.coalesce(cols["text"], F.lit(""))
    meta = F.struct(*[F.coalesce(get(c, kind), get(f"metadata.{c}", kind)).alias(c) for c, kind in METADATA.items() if c in fields]).alias("metadata")
    known = {*RESULT, *METADATA, *DERIVED, "metadata"}
    whole = F.coalesce(v.try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    other = F.map_filter(whole, lambda k, _: ~k.isin(*sorted(known))).alias("other")
    return stored.select(*keys, *[x.alias(c) for c, x in cols.items()], meta, other, F.coalesce(get("metadata", "variant").isNotNull(), F.lit(False)).alias("older"))


def field(other: Column, name: str, kind: str) -> Column:
    """A field of `other`, typed; null if it is not there or not of that type."""
    return F.try_variant_get(F.element_at(other, name), "$", kind)
