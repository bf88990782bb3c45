"""Metadata predicates with their rules for missing values."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import currency_token, normalize_text, first_number, nfkc, parse_numeric, without_commas

EMPTY = "array<string>"


def given(value: Column) -> Column:
    """True for what is neither null nor empty."""
    return F.coalesce(value.cast("string") != "", F.lit(False))


def permissive(column: Column, value) -> Column:
    """A scalar filter rejects only what is known to differ: a missing row value passes."""
    return ~given(column) | (column == (value if isinstance(value, Column) else F.lit(value)))


def _holds(x: Column, y: Column) -> Column:
    return F.contains(x, y) | F.contains(y, x)


def bi_contains(a: Column, b: Column, exact: bool = True) -> Column:
    """Either normalised text holds the other; a missing side passes."""
    return ~given(a) | ~given(b) | _holds(normalize_text(a, exact), normalize_text(b, exact))


def normal_list(items: Column) -> Column:
    """Normalised items that hold something, without the compatibility form, which needs Python: lists that may need it are
    to be brought to it when they are read."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast(EMPTY)), lambda t: normalize_text(t, False)), lambda t: t != "")


def tags_match(observed: Column, expected: Column) -> Column:
    """Every expected tag contains, or is contained in, some observed one; nothing expected passes, nothing observed fails."""
    seen, want = normal_list(observed), normal_list(expected)
    none = F.coalesce(F.size(expected) <= 0, F.lit(True))
    return none | ((F.size(seen) > 0) & F.forall(want, lambda e: F.exists(seen, lambda o: _holds(o, e))))


def section_matches(expected: Column, *columns: Column, exact: bool = True) -> Column:
    """Some section column matches both ways; rejected when none is present, passed when nothing is expected."""
    want = normalize_text(expected, exact)
    tests = [given(c) & _holds(normalize_text(c, exact), want) for c in columns]
    some = tests[0]
    for t in tests[1:]:
        some = some | t
    return ~given(expected) | some


def flags_cover(flags: Column, required: Column) -> Column:
    none = F.coalesce(F.size(required) <= 0, F.lit(True))
    return none | (F.size(F.array_except(required, F.coalesce(flags, F.array().cast(EMPTY)))) == 0)


def member(doc: Column, allowed: Column) -> Column:
    """A document among the allowed ones; a missing id fails, no list passes."""
    return F.coalesce(F.size(allowed) <= 0, F.lit(True)) | F.coalesce(F.array_contains(allowed, doc), F.lit(False))


def truthy(value: Column) -> Column:
    """Fixed values that count as true."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y", "on"), F.lit(False))


def topic_flags(df: DataFrame) -> Column:
    """Sorted names of the has_* and mentions_* columns that hold something true."""
    names = [c for c in df.columns if c.startswith(("has_", "mentions_"))]
    return F.array_sort(F.array_compact(F.array(*[F.when(truthy(F.col(c)), F.lit(c)) for c in names]))) if names else F.array().cast(EMPTY)


@dataclass
class Filters:
    """What a question asks of a result's metadata; None or an empty list asks nothing. Values are literals or columns."""

    company_name: object = None
    currency: object = None
    year: object = None
    report_type: object = None
    doc_source_type: object = None
    major_industry: object = None
    exchange: object = None
    board: object = None
    market_type: object = None
    industry_l1: object = None
    industry_l2: object = None
    security_code: object = None
    broker_name: object = None
    period: object = None
    section_name: object = None
    chain_position_major: object = None
    business_tags: list = field(default_factory=list)
    strategy_tags: list = field(default_factory=list)
    factor_tags: list = field(default_factory=list)
    chain_position_minor: list = field(default_factory=list)
    listing_tags: list = field(default_factory=list)
    ownership_tags: list = field(default_factory=list)
    status_tags: list = field(default_factory=list)
    style_tags: list = field(default_factory=list)
    required_topic_flags: list = field(default_factory=list)
    candidate_doc_ids: list = field(default_factory=list)


#: How each field is compared (fixed values): equal, as text both ways, as lists; sections and the rest have rules of their own.
EQUAL = ("company_name", "broker_name", "period")
TEXT = ("report_type", "doc_source_type", "major_industry", "exchange", "board", "market_type", "industry_l1", "industry_l2", "chain_position_major")
LISTS = ("business_tags", "strategy_tags", "factor_tags", "chain_position_minor", "listing_tags", "ownership_tags", "status_tags", "style_tags")
SECTIONS = ("section_name", "section_title", "report_section", "section_leaf", "section_path", "section_l1", "section_l2", "section_l3")


def _value(x) -> Column:
    return x if isinstance(x, Column) else F.array(*map(F.lit, x)).cast(EMPTY) if isinstance(x, (list, tuple)) else F.lit(x)


def _asked(x) -> bool:
    return isinstance(x, Column) or (x is not None and x != "" and x != [])


def matches(rows: DataFrame, want: Filters, exact: bool = True) -> Column:
    """The conjunction of all filters over a result's metadata columns; columns that rows lack are missing values.

    Scalars reject only what is known to differ, lists and sections also what is missing, a list of documents what has none.
    """
    have = set(rows.columns)
    col = lambda c, kind="string": F.col(f"`{c}`") if c in have else F.lit(None).cast(kind)
    tests = []
    for f in fields(want):
        v = getattr(want, f.name)
        if not _asked(v):
            continue
        v, name = _value(v), f.name
        if name in EQUAL:
            tests.append(~given(v) | permissive(col(name), v))
        elif name == "currency":
            tests.append(~given(v) | permissive(col(name), currency_token(v, exact)))
        elif name == "year":
            tests.append(v.isNull() | col("report_year", "int").isNull() | (col("report_year", "int") == v))
        elif name in TEXT:
            tests.append(bi_contains(v, col(name), exact))
        elif name == "security_code":
            code = F.coalesce(*[F.when(given(col(c)), col(c).cast("string")) for c in ("security_code", "stock_code")])
            tests.append(~given(v) | code.isNull() | (code == v.cast("string")))
        elif name == "section_name":
            tests.append(section_matches(v, *[col(c) for c in SECTIONS if c in have] or [F.lit(None).cast("string")], exact=exact))
        elif name in LISTS:
            tests.append(tags_match(col(name, EMPTY), v))
        elif name == "required_topic_flags":
            tests.append(flags_cover(col("topic_flags", EMPTY), v))
        elif name == "candidate_doc_ids":
            tests.append(member(col("doc_id").cast("string"), v))
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(True))
    return out


def _prefixed(name: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.concat(F.lit(f"{name}:"), x))


#: What a catalog filter compares, and the order in which its reasons are named.
CATALOG_TEXT = ("exchange", "board", "market_type", "industry_l1", "industry_l2", "chain_position_major")


def catalog_matches(rows: DataFrame, want: Filters, exact: bool = True) -> tuple[Column, Column]:
    """(passes, reasons) of a catalog entry: document kinds and years must be equal where known, text and lists as in
    matches(). Reasons name what was asked and passed; an entry that fails has none."""
    have = set(rows.columns)
    col = lambda c, kind="string": F.col(f"`{c}`") if c in have else F.lit(None).cast(kind)
    year = F.coalesce(*[F.when(given(col(c)), col(c).cast("string")) for c in ("report_year", "fiscal_year")]).try_cast("int")
    tests, names = [], []
    if _asked(want.doc_source_type):
        tests.append(permissive(col("doc_source_type"), _value(want.doc_source_type)))
    if _asked(want.year):
        tests.append(year.isNull() | (year == _value(want.year)))
        names.append(F.when(year == _value(want.year), F.lit("year_filter_match")))
    for n in CATALOG_TEXT:
        if _asked(getattr(want, n)):
            tests.append(bi_contains(_value(getattr(want, n)), col(n), exact))
            names.append(F.when(given(_value(getattr(want, n))), F.lit(f"{n}_filter_match")))
    names = [F.array_compact(F.array(*names)) if names else F.array().cast(EMPTY)]
    for n in LISTS:
        if _asked(getattr(want, n)):
            v = _value(getattr(want, n))
            tests.append(tags_match(col(n, EMPTY), v))
            names.append(_prefixed(n, v))
    if _asked(want.doc_source_type):
        names.append(F.array(F.lit("doc_source_type_filter_match")))
    passes = F.lit(True)
    for t in tests:
        passes = passes & F.coalesce(t, F.lit(True))
    return passes, F.when(passes, F.concat(*names)).otherwise(F.array().cast(EMPTY))


def kind_bonus(kind: Column, chunk_type: Column, flagged: Column | None = None) -> Column:
    """Bonus of a chunk for a question's kind (fixed values). flagged: the chunk has one of the topics asked for."""
    number = F.when(chunk_type == "serialized_table", 0.12).when(chunk_type == "table", 0.10).when(chunk_type == "chart_to_table", 0.08).otherwise(0.0)
    content = F.coalesce(chunk_type == "content", F.lit(False))
    topic = F.coalesce(flagged, F.lit(False)) if flagged is not None else F.lit(False)
    boolean = F.when(topic, 0.08).when(content, 0.02).otherwise(0.0)
    return F.when(kind == "number", number).when(kind == "boolean", boolean).when(kind.isin("name", "names") & content, 0.04).otherwise(0.0)


def with_bonus(rows: DataFrame, kind: Column, chunk_type: Column, flagged: Column | None = None, score: str = "score") -> DataFrame:
    """rows plus filter_bonus and ranking_score, by which filtered results are ordered again."""
    bonus = F.round(kind_bonus(kind, chunk_type, flagged), 4)
    return rows.withColumn("filter_bonus", bonus).withColumn("ranking_score", F.round(F.col(score) + F.col("filter_bonus"), 4))


def reasons(**tests: Column) -> Column:
    """Names of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))


#: What a cell may look like to count as a number, and words that make it a date.
NUMBER_CELL = r"^\s*[(（]?\s*[-+]?\d[\d,，]*(?:\.\d+)?\s*[)）]?\s*(?:%|％|元|万元|亿元|千元|百万元|千万元)?\s*$"
DATE_WORDS = "年|报告期"


def is_numeric_cell(raw: Column, question: Column | None = None, exact: bool = True) -> Column:
    """A cell that is a number: at most 48 characters, no run of seven ideographs, no word of dates, a percentage only if
    the question speaks of one."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    percent = F.coalesce(F.contains(question, F.lit("%")), F.lit(False)) if question is not None else F.lit(False)
    good = (F.length(text) <= 48) & ~text.rlike("[一-鿿]{7,}") & ~text.rlike(DATE_WORDS) & (percent | ~text.rlike("[%％]"))
    return good & text.rlike(NUMBER_CELL) & first_number(without_commas(nfkc(text) if exact else text)).isNotNull()


def value_matches(observed: Column, expected, is_list: bool = False) -> Column:
    """One of the expected values is observed, or among the observed list; text values compare as they are."""
    want = F.array(*map(F.lit, expected if isinstance(expected, (list, tuple)) else [expected]))
    return F.coalesce(F.arrays_overlap(observed, want) if is_list else F.array_contains(want, observed), F.lit(False))


def mix_select(rows: DataFrame, match: dict, exclude: dict) -> Column:
    """Rows of a mix's part: every field of `match` has one of its values, no field of `exclude` has one."""
    kinds, out = dict(rows.dtypes), F.lit(True)
    for name, values in match.items():
        out = out & value_matches(F.col(name), values, kinds[name].startswith("array"))
    for name, values in exclude.items():
        out = out & ~value_matches(F.col(name), values, kinds[name].startswith("array"))
    return out
