"""Rule answers, validation, confidence, citations, and what is read out of a model's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .filters import given
from .retrieval import ranked
from .routing import alias_matches

LEVELS = ("low", "medium", "high")


def count_with_fallback(rows: DataFrame, by: list[str], item: str, attempts: dict[str, Column]) -> DataFrame:
    """Distinct items of the first attempt (in order) that matches any: strict filters first, relaxed ones after.

    All attempts are counted in one aggregate; no pass is repeated.
    """
    names = list(attempts)
    counts = rows.groupBy(*by).agg(*[F.countDistinct(F.when(test, F.col(item))).alias(n) for n, test in attempts.items()])
    used = F.coalesce(*[F.when(F.col(n) > 0, F.lit(n)) for n in names])
    value = F.coalesce(*[F.when(F.col(n) > 0, F.col(n)) for n in names], F.lit(0))
    return counts.select(*by, value.cast("long").alias("answer"), F.coalesce(used, F.lit("none")).alias("attempt"))


def label_matches(questions: DataFrame, reports: DataFrame, evidence: DataFrame, exact: bool = True) -> DataFrame:
    """(question_id, doc, company, labels): reports that carry one of a question's labels, as a tag or as evidence.

    questions: question_id, labels (array). reports: doc, company, code, tags (array). evidence: doc, label. Labels meet tags
    by equality of their normal form, and evidence the same way or inside a longer label, so all join on the evidence's or
    tag's distinct labels: a vocabulary, not documents.
    """
    asked = questions.select("question_id", F.explode("labels").alias("label")).withColumn("key", X.normalize_text(F.col("label"), exact)).where("key <> ''")
    tags = reports.select("doc", F.explode("tags").alias("tag")).withColumn("key", X.normalize_text(F.col("tag"), exact)).select("doc", "key").distinct()
    said = evidence.select("doc", X.normalize_text(F.col("label"), exact).alias("said")).distinct()
    vocabulary = said.select("said", F.col("said").alias("text")).distinct()
    words = alias_matches(vocabulary, asked.select(F.col("key").alias("alias")).distinct(), "said", fold=False).select("said", F.col("alias").alias("key"))
    by_evidence = said.join(words, "said").select("doc", "key").distinct()
    hit = asked.join(tags.unionByName(by_evidence).distinct(), "key").groupBy("question_id", "doc").agg(F.array_sort(F.collect_set("label")).alias("matched_labels"))
    return hit.join(reports.select("doc", "company", "code"), "doc")


def names_of(matches: DataFrame) -> DataFrame:
    """(question_id, place, company): the companies that answer a question for names, by code (or document) and name."""
    order = [F.coalesce(F.col("code").cast("string"), F.col("doc").cast("string")), F.col("company")]
    return ranked(matches, ["question_id"], *order, name="place").select("question_id", "place", "doc", "company")


def confidence_of_parts(parts: DataFrame, by: str) -> DataFrame:
    """All high: high; any at least medium: medium; else low."""
    out = F.when(F.bool_and(F.col("confidence") == "high"), "high").when(F.bool_or(F.col("confidence").isin("high", "medium")), "medium").otherwise("low")
    return parts.groupBy(by).agg(out.alias("confidence"))


def downgrade(level: Column, steps: Column) -> Column:
    """Down the ladder high, medium, low, and no further; unknown levels are low."""
    at = F.greatest(F.array_position(F.array(*map(F.lit, LEVELS)), F.coalesce(F.lower(level), F.lit("low"))) - 1, F.lit(0))
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.greatest(F.lit(0), at - steps).cast("int") + 1)


def confidence(answer: Column, scores: Column, pages: Column, citations: Column, table: Column, chart: Column, flags: Column) -> Column:
    """From retrieval scores and grounding (fixed thresholds). scores: array in rank order; pages, citations and flags: how
    many; table, chart: grounded in one. Without an answer, or without results, it is low."""
    best, second = F.get(scores, F.lit(0)), F.coalesce(F.get(scores, F.lit(1)), F.lit(0.0))
    sure = (best >= 0.45) & (pages >= 1)
    return (
        F.when(answer.isNull() | (answer == "N/A") | F.coalesce(F.size(scores) <= 0, F.lit(True)), "low")
        .when(table & sure & (flags == 0), "high")
        .when(chart & sure & (flags == 0), "medium")
        .when((best >= 0.8) & (best - second >= 0.08) & (pages >= 1) & (citations >= F.greatest(pages, F.lit(1))), "high")
        .when(sure, "medium")
        .otherwise("low")
    )


def retrieved_sets(results: DataFrame, by: str) -> DataFrame:
    """What a question's results say of themselves: sets of currencies, years, kinds, periods and topics, and their number."""
    kept = lambda c: F.collect_set(F.when(given(F.col(c)), F.col(c)))
    flags = F.array_distinct(F.flatten(F.collect_set(F.coalesce("topic_flags", F.array().cast("array<string>")))))
    return results.groupBy(by).agg(kept("currency").alias("currencies"), kept("report_year").alias("years"), kept("doc_source_type").alias("kinds"), kept("period").alias("periods"), flags.alias("flags_seen"), F.count(F.lit(1)).alias("n_results"))


def periods_agree(asked: Column, seen: Column) -> Column:
    """Either holds the other, in any case; a missing side agrees."""
    a, b = F.lower(asked.cast("string")), F.lower(seen.cast("string"))
    return ~given(asked) | ~given(seen) | F.contains(a, b) | F.contains(b, a)


#: Chunk types that support a number (fixed values).
STRUCTURED = ("serialized_table", "table", "table_grounding", "chart_to_table", "chart_grounding")
#: Checks in order, with what failing one costs: steps down the ladder, or the answer itself (fixed values).
COSTS = {
    "missing_citations": 1, "missing_relevant_pages": 1, "currency_mismatch": "answer", "report_year_mismatch": "answer", "doc_source_type_mismatch": 1, "period_filter_weak_match": 1, "topic_filter_weak_match": 1,
    "numeric_grounding_missing_value": "answer", "numeric_grounding_period_mismatch": "answer", "numeric_grounding_currency_mismatch": "answer", "chart_grounding_low_confidence": 1, "chart_year_mismatch": "answer",
    "chart_unit_mismatch": 1, "numeric_answer_without_structured_grounding": 1, "no_retrieval_results": "level",
}


def validate(answers: DataFrame, results: DataFrame, by: str = "question_id") -> DataFrame:
    """answers plus validation_flags, and with final_answer, confidence, relevant_pages and n_citations as the checks leave them.

    answers: question_id, question, final_answer (string), confidence, relevant_pages (array), n_citations, citation_types
    (array), numeric (the question asks for a number), what was asked (f_currency, f_year, f_doc_source_type, f_period,
    f_topics) and grounding (has_table, table_value, table_period, table_unit, has_chart, chart_value, chart_period,
    chart_unit, chart_confidence). results: by, currency, report_year, doc_source_type, period, topic_flags.

    A hard mismatch takes the answer and its evidence away; soft ones cost a step each.
    """
    rows = answers.join(retrieved_sets(results, by), by, "left")
    c, none = F.col, F.lit(False)
    answered = given(c("final_answer")) & (c("final_answer") != "N/A")
    known = lambda s: F.coalesce(F.size(s) > 0, none)
    lacks = lambda asked, seen: given(asked) & known(seen) & ~F.coalesce(F.array_contains(seen, asked), none)
    number, table = c("numeric") & answered, F.coalesce(c("has_table"), none)
    chart = F.coalesce(c("has_chart"), none) & ~table
    unit = F.upper(F.coalesce("table_unit", F.lit("")))
    other_money = given(c("f_currency")) & (unit != "") & ~F.contains(unit, c("f_currency")) & ~((c("f_currency") == "CNY") & F.contains("table_unit", F.lit("人民币")))
    chart_year = given(c("f_year")) & given(c("chart_period")) & ~F.contains("chart_period", c("f_year").cast("string"))
    bad = {
        "missing_citations": answered & (F.coalesce("n_citations", F.lit(0)) == 0),
        "missing_relevant_pages": answered & ~known(c("relevant_pages")),
        "currency_mismatch": lacks(c("f_currency"), c("currencies")),
        "report_year_mismatch": c("f_year").isNotNull() & known(c("years")) & ~F.coalesce(F.array_contains("years", c("f_year")), none),
        "doc_source_type_mismatch": lacks(c("f_doc_source_type"), c("kinds")),
        "period_filter_weak_match": given(c("f_period")) & known(c("periods")) & ~F.exists("periods", lambda p: periods_agree(c("f_period"), p)),
        "topic_filter_weak_match": known(c("f_topics")) & known(c("flags_seen")) & ~F.arrays_overlap("f_topics", "flags_seen"),
        "numeric_grounding_missing_value": number & ((table & c("table_value").isNull()) | (chart & c("chart_value").isNull())),
        "numeric_grounding_period_mismatch": number & table & ~periods_agree(c("f_period"), c("table_period")),
        "numeric_grounding_currency_mismatch": number & table & other_money,
        "chart_grounding_low_confidence": number & chart & (F.coalesce("chart_confidence", F.lit(0.0)) < 0.7),
        "chart_year_mismatch": number & chart & (chart_year | ~periods_agree(c("f_period"), c("chart_period"))),
        "chart_unit_mismatch": number & chart & c("question").rlike("%|占比|比例") & ~F.contains(F.coalesce("chart_unit", F.lit("")), F.lit("%")),
        "numeric_answer_without_structured_grounding": number & ~table & ~chart & ~F.coalesce(F.arrays_overlap("citation_types", F.array(*map(F.lit, STRUCTURED))), none),
        "no_retrieval_results": F.coalesce("n_results", F.lit(0)) == 0,
    }
    rows = rows.withColumn("validation_flags", validation_flags(**bad))
    hit = lambda kind: F.exists("validation_flags", lambda f: f.isin(*[n for n, k in COSTS.items() if k == kind]))
    steps = F.size(F.filter("validation_flags", lambda f: f.isin(*[n for n, k in COSTS.items() if k == 1])))
    rows = rows.withColumn("lost", hit("answer")).withColumn("n_steps", steps)
    gone = c("lost") | hit("level") | c("final_answer").isNull() | (c("final_answer") == "N/A")
    out = {
        "confidence": F.when(gone, "low").otherwise(downgrade(c("confidence"), c("n_steps"))),
        "final_answer": F.when(c("lost"), "N/A").otherwise(c("final_answer")),
        "relevant_pages": F.when(c("lost"), F.array().cast(dict(answers.dtypes)["relevant_pages"])).otherwise(c("relevant_pages")),
        "n_citations": F.when(c("lost"), 0).otherwise(c("n_citations")),
    }
    return rows.withColumns(out).drop("currencies", "years", "kinds", "periods", "flags_seen", "n_results", "lost", "n_steps")


def dedupe_last(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """One row per key: the last value, at the place where the key first stood."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.min(order).alias(order))


def repair_pages(claimed: Column, retrieved: Column, least: int = 1, most: int = 8) -> Column:
    """Claimed pages that were retrieved, repeats included; if fewer than `least`, the best other retrieved pages follow
    until there are so many; `most` at most."""
    good = F.filter(claimed, lambda p: F.array_contains(retrieved, p))
    more = F.slice(F.array_except(retrieved, good), F.lit(1), F.greatest(F.lit(least) - F.size(good), F.lit(0)))
    return F.slice(F.concat(good, more), 1, most)


def compare_values(a: Column, b: Column, first: Column, second: Column) -> Column:
    """Who is higher: ties favour the one named first; unknown if a value is missing."""
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a >= b, first).otherwise(second)


def exceeds(value: Column, threshold: Column) -> Column:
    """Strictly greater."""
    return value > threshold


def validation_flags(**bad: Column) -> Column:
    """Names of the checks that failed, in order; a missing value fails nothing."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in bad.items()]))


def inject_missing(results: DataFrame, grounded: DataFrame, by: str, keys: list[str], support: DataFrame | None = None) -> DataFrame:
    """Grounding rows whose keys (such as document and page) a question's results lack come first, with full score; support
    rows come after all results, one per key. Ranks count on from 1."""
    have = results.select(by, *keys).distinct()
    full = lambda df, part, kind: df.withColumn("score", F.lit(1.0)).withColumn("source", F.lit(kind)).withColumn("__part", F.lit(part))
    first = full(grounded.dropna(subset=keys).join(have, [by, *keys], "left_anti").withColumn("rank", F.lit(0)), 0, "grounding")
    out = first.unionByName(results.withColumn("__part", F.lit(1)), allowMissingColumns=True)
    if support is not None:
        seen = have.unionByName(grounded.select(by, *keys)).distinct()
        new = ranked(support.dropna(subset=keys).join(seen, [by, *keys], "left_anti"), [by, *keys], F.col("rank"), top=1, name="__k").drop("__k")
        out = out.unionByName(full(new, 2, "support"), allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy("__part", "rank", *keys)
    return out.withColumn("rank", F.row_number().over(order)).drop("__part")


def citations(rows: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """First citation of each page, in rank order."""
    w = Window.partitionBy(*by, "page").orderBy("rank")
    one = rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    order = Window.partitionBy(*by).orderBy("rank", "page")
    return one.withColumn("citation", F.row_number().over(order)).where(F.col("citation") <= most)


def references(pages: DataFrame, results: DataFrame, by: str) -> DataFrame:
    """(by, doc, page, place): the distinct documents and pages among a question's results that its answer relies on.

    pages: by, page. results: by, doc, page, rank.
    """
    hit = results.join(pages.select(by, "page").distinct(), [by, "page"]).groupBy(by, "doc", "page").agg(F.min("rank").alias("first"))
    return ranked(hit, [by], F.col("first"), F.col("doc"), F.col("page"), name="place").drop("first")


def references_of_document(answers: DataFrame, by: str) -> DataFrame:
    """(by, doc, page, place): every page, in order, of an answer about one document (columns doc, relevant_pages)."""
    return answers.select(by, "doc", F.posexplode("relevant_pages").alias("place", "page")).select(by, "doc", "page", (F.col("place") + 1).alias("place"))


def selected_document(selected: Column, candidates: Column, of_company: Column) -> Column:
    """The report that routing selected, else the only candidate, else the company's."""
    return F.coalesce(F.when(given(selected), selected.cast("string")), F.when(F.size(candidates) == 1, F.get(candidates, F.lit(0)).cast("string")), of_company.cast("string"))


def newest_report(reports: DataFrame, company: str, year: Column | None = None, kind: Column | None = None) -> DataFrame:
    """One report per company: of those of the year and kind asked for (unknown ones pass) the latest, ties by document."""
    rows = reports
    if year is not None:
        rows = rows.where(F.col("report_year").isNull() | year.isNull() | (F.col("report_year") == year))
    if kind is not None:
        rows = rows.where(~given(F.col("doc_source_type")) | ~given(kind) | (F.col("doc_source_type") == kind))
    return ranked(rows, [company], F.col("report_year").desc_nulls_last(), F.col("doc").desc(), top=1).drop("rank")


def citation_page(pages: Column) -> Column:
    """The page that a label's evidence is cited by: the least of the first three pages, else the second."""
    front = F.array_min(F.filter(pages, lambda p: p.between(1, 3)))
    return F.coalesce(front, F.lit(2))


#: Aliases that are evidence of a label (fixed values).
LABEL_ALIASES = {
    "国产替代": ["国产替代", "国产化", "自主可控", "信创"], "数字化转型": ["数字化转型", "数字化", "数智化"], "出海": ["出海", "海外", "海外市场", "海外业务", "国际化", "境外"],
    "绿色转型": ["绿色转型", "绿色低碳", "双碳", "碳中和"], "人工智能": ["人工智能", "AI", "大模型"],
}


def label_terms(label: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """A label and its aliases, distinct, in order."""
    extra = F.array().cast("array<string>")
    for name, terms in (LABEL_ALIASES if aliases is None else aliases).items():
        extra = F.when(label == name, F.array(*map(F.lit, terms))).otherwise(extra)
    return F.array_distinct(F.concat(F.array(F.trim(label)), extra))


def label_evidence(labels: DataFrame, pages: DataFrame, aliases: dict[str, list[str]] | None = None, doc: str = "doc") -> DataFrame:
    """Where a report first bears out each of its labels: the first of the label's terms that any page holds, on the first
    such page; without one a row with has_literal_evidence false. labels: doc, label. pages: doc, page, text.

    Labels meet only the pages of their own document.
    """
    terms = labels.select(doc, "label").distinct().select(doc, "label", F.posexplode(label_terms(F.col("label"), aliases)).alias("term_no", "term")).where("term <> ''")
    hit = terms.join(pages.select(doc, "page", "text"), doc).where(X.position_of(F.col("term"), F.col("text")) > 0)
    first = ranked(hit, [doc, "label"], F.col("term_no"), F.col("page"), top=1).select(doc, "label", F.col("page").alias("evidence_page"), F.col("term").alias("match_term"), X.snippet_around(F.col("term"), F.col("text")).alias("evidence_snippet"))
    out = labels.select(doc, "label").distinct().join(first, [doc, "label"], "left")
    return out.withColumn("evidence_snippet", F.coalesce("evidence_snippet", F.lit(""))).withColumn("has_literal_evidence", F.col("match_term").isNotNull())


def literal_evidence(tag: Column, text: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """A tag, or one of its aliases, stands in a text; plain ASCII ones in any case."""
    return F.exists(label_terms(tag, aliases), lambda t: (t != "") & (X.position_of(t, F.coalesce(text, F.lit(""))) > 0))


# -- rules over a document's pages ---------------------------------------------------------------------------------------

#: Lines that speak of another than the present representative, patterns by falling score, signs of pages that name them (fixed values).
NOT_PRESENT = "辞去法定代表人|曾任法定代表人|原法定代表人|不再担任法定代表人|变更法定代表人|法定代表人变更|历任|任职表|履历|简历"
PERSON_PATTERNS = {
    "explicit_legal_representative": (r"(?:公司(?:的)?法定代表人|法定代表人|法人代表)\s*(?:[:：|]\s*)+([一-鿿·]{2,8})", 100.0),
    "signed_legal_representative": (r"([一-鿿·]{2,8})\s*(?:法定代表人|法人代表)(?=[、,，\s|]|$)", 84.0),
    "company_leader_fallback": (r"公司负责人\s*(?:[:：|]\s*)?([一-鿿·]{2,8})(?=[、,，\s|及声明]|$)", 62.0),
}
COMPANY_PAGE, TITLES = "公司简介|公司基本情况|公司信息|主要财务指标", "(?:先生|女士|博士|教授|董事长|副董事长|行长|董事|总经理|负责人)$"


def person_name(raw: Column) -> Column:
    """A person's name without signs and titles; null for what is none."""
    flat = F.regexp_replace(raw, r"^[\s|:：,，。；;]+|[\s|:：,，。；;]+$", "")
    flat = F.trim(F.regexp_extract(flat, r"^[^|、,，。；;\s]*", 0), F.lit("为系：:"))
    name = F.regexp_replace(F.regexp_extract(flat, r"^[一-鿿·]{2,8}", 0), TITLES, "")
    return F.when((F.length(name) >= 2) & ~name.rlike("公司|负责人|法定|代表人"), name)


def legal_representative(pages: DataFrame, doc: str = "doc", exact: bool = True) -> DataFrame:
    """(doc, name, page, match_type, score, snippet): who represents a company, by the best line of its report: the pattern's
    score and what its page is worth; ties go to what stands first."""
    flat = X.normalize_text(F.col("text"), exact)
    worth = F.when(F.col("page") <= 20, 18.0).otherwise(0.0) + F.when(flat.rlike(COMPANY_PAGE), 14.0).otherwise(0.0) + F.when(flat.rlike("财务报告") & flat.rlike("公司负责人"), 8.0).otherwise(0.0)
    rows = pages.where(F.col("text").rlike("法定代表|法人代表|公司负责")).select(doc, "page", worth.alias("worth"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("flat", F.replace(X.squeezed(F.col("line"), exact), F.lit("⼈"), F.lit("人"))).where(F.col("flat").rlike("法定代表人|法人代表|公司负责人") & ~F.col("flat").rlike(NOT_PRESENT))
    found = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(n).alias("match_type"), F.lit(s).alias("base"), person_name(F.regexp_extract("flat", p, 1)).alias("name")) for i, (n, (p, s)) in enumerate(PERSON_PATTERNS.items())])
    rows = rows.select(doc, "page", "line_no", "line", "worth", F.explode(found).alias("f")).where("f.name is not null").withColumn("score", F.col("f.base") + F.col("worth"))
    best = ranked(rows, [doc], F.col("score").desc(), F.col("page"), F.col("line_no"), F.col("f.no"), top=1)
    return best.select(doc, F.col("f.name").alias("name"), "page", F.col("f.match_type").alias("match_type"), F.round("score", 4).alias("score"), F.substring(F.trim("line"), 1, 500).alias("snippet"))


#: Terms of a cash dividend, and of the pages that decide on one (fixed values).
DIVIDEND_TERMS = ("现金分红", "现金红利", "现金股利", "派发股息", "派发现金红利", "每10股派发", "每 10 股派发", "每10股派息", "每 10 股派息")
DIVIDEND_PAGE = "利润分配预案|利润分配|重要提示|重要事项"


def dividend_mention(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, page, term, score, snippet): the page that best shows that a cash dividend is mentioned, ties by page."""
    rows = pages.withColumn("term", X.first_held(F.col("text"), DIVIDEND_TERMS)).where("term is not null")
    score = F.lit(50.0) + F.when(F.col("page") <= 5, 20.0).otherwise(0.0) + F.when(F.col("text").rlike(DIVIDEND_PAGE), 10.0).otherwise(0.0)
    best = ranked(rows.withColumn("score", score), [doc], F.col("score").desc(), F.col("page"), top=1)
    line = F.trim(F.get(F.filter(F.split("text", "\n"), lambda s: F.contains(s, F.col("term"))), F.lit(0)))
    return best.select(doc, "page", "term", "score", F.substring(F.coalesce(line, "text"), 1, 500).alias("snippet"))


# -- what a model's text says --------------------------------------------------------------------------------------------

_VALUE = r"""(\[[^\]]*\]|"(?:\\.|[^"])*"|'(?:\\.|[^'])*'|true|false|null|-?\d+(?:\.\d+)?)"""


def last_json_value(text: Column, key: str) -> Column:
    """The last value that a key has in free text, as JSON: a list, a string, a number or a literal; null counts as none."""
    found = F.regexp_extract_all(text, F.lit(rf"""(?is)["']?{key}["']?\s*:\s*{_VALUE}"""), F.lit(1))
    known = F.filter(found, lambda v: F.lower(v) != "null")
    return F.element_at(F.when(F.size(known) > 0, known), -1)


def _unquoted(value: Column) -> Column:
    """The content of a quoted value; null for any other."""
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    return F.when(value.rlike("""^["']"""), F.regexp_replace(F.regexp_replace(inner, r'\\"', '"'), r"\\n", "\n"))


def _of_keys(text: Column, test) -> Column:
    return F.coalesce(*[F.when(test(v), v) for v in (last_json_value(text, k) for k in ("final_answer", "answer"))])


_SAID = r"(?i)(?:answer should be|final answer(?:\s+should\s+be|\s+is|:)|答案(?:应为|为|是))\s*"


def string_answer(text: Column) -> Column:
    """The answer as text: of the key final_answer or answer, else what the text says that it is."""
    keyed = F.nullif(F.trim(_unquoted(_of_keys(text, lambda v: v.rlike("""^["']\\s*[^\\s"']""")))), F.lit(""))
    return F.coalesce(keyed, F.nullif(F.trim(F.regexp_extract(text, _SAID + r'["“]?([^"\n”]+)["”]?', 1)), F.lit("")))


def number_answer(text: Column) -> Column:
    keyed = _of_keys(text, lambda v: v.rlike(r"^-?\d"))
    return F.coalesce(keyed, F.nullif(F.regexp_extract(text, _SAID + r"(-?\d+(?:\.\d+)?)", 1), F.lit(""))).try_cast("double")


def bool_answer(text: Column) -> Column:
    keyed = _of_keys(text, lambda v: F.lower(v).isin("true", "false"))
    says = lambda word: text.rlike(_SAID + rf"{word}\b")
    return F.coalesce(F.lower(keyed) == "true", F.when(says("true"), True).when(says("false"), False))


def list_answer(text: Column) -> Column:
    """The answer as a list of texts: of its key, else the names that lines of the text begin with; null without any."""
    keyed = F.from_json(_of_keys(text, lambda v: v.rlike(r'^\[\s*"')), "array<string>")
    keyed = F.filter(F.transform(keyed, lambda x: F.trim(x)), lambda x: x != "")
    line = F.transform(F.split(text, r"\r\n|[\n\r]"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(s), r"^\d+\.\s*", ""), r"^[-*]\s*", ""), r"\s*\([^)]*\)\s*$", "")))
    line = F.filter(line, lambda s: (F.length(s) >= 2) & s.rlike("[一-鿿]{2,}") & ~F.lower(s).rlike("question|answer|reasoning|schema|page|context") & ~s.rlike("^(?:问题|检索|上下文|根据|给定|返回|因此|故|说明|无法|未发现)"))
    entity = r"(?i)^([一-鿿A-Za-z0-9（）()·\-/]{2,}?)(?:\s+(?:mentioned|mentions|提到|指出|列出)(?![A-Za-z0-9_一-鿿])|[，,:：]|$)"
    name = lambda s: F.trim(F.coalesce(F.nullif(F.regexp_extract(s, entity, 1), F.lit("")), F.regexp_extract(s, "^[^，,:：]*", 0)), F.lit(" \"'“”"))
    names = F.array_distinct(F.filter(F.transform(line, name), lambda s: F.length(s) >= 2))
    return F.coalesce(F.when(F.size(keyed) > 0, keyed), F.when(F.size(names) > 0, names))


def pages_said(text: Column) -> Column:
    """Distinct positive page numbers that a text names: of the key relevant_pages, then in lists, in Chinese, one by one."""
    numbers = lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    listed = last_json_value(text, "relevant_pages")
    parts = [F.when(listed.startswith("["), numbers(listed)).otherwise(F.array().cast("array<int>"))]
    for pattern in (r"(?i)\bpages\s+((?:\d+\s*,\s*)+\d+)\b", r"第\s*(\d+)\s*页", r"(?i)\bpage\s+(\d+)\b"):
        parts.append(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), numbers)))
    return F.array_distinct(F.filter(F.concat(*parts), lambda p: p > 0))


#: How a text says that there is no answer (fixed values).
NO_ANSWER = r"""(?i)(?:answer should be|final answer(?:\s+should\s+be|\s+is|:)|return(?:ed|s)?|返回|应返回|故返回|因此返回|最终(?:答案|结论)(?:应为|为|是)?|答案(?:应为|为|是))\s*["`]?N/A["`]?"""


def not_available(text: Column) -> Column:
    """A text that says, by its key or in its last 1200 characters, that there is no answer."""
    keyed = F.upper(F.trim(F.coalesce(_unquoted(_of_keys(text, lambda v: F.upper(v).rlike("""^["']\\s*N/A\\s*["']$"""))), F.lit(""))))
    flat = F.trim(text, F.lit(" \t\n\r\x0b\f"))
    return (keyed == "N/A") | F.substring(flat, F.greatest(F.length(flat) - 1199, F.lit(1)), F.lit(1200)).rlike(NO_ANSWER)


def structured_answer(text: Column, kind: Column) -> dict[str, Column]:
    """(value as text, pages) of a model's free text for a question's kind; N/A where it says that there is none."""
    value = F.when(kind == "names", F.to_json(list_answer(text))).when(kind == "boolean", bool_answer(text).cast("string")).when(kind == "number", number_answer(text).cast("string")).otherwise(string_answer(text))
    value = F.coalesce(value, F.when(not_available(text), "N/A"))
    return {"value": value, "pages": F.when(F.coalesce(value == "N/A", F.lit(False)) | value.isNull(), F.array().cast("array<int>")).otherwise(pages_said(text))}
