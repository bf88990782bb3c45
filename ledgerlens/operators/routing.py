"""Which documents a question is about: rewriting, alias matching, catalog scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import char_ngrams, currency_token, in_parts, normalize_text, period_token, query_fingerprint, security_codes
from .retrieval import ranked

#: Weights of a catalog match (fixed values).
WEIGHTS = {"name": 6.0, "alias": 5.0, "code": 5.5, "doc_type": 2.5, "report_type": 1.5, "year": 2.0, "currency": 1.0, "industry": 1.0, "broker": 1.5, "title": 2.0, "language": 0.2}


def catalog_score(**matches: Column) -> Column:
    """Sum of the weights of the matches that hold."""
    total = F.lit(0.0)
    for name, test in matches.items():
        total = total + F.when(F.coalesce(test, F.lit(False)), F.lit(WEIGHTS[name])).otherwise(0.0)
    return F.round(total, 4)


def catalog_topk(pairs: DataFrame, by: list[str], top: int, *ties: Column) -> DataFrame:
    """Candidates with a positive score, best first; ties as given, in falling order."""
    return ranked(pairs.where(F.col("score") > 0), by, F.col("score").desc(), *ties, top=top)


#: Characters of the pieces by which names and texts meet.
GRAM = 5
#: Names that every task may hold as one automaton: so many, and so many characters in all. Their number is counted first.
NAMES, NAME_CHARS = 100_000, 2_000_000


def alias_matches(texts: DataFrame, aliases: DataFrame, key: str, fold: bool = True, exact: bool = True) -> DataFrame:
    """(key, alias, position): names that stand anywhere in a text, inside longer words too, with their first position.

    Up to NAMES names go to every task as one automaton, which passes over each text once, whatever their number; texts
    don't move. More names meet the texts by equality of pieces (_by_pieces). Both ways give the same rows. fold: both sides
    in their normal form, else as they are. Null texts hold nothing, null and empty names are nowhere.
    """
    form = (lambda c: normalize_text(c, exact)) if fold else (lambda c: c)
    names = aliases.select(F.col("alias").cast("string").alias("alias"), form(F.col("alias")).alias("name")).where("name <> ''").distinct()
    low = texts.select(key, form(F.col("text")).alias("low"))
    size = names.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("name") + F.length("alias")), F.lit(0)).alias("chars")).first()
    if size["n"] > NAMES or size["chars"] > NAME_CHARS:
        return _by_pieces(low, names, key)
    by_name: dict[str, list[str]] = {}
    for alias, name in sorted(tuple(r) for r in names.collect()):
        by_name.setdefault(name, []).append(alias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for name, said in by_name.items():
            found.add_word(name, (len(name), said))
        if by_name:
            found.make_automaton()
        for batch in in_parts(batches, 1):
            row, alias, position = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist() if by_name else ()):
                seen: set[str] = set()
                for end, (n, said) in found.iter(text or ""):
                    if said[0] not in seen:  # the first place a name ends is the first it begins
                        seen.add(said[0])
                        row += [i] * len(said)
                        alias += said
                        position += [end - n + 2] * len(said)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(alias, pa.string()), pa.array(position, pa.int64())], [key, "alias", "position"])

    return low.mapInArrow(run, T.StructType([low.schema[key], T.StructField("alias", T.StringType()), T.StructField("position", T.LongType())]))


def _by_pieces(low: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """alias_matches() for any number of names.

    Of every name one piece of GRAM characters (the whole name, if shorter) is a key: of its pieces the one that the fewest
    texts hold. Texts meet these keys by equality on their own pieces; only pairs that share a piece are compared, and no
    text with every name.
    """
    sizes = sorted(r[0] for r in names.select(F.least(F.length("name"), F.lit(GRAM))).distinct().collect())  # GRAM values at most
    if not sizes:
        return low.select(key, F.lit(None).cast("string").alias("alias"), F.lit(0).cast("long").alias("position")).where("false")
    pieces = lambda c, n: char_ngrams(c, n)
    of_name = F.lit(None).cast("array<string>")
    for n in sizes:
        of_name = F.when(F.least(F.length("name"), F.lit(GRAM)) == n, F.array_distinct(pieces(F.col("name"), n))).otherwise(of_name)
    named = names.select("alias", "name", F.explode(of_name).alias("piece"))
    held = low.select(key, F.explode(F.array_distinct(F.concat(*[pieces(F.col("low"), n) for n in sizes]))).alias("piece"))
    # a piece in no text settles its names at once
    df = held.join(named.select("piece").distinct(), "piece").groupBy("piece").agg(F.count(F.lit(1)).alias("df"))
    rare = ranked(named.join(df, "piece", "left"), ["alias"], F.coalesce("df", F.lit(0)), F.col("piece"), top=1).where("df is not null").select("alias", "name", "piece")
    pairs = held.join(rare, "piece").groupBy(key).agg(F.collect_set(F.struct("alias", "name")).alias("names"))
    found = low.join(pairs, key).select(key, "low", F.explode("names").alias("n"))
    found = found.select(key, F.col("n.alias").alias("alias"), F.expr("instr(low, n.name)").cast("long").alias("position"))
    return found.where("position > 0")


def companies_in_order(matches: DataFrame, companies: DataFrame, key: str) -> DataFrame:
    """(key, company, position, place): companies that a text names by any alias, each once, by their first position.
    companies: company, alias."""
    first = matches.join(companies, "alias").groupBy(key, "company").agg(F.min("position").alias("position"))
    return ranked(first, [key], F.col("position"), F.col("company"), name="place")


#: What names an exchange, board, market, chain position, section, topic or tag in a question, the first that fits (fixed values).
EXCHANGES = {"上海证券交易所": "上海证券交易所|上交所|sse", "深圳证券交易所": "深圳证券交易所|深交所|szse", "北京证券交易所": "北京证券交易所|北交所|bse"}
BOARDS = {"科创板": "科创板", "创业板": "创业板", "沪主板": "沪主板|上海主板", "深主板": "深主板|深圳主板", "北交所": "北交所|北京证券交易所"}
MARKETS = {"A股": "a股|a 股", "H股": "h股|h 股", "港股": "港股"}
CHAIN = {"上游资源": "上游", "中游制造": "中游", "下游应用": "下游"}
DOC_TYPES = {"research_report": "研报|券商|深度报告|首次覆盖|点评报告", "annual_report": "年报|年度报告|annual report", "interim_report": "中报|半年报|季报|q1|q2|q3|q4"}
REPORT_TYPES = {"annual": "annual report|年报|年度报告", "interim": "中报|半年报", "quarterly": "季报|q1|q2|q3|q4"}
SECTION_HINTS = "管理层讨论与分析 公司简介和主要财务指标 重要事项 公司治理 财务报告 释义 股份变动及股东情况 风险提示".split()
TOPICS = {
    "mentions_recent_mergers_and_acquisitions": "mergers or acquisitions|mergers and acquisitions|m&a|acquisition|merger|并购|收购|兼并",
    "has_leadership_changes": "leadership|executive|management changes|board changes|ceo|cfo|管理层变动|董事变更|高管变更",
    "has_dividend_policy_changes": "dividend policy|dividend strategy|dividend framework|dividend changes|分红|股利|派息",
    "has_share_buyback_plans": "share buyback|share repurchase|repurchase program|buyback plan|回购|股份回购", "has_guidance_updates": "guidance|outlook|forecast|指引|业绩预告|展望",
    "has_regulatory_or_litigation_issues": "litigation|lawsuit|regulatory|investigation|诉讼|监管|调查",
}
TAG_WORDS = {
    "strategy_tags": {"出海": "出海|海外|国际化|境外", "数字化转型": "数字化|数智化|数字化转型", "人工智能": "人工智能|ai|大模型", "绿色转型": "绿色转型|绿色低碳|双碳|碳中和", "国产替代": "国产替代|自主可控|国产化"},
    "listing_tags": {"A股": "a股|a 股", "科创板": "科创板", "创业板": "创业板", "沪主板": "沪主板|上海主板", "深主板": "深主板|深圳主板"}, "status_tags": {"龙头": "龙头|龙头候选"}, "factor_tags": {"高资本开支": "资本开支|capex"},
}
#: Other words for terms of a question (fixed values).
SYNONYMS = {
    "operating margin": ["operating profit margin"], "gross margin": ["gross profit margin"], "share buyback": ["share repurchase", "repurchase program"], "mergers or acquisitions": ["m&a", "acquisition", "merger"],
    "营业收入": ["营收", "收入"], "归母净利润": ["母公司股东净利润", "归属于母公司股东的净利润", "归母"], "扣非归母净利润": ["扣非净利润", "归母扣非净利润"], "毛利率": ["综合毛利率"], "净利率": ["销售净利率"], "期间费用率": ["费用率"],
    "经营活动现金流净额": ["经营现金流净额", "经营性现金流净额"], "分红": ["派息", "股利", "现金分红"], "回购": ["股份回购", "股票回购"], "并购": ["收购", "兼并", "并表交易"], "定增": ["非公开发行", "再融资"],
}


def _holds(text: Column, words: str) -> Column:
    """A text holds one of the words, parted by "|"; looked for as they are, many times faster than by a pattern."""
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words.split("|")])


def _first_named(text: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(_holds(text, p), F.lit(n)) for n, p in table.items()])


def industry_label(question: Column) -> Column:
    """What stands before 行业 or 板块, without particles."""
    found = F.regexp_extract(question, "([A-Za-z0-9一-鿿·、，,（）() -]{2,40}?)(?:行业|板块)", 1)
    return F.nullif(F.trim(F.regexp_replace(F.trim(found, F.lit(" ，,、")), "^(?:在|于|属于|的)+", ""), F.lit(" ，,、")), F.lit(""))


def clean_industry(value: Column) -> Column:
    """An industry without leading particles and without the year that a label ends in."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(value), "^(?:在|于|属于|的)+", ""), r"_\d{4}$", ""), F.lit(""))


def rewrite(text: Column, flat: Column, exact: bool = True) -> dict[str, Column]:
    """What a question asks for: latest year, currency, kind of document and report, market, industry, section, code, period,
    chain position, topics and tags. flat: a column that holds normalize_text() of the question, worked out once."""
    years = F.regexp_extract_all(text, F.lit(r"(?:19|20)\d{2}"), F.lit(0))
    money = F.regexp_extract(text, r"\b(?:USD|EUR|GBP|JPY|CNY|RMB|AUD|CAD|CHF|HKD)\b|[$€£¥￥]", 0)
    # the sign is looked for once: as a lambda's variable it is not put into every test of its name
    money = F.get(F.transform(F.array(F.translate(money, "￥", "¥") if exact else money), lambda m: F.when(m != "", currency_token(m, False))), F.lit(0))
    listed = lambda table: F.array_compact(F.array(*[F.when(_holds(flat, p), F.lit(n)) for n, p in table.items()]))
    out = {
        "year": F.array_max(F.transform(years, lambda y: y.cast("int"))),
        "currency": F.coalesce(money, F.when(F.contains(text, F.lit("人民币")), "CNY")),
        "doc_source_type": _first_named(flat, DOC_TYPES), "report_type": _first_named(flat, REPORT_TYPES), "exchange": _first_named(flat, EXCHANGES), "board": _first_named(flat, BOARDS), "market_type": _first_named(flat, MARKETS),
        "industry_l1": industry_label(text), "chain_position_major": _first_named(flat, CHAIN), "section_name": F.coalesce(*[F.when(F.contains(flat, F.lit(h)), F.lit(h)) for h in SECTION_HINTS]),
        "security_code": F.get(security_codes(text, exact), F.lit(0)), "period": period_token(text, exact), "topic_flags": listed(TOPICS),
    }
    return out | {name: listed(table) for name, table in TAG_WORDS.items()}


def expanded_queries(text: Column, more: list[Column], exact: bool = True) -> Column:
    """Search queries for a question, in order: itself, its normal form, each with a term replaced by another word for it,
    and itself with each thing asked for that it does not name (null: nothing to add)."""
    own, flat = F.trim(text), normalize_text(text, exact)
    parts = [own, flat]
    low = F.lower(text)
    for term, words in SYNONYMS.items():
        for word in words:
            changed = F.replace(text, F.lit(term), F.lit(word))
            parts.append(F.when((F.contains(low, F.lit(term.lower())) | F.contains(text, F.lit(term))) & (changed != text), changed))
    parts += [F.when(~F.contains(flat, normalize_text(m.cast("string"), exact)), F.concat(own, F.lit(" "), m.cast("string"))) for m in more]
    return F.array_compact(F.array(*parts))


def most_queries(schema: Column, company: Column) -> Column:
    """How many search queries a question gets (fixed values)."""
    return F.when(F.coalesce(company != "", F.lit(False)), F.when(schema.isin("name", "boolean"), 2).otherwise(3)).otherwise(4)


#: Words that tell what a question is about (fixed values).
LABEL_WORDS = "国产替代|数字化转型|绿色转型|人工智能|智能制造|出海"


def question_kinds(text: Column, schema: Column) -> dict[str, Column]:
    """Which rule may answer a question: counts, names and membership of companies, dividends, revenue, representatives, charts."""
    kind, t = F.lower(F.coalesce(schema, F.lit(""))), F.coalesce(text, F.lit(""))
    return {
        "count": (kind == "number") & t.rlike("共有几家|多少家|几家公司|数量|公司数") & t.rlike(LABEL_WORDS),
        "names": (kind == "names") & t.rlike("哪些公司") & t.rlike("提到|提及|涉及|包含"),
        "membership": (kind == "boolean") & t.rlike("名单") & t.rlike("是否属于|是否在|是不是|是否为|是否入选"),
        "dividend": (kind == "boolean") & t.rlike("现金分红|现金红利|现金股利|派发股息|派发现金红利|每 ?10 ?股派发|每 ?10 ?股派息") & t.rlike("是否提到|是否提及|年度利润分配预案|利润分配预案|重要事项"),
        "revenue": normalize_text(t).rlike("营业收入|营收"),
        "legal_representative": (kind == "name") & t.rlike("法定代表人"),
        "chart": t.rlike("图表|柱状图|折线图|趋势图|走势图|曲线图|趋势"),
    }


def metric_of(text: Column, capability: Column, kind: Column) -> dict[str, Column]:
    """Metric, period, currency and unit that a benchmark question is about (fixed values)."""
    named = F.coalesce(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in ("法定代表人", "营业收入", "现金分红", "国产替代")])
    metric = F.coalesce(named, F.when((capability == "cross_doc_compare") & text.rlike("谁的") & text.rlike("更高"), "比较题"), F.when(kind == "boolean", "布尔判断"))
    number, yuan = kind == "number", F.contains(text, F.lit("元"))
    return {"metric": metric, "period": F.when(number, F.when(text.rlike("年末|期末"), "期末").otherwise("本期")), "currency": F.when(number & yuan, "CNY"), "unit": F.when(number & yuan, "元")}


def capability_of(task: Column, docs: Column, schema: Column, text: Column) -> Column:
    """What a seed question tests: its task, or what its documents, kind and words say."""
    return F.coalesce(F.nullif(task, F.lit("")), F.when(docs > 1, "cross_doc_compare").when(schema == "boolean", "single_doc_boolean").when(schema == "names", "metadata_tag_retrieval").when(F.contains(text, F.lit("章节")), "section_filter").otherwise("single_doc_fact"))


def limit_queries(queries: DataFrame, by: str, order: str, cap: int) -> DataFrame:
    """Search queries without those that only differ in signs and case; the first of each, `cap` at most."""
    w = Window.partitionBy(by, "print").orderBy(order)
    first = queries.withColumn("print", query_fingerprint(F.col("query"))).where("print <> ''").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "print")
    return ranked(first, [by], F.col(order), top=cap, name="query_no")


