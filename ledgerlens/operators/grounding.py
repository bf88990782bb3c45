"""Grounding of number questions in table cells and chart records: validity, scores, the best match and its support."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .filters import given, is_numeric_cell
from .retrieval import ranked

#: Units that an answer can be asked in, the order in which a question is searched for them, and their sizes (fixed values).
TARGETS = {"百万元": 1e6, "千万元": 1e7, "亿元": 1e8, "万元": 1e4, "元": 1.0}
FOREIGN = "美元 港元 欧元 日元".split()
#: Decimal places of an answer by its unit (fixed values).
PLACES = {"元": 2, "万元": 4, "亿元": 6, "百万元": 4}
#: Terms of revenue tables (fixed values).
REVENUE = "营业收入|营业总收入|营收"
BAD_ROW = "占营业收入比例|营业收入比例|销售费用占|研发投入占营业收入"
BAD_COL = "同比|变动|比例|占比|百分比|本期比上年同期|期末余额|期初|数量合计|分部收入|关联方"
SEGMENT_COL = "公司业务|个人业务|资金业务|公司银行业务|零售银行业务|金融市场业务|未分配项目|其他业务"
SEGMENTS = "分部|地区|产品|关联方|客户"
MINOR = "扣除与主营业务无关|不具备商业实质"
EXACT_ROW, TOTAL_ROW = ("营业收入", "一、营业收入", "-、营业收入"), ("营业总收入", "一、营业总收入", "-、营业总收入")
#: Units in the order in which a table's surroundings are searched for them, and those that overrule a weak hint (fixed values).
UNIT_PRIORITY = "人民币百万元 百万元 人民币千万元 千万元 人民币千元 千元 人民币万元 万元人民币 万元 亿元 人民币元 元 %".split()
STRONG_UNITS, WEAK_HINTS = "人民币百万元 百万元 人民币千元 千元".split(), ("元", "万元", "人民币万元", "万元人民币")
#: Least score of a match in tables and in charts.
TABLE_LEAST, CHART_LEAST = 2.2, 1.5
#: Signs that a table is the summary of accounts (fixed values).
SUMMARY = "主要会计数据|主要财务指标|会计数据和财务指标摘要|近三年主要会计数据和财务指标"


def _yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def points(*terms: tuple[Column, float]) -> Column:
    """Sum of the weights of the tests that hold."""
    return sum((F.when(_yes(t), w).otherwise(0.0) for t, w in terms), F.lit(0.0))


def target_unit(question: Column) -> Column:
    """The unit that a question asks for; 元 alone counts unless it belongs to a foreign currency."""
    named = X.first_held(question, [u for u in TARGETS if u != "元"])
    foreign = reduce(or_, [F.contains(question, F.lit(u)) for u in FOREIGN])
    return F.coalesce(named, F.when(F.contains(question, F.lit("元")) & ~foreign, F.lit("元")))


def to_target(value: Column, unit: Column) -> Column:
    """A value in units of its target; unknown units leave it."""
    out = value
    for name, factor in TARGETS.items():
        out = F.when(unit == name, value / F.lit(factor)).otherwise(out)
    return out


def answer_value(value: Column, unit: Column) -> Column:
    """The value to answer with: rounded half up to the places of its unit."""
    out = value
    for name, places in PLACES.items():
        out = F.when(unit == name, F.round(value, places)).otherwise(out)
    return out


def threshold_yuan(question: Column) -> Column:
    """The amount, in yuan, that a question asks to be exceeded."""
    m = r"(?:超过|高于|大于)\s*([0-9０-９][0-9０-９,，]*(?:\.\d+)?)\s*(百万元|千万元|亿元|万元|元)?"
    number, unit = F.regexp_extract(question, m, 1), F.regexp_extract(question, m, 2)
    return F.when(number != "", X.parse_numeric(F.concat(number, F.when(unit == "", "元").otherwise(unit))))


def asks_revenue(question_normal: Column) -> Column:
    return question_normal.rlike("营业收入|营收")


def infer_unit(hint: Column, flat: Column, context_compact: Column) -> Column:
    """The unit of a cell: a percentage by its hint; a strong unit of the surroundings before none or a weak hint; else the
    first of the priority list that hint or surroundings name; else the hint. flat: table_text() of the hint;
    context_compact: table_text() of the first 3000 characters."""
    raw = F.trim(F.coalesce(hint, F.lit("")))
    strong = X.first_held(context_compact, STRONG_UNITS)
    overrules = strong.isNotNull() & ((flat == "") | flat.isin(*WEAK_HINTS) | ((flat == "千元") & strong.isin("人民币千元", "千元")))
    named = F.coalesce(*[F.when(F.contains(flat, F.lit(u)) | F.contains(context_compact, F.lit(u)), F.lit(u)) for u in UNIT_PRIORITY])
    return F.when(raw.rlike("[%％]"), "%").when(overrules, strong).otherwise(F.coalesce(named, F.nullif(raw, F.lit(""))))


def rejects_unit(question: Column, question_normal: Column, unit: Column) -> Column:
    """A percentage can't answer a question for revenue that speaks of none."""
    return asks_revenue(question_normal) & ~F.contains(question, F.lit("%")) & F.coalesce(unit, F.lit("")).rlike("[%％]|百分点")


def scope_score(question_normal: Column, context_compact: Column) -> Column:
    """How far a table's surroundings are those of consolidated revenue; 0 for other questions."""
    c = context_compact
    score = points((c.rlike("主要会计数据|主要财务指标"), 5.0), (c.rlike("公司简介和主要财务指标"), 2.0), (c.rlike("利润表"), 2.5), (c.rlike("关联方|分部信息|按产品|按地区|母公司"), -3.0))
    return F.when(asks_revenue(question_normal), score).otherwise(0.0)


def revenue_score(question_normal: Column, row: Column, col: Column) -> Column:
    """Score of a cell's headers (both normalised) for a question for revenue: null rejects, 0 for other questions."""
    q, both = question_normal, F.concat_ws(" ", row, col)
    only_if_asked = lambda words, where: where.rlike(words) & ~q.rlike(words)
    reject = (
        ~both.rlike(REVENUE) | both.rlike(BAD_ROW) | col.rlike(BAD_COL) | (col.rlike("增减") & ~col.rlike(r"20\d{2}")) | (col.rlike(SEGMENT_COL) & ~col.rlike("合计"))
        | only_if_asked("季度", col) | (col.rlike("%|百分点") & ~F.contains(q, F.lit("%"))) | only_if_asked("母公司", both) | only_if_asked("本行", both) | only_if_asked(SEGMENTS, both)
    )
    group = F.when(col.rlike("本集团|合计"), 2.0).otherwise(0.0)
    score = F.when(row.isin(*EXACT_ROW), 8.0 + group).when(row.isin(*TOTAL_ROW), 7.5 + group).when(row.rlike(MINOR), 1.0).when(row.rlike("营业收入|营业总收入"), 4.0).otherwise(1.5)
    return F.when(~asks_revenue(q), 0.0).when(reject, F.lit(None)).otherwise(score)


def overlap(tokens: Column, text: Column) -> Column:
    """How many tokens stand in a (normalised) text."""
    return F.size(F.filter(tokens, lambda t: F.contains(text, t))).cast("double")


def fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows plus columns that are worked out once. Spark puts a column's expression into every later filter that names it;
    what a generator returns is not, so long expressions neither multiply nor run twice."""
    return rows.select("*", F.inline(F.array(F.struct(*[v.alias(n) for n, v in columns.items()]))))


def in_form(rows: DataFrame, *names: str) -> DataFrame:
    """Text columns in compatibility form, all in one pass; what follows stays in the JVM."""
    return rows.withColumns({n: X.nfkc(F.col(n)) for n in names if n in rows.columns})


def prepare_tables(tables: DataFrame, context: str = "context", exact: bool = True) -> DataFrame:
    """tables plus what every cell's score reads of the surroundings, worked out once per table."""
    c = F.coalesce(F.col(context), F.lit(""))
    return fixed(tables, context_normal=X.normalize_text(c, exact), context_compact=X.table_text(c, exact), context_head=X.table_text(F.substring(c, 1, 3000), exact))


def ground_numbers(questions: DataFrame, tables: DataFrame, cells: DataFrame, exact: bool = True) -> DataFrame:
    """Scored matches of number questions with cells, one row per valid pair; the plan is an equi-join on the document.

    questions: question_id, question, docs (array of allowed documents), pages (array of retrieved pages), year int, period,
    currency. tables: doc, table_id, context. cells: doc, table_id, page, row_idx, col_idx, raw_value, row_head, col_head,
    unit_hint, period, normalized_value, ordinal (scan order). Adds score, unit, value, target_unit and answer_value.
    """
    if exact:
        questions, tables, cells = in_form(questions, "question", "period", "currency"), in_form(tables, "context"), in_form(cells, "raw_value", "row_head", "col_head", "unit_hint", "period")
    exact = False
    asks = fixed(questions, q_normal=X.normalize_text(F.col("question"), exact), q_tokens=X.index_tokens(F.col("question"), exact), target_unit=target_unit(F.col("question")), currency_normal=X.normalize_text(F.col("currency"), exact)).where(F.size("q_tokens") > 0)
    asks = asks.select("question_id", "question", "q_normal", "q_tokens", "target_unit", F.col("pages").alias("q_pages"), F.col("year").alias("q_year"), F.col("period").alias("q_period"), F.col("currency").alias("q_currency"), "currency_normal", F.explode(F.array_distinct("docs")).alias("doc"))
    # what depends on a cell or a table alone is worked out before they meet questions
    own = fixed(cells.where(F.col("raw_value").rlike(r"\d")), row_normal=X.normalize_text(F.col("row_head"), exact), col_normal=X.normalize_text(F.col("col_head"), exact), period_normal=X.normalize_text(F.col("period"), exact), hint_flat=X.table_text(F.col("unit_hint"), exact), with_percent=is_numeric_cell(F.col("raw_value"), F.lit("%"), exact))
    # a plain number is one that the same test passes for questions without percentages
    own = own.where("with_percent").withColumn("plain", ~F.col("raw_value").rlike("[%％]")).join(prepare_tables(tables.select("doc", "table_id", "context"), exact=exact), ["doc", "table_id"])
    own = fixed(own, unit=infer_unit(F.col("unit_hint"), F.col("hint_flat"), F.col("context_head")))
    own = fixed(own, value=F.coalesce(X.parse_numeric(F.col("raw_value"), F.col("unit"), exact), F.col("normalized_value")), unit_normal=X.normalize_text(F.col("unit"), exact))
    rows = own.join(asks, "doc").where(F.col("plain") | F.contains("question", F.lit("%")))
    q = F.col("q_normal")
    rows = rows.where(~rejects_unit(F.col("question"), q, F.col("unit")))
    rows = fixed(rows, revenue=revenue_score(q, F.col("row_normal"), F.col("col_normal"))).where("revenue is not null")
    when = F.when(given(F.col("period")), F.col("period_normal")).otherwise(F.col("context_normal"))
    money = F.when(given(F.col("unit")), F.col("unit_normal")).otherwise(F.col("context_normal"))
    asked_money = F.col("currency_normal")
    score = (
        F.col("revenue") + overlap(F.col("q_tokens"), F.col("row_normal")) * 2.2 + overlap(F.col("q_tokens"), F.col("col_normal")) * 1.8 + overlap(F.col("q_tokens"), F.col("context_normal")) * 0.8
        + scope_score(q, F.col("context_compact"))
        + F.when(asks_revenue(q), points((X.table_text(F.col("row_head"), exact).startswith("其中:营业收入") & F.contains("context_compact", F.lit("营业总收入")), 6.0), (F.col("page") <= 10, 8.0), (F.col("page").between(11, 20), 4.0))).otherwise(0.0)
        + points(
            (F.array_contains("q_pages", F.col("page")), 1.5), (F.contains(when, F.col("q_year").cast("string")), 1.5), (given(F.col("q_period")) & F.contains(when, X.normalize_text(F.col("q_period"), exact)), 1.0),
            (given(F.col("q_currency")) & (F.contains(money, asked_money) | ((F.col("q_currency") == "CNY") & F.contains(money, F.lit("人民币")))), 0.6),
            (F.contains("question", F.lit("%")) & F.contains("raw_value", F.lit("%")), 0.5),
        )
    )
    rows = fixed(rows, score=F.round(score, 4), answer_value=to_target(F.col("value"), F.col("target_unit")))
    return rows.drop("revenue", "context_head", "q_tokens", "q_pages", "plain", "with_percent", "hint_flat", "period_normal", "unit_normal", "currency_normal")


def best_matches(matches: DataFrame, by: str = "question_id", least: float = TABLE_LEAST) -> DataFrame:
    """The match of the largest score of each question, first in scan order among equals, if it reaches the threshold."""
    return ranked(matches.where((F.col("score") >= least) & (F.col("score") > 0)), [by], F.col("score").desc(), F.col("ordinal"), top=1).drop("rank")


def support_priority(context_compact: Column, page: Column) -> Column:
    """Tables of the summary of accounts come first, then statements of income and early pages (fixed values)."""
    page = F.coalesce(page, F.lit(10_000))
    return points((context_compact.rlike(SUMMARY), 100.0), (context_compact.rlike("公司简介和主要财务指标"), 20.0), (context_compact.rlike("利润表"), 10.0), (page <= 20, 20.0)).cast("int")


def mentions_year(year: Column, *texts: Column, exact: bool = True) -> Column:
    """Some text names the year; none asked for passes."""
    return year.isNull() | F.contains(X.normalize_text(F.concat_ws(" ", *texts), exact), year.cast("string"))


def supporting_matches(matches: DataFrame, top: int = 2, least: float = TABLE_LEAST) -> DataFrame:
    """Other cells of the best match's document that hold its value (within max(1, 1e-6 |value|)) and name the year asked
    for: by priority, page and score, one per page other than the best one's, `top` at most; questions for revenue only.
    The best match is that of best_matches(); it is found in the pass over its question's matches, which are worked out once."""
    good = (F.col("score") >= least) & (F.col("score") > 0)
    best = F.min(F.when(good, F.struct((-F.col("score")).alias("order"), "ordinal", "doc", "page", "value"))).over(Window.partitionBy("question_id"))
    rows = matches.withColumn("b", best).where("b is not null")
    rows = rows.select("*", *[F.col(f"b.{x}").alias(f"b_{x}") for x in ("doc", "page", "value", "ordinal")]).drop("b")
    hit = rows.where(F.col("doc").eqNullSafe(F.col("b_doc")) & (F.col("ordinal") != F.col("b_ordinal")) & asks_revenue(F.col("q_normal")))
    hit = hit.where(F.abs(F.col("value") - F.col("b_value")) <= F.greatest(F.lit(1.0), F.abs("b_value") * 1e-6))
    hit = hit.where(mentions_year(F.col("q_year"), F.col("row_normal"), F.col("col_normal"), F.col("period"), F.col("context_normal"), exact=False) & ~F.col("page").eqNullSafe(F.col("b_page")))
    hit = hit.withColumn("priority", support_priority(F.col("context_compact"), F.col("page")))
    order = [F.col("priority").desc(), F.col("page"), F.col("score").desc(), F.col("ordinal")]
    one = ranked(hit, ["question_id", "page"], *order, top=1, name="in_page").drop("in_page")
    return ranked(one, ["question_id"], *order, top=top, name="support_rank").drop("b_doc", "b_page", "b_value", "b_ordinal")


#: Words of a question about a chart (fixed values).
CHART_WORDS = "图表|柱状图|折线图|趋势图|走势图|曲线图|趋势"


def chart_unit_penalty(question: Column, unit: Column) -> Column:
    """Taken off where a question for a share meets a chart without percentages, or where the units of money differ."""
    unit, target = F.coalesce(unit, F.lit("")), target_unit(question)
    plain_yuan = (target == "元") & unit.endswith("元")
    return F.when(question.rlike("%|占比|比例") & ~F.contains(unit, F.lit("%")), 2.0).when(target.isNotNull() & (unit != "") & (target != unit) & ~plain_yuan, 0.4).otherwise(0.0)


def ground_charts(questions: DataFrame, records: DataFrame, exact: bool = True) -> DataFrame:
    """Scored matches of number questions with chart records, an equi-join on the document.

    questions as for ground_numbers(). records: doc, chart_id, page, series_name, x_label, unit, raw_value, normalized_value,
    context_text, table_markdown, confidence, ordinal. Records without a number are left out.
    """
    if exact:
        questions, records = in_form(questions, "question", "period"), in_form(records, "series_name", "x_label", "unit", "raw_value", "context_text", "table_markdown")
    exact = False
    asks = questions.withColumn("q_normal", X.normalize_text(F.col("question"), exact)).withColumn("q_tokens", X.index_tokens(F.col("question"), exact)).where(F.size("q_tokens") > 0)
    asks = asks.select("question_id", "question", "q_normal", "q_tokens", F.col("pages").alias("q_pages"), F.col("year").alias("q_year"), F.col("period").alias("q_period"), F.explode(F.array_distinct("docs")).alias("doc"))
    present = lambda *c: F.concat_ws("\n", *[F.when(given(F.col(x)), F.col(x)) for x in c])
    rows = fixed(records, value=F.coalesce(F.col("normalized_value"), X.parse_numeric(F.col("raw_value"), F.col("unit"), exact))).where("value is not null")
    rows = fixed(rows, series_normal=X.normalize_text(F.col("series_name"), exact), x_normal=X.normalize_text(F.col("x_label"), exact), context_normal=X.normalize_text(present("series_name", "x_label", "unit", "context_text", "table_markdown"), exact))
    rows = rows.join(asks, "doc")
    around = F.concat_ws(" ", "x_normal", "context_normal")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0)))) * 2.0
    score = overlap(F.col("q_tokens"), F.col("series_normal")) * 2.2 + overlap(F.col("q_tokens"), F.col("x_normal")) * 1.8 + overlap(F.col("q_tokens"), F.col("context_normal")) * 0.7
    score = score + points(
        (asks_revenue(F.col("q_normal")) & F.col("series_normal").rlike("营业收入|营收"), 3.0), (F.contains(around, F.col("q_year").cast("string")), 1.5),
        (given(F.col("q_period")) & F.contains(around, X.normalize_text(F.col("q_period"), exact)), 1.0), (F.array_contains("q_pages", F.col("page")), 1.0), (F.col("question").rlike(CHART_WORDS), 0.8),
    )
    rows = fixed(rows, score=F.round(score + confidence - chart_unit_penalty(F.col("question"), F.col("unit")), 4), target_unit=target_unit(F.col("question")))
    return rows.withColumn("answer_value", to_target(F.col("value"), F.col("target_unit"))).drop("q_tokens", "q_pages")


def grounded_pages(page: Column, members: Column, support: Column, most: int = 3) -> Column:
    """Pages of a grounded answer, rising: the cell's, all of its logical table, then support pages until there are `most`."""
    first = F.array_distinct(F.array_compact(F.concat(F.array(page), F.coalesce(members, F.array().cast("array<int>")))))
    more = F.array_except(F.array_compact(F.coalesce(support, F.array().cast("array<int>"))), first)
    # the support page that is looked at first is taken even if there are enough already
    room = F.greatest(F.lit(most) - F.size(first), F.lit(1))
    return F.array_sort(F.concat(first, F.slice(more, F.lit(1), room)))


#: What is measured of a report: words of its rows, weaker words, words that rule a row out, and words around it (fixed values).
METRICS = {
    "net_profit": ("归属于上市公司股东的净利润|归属于母公司股东的净利润", "净利润", "扣除非经常性|少数股东|每股|率|现金流量", "主要会计数据|主要财务指标|公司简介和主要财务指标|利润表"),
    "rd_investment": ("研发投入合计|研发投入总额", None, "占营业收入|比例|资本化的比重|人员|人数|变化幅度", "研发投入|研发费用"),
    "total_assets": ("总资产|资产总额|资产总计", None, "负债|净资产|收益率|每股|增减|同比", "主要会计数据|主要财务指标|公司简介和主要财务指标|资产负债表"),
    "operating_cash_flow": ("经营活动产生的现金流量净额|经营活动现金流量净额", "经营性现金净流量|经营现金流量净额", "每股|比率|占比|收益率", "主要会计数据|主要财务指标|公司简介和主要财务指标|现金流量表"),
}
OTHER_YEARS, CHANGES = "2023|2022|2021|上年|上期|上年度|上期期末", "增减|变化|比例|比上年|同比|%|百分点"


def metric_cells(tables: DataFrame, cells: DataFrame, metric: str, year: str = "2024", exact: bool = True) -> DataFrame:
    """The best cell of each document for a metric: rows that name it, columns of the year or the current period, tables
    whose surroundings fit and early pages; first in scan order among equals.

    tables: doc, table_id, context. cells: as for ground_numbers().
    """
    strong, weak, bad, around = METRICS[metric]
    if exact:
        tables, cells = in_form(tables, "context"), in_form(cells, "raw_value", "row_head", "col_head", "unit_hint")
    exact = False
    rows = cells.join(tables.select("doc", "table_id", X.table_text(F.col("context"), exact).alias("around")), ["doc", "table_id"])
    rows = fixed(rows, row=X.table_text(F.col("row_head"), exact), col=X.table_text(F.col("col_head"), exact), plain=is_numeric_cell(F.col("raw_value"), None, exact)).where("plain")
    row, col = F.col("row"), F.col("col")
    row_score = F.when(row.rlike(bad), None).when(row.rlike(strong), 20.0)
    row_score = row_score.when(row.rlike(weak), 10.0) if weak else row_score
    ends = F.when(col.rlike("期末|本年末|年末|期末余额"), 4.0) if metric == "total_assets" else F.lit(None)
    col_score = F.when(~col.rlike(f"{OTHER_YEARS}|{CHANGES}"), F.coalesce(F.when(F.contains(col, F.lit(year)), 5.0), ends, F.when(col.rlike("本期|本年度|本年|本报告期|合计|本集团|本公司"), 3.0), F.when(col == "", 1.0)))
    rd = metric == "rd_investment"
    place = points((F.col("around").rlike(around), 8.0), (F.contains("around", F.lit("母公司")) & F.lit(not rd), -4.0), (F.col("page") <= (80 if rd else 15), 2.0 if rd else 4.0))
    rows = fixed(rows, score=F.round(row_score + col_score + place, 4), value=X.parse_numeric(F.col("raw_value"), F.col("unit_hint"), exact)).where("score is not null and value is not null")
    return ranked(rows, ["doc"], F.col("score").desc(), F.col("ordinal"), top=1).drop("rank", "row", "col", "around", "plain")
