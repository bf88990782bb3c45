"""Evaluation: set, rank, token, number, entity and keyword measures, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .filters import given
from .retrieval import dealt, ranked, tasks_for


def ratio(top: Column, low: Column) -> Column:
    """Round 4; null where nothing was counted."""
    return F.when(low > 0, F.round(top / low, 4))


def matched_gold(predictions: DataFrame, gold: DataFrame, key: str, order: str) -> DataFrame:
    """Predictions joined with the last gold row of their key (its columns as gold_*); predictions without gold go."""
    last = ranked(gold.where(given(F.col(key))), [key], F.col(order).desc(), top=1, name="__k").drop("__k", order)
    return predictions.join(last.select(key, *[F.col(c).alias(f"gold_{c}") for c in last.columns if c != key]), key)


def ranked_measures(found: DataFrame, gold: DataFrame, by: str, item: str, k: int) -> DataFrame:
    """Recall, precision and hit at k per question; precision divides by k, however short the list; round 4.

    found: (by, item, rank), repeats count once where they first stand; questions without gold are left out.
    """
    first = found.groupBy(by, item).agg(F.min("rank").alias("rank"))
    top = ranked(first, [by], F.col("rank"), F.col(item), top=k, name="place")
    hit = top.join(gold.select(by, item).distinct(), [by, item], "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("hits"))
    size = gold.select(by, item).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("gold"))
    out = size.join(hit, by, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.select(by, F.round(F.col("hits") / F.col("gold"), 4).alias("recall"), F.round(F.col("hits") / k, 4).alias("precision"), F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"))


def ranked_summary(questions: DataFrame, recall_k: int = 10, precision_k: int = 3) -> DataFrame:
    """One row: macro recall, precision and hits over questions with reference pages, and how many lack what.

    questions: reference_pages (array), ranked_pages (array in rank order, repeats allowed; null: no details are known).
    """
    gold, seen = F.array_distinct("reference_pages"), F.array_distinct(F.coalesce("ranked_pages", F.array().cast(dict(questions.dtypes)["ranked_pages"])))
    rows = questions.select((F.size(gold) > 0).alias("eligible"), F.col("ranked_pages").isNull().alias("unknown"), F.size(seen).alias("n"), F.size(gold).alias("g"), *[F.size(F.array_intersect(F.slice(seen, 1, k), gold)).alias(c) for c, k in (("r", recall_k), ("p", precision_k))])
    ok, flag = F.col("eligible"), lambda test: F.count_if(F.col("eligible") & test)
    mean = lambda c: F.round(F.avg(F.when(ok, c)), 4)
    return rows.agg(
        F.count(F.lit(1)).alias("matched_questions"), F.count_if(ok).alias("eligible_questions"), F.count_if(~ok).alias("without_reference_pages"), flag(F.col("unknown")).alias("missing_details"),
        flag(F.col("n") == 0).alias("no_ranked_pages"), flag(F.col("n") < recall_k).alias("fewer_than_recall_k"), flag(F.col("n") < precision_k).alias("fewer_than_precision_k"),
        mean(F.round(F.col("r") / F.col("g"), 4)).alias("macro_recall"), mean(F.round(F.col("p") / precision_k, 4)).alias("macro_precision"), mean(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("hit"),
    )


def micro_recall(units: DataFrame, by: list[str]) -> DataFrame:
    """Recall over all units of each level, and the share of questions with a hit; units: by, question_id, gold unit rows with
    `hit` (boolean)."""
    per = units.groupBy(*by, "question_id").agg(F.count(F.lit(1)).alias("gold"), F.count_if("hit").alias("hits"))
    return per.groupBy(*by).agg(F.sum("gold").alias("gold"), F.sum("hits").alias("hits"), ratio(F.sum("hits"), F.sum("gold")).alias("micro_recall"), F.round(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)), 4).alias("hit_rate"))


#: Levels of gold units, finest first, and backends that match words (fixed values); "vector" matches meaning.
UNIT_LEVELS, LEXICAL = ("table", "chunk", "page", "doc"), ("bm25", "sparse", "tag")


def attribution(gold: DataFrame, retrieved: DataFrame, reranked: bool = True) -> DataFrame:
    """(question_id, level, unit, attribution): what found each gold unit of a question's finest level that has any.

    gold: question_id, level, unit. retrieved: question_id, level, unit, stage (candidate, top before reranking, final) and
    sources (array of backends, of candidates). Gold that only reranking brought up is rescued; the rest is told apart by
    the backends that found it.
    """
    order = F.array(*map(F.lit, UNIT_LEVELS))
    finest = gold.groupBy("question_id").agg(F.min(F.array_position(order, F.col("level"))).alias("at"))
    of = gold.join(finest, "question_id").where(F.array_position(order, F.col("level")) == F.col("at")).select("question_id", "level", "unit").distinct()
    none, at = F.array().cast("array<string>"), lambda stage: F.bool_or(F.col("stage") == stage)
    seen = retrieved.groupBy("question_id", "level", "unit").agg(at("candidate").alias("pool"), at("top").alias("top"), at("final").alias("final"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("stage") == "candidate", F.coalesce("sources", none))))).alias("s"))
    rows = of.join(seen, ["question_id", "level", "unit"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    words, sense = F.coalesce(F.arrays_overlap("s", F.array(*map(F.lit, LEXICAL))), F.lit(False)), F.coalesce(F.array_contains("s", "vector"), F.lit(False))
    kind = F.when(~yes("final"), "Not_recalled").when(yes("pool") & ~yes("top") & F.lit(reranked), "Reranker_rescue").when(words & sense, "Both").when(words, "BM25_only").when(sense, "Dense_only").otherwise("Unknown")
    return rows.select("question_id", "level", "unit", kind.alias("attribution"))


def settings_grid(spark, **values: list) -> DataFrame:
    """Every combination of the settings' values, each once, numbered in order. The grid is of the settings' own size."""
    out = None
    for name, options in values.items():
        df = spark.createDataFrame([(i, v) for i, v in enumerate(dict.fromkeys(options))], f"{name}_no int, {name} {'string' if isinstance(options[0], str) else 'double' if isinstance(options[0], float) else 'int'}")
        out = df if out is None else out.crossJoin(df)
    return ranked(out, [F.lit(0)], *[F.col(f"{n}_no") for n in values], name="setting").select("setting", *values)


def token_list(text: Column) -> Column:
    """Tokens of an answer: of texts with ideographs the words if spaces part them, short ones whole, else the characters;
    of others what white space and signs of lists part."""
    flat = X.flat_text(F.lower(text))
    cjk = F.when(F.contains(flat, F.lit(" ")), F.split(flat, " ")).when(F.length(flat) <= 4, F.array(flat)).otherwise(F.split(flat, ""))
    parts = F.when(X.contains_cjk(flat), cjk).otherwise(F.split(flat, r"[\s,;|/]+"))
    return F.filter(parts, lambda t: F.trim(t) != "")


def _counts(tokens: Column) -> Column:
    """An array as a histogram: (token, n), in one pass over the sorted array."""
    return F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("t"), F.size(F.filter(tokens, lambda x: x == t)).alias("n")))


def multiset_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays as multisets, within the row: 1 if both are empty. What both hold is counted over the distinct
    tokens of the shorter side, so one long side costs one pass per token of the short one."""
    a, b = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    shared = F.array_intersect(F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a))
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    same = F.aggregate(shared, F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t)))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(F.round(2 * same / total, 4))


def token_f1(pairs: DataFrame, key: list[str], a: Column, b: Column) -> DataFrame:
    """F1 over tokens as multisets, for pairs of texts of any length: (key, f1). Both sides' tokens are counted in one
    map-side combined aggregate; nothing is compared pair by pair."""
    side = lambda tokens, n: F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(n).alias("side")))
    both = pairs.select(*key, F.explode_outer(F.concat(side(a, 0), side(b, 1))).alias("x"))
    per = both.groupBy(*key, "x.t").agg(F.count_if(F.col("x.side") == 0).alias("na"), F.count_if(F.col("x.side") == 1).alias("nb"))
    same, total = F.sum(F.least("na", "nb")), F.sum(F.col("na") + F.col("nb"))
    return per.groupBy(*key).agg(F.when(total == 0, 1.0).otherwise(F.round(2 * same / total, 4)).alias("f1"))


def exact_match(a: Column, b: Column) -> Column:
    """1 for values that are equal but for case and white space; null counts as empty."""
    return F.when(X.flat_text(F.lower(F.coalesce(a.cast("string"), F.lit("")))) == X.flat_text(F.lower(F.coalesce(b.cast("string"), F.lit("")))), 1.0).otherwise(0.0)


def list_f1(a: Column, b: Column) -> Column:
    """F1 of two lists as multisets of normal values."""
    flat = lambda xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: X.flat_text(F.lower(x)))
    return multiset_f1(flat(a), flat(b))


def sequence_similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts in lower case with single spaces; 1 for two empty ones."""
    return F.round(X.sequence_ratio(X.flat_text(F.lower(a)), X.flat_text(F.lower(b))), 4)


def metric_number(value: Column) -> Column:
    """A number for comparison: commas, percent signs, 人民币 and 元 are taken out, in this order, so that what is left of
    a longer unit (万, 亿) makes it no number."""
    out = F.trim(value)
    for sign in (",", "，", "%", "人民币", "元", "万元", "亿元"):
        out = F.replace(out, F.lit(sign), F.lit(""))
    return F.nullif(F.trim(out), F.lit("")).try_cast("double")


def semantic_score(kind: Column, value: Column, gold: Column, values: Column, golds: Column) -> Column:
    """How far an answer agrees with the gold one, by the question's kind: numbers by their difference, names by list F1,
    booleans exactly, other texts by the mean of token F1 and sequence ratio."""
    number = X.numeric_similarity(metric_number(value), metric_number(gold))
    text = F.round((multiset_f1(token_list(value), token_list(gold)) + sequence_similarity(value, gold)) / 2, 4)
    return F.when(kind == "number", F.coalesce(number, exact_match(value, gold))).when(kind == "names", list_f1(values, golds)).when(kind == "boolean", exact_match(value, gold)).otherwise(text)


def weighted_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean over the components that are known; null if none is."""
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts.values()), F.lit(0.0))
    low = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts.values()), F.lit(0.0))
    return F.when(low > 0, F.round(top / low, 4))


def summary_by_kind(rows: DataFrame, kind: str, measures: dict[str, Column]) -> DataFrame:
    """Counts and means overall and by kind, in one pass."""
    return rows.rollup(kind).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(n) for n, c in measures.items()]).withColumn(kind, F.coalesce(kind, F.lit("all")))


def answer_summary(answers: DataFrame) -> DataFrame:
    """Per kind, per confidence, and over all answers, in one pass of grouping sets: number, rates of answers, of "N/A" and of
    citations, references per answer. answers: kind, confidence, value, n_citations, n_references."""
    rows = answers.select(F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("confidence", F.lit("unknown")).alias("confidence"), "value", "n_citations", "n_references")
    rate = lambda test: F.round(F.avg(F.when(F.coalesce(test, F.lit(False)), 1.0).otherwise(0.0)), 4)
    out = rows.groupingSets([[], ["kind"], ["confidence"]], "kind", "confidence").agg(
        F.when(F.grouping("kind") == 0, "kind").when(F.grouping("confidence") == 0, "confidence").otherwise("all").alias("part"), F.coalesce(F.first("kind"), F.first("confidence"), F.lit("all")).alias("value_of"), F.count(F.lit(1)).alias("total"),
        rate(F.col("value").isNotNull() & (F.col("value") != "N/A")).alias("answer_rate"), rate(F.col("value") == "N/A").alias("na_rate"), rate(F.col("n_citations") > 0).alias("citation_coverage"),
        F.round(F.avg(F.coalesce(F.col("n_references").cast("double"), F.lit(0.0))), 4).alias("avg_references"),
    )
    name = F.when(F.col("part") == "kind", F.col("kind")).when(F.col("part") == "confidence", F.col("confidence")).otherwise("all")
    return out.select("part", name.alias("name"), "total", "answer_rate", "na_rate", "citation_coverage", "avg_references")


def accuracy(matched: DataFrame) -> DataFrame:
    """Exact match, page hits and page precision over all matched questions, by kind and by confidence, in one pass.

    matched: kind, confidence, value, gold_value, pages, citation_pages, retrieval_pages and gold_pages (arrays). Page
    measures divide by all matched questions, those without gold pages too.
    """
    hit = lambda c: (F.size("gold_pages") > 0) & F.arrays_overlap(F.coalesce(F.col(c), F.array().cast("array<int>")), "gold_pages")
    precision = lambda c: F.when((F.size("gold_pages") > 0) & (F.size(c) > 0), F.size(F.array_intersect(c, "gold_pages")) / F.size(F.array_distinct(c))).otherwise(0.0)
    one = lambda test: F.avg(F.when(F.coalesce(test, F.lit(False)), 1.0).otherwise(0.0))
    rows = matched.withColumn("kind", F.coalesce("kind", F.lit("unknown"))).withColumn("confidence", F.coalesce("confidence", F.lit("unknown")))
    out = rows.groupingSets([[], ["kind"], ["confidence"]], "kind", "confidence").agg(
        F.when(F.grouping("kind") == 0, "kind").when(F.grouping("confidence") == 0, "confidence").otherwise("all").alias("part"), F.count(F.lit(1)).alias("total"),
        F.round(one(exact_match(F.col("value"), F.col("gold_value")) == 1.0), 4).alias("exact_match"), F.round(one(hit("pages")), 4).alias("reference_page_hit"), F.round(one(hit("citation_pages")), 4).alias("citation_page_hit"),
        F.round(one(hit("retrieval_pages")), 4).alias("retrieval_hit"), F.round(F.avg(precision("pages")), 4).alias("reference_page_precision"), F.round(F.avg(precision("citation_pages")), 4).alias("citation_page_precision"),
    )
    name = F.when(F.col("part") == "kind", F.col("kind")).when(F.col("part") == "confidence", F.col("confidence")).otherwise("all")
    return out.select("part", name.alias("name"), "total", "exact_match", "reference_page_hit", "citation_page_hit", "retrieval_hit", "reference_page_precision", "citation_page_precision")


def finance_summary(cases: DataFrame, scores: list[str], passes: tuple[str, ...] = ("final_quality_score", "answer_score"), least: float = 0.8) -> DataFrame:
    """One row: how many cases, the mean of every score over the cases that have it, and the share at `least` or more of some."""
    means = [F.round(F.avg(c), 4).alias(f"mean_{c}") for c in scores]
    rates = [F.round(F.avg(F.when(F.col(c).isNotNull(), F.when(F.col(c) >= least, 1.0).otherwise(0.0))), 4).alias(f"{c}_pass_rate") for c in passes]
    return cases.agg(F.count(F.lit(1)).alias("matched_predictions"), *means, *rates)


def question_statistics(answers: DataFrame) -> DataFrame:
    """One row: questions, errors, "N/A" answers and successes; errors and "N/A" are counted each by itself."""
    error, none = F.coalesce(F.col("error").isNotNull() & (F.col("error") != ""), F.lit(False)), F.coalesce(F.col("value") == "N/A", F.lit(False))
    return answers.agg(F.count(F.lit(1)).alias("total"), F.count_if(error).alias("errors"), F.count_if(none).alias("not_available"), (F.count(F.lit(1)) - F.count_if(error) - F.count_if(none)).alias("successes"))


def latency_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, extremes, mean, sample deviation (0 for one value), linear p50 and p95.

    Percentiles are exact and distributed: values are ordered within their group by a window over (group, value range), where
    a range holds about a thousandth of the group's span of ranks at most; only the rows at the asked ranks leave it.
    """
    base = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(value).alias("n"), F.round(F.min(value), 4).alias("least"), F.round(F.max(value), 4).alias("most"), F.round(F.avg(value), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 4).alias("stdev"),
    )
    return base.join(exact_percentiles(rows, by, value, {"p50": 0.5, "p95": 0.95}), by)


def exact_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linear percentiles of each group. Equal values are counted first (map-side combined), so what is ordered is distinct
    values with counts; their running counts come from counts per block of values, so no group is one task's work."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    # blocks by an order-preserving key: the leading bits of the value, as many blocks as values are spread over
    block = F.floor(F.signum("v") * F.log1p(F.abs("v")) * 64).alias("block")
    counts = counts.withColumn("block", block)
    sizes = counts.groupBy(*by, "block").agg(F.sum("c").alias("m"))
    over = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("m").over(over), F.lit(0))).withColumn("n", F.sum("m").over(Window.partitionBy(*by)))
    inner = Window.partitionBy(*by, "block").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    at = counts.join(sizes.drop("m"), [*by, "block"]).withColumn("lo", F.col("before") + F.coalesce(F.sum("c").over(inner), F.lit(0))).withColumn("hi", F.col("lo") + F.col("c") - 1)
    parts = []
    for name, q in shares.items():
        place = (F.col("n") - 1) * F.lit(q)
        low, high = F.floor(place), F.ceil(place)
        pick = lambda r: F.max(F.when((F.col("lo") <= r) & (F.col("hi") >= r), F.col("v")))  # noqa: E731, B023
        parts += [pick(low).alias(f"{name}_lo"), pick(high).alias(f"{name}_hi"), F.max(place - low).alias(f"{name}_w")]
    got = at.groupBy(*by).agg(*parts)
    return got.select(*by, *[F.round(F.col(f"{p}_lo") + (F.col(f"{p}_hi") - F.col(f"{p}_lo")) * F.col(f"{p}_w"), 4).alias(p) for p in shares])


def strata(rows: DataFrame, **dims: Column) -> DataFrame:
    """Histogram over all rows and every value of every dimension, as "all" and "dimension/value"."""
    names = F.array(F.lit("all"), *[F.concat(F.lit(f"{n}/"), c.cast("string")) for n, c in dims.items()])
    return rows.select(F.explode(F.array_compact(names)).alias("stratum")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


def error_stage(error: Column, flags: Column, retrieved: Column, cited: Column, value: Column, gold: Column) -> Column:
    """Where a case went wrong: routing, parse, validation, retrieval or generation; correct where nothing did.

    flags: array; retrieved, cited: how many; gold: null without a comparable answer.
    """
    low = F.lower(error)
    wrong = gold.isNotNull() & (F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("none")))) != F.lower(F.trim(gold.cast("string"))))
    return (
        F.when(given(error), F.when(low.rlike("company name found|ambiguous"), "routing").when(low.rlike("parse|docling|pdf"), "parse").otherwise("generation"))
        .when(F.exists(F.coalesce(flags, F.array().cast("array<string>")), lambda f: f.rlike("mismatch|validation")), "validation")
        .when((F.coalesce(retrieved, F.lit(0)) == 0) | (F.coalesce(cited, F.lit(0)) == 0), "retrieval")
        .when(wrong, "generation")
        .otherwise("correct")
    )


def error_stages(rows: DataFrame, stage: Column, example: str, most: int = 3) -> DataFrame:
    """Count of each stage and its first examples; correct ones need none."""
    w = rows.withColumn("stage", stage)
    few = ranked(w.where("stage <> 'correct'"), ["stage"], F.col(example), top=most).groupBy("stage").agg(F.array_join(F.transform(F.array_sort(F.collect_list(example)), lambda x: x.cast("string")), ",").alias("examples"))
    return w.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).join(few, "stage", "left")


#: Names of kinds of reports and of currencies that keywords stand for (fixed values).
REPORT_ALIASES = {"annual_report": ["annual report", "年度报告", "年报"], "q1_report": ["一季报", "第一季度报告"], "semi_annual_report": ["半年报", "中报", "半年度报告"], "q3_report": ["三季报", "第三季度报告"]}
CURRENCY_ALIASES = {"cny": ["人民币", "rmb", "元"], "usd": ["美元"], "eur": ["欧元"]}


def joined_text(value: Column) -> Column:
    """A value in lower case without any white space."""
    return F.regexp_replace(F.lower(F.coalesce(value.cast("string"), F.lit(""))), X.SPACE, "")


def _with_aliases(value: Column, table: dict[str, list[str]]) -> Column:
    flat = joined_text(value)
    out = F.array(flat)
    for name, aliases in table.items():
        out = F.when(flat == name, F.array(F.lit(name), *[F.lit("".join(a.lower().split())) for a in aliases])).otherwise(out)
    return out


def code_digits(value: Column) -> Column:
    """The last six digits of a stock code, or all if fewer."""
    digits = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\D+", "")
    return F.when(F.length(digits) >= 6, F.substring(digits, -6, 6)).otherwise(digits)


def expected_keywords(company: Column, code: Column, year: Column, period: Column, metric: Column, unit: Column, report_type: Column, currency: Column, more: Column | None = None) -> Column:
    """Keywords that an answer should be borne out by, distinct, in order; single signs are none."""
    flat = [joined_text(c) for c in (company, code_digits(code), year, period, metric, unit)]
    listed = F.concat(F.array(*flat), _with_aliases(report_type, REPORT_ALIASES), _with_aliases(currency, CURRENCY_ALIASES), F.transform(F.coalesce(more, F.array().cast("array<string>")), joined_text) if more is not None else F.array().cast("array<string>"))
    return F.array_distinct(F.filter(listed, lambda k: F.length(k) > 1))


def coverage(text: Column, keywords: Column) -> Column:
    """Share of the keywords that the text holds; null without keywords."""
    low = F.lower(text)
    held = F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k))))
    return F.when(F.size(keywords) > 0, F.round(held / F.size(keywords), 4))


#: Weights of the fields that entities are compared in (fixed values).
ENTITY_WEIGHTS = {"doc_ids": 0.15, "company_name": 0.2, "stock_code": 0.1, "report_year": 0.15, "report_type": 0.1, "period": 0.1, "currency": 0.1, "unit": 0.1}
MONEY = {"人民币": "cny", "rmb": "cny", "cny": "cny", "usd": "usd", "美元": "usd", "eur": "eur", "欧元": "eur"}


def _money(value: Column) -> Column:
    flat = joined_text(value)
    out = flat
    for name, code in MONEY.items():
        out = F.when(flat == name, F.lit(code)).otherwise(out)
    return out


def entity_matches(observed: dict[str, Column], expected: dict[str, Column]) -> dict[str, Column]:
    """Per field whether what was observed (arrays) bears out what is expected (doc_ids: an array); null where nothing is
    expected. Names and units match both ways as parts, codes by their last digits, currencies by their code."""
    some = lambda xs, f: F.coalesce(F.exists(xs, f), F.lit(False))
    part = lambda n: lambda o, e: some(o, lambda x: (n(x) != "") & (F.contains(n(e), n(x)) | F.contains(n(x), n(e))))
    same = lambda n: lambda o, e: some(o, lambda x: (n(e) != "") & (n(x) == n(e)))
    unit = lambda c: F.replace(joined_text(c), F.lit("人民币"), F.lit(""))
    rules = {"company_name": part(joined_text), "unit": part(unit), "stock_code": same(code_digits), "currency": same(_money), "report_year": same(lambda c: c.cast("string")), "report_type": same(joined_text), "period": same(joined_text)}
    out = {}
    for field, want in expected.items():
        if field == "doc_ids":
            flat = lambda xs: F.transform(xs, joined_text)
            out[field] = F.when(F.size(want) > 0, F.coalesce(F.arrays_overlap(flat(want), flat(observed[field])), F.lit(False)))
        else:
            out[field] = F.when(given(want), rules[field](observed[field], want))
    return out


def entity_score(matches: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted share of the expected fields that match; null if none is expected."""
    weights = weights or ENTITY_WEIGHTS
    return weighted_score({f: (F.when(m.isNotNull(), F.when(m, 1.0).otherwise(0.0)), weights.get(f, 0.0)) for f, m in matches.items()})


def segments(text: Column) -> Column:
    """Parts of a free text between signs that end sentences or begin items, without signs, of four characters or more."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[。；;！？!?\n\r•-]+")
    return F.array_distinct(F.filter(F.transform(parts, free_text), lambda p: F.length(p) >= 4))


def free_text(text: Column) -> Column:
    """Letters, digits, underscores and ideographs in lower case, nothing else."""
    return F.regexp_replace(F.lower(X.flat_text(text)), r"[^\p{L}\p{M}\p{N}_]+", "")


def consistency(a: Column, b: Column) -> dict[str, Column]:
    """How far two free texts say the same: sequence ratio, Jaccard index and containment of character bigrams, overlap of
    segments, and whether that is enough (fixed thresholds). An empty side is inconsistent, equal ones are consistent."""
    x, y = free_text(a), free_text(b)
    gx, gy = F.array_distinct(X.char_ngrams(x, 2)), F.array_distinct(X.char_ngrams(y, 2))
    ratio_, jac, con, seg = X.sequence_ratio(x, y), X.jaccard(gx, gy), X.containment(gx, gy), X.jaccard(segments(a), segments(b))
    empty, equal = (x == "") | (y == ""), x == y
    enough = (ratio_ >= 0.58) | (jac >= 0.38) | ((con >= 0.62) & (ratio_ >= 0.42)) | ((seg >= 0.34) & (con >= 0.45))
    show = lambda c: F.when(empty, 0.0).when(equal, 1.0).otherwise(F.round(c, 4))
    return {"sequence_ratio": show(ratio_), "ngram_jaccard": show(jac), "ngram_containment": show(con), "segment_overlap": show(seg), "consistent": F.when(empty, False).when(equal, True).otherwise(enough)}


def alignment(questions: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Which side every key is on: both, question_only, answer_only."""
    q, a = questions.select(key).distinct().withColumn("q", F.lit(1)), answers.select(key).distinct().withColumn("a", F.lit(1))
    side = F.when(F.col("q").isNull(), "answer_only").when(F.col("a").isNull(), "question_only").otherwise("both")
    return q.join(a, key, "full_outer").select(key, side.alias("side"))


def export_bundle(questions: DataFrame, answers: DataFrame, key: str = "question_id", text: str = "question_text") -> DataFrame:
    """One row per question with its answer, met by id, else by text; without one "N/A" and status missing. Answers that no
    question asked for follow with status unmatched."""
    tasks = tasks_for(questions)
    a = answers.select(F.col(key).alias("a_id"), F.col(text).alias("a_text"), "value")
    by_id = dealt(questions, key, tasks=tasks).join(dealt(a.where(F.col("a_id").isNotNull()), "a_id", tasks=tasks).dropDuplicates(["a_id"]), F.col(key) == F.col("a_id"), "left")
    by_text = dealt(a.where(F.col("a_text").isNotNull()), "a_text", tasks=tasks).groupBy(F.col("a_text").alias("t_text")).agg(F.first("value").alias("t_value"))
    both = dealt(by_id, text, tasks=tasks).join(by_text, F.col("a_id").isNull() & (F.col(text) == F.col("t_text")), "left")
    found = F.col("a_id").isNotNull() | F.col("t_text").isNotNull()
    out = both.select(key, text, F.coalesce("value", "t_value", F.lit("N/A")).alias("value"), F.when(found, "answered").otherwise("missing").alias("status"))
    rest = dealt(answers, key, tasks=tasks).join(dealt(questions.select(F.col(key).alias("q_id")), "q_id", tasks=tasks).distinct(), F.col(key) == F.col("q_id"), "left_anti")
    rest = dealt(rest, text, tasks=tasks).join(dealt(questions.select(F.col(text).alias("q_text")), "q_text", tasks=tasks).distinct(), F.col(text) == F.col("q_text"), "left_anti")
    return out.unionByName(rest.select(key, text, "value", F.lit("unmatched").alias("status")))
