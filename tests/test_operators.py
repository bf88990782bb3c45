"""Rules for missing values, ties and quirks that the tables don't hold."""

from pyspark.sql import functions as F

from ledgerlens.functions import text as X
from ledgerlens.operators import answers as A
from ledgerlens.operators import chunks as C
from ledgerlens.operators import evaluate as E
from ledgerlens.operators import filters as P
from ledgerlens.operators import fusion as U
from ledgerlens.operators import sft as L
from ledgerlens.operators import tables as T
from ledgerlens.sources import manifests as M
from ledgerlens.streaming import events as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_numbers(spark):
    cases = [("4,000 million", None, 4000.0), ("12-15", None, -12.0), ("(3.5)", None, -3.5), ("50 %", None, 50.0), ("50％ 万元", None, 50.0), ("none", None, None), ("2亿元", None, 2e8), ("３", "百万元", 3e6), ("1，234", "万元人民币", 1234e4), ("7", "亿股", 7e8), ("8", "千万", 8e7), ("12亿元 万元", None, 12e8), ("12万元 亿元", None, 12e8), ("5百万元 亿港元", None, 5e8), ("5", "万元 亿股", 5e8), ("5亿元", "万元人民币", 5e4)]
    for text, hint, want in cases:
        got = one(spark, X.parse_numeric(F.lit(text), None if hint is None else F.lit(hint)))
        assert got == want, (text, got)


def test_tokens_that_name_things(spark):
    for text, want in (("2024 Q3 report", "2024Q3"), ("2024年度报告", "2024年报"), ("在2024 年报中", "2024年报"), ("2023半年度报告", "2023半年报"), ("2024", None)):
        assert one(spark, X.period_token(F.lit(text))) == want, text
    assert one(spark, X.security_codes(F.lit("SH600519, 000001.SZ 1600519 600519 A300750"))) == ["600519", "000001"]
    assert one(spark, X.currency_token(F.lit(" ＵＳ$ "))) == "USD" and one(spark, X.currency_token(F.lit("人民币"))) == "CNY" and one(spark, X.currency_token(F.lit("xyz"))) == "XYZ"
    assert one(spark, X.normalize_text(F.lit("Ａ，Ｂ（1,234%）—x\u00a0y"))) == "a,b(1234 % )-x y"
    assert one(spark, X.snippet(F.lit("a " * 200))) == ("a " * 110).rstrip() + "..."
    assert one(spark, X.snippet_around(F.lit("AI"), F.lit("x" * 100 + " ai " + "y" * 200))) == "x" * 79 + " ai " + "y" * 139
    assert one(spark, X.char_ngrams(F.lit("ab"), 3)) == ["ab"] and one(spark, X.char_ngrams(F.lit("a\nbc"), 2)) == ["a\n", "\nb", "bc"]


def test_tokens_of_cjk(spark):
    assert one(spark, X.index_tokens(F.lit("营业收入 ABC abc"))) == ["abc", "营业收入", "营业", "业收", "收入"]  # the run is itself a term of finance


def test_filters_with_missing_values(spark):
    none = F.lit(None).cast("string")
    assert one(spark, P.permissive(none, "a")) and not one(spark, P.permissive(F.lit("b"), "a"))
    assert one(spark, P.bi_contains(none, F.lit("a"))) and one(spark, P.bi_contains(F.lit("A B"), F.lit("b")))
    tags = lambda *t: F.array(*map(F.lit, t)).cast("array<string>")
    assert not one(spark, P.tags_match(tags(), tags("x")))
    assert one(spark, P.tags_match(tags("solar power"), tags("solar")))
    assert one(spark, P.tags_match(tags(), tags())) and one(spark, P.tags_match(tags("a"), F.lit(None).cast("array<string>")))
    assert not one(spark, P.section_matches(F.lit("risk"), none, none)) and one(spark, P.section_matches(none, none))
    assert one(spark, P.flags_cover(tags("a", "b"), tags("a")))


def test_minmax_of_equal_scores(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 0.0), (2, 0.0)], "g int, s double")
    assert [r.m for r in df.withColumn("m", U.minmax(F.col("s"), ["g"])).orderBy("g").collect()] == [1.0, 1.0, 0.0, 0.0]


def test_parents_stop_at_the_next_parent(spark):
    rows = [(1, 1, "a", 10), (1, 2, "b", 11), (1, 3, "c", 12), (1, 4, "a", 13)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "q int, rank int, parent string, chunk int, score double")
    got = {r.parent: r.children for r in U.parents_of(df, ["q"], 2).collect()}
    assert got == {"a": "10", "b": "11"}


def test_greedy_pairs(spark):
    df = spark.createDataFrame([("d", 1, 2, 0.9), ("d", 1, 3, 0.95), ("d", 2, 3, 0.8), ("d", 4, 2, 0.7), ("d", 5, 6, 0.1)], "doc string, left int, right int, score double")
    assert {(r.left, r.right) for r in T.greedy_pairs(df, "doc").collect()} == {(1, 3), (4, 2)}


def test_page_repair_and_json(spark):
    ints = lambda *v: F.array(*map(F.lit, v)).cast("array<int>")
    assert one(spark, A.repair_pages(ints(9), ints(3, 4))) == [3]
    assert one(spark, A.repair_pages(ints(4, 9, 4), ints(3, 4))) == [4, 4]
    assert one(spark, A.repair_pages(ints(4), ints(3, 4, 5), 3)) == [4, 3, 5]
    assert one(spark, A.last_json_value(F.lit('{"a": 1} then {"a": "two"}, "a": null'), "a")) == '"two"'
    assert one(spark, A.downgrade(F.lit("high"), F.lit(5))) == "low"


def test_chunks(spark):
    df = spark.createDataFrame([(1, 1, "intro\n# A\nx\n\n### B \ny"), (2, 1, None), (3, 4, "  "), (4, 2, "公司概况\n正文，一")], "doc_id long, page int, text string")
    got = [(r.doc_id, r.section_title, r.text) for r in C.sections(df).orderBy("doc_id", "block").collect()]
    assert got == [(1, "Page 1", "intro"), (1, "A", "# A\nx"), (1, "B", "### B\ny"), (4, "公司概况", "公司概况\n正文，一")]
    assert C.split_text("a b c. d e. f", 3, 0) == ["a b c", ". d e", ". f"] and C.split_text(" ", 3, 0) == []
    long = C.split_text(" ".join(f"w{i}" for i in range(50)), 10, 4, (" ",))
    assert all(C.count_words(p) <= 10 for p in long) and long[1].split()[:4] == long[0].split()[-4:]
    pages = spark.createDataFrame([(1, 3, "z")], "doc_id long, page int, text string")
    assert [r.page for r in C.fill_pages(pages).orderBy("page").collect()] == [1, 2, 3]


def test_page_assembly():
    block = lambda kind, text="", table=None: {"type": kind, "text": text, "table_id": table}
    blocks = [block("section_header", "Top"), block("text", "Sales:"), block("table", table="7"), block("text", "note"), block("footnote", "1 f"), block("paragraph", "Lead"), block("paragraph", "Items:"), block("list_item", "a"), block("list_item", "b"), block("page_footer", "9"), block("page_header", "Late"), block("text", " ")]
    want = "# Top\n\n\nSales:\n|m|\nnote\n1 f\n\n\n\n### Lead\n\n\nItems:\n- a\n- b\n\n\n\n## Late"
    assert C.assemble(blocks, {"7": "|m|"}) == want
    assert C.assemble([]) == "" and C.assemble([block("page_header", "H"), block("section_header", "S")]) == "# H\n\n\n## S"
    import pytest

    with pytest.raises(ValueError):
        C.assemble([block("odd")])


def test_page_texts(spark):
    rows = [("d", 1, 0, "text", "Rows:", None, None), ("d", 1, 1, "table", None, 3, None), ("d", 1, 2, "picture", None, None, 5), ("d", 2, 0, "picture", None, None, 6)]
    blocks = spark.createDataFrame(rows, "doc string, page int, pos int, type string, text string, table_id int, picture_id int")
    tables = spark.createDataFrame([("d", 3, "|a|")], "doc string, table_id int, markdown string")
    charts = spark.createDataFrame([("d", "c1", 1, 5, "|x|", None, "near")], "doc string, chart_id string, page int, picture_id int, table_markdown string, raw_output string, context_text string")
    got = {(r.doc, r.page): r.text for r in C.page_texts(blocks, tables, charts).collect()}
    assert got == {("d", 1): "Rows:\n|a|\n\n\n[Chart Evidence]\n图表ID：c1\n页码：1\n图片ID：5\nDePlot表格：\n|x|\n周边说明：\nnear"}


def test_glyphs(spark):
    text, n = C.clean_glyphs(F.lit("/one.pl/two.tnum.pl glyph<c=1,font=2>/A.cap/slash.casefive /dollar.sups"))
    assert one(spark, text) == "12 A/five $" and one(spark, n) == 6


def test_pixel_boxes(spark):
    box = lambda l, t, r, b: one(spark, C.pixel_box(*map(F.lit, (l, t, r, b)), F.lit(100.0), F.lit(200), F.lit(200), F.lit(2.0), 1))  # noqa: E731, E741
    assert box(10.0, 20.0, 30.5, 40.0) == [19, 39, 62, 81] and box(10.0, 40.0, 30.0, 20.0) == [19, 119, 61, 161] and box(-5.0, 0.0, -1.0, 0.0) == [0, 0, 1, 1]


def test_manifests(spark, tmp_path):
    (tmp_path / "manifest.csv").write_text("doc_id,company_name,report_year\n1, A ,2024\n1,B,oops\n2,,2023\n")
    df = M.last_wins(M.read_manifest_csv(spark, str(tmp_path / "manifest.csv")))
    assert {(r.doc_id, r.company_name, r.report_year) for r in df.collect()} == {("1", "B", None), ("2", None, 2023)}
    assert one(spark, M.split_aliases(F.lit("a|b、a; c"))) == ["a", "b", "c"]


def test_streams_equal_batches(spark, tmp_path):
    events = spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600 + 86_400).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("t").alias("event_type"), F.lit(1.0).alias("value"))
    events.write.parquet(str(tmp_path / "in"))
    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    stream = S.read_stream(spark, str(tmp_path / "in"))
    assert run(S.tumbling(stream, late="1 hour"), "tumbled", "complete") == sorted(map(tuple, S.tumbling(events).collect()))
    assert len(run(S.distinct_events(stream), "distinct_events", "append")) == 200


def test_edges_of_tables(spark):
    score = lambda *levels, **k: one(spark, T.edge_score(*map(F.lit, levels), **{n: F.lit(v) for n, v in k.items()}))
    assert score(2, 1, 3, 2, 1, True, row_continuity=True) == 0.98 and score(0, 0, 0, 0, 0, False) == 0.0 and score(0, 0, 1, 0, 0, True) == 0.30


def test_greedy_pairs_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = sorted({(d, p, 100 * p + rng.randrange(4), 100 * (p + 1) + rng.randrange(4)) for d in range(20) for p in range(4) for _ in range(9)})
    rows = [(*r, rng.randrange(50, 100) / 100) for r in rows]
    df = spark.createDataFrame(rows, "doc int, page int, left int, right int, score double")
    want, left, right = set(), set(), set()
    for d, _, a, b, s in sorted(rows, key=lambda r: (r[0], -r[4], r[2], r[3])):
        if s >= 0.62 and (d, a) not in left and (d, b) not in right:
            want.add((d, a, b))
            left.add((d, a))
            right.add((d, b))
    assert {(r.doc, r.left, r.right) for r in T.greedy_pairs(df, "doc").collect()} == want
    tables = spark.createDataFrame(sorted({(r[0], t, t // 100) for r in rows for t in (r[2], r[3])}), "doc int, table_id int, page int")
    chains = T.table_chains(tables, T.greedy_pairs(df, "doc"), "doc").collect()
    after = {(d, a): b for d, a, b in want}
    heads = {k for k in after if k not in {(d, b) for d, _, b in want}}
    expected = {}
    for d, h in heads:
        chain = [h]
        while (d, chain[-1]) in after:
            chain.append(after[d, chain[-1]])
        expected[d, h] = chain
    got = {}
    for r in sorted(chains, key=lambda r: r.place):
        got.setdefault((r.doc, r.logical_table_id), []).append((r.table_id, r.role))
    assert sorted((k[0], [t for t, _ in v]) for k, v in got.items()) == sorted((d, c) for (d, _), c in expected.items())
    assert all(v[0][1] == "head" and v[-1][1] == "tail" for v in got.values())


def test_measures(spark):
    assert one(spark, X.numeric_similarity(F.lit(0.5), F.lit(0.25))) == 0.75 and one(spark, X.numeric_similarity(F.lit(1e-10), F.lit(0.0))) == 1.0
    assert one(spark, E.metric_number(F.lit("1,234元"))) == 1234.0 and one(spark, E.metric_number(F.lit("12万元"))) is None and one(spark, E.metric_number(F.lit("5 %"))) == 5.0
    words = lambda *t: F.array(*map(F.lit, t)).cast("array<string>")
    assert one(spark, E.multiset_f1(words("a", "a", "b"), words("a", "c"))) == 0.4 and one(spark, E.list_f1(words(), words())) == 1.0
    same = E.consistency(F.lit("营业收入增长。主要来自海外"), F.lit("主要来自海外；营业收入增长"))
    assert one(spark, same["consistent"]) and one(spark, same["segment_overlap"]) == 1.0
    none = E.consistency(F.lit(""), F.lit("x"))
    assert not one(spark, none["consistent"]) and one(spark, none["sequence_ratio"]) == 0.0


def test_names_and_booleans(spark):
    tier = lambda a, b: one(spark, L.same_name(F.lit(a), F.lit(b)))
    assert tier("甲公司", "甲公司") == "exact" and tier("A（B）", "a(b)") == "normalized_exact" and tier("甲股份有限公司", "甲") == "alias_exact" and tier("甲", "乙") == "mismatch" and tier("", "x") == "missing_value"
    line = lambda a, q: one(spark, L.boolean_line(F.lit(a), F.lit(q)))
    assert line("本年不进行现金分红", "是否提到现金分红？") == "explicit_negative" and line("派发现金红利", "是否提到现金分红？") == "explicit_positive"
    assert line("公司未涉及诉讼", "公司是否存在诉讼？") == "explicit_negative" and line("无关", "公司是否存在诉讼？") is None
    target = lambda q: one(spark, L.boolean_target(F.lit(q)))
    assert [target(q) for q in ("是否有回购方案？", "审计报告是否为非标？", "控制权变更与否", "派息多少", "营业收入")] == ["share_buyback_plan", "nonstandard_audit_opinion", "controlling_shareholder_change", "cash_dividend_plan", None]
    assert line("公司无回购计划", "是否披露股份回购？") == "explicit_negative" and line("拟回购", "是否披露股份回购？") == "explicit_positive" and line("审计意见类型: 标准无保留意见", "审计意见是否为非标？") == "explicit_negative"
    assert line("实际控制人未发生变更", "控股股东变更了吗？") is None  # none of the words that state it stands in the line
    items = spark.createDataFrame([(1, 1, "回购方案：拟回购\n未实施回购，回购计划"), (2, 1, "现金分红\n不分红，派息"), (3, 1, "现金分红\n不分红，派息，拟分配")], "q int, page int, text string")
    asked = spark.createDataFrame([(1, "是否披露股份回购？"), (2, "现金分红吗"), (3, "现金分红吗"), (4, "派息")], "q int, question string")
    got = {r.q: r.classification for r in L.boolean_context(items, asked, "q").collect()}
    assert got == {1: "explicit_negative", 2: "conflict", 3: "explicit_negative", 4: "insufficient_evidence"}
