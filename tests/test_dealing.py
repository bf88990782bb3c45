"""What is dealt to more tasks, or looked for in another way, gives the same; tasks grow with the rows."""

import hashlib
import unicodedata

from pyspark.sql import functions as F

from ledgerlens.functions import text as X
from ledgerlens.operators import curate as K
from ledgerlens.operators import fusion as U
from ledgerlens.operators import retrieval as R
from ledgerlens.operators import routing as G


def test_tasks_grow_with_rows(spark):
    assert [R.tasks_for(spark.range(n), 100) for n in (0, 1, 100, 101, 1000)] == [1, 1, 1, 2, 10]
    assert R.dealt(spark.range(1000), "id", tasks=7).rdd.getNumPartitions() == 7


def test_wide_signs_stay_in_the_jvm(spark):
    texts = [None, "", "（１２％）　Ａ～！", "其中：x", "ﬁ：①", "é＋", "ａ́", "½ｘ"]
    got = [r.x for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.nfkc(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_stable_hash(spark):
    for m in (1_000_000, 720_720, 7, 1_999_999_999):
        got = spark.range(50).select(F.col("id").cast("string").alias("k")).select("k", K.stable_hash(F.col("k"), m).alias("h")).collect()
        assert all(r.h == int(hashlib.sha1(r.k.encode()).hexdigest(), 16) % m for r in got)


def test_parents(spark):
    rows = [(q, q * 100 + i + 1, (i * i + q) % 7, i, 1.0 / (i + 1)) for q in range(6) for i in range(25)]
    want = []
    for q in range(6):
        seen: dict = {}
        for _, _, p, i, s in (r for r in rows if r[0] == q):
            if p not in seen and len(seen) == 3:
                break
            seen.setdefault(p, []).append((i, s))
        want += [(q, p, n, max(s for _, s in x), ",".join(str(i) for i, _ in x), len(x)) for n, (p, x) in enumerate(seen.items(), 1)]
    df = spark.createDataFrame(rows, "qid int, rank int, parent int, chunk int, score double")
    assert sorted(map(tuple, U.parents_of(df, ["qid"], 3).select("qid", "parent", "parent_rank", "score", "children", "n_children").collect())) == sorted(want)
    plan = U.parents_of(R.dealt(df, "qid", tasks=5), ["qid"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" in plan and "hashpartitioning(qid#" in plan and ", parent#" not in "".join(x for x in plan.split("\n") if "hashpartitioning" in x)


def test_words_are_no_patterns(spark):
    words = [w for t in (G.EXCHANGES, G.BOARDS, G.MARKETS, G.CHAIN, G.DOC_TYPES, G.REPORT_TYPES, G.TOPICS, *G.TAG_WORDS.values()) for p in t.values() for w in p.split("|")]
    assert words and not set("".join(words)) & set("\\.*+?[](){}^$")


def test_currencies_of_questions(spark):
    cases = {"in ￥ 5": "¥", "RMB and $": "CNY", "by 人民币": "CNY", "a US$": "USD", "HKD": "HKD", "none": None, "xUSDx": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = df.select("t", G.rewrite(F.col("t"), X.normalize_text(F.col("t")))["currency"].alias("c")).collect()
    assert {r.t: r.c for r in got} == cases
    form = G.rewrite(F.col("t"), F.col("t"))["currency"]
    plan = df.select(form.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("HKD)") == 1
