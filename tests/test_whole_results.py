"""Results that must not depend on how rows are dealt, how many there are, or how near an amount is to a whole one."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.operators import sft as L
from ledgerlens.operators import tables as T
from ledgerlens.plans import files

SF = "/root/testdata/sf0.001"


def most_rows(spark, df):
    """The most rows that a step of df's plan gave, and df's rows."""
    got = df.collect()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    values, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    found = [0]
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        for k in range(metrics.size()):
            m = metrics.apply(k)
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                found.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return max(found), got


def test_other_companies(spark):
    kinds = [None, "", "a", "b"]
    reports = [(i, None if i % 41 == 0 else i * i % 97 // (1 + i % 3), 2000 + i % 2, kinds[i * 7 % 4]) for i in range(700)]
    queries = [(q, q * 3 % 700 if q % 5 else -1, ["", None][q % 2] if q % 9 == 0 else q % 40, 2000 + q % 3, kinds[q // 3 % 4]) for q in range(600)]
    want = []
    for q, doc, company, year, kind in queries:
        fits = [d for d, o, y, k in reports if y == year and d != doc and (not company and company != 0 or o != company) and (not kind or not k or k == kind)]
        want += [(q, d, n) for n, d in enumerate(sorted(fits)[:4], 1)]
    text = lambda rows: [(a, b, None if c is None else str(c), d, e) for a, b, c, d, e in rows]
    asks = spark.createDataFrame(text(queries), "q long, doc long, company string, year int, kind string")
    held = spark.createDataFrame([(a, None if b is None else str(b), c, d) for a, b, c, d in reports], "doc long, company string, year int, kind string")
    most, got = most_rows(spark, L.other_companies(asks, held, 4, "q"))
    assert sorted(map(tuple, got)) == sorted(want)
    assert most <= 4 * len(queries)  # not a row per query and report


def test_parts_of_one_place(spark):
    rows = [(1, 5, float(q), h) for q, h in ((3, "a"), (1, None), (2, "b"), (2, "a"))]
    out = lambda some: sorted(map(str, T.row_offsets(spark.createDataFrame(some, "doc long, part long, n double, h string").coalesce(1), ["doc"], ["part", "n", "h"], "n").withColumn("head", T.inherited(F.col("h"), ["doc"], ["part", "n", "h"])).collect()))
    assert out(rows) == out(rows[::-1])


def test_documents_of_a_manifest_are_dealt_anyhow(spark):
    keys = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = files.QUERIES["manifest_json_to_csv"](spark, SF).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == sorted(map(tuple, spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name", "p_size").collect()))


def test_amounts_beside_whole_ones(spark):
    cases = [("299999999.99", 2, 3), ("300000000.00", 2, 4), ("300000000.01", 3, 4), ("300000004.00", 3, 4), ("0.01", 1, 1), ("99999999.99", 1, 1), ("100000000.00", 1, 2)]
    df = spark.createDataFrame([(Decimal(v),) for v, _, _ in cases], "v decimal(20,2)")
    low, high = (L.threshold_variant(F.col("v"), F.lit(i))[0] for i in (0, 1))
    assert [tuple(r) for r in df.select(low.alias("a"), high.alias("b")).collect()] == [(a, b) for _, a, b in cases]
    df = spark.createDataFrame([(Decimal("49.999999"), "百万元"), (Decimal("50"), "百万元"), (Decimal("0.499999"), "万元"), (Decimal("49.9999"), "亿元")], "v decimal(38,6), u string")
    got = df.select(F.coalesce(*[F.when(F.col("u") == u, L.unit_variant(F.col("v"), u)) for u in ("百万元", "万元", "亿元")]).alias("x")).collect()
    assert [r.x for r in got] == [0.0, 0.0001, 0.0, 0.0]
