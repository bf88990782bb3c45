"""Work that several configurations or questions share is done once."""

from ledgerlens.operators import retrieval as R
from ledgerlens.plans import analytics, search, stores


def test_configurations_share_their_lists(spark, monkeypatch):
    asked = []
    for name in ("_bm25", "_tags"):
        real = getattr(search, name)
        monkeypatch.setattr(search, name, lambda s, d, k, real=real, name=name: asked.append(name) or real(s, d, k))
    assert search.configured_retrieval(spark, "/root/testdata/sf0.001").count()
    assert sorted(asked) == ["_bm25", "_tags"]


def test_tags_by_sets(spark):
    rows = [(i, t) for i in range(60) for t in {f"a{i % 3}", f"b{i % 4}", "b0"}] + [(7, None), (None, "a1"), (99, ""), (98, None)]
    asked = [(1, "a1"), (1, "b"), (2, "b0x"), (3, "zz")]
    got = R.tag_topk(spark.createDataFrame(rows, "doc_id long, tag string"), spark.createDataFrame(asked, "qid long, term string"), 5)
    got = sorted((r.qid, r["rank"], r.doc_id, r.score) for r in got.collect())
    want = []
    for q in {q for q, _ in asked}:
        scored = []
        for doc in {d for d, _ in rows if d is not None}:
            own = {t for d, t in rows if d == doc and t is not None}
            hits = {x for p, x in asked if p == q for t in own if t and (x in t or t in x)}
            if hits:
                scored.append((-round(len(hits) / max(1, len(own)), 4), doc))
        want += [(q, i + 1, doc, -s) for i, (s, doc) in enumerate(sorted(scored)[:5])]
    assert got == sorted(want)


def test_only_fields_that_are_read_are_taken_from_results(spark):
    plan = stores.result_round_trip(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "$.company_name" in plan and "$.security_code" not in plan and "schema_of_variant" not in plan.lower() and "SchemaOfVariant" not in plan


def test_table_texts_are_squeezed_table_by_table(spark):
    """Pairs are scored from squeezed texts, once: no text form above the join, and one column of scores for all filters."""
    plan = analytics.table_greedy_matching(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert "regexp_replace" not in above.lower() and plan.count("0.18 + ") == 1
