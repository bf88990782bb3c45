"""A catalogue's faults, choices by the whole hash, and what can't be asked."""

import hashlib

from pyspark.sql import functions as F

from ledgerlens.operators import curate as K
from ledgerlens.operators import templates as Q
from ledgerlens.plans.samples import CATALOGUE


def test_faults_of_a_catalogue():
    assert Q.catalog_faults(CATALOGUE, []) == []
    n1 = CATALOGUE[0]
    bad = [n1, n1 | {"generation_mode": "per_day"}, {"template_id": "x"}, n1 | {"template_id": "y", "surface_forms": []}, n1 | {"template_id": "z", "schema": "boolean", "target_key": "luck"}, n1 | {"template_id": "w", "schema": "name", "target_key": "chairman"}]
    got = Q.catalog_faults(bad, ["chairman"])
    assert ("n1", "its id stands twice") in got and ("n1", "unknown mode per_day") in got and ("x", "no schema") in got and ("y", "no surface form") in got and ("z", "unknown target luck") in got
    assert not [f for i, f in got if i == "w"]
    assert not Q.catalog_faults([n1 | {"schema": "boolean", "target_key": "share_buyback_plan"}], [])


def test_the_whole_hash_chooses(spark):
    """As the remainder of the whole number, for any number of wordings."""
    forms = [f"form {i}" for i in range(7)]
    for n in (1, 2, 3, 5, 6, 7):
        for key in ("a", "17", "公司"):
            want = int(hashlib.sha1(f"s::{key}".encode()).hexdigest(), 16) % n
            got = spark.range(1).select(K.surface_form(forms[:n], F.lit(key), "s").alias("x")).first().x
            assert (got.variant, got.text) == (f"{want:02d}", f"form {want}")


def test_what_cannot_be_asked(spark):
    rows = [("1", "A", 2024), (None, "B", 2024), ("3", None, 2024), ("4", " ", 2024), ("5", "C", None), ("6", "D", 0)]
    df = spark.createDataFrame(rows, "doc_id string, company_name string, report_year int")
    assert {r.doc_id for r in Q.per_document(df, CATALOGUE, "v").collect()} == {"1"}
    only = [CATALOGUE[0] | {"surface_forms": ["{nobody} knows"]}]
    assert Q.per_document(df, only, "v").count() == 0
    most = [t | {"max_per_doc": 2} for t in CATALOGUE]
    assert {r.template_id for r in Q.per_document(df, most, "v").collect()} == {"n1", "n2"}
    pairs = spark.createDataFrame([("1", "2", "A", "B", 2024), ("1", None, "A", "B", 2024), ("1", "2", "A", "", 2024), ("1", "2", "A", "B", None)], "doc_a string, doc_b string, company_a string, company_b string, year int")
    assert Q.per_pair(pairs, CATALOGUE).count() == 1
