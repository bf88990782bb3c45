"""Questions from a catalogue of templates: its faults, and a question per document or pair of documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curate import stable_hash, surface_form
from .grounding import fixed
from .retrieval import dealt, tasks_for
from .sft import TARGETS

#: What every template must say, how questions are made, and the numbers that can be asked for (fixed values).
REQUIRED = ("template_id", "template_family", "schema", "task_type", "generation_mode", "target_key", "surface_forms", "section_hints", "split_pool", "answer_policy", "validator_target", "max_per_doc")
MODES = ("per_doc", "per_bucket", "per_pair")
NUMBERS = ("revenue", "attributable_net_profit", "deducted_attributable_net_profit", "operating_cashflow_net", "basic_eps", "asset_liability_ratio")
#: A hash modulo this has the same remainder as the hash itself for every number of choices up to 16.
CHOICES = 720_720
#: Reports of one task.
REPORTS = 20_000


def catalog_faults(templates: Iterable[Mapping], names: Iterable[str], booleans: Iterable[str] = tuple(TARGETS), numbers: Iterable[str] = NUMBERS) -> list[tuple[str, str]]:
    """(template_id, fault) of a catalogue, in its order; none: it can be used. Targets of each kind must be known ones."""
    templates = list(templates)
    known = {"name": set(names), "boolean": set(booleans), "number": set(numbers)}
    twice = {k for k, n in Counter(str(t.get("template_id")) for t in templates).items() if n > 1}
    out = []
    for t in templates:
        own = str(t.get("template_id"))
        faults = [f"no {f}" for f in REQUIRED if f not in t]
        if own in twice:
            faults.append("its id stands twice")
        if "generation_mode" in t and t["generation_mode"] not in MODES:
            faults.append(f"unknown mode {t['generation_mode']}")
        if "surface_forms" in t and (not isinstance(t["surface_forms"], list) or not t["surface_forms"]):
            faults.append("no surface form")
        if len(t.get("surface_forms") or ()) > 16 or len(t.get("section_hints") or ()) > 16:
            faults.append("more than 16 choices")
        if t.get("schema") in known and t.get("target_key") not in known[t["schema"]]:
            faults.append(f"unknown target {t.get('target_key')}")
        out += [(own, f) for f in faults]
    return out


def _choice(key: Column, salt: str, n: int) -> Column:
    return stable_hash(F.concat(F.lit(f"{salt}::"), key), CHOICES) % n


def _record(t: Mapping, asked: Column, query_id: Column, **more: Column) -> Column:
    fields = {k: F.lit(str(t[k])) for k in ("schema", "template_id", "template_family", "target_key", "split_pool", "answer_policy", "validator_target")}
    return F.struct(query_id.alias("query_id"), asked["text"].alias("question_text"), asked["variant"].alias("surface_variant_id"), *[v.alias(k) for k, v in (fields | more).items()])


def per_document(reports: DataFrame, templates: list[Mapping], version: str, doc: str = "doc_id") -> DataFrame:
    """A question per report and chosen template: (doc, query_id, question_text, ...).

    reports: doc, company_name, report_year. Of the templates of each kind, in order of their ids, a report takes as many as
    the largest max_per_doc, going round from where a hash of the report points. Section and wording are chosen by hashes
    too, the same on every run. A question whose wording names its section is a section_filter. The catalogue is a driver's
    list; reports are dealt to tasks of REPORTS each, since a few bytes of one make much work. Reports without a name, a year or an id are left out; so is a template none of whose
    wordings can be filled in.
    """
    key = F.col(doc).cast("string")
    rows = dealt(reports, doc, tasks=tasks_for(reports, REPORTS)).where((F.trim(key) != "") & (F.trim("company_name") != "") & F.col("report_year").isNotNull() & (F.col("report_year") != 0))
    made, first, second = [], {}, {}
    for schema in sorted({t["schema"] for t in templates if t["generation_mode"] == "per_doc"}):
        own = sorted((t for t in templates if t["generation_mode"] == "per_doc" and t["schema"] == schema), key=lambda t: str(t["template_id"]))
        most, start = max(int(t.get("max_per_doc") or 1) for t in own), F.col(f"__start_{len(first)}")
        first[f"__start_{len(first)}"] = _choice(key, f"{schema}:{version}", len(own))
        for i, t in enumerate(own):
            hints = [str(h) for h in t.get("section_hints") or () if str(h).strip()]
            section = F.col(f"__section_{len(second)}")
            first[f"__section_{len(second)}"] = F.element_at(F.array(*map(F.lit, hints)), (_choice(key, f"{t['template_id']}:section", len(hints)) + 1).cast("int")) if hints else F.lit(None).cast("string")
            context = {"company_name": F.col("company_name"), "report_year": F.col("report_year"), "section_name": section} | {k: F.lit(t.get(k)).cast("string") for k in ("field_label", "metric_label", "question_suffix")}
            asked = F.col(f"__asked_{len(second)}")
            second[f"__asked_{len(second)}"] = surface_form(t["surface_forms"], key, f"{t['template_id']}:surface", **context)
            names_it = F.element_at(F.array(*[F.lit("{section_name}" in f) for f in t["surface_forms"]]), asked["variant"].cast("int") + 1)
            said = F.concat(F.lit(f"seed-v2-{schema}-{t['target_key']}-"), asked["variant"], F.lit("-"), key)
            record = _record(t, asked, said, task_type=F.when(names_it, "section_filter").otherwise(str(t["task_type"])), section_name=F.when(names_it, section))
            made.append(F.when((F.pmod(F.lit(i) - start, F.lit(len(own))) < most) & asked.isNotNull(), record))
    rows = fixed(fixed(rows, **first), **second) if made else rows  # each hash and each wording is worked out once
    return rows.select(doc, "company_name", "report_year", F.inline(F.array_compact(F.array(*made))))


def per_pair(pairs: DataFrame, templates: list[Mapping]) -> DataFrame:
    """A comparing question per pair of reports and template: (doc_a, doc_b, query_id, question_text, ...).

    pairs: doc_a, doc_b, company_a, company_b, year, as curate.pair_up() and a join give them. Pairs that lack a name, an id
    or the year are left out.
    """
    a, b = F.col("doc_a").cast("string"), F.col("doc_b").cast("string")
    good = [F.trim(c) != "" for c in (a, b, F.col("company_a"), F.col("company_b"))]
    rows = pairs.where(good[0] & good[1] & good[2] & good[3] & F.col("year").isNotNull() & (F.col("year") != 0))
    made = []
    for t in sorted((t for t in templates if t["generation_mode"] == "per_pair"), key=lambda t: str(t["template_id"])):
        key = F.concat(F.lit('{"doc_ids": ["'), a, F.lit('", "'), b, F.lit(f'"], "template_id": "{t["template_id"]}"}}'))
        asked = surface_form(t["surface_forms"], key, f"{t['template_id']}:surface", year=F.col("year"), company_a=F.col("company_a"), company_b=F.col("company_b"), metric_label=F.lit(t.get("metric_label")).cast("string"))
        record = _record(t, asked, F.concat(F.lit(f"seed-v2-{t['schema']}-{t['target_key']}-"), a, F.lit("-"), b), task_type=F.lit("cross_doc_compare"))
        made.append(F.when(asked.isNotNull(), record))
    return rows.select("doc_a", "doc_b", "company_a", "company_b", "year", F.inline(F.array_compact(F.array(*made))))
