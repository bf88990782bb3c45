"""The registered queries op1 to op10 and the pipeline, each against its SQL or a brute-force version of its contract."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from ledgerlens.llm import decontamination, packing, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def duck(folder):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{folder if f.startswith('documents') else SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck(SF).execute(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    show = lambda df: sorted(map(str, df.astype(object).itertuples(index=False, name=None)))
    assert len(got) and show(got) == show(want)


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.9), ("op4_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    folder = SF.replace("0.001", "0.01")
    got = queries.QUERIES[name](spark, folder).toPandas()
    assert len(got) == len(pd.read_parquet(f"{folder}/documents.parquet")) and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    both = got.loc[got.held_out, ["doc_id", "predicted"]].merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id").dropna(subset=[label])
    assert (both.predicted == both[label]).mean() >= least


def test_suffix_dedup_by_brute_force(spark, documents):
    raw = [t.encode() if t else b"" for t in documents.text]
    seen: dict[bytes, int] = {}
    for t in raw:
        for i in range(len(t) - 399):
            d = hashlib.blake2b(t[i : i + 400], digest_size=16).digest()
            seen[d] = seen.get(d, 0) + 1
    want = {}
    for doc, t in zip(documents.doc_id, raw):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 399):
            if seen[hashlib.blake2b(t[i : i + 400], digest_size=16).digest()] > 1:
                gone[i : i + 400] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[doc] = (len(t), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2] if len(gone) > 1 else [])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op3_suffix_dedup"](spark, SF).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_edited_fingerprints_by_brute_force(spark, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op5_edit_fingerprints"](spark, SF).collect()}
    texts = dict(zip(documents.doc_id, documents.text.fillna("")))
    ids = sorted(texts, reverse=True)
    prints = {}
    for k, i in enumerate(ids):
        x, y = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = x[: len(x) - len(x) // 3] + y[: len(x) // 3]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(x, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    both = pd.DataFrame([(r.near_edited, r.near_next) for r in got.values() if r.n_chars > 300], columns=["edited", "next"])
    assert both.edited.mean() > 0.5 and both.next.mean() < 0.3


def naive_sum_of_squares(lengths, capacity, opening=True):
    """The rule as it is defined: of every open bin that is wide enough, and a new one, the least sum of squared counts."""
    bins: list[int] = []  # residual gaps
    out = {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size, best = lengths[i], None
        held = {}
        for g in bins:
            if 0 < g < capacity:
                held[g] = held.get(g, 0) + 1

        def total(change):
            now = dict(held)
            for g, d in change:
                if 0 < g < capacity:
                    now[g] = now.get(g, 0) + d
            return sum(v * v for v in now.values())

        choices = [(total([(g, -1), (g - size, 1)]), 0, g) for g in sorted(set(bins)) if g >= size]
        if opening or not choices:
            choices.append((total([(capacity - size, 1)]), 1, capacity))
        best = min(choices)
        if best[1]:
            bins.append(capacity - size)
            out[i] = (best[2], capacity - size)
        else:
            at = len(bins) - 1 - bins[::-1].index(best[2])
            bins[at] -= size
            out[i] = (best[2], bins[at])
    return sorted(bins)


@pytest.mark.parametrize("opening", [True, False])
def test_packing_rule_by_its_definition(opening):
    rng = np.random.default_rng(4)
    for capacity, n in ((10, 60), (50, 200), (64, 150)):
        lengths = rng.integers(1, capacity + 1, n)
        got = packing.sum_of_squares(lengths, capacity, opening)
        assert sorted((capacity - np.bincount(got, lengths)).astype(int).tolist()) == naive_sum_of_squares(lengths.tolist(), capacity, opening)


def test_packing_query(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.QUERIES["op6_best_fit_pack"](spark, SF).toPandas()
    want = {}
    for doc, text in zip(documents.doc_id, documents.text.fillna("")):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[doc, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1


def test_simhash_query_by_brute_force(spark, documents):
    prints = {}
    for doc, text in zip(documents.doc_id, documents.text.fillna("")):
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
        runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    component = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and component[a] < component[b]:
                    component[b], changed = component[a], True
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op10_simhash_near_dedup"](spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", component[d]) for d in prints}


# -- the pipeline --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output."""
    docs, base, out = spark.read.parquet(f"{SF}/documents.parquet"), tmp_path_factory.mktemp("stages"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        before, docs = docs, spark.read.parquet(f"{base}/{name}")
        out[name] = (before, docs)
    return out


def test_pipeline_keeps_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    for name in list(stages)[:-1]:
        assert stages[name][0].columns == stages[name][1].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_toxicity(stages):
    before, after = (x.toPandas() for x in stages["toxicity"])
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    gone = set(before.doc_id) - set(after.doc_id)
    clean = set(labels[labels.toxic == 0].doc_id)
    assert len(gone & clean) <= 0.05 * max(1, len(clean))


def test_pipeline_line_dedup(stages):
    before, after = (x.toPandas() for x in stages["line_dedup"])
    strip = " \t\n\x0b\f\r"
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(strip))
    held: dict[str, set] = {}
    for r in before.itertuples():
        for s in (r.text or "").split("\n"):
            if len(key(s)) >= 20:
                held.setdefault(key(s), set()).add(r.doc_id)
    want = {r.doc_id: "\n".join(s for s in (r.text or "").split("\n") if len(held.get(key(s), ())) < 3 or max(held[key(s)]) == r.doc_id) for r in before.itertuples()}
    assert dict(zip(after.doc_id, after.text)) == want and (after.n_chars == after.text.str.len()).all()


def test_pipeline_near_copies(stages):
    before, after = (x.toPandas() for x in stages["near_copy_dedup"])
    sets = {}
    for r in before.itertuples():
        words = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower())
        sets[r.doc_id] = frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert set(after.doc_id) == {d for d in ids if find(d) == d}


def test_pipeline_decontamination(stages, tmp_path):
    before, after = stages["decontamination"]
    before.toPandas().to_parquet(tmp_path / "documents.parquet")
    bad = set(duck(str(tmp_path)).execute(decontamination.OP7_SQL).df().doc_id)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad


def test_pipeline_run_packs_all(spark, stages):
    before, after = stages["best_fit_pack"]
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) == {r.doc_id for r in before.collect()} and len(got) == after.count()
    assert got.groupby("sequence_id").length.sum().max() <= 4096
