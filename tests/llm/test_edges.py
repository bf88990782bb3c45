"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import chat, components, decontamination, edit_embedding, line_dedup, packing, quality, simhash, substring_dedup, suffix_dedup, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCAB = public_tokenizers.path("word_bpe_49k.json")
WORDS = [f"w{i}x" for i in range(400)]


def text_of(lo, hi):
    return " ".join(WORDS[lo:hi])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, text_of(0, 120)), (2, text_of(0, 120)), (3, "x " + text_of(0, 119)), (4, None), (5, ""), (6, "  \n "), (7, "a " * 30_000), (7, "a " * 30_000), (8, "kürz"), (None, text_of(5, 100)), (9, text_of(200, 300) + "\n" + text_of(5, 90))]
    return spark.createDataFrame([(i, t, "en", k, "clash") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, n_lines int, kept string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_line_dedup(spark, docs, empty):
    line = "This line stands in many documents."
    rows = [(1, f"{line}\nown"), (2, f" {line.upper()} \nb"), (3, f"{line}\n{line}"), (None, line), (4, None), (5, "short\nshort")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(df).collect()}
    assert got == {1: ("own", 2, 1), 2: ("b", 2, 1), 3: (f"{line}\n{line}", 2, 0), None: ("", 1, 1), 4: ("", 1, 0), 5: ("short\nshort", 2, 0)}
    out = line_dedup.line_dedup(docs)
    assert out.count() == docs.count() and out.columns.count("n_lines") == 1
    assert line_dedup.line_dedup(empty).count() == 0


def test_substring_dedup(docs, empty):
    got = {(r.doc_id, r.lang): (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs, bucket=1).where("doc_id is null or doc_id <> 7").collect()}
    assert got[(1, "en")] == (120, 0) and got[(2, "en")] == (120, 120) and got[(3, "en")] == (120, 119)
    assert got[(4, "en")] == got[(5, "en")] == got[(6, "en")] == (0, 0)
    assert got[(None, "en")] == (95, 95) and got[(9, "en")] == (185, 85)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_buckets_cut_again_agree(docs, monkeypatch):
    a, b = (sorted(map(str, substring_dedup.substring_dedup(docs, bucket=n).select("doc_id", "n_removed", "kept").collect())) for n in (1, 10**9))
    assert a == b
    a, b = (sorted(map(str, suffix_dedup.suffix_dedup(docs, bucket=n).select("doc_id", "n_removed", "n_spans", "kept").collect())) for n in (1, 10**9))
    assert a == b


def test_windows_sorted_in_files():
    rng = np.random.default_rng(6)
    items = [(1, i, int(rng.integers(5)), " ".join(rng.choice(list("ab"), 30)).encode()) for i in range(60)]
    assert substring_dedup._sorted_windows(items, 6, 10**9) and sorted(substring_dedup._sorted_windows(items, 6, 50)) == sorted(substring_dedup._sorted_windows(items, 6, 10**9))


def test_suffix_dedup(docs, empty):
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs).collect()}
    n = len(text_of(0, 120))
    assert got[(1, n)] == (n, 1, b"") and got[(4, 0)] == (0, 0, b"") and got[(7, 60_000)] == (60_000, 1, b"")
    # judged against brute force
    texts = [r.text.encode() if r.text else b"" for r in docs.collect()]
    count = {}
    for t in texts:
        for o in range(len(t) - 399):
            count[t[o : o + 400]] = count.get(t[o : o + 400], 0) + 1
    want = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for o in range(len(t) - 399):
            if count[t[o : o + 400]] > 1:
                mask[o : o + 400] = True
        want.append((len(t), int(mask.sum())))
    assert sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(docs).collect()) == sorted(want)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_packing(docs, empty):
    out = packing.best_fit_pack(docs, VOCAB, group=3).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 4096
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    want = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.where("doc_id is null or doc_id <> 7").collect())
    assert sorted(out[out.doc_id != 7].groupby("doc_id", dropna=False).length.sum()) == want
    assert packing.best_fit_pack(empty, VOCAB).count() == 0


def test_tokens_of_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(VOCAB), packing.WordTokens(VOCAB)
    texts = ["", " ", "Don't we'll I'M", "<|endoftext|> a<|startoftext|>b", "naïve café ÀÉ ß", "日本語 テキスト １２", "a\x1cb c\x85d\xa0e", "é ﬁ ²", "x" * 3000, "a1b2 3.14 !!!???", "\x01 \x00", "İstanbul ΣΑΣ"]
    assert [np.frombuffer(b, "<u4").tolist() for b in w.encode(pa.array(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_every_entry_encodes_to_itself():
    """What merging by ranks rests on: each entry of the vocabulary is what its own bytes merge to."""
    import tiktoken

    ranks = packing.merge_ranks(VOCAB)
    enc = tiktoken.Encoding("runs", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={})
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCAB)
    ends = [b[:-1].decode() for b in ranks if b.endswith(b"\x01") and len(b) > 2 and b[:-1].isascii() and b[:-1].isalpha()]
    got = [x.ids for x in whole.encode_batch_fast(ends, add_special_tokens=False)]
    assert sum(g != [ranks[e.encode() + b"\x01"]] for g, e in zip(got, ends)) == 0
    assert [enc.encode_ordinary(e + "\x01") for e in ends] == got


def test_sum_of_squares_is_tight():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 1500, 3000)
    bins = packing.sum_of_squares(size)
    assert np.bincount(bins, size).max() <= 4096 and bins.max() + 1 <= -(-size.sum() // 4096) + 1
    assert len(packing.sum_of_squares(np.array([], np.int64))) == 0


def test_chat(spark):
    rows = [("a", None, 1, "system", "<|end|>\n&lt;", 0.0), ("b", "a", 1, "user", None, 0.0), ("c", "b", 1, "assistant", "good", 2.0), ("d", "b", 1, "assistant", "bad", 1.0), ("e", "zz", 2, None, "alone", None), ("x", "y", 3, "user", "loop", 1.0), ("y", "x", 3, "user", "loop", 1.0), ("z", "x", 3, "user", "tail", 1.0)]
    df = spark.createDataFrame(rows, "node string, parent string, conv_id long, role string, text string, score double")
    out = {r.conv_id: r for r in chat.read_back(chat.chat_format(df)).collect()}
    assert set(out) == {1, 2}
    assert [(t.role, t.text) for t in out[1].turns] == [("system", "<|end|>\n&lt;"), ("user", ""), ("assistant", "good")] and out[1].loss_text == "good"
    assert [(t.role, t.text) for t in out[2].turns] == [("", "alone")]
    assert chat.chat_format(df, top_k=None).where("conv_id = 1").count() == 2
    assert chat.chat_format(df.where("false")).count() == 0


def test_simhash(docs, empty):
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.simhash_groups(docs).collect()]
    by = {d: (f, c) for d, f, c in got}
    assert by[1] == by[2] == (by[1][0], 1) and by[4] == by[5] == by[6] == (0, 4) and len(got) == docs.count()
    assert simhash.simhash_dedup(docs).columns == docs.columns
    assert {1, 4, 7, 8, 9} <= {r.doc_id for r in simhash.simhash_dedup(docs).collect()}
    assert simhash.simhash_groups(empty).count() == 0


def test_simhash_links_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6))]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in components.components(simhash.near_links(df)).collect()}
    parent = {int(x): int(x) for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps.tolist()):
        for b in fps.tolist()[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                parent[find(a)] = find(b)
    want = {}
    for x in fps.tolist():
        want.setdefault(find(x), set()).add(int(np.uint64(x).view(np.int64)))
    have = {}
    for n in (int(x) for x in fps.view(np.int64)):
        have.setdefault(got.get(n, n), set()).add(n)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_dense_bucket_is_cut_again(monkeypatch):
    rng = np.random.default_rng(2)
    fps = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 40, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, 900).astype(np.uint64)))
    monkeypatch.setattr(simhash, "DENSE", 100)
    links = simhash._forest(fps, 3)
    seen = set(np.concatenate([np.concatenate(x) for x in links]).tolist())
    assert seen == set(fps.tolist()) and all((np.bitwise_count(a ^ b) <= 3).all() for a, b in links)


def test_decontamination(spark, docs, empty):
    item = "Anna walks 12 km in the park every day and then she takes 3 hours to read a book about old trains near the lake"
    changed = item.replace("12", "45").replace("3 hours", "8 hours").replace("12 km", "45 km")
    swapped = item.replace("12", "7").replace(" 3 ", " 7 ")
    rows = [(1, f"Some text. {item} More."), (2, f"Before\n{changed}\nafter"), (3, "Nothing of that kind is here at all, only plain words in a row"), (4, None), (5, swapped), (None, item)]
    bench = spark.createDataFrame([(0, item), (1, None), (2, "two words")], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.item_id, r.changed) for r in decontamination.contaminated_pairs(df, bench).collect()}
    assert got == {1: (0, 0), 2: (0, 2), None: (0, 0)}  # 5: two values became one
    assert {r.doc_id for r in decontamination.decontaminate(df, bench).collect()} == {3, 4, 5}
    assert decontamination.decontaminate(docs, bench).count() == docs.count()
    assert decontamination.decontaminate(empty, bench).count() == 0 and decontamination.decontaminate(df, bench.where("false")).count() == 6


def test_decontamination_of_reworded_quotes(spark):
    items = [(0, "What is the chemical symbol for the element gold?"), (1, "Tom has 3 apples and 12 km to walk. Tom gives 2 apples to his old friend and walks home in 4 hours."), (2, "red fox"), (3, "How many moons does the planet have, and which one of them is the largest of all in size?")]
    rows = [
        (10, "Question: What is the chemical symbol for the element gold? Answer"), (11, "so WHAT IS THE CHEMICAL SYMBOL FOR THE ELEMENT GOLD"), (12, "what is the chemical symbol for the element silver"),
        (20, items[1][1].replace("Tom", "Mary Ann")), (21, items[1][1].lower()), (22, items[1][1].replace("Tom", "Bob", 1)), (23, "Intro by Jane Doe " + items[1][1].replace("3", "1,5")), (24, items[1][1].replace("12 km", "12 very long km")),
        (30, "Red fox!"), (31, "the red fox runs"), (40, items[3][1].replace("the planet", "the big planet")), (41, " ".join(items[3][1].split()[:9])),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated_pairs(df, bench).collect()}
    assert got >= {(10, 0), (11, 0), (20, 1), (21, 1), (23, 1), (30, 2)}
    assert not got & {(12, 0), (31, 2), (41, 3)}


def test_window_sizes_meet_every_look():
    """Whatever windows are missing, as many as may be, and wherever the looks fall, one of them meets a found window."""
    import math

    for n in range(decontamination.SHORTEST, 200):
        size, stride = decontamination.window_size(n)
        w = n - size + 1
        least = min(len(range(r, w, stride)) for r in range(stride))
        assert least > w - math.ceil(w * decontamination.COVER - 1e-9), n


def test_edit_fingerprints(docs, empty):
    df = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r.text or "" for r in df.collect()}
    got = {r.doc_id: r for r in edit_embedding.next_edited(df, parts=4).collect()}
    ids = sorted(rows, reverse=True)
    for k, i in enumerate(ids):
        x, y = rows[i], rows[ids[(k + 1) % len(ids)]]
        edited = x[: len(x) - len(x) // 3] + y[: len(x) // 3]
        fx, fe, fy = edit_embedding.fingerprint_texts([x, edited, y])
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(x), hashlib.sha256(edited.encode()).hexdigest(), fx, fe)
        assert r.near_next == edit_embedding.likeness(fx, fy) and r.near_edited == edit_embedding.likeness(fx, fe)
    assert got[1].fingerprint == got[2].fingerprint and got[4].near_next in (0.0, 1.0)
    assert edit_embedding.next_edited(docs).count() == docs.count() and edit_embedding.next_edited(empty).count() == 0
    assert edit_embedding.next_edited(df.where("doc_id = 8")).first().near_next == 1.0


def test_edit_links(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base, other = ("".join(rng.choice(list("abcdefgh "), 2000)) for _ in range(2))
    near = base[:900] + "zz" + base[905:]
    rows = [(1, base), (2, near), (3, other), (4, base), (5, None)]
    edit = lambda t, at: t[:at] + "q" + t[at + 1 :]
    rows += [(100 + i, edit(edit(other, 1500 + i), 1990 - i)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(edit_embedding, "HOT", 8)
    names = {r.fid: r.similar_id for r in edit_embedding.similar_groups(df).collect()}
    nodes, _ = edit_embedding.similar_links(df)
    got = {r.first: names.get(r.fid) for r in nodes.collect()}
    assert got[1] == got[2] == 1 and got[5] is None and got[3] == 3
    assert sum(got.get(100 + i, 3) == 3 for i in range(120)) >= 115  # some share a fingerprint with what they were made of
    assert edit_embedding.similar_groups(df.where("false")).count() == 0


def test_recall_of_bands(spark):
    """Of the pairs of different texts whose likeness is the least or more, found by comparing all, nine in ten at least are
    in one group."""
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    nodes, links = edit_embedding.similar_links(docs)
    root = {r.node: r.root for r in components.components(links).collect()}
    rows = [(r.fid, r.fingerprint) for r in nodes.collect()]
    ends = np.array([int(f.split(":")[0], 16) for _, f in rows])
    order = np.argsort(ends)
    true = found = 0
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if ends[b] * 0.75 > ends[a]:  # the likeness is at most the share of the longer walk
                break
            if edit_embedding.likeness(rows[a][1], rows[b][1]) >= edit_embedding.LEAST:
                true += 1
                found += root.get(rows[a][0], -1) == root.get(rows[b][0], -2)
    print("pairs", true, "recall", found / max(1, true))
    assert found >= 0.9 * true


def test_classifiers(spark, docs, empty):
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(WORDS, 60)) + "." for _ in range(120)]
    rows = [(100 + i, t if i % 2 else t.upper().replace(" ", "!! ") + " vile vilest", "en" if i % 3 else None) for i, t in enumerate(good)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (1 - F.col("doc_id") % 2).cast("int").alias("toxic")).unionByName(spark.createDataFrame([(None, 1, 1), (100, None, None)], "doc_id long, quality int, toxic int"))
    q = quality.fit_quality(df, labels)
    got = quality.quality_scores(df, q).toPandas()
    assert ((got.quality_score > 0.3) == (got.doc_id % 2 == 1)).mean() > 0.95
    m = toxicity.fit_toxicity(df, labels)
    got = toxicity.toxicity(df, m).toPandas()
    assert ((got.toxicity >= 0.5) == (got.doc_id % 2 == 0)).mean() > 0.95
    for out, n in ((toxicity.toxicity(docs, m), docs.count()), (quality.quality_scores(docs, q), docs.count()), (toxicity.toxicity(empty, m), 0), (quality.quality_scores(empty, q), 0)):
        assert out.count() == n
    none = labels.where("false")
    assert toxicity.toxicity(docs, toxicity.fit_toxicity(docs, none)).where("toxic").count() == 0
    assert {r.quality_score for r in quality.quality_scores(docs, quality.fit_quality(docs, none)).collect()} == {0.5}


def test_components_of_a_chain(spark):
    n = 70
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501)], "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 500, 501: 500}
