"""Prefix trie, token counts and periodic runs against naive forms, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import prefix_trie, queries, runs, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


# ---- prefix trie


def naive_trie(rows):
    """rows: (conv_id, turn, role, text). The contract of op11, read literally."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t, r or "", x or ""))
    key = lambda v: (v[0] is not None, v[0] or 0, hashlib.sha256(f"{len(v[1])}:{v[1]}{v[2]}".encode()).digest())
    own = {c: [v[1:] for v in sorted(vs, key=key)] for c, vs in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for node, cs in members.items():
        under = [m for m in members if m[: len(node)] == node]
        kids = [m for m in under if len(m) == len(node) + 1]
        leaves = [m for m in under if not any(len(x) > len(m) and x[: len(m)] == m for x in under)]
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(node)))
        saved = sum((len(members[m]) - 1) * (len(m[-1][1]) if m else 0) for m in under)
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(spark, rows):
    c = F.col("conv_id")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string, depth int")
    out = prefix_trie.prefix_trie(prefix_trie.prefixes(df, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5))
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("seed", [0, 1])
def test_trie_against_naive(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 40), 100, 101, 150, 305, 306, 307, None]:  # 300 is absent: some are rebuilt from nothing
        for k in range(rnd.choice([1, 2, 3, 6, 9])):
            turn = rnd.choice([k, k, None, 0])
            rows.append((c, turn, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b", "", None, "é<|"]), "clash", k))
    assert trie_rows(spark, rows) == naive_trie([r[:4] for r in rows])


def test_trie_edges(spark):
    assert trie_rows(spark, []) == []
    # copies in any number are one chain; a long conversation costs a row per turn
    rows = [(c, k, "user", f"t{k}", "", 0) for c in (100, 200, 300) for k in range(300)]
    rows += [(900 + c, 0, "user", "same", "", 0) for c in range(1, 60)]
    assert trie_rows(spark, rows) == naive_trie([r[:4] for r in rows])


# ---- token counts


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_token_counts_query(spark):
    count = library()
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op12_token_counts"](spark, SF).collect()
    assert len(got) == len(text)
    for r in got:
        n = count(text[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 1024)


def test_merges_as_the_library(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)  # forgetting changes nothing
    count, mine, rnd = library(), token_counts.MergeCounter(VOCAB), random.Random(5)
    parts = ["<|endoftext|>", "<|endof", "'s", "'re", " ", "  ", "\n", "a", "the", "é", "漢字", "🙂", "12", "!!", "\x1c", "\u3000", "\x00", "ing"]
    for _ in range(3000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert mine.count(s) == count(s), repr(s)
    for s in ("a" * 30_000, "ab" * 20_000, "the" * 9_000, " " * 5_000, "x<|endoftext|>" * 999):
        assert mine.count(s) == count(s)


def test_token_counts_edges(spark):
    df = spark.createDataFrame([(1, None, 7, 1), (None, "", 7, 2), (2, "two words", 7, 3), (2, "two words", 7, 3)], "doc_id long, text string, n_tokens int, text_bytes_of int")
    got = sorted(map(tuple, token_counts.token_counts(df, VOCAB, limit=1).collect()), key=repr)
    assert got == sorted([(1, 1, 0, 0, False), (None, 2, 0, 0, False), (2, 3, 9, 2, True), (2, 3, 9, 2, True)], key=repr)
    assert token_counts.token_counts(df.where("false"), VOCAB).count() == 0


# ---- periodic runs


def naive_runs(w, shortest, periods):
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(shortest, periods * q) and all(any(w[k] != w[k + d] for k in range(s, s + n - d)) for d in range(1, q)):
                out.append((s, n, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_naive(seed):
    rnd = random.Random(seed)
    for _ in range(120):
        docs = []
        for _ in range(rnd.randint(0, 6)):
            k = rnd.randint(1, 4)
            w = [b"abcd"[j : j + 1] for j in (rnd.randrange(k) for _ in range(rnd.choice([0, 1, 2, 5, 30, 90])))]
            if rnd.random() < 0.5:
                w = runs.rebuilt(w, str(rnd.randrange(10**6)))
            if rnd.random() < 0.5 and w:
                a, p = rnd.randrange(len(w)), rnd.randint(1, 9)
                w = w[:a] + (w[a : a + p] * 20)[: rnd.randint(1, 60)] + w[a:]
            docs.append(w)
        shortest, periods = rnd.choice([(24, 3), (1, 2), (2, 2), (4, 3)])
        assert runs.runs_of(docs, shortest, periods) == [naive_runs(d, shortest, periods) for d in docs]


def test_refinement_keeps_its_classes():
    """At every length: classes are the equal factors, links join neighbours, no split was missed by leaving out the largest child."""
    import numpy as np

    rnd = random.Random(3)
    w = [rnd.randrange(2) for _ in range(40)] + [0, 1, 1] * 12 + [rnd.randrange(3) for _ in range(20)]
    n = len(w)
    r = runs.Refinement(np.array([*w, -1]), np.full(n + 1, n))
    for length in range(1, 40):
        assert r.length == length
        want = {}
        for i in range(n - length + 1):
            want.setdefault(tuple(w[i : i + length]), []).append(i)
        have = {}
        for i in range(n - length + 1):
            have.setdefault(int(r.cls[i]), []).append(i)
        assert sorted(want.values()) == sorted(have.values())
        for same in want.values():
            assert [int(r.after[i]) for i in same] == [*same[1:], -1]
            assert r.size[r.cls[same[0]]] == len(same)
        r.squares()
        r.step()


def naive_op13(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = []
    for q in range(1, n // 3 + 1):  # stretches of equal words q apart, joined at C speed where nothing is equal
        same = [a == b for a, b in zip(words, words[q:])]
        if sum(same) < max(24, 3 * q) - q:
            continue
        i = 0
        while i < len(same):
            if not same[i]:
                i += 1
                continue
            s = i
            while i < len(same) and same[i]:
                i += 1
            size = i - s + q
            if size >= max(24, 3 * q) and all(words[s : s + size - d] != words[s + d : s + size] for d in range(1, q)):
                found.append((s, size, q))
    found.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = runs.strongest(found) or (None,) * 3
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, runs.digest(found), hashlib.sha256(kept).hexdigest())


def test_runs_query(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = sorted(map(tuple, queries.QUERIES["op13_periodic_runs"](spark, SF).collect()))
    assert sum(r[1] > 0 for r in got) > 5
    assert got == sorted(naive_op13(d, t) for d, t in text.items())


def test_runs_edges(spark):
    rows = [(1, None, 0, "x"), (None, "", 0, "x"), (2, "a " * 30 + "b", 0, "x"), (2, "a " * 30 + "b", 0, "x"), (3, "a\u00a0b " * 24, 0, "x"), (4, "a " * 20_000, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, doc_name string")
    got = Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed, r.doc_name) for r in runs.repeat_runs(df).collect())
    want = Counter([(1, (), "", "x"), (None, (), "", "x"), (2, ((0, 30, 1),), "a b", "x"), (2, ((0, 30, 1),), "a b", "x"), (3, ((0, 24, 1),), "a\u00a0b", "x"), (4, ((0, 20_000, 1),), "a", "x")])
    assert got == want
    assert runs.repeat_runs(df.where("false")).count() == 0
    assert runs.strongest([(5, 30, 10), (2, 24, 8), (0, 25, 9)]) == (2, 24, 8)
