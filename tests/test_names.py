"""Names in texts: the automaton and the join by pieces give the same rows."""

import random

from ledgerlens.operators import chunks as C
from ledgerlens.operators import curate as K
from ledgerlens.operators import routing as G


def test_two_ways_to_names(spark, monkeypatch):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcé漢 ") for _ in range(rnd.randint(1, 9)))
    texts = [(i, rnd.choice([None, "", "".join(word() for _ in range(rnd.randint(1, 30))).upper()])) for i in range(60)] + [(None, "abc")]
    names = [word() for _ in range(150)] + [None, "", "  ", "ABC", "abc", "Abc "]
    t, n = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(x,) for x in names], "alias string")
    for fold in (True, False):
        a = sorted(map(tuple, G.alias_matches(t, n, "id", fold).collect()), key=repr)
        with monkeypatch.context() as m:
            m.setattr(G, "NAMES", 3)
            b = sorted(map(tuple, G.alias_matches(t.where("id is not null"), n, "id", fold).collect()), key=repr)
        assert [r for r in a if r[0] is not None] == b and len(b) > 50
    assert {r[1] for r in a if r[0] is None} >= {"abc"}
    assert G.alias_matches(t, n.where("false"), "id").count() == 0 == G.alias_matches(t.where("false"), n, "id").count()


def test_turns_of_groups(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None, "c", "d"]) if i > 40 else "a", i) for i in range(300)]
    got = K.round_robin(spark.createDataFrame(rows, "g string, o int"), "g", "o").collect()
    turn, want = {}, []
    for g, o in sorted(rows, key=lambda r: r[1]):
        turn[g] = turn.get(g, 0) + 1
        want.append((turn[g], g is not None, g or "", o))
    want = {o: (k + 1, t) for k, (t, _, _, o) in enumerate(sorted(want))}
    assert {r.o: (r.place, r.turn) for r in got} == want


def test_budget_of_contexts(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None, "e"]), i, rnd.choice([None, "", "x", "y" * 30, "z" * 41, "z" * 90])) for i in range(120)] + [("only", 500, "")]
    got = {r.g: r.context for r in C.context(spark.createDataFrame(rows, "g string, rank int, text string"), ["g"], 40, 300, "##").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        out, before = [], 0
        for _, _, text in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            part = text or ""
            part = part[:40] + "##" if len(part) > 40 else part
            if before >= 300:
                break
            out.append(part[: 300 - before] + "##" if len(part) > 300 - before else part)
            before += len(part)
        want[g] = "\n\n".join(out)
    assert got == want
