"""Periodic runs of words: partition refinement over whole documents, many documents at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import fresh, ship, slices, text_of, without

#: A run spans this many periods and this many words at least.
PERIODS, SHORTEST = 3, 24
#: Bytes of text whose documents are refined together (one longer document is taken alone).
TOGETHER = 6 << 20


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[k], start[k] + 1, ... (size[k] of them), one stretch after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Refinement:
    """Classes of positions whose factors of one length are equal, refined from length to length.

    A class is a stretch of `members`; `at` is a position's place there. Members of a class are also linked in order of
    position (`after`), since neighbours at a distance equal to the length are what is looked for: the factor at i and
    the one at i + length are equal, and nothing between them is, so a square with a root that is no power begins at i.

    Going from a length to the next, a class parts by what classes its members' successors i + 1 are in. Only
    successors in classes that parted at the step before can tell members apart, and of each class that parted the largest
    child can be left out: its predecessors are what remains. So every position is touched a logarithm of times.
    """

    def __init__(self, codes: np.ndarray, limit: np.ndarray):
        """codes: a number per position, equal where and only where words of one document are equal, with a number of its
        own at each document's end. limit: per position, the largest distance that matters."""
        n = len(codes)
        self.limit = limit
        order = np.argsort(codes, kind="stable")
        new = np.concatenate(([True], codes[order[1:]] != codes[order[:-1]])) if n else np.zeros(0, bool)
        self.members = order
        self.at = np.empty(n, np.int64)
        self.at[order] = np.arange(n)
        self.first = np.zeros(n + 1, np.int64)  # by class
        self.size = np.zeros(n + 1, np.int64)
        heads = np.flatnonzero(new)
        self.classes = len(heads)
        self.first[: self.classes], self.size[: self.classes] = heads, np.diff(np.append(heads, n))
        self.cls = np.empty(n, np.int64)
        self.cls[order] = np.cumsum(new) - 1
        self.after, self.before = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        same = ~new[1:]
        self.after[order[:-1][same]] = order[1:][same]
        self.before[order[1:][same]] = order[:-1][same]
        self.due: dict[int, list[np.ndarray]] = {}
        self.length = 1
        self._expect(order)
        self.small = np.arange(self.classes)  # at first every class may part its predecessors

    def _expect(self, i: np.ndarray) -> None:
        """Note for each position at what length its distance to the next member is due."""
        gap = self.after[i] - i
        fit = (self.after[i] >= 0) & (gap >= self.length) & (gap <= self.limit[i])
        i, gap = i[fit], gap[fit]
        if not len(i):
            return
        order = np.argsort(gap, kind="stable")
        i, gap = i[order], gap[order]
        cuts = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        lo = 0
        for hi in [*cuts.tolist(), len(i)]:
            self.due.setdefault(int(gap[lo]), []).append(i[lo:hi])
            lo = hi

    def squares(self) -> np.ndarray:
        """Sorted positions where a square begins whose root has the present length and is no power."""
        found = self.due.pop(self.length, None)
        if not found:
            return np.zeros(0, np.int64)
        i = np.unique(np.concatenate(found))
        return i[self.after[i] - i == self.length]

    def step(self) -> None:
        """Go on to the next length."""
        self.length += 1
        moved = self.members[_spans(self.first[self.small], self.size[self.small])]
        i = moved - 1
        i = i[i >= 0]
        i = i[(self.size[self.cls[i]] > 1) & (self.limit[i] >= self.length)]
        self.small = np.zeros(0, np.int64)
        if not len(i):
            return
        old, key = self.cls[i], self.cls[i + 1]
        order = np.lexsort((i, key, old))
        i, old, key = i[order], old[order], key[order]
        head = np.concatenate(([True], (old[1:] != old[:-1]) | (key[1:] != key[:-1])))
        start = np.flatnonzero(head)
        count = np.diff(np.append(start, len(i)))
        parent = old[start]
        top = np.concatenate(([True], parent[1:] != parent[:-1]))  # a parent's first child
        which = np.cumsum(top) - 1
        parents = parent[top]
        touched = np.bincount(which, count).astype(np.int64)
        rest = self.size[parents] - touched
        # a parent all of whose members went to one child is as it was
        whole = (rest == 0) & (np.bincount(which) == 1)
        if whole.all():
            return
        if whole.any():
            keep = ~whole[which]
            inside = np.repeat(keep, count)
            i, old = i[inside], old[inside]
            count, parent, top = count[keep], parent[keep], top[keep]
            which = np.cumsum(top) - 1
            parents, touched, rest = parents[~whole], touched[~whole], rest[~whole]
        group = np.repeat(np.arange(len(count)), count)
        self._unlink(i, old)
        # stretches: what remains in front, the children behind it in order
        begin = self.first[parents]
        zone = _spans(begin + rest, touched)  # where the touched go
        inhabitants = self.members[zone]
        gone = np.zeros(len(zone), bool)
        place = self.at[i]
        owner = np.repeat(np.arange(len(parents)), touched)
        inzone = place >= (begin + rest)[owner]
        offset = np.cumsum(touched) - touched
        gone[(offset[owner] + place - (begin + rest)[owner])[inzone]] = True
        stay = inhabitants[~gone]  # these change places with the touched ones in front
        holes = place[~inzone]
        self.members[holes], self.at[stay] = stay, holes
        self.members[zone], self.at[i] = i, zone
        # the remainder, or else the first child, keeps the class's number
        keeps = top & (rest[which] == 0)
        number = np.where(keeps, parent, 0)
        fresh_ones = np.flatnonzero(~keeps)
        number[fresh_ones] = self.classes + np.arange(len(fresh_ones))
        self.classes += len(fresh_ones)
        into = np.cumsum(count) - count
        self.size[parents] = rest  # where a child keeps the number, the next line sets it
        self.first[number], self.size[number] = zone[into], count
        self.cls[i] = number[group]
        # links of the children
        same = group[1:] == group[:-1]
        self.after[i], self.before[i] = -1, -1
        self.after[i[:-1][same]] = i[1:][same]
        self.before[i[1:][same]] = i[:-1][same]
        self._expect(np.concatenate((i, self.relinked)))
        # all children but each parent's largest part their predecessors next
        child, of, size = np.concatenate((number, parents[rest > 0])), np.concatenate((which, np.flatnonzero(rest > 0))), np.concatenate((count, rest[rest > 0]))
        order = np.lexsort((-size, of))
        largest = np.concatenate(([True], np.diff(of[order]) > 0))
        self.small = child[order[~largest]]

    def _unlink(self, i: np.ndarray, old: np.ndarray) -> None:
        """Take positions out of their classes' links; `relinked` are those that have got another neighbour."""
        order = np.lexsort((i, old))
        i = i[order]
        apart = np.concatenate(([True], self.after[i[:-1]] != i[1:]))  # else it stands right behind the one before
        ends = np.concatenate((np.flatnonzero(apart)[1:] - 1, [len(i) - 1]))
        p, q = self.before[i[apart]], self.after[i[ends]]
        self.after[p[p >= 0]] = q[p >= 0]
        self.before[q[q >= 0]] = p[q >= 0]
        self.relinked = p[(p >= 0) & (q >= 0)]

    @property
    def done(self) -> bool:
        return not len(self.small) and not self.due


def find_runs(codes: np.ndarray, limit: np.ndarray, shortest: int = SHORTEST, periods: int = PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of at least `shortest` words and `periods` periods, for codes as in Refinement."""
    found = [np.zeros((0, 3), np.int64)]
    r = Refinement(codes, limit)
    while not r.done:
        q = r.length
        i = r.squares()
        if len(i):
            cuts = np.flatnonzero(np.diff(i) > 1)
            start, end = i[np.concatenate(([0], cuts + 1))], i[np.append(cuts, len(i) - 1)]
            length = end - start + 2 * q
            long = length >= max(shortest, periods * q)
            if long.any():
                found.append(np.stack((start[long], length[long], np.full(int(long.sum()), q)), 1))
        r.step()
    return tuple(np.concatenate(found).T)


def rebuilt(words: list, doc: str | None) -> list:
    """The words with their tail made periodic, for one document in ten: a rule of op13's contract, for tables without long runs."""
    import zlib

    n = len(words)
    if doc is None or not n:
        return words
    h = zlib.crc32(doc.encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def runs_of(docs: list[list[bytes]], shortest: int = SHORTEST, periods: int = PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document's words, by start, then period."""
    size = np.fromiter(map(len, docs), np.int64, len(docs)) + 1  # one position for the end
    first = np.cumsum(size) - size
    n = int(size.sum())
    word = pa.array([w for d in docs for w in (*d, b"")], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(docs)), size)
    codes = doc * (int(word.max(initial=0)) + 1) + word
    codes[first + size - 1] = -1 - np.arange(len(docs))  # an end is like nothing else
    limit = np.repeat((size - 1) // periods, size)
    start, length, period = find_runs(codes, limit, shortest, periods)
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    at = doc[start] if n else start
    for k in np.lexsort((period, start)).tolist():
        out[at[k]].append((int(start[k] - first[at[k]]), int(length[k]), int(period[k])))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds behind its first period."""
    out, upto = [], 0
    for lo, hi in sorted((s + q, s + n) for s, n, q in runs):
        if hi > upto:
            out += words[upto : max(lo, upto)]
            upto = hi
    return out + words[upto:]


def repeat_runs(docs: DataFrame, shortest: int = SHORTEST, periods: int = PERIODS, rebuild: bool = False, text: str = "text") -> DataFrame:
    """docs with their periodic runs of words: adds runs, an array of (start, length, period), and collapsed.

    Words are what stands between white space ([\\x20\\x09-\\x0D]). A run is a stretch whose words stand again `period`
    further on, for the least such period, that no neighbouring word extends; those of at least `shortest` words and
    `periods` periods are found, by start, then period. collapsed has the words that remain if each run keeps its first
    period, joined by one space. rebuild: first make the tails of some documents periodic (rebuilt()).

    Every document is looked at whole in one task, several at a time; nothing is shuffled. Memory follows the longest
    document, time the number of words times its logarithm.

    Defined results: a null or empty text has no words, no runs and an empty collapsed text; rows that repeat are looked
    at each; a null doc_id is never rebuilt; other columns stay; those named runs or collapsed are replaced.
    """
    ship(docs.sparkSession)
    kept = without(docs, (text, "runs", "collapsed"))
    doc, own = fresh(docs, "doc_name", "text_of_doc")
    name = F.col("doc_id").cast("string") if rebuild else F.lit(None).cast("string")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], name.alias(doc), text_of(f"`{text}`").alias(own))
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for part in slices(batch, last, TOGETHER):
                words = [t.encode().split() for t in part.column(last).to_pylist()]  # of bytes, split() knows no other white space
                words = [rebuilt(w, d) for w, d in zip(words, part.column(last - 1).to_pylist())]
                found = runs_of(words, shortest, periods)
                told = pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], span)
                rest = pa.array([b" ".join(collapsed(w, f)) for w, f in zip(words, found)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: last - 1], told, rest], [*kept, "runs", "collapsed"])

    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))).add("collapsed", "string")
    return rows.mapInArrow(run, schema)


def digest(runs: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by period, exactly compared; of equal ones the least start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def op13_periodic_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = repeat_runs(docs, rebuild=True)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    # the greatest length / period: fractions are compared by cross products, so ties are exact
    beats = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | ((x["length"] * y["period"] == y["length"] * x["period"]) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(beats(r, b), r).otherwise(b))
    rows = rows.withColumn("best", best)
    milli = F.expr("(1000 * best.length) DIV best.period")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), milli.alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
