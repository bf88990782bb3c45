"""External induced sorting of suffixes: disk-backed queues carry suffixes and common-prefix values, level by level.

Positions where the text turns from falling to rising (LMS) are ordered first, by the order of their pieces' names: in
memory while few, else by the same induction on the string of names. From them the falling (L) suffixes follow by one
sweep over the characters upwards, from those the rising (S) ones by a sweep downwards. A sweep pushes each suffix's
predecessor into a queue ordered by character, first in first out within one; what it shares with its forerunner there is
one more than the least common prefix passed since. Queues spill to files, so memory holds a bucket, not the text's order.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Names that are ordered in memory by doubling; more go through another level of induction.
BASE = 4_000_000
#: Queue entries kept in memory before a queue spills.
HELD = 4_000_000


class CharQueue:
    """Priority queue of (character, position, common prefix): by character, first in first out within one."""

    def __init__(self, folder: str, name: str, lcp: bool, held: int = HELD):
        self.folder, self.name, self.lcp, self.limit = folder, name, lcp, held
        self.now: dict[int, list] = {}
        self.size, self.runs = 0, []

    def push(self, char: int, pos: np.ndarray, lcp: np.ndarray | None) -> None:
        self.now.setdefault(char, []).append((pos, lcp))
        self.size += len(pos)
        if self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        path, where, at = os.path.join(self.folder, f"{self.name}-{len(self.runs)}"), {}, 0
        with open(path, "wb") as f:
            for c in sorted(self.now):
                pos = np.concatenate([p for p, _ in self.now[c]]).astype(np.int64)
                raw = pos.tobytes() + (np.concatenate([x for _, x in self.now[c]]).astype(np.uint16).tobytes() if self.lcp else b"")
                f.write(raw)
                where[c] = (at, len(pos))
                at += len(raw)
        self.runs.append((path, where))
        self.now, self.size = {}, 0

    def pop(self, char: int) -> tuple[np.ndarray, np.ndarray | None]:
        """All of one character, in order, removed."""
        parts = []
        for path, where in self.runs:
            if char in where:
                at, n = where.pop(char)
                with open(path, "rb") as f:
                    f.seek(at)
                    pos = np.frombuffer(f.read(8 * n), np.int64)
                    parts.append((pos, np.frombuffer(f.read(2 * n), np.uint16) if self.lcp else None))
        late = self.now.pop(char, [])
        self.size -= sum(len(p) for p, _ in late)
        parts += late
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.uint16) if self.lcp else None
        return np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts]) if self.lcp else None


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo:hi] for many ranges (hi > lo), by one table of doubled spans at a time."""
    out = np.empty(len(lo), values.dtype)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > (1 << k) else table
    return out


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is less than the next one; the end of the text is less than anything."""
    n = len(text)
    up = np.zeros(n, bool)
    up[:-1] = text[:-1] < text[1:]
    same = np.zeros(n, bool)
    same[:-1] = text[:-1] == text[1:]
    at = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    settled = np.where(same, at[-1], at)  # equal neighbours take the type of where their run ends
    return up[np.minimum.accumulate(settled[::-1])[::-1]]


def _run(text: np.ndarray, p: int, most: int) -> int:
    """Length of the run of one character at p."""
    part = np.asarray(text[p : p + most])
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def _first_ranks(key: np.ndarray) -> np.ndarray:
    """Rank of each key: how many keys are less. Equal keys have equal ranks."""
    order = np.argsort(key)
    ranked = key[order]
    at = np.arange(len(key))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.append(True, ranked[1:] != ranked[:-1]), at, 0))
    return rank


def _refine(rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Part equal ranks of the rows `live` by a further key (from 0 to len(rank)); returns those of them that are still tied.

    A tied group must be in `live` as a whole. Ranks count the rows that are less, so other rows' ranks stay right.
    """
    old = rank[live]
    both = old * (len(rank) + 2) + key if key.max(initial=0) < len(rank) + 2 else None
    order = np.argsort(both) if both is not None else np.lexsort((key, old))
    old, key, live = old[order], key[order], live[order]
    at = np.arange(len(live))
    group = np.append(True, old[1:] != old[:-1])
    part = group.copy()
    part[1:] |= key[1:] != key[:-1]
    begin = np.maximum.accumulate(np.where(part, at, 0))
    rank[live] = old + begin - np.maximum.accumulate(np.where(group, at, 0))
    size = np.diff(np.append(np.flatnonzero(part), len(live)))
    return live[np.repeat(size > 1, size)]


def _names(text: np.ndarray, rising: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order-preserving names of the pieces from each LMS position to the next, ends included, types told apart; and the
    pieces whose name is not their own."""
    n, bits = len(text), int(text.max()).bit_length() + 2
    per, size = max(1, 62 // bits), np.append(lms[1:] - lms[:-1] + 1, n + 1 - lms[-1])

    def symbols(rows: np.ndarray, done: int) -> np.ndarray:
        key = np.zeros(len(rows), np.int64)
        at, most = lms[rows], size[rows]
        for j in range(done, done + per):
            here = np.minimum(at + j, n - 1)
            symbol = np.where(at + j < n, (text[here].astype(np.int64) + 1) * 2 + rising[here], 1)  # 1: the text's end
            key = (key << bits) | np.where(j < most, symbol, 0)
        return key

    rank, done = _first_ranks(symbols(np.arange(len(lms)), 0)), per
    tied = np.bincount(rank, minlength=len(rank))[rank] > 1
    live = np.flatnonzero(tied & (size > done))
    while len(live):  # tied pieces are either all longer than this or all at their end
        live = _refine(rank, live, symbols(live, done))
        done += per
        live = live[size[live] > done]
    return rank, np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def _order_lms(text: np.ndarray, rising: np.ndarray, lms: np.ndarray, depth: int, folder: str, base: int) -> np.ndarray:
    """LMS positions in the order of their suffixes, as far as `depth` characters tell them apart."""
    if len(lms) < 2:
        return lms
    rank, live = _names(text, rising, lms)
    if len(lms) > base:
        inner = os.path.join(folder, "deeper")
        os.makedirs(inner, exist_ok=True)
        return lms[sort_suffixes(rank, depth, inner, base)]
    span = 1
    while span < depth and len(live):  # a piece is two characters at least; only tied ones go on, twice as far each time
        ahead = live + span
        key = np.where(ahead < len(rank), rank[np.minimum(ahead, len(rank) - 1)] + 1, 0)
        live = _refine(rank, live, key)
        span *= 2
    return lms[np.argsort(rank, kind="stable")]


def _common(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of neighbours in `order`, up to depth; the first is 0. Eight bytes are compared at a time."""
    out, n, unit = np.zeros(len(order), np.uint16), len(text), text.itemsize
    raw = np.concatenate((np.frombuffer(np.ascontiguousarray(text), np.uint8), np.zeros(8 + unit, np.uint8)))
    words = np.ndarray((n + 1,), "<u8", raw.data, strides=(unit,))
    per = 8 // unit
    a, b, live = order[:-1].copy(), order[1:].copy(), np.arange(1, len(order))
    room = n - np.maximum(a, b)  # common prefixes end with the text
    for done in range(0, depth, per):
        if not len(live):
            break
        differ = words[np.minimum(a + done, n)] ^ words[np.minimum(b + done, n)]
        stop = (differ != 0) | (room <= done + per)
        if stop.any():
            at = np.flatnonzero(stop)
            low = differ[at] & (~differ[at] + np.uint64(1))
            equal = np.where(low == 0, per, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // (8 * unit))
            out[live[at]] = np.minimum(np.minimum(done + equal, room[at]), depth)
            a, b, live, room = a[~stop], b[~stop], live[~stop], room[~stop]
    out[live] = depth
    return out


def _spread(seq: np.ndarray, lcp: np.ndarray | None, take: np.ndarray, target: np.ndarray, queue: CharQueue, cap: int) -> None:
    """Push the predecessors of seq[take] by their characters, in order, with what they share with their forerunners."""
    if not len(take):
        return
    by = np.argsort(target, kind="stable")
    take, target = take[by], target[by]
    cut = np.flatnonzero(np.diff(target)) + 1
    first = np.concatenate(([0], cut))
    shared = None
    if lcp is not None:
        shared = np.ones(len(take), np.uint16)  # the first of a character in this bucket shares that character only
        rest = np.ones(len(take), bool)
        rest[first] = False
        rest = np.flatnonzero(rest)
        if len(rest):
            shared[rest] = np.minimum(_range_min(lcp, take[rest - 1] + 1, take[rest] + 1), cap - 1) + 1
    for lo, hi in zip(first.tolist(), [*cut.tolist(), len(take)]):
        queue.push(int(target[lo]), seq[take[lo:hi]] - 1, shared[lo:hi] if shared is not None else None)


def _with_runs(text: np.ndarray, char: int, pos: np.ndarray, lcp: np.ndarray | None, cap: int):
    """pos and, round by round, the predecessors of the same character, which follow in the same order."""
    all_pos, all_lcp, now, shared, depth = [pos], [lcp], pos, lcp, 0
    while len(now):
        take = np.flatnonzero((now > 0) & (text[np.maximum(now - 1, 0)] == char))
        if not len(take):
            break
        depth += 1
        if lcp is not None:
            more = np.full(len(take), min(depth, cap), np.uint16)
            if len(take) > 1:
                more[1:] = np.minimum(_range_min(shared, take[:-1] + 1, take[1:] + 1), cap - 1) + 1
            shared = more
            all_lcp.append(more)
        now = now[take] - 1
        all_pos.append(now)
    return np.concatenate(all_pos), np.concatenate(all_lcp) if lcp is not None else None


def _induce(text: np.ndarray, rising: np.ndarray, lms: np.ndarray, shared: np.ndarray | None, cap: int, folder: str):
    """Both sweeps. Yields, by falling character, (S positions, their prefixes, L positions, theirs), each in falling order."""
    chars = np.unique(text)
    kind = shared is not None
    falling, done, later = CharQueue(folder, "L", kind), CharQueue(folder, "D", kind), CharQueue(folder, "S", kind)
    zero = np.zeros(1, np.uint16) if kind else None
    falling.push(int(text[-1]), np.array([len(text) - 1]), zero)
    begin = np.searchsorted(text[lms], chars, "left")
    end = np.searchsorted(text[lms], chars, "right")
    for c, lo, hi in zip(chars.tolist(), begin.tolist(), end.tolist()):
        pos, lcp = _with_runs(text, c, *falling.pop(c), cap)
        seq, both = np.concatenate((pos, lms[lo:hi])), None
        if not len(seq):
            continue
        if kind:
            both = np.concatenate((lcp, shared[lo:hi]))
            both[0] = 0
            if len(pos) and hi > lo:
                both[len(pos)] = min(_run(text, int(pos[-1]), cap), _run(text, int(lms[lo]), cap))
        before = text[np.maximum(seq - 1, 0)]
        take = np.flatnonzero((seq > 0) & (before > c))
        _spread(seq, both, take, before[take], falling, cap)
        if len(pos):
            done.push(c, pos, both[: len(pos)] if kind else None)
    for c in chars[::-1].tolist():
        pos, lcp = _with_runs(text, c, *later.pop(c), cap)
        left, left_lcp = done.pop(c)
        left, both = left[::-1], None
        if kind:
            turned = np.concatenate((zero, left_lcp[:0:-1])) if len(left) else left_lcp
            if len(pos):
                lcp[0] = 0
            if len(pos) and len(left):
                turned[0] = min(_run(text, int(pos[-1]), cap), _run(text, int(left[0]), cap))
            both = np.concatenate((lcp, turned))
        seq = np.concatenate((pos, left))
        if not len(seq):
            continue
        before = text[np.maximum(seq - 1, 0)]
        take = np.flatnonzero((seq > 0) & (before < c))
        _spread(seq, both, take, before[take], later, cap)
        yield seq, both


def sort_suffixes(text: np.ndarray, depth: int, folder: str | None = None, base: int = BASE) -> np.ndarray:
    """All positions in the order of their suffixes, as far as `depth` characters tell them apart."""
    own = folder or tempfile.mkdtemp(prefix="suffix-")
    try:
        rising = _types(text)
        lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
        lms = _order_lms(text, rising, lms, depth, own, base)
        return np.concatenate([seq for seq, _ in _induce(text, rising, lms, None, depth, own)])[::-1]
    finally:
        shutil.rmtree(own, ignore_errors=True)


def repeated_windows(text: np.ndarray, window: int, usable: np.ndarray, base: int = BASE) -> np.ndarray:
    """True at each usable position whose next `window` characters also start at another usable position.

    usable must hold only positions whose window lies within one string of the text.
    """
    own = tempfile.mkdtemp(prefix="suffix-")
    try:
        found = np.zeros(len(text), bool)
        rising = _types(text)
        lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
        lms = _order_lms(text, rising, lms, window, own, base)
        shared = _common(text, lms, window) if len(lms) else np.empty(0, np.uint16)
        for seq, lcp in _induce(text, rising, lms, shared, window, own):
            hit = np.flatnonzero(lcp >= window)
            found[seq[hit]] = True
            found[seq[hit[hit > 0] - 1]] = True
        return found & usable
    finally:
        shutil.rmtree(own, ignore_errors=True)
