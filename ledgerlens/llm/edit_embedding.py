"""Document fingerprints: a randomised edit embedding maps edit distance to Hamming distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import drop_stash, ship, stash, text_of
from .components import components

#: Classes that code points are hashed to, and steps after which the shared random bits start over.
CLASSES, PERIOD = 64, 1 << 16
#: Steps sampled of each octave of the walk; the first octave ends with step SAMPLES.
SAMPLES = 64
#: Share of steps on which the hashed characters of unrelated texts agree.
CHANCE = 0.08
#: Characters that are walked at a time.
HELD = 5_000_000


def _hashed(cp: np.ndarray, seed: int) -> np.ndarray:
    x = (cp.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x >> np.uint64(32)


class Walk:
    """One random walk for all texts: at each step the walk stays on its character or moves on, by a random bit that
    depends on the step and the character's class alone. Step s of the embedding is the character the walk is on; texts
    that differ by few edits fall into step again soon, so their embeddings differ in few places.
    """

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        move = rng.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
        move[:, -1] = 1
        # steps spent on a character of a class from a given step on: to the first moving bit, itself included
        stay = np.empty((CLASSES, PERIOD), np.uint8)
        run = np.zeros(CLASSES, np.uint8)
        twice = np.concatenate((move, move[:, :64]), 1)
        for s in range(PERIOD + 63, -1, -1):
            run = np.where(twice[:, s] == 1, 1, run + 1).astype(np.uint8)
            if s < PERIOD:
                stay[:, s] = run
        self.stay = np.ascontiguousarray(stay.T).ravel()  # by step, then class: neighbours in a walk lie close
        self.samples: list[np.ndarray] = []
        self.rng = np.random.default_rng(seed + 1)

    def steps(self, classes: np.ndarray, bounds: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """First step of every character of many texts in a row; begin: the step at which each text's walk starts."""
        size = np.diff(bounds)
        out = np.empty(len(classes), np.int32 if len(classes) < 1 << 29 else np.int64)
        order = np.argsort(-size, kind="stable")
        at, now = bounds[:-1][order], begin[order].astype(np.int64)
        size, i, live = size[order], 0, len(order)
        while True:  # all texts move on by one character at a time
            while live and size[live - 1] <= i:
                live -= 1
            if live < 24:
                break
            p = at[:live] + i
            out[p] = now[:live]
            now[:live] += self.stay[((now[:live] & (PERIOD - 1)) * CLASSES) + classes[p]]
            i += 1
        table = self.stay.data
        for k in range(live):  # the few longest go on one by one
            rest = classes[at[k] + i : at[k] + size[k]]
            walked = accumulate(rest.tolist(), lambda s, c: s + table[((s & (PERIOD - 1)) * CLASSES) + c], initial=int(now[k]))
            out[at[k] + i : at[k] + size[k]] = np.fromiter(walked, np.int64, len(rest) + 1)[:-1]
        return out

    def octave(self, k: int) -> np.ndarray:
        """Sampled steps of octave k, rising: the same for all texts."""
        while len(self.samples) <= k:
            n = len(self.samples)
            if n == 0:
                self.samples.append(np.arange(SAMPLES))
            else:
                lo = SAMPLES << (n - 1)
                self.samples.append(np.sort(lo + self.rng.choice(lo, SAMPLES, replace=False)) if lo < 1 << 22 else lo + np.sort(self.rng.integers(0, lo, SAMPLES)))
        return self.samples[k]

    def fingerprint(self, cps: np.ndarray, first: np.ndarray, end: int) -> str:
        """end (steps of the whole walk) in hex, then one hex digit, a hash of the character, per sampled step before it."""
        if not len(cps):
            return "0:"
        octaves = 1
        while SAMPLES << (octaves - 1) < end:
            octaves += 1
        steps = np.concatenate([self.octave(k) for k in range(octaves)])
        steps = steps[steps < end]
        on = np.searchsorted(first, steps, "right") - 1
        return f"{end:x}:" + _DIGIT[cps[on]].tobytes().translate(_HEX).decode()


_HEX = bytes(b"0123456789abcdef"[i & 15] for i in range(256))


def likeness(a: str, b: str) -> float:
    """Share of the two walks' steps (up to the longer one's end) on which they agree, estimated octave by octave, with
    what hashes agree by chance taken off; 1 for equal fingerprints, 0 for an empty one and another."""
    if a == b:
        return 1.0
    (na, da), (nb, db) = a.split(":"), b.split(":")
    na, nb = int(na, 16), int(nb, 16)
    far, near = max(na, nb), min(na, nb)
    if not near:
        return 0.0
    x, y = (np.frombuffer(d.encode(), np.uint8) for d in (da, db))
    n = min(len(x), len(y))
    same = np.add.reduceat((x[:n] == y[:n]).astype(np.int64), np.arange(0, n, SAMPLES))
    octave = np.arange(len(same))
    low = np.where(octave == 0, 0, SAMPLES << np.maximum(octave - 1, 0))
    # the last octave may be cut short by the shorter walk
    span = np.maximum(np.minimum(SAMPLES << octave, near) - low, 0)
    agree = same / np.minimum(SAMPLES, n - octave * SAMPLES)
    return float(min(1.0, (np.maximum(0.0, (agree - CHANCE) / (1 - CHANCE)) * span).sum() / far))


def _walk() -> Walk:
    if "walk" not in _kept:
        _kept["walk"] = Walk()
    return _kept["walk"]


_kept: dict[str, Walk] = {}


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    cps = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    return cps, np.cumsum([0, *map(len, texts)])


_CLASS = (_hashed(np.arange(0x110000), 5) & np.uint64(CLASSES - 1)).astype(np.uint8)
_DIGIT = (_hashed(np.arange(0x110000), 77) & np.uint64(15)).astype(np.uint8)


def _classes(cps: np.ndarray) -> np.ndarray:
    return _CLASS[cps]


def fingerprint_texts(texts: list[str]) -> list[str]:
    """Fingerprints of texts; equal texts have equal ones."""
    walk = _walk()
    cps, bounds = _code_points(texts)
    classes = _classes(cps)
    first = walk.steps(classes, bounds, np.zeros(len(texts), np.int64))
    return [walk.fingerprint(cps[a:b], first[a:b], _end(walk, classes, first, b)) if b > a else "0:" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _end(walk: Walk, classes, first, b: int) -> int:
    s = int(first[b - 1])
    return s + int(walk.stay[((s & (PERIOD - 1)) * CLASSES) + int(classes[b - 1])])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fingerprint) of every row; row is a hash of the text, null counts as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._shared import slices

        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fingerprint_texts(part.column(2).to_pylist()), pa.string())], ["doc_id", "row", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("row"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, fingerprint string")


#: Bands of a fingerprint, digits sampled for each, and how alike linked texts are at least.
BANDS, DIGITS, LEAST = 24, 6, 0.8
#: Keys that more fingerprints share are first linked through a few of their members, in some rounds.
HOT, REPS, ROUNDS = 64, 2, 3


def _picks(seed: int, octave: int, bands: int, digits: int) -> np.ndarray:
    """The sampled places within an octave's digits, band by band: the same for all texts."""
    rng = np.random.default_rng((seed, octave))
    return np.stack([rng.choice(SAMPLES, digits, replace=False) for _ in range(bands)])


def band_keys(prints: list[str], bands: int = BANDS, digits: int = DIGITS) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, key) of all bands: hashes of sampled digits of the octave in which a walk ends and of the one
    below, so that walks on either side of an octave's end meet too."""
    kept: dict[int, np.ndarray] = {}
    which, keys = [], []
    for n, fp in enumerate(prints):
        d = np.frombuffer(fp.split(":")[1].encode(), np.uint8)
        last = max(0, (len(d) - 1) // SAMPLES)
        for o in sorted({last, max(0, last - 1)}):
            part = np.zeros(SAMPLES, np.uint8)
            have = d[o * SAMPLES : (o + 1) * SAMPLES]
            part[: len(have)] = have
            if o not in kept:
                kept[o] = _picks(0, o, bands, digits)
            raw = part[kept[o]].tobytes()
            keys += [xxhash.xxh3_64_intdigest(raw[b * digits : (b + 1) * digits], (o << 16) + b) for b in range(bands)]
            which += [n] * bands
    return np.array(which, np.int64), np.array(keys, np.uint64)


def similar_links(docs: DataFrame, least: float = LEAST, bands: int = BANDS, digits: int = DIGITS) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): nodes (fid, fingerprint, first) are the distinct fingerprints with the least doc_id that has them, links
    (a, b) pairs of fids whose likeness is `least` or more and that connect all such pairs that share a band.

    Bit-sampled banding: equal bands meet by a shuffle of (key, fid); every pair is verified by its whole fingerprints. Copies
    share a fingerprint and are one node. Of a key that many share, members are first linked through a few of them; then
    only pairs that no chain of links joins yet are formed, so groups of near copies cost their size, not its square.
    """
    spark = docs.sparkSession
    nodes, _ = stash(fingerprints(docs).groupBy("fingerprint").agg(F.min("doc_id").alias("first")).withColumn("fid", F.xxhash64("fingerprint")), "edit-nodes")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fid = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(fid), 2000):
                which, key = band_keys(batch.column(1).slice(lo, 2000).to_pylist(), bands, digits)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fid[lo:][which])], ["key", "fid"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [likeness(x, y) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        side = lambda c: nodes.select(F.col("fid").alias(c), F.col("fingerprint").alias(f"f{c}"))
        both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "fa", "fb")
        return stash(both.mapInArrow(alike, "a long, b long"), label)[0]

    def rooted(part: DataFrame) -> DataFrame:
        if links is None:
            return part.withColumn("root", F.col("fid"))
        return part.join(components(links).withColumnRenamed("node", "fid"), "fid", "left").withColumn("root", F.coalesce("root", "fid"))

    rows, rows_path = stash(nodes.select("fid", "fingerprint").mapInArrow(keys, "key long, fid long").distinct(), "edit-keys")
    size = rows.groupBy("key").count().where("count > 1")
    rows, shared_path = stash(rows.join(size, "key"), "edit-shared")
    drop_stash(spark, rows_path)
    links, hot = None, rows.where(F.col("count") > HOT)
    for k in range(0 if hot.isEmpty() else ROUNDS):
        part = rooted(hot)
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("fid", F.lit(k)), "fid"))
        reps = part.withColumn("at", rank).where(F.col("at") <= REPS)
        pairs = part.alias("x").join(reps.alias("y"), F.col("x.key") == F.col("y.key")).where(F.col("x.root") != F.col("y.root"))
        found = verified(pairs.select(F.least("x.fid", "y.fid").alias("a"), F.greatest("x.fid", "y.fid").alias("b")), "edit-round")
        links = found if links is None else links.unionByName(found)
    left, left_path = stash(rooted(rows), "edit-left")
    pairs = left.alias("x").join(left.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fid") < F.col("y.fid")) & (F.col("x.root") != F.col("y.root")))
    found = verified(pairs.select(F.col("x.fid").alias("a"), F.col("y.fid").alias("b")), "edit-links")
    for path in (shared_path, left_path):
        drop_stash(spark, path)
    return nodes, found if links is None else links.unionByName(found)


def similar_groups(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(fid, similar_id) of every fingerprint that is linked to another: similar_id is the least doc_id of its group; fid is
    xxhash64 of the fingerprint. Fingerprints without a link are their own group and are left out."""
    nodes, links = similar_links(docs, least)
    named = nodes.select("fid", "first").join(components(links).withColumnRenamed("node", "fid"), "fid")
    return named.join(named.groupBy("root").agg(F.min("first").alias("similar_id")), "root").select("fid", "similar_id")


def next_edited(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited text, which ends in the next document's beginning.

    The next document is that of the next smaller doc_id (after the least: the largest). The edited text is the text with
    its last floor(n/3) code points replaced by as many, or all, of the next one's first. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, the likeness of the fingerprint to the
    edited text's and to the next document's.

    Rows are dealt to ranges of doc_id, so no task orders them all; of each range only its largest row is sent to the range
    above as well. Texts travel once, compressed.

    Defined results: a null text is empty, has an empty fingerprint and is like nothing but an empty one; rows that share a
    doc_id follow one another in the order of their texts' hashes; null doc_ids come last; a table of one row is its own
    next; an empty table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = parts or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("row"), text_of().alias("text"))
    # at most `parts` boundaries reach the driver
    quantiles = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [k / parts for k in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    cuts = np.array(sorted({int(x) for x in quantiles}), np.int64)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _range_of(batch.column(0), cuts)], ["doc_id", "row", "b"])

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw = [pack.compress(t.encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _range_of(batch.column(0), cuts), pa.array(raw, pa.binary())], ["doc_id", "row", "b", "z"])

    # the first row of each range, in falling order: nulls last, ties by the text's hash; one row per range
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), (-F.col("row").cast("decimal(20,0)")).alias("tie"))
    firsts = rows.select("doc_id", "row").mapInArrow(ranges, "doc_id long, row long, b int").groupBy("b").agg(F.max(place).alias("p")).orderBy("b").collect()
    # it also ends the range above; the highest range's ends the lowest
    ends = [(r["b"], firsts[(i + 1) % len(firsts)]["b"], r["p"]["id"] if r["p"]["known"] else None, -int(r["p"]["tie"])) for i, r in enumerate(firsts)]
    ends = spark.createDataFrame(ends, "b int, above int, doc_id long, row long")
    sent = rows.mapInArrow(compress, "doc_id long, row long, b int, z binary").alias("s")
    same = (F.col("s.b") == F.col("e.b")) & F.col("s.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("s.row") == F.col("e.row"))
    sent = sent.join(F.broadcast(ends).alias("e"), same, "left")
    here, there = (F.struct(F.col(c).alias("b"), F.lit(g).alias("ghost")) for c, g in (("s.b", 0), ("above", 1)))
    sent = sent.select("s.doc_id", "s.row", "s.z", F.explode(F.when(F.col("above").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("to"))
    sent = sent.select("to.b", "to.ghost", "doc_id", "row", "z")
    sent = sent.repartition(parts, "b").sortWithinPartitions(F.col("b"), F.col("ghost"), F.col("doc_id").desc_nulls_last(), F.col("row"))
    return sent.mapInArrow(_edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _range_of(ids: pa.Array, cuts: np.ndarray) -> pa.Array:
    """Number of each id's range, rising with the ids; nulls are in the lowest."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    at = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), "left") + 1
    return pa.array(np.where(known, at, 0).astype(np.int32))


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (range, then falling; each range ends with the row that follows its last): fingerprints and likenesses."""
    walk, unpack = _walk(), zstandard.ZstdDecompressor()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def settle(held: list[tuple]) -> pa.RecordBatch | None:
        """held: consecutive rows (b, ghost, doc_id, text); all but the last, and ghosts, have their next beside them."""
        texts = [x[3] for x in held]
        cps, bounds = _code_points(texts)
        classes = _classes(cps)
        first = walk.steps(classes, bounds, np.zeros(len(texts), np.int64))
        lows, highs = bounds[:-1].tolist(), bounds[1:].tolist()
        prints = [walk.fingerprint(cps[a:b], first[a:b], _end(walk, classes, first, b)) if b > a else "0:" for a, b in zip(lows, highs)]
        mine = [i for i in range(len(held) - 1) if not held[i][1]]
        if not mine:
            return None
        # an edited text keeps its walk up to the cut; only what replaces the rest is walked anew
        cut = [len(texts[i]) - len(texts[i]) // 3 for i in mine]
        tails = [texts[i + 1][: len(texts[i]) // 3] for i in mine]
        tail_cps, tail_bounds = _code_points(tails)
        tail_classes = _classes(tail_cps)
        begin = np.array([0 if not c else _end(walk, classes, first, lows[i] + c) for i, c in zip(mine, cut)], np.int64)
        tail_first = walk.steps(tail_classes, tail_bounds, begin)
        out = []
        for k, (i, c, tail) in enumerate(zip(mine, cut, tails)):
            a, ta, tb = lows[i], int(tail_bounds[k]), int(tail_bounds[k + 1])
            end = _end(walk, tail_classes, tail_first, tb) if tb > ta else int(begin[k])
            edited = walk.fingerprint(np.concatenate((cps[a : a + c], tail_cps[ta:tb])), np.concatenate((first[a : a + c], tail_first[ta:tb])), end)
            sha = hashlib.sha256((texts[i][:c] + tail).encode()).hexdigest()
            out.append((held[i][2], len(texts[i]), sha, prints[i], edited, likeness(prints[i], edited), likeness(prints[i], prints[i + 1])))
        return pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out), kinds)], names)

    held, size = [], 0
    for batch in batches:
        for b, ghost, doc, z in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
            text = unpack.decompress(z).decode() if z else ""
            held.append((b, ghost, doc, text))
            size += len(text)
            if size >= HELD and len(held) > 1:
                if (done := settle(held)) is not None:
                    yield done
                held, size = held[-1:], len(held[-1][3])
    if len(held) > 1 and (done := settle(held)) is not None:
        yield done


def op5_edit_fingerprints(spark, sf_dir):
    """The contract's columns; links between alike texts are similar_groups()' part, beyond this query's budget of disk."""
    return next_edited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
