"""Near copies by the Jaccard likeness of their shingles: an exact prefix-filtered join, every link verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import drop_stash, fresh, ship, stash, text_of
from .components import components
from .simhash import SEED, shingle_hashes, simhash_groups

#: Least likeness of a link, and what rounding may take from it.
LEAST, EPS = 0.8, 1e-9
#: Documents sampled for frequent shingles, and how many of these are told apart. They only order shingles: results don't depend on them.
SAMPLE, FREQUENT = 20_000, 50_000
#: Keys that more sets share are first linked through a few of their members, in some rounds, by so many keys of each set.
HOT, REPS, ROUNDS, KEYS = 64, 3, 4, 6


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes((text or "").encode(), words))


def set_id(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - 2**63


def sketch(found: np.ndarray) -> bytes:
    """How many shingles fall into each of 256 bins, a byte each; empty if a byte can't hold one."""
    n = np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The rarest shingles of a set, in order: sets that share `least` of their union share one of these.

    The order is total and the same for all sets: by the count in the sample (0 if not frequent), then by hash.
    """
    n = len(found)
    if not n:
        return found
    rank = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        rank = np.where(frequent[at] == found, counts[at], 0)
    return found[np.argsort(rank, kind="stable")[: n - math.ceil(least * n - EPS) + 1]]


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a bounded sample, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words).view(np.int64))], ["h"])

    n = docs.count()
    some = docs.select(text_of().alias("text")).sample(False, min(1.0, SAMPLE / max(n, 1)), SEED)
    rows = some.mapInArrow(run, "h long").groupBy("h").count().where("count >= 4").orderBy(F.desc("count"), "h").limit(FREQUENT).toArrow()
    h, c = rows.column("h").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, n, prefix) to (key, sid, n, pos)."""
    for batch in batches:
        sid, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for lo in range(0, len(sid), 1000):
            parts = [np.frombuffer(p, np.int64) for p in batch.column(2).slice(lo, 1000).to_pylist()]
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            pos = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            cols = [np.concatenate(parts), np.repeat(sid[lo : lo + 1000], size), np.repeat(n[lo : lo + 1000], size), pos]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "sid", "n", "pos"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of key those whose key another row has too."""
    held, held_out = None, False  # the last row seen: whether it goes out shows in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        key = both.column(0).to_numpy(zero_copy_only=False)
        same = key[1:] == key[:-1]
        keep = np.zeros(len(key), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if held_out:
            keep[0] = False
        last = bool(keep[-1])
        held, held_out = both.slice(len(key) - 1), last or (held_out and len(key) == 1)
        yield both.filter(pa.array(keep))


def _may(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(a, b, sketch of a, sketch of b) without the pairs whose bins don't hold the overlap: the lesser count of each bin bounds it."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            keep.append(not len(x) or not len(y) or np.minimum(x, y).sum(dtype=np.int64) >= least / (1 + least) * (x.sum(dtype=np.int64) + y.sum(dtype=np.int64)) - EPS)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(a, b, set of a, set of b) to the pairs whose Jaccard likeness is `least` or more."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= least * (len(x) + len(y) - both) - EPS)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _can(least: float):
    """Length and position allow the overlap that `least` asks for: true at the first shingle that a pair shares."""
    na, nb, ia, ib = (F.col(c) for c in ("x.n", "y.n", "x.pos", "y.pos"))
    need = F.lit(least / (1 + least)) * (na + nb) - EPS
    return (F.least(na, nb) >= F.lit(least) * F.greatest(na, nb) - EPS) & (F.least(na - ia, nb - ib) >= need)


def near_copy_links(docs: DataFrame, rows: DataFrame, words: int, least: float, keys: DataFrame, links: DataFrame) -> DataFrame:
    """links and verified links (a, b) of set ids that connect all sets of likeness `least` or more; links: those that are
    known already, whose sets are not compared again."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared, shared_at = stash(keys.mapInArrow(_explode, "key long, sid long, n int, pos int").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_shared, "key long, sid long, n int, pos int"), "keys")
    if shared.isEmpty():
        return links

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], ["sid", "found"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Only the texts that stand in a pair are read again; which these are is a table of known size."""
        side = lambda c: rows.groupBy(F.col("sid").alias(c)).agg(F.min("sketch").alias(f"s{c}"))
        pairs = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
        pairs, at = stash(pairs.mapInArrow(lambda batches: _may(batches, least), "a long, b long"), "pairs")
        some = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        some, some_at = stash(rows.join(some, "sid").groupBy("sid").agg(F.min("key").alias("key")).select("key").distinct(), "texts")
        texts = docs.select(text_of().alias("text")).withColumn("key", F.xxhash64("text")).join(some, "key", "left_semi").select("text")
        sets, sets_at = stash(texts.mapInArrow(sets_of, "sid long, found binary").groupBy("sid").agg(F.min("found").alias("found")), "sets")
        both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("found").alias("fa")), "a").join(sets.select(F.col("sid").alias("b"), F.col("found").alias("fb")), "b")
        out, _ = stash(both.select("a", "b", "fa", "fb").mapInArrow(lambda batches: _verify(batches, least), "a long, b long"), "near")
        for path in (at, some_at, sets_at):
            drop_stash(spark, path)
        return out

    def rooted(part: DataFrame) -> DataFrame:
        """part with the root of each set: sets, of which there are fewer than rows, meet the components."""
        sets = part.select("sid").distinct().join(components(links).withColumnRenamed("node", "sid"), "sid", "left")
        return part.join(sets.select("sid", F.coalesce("root", "sid").alias("root")), "sid")

    # near copies share most of their keys, and so many keys have the very same sets: one of these keys is enough. Of a set's
    # places the first counts, which is what the position test wants; two lists that collide only make more pairs to verify
    size = shared.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.sum(F.xxhash64("sid").cast("decimal(20,0)")).alias("who"))
    alike = size.select("key", "count", F.xxhash64("count", "who").alias("list"))
    lists, lists_at = stash(shared.join(alike, "key").groupBy(F.col("list").alias("key"), "sid").agg(F.max("n").alias("n"), F.min("pos").alias("pos"), F.max("count").alias("count")), "lists")
    drop_stash(spark, shared_at)
    hot = lists.where(F.col("count") > HOT)
    # a set that stands under many hot keys is like what its copies were made of: it comes first where a key is new
    hot, hot_at = stash(hot.join(hot.groupBy("sid").agg(F.count(F.lit(1)).alias("held")), "sid"), "hot")
    for k in range(0 if hot.isEmpty() else ROUNDS):
        part, at = stash(rooted(hot), "part")
        by = F.col("held").desc() if k % 2 == 0 else F.xxhash64("sid", F.lit(k))
        # the others of a key meet members of its largest groups, so that these take in what they can: a row per key and root
        large = ranked(part.groupBy("key", "root").agg(F.count(F.lit(1)).alias("mine")), "key", F.col("mine").desc(), F.col("root"), top=REPS)
        reps = ranked(part.join(large, ["key", "root"]), "key", F.col("mine").desc(), by, F.col("sid"), top=REPS)
        # a few keys of each set, its most shared ones and then others: what is not linked by these is met below
        few = ranked(part, "sid", F.col("count").desc() if k % 2 == 0 else F.xxhash64("key", F.lit(k)), F.col("key"), top=KEYS)
        pairs = few.alias("x").join(reps.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _can(least))
        links = links.unionByName(verified(pairs.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"))))
        drop_stash(spark, at)
    # all that is left: the pairs of each key that no chain of links joins yet
    left, left_at = stash(rooted(lists), "left")
    pairs = left.alias("x").join(left.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & _can(least))
    found = verified(pairs.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")))
    for path in (left_at, lists_at, hot_at):
        drop_stash(spark, path)
    return links.unionByName(found)


def ranked(rows: DataFrame, by: str, *order, top: int) -> DataFrame:
    """The first rows of each value of `by`; Spark keeps no more of them in each task before they move."""
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("at") <= top).drop("at")


def fingerprint_links(docs: DataFrame, rows: DataFrame, words: int, bits: int) -> DataFrame:
    """(a, b) of set ids: the sets of each SimHash component with its first one. rows: key, sid."""
    roots = simhash_groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), words, bits, True).groupBy("key").agg(F.min("root").alias("fp_root"))
    sets = rows.join(roots, "key").select("sid", "fp_root").distinct()
    sets = sets.join(sets.groupBy("fp_root").agg(F.min("sid").alias("a")), "fp_root")
    return stash(sets.select("a", F.col("sid").alias("b")).where("a <> b").distinct(), "fingerprint-links")[0]


def near_copy_groups(docs: DataFrame, words: int = 5, least: float = LEAST, bits: int | None = None) -> DataFrame:
    """(doc_id, key, root) per row: key is xxhash64 of its text; rows of one root are linked by likeness `least` or more.

    The likeness of two texts is the Jaccard index of their sets of `words`-word shingles (a shorter text is one
    shingle). No pair is lost: two such sets share a shingle among the rarest n - ceil(least * n) + 1 of each, so these
    meet by equality, and the pairs that length and position allow are verified on the whole sets. Equal sets are one
    node. Keys that many sets share are linked through a few members first; then only pairs of different groups remain.
    bits: texts whose SimHash fingerprints are linked over at most so many differing bits are linked too, and first of all.
    """
    frequent, counts = _frequent(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, words) for t in batch.column(2).to_pylist()]
            sid, n = pa.array([set_id(f) for f in found], pa.int64()), pa.array([len(f) for f in found], pa.int32())
            keys = pa.array([prefix(f, frequent, counts, least).tobytes() for f in found], pa.binary())
            bins = pa.array([sketch(f) for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sid, n, keys, bins], ["doc_id", "key", "sid", "n", "prefix", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("key"), text_of().alias("text"))
    rows, _ = stash(rows.mapInArrow(run, "doc_id long, key long, sid long, n int, prefix binary, sketch binary"), "rows")
    known = docs.sparkSession.createDataFrame([], "a long, b long") if bits is None else fingerprint_links(docs, rows.select("key", "sid"), words, bits)
    links = near_copy_links(docs, rows.select("key", "sid", "sketch"), words, least, rows.groupBy("sid", "n").agg(F.min("prefix").alias("prefix")), known)
    rows = rows.select("doc_id", "key", "sid")
    return rows.join(components(links).withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "key", F.coalesce("root", "sid").alias("root"))


def near_copy_dedup(docs: DataFrame, words: int = 5, least: float = LEAST, bits: int | None = None) -> DataFrame:
    """docs without the near copies: of each group only the row with the least doc_id stays, with all its columns.

    Null and empty texts are copies of each other and of nothing else. Rows without a doc_id stay only if nothing with
    one is in their group. Rows of a group that share its least doc_id: one stays. bits as for near_copy_groups().
    """
    ship(docs.sparkSession)
    key, at, doc, text = fresh(docs, "key", "at", "keep_doc", "keep_key")
    groups, _ = stash(near_copy_groups(docs, words, least, bits), "groups")
    keep = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"))
    keep, _ = stash(keep.select(F.col("m.doc_id").alias(doc), F.col("m.key").alias(text)), "keep")
    rows = docs.withColumn(key, F.xxhash64(text_of()))
    rows = rows.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text)), "left_semi")
    if not groups.groupBy("doc_id", "key").count().where("count > 1").isEmpty():  # texts move only if rows repeat
        one = Window.partitionBy("doc_id", key).orderBy(F.lit(0))
        rows = rows.withColumn(at, F.row_number().over(one)).where(F.col(at) == 1)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
