"""SimHash near-dedup: deletion-variant signatures find fingerprints that differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import fresh, ship, stash, text_of
from .components import components

SEED = 42
#: Two segments of 32 bits: three differing bits leave one segment with one at most.
SEGMENT, MAX_BITS = 32, 3
#: Buckets over this size are cut again before pairs are compared.
DENSE = 6000


def shingle_hashes(raw: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of `words` words, A-Z lower-cased; of the whole sequence if it is shorter; none if empty."""
    found = raw.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(words, len(found)) - 1 :][:n] - 1).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, stops)), repeat(SEED)), np.uint64, n)


def fingerprint(raw: bytes, words: int = 3) -> int:
    """64-bit SimHash as a signed integer; zero for a text without words."""
    h = shingle_hashes(raw, words)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 65536):  # very long texts: a bounded array of bits at a time
        part = h[lo : lo + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, key, fp long) for every row, key a hash of its text; null text counts as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, words) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("key"), text_of().cast("binary").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def _forest(fps: np.ndarray, max_bits: int, deep: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever links of at most max_bits connect in fps (unsigned, distinct): never all pairs."""
    if len(fps) > DENSE and deep:  # the same cut again, in four segments of 16 bits with one deleted
        out = []
        for seg in range(4):
            part = (fps >> np.uint64(16 * seg)) & np.uint64(0xFFFF)
            for bit in range(16):
                masked = part & np.uint64(0xFFFF ^ (1 << bit))
                order = np.argsort(masked, kind="stable")
                cuts = np.flatnonzero(np.diff(masked[order])) + 1
                for group in np.split(order, cuts):
                    if len(group) > 1:
                        out += _forest(fps[group], max_bits, deep=False)
        a, b = (np.concatenate([x[k] for x in out]) if out else np.empty(0, np.uint64) for k in (0, 1))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return [(both[:, 0], both[:, 1])]
    rest, out = fps, []
    while len(rest) > 1:  # breadth first: each fingerprint meets only those that no link has reached yet
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                got = rest[near]
                out.append((np.full(len(got), x), got))
                queue.extend(got)
                rest = rest[~near]
    return out


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) in order of key: yields links (a, b) within each key."""
    open_key, open_fps = None, []

    def table(pairs) -> pa.RecordBatch:
        a, b = (np.concatenate([p[k] for p in pairs]).view(np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def close(parts):
        fps = np.unique(np.concatenate(parts).view(np.uint64))
        return _forest(fps, max_bits) if len(fps) > 1 else []

    for batch in batches:
        key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(key):
            continue
        cuts = np.flatnonzero(np.diff(key)) + 1
        bounds = np.concatenate(([0], cuts, [len(key)]))
        pairs = []
        if open_key is not None and key[0] != open_key:
            pairs += close(open_fps)
            open_fps = []
        if len(bounds) == 2:
            open_key, open_fps = key[0], [*open_fps, fp]
        else:
            pairs += close([*open_fps, fp[: bounds[1]]])
            hi = bounds[-2]
            sizes = np.diff(bounds[1:-1])
            two = bounds[1:-2][sizes == 2]
            a, b = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
            near = (np.bitwise_count(a ^ b) <= max_bits) & (a != b)
            if near.any():
                pairs.append((a[near], b[near]))
            for at, n in zip(bounds[1:-2][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                pairs += close([fp[at : at + n]])
            open_key, open_fps = key[-1], [fp[hi:]]
        if pairs:
            yield table(pairs)
    if open_key is not None and (pairs := close(open_fps)):
        yield table(pairs)


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect all distinct fp values of at most max_bits differing bits.

    Every distinct fingerprint gives 64 keys: one of its two halves with one bit deleted, and which. Two fingerprints of
    at most three differing bits share a key: some half differs in one bit at most. Equal keys meet by a shuffle on the
    key; within a key every pair is verified by its bits, but only links that join two groups are returned, so a key that
    many fingerprints share yields one link less than it has members.
    """
    if max_bits > 3:
        raise ValueError("two segments with one deletion find at most three differing bits")
    half = lambda k: F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))
    bit = F.col("bit")
    masked = F.when(bit < SEGMENT, half(0)).otherwise(half(1))
    key = masked.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit % 32)"))).bitwiseOR(F.expr("shiftleft(cast(bit as bigint), 32)"))
    rows = fps.select("fp").distinct().select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select(key.alias("key"), "fp")
    n = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(n, "key").sortWithinPartitions("key")
    return rows.mapInArrow(lambda batches: _links(batches, max_bits), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, words: int = 3, max_bits: int = MAX_BITS, roots: bool = False) -> DataFrame:
    """(doc_id, fp long, component_id): component_id is the least doc_id reachable over links of at most max_bits bits.
    roots: (doc_id, key, fp, root) instead, root naming the component, key being xxhash64 of the row's text.

    Defined results: null and empty texts have no words, fingerprint zero, and link like any other; fewer words than a
    shingle count as one shingle; equal fingerprints are one node, so copies never form pairs; each input row gives one
    output row, also where doc_ids repeat; null doc_ids belong to a component but never name it unless it has no other
    (then component_id is null); an empty table gives no row.
    """
    fps, _ = stash(fingerprints(docs, words), "fps")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = components(near_links(nodes, max_bits))
    named = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    if roots:
        return fps.join(named.select("fp", "root"), "fp").select("doc_id", "key", "fp", "root")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, words: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """docs without the near copies: of each component one row stays, with all its columns.

    The row that stays has the component's least doc_id; of several such rows the one with the least fingerprint, then with
    the least hash of its text, then any. Rows without a doc_id stay only if nothing in their component has one. Rows of
    different components never take each other's place, also where they share a doc_id.
    """
    cols, (key, at) = docs.columns, fresh(docs, "key", "at")
    groups, _ = stash(simhash_groups(docs.withColumn("doc_id", F.col("doc_id").cast("long")), words, max_bits, True), "groups")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "key")).alias("m")
    keep = groups.groupBy("root").agg(best).select(F.col("m.doc_id").alias("keep_doc"), F.col("m.key").alias("keep_key"))
    rows = docs.withColumn(key, F.xxhash64(text_of()))
    rows = rows.join(keep.distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("keep_doc")) & (F.col(key) == F.col("keep_key")), "left_semi")
    # equal rows: one stays
    one = Window.partitionBy("doc_id", key).orderBy(F.lit(0))
    return rows.withColumn(at, F.row_number().over(one)).where(F.col(at) == 1).select(*[F.col(f"`{c}`") for c in cols])


def op10_simhash_near_dedup(spark, sf_dir):
    out = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
