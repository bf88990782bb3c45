"""Long passages that occur more than once: what substring dedup over words and over bytes have in common.

Every window of a fixed number of units belongs to a super-k-mer, a run of consecutive windows that share a minimiser.
Equal windows share their minimiser wherever they stand, so:

1. each document gives rows (minimiser, hash of the super-k-mer's string, place); minimisers seen in one place only are done;
2. equal super-k-mers are aggregated, with map-side combine, before anything else moves: of copies one travels on;
3. where different super-k-mers share a minimiser, each distinct string travels, packed, to its bucket, where the operator's
   own method compares windows;
4. a bucket of more strings than a task should hold is cut again: its strings are taken as texts and go through 1 to 3 with
   minimisers of another order, so windows that are equal still meet, and others part;
5. what was found meets the places again, spans are gathered per document, and texts are shuffled once to be cut.

Strings are equal if minimiser and hash, 128 bits together, are. Intermediate tables lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_stash, slices, stash, text_of
from .segments import ragged, super_kmers

SPANS = "array<struct<s:int,e:int>>"
PLACE = "doc long, row long"
#: How often a bucket may be cut again by minimisers of another order.
LEVELS = 4


@dataclass(frozen=True)
class Units:
    """How a text becomes units: `window` of them are compared, minimisers are hashes of `k`, their order is the seed's."""

    words: bool
    window: int
    k: int
    seed: int = 0

    def read(self, texts: pa.Array, hashed: bool = True):
        """(unit hashes, where each text's begin and the end, packed bytes per text, byte offset of each unit in its text)."""
        if not self.words:
            raw = texts.cast(pa.binary()).to_pylist()
            bounds = np.cumsum([0, *map(len, raw)])
            if not hashed:
                return None, bounds, raw, None
            table = np.random.default_rng(20240501).integers(0, 2**64, 256, dtype=np.uint64)
            return table[np.frombuffer(b"".join(raw), np.uint8)], bounds, raw, None
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.cast(pa.string())))
        raw = pc.binary_join(split, " ").cast(pa.binary()).to_pylist()
        hashes = None
        if hashed:
            coded = split.flatten().dictionary_encode()
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))[coded.indices.to_numpy()]
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        size = pc.binary_length(split.flatten()).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        at = np.cumsum(size) - size
        at -= np.repeat(at[np.minimum(bounds[:-1], max(0, len(at) - 1))], np.diff(bounds)) if len(at) else 0
        return hashes, bounds, raw, np.append(at, 0)


def _cut(raw: list[bytes], seq, start, units, at, bounds) -> list[bytes]:
    """The packed strings of units [start, start + units) of texts seq."""
    if at is None:
        return [raw[q][s : s + n] for q, s, n in zip(seq.tolist(), start.tolist(), units.tolist())]
    low = at[bounds[seq] + start]
    end = bounds[seq] + start + units
    high = np.where(end < bounds[seq + 1], at[end] - 1, np.iinfo(np.int64).max)
    return [raw[q][a:b] for q, a, b in zip(seq.tolist(), low.tolist(), high.tolist())]


def places(docs: DataFrame, unit: Units) -> DataFrame:
    """One row per super-k-mer: doc, row, start, windows, mini, h, many (its minimiser stands in it more than once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                hashes, bounds, raw, at = unit.read(part.column(2))
                seq, start, count, low, kmers = super_kmers(hashes, bounds, unit.window, unit.k, unit.seed)
                if not len(seq):
                    continue
                span = count + unit.window - unit.k
                here = kmers[ragged(bounds[seq] + start, span)] == np.repeat(low, span)
                many = np.add.reduceat(here, np.cumsum(span) - span) > 1
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, _cut(raw, seq, start, count + unit.window - 1, at, bounds)), np.uint64, len(seq))
                of = pa.array(seq)
                cols = [part.column(0).take(of), part.column(1).take(of), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(low.view(np.int64)), pa.array(h.view(np.int64)), pa.array(many)]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "row", "start", "windows", "mini", "h", "many"])

    return docs.mapInArrow(run, f"{PLACE}, start int, windows int, mini long, h long, many boolean")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, row, text) of every row: null ids come after all others, row is a hash that tells apart rows of one id."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    return docs.select(doc.alias("doc"), F.xxhash64(F.lit(3), "doc_id", text_of()).alias("row"), text_of().alias("text"))


def strings(docs: DataFrame, wanted: DataFrame, unit: Units) -> DataFrame:
    """The packed strings of `wanted` (mini, h, first, doc, row, start, windows), cut from their documents."""
    fields = ["mini", "h", "first", "n", "start", "windows"]
    by = wanted.groupBy(F.col("doc").alias("d"), F.col("row").alias("r")).agg(F.collect_list(F.struct(*fields)).alias("want"))
    same = (F.col("doc") == F.col("d")) & (F.col("row") == F.col("r"))
    both = docs.join(by, same).select("text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                _, bounds, raw, at = unit.read(part.column(0), hashed=False)
                lists = part.column(1)
                want = lists.flatten()
                seq = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                start, count = (want.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "windows"))
                packed = _cut(raw, seq, start, count + unit.window - 1, at, bounds)
                yield pa.RecordBatch.from_arrays([*(want.field(f) for f in ("mini", "h", "first", "n")), pa.array(packed, pa.binary())], ["mini", "h", "first", "n", "packed"])

    return both.mapInArrow(run, "mini long, h long, first long, n long, packed binary")


def repeated_spans(rows: DataFrame, unit: Units, ordered: bool, compare: Callable[[DataFrame], DataFrame], bucket: int, levels: int = LEVELS) -> tuple[DataFrame, str]:
    """(doc, row, spans): the units to remove of each text, overlapping spans allowed; and the table that holds them.

    rows: (doc, row, text), as keyed() gives them. ordered: only what also starts in a smaller doc is removed; else all that
    starts elsewhere, however often. compare: takes the travelling strings (mini, h, first, n, packed) and returns (mini, h,
    runs), the spans, in units of the string, of windows that other strings (or the string itself) hold. Buckets of more than
    `bucket` distinct strings are cut again, `levels` times at most.
    """
    spark = rows.sparkSession
    at, at_path = stash(places(rows, unit), "places")
    if ordered:
        worth = F.min("doc") != F.max("doc")
        mixed = F.min("h") != F.max("h")
    else:
        mixed = (F.min("h") != F.max("h")) | F.max("many")
        worth = (F.count(F.lit(1)) > 1) | F.max("many")
    minis = at.groupBy("mini").agg(worth.alias("worth"), mixed.alias("mixed")).where("worth").drop("worth")
    shared, shared_path = stash(at.drop("many").join(minis, "mini"), "shared")
    drop_stash(spark, at_path)
    n = F.count(F.lit(1))
    whole = (F.min("doc") != F.max("doc")) if ordered else n > 1
    groups = shared.groupBy("mini", "h").agg(n.alias("n"), whole.alias("whole"), F.min(F.struct("doc", "row", "start", "windows")).alias("at"), F.max("mixed").alias("mixed"))
    groups, groups_path = stash(groups, "groups")
    travel = groups.where("mixed").select("mini", "h", F.col("at.doc").alias("first"), "n", "at.doc", "at.row", "at.start", "at.windows")
    used = [shared_path, groups_path]
    large, large_path = stash(travel.groupBy("mini").count().where(F.col("count") > bucket).select("mini"), "large")
    used.append(large_path)
    if levels and not large.isEmpty():
        packed, path = stash(strings(rows, travel, unit), "strings")
        again = packed.join(large, "mini", "left_semi").select("mini", "h", F.col("first").alias("doc"), F.xxhash64("mini", "h").alias("row"), F.col("packed").alias("text"))
        deeper, deeper_path = repeated_spans(again.select("doc", "row", "text"), replace(unit, seed=unit.seed + 1), ordered, compare, bucket, levels - 1)
        used += [path, deeper_path]
        compared = compare(packed.join(large, "mini", "left_anti")).unionByName(again.drop("text").join(deeper, ["doc", "row"]).select("mini", "h", F.col("spans").alias("runs")))
    else:
        compared = compare(strings(rows, travel, unit))
    found, found_path = stash(compared, "found")
    used.append(found_path)
    known = groups.select("mini", "h", "whole", F.col("at.doc").alias("first")).join(found, ["mini", "h"], "left").where(F.col("whole") | F.col("runs").isNotNull())
    # (doc, row, start) joins its super-k-mer's verdict; a hot one is split by Spark's skew join
    all_of = F.array(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("windows") + unit.window - 1).cast("int").alias("e")))
    part_of = F.transform("runs", lambda x: F.struct((x["s"] + F.col("start")).cast("int").alias("s"), (x["e"] + F.col("start")).cast("int").alias("e")))
    gone = F.when((F.col("doc") > F.col("first")) if ordered else F.col("whole"), all_of).otherwise(part_of)
    met = shared.select("mini", "h", "doc", "row", "start", "windows").join(known, ["mini", "h"]).select("doc", "row", gone.alias("spans")).where(F.col("spans").isNotNull())
    spans, spans_path = stash(met.groupBy("doc", "row").agg(F.flatten(F.collect_list("spans")).cast(SPANS).alias("spans")), "spans")
    for path in used:
        drop_stash(spark, path)
    return spans, spans_path


def covered(spans, n: int) -> np.ndarray:
    """Boolean mask of n units under the spans."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, [x["s"] for x in spans], 1)
    np.add.at(step, [min(x["e"], n) for x in spans], -1)
    return np.cumsum(step[:-1]) > 0


def with_spans(docs: DataFrame, spans: DataFrame, drop: list[str]) -> DataFrame:
    """(row, text, spans): docs' columns (without those in `drop`) as one struct, and each row's own text and spans."""
    gone = {c.lower() for c in drop}
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in gone])
    rows = docs.select(row.alias("row"), text_of().alias("text"), doc.alias("doc"), F.xxhash64(F.lit(3), "doc_id", text_of()).alias("hash"))
    spans = spans.select(F.col("doc").alias("d"), F.col("row").alias("r"), "spans")
    return rows.join(spans, (F.col("doc") == F.col("d")) & (F.col("hash") == F.col("r")), "left").select("row", "text", "spans")
