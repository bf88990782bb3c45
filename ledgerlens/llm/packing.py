"""Best-fit packing: token sequences of fixed capacity, filled by the sum-of-squares rule."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_stash, give_back, ship, slices, stash, text_of

CAPACITY, END_ID = 4096, 1
#: Pieces that one group packs at least; groups, not the corpus, are what one task holds.
GROUP = 40_000
#: Sequences with a larger gap than this are opened again and packed with the leftovers of other groups.
LOOSE = 8


def merge_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary as bytes and ranks, byte 1 standing for the end of a word.

    Ids rise with the order of the merges. As every entry of the vocabulary encodes to itself (a test holds this), two
    neighbours whose join is an entry can only be the pair that its merge names: until something outside joins in, what
    happens inside an entry's span is what happens to the entry alone. So merging by ranks gives the tokenizer's ids.
    """
    import json

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ranks = {}
    for name, rank in vocab.items():
        if not name.startswith("<|"):
            last = name.endswith("</w>") and name != "</w>"
            ranks[bytes(byte[c] for c in (name[:-4] if last else name)) + b"\x01" * last] = rank
    return ranks


class WordTokens:
    """Token ids of texts, through a bounded cache of words.

    The tokenizer drops white space and never merges across it, so a text's ids are its words' ids in a row. Words of
    plain letters, digits and signs split by the tokenizer's own pattern into runs, which are merged one by one; any
    other word goes to the tokenizer as it is.
    """

    LETTERS = "a-zß-öø-ÿ"
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
    RUNS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")

    def __init__(self, path: str, limit: int = 700_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        ranks = merge_ranks(path)
        self.runs = tiktoken.Encoding("runs", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.last = np.zeros(max(ranks.values()) + 1, bool)
        self.last[[r for b, r in ranks.items() if b.endswith(b"\x01")]] = True
        self.words, self.known, self.limit = {}, {}, limit

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if self.PLAIN.fullmatch(w) is not None and "<|" not in w]
        if len(plain) < len(words):
            for w in set(words).difference(plain):
                self.words[w] = np.array(self.whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        split = [self.RUNS.findall(w.lower()) for w in plain]
        if new := list({r for w in split for r in w} - self.known.keys()):
            ids = np.array(self.runs.encode_ordinary("\x01 ".join(new) + "\x01"), "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1  # every run's last token, and no other, ends a word
            if len(ends) != len(new):
                raise RuntimeError("runs don't end words one by one")
            raw, ends = ids.tobytes(), (ends * 4).tolist()
            self.known.update(zip(new, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        get = self.known.__getitem__
        self.words.update((w, b"".join(map(get, s))) for w, s in zip(plain, split))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, one bytes object per text.

        Arrow splits the texts and numbers their distinct words; Python sees each distinct word once, numpy does the rest.
        """
        if len(self.words) > self.limit:
            self.words.clear()
        if len(self.known) > self.limit:
            self.known.clear()
        split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if new := [w for w in words if w not in self.words]:
            self._learn(new)
        raw = list(map(self.words.__getitem__, words))
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ids, start = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(size) - size
        count = size[which]
        ends = np.cumsum(count)
        out = ids[np.repeat(start[which] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = (np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()] * 4).tolist()
        found = [out[p:q] for p, q in zip(at, at[1:])]
        # what Arrow takes for white space and the tokenizer doesn't
        for i in np.flatnonzero(pc.match_substring_regex(texts, "[\\x1c-\\x1f]").to_numpy(zero_copy_only=False)):
            found[i] = np.array(self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return found


_loaded: dict[str, WordTokens] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): every document's ids and its end id, cut only where longer than capacity.

    row tells apart rows that repeat a doc_id: a hash of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        tokens = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, WordTokens(tokenizer))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out = []
            for part in slices(batch, 2, 4 << 20):
                for doc, row, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), tokens.encode(part.column(2))):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        out.append((doc, row, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("row"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY, opening: bool = True) -> np.ndarray:
    """Bin of each length, longest first: where the squared counts of open bins per residual gap become least.

    An open bin of every gap that is wide enough and a new bin are candidates alike; full and untouched bins don't count.
    Ties go to an open bin before a new one, and to the tightest gap. Only lengths matter, so equal ones are
    interchangeable. opening=False leaves a new bin to lengths that no open bin holds: for leftovers, which no further
    lengths will fill up.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by residual gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, bins, never = np.empty(len(lengths), np.int64), 0, np.iinfo(np.int64).max
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        have = count[size:]
        # moving a bin from gap g to gap g - size changes the sum by 2 (count[g - size] - count[g] + 1); a filled one leaves it
        change = 2 * (count[: capacity + 1 - size] - have + 1)
        change[0] = 1 - 2 * have[0]
        change = np.where(have > 0, change, never)
        g = int(change.argmin())
        new = 2 * count[capacity - size] + 1 if size < capacity else 0
        if have[g] == 0 or (opening and new < change[g]):
            b, bins = bins, bins + 1
            gap = capacity - size
        else:
            b, gap = open_bins[g + size].pop(), g
            count[g + size] -= 1
        out[i] = b
        if gap:
            count[gap] += 1
            open_bins[gap].append(b)
    return out


def _pack_groups(rows: DataFrame, groups: int, level: int, capacity: int, final: bool) -> DataFrame:
    """Pack each group by itself. Adds sequence_id, offset and loose: in a sequence that a later level should open again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None

        def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            size = t.column("length").to_numpy()
            seq = sum_of_squares(size, capacity, not final)
            order = np.lexsort((-size, seq))
            before = np.cumsum(size[order]) - size[order]
            first = np.concatenate(([True], np.diff(seq[order]) > 0))
            offset = np.empty(len(size), np.int64)
            offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
            used = np.bincount(seq, size)[seq]
            ids = (level << 56) + (int(t.column("g")[0].as_py()) << 32) + seq
            loose = (used < capacity - LOOSE) & (not final)
            t = t.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset)).append_column("loose", pa.array(loose))
            return t.drop_columns(["g"]).combine_chunks().to_batches()[0]

        for batch in batches:
            g = batch.column(batch.schema.get_field_index("g")).to_numpy()
            for part in np.split(np.arange(len(g)), np.flatnonzero(np.diff(g)) + 1):
                if not len(part):
                    continue
                if group is not None and g[part[0]] != group:
                    yield packed(held)
                    held = []
                group = g[part[0]]
                held.append(batch.slice(int(part[0]), len(part)))
        if held:
            yield packed(held)

    key = F.pmod(F.xxhash64(F.lit(level), "doc_id", "row", "piece"), F.lit(groups)).cast("long").alias("g")
    rows = rows.select("doc_id", "row", "piece", "start", "length", "ids_crc32", key)
    rows = rows.repartition(groups, "g").sortWithinPartitions("g", "doc_id", "row", "piece")
    return rows.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, loose boolean")


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens: one row per piece with its sequence and place.

    The corpus is dealt at random into groups of about `group` pieces; each group is packed by the sum-of-squares rule,
    longest first. What lies in sequences not filled to within a few tokens goes on to fewer groups, until one group
    packs the last of it: leftovers shrink at every level, so no task holds more than a bounded share. At the last level a
    sequence is opened only for a piece that no open one holds.

    Defined results: a null or empty text is the end id alone, one piece of length 1; rows that repeat a doc_id are
    packed each; null doc_ids are packed too; texts longer than a sequence are cut into full pieces, whose last may be
    shorter; an empty table gives no row; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows, path = stash(pieces(docs, tokenizer, capacity), "pieces")
    done, level, before, left = [], 0, None, rows.count()
    while True:
        groups = max(1, -(-left // group))
        # the last level: one group, or leftovers that no longer shrink
        final = groups == 1 or (before is not None and left > 0.8 * before)
        packed, new = stash(_pack_groups(rows, groups, level, capacity, final), "packed")
        if not level:
            drop_stash(docs.sparkSession, path)  # later levels read the tables that the result reads too
        path = new
        done.append(packed.where(~F.col("loose")).drop("loose", "row"))
        if final:
            break
        rows = packed.where(F.col("loose")).drop("loose", "sequence_id", "offset")
        before, left, level = left, rows.count(), level + 1
        if not left:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_best_fit_pack(spark, sf_dir):
    import public_tokenizers

    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
