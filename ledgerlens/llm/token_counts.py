"""Token counts: byte-pair merging with a heap over a linked list of symbols; counts only, no ids."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, ship, slices, text_of, without

#: What the byte-level pattern of this family of vocabularies splits texts into before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers, and the longest of them in code points.
REMEMBERED, LONGEST = 600_000, 48


def byte_names() -> dict[str, int]:
    """The vocabulary's name of each byte: printable ones stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(plain)))}


class MergeCounter(dict):
    """Tokens of a word, by word: a bounded memory over merged().

    Symbols are numbered by this class alone: a byte is itself, and what merge r makes is 256 + r. `ranks` has the merge
    of a pair (left << 17 | right), so the lowest rank of all adjacent pairs is the next merge.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            raise ValueError("only byte-level BPE vocabularies that split by the usual pattern, without a normalizer, can be counted")
        number = byte_names()
        self.ranks: dict[int, int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = number[left], number[right]
            self.ranks.setdefault(a << 17 | b, r)
            number.setdefault(left + right, 256 + r)
        # a special string inside a text is one token and parts what stands around it, as the library does by default
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take in their surroundings are not known here")
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.added_strings = added
        self.words = regex.compile(WORDS)

    def __missing__(self, word: str) -> int:
        n = self.merged(word.encode())
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n

    def merged(self, raw: bytes) -> int:
        """Symbols left of one word: as many as it has bytes, less one for every merge.

        The heap holds (rank, place) of adjacent pairs, as one integer; of equal ranks the leftmost comes first. Symbols
        are a doubly linked list over their first bytes' places. An entry whose pair has changed meanwhile is skipped.
        """
        n = left = len(raw)
        if n < 2:
            return n
        rank_of, symbol = self.ranks.get, list(raw)
        heap = [r * n + i for i in range(n - 1) if (r := rank_of(symbol[i] << 17 | symbol[i + 1])) is not None]
        if not heap:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, i = divmod(pop(heap), n)
            j = after[i]
            if j >= n or symbol[i] < 0 or rank_of(symbol[i] << 17 | symbol[j]) != rank:
                continue
            own = symbol[i] = 256 + rank
            symbol[j] = -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(own << 17 | symbol[k])) is not None:
                    push(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbol[h] << 17 | own)) is not None:
                push(heap, r * n + h)
        return left

    def count(self, text: str) -> int:
        parts, n = [text], 0
        if self.added and any(s in text for s in self.added_strings):
            parts = self.added.split(text)
            n = len(parts) - 1
        for part in parts:
            n += sum(map(self.__getitem__, self.words.findall(part)))
        return n


_loaded: dict[str, MergeCounter] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """docs without the text, plus n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    tokenizer: path of a byte-level BPE vocabulary, which every executor must be able to read. Counts are those of its own
    library without special tokens at the ends; special strings inside texts count as one. Texts never leave their task:
    there is no shuffle, and a task holds a few megabytes of texts and a bounded memory of words.

    Defined results: a null or empty text has 0 bytes and 0 tokens; rows that repeat are counted each; a text of one
    endless word is merged whole; null doc_ids and other columns are kept; columns of the names that are added are replaced.
    """
    ship(docs.sparkSession)
    kept = without(docs, (text, "n_bytes", "n_tokens", "over_limit"))
    (own,) = fresh(docs, "text_bytes_of")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], text_of(f"`{text}`").alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _loaded.get(tokenizer) or _loaded.setdefault(tokenizer, MergeCounter(tokenizer))
        for batch in batches:
            last = batch.num_columns - 1
            for part in slices(batch, last):
                n = np.fromiter(map(counter.count, part.column(last).to_pylist()), np.int64, part.num_rows)
                cols = [*part.columns[:last], pc.binary_length(part.column(last)).cast(pa.int64()), pa.array(n), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = [*kept, "n_bytes", "n_tokens", "over_limit"]
    schema = rows.select(*[F.col(f"`{c}`") for c in kept]).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return rows.mapInArrow(run, schema)


def op12_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
