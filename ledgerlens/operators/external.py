"""Calls to models and services behind injected functions: batched, limited in pace, merged with what is known already."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def call_in_batches(rows: DataFrame, call: Callable[[list[str]], list], column: str, out: str, kind: str, size: int = 16, per_second: float | None = None) -> DataFrame:
    """rows plus `out`, call() of the column's values in batches of `size`; a batch that fails is tried again value by value,
    and what fails alone is null. Blank values are not sent. per_second paces each task: give it quota / number of tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = time.monotonic()

        def paced(values: list[str]) -> list:
            nonlocal ready
            if per_second:
                now = time.monotonic()
                if now < ready:
                    time.sleep(ready - now)
                ready = max(now, ready) + len(values) / per_second
            return call(values)

        for b in batches:
            values = b[column].tolist()
            todo = [i for i, v in enumerate(values) if v is not None and str(v).strip()]
            got: list = [None] * len(values)
            for lo in range(0, len(todo), size):
                part = todo[lo : lo + size]
                try:
                    found = list(paced([values[i] for i in part]))
                except Exception:  # noqa: BLE001  a service may fail in any way
                    found = []
                for k, i in enumerate(part):
                    value = found[k] if k < len(found) else None
                    if value is None:
                        try:
                            value = next(iter(paced([values[i]])), None)
                        except Exception:  # noqa: BLE001
                            value = None
                    got[i] = value
            yield b.assign(**{out: pd.Series(got, index=b.index, dtype=object)})

    return rows.mapInPandas(run, ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes if n != out), f"`{out}` {kind}"]))


def rerank(rows: DataFrame, by: list[str], score: Callable[[list[str]], list[float]], weight: float = 0.7, size: int = 4, text: str = "text") -> DataFrame:
    """Candidates (by, query, text, distance) with relevance from an injected scorer of "query\\n\\ntext", blended with their
    distance and ranked. Batches that come back short, or without a score, are filled candidate by candidate."""
    from .fusion import blend
    from .retrieval import ranked

    scored = call_in_batches(rows.withColumn("__asked", F.concat_ws("\n\n", "query", text)), score, "__asked", "relevance", "double", size).drop("__asked")
    out = scored.withColumn("score", blend(F.coalesce("relevance", F.lit(0.0)), F.col("distance")))
    return ranked(out, by, F.col("score").desc(), F.col("distance").desc(), F.col(text))


def encode(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str, out: str = "embedding", size: int = 64, least: int = 1) -> DataFrame:
    """rows plus vectors from an injected encoder. A batch that does not fit is cut to three quarters and tried again, down to
    `least`; blank texts get null at their own row, so vectors never shift."""

    def backoff(values: list[str]) -> list:
        n = len(values)
        while True:
            try:
                return [v for lo in range(0, len(values), n) for v in embed(values[lo : lo + n])]
            except MemoryError:
                if n <= least:
                    raise
                n = max(least, n * 3 // 4)

    return call_in_batches(rows, backoff, text, out, "array<double>", size)


def hashed_vectors(dim: int = 256) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for a sentence encoder: words hashed to signed places of a unit vector. The same on every machine."""

    def embed(texts: list[str]) -> list[list[float]]:
        import zlib

        import numpy as np

        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if (h >> 16) & 1 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def sparse_weights(texts: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """A stand-in for a sparse encoder: (key, term, w), log(1 + count) of every token, no vector per text in memory."""
    return texts.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.log1p(F.count(F.lit(1))).alias("w"))


def sse_events(lines: Iterator[str]) -> Iterator[dict]:
    """The JSON payloads of a server-sent event stream: data lines up to a blank one are one event; "[DONE]" ends it."""
    held: list[str] = []

    def payload() -> dict | None:
        said = "\n".join(held).strip()
        return json.loads(said) if said and said != "[DONE]" else None

    for line in (*lines, ""):
        line = line.rstrip("\r\n")
        if line.startswith("data:"):
            held.append(line[5:].lstrip())
            if held[-1] == "[DONE]":
                return
        elif not line.strip() and held:
            if (event := payload()) is not None:
                yield event
            held = []


def streamed_text(lines: Iterator[str]) -> str:
    """What a streamed chat answer says: the pieces of its events in order."""
    out = []
    for event in sse_events(lines):
        for choice in event.get("choices", []):
            out.append((choice.get("delta") or choice.get("message") or {}).get("content") or "")
        if event.get("type") == "response.output_text.delta":
            out.append(event.get("delta") or "")
    return "".join(out)


class TokenBucket:
    """How many requests and tokens may go now: both refill with time up to a minute's worth; what does not fit waits."""

    def __init__(self, requests_a_minute: float, tokens_a_minute: float, clock: Callable[[], float] = time.monotonic):
        self.limits, self.have, self.clock, self.last = (requests_a_minute, tokens_a_minute), [requests_a_minute, tokens_a_minute], clock, clock()

    def take(self, tokens: float) -> bool:
        now = self.clock()
        self.have = [min(most, h + most * (now - self.last) / 60) for h, most in zip(self.have, self.limits)]
        self.last = now
        if self.have[0] < 1 or self.have[1] < tokens:
            return False
        self.have = [self.have[0] - 1, self.have[1] - tokens]
        return True


def run_requests(requests: list[tuple[int, dict]], call: Callable[[dict], dict], bucket: TokenBucket, tokens: Callable[[dict], float], tries: int = 5, wait: Callable[[], None] = lambda: time.sleep(0.01)) -> Iterator[tuple[int, dict | None, str | None]]:
    """(id, answer, error) as requests finish, within the bucket's pace; failed ones go to the end of the queue, `tries` times.
    For the requests of one task; tables are dealt to tasks, each with its share of the quota."""
    queue = [(i, r, tries) for i, r in requests]
    while queue:
        i, r, left = queue.pop(0)
        while not bucket.take(tokens(r)):
            wait()
        try:
            yield i, call(r), None
        except Exception as e:  # noqa: BLE001
            if left > 1:
                queue.append((i, r, left - 1))
            else:
                yield i, None, str(e)


def bounded_contexts(results: DataFrame, by: str, most: int = 8, chars: int = 4000) -> DataFrame:
    """(by, contexts): the distinct texts of a question's first results, cut to a length, as judges of answers read them."""
    from .retrieval import ranked

    one = results.where(F.trim("text") != "").withColumn("said", F.substring(F.trim("text"), 1, chars)).groupBy(by, "said").agg(F.min("rank").alias("rank"))
    few = ranked(one, [by], F.col("rank"), F.col("said"), top=most, name="place")
    return few.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "said"))), lambda x: x["said"]).alias("contexts"))


def judged(cases: DataFrame, contexts: DataFrame, judge: Callable[[list[str]], list[float]], cached: DataFrame | None = None, by: str = "question_id") -> DataFrame:
    """(by, judge_score): scores of an injected judge of "question, answer, contexts"; cases scored before keep their score."""
    rows = cases.join(contexts, by, "left")
    if cached is not None:
        rows = rows.join(cached.select(by), by, "left_anti")
    asked = rows.select(by, F.concat_ws("\n\n", "question", "answer", F.array_join("contexts", "\n---\n")).alias("asked"))
    out = call_in_batches(asked, judge, "asked", "judge_score", "double").select(by, "judge_score")
    return out.unionByName(cached.select(by, "judge_score")) if cached is not None else out
