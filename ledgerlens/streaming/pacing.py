"""Quotas per key, kept across all tasks: at most so many requests of a key in a window, the rest in later ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "key string, id long, asked timestamp, granted timestamp, waited long"


def paced(requests: DataFrame, quota: int, seconds: int) -> DataFrame:
    """(key, id, asked, granted, waited): when each request of a table may go, first come first served.

    requests: key, id, asked. Time is cut into windows of `seconds`; a key gets `quota` requests a window. A request goes
    in its own window or, if that is full, in the first later one with room: granted is asked or that window's begin,
    waited the windows it was put off. Times without a zone are taken in the session's. Of every `quota`-th request of a key in turn, each goes at least a window later, so
    the window of the i-th is a running maximum: one sort per key, no loop.
    """
    kind = requests.schema["asked"].dataType.simpleString()
    slot = F.floor(F.unix_micros(F.col("asked").cast("timestamp")) / (seconds * 1_000_000))
    order = Window.partitionBy("key").orderBy("asked", "id")
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), "asked").withColumn("slot", slot).withColumn("at", F.row_number().over(order) - 1)
    rows = rows.withColumn("lane", F.col("at") % quota).withColumn("turn", F.floor(F.col("at") / quota))
    lane = Window.partitionBy("key", "lane").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("goes", F.max(F.col("slot") - F.col("turn")).over(lane) + F.col("turn"))
    granted = F.when(F.col("goes") > F.col("slot"), F.timestamp_micros(F.col("goes") * (seconds * 1_000_000)).cast(kind)).otherwise(F.col("asked"))
    return rows.select("key", "id", "asked", granted.alias("granted"), (F.col("goes") - F.col("slot")).alias("waited"))


def paced_stream(requests: DataFrame, quota: int, seconds: int, late: str = "0 seconds") -> DataFrame:
    """The same for a stream, by keyed state with timers: one budget per key, wherever its requests arrive.

    requests: key, id, asked, as a stream; `late` is its watermark. State holds, per key, the window that is being filled,
    what went in it, and the requests that wait. A request with room goes at once. The others wait in state; a timer at the
    begin of the next window lets `quota` of them go and sets the next one, so a key without waiting requests has no
    timer. Requests of one batch go in order of time; one that comes later than others of its key queues behind them.
    Needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    micros = seconds * 1_000_000

    def row(key, request, goes):
        asked = request[1]
        slot = asked // micros
        granted = asked if goes <= slot else goes * micros
        return (key, request[0], pd.Timestamp(asked, unit="us"), pd.Timestamp(granted, unit="us"), max(0, goes - slot))

    def frame(rows):
        return pd.DataFrame(rows, columns=["key", "id", "asked", "granted", "waited"])

    class Pacer(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.now = handle.getValueState("now", "slot long, used int")
            self.waiting = handle.getListState("waiting", "id long, asked long")

        def _go(self, key, queue, slot, used, upto):
            """Requests that go by window `upto`; what is left, and the window and count reached."""
            out = []
            while queue:
                own = queue[0][1] // micros
                at, had = max(own, slot), used if own <= slot else 0
                if had >= quota:
                    at, had = at + 1, 0
                if at > max(upto, own):
                    break
                slot, used = at, had + 1
                out.append(row(key, queue.pop(0), at))
            return out, slot, used

        def _run(self, key, new, upto):
            slot, used = self.now.get() if self.now.exists() else (-1, 0)
            held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
            queue = held + sorted(new, key=lambda r: (r[1], r[0]))
            out, slot, used = self._go(key, queue, slot, used, upto)
            self.now.update((slot, used))
            if queue:
                self.waiting.put(queue)
                self.handle.registerTimer((slot + 1) * seconds * 1000)
            else:
                self.waiting.clear()
            return frame(out)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            new = []
            for part in rows:
                new += list(zip(part["id"].tolist(), (part["asked"].astype("datetime64[us]").astype("int64")).tolist()))
            yield self._run(key[0], new, timerValues.getCurrentWatermarkInMs() // (seconds * 1000))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            yield self._run(key[0], [], timerValues.getCurrentWatermarkInMs() // (seconds * 1000))

        def close(self) -> None:
            pass

    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("asked").cast("timestamp").alias("asked")).withWatermark("asked", late)
    return rows.groupBy("key").transformWithStateInPandas(Pacer(), SCHEMA, outputMode="Append", timeMode="EventTime")
