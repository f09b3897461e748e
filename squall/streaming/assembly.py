"""Volumes put together as their chunks come.

A volume is given once all of its chunks up to the End chunk are there, or, with what came, when the
watermark passes its last chunk's time by a wait.  Its chunks are held by sequence in Spark's
state store and appended when it is given; nothing of it is kept after that.

Defined results: the order of chunks doesn't matter; of a chunk that came twice the least bytes
count; a volume without its start chunk is never given; what comes after a volume was given waits by
itself and, without a start chunk, goes; rows with a null in their key, sequence or time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from squall.shipping import ship
from squall.streaming.site_state import _PROVIDER

ASSEMBLED = "volume_id string, content binary, n_chunks long, missing array<int>, complete boolean"
_STATE = "last int, final int, latest_ms long"  # greatest sequence, that of the End chunk, newest time


class Assembler(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", _STATE)
        self.parts = handle.getMapState("parts", "sequence int", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        last, final, latest = tuple(self.known.get()) if self.known.exists() else (0, None, None)
        before = latest
        for r in pd.concat(list(rows)).itertuples():
            k, data = (int(r.sequence),), bytes(r.data)
            if not self.parts.containsKey(k) or data < bytes(self.parts.getValue(k)[0]):
                self.parts.updateValue(k, (data,))
            last = max(last, k[0])
            final = max(final or 0, k[0]) if r.chunk_type == "End" else final
            latest = max(latest or 0, int(r.time_ms))
        if final is not None and all(self.parts.containsKey((k,)) for k in range(1, final + 1)):
            yield from self._given(key, last, final, before)
            return
        self.known.update((last, final, latest))
        if before != latest:
            if before is not None:
                self.handle.deleteTimer(before + self.wait_ms)
            self.handle.registerTimer(latest + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if self.known.exists():
            last, final, latest = tuple(self.known.get())
            if latest + self.wait_ms <= expiredTimerInfo.getExpiryTimeInMs():
                yield from self._given(key, last, final, None)

    def _given(self, key, last: int, final: int | None, timer_of: int | None) -> Iterator:
        import pandas as pd

        have = {k: bytes(self.parts.getValue((k,))[0]) for k in range(1, last + 1) if self.parts.containsKey((k,))}
        if timer_of is not None:
            self.handle.deleteTimer(timer_of + self.wait_ms)
        self.known.clear()
        self.parts.clear()
        if 1 in have:
            missing = [k for k in range(1, last + 1) if k not in have]
            row = ("-".join(str(x) for x in key), b"".join(have[k] for k in sorted(have)), len(have), missing, not missing and final == last)
            yield pd.DataFrame([row], columns=[x.split()[0] for x in ASSEMBLED.split(", ")])

    def close(self) -> None:
        pass


def assemble_stream(chunks: DataFrame, delay: str, wait_ms: int, by: tuple[str, ...] = ("site", "volume")) -> DataFrame:
    """A stream of chunks(by..., sequence, chunk_type, time_ms, data) as ASSEMBLED, the rows of ``chunk_stream.assemble``; volume_id joins the key by dashes."""
    spark = ship(chunks.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    needed = [F.col(c).isNotNull() for c in (*by, "sequence", "time_ms", "data")]
    for condition in needed:
        chunks = chunks.where(condition)
    timed = chunks.select(*by, "sequence", "chunk_type", "time_ms", "data", F.timestamp_millis("time_ms").alias("chunk_time")).withWatermark("chunk_time", delay)
    return timed.groupBy(*by).transformWithStateInPandas(Assembler(wait_ms), ASSEMBLED, "append", "EventTime")
