"""What is known of each site while its chunks come: place, intervals per kind, and when the next chunk is due.

State in Spark's state store, typed: a value (volume, sequence, time, due time) and a map of the last
ten intervals by kind of chunk.  With a watermark on the chunks a timer tells of a site whose next
chunk hasn't come when the watermark passes the time it was due: one row "overdue", whether the
chunk comes later or never.

Defined results: rows of a batch are taken in order of time, volume and sequence, as those of one
site; a chunk of before the site's time is told of as late and changes nothing; rows without a site
or a time are left out; a volume's last chunk is followed by the next volume's like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from squall.functions import timing
from squall.shipping import ship

EVENTS = (
    "site string, event string, volume int, sequence int, chunk_type string, time_ms long, interval_ms long, average_ms long, n_samples int, gap boolean, "
    "volume_done boolean, late boolean, expected_ms long"
)
PLACE = "volume int, sequence int, chunk_type string, time_ms long, expected_ms long"
_COLUMNS = [x.split()[0] for x in EVENTS.split(", ")]
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def follow(place: tuple | None, samples: dict[str, list[int]], chunk: tuple) -> tuple[list[tuple], tuple | None]:
    """One chunk (volume, sequence, chunk_type, time_ms): the rows that it gives, without the site, and the place after it.

    samples: intervals by kind, of which the chunk's own are brought up to date.
    """
    volume, sequence, kind, time_ms = chunk
    if place is not None and time_ms < place[3]:
        return [("chunk", volume, sequence, kind, time_ms, None, None, 0, False, kind == "End", True, None)], place
    out, interval, gap = [], None, False
    if place is not None:
        if place[4] is not None and time_ms > place[4]:
            out.append(overdue(place))
        interval, gap = time_ms - place[3], place[0] == volume and sequence != place[1] + 1
        samples[kind] = (samples.get(kind, []) + [interval])[-timing.WINDOW :]
    own = samples.get(kind, [])
    expected = time_ms + timing.next_wait_ms(kind, own)
    out.append(("chunk", volume, sequence, kind, time_ms, interval, sum(own) // len(own) if own else None, len(own), gap, kind == "End", False, expected))
    return out, (volume, sequence, kind, time_ms, expected)


def overdue(place: tuple) -> tuple:
    volume, sequence, kind, time_ms, expected = place
    return ("overdue", volume, sequence, kind, time_ms, None, None, 0, False, kind == "End", False, expected)


class SiteTracker(StatefulProcessor):
    def __init__(self, timed: bool):
        self.timed = timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", PLACE)
        self.intervals = handle.getMapState("intervals", "chunk_type string", "ms array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        place = tuple(self.place.get()) if self.place.exists() else None
        due = place[4] if place else None
        samples: dict[str, list[int]] = {}
        out: list[tuple] = []
        for r in pd.concat(list(rows)).sort_values(["time_ms", "volume", "sequence"]).itertuples():
            kind = r.chunk_type
            if kind not in samples:
                samples[kind] = list(self.intervals.getValue((kind,))[0]) if self.intervals.containsKey((kind,)) else []
            made, place = follow(place, samples, (int(r.volume), int(r.sequence), kind, int(r.time_ms)))
            out += made if self.timed else [x for x in made if x[0] == "chunk"]
        self.place.update(place)
        for kind, ms in samples.items():
            self.intervals.updateValue((kind,), (ms,))
        if self.timed and place[4] != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if place[4] is not None:
                self.handle.registerTimer(place[4])
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        place = tuple(self.place.get()) if self.place.exists() else None
        if place and place[4] is not None and place[4] <= expiredTimerInfo.getExpiryTimeInMs():
            self.place.update((*place[:4], None))
            yield _frame(key[0], [overdue(place)])

    def close(self) -> None:
        pass


def _frame(site: str, rows: list[tuple]):
    import pandas as pd

    made = pd.DataFrame([(site, *r) for r in rows], columns=_COLUMNS)
    return made.astype({"interval_ms": "Int64", "average_ms": "Int64", "expected_ms": "Int64"})


def track(chunks: DataFrame, delay: str | None = None) -> DataFrame:
    """chunks(site, volume, sequence, chunk_type, time_ms) as EVENTS: one row a chunk, and with a delay (as of a watermark) one for each that is overdue."""
    spark = ship(chunks.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    chunks = chunks.where(F.col("site").isNotNull() & F.col("time_ms").isNotNull()).select("site", "volume", "sequence", "chunk_type", "time_ms")
    if delay is not None:
        chunks = chunks.withColumn("chunk_time", F.timestamp_millis("time_ms")).withWatermark("chunk_time", delay)
    return chunks.groupBy("site").transformWithStateInPandas(SiteTracker(delay is not None), EVENTS, "append", "none" if delay is None else "EventTime")
