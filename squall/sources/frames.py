"""Messages from frames as relations, and the cutters as table functions of SQL.

``frame_rows`` cuts records into frames; ``reassemble`` joins segments with windows, so that the
frames of a record needn't be in one call, nor in one task's memory.

Defined results: a run begins at a frame that is its message's only segment or its first; frames before
the first run, and those behind a run's number of segments, belong to no message; a run that a new
start cuts short is no message.  Radials and other messages of variable length stand alone and
cut no run.  Frames of equal number in a record are taken in no defined order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squall.functions import wire
from squall.shipping import ship
from squall.sources import archive, columnar
from squall.sources import layouts as L

_HEADER = "message_type int, channel int, sequence int, mjd int, ms long, segment_count int, segment_number int"
FRAMES = f"volume_id string, record_idx int, frame_idx int, alone boolean, {_HEADER}, payload binary"


def cut_frames(data: bytes, segment_payload: str = "reference") -> Iterator[tuple]:
    """(alone, header, payload) of each frame of an opened record, up to the first that runs over its end."""
    at = 0
    while len(data) - at >= L.HEADER_BYTES:
        header = L.read(L.MESSAGE_HEADER, data, at)
        begin = at + L.HEADER_BYTES
        if header["message_type"] == 31 or header["segment_size"] >= wire.VARIABLE_LENGTH:
            # what stands alone is measured by the message walk: the first message from here on
            one = next(iter(archive.frame_messages(data[at:], segment_payload)), None)
            if one is None:
                return
            yield True, one[0], b"".join(one[3])
            at += one[1] + one[2]
            continue
        n, step = archive.frame_size(header, segment_payload)
        if begin + n > len(data):
            return
        yield False, header, data[begin : begin + n]
        at = min(at + step, len(data))


def frame_rows(records: DataFrame, segment_payload: str = "reference") -> DataFrame:
    """One row per frame of each record (FRAMES)."""

    def work(row):
        data = archive.open_record(row["data"]) if row["compressed"] else row["data"]
        for k, (alone, h, payload) in enumerate(cut_frames(data, segment_payload)):
            own = {c: h[c] for c in ("message_type", "channel", "sequence", "mjd", "ms", "segment_count", "segment_number")}
            yield {"volume_id": row["volume_id"], "record_idx": row["record_idx"], "frame_idx": k, "alone": alone, **own, "payload": payload}

    return archive._rows(records, work, FRAMES)


#: Frames of a partition, about, where their number is known.
PART_FRAMES = 500_000


def reassemble(frames: DataFrame, n: int | None = None) -> DataFrame:
    """Frames (FRAMES) as messages: the columns of the archive's MESSAGES but for places and errors, payloads in order.

    n: how many frames there are, about, where that is known; partitions follow it.
    """
    record = ["volume_id", "record_idx"]
    if n is not None:
        frames = frames.repartition(max(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_FRAMES)), *record)
    along = Window.partitionBy(*record, "alone").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = (F.col("segment_count") <= 1) | (F.col("segment_number") == 1)
    runs = frames.withColumn("_start", start).withColumn("_run", F.when(F.col("alone"), F.col("frame_idx")).otherwise(F.sum(F.col("_start").cast("int")).over(along)))
    # a run's frames follow each other, so its start's row and number of segments are the last ones seen
    runs = runs.withColumn("_row", F.row_number().over(along))
    since = F.last(F.when(F.col("_start"), F.col("_row")), ignorenulls=True).over(along)
    need = F.last(F.when(F.col("_start"), F.greatest(F.lit(1), F.col("segment_count"))), ignorenulls=True).over(along)
    runs = runs.withColumns({"_since": since, "_need": need}).where(F.col("alone") | (F.col("_run") > 0))
    place, need = (F.when(F.col("alone"), 1).otherwise(x) for x in (F.col("_row") - F.col("_since") + 1, F.col("_need")))
    held = runs.withColumn("_need", need).where(place <= F.col("_need"))
    names = ("message_type", "channel", "sequence", "mjd", "ms")
    first = F.min_by(F.struct(*names), "frame_idx").alias("h")
    parts = F.array_sort(F.collect_list(F.struct("frame_idx", "payload")))
    whole = held.groupBy(*record, "alone", "_run").agg(first, F.max("frame_idx").alias("_last"), F.count(F.lit(1)).cast("int").alias("n_segments"), F.max("_need").alias("_need"), parts.alias("parts"))
    whole = whole.where(F.col("n_segments") == F.col("_need"))
    number = (F.row_number().over(Window.partitionBy(*record).orderBy("_last")) - 1).alias("message_idx")
    return whole.select(*record, number, *[F.col(f"h.{n}").alias(n) for n in names], "n_segments", F.transform("parts", lambda p: p["payload"]).alias("payloads"))


# ---- reading across segments ----------------------------------------------------

MAP_SEGMENTS = "volume_id string, record_idx int, message_idx int, n_segments int, number int, bits binary"


def _map_segments(payloads: list[bytes]) -> Iterator[tuple]:
    """(n_segments, number, bits) of each whole elevation segment of a bypass map."""
    s = archive.Segments(payloads)
    try:
        n = s.read(L.MAP_HEADER)["n_segments"]
        for _ in range(n):
            number = struct.unpack(">H", s.take_across(2))[0]
            yield n, number, s.take_across(L.BYPASS_RADIALS * L.BYPASS_WORDS * 2)
    except struct.error:
        return


def bypass_segments(messages: DataFrame) -> DataFrame:
    """Elevation segments of bypass maps (type 13), read across the ends of the messages' segments; a map that ends too soon gives those that are whole."""
    kinds = archive._arrow_schema(MAP_SEGMENTS)

    def run(batches):
        for batch in batches:
            rows = [(*place, *one) for *place, payloads in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True) for one in _map_segments(payloads)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    ship(messages.sparkSession)
    return messages.where("message_type = 13").select("volume_id", "record_idx", "message_idx", "payloads").mapInArrow(run, MAP_SEGMENTS)


def record_bypass_segments(records: DataFrame, mode: str = "FAILFAST", segment_payload: str = "reference", writer=None) -> DataFrame:
    """``bypass_segments`` of ``decode_records`` in one pass over the bytes: of records that are frames throughout, each byte of a map is copied once, from its frame to where it goes.

    writer: what makes RECORDS of the rows' Arrow batches (``archive.record_writer``), in the same worker, where records are not RECORDS yet.
    """
    kinds = archive._arrow_schema(MAP_SEGMENTS)

    def one_by_one(part, row, data):
        place = {n: part.column(n)[row].as_py() for n in ("volume_id", "record_idx")}
        for k, (h, _, _, payloads) in enumerate(archive.frame_messages(data.tobytes(), segment_payload)):
            if h["message_type"] == 13:
                for one in _map_segments(payloads):
                    yield place | dict(zip(kinds.names[2:], (k, *one), strict=True))

    def run(batches):
        for part, data, start, end, error in archive._opened(writer(batches) if writer else batches, mode):
            if error:
                continue
            rec, idx, header, count, at, size, slow = columnar.segmented(data, start, end, segment_payload)
            # a header that doesn't lie in its message's first segment is read one by one
            late = (header["message_type"] == 13) & (size[np.cumsum(count) - count] < L.size(L.MAP_HEADER))
            slow = np.union1d(slow, rec[late])
            maps = (header["message_type"] == 13) & ~np.isin(rec, slow)
            rec, idx, count, own = rec[maps], idx[maps], count[maps], np.repeat(maps, count)
            of, number, bits, n = columnar.bypass_maps(data, count, at[own], size[own])
            i4 = lambda x: pa.array(x.astype(np.int32))
            volume_id, record_idx = (part.column(c).take(pa.array(rec[of])) for c in ("volume_id", "record_idx"))
            yield pa.RecordBatch.from_arrays([volume_id, record_idx, i4(idx[of]), i4(n[of]), i4(number), bits], schema=kinds)
            yield from archive._gathered((one for row in slow.tolist() for one in one_by_one(part, row, data[start[row] : end[row]])), kinds)

    archive._ready(records.sparkSession)
    return records.mapInArrow(run, MAP_SEGMENTS)


# ---- table functions -------------------------------------------------------------


class Records:
    """squall_records(content): the records of a volume file; an error for one that can't be cut."""

    def eval(self, content: bytes):
        if content is None:
            return
        data = archive.gunzip(bytes(content))
        if len(data) < L.size(L.VOLUME_HEADER):
            raise archive.RecordError("shorter than a volume header")
        for k, (at, record) in enumerate(archive.split_records(data[L.size(L.VOLUME_HEADER) :])):
            yield k, at, len(record), archive.is_compressed(record), record


class Messages:
    """squall_messages(data): the messages of a record, compressed or not."""

    def eval(self, data: bytes):
        if data is None:
            return
        data = bytes(data)
        opened = archive.open_record(data) if archive.is_compressed(data) else data
        for k, (h, at, n, payloads) in enumerate(archive.frame_messages(opened)):
            yield k, at, n, h["message_type"], h["channel"], h["sequence"], h["mjd"], h["ms"], len(payloads), b"".join(payloads)


def register(spark: SparkSession) -> None:
    """Makes squall_records and squall_messages callable from SQL, with LATERAL."""
    ship(spark)
    records = F.udtf(Records, returnType="record_idx int, offset long, size long, compressed boolean, data binary", useArrow=True)
    messages = F.udtf(Messages, returnType="message_idx int, offset long, size long, message_type int, channel int, sequence int, mjd int, ms long, n_segments int, payload binary", useArrow=True)
    spark.udtf.register("squall_records", records)
    spark.udtf.register("squall_messages", messages)
