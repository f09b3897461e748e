"""Archive volumes: files to records to messages to radials, each step a table.

Bytes are opened in Arrow batches.  Every row keeps where it came from (volume,
record, message), as order has a meaning.  mode "FAILFAST" raises on a broken
record; "PERMISSIVE" keeps what can be read and names the error in ``_corrupt``.
Bad messages inside a good record are passed over in either mode.
"""

from __future__ import annotations

import bz2
import functools
import gzip
import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.functions import wire
from squall.shipping import ship
from squall.sources import columnar
from squall.sources import layouts as L


class RecordError(ValueError):
    """A record that cannot be cut out or opened."""


# ---- bytes ---------------------------------------------------------------------


def gunzip(data: bytes) -> bytes:
    """Opened if it is gzip, else as it is."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def split_records(body: bytes) -> list[tuple[int, bytes]]:
    """(offset, record with its size prefix); data that begins with four zero bytes is one record."""
    if len(body) >= 4 and body[:4] == b"\0\0\0\0":
        return [(0, body)]
    out, at = [], 0
    while at < len(body):
        if at + 4 > len(body):
            raise RecordError(f"truncated record: expected {at + 4}, actual {len(body)}")
        n = abs(struct.unpack_from(">i", body, at)[0])
        if n == 0:
            raise RecordError(f"invalid record size 0 at {at}")
        if at + 4 + n > len(body):
            raise RecordError(f"truncated record: expected {at + 4 + n}, actual {len(body)}")
        out.append((at, body[at : at + 4 + n]))
        at += 4 + n
    return out


def is_compressed(record: bytes) -> bool:
    return record[4:6] == b"BZ"


def open_record(record: bytes) -> bytes:
    if not is_compressed(record):
        raise RecordError("record is not compressed")
    try:
        return bz2.BZ2Decompressor().decompress(record[4:])
    except OSError as e:
        raise RecordError(f"bad bzip2 data: {e}") from e


def coverage_pattern(data: bytes) -> dict | None:
    """The first coverage pattern (type 5) of a start chunk or a volume; None without one."""
    for _, record in split_records(gunzip(data)[L.size(L.VOLUME_HEADER) :]):
        for header, _, _, payloads in frame_messages(open_record(record) if is_compressed(record) else record):
            if header["message_type"] == 5:
                return decode_body(5, payloads)
    return None


def chunk_kind(data: bytes) -> str:
    """Start (a volume's head) or record, of a real-time chunk."""
    if data[:3] == b"AR2":
        return "Start"
    if is_compressed(data):
        return "IntermediateOrEnd"
    raise RecordError("unrecognised chunk format")


class Segments:
    """A message's payload, in segments; a read that would straddle two goes on in the next."""

    def __init__(self, payloads: list[bytes]):
        self.payloads, self.at, self.place = payloads, 0, 0

    def take(self, n: int) -> bytes:
        while self.at < len(self.payloads) and len(self.payloads[self.at]) - self.place < n:
            self.at, self.place = self.at + 1, 0
        if self.at >= len(self.payloads):
            raise struct.error("segments ran out")
        out = self.payloads[self.at][self.place : self.place + n]
        self.place += n
        return out

    def take_across(self, n: int) -> bytes:
        """Bytes across segment ends."""
        out = b""
        while len(out) < n:
            if self.at >= len(self.payloads):
                raise struct.error("segments ran out")
            part = self.payloads[self.at][self.place : self.place + n - len(out)]
            out += part
            self.place += len(part)
            if self.place >= len(self.payloads[self.at]):
                self.at, self.place = self.at + 1, 0
        return out

    def read(self, layout) -> dict:
        return L.read(layout, self.take(L.size(layout)))


def frame_messages(data: bytes, segment_payload: str = "reference"):
    """Yields (header, offset, size, payloads) of each message."""
    for header, at, size, payloads, _ in walk_messages(data, segment_payload):
        yield header, at, size, payloads() if callable(payloads) else payloads


def walk_messages(data: bytes, segment_payload: str = "reference"):
    """Yields (header, offset, size, payloads, blocks) of each message; of a radial, payloads is a function and blocks its header and blocks.

    Radials (type 31) and messages at the variable-length mark stand alone; all
    others come in frames of 2432 bytes, in one or more segments.  Segments
    without a first one are passed over; a new first one discards what is open.
    segment_payload "icd" counts the twelve bytes before the header in.
    """
    at, open_headers, open_payloads, first, expected = 0, [], [], 0, 0
    while len(data) - at >= L.HEADER_BYTES:
        header = L.read(L.MESSAGE_HEADER, data, at)
        if header["segment_size"] >= wire.VARIABLE_LENGTH:
            total = header["segment_count"] << 16 | header["segment_number"]
        else:
            total = header["segment_size"] * 2
        if header["segment_size"] >= wire.VARIABLE_LENGTH or header["message_type"] == 31:
            blocks = None
            if header["message_type"] == 31:
                try:
                    *blocks, end = _radial_blocks(data, at + L.HEADER_BYTES)
                except struct.error:
                    return
                except ValueError:  # a bad message: on to where its size says
                    if total <= 0 or at + total > len(data):
                        return
                    at += total
                    continue
            else:
                end = at + L.HEADER_BYTES + max(0, total - L.HEADER_BYTES)
                if end > len(data):
                    return
            begin = at + L.HEADER_BYTES
            yield header, at, end - at, lambda a=begin, z=end: [data[a:z]], blocks
            at = end
            continue
        count, number = header["segment_count"], header["segment_number"]
        begin = at + L.HEADER_BYTES
        n, step = frame_size(header, segment_payload)
        if begin + n > len(data):
            return
        payload, here = data[begin : begin + n], at
        at = min(at + step, len(data))
        if count > 1 and number != 1:
            if not open_headers:
                continue
        else:
            open_headers, open_payloads, first, expected = [], [], here, count
        open_headers.append(header)
        open_payloads.append(payload)
        if len(open_headers) >= expected:
            yield open_headers[0], first, at - first, open_payloads, None
            open_headers, open_payloads = [], []


def frame_size(header: dict, segment_payload: str = "reference") -> tuple[int, int]:
    """Bytes of a frame's payload, and from its begin to the next frame's."""
    if header["segment_count"] <= 1:
        return L.FRAME_BYTES - L.HEADER_BYTES, L.FRAME_BYTES
    n = max(0, header["segment_size"] * 2 - (L.HEADER_BYTES if segment_payload == "reference" else 16))
    return n, max(L.FRAME_BYTES, L.HEADER_BYTES + n)


def _radial_blocks(data: bytes, start: int):
    """(name, offset of the block's content) by ascending pointers, and the end."""
    header = L.read(L.RADIAL_HEADER, data, start)
    at = start + L.size(L.RADIAL_HEADER)
    pointers = struct.unpack_from(f">{header['data_block_count']}I", data, at)
    at += 4 * len(pointers)
    blocks = []
    for p in pointers:
        if at - start > p:
            raise ValueError("block pointer goes backwards")
        at = start + p
        name = struct.unpack_from(">1s3s", data, at)[1]
        at += 4
        blocks.append((name, at))
        if name == b"VOL":
            at += L.size(L.VOLUME_BLOCK) + (0 if struct.unpack_from(">H", data, at)[0] <= 44 else L.size(L.VOLUME_BLOCK_MORE))
        elif name == b"ELV":
            at += L.size(L.ELEVATION_BLOCK)
        elif name == b"RAD":
            at += L.size(L.RADIAL_BLOCK) + (0 if struct.unpack_from(">H", data, at)[0] <= 20 else L.size(L.RADIAL_BLOCK_MORE))
        elif name in L.MOMENTS:
            moment = L.read(L.MOMENT_BLOCK, data, at)
            at += L.size(L.MOMENT_BLOCK) + moment["gate_count"] * moment["word_size"] // 8
        if at > len(data):
            raise struct.error("block runs over the end")
    return header, blocks, at


def gate_codes(raw: bytes, word_size: int) -> np.ndarray:
    """Raw gate numbers: bytes, or big-endian halfwords (an odd byte is dropped)."""
    if word_size == 16:
        return np.frombuffer(raw, dtype=">u2", count=len(raw) // 2)
    return np.frombuffer(raw, dtype=np.uint8)


def decode_radial(payload: bytes, parsed=None) -> dict:
    """Type 31: header, site and radial blocks, moments by name; parsed: header and blocks, where they are known."""
    header, blocks = parsed or _radial_blocks(payload, 0)[:2]
    out = {"header": header, "moments": {}}
    for name, at in blocks:
        if name == b"VOL":
            out["volume"] = L.read(L.VOLUME_BLOCK, payload, at)
            if out["volume"]["lrtup"] > 44:
                out["volume"] |= L.read(L.VOLUME_BLOCK_MORE, payload, at + L.size(L.VOLUME_BLOCK))
        elif name == b"ELV":
            out["elevation"] = L.read(L.ELEVATION_BLOCK, payload, at)
        elif name == b"RAD":
            out["radial"] = L.read(L.RADIAL_BLOCK, payload, at)
            if out["radial"]["lrtup"] > 20:
                out["radial"] |= L.read(L.RADIAL_BLOCK_MORE, payload, at + L.size(L.RADIAL_BLOCK))
        elif name in L.MOMENTS:
            m = L.read(L.MOMENT_BLOCK, payload, at)
            begin = at + L.size(L.MOMENT_BLOCK)
            out["moments"][L.MOMENTS[name]] = _moment(m, payload[begin : begin + m["gate_count"] * m["word_size"] // 8])
    return out


def _moment(m: dict, raw: bytes) -> dict:
    return {
        "gate_count": m["gate_count"], "first_gate_km": m["first_gate_m"] * 0.001, "gate_interval_km": m["gate_interval_m"] * 0.001, "word_size": m["word_size"],
        "scale": float(m["scale"]), "offset": float(m["offset"]), "raw": gate_codes(raw, m["word_size"]),
    }


def decode_legacy_radial(payloads: list[bytes]) -> dict:
    """Type 1: angles in 1/32768 half turns, three moments of fixed scale."""
    data = b"".join(payloads)
    h = L.read(L.LEGACY_RADIAL, data)
    base, moments = L.size(L.LEGACY_RADIAL), {}
    doppler_scale = 1.0 if _legacy_resolution(h["doppler_resolution"]) > 0.9 else 2.0
    for name, pointer, gates, first, step, scale, offset in (
        ("REF", h["ref_pointer"], h["surveillance_gates"], h["surveillance_first"], h["surveillance_interval"], 2.0, 66.0),
        ("VEL", h["vel_pointer"], h["doppler_gates"], h["doppler_first"], h["doppler_interval"], doppler_scale, 129.0),
        ("SW", h["sw_pointer"], h["doppler_gates"], h["doppler_first"], h["doppler_interval"], 2.0, 129.0),
    ):
        if pointer >= base and gates:
            raw = data[pointer : pointer + gates]
            if len(raw) < gates:
                raise struct.error("gates run over the end")
            moments[name] = _moment({"gate_count": gates, "first_gate_m": abs(first), "gate_interval_m": step, "word_size": 8, "scale": scale, "offset": offset}, raw)
    header = {
        "ms": h["ms"], "mjd": h["mjd"], "azimuth_number": h["azimuth_number"], "azimuth_angle": h["azimuth_angle"] * 180.0 / 32768.0, "azimuth_resolution_spacing": 2,
        "radial_status": h["radial_status"] if h["radial_status"] <= 4 else 1, "elevation_number": h["elevation_number"] % 256, "elevation_angle": h["elevation_angle"] * 180.0 / 32768.0,
    }
    return {"header": header, "moments": moments, "vcp": h["vcp"]}


def _legacy_resolution(code: int) -> float:
    return {2: 0.5, 4: 1.0}.get(code, 0.0)


@functools.cache
def _adaptation_layout() -> tuple[struct.Struct, tuple]:
    """The whole document as one layout: its codes, and (field, places of its values, whether it is a list)."""
    fields = [(name, kind, (at,), False) for name, kind, at in L.ADAPTATION_FIELDS] + [(name, kind, offsets, True) for name, kind, offsets in L.ADAPTATION_LISTS]
    codes, place, at = ">", {}, 0
    for k, (begin, kind) in enumerate(sorted((at, kind) for _, kind, offsets, _ in fields for at in offsets)):
        codes += f"{begin - at}x{kind}"
        place[begin], at = k, begin + struct.calcsize(">" + kind)
    return struct.Struct(codes), tuple((name, tuple(place[x] for x in offsets), many) for name, _, offsets, many in fields)


def _adaptation(data: bytes) -> dict:
    """Type 18: all fields; of a document that ends too soon those that are whole."""
    out = {k: L.text(v) for k, v in L.read(L.ADAPTATION_HEADER, data).items()}
    codes, fields = _adaptation_layout()
    if len(data) >= codes.size:
        values = [L.text(v) if isinstance(v, bytes) else v for v in codes.unpack_from(data)]
        out |= {name: [values[k] for k in places] if many else values[places[0]] for name, places, many in fields}
    else:
        for name, kind, at in L.ADAPTATION_FIELDS:
            if at + struct.calcsize(">" + kind) <= len(data):
                v = struct.unpack_from(">" + kind, data, at)[0]
                out[name] = L.text(v) if isinstance(v, bytes) else v
        for name, kind, offsets in L.ADAPTATION_LISTS:
            out[name] = [struct.unpack_from(">" + kind, data, at)[0] for at in offsets if at + struct.calcsize(">" + kind) <= len(data)]
    if "slondir" in out:
        out["site_latitude"] = L.sexagesimal(out["slatdeg"], out["slatmin"], out["slatsec"], out["slatdir"], "S")
        out["site_longitude"] = L.sexagesimal(out["slondeg"], out["slonmin"], out["slonsec"], out["slondir"], "W")
    return out


def decode_body(message_type: int, payloads: list[bytes]) -> dict | None:
    """Fields of a message other than a radial; None for types that are passed on undecoded."""
    s = Segments(payloads)
    if message_type == 2:
        out = s.read(L.STATUS)
        out["alarms"] = [out.pop(f"alarm_{k}") for k in range(1, 15)]
        return out
    if message_type == 3:
        raw = s.take(960)
        return {"halfwords": list(struct.unpack(">480H", raw))}
    if message_type in (4, 10):
        n = struct.unpack(">H", s.take(2))[0]
        raw = s.take(min(n, len(payloads[0]) - 2))
        return {"size": n, "text": raw.decode("utf-8") if _is_utf8(raw) else None}
    if message_type in (5, 7):
        out = s.read(L.PATTERN_HEADER)
        if message_type == 7:
            return None
        out["cuts"] = [s.read(L.PATTERN_CUT) for _ in range(out["n_cuts"])]
        return out
    if message_type == 6:
        return s.read(L.CONTROL_COMMANDS)
    if message_type == 8:
        n = struct.unpack(">H", s.take(2))[0]
        return {"regions": [s.read(L.CENSOR_REGION) for _ in range(n)]}
    if message_type == 9:
        code = struct.unpack(">H", s.take(2))[0]
        return {"code": code} | {name: bool(code & bit) for name, bit in wire.REQUEST_BITS.items()}
    if message_type in (11, 12):
        n = struct.unpack(">H", s.take(2))[0]
        return {"size": n, "pattern": s.take(min(max(0, n * 2 - 2), len(payloads[0]) - 2)).hex()}
    if message_type == 13:
        out = s.read(L.MAP_HEADER)
        out["segments"] = [
            {"number": struct.unpack(">H", s.take_across(2))[0], "bits": s.take_across(L.BYPASS_RADIALS * L.BYPASS_WORDS * 2).hex()} for _ in range(out["n_segments"])
        ]
        return out
    if message_type == 15:
        out = s.read(L.MAP_HEADER)
        out["segments"] = []
        for k in range(out["n_segments"]):
            azimuths = []
            for _ in range(L.MAP_AZIMUTHS):
                zones = struct.unpack(">H", s.take(2))[0]
                azimuths.append([struct.unpack(">HH", s.take(4)) for _ in range(zones)])
            out["segments"].append({"number": k + 1, "azimuths": azimuths})
        return out
    if message_type == 18:
        return _adaptation(b"".join(payloads))
    if message_type == 32:
        n, _ = struct.unpack(">HH", s.take(4))
        waveforms = []
        for _ in range(n):
            kind, k = struct.unpack(">HH", s.take(4))
            waveforms.append({"waveform": kind, "prfs": list(struct.unpack(f">{k}I", s.take(4 * k)))})
        return {"waveforms": waveforms}
    if message_type == 33:
        out = s.read(L.LOG_HEADER)
        out["identifier"] = L.text(out["identifier"])
        out["payload_hex"] = s.take(min(out["compressed_size"], len(payloads[0]) - L.size(L.LOG_HEADER))).hex()
        return out
    return None


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def bypass_flag(bits_hex: str, radial: int, range_bin: int) -> bool | None:
    """Whether a bin's bypass bit is set: halfword radial * 32 + bin / 16, bit bin % 16; None outside."""
    if not (0 <= radial < L.BYPASS_RADIALS and 0 <= range_bin < L.BYPASS_WORDS * 16):
        return None
    at = (radial * L.BYPASS_WORDS + range_bin // 16) * 4
    return bool(int(bits_hex[at : at + 4], 16) >> (range_bin % 16) & 1)


# ---- tables --------------------------------------------------------------------

RECORDS = "volume_id string, record_idx int, offset long, size long, compressed boolean, data binary, _corrupt string"
MESSAGES = (
    "volume_id string, record_idx int, message_idx int, ordinal long, offset long, size long, message_type int, channel int, sequence int, mjd int, ms long, "
    "n_segments int, payloads array<binary>, _corrupt string"
)
_MOMENT = "struct<gate_count:int,first_gate_km:double,gate_interval_km:double,word_size:int,scale:double,offset:double,raw:array<int>>"
RADIALS = (
    "volume_id string, ordinal long, time_ms long, azimuth_number int, azimuth_deg double, azimuth_spacing_deg double, radial_status int, elevation_number int, "
    "elevation_deg double, latitude double, longitude double, site_height_m double, tower_height_m double, vcp int, "
    "nyquist_ms double, unambiguous_range_km double, atmos_db double, "
    + ", ".join(f"{name} {_MOMENT}" for name in L.MOMENTS.values())
)
HEADER = "volume_id string, tape_filename string, extension string, mjd long, ms long, icao string"


#: Bytes of an Arrow batch that goes to a Python worker, where the session leaves Spark's default: a row is a record or a file.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _ready(spark: SparkSession) -> SparkSession:
    """Executors can import this package, and batches of bytes are small."""
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return ship(spark)


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(volume_id, content) of files: local, or any store that Spark reads."""
    return ship(spark).read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("volume_id"), "content")


#: Bytes and rows, about, of what a Python worker holds as objects at once, coming in or going out.
HELD_BYTES, HELD_ROWS = 8 << 20, 4096


def _plain(batches):
    """The rows of Arrow batches as dicts, made from slices of bounded bytes."""
    for batch in batches:
        names = batch.schema.names
        step = max(1, min(HELD_ROWS, batch.num_rows * HELD_BYTES // max(1, batch.nbytes)))
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            for values in zip(*map(_values, part.columns), strict=True):
                yield dict(zip(names, values, strict=True))


def _values(column: pa.Array) -> list:
    whole = pa.types.is_integer(column.type) and not column.null_count
    return column.to_numpy(zero_copy_only=False).tolist() if whole else column.to_pylist()


def _weight(value) -> int:
    """Bytes of a binary value, or of a list of them."""
    return sum(map(len, value)) if isinstance(value, list) else len(value or b"")


def _rows(df: DataFrame, work, schema: str) -> DataFrame:
    """Each input row to some output rows, as plain dicts."""
    arrow = _arrow_schema(schema)

    def run(batches):
        yield from _gathered((one for row in _plain(batches) for one in work(row)), arrow)

    _ready(df.sparkSession)
    return df.mapInArrow(run, schema)


def _gathered(rows, arrow: pa.Schema):
    """Rows as batches of bounded bytes."""
    heavy = [f.name for f in arrow if pa.types.is_binary(f.type) or pa.types.is_list(f.type) and pa.types.is_binary(f.type.value_type)]
    made, held = [], 0
    for one in rows:
        made.append(one)
        for name in heavy:
            held += _weight(one[name])
        if held >= HELD_BYTES or len(made) >= HELD_ROWS:
            yield pa.RecordBatch.from_pylist(made, schema=arrow)
            made, held = [], 0
    if made:
        yield pa.RecordBatch.from_pylist(made, schema=arrow)


def volume_headers(volumes: DataFrame) -> DataFrame:
    def work(row):
        data = gunzip(row["content"])
        if len(data) >= L.size(L.VOLUME_HEADER):
            h = L.read(L.VOLUME_HEADER, data)
            yield {"volume_id": row["volume_id"], **{k: L.text(v) if isinstance(v, bytes) else v for k, v in h.items()}}

    out = _rows(volumes, work, HEADER)
    return out.withColumn("time", wire.mjd_timestamp(F.col("mjd"), F.col("ms")))


def split_volumes(volumes: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """One row per record: bytes with the size prefix."""

    def work(row):
        try:
            data = gunzip(row["content"])
            if len(data) < L.size(L.VOLUME_HEADER):
                raise RecordError("shorter than a volume header")
            for k, (at, record) in enumerate(split_records(data[L.size(L.VOLUME_HEADER) :])):
                yield {"volume_id": row["volume_id"], "record_idx": k, "offset": at, "size": len(record), "compressed": is_compressed(record), "data": record, "_corrupt": None}
        except (RecordError, OSError, EOFError) as e:
            if mode == "FAILFAST":
                raise
            yield {"volume_id": row["volume_id"], "record_idx": -1, "offset": 0, "size": 0, "compressed": False, "data": None, "_corrupt": str(e)}

    return _rows(volumes, work, RECORDS)


CHUNKS = "volume_id string, sequence int, chunk_type string, data binary"


def cut_chunks(volumes: DataFrame) -> DataFrame:
    """Volumes as the chunks of a feed (CHUNKS): the volume header with the first record is the Start, then come Intermediate ones of a record each; the last one is the End."""

    def work(row):
        data, head = gunzip(row["content"]), L.size(L.VOLUME_HEADER)
        if len(data) < head:
            raise RecordError("shorter than a volume header")
        records = split_records(data[head:])
        for k, (_, record) in enumerate(records):
            kind = "Start" if k == 0 else "End" if k == len(records) - 1 else "Intermediate"
            yield {"volume_id": row["volume_id"], "sequence": k + 1, "chunk_type": kind, "data": data[:head] + record if k == 0 else record}

    return _rows(volumes, work, CHUNKS)


def open_records(records: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Records with their bytes decompressed; those that never were stay as they are."""

    def work(row):
        try:
            data = open_record(row["data"]) if row["compressed"] else row["data"]
        except RecordError as e:
            if mode == "FAILFAST":
                raise
            yield {**row, "data": None, "_corrupt": str(e)}
            return
        yield {**row, "size": len(data), "compressed": False, "data": data}

    return _rows(records, work, RECORDS)


#: Bytes, about, that are walked at once in numpy, and rows that are written at once.
WALKED_BYTES, WALKED_ROWS = 2 << 20, 1024


def _opened(batches, mode: str):
    """(rows, bytes, starts, ends, error) of RECORDS, opened, in parts of bounded bytes; a row with an error comes alone."""
    for batch in batches:
        step = max(1, min(HELD_ROWS, batch.num_rows * WALKED_BYTES // max(1, batch.nbytes)))
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            if not part.column("compressed").true_count and part.column("_corrupt").null_count == part.num_rows:
                yield (part, *columnar.bytes_of(part.column("data")), None)
                continue
            held, begin = [], 0
            for k in range(part.num_rows):
                try:
                    if part.column("_corrupt")[k].as_py():
                        raise RecordError(part.column("_corrupt")[k].as_py())
                    data = part.column("data")[k].as_py() or b""
                    held.append(open_record(data) if part.column("compressed")[k].as_py() else data)
                    error = None
                except RecordError as e:
                    if mode == "FAILFAST":
                        raise
                    error = str(e)
                if held and (error or k == part.num_rows - 1 or sum(map(len, held)) >= WALKED_BYTES):
                    yield (part.slice(begin, len(held)), *_joined(held), None)
                    held, begin = [], begin + len(held)
                if error:
                    yield part.slice(k, 1), *_joined([]), error
                    begin = k + 1


def _joined(pieces: list[bytes]):
    ends = np.cumsum([len(x) for x in pieces], dtype=np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([np.zeros(min(1, len(pieces)), np.int64), ends[:-1]]), ends


def _place(part: pa.RecordBatch, walk: columnar.Walk, chosen=slice(None)) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(volume_id, record_idx, ordinal) of the walk's messages."""
    rec = walk.rec[chosen]
    number = part.column("record_idx").to_numpy(zero_copy_only=False).astype(np.int64)[rec]
    return part.column("volume_id").take(pa.array(rec)), number, number * 1_000_000 + walk.idx[chosen]


def decode_records(records: DataFrame, mode: str = "FAILFAST", segment_payload: str = "reference") -> DataFrame:
    """One row per message of each record."""
    arrow = _arrow_schema(MESSAGES)

    def one_by_one(part, row, data, start, end):
        volume_id, number = part.column("volume_id")[row].as_py(), part.column("record_idx")[row].as_py()
        for k, (h, at, n, payloads) in enumerate(frame_messages(data[start[row] : end[row]].tobytes(), segment_payload)):
            yield {
                "volume_id": volume_id, "record_idx": number, "message_idx": k, "ordinal": number * 1_000_000 + k, "offset": at, "size": n, "message_type": h["message_type"],
                "channel": h["channel"], "sequence": h["sequence"], "mjd": h["mjd"], "ms": h["ms"], "n_segments": len(payloads), "payloads": payloads, "_corrupt": None,
            }

    def run(batches):
        for part, data, start, end, error in _opened(batches, mode):
            if error:
                row = dict.fromkeys(arrow.names) | {"message_idx": -1, "offset": 0, "size": 0, "n_segments": 0, "payloads": [], "_corrupt": error}
                yield pa.RecordBatch.from_pylist([row | {n: part.column(n)[0].as_py() for n in ("volume_id", "record_idx")}], schema=arrow)
                continue
            walk = columnar.Walk(data, start, end)
            if len(walk.rec):
                volume_id, number, ordinal = _place(part, walk)
                h = walk.header
                made = [
                    volume_id, number, walk.idx, ordinal, walk.at - start[walk.rec], walk.size, h["message_type"], h["channel"], h["sequence"], h["mjd"], h["ms"],
                    np.ones(len(number)), walk.payloads(), pa.nulls(len(number)),
                ]
                made = [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x.astype(f.type.to_pandas_dtype())) for x, f in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(made, schema=arrow)
            yield from _gathered((one for row in walk.slow for one in one_by_one(part, row, data, start, end)), arrow)

    _ready(records.sparkSession)
    return records.mapInArrow(run, MESSAGES)


_NUMBERS = (
    "time_ms", "azimuth_number", "azimuth_deg", "azimuth_spacing_deg", "radial_status", "elevation_number", "elevation_deg", "latitude", "longitude", "site_height_m",
    "tower_height_m", "vcp", "nyquist_ms", "unambiguous_range_km", "atmos_db",
)


class RadialRows:
    """Decoded radials, gathered as columns: gates stay numpy arrays until they become one Arrow list column."""

    def __init__(self, schema):
        self.schema = schema
        self.clear()

    def clear(self):
        self.columns = {n: [] for n in ("volume_id", "ordinal", *_NUMBERS)}
        self.moments = {name: [] for name in L.MOMENTS.values()}
        self.gates = 0

    def add(self, volume_id, ordinal, r: dict):
        h, v = r["header"], r.get("volume", {})
        if not h["mjd"]:
            raise RecordError("message without a date")
        row = (
            volume_id, ordinal, (h["mjd"] - 1) * 86_400_000 + h["ms"], h["azimuth_number"], h["azimuth_angle"], h["azimuth_resolution_spacing"] * 0.5, h["radial_status"],
            h["elevation_number"], h["elevation_angle"], v.get("latitude"), v.get("longitude"), _scaled(v.get("site_height"), 1.0), _scaled(v.get("tower_height"), 1.0),
            v.get("vcp", r.get("vcp")), _scaled(r.get("radial", {}).get("nyquist_velocity"), 100.0), _scaled(r.get("radial", {}).get("unambiguous_range"), 1.0),
            _scaled(r.get("elevation", {}).get("atmos"), 1000.0),
        )
        for column, value in zip(self.columns.values(), row, strict=True):
            column.append(value)
        for name, column in self.moments.items():
            m = r["moments"].get(name)
            column.append(m)
            self.gates += len(m["raw"]) if m else 0

    def batch(self):
        arrays = [pa.array(v, self.schema.field(k).type) for k, v in self.columns.items()]
        arrays += [self._moment(name, column) for name, column in self.moments.items()]
        made = pa.RecordBatch.from_arrays(arrays, schema=self.schema)
        self.clear()
        return made

    def _moment(self, name: str, column: list):
        kind = self.schema.field(name).type
        raws = [m["raw"] if m else np.zeros(0, np.uint8) for m in column]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in raws])]).astype(np.int32)
        values = np.concatenate(raws).astype(np.int32) if raws else np.zeros(0, np.int32)
        parts = []
        for field in kind:
            if field.name == "raw":
                parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)).cast(field.type))
            else:
                parts.append(pa.array([m[field.name] if m else None for m in column], field.type))
        return pa.StructArray.from_arrays(parts, fields=list(kind), mask=pa.array([m is None for m in column], pa.bool_()))


def _arrow_schema(ddl: str):
    """On the driver: the Arrow schema that goes to the workers."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


#: Gates of a batch of radials, about: some ten megabytes.
BATCH_GATES = 2_000_000


def radials(messages: DataFrame, types: tuple[int, ...] = (31, 1)) -> DataFrame:
    """Radials of digital (31) and legacy (1) messages; those that cannot be decoded are passed over."""
    _ready(messages.sparkSession)
    schema = _arrow_schema(RADIALS)

    def run(batches):
        for batch in batches:
            step = max(1, min(HELD_ROWS, batch.num_rows * WALKED_BYTES // max(1, batch.nbytes)))
            for first in range(0, batch.num_rows, step):
                volume_ids, ordinals, kinds, payloads = batch.slice(first, step).columns
                digital = kinds.to_numpy(zero_copy_only=False) == 31
                data, start, end = columnar.bytes_of(payloads.values)
                place = payloads.offsets.to_numpy()[:-1][digital]
                yield from _digital(schema, volume_ids.filter(pa.array(digital)), ordinals.filter(pa.array(digital)), data, start[place], end[place])
                rows = RadialRows(schema)
                for k in np.flatnonzero(~digital).tolist():
                    try:
                        r = decode_legacy_radial(payloads[k].as_py())
                    except (struct.error, ValueError):
                        continue
                    rows.add(volume_ids[k].as_py(), ordinals[k].as_py(), r)
                if rows.gates:
                    yield rows.batch()

    chosen = messages.where(F.col("message_type").isin(*types)).select("volume_id", "ordinal", "message_type", "payloads")
    return chosen.mapInArrow(run, RADIALS)


def _digital(schema, volume_ids: pa.Array, ordinals: pa.Array, data, start, end):
    """Batches of digital radials at these places; those that are not sound are passed over."""
    step = max(1, BATCH_GATES * len(start) // max(1, int((end - start).sum())))
    for first in range(0, len(start), step):
        own = slice(first, first + step)
        numbers, moments, kept, dateless = columnar.radial_columns(data, start[own], end[own])
        if dateless:
            raise RecordError("message without a date")
        kept = pa.array(kept + first)
        yield columnar.radial_batch(schema, volume_ids.take(kept), ordinals.take(kept), numbers, moments)


def _record_radials(schema, part, data, start, end, types):
    """Batches of the radials of opened records."""
    walk = columnar.Walk(data, start, end)
    chosen = np.flatnonzero(walk.header["message_type"] == 31) if 31 in types else np.zeros(0, np.int64)
    volume_ids, _, ordinals = _place(part, walk, chosen)
    yield from _digital(schema, volume_ids, pa.array(ordinals), data, walk.at[chosen] + L.HEADER_BYTES, walk.at[chosen] + walk.size[chosen])
    rows = RadialRows(schema)

    def single():
        for k in np.flatnonzero(walk.header["message_type"] == 1).tolist() if 1 in types else ():
            at = int(walk.at[k])
            yield int(walk.rec[k]), int(walk.idx[k]), 1, [data[at + L.HEADER_BYTES : at + L.FRAME_BYTES].tobytes()]
        for row in walk.slow.tolist():
            for k, (h, _, _, payloads) in enumerate(frame_messages(data[start[row] : end[row]].tobytes())):
                if h["message_type"] in types:
                    yield row, k, h["message_type"], payloads

    for row, k, kind, payloads in single():
        try:
            r = decode_radial(payloads[0]) if kind == 31 else decode_legacy_radial(payloads)
        except (struct.error, ValueError):
            continue
        rows.add(part.column("volume_id")[row].as_py(), part.column("record_idx")[row].as_py() * 1_000_000 + k, r)
        if len(rows.columns["ordinal"]) >= HELD_ROWS or rows.gates > BATCH_GATES:
            yield rows.batch()
    if rows.columns["ordinal"]:
        yield rows.batch()


def record_radials(records: DataFrame, mode: str = "FAILFAST", types: tuple[int, ...] = (31, 1)) -> DataFrame:
    """``radials`` of ``decode_records``, in one pass over the bytes."""
    _ready(records.sparkSession)
    schema = _arrow_schema(RADIALS)

    def run(batches):
        for part, data, start, end, error in _opened(batches, mode):
            if not error:
                yield from _record_radials(schema, part, data, start, end, types)

    return records.mapInArrow(run, RADIALS)


def _scaled(x, by: float):
    return None if x is None else x / by


def bodies(messages: DataFrame) -> DataFrame:
    """Other messages with their fields as JSON (null for types that are passed on undecoded)."""

    def work(row):
        base = {k: row[k] for k in ("volume_id", "ordinal", "message_type", "mjd", "ms")}
        try:
            body = decode_body(row["message_type"], row["payloads"])
        except (struct.error, ValueError):
            return
        yield {**base, "body": None if body is None else json.dumps(body)}

    other = messages.where(F.col("message_type").isNotNull() & ~F.col("message_type").isin(1, 31))
    out = _rows(other.select("volume_id", "ordinal", "message_type", "mjd", "ms", "payloads"), work, "volume_id string, ordinal long, message_type int, mjd int, ms long, body string")
    return out.withColumn("type_name", wire.label(F.col("message_type"), wire.MESSAGE_TYPES))


def record_bodies(records: DataFrame, fields: str, types: tuple[int, ...], mode: str = "FAILFAST") -> DataFrame:
    """``bodies`` of ``decode_records`` of some types in one pass over the bytes: body is a struct of fields (of decode_body; what a type lacks is null), null for types that are passed on undecoded."""
    types = tuple(k for k in types if k not in (1, 31))
    _ready(records.sparkSession)
    schema = f"volume_id string, ordinal long, message_type int, mjd int, ms long, body struct<{fields}>"
    arrow = _arrow_schema(schema)
    own = arrow.field("body").type

    def decoded(kind: int, payloads: list[bytes]):
        try:
            return True, decode_body(kind, payloads)
        except (struct.error, ValueError):
            return False, None

    def one_by_one(part, row, data, start, end):
        volume_id, number = part.column("volume_id")[row].as_py(), part.column("record_idx")[row].as_py()
        for k, (h, _, _, payloads) in enumerate(frame_messages(data[start[row] : end[row]].tobytes())):
            if h["message_type"] in types:
                sound, body = decoded(h["message_type"], payloads)
                if sound:
                    yield {"volume_id": volume_id, "ordinal": number * 1_000_000 + k, "message_type": h["message_type"], "mjd": h["mjd"], "ms": h["ms"], "body": body}

    def run(batches):
        for part, data, start, end, error in _opened(batches, mode):
            if error:
                continue
            walk = columnar.Walk(data, start, end)
            kinds = walk.header["message_type"]
            for kind in types:
                chosen = np.flatnonzero(kinds == kind)
                if not len(chosen):
                    continue
                at = walk.at[chosen] + L.HEADER_BYTES
                try:
                    found, sound = columnar.body_columns(kind, data, at)
                    body = columnar.body_struct(found, len(at), own)
                except KeyError:
                    each = [decoded(kind, [data[x : x + L.FRAME_BYTES - L.HEADER_BYTES].tobytes()]) for x in at.tolist()]
                    sound, body = np.array([x for x, _ in each]), pa.array([x for _, x in each], own)
                volume_id, _, ordinal = _place(part, walk, chosen)
                h = walk.header[chosen]
                made = [volume_id, pa.array(ordinal), *(pa.array(h[n].astype(f)) for n, f in (("message_type", np.int32), ("mjd", np.int32), ("ms", np.int64))), body]
                made = pa.RecordBatch.from_arrays(made, schema=arrow)
                yield made if sound.all() else made.filter(pa.array(sound))
            yield from _gathered((one for row in walk.slow.tolist() for one in one_by_one(part, row, data, start, end)), arrow)

    out = records.mapInArrow(run, schema)
    return out.withColumn("type_name", wire.label(F.col("message_type"), wire.MESSAGE_TYPES))


def whole_payload(payloads: Column) -> Column:
    """A message's segments as one."""

    @F.arrow_udf("binary")
    def joined(batch: pa.Array) -> pa.Array:
        return pa.array([None if p is None else b"".join(p) for p in batch.to_pylist()], pa.binary())

    return joined(payloads)


def load(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Radials of all volumes under a path."""
    return scan(read_volumes(spark, path), mode)


def volume_radials(volumes: DataFrame, mode: str = "FAILFAST", sweeps: set[int] | None = None) -> DataFrame:
    """Digital radials of volumes, from file to gates in one pass over the bytes; sweeps: of the volumes that ``trim`` makes of them, in the same worker."""
    _ready(volumes.sparkSession)
    schema = _arrow_schema(RADIALS)

    def opened(content: bytes):
        data = gunzip(content if sweeps is None else trimmed(content, sweeps))
        if len(data) < L.size(L.VOLUME_HEADER):
            raise RecordError("shorter than a volume header")
        return split_records(data[L.size(L.VOLUME_HEADER) :])

    def pieces(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                volume_id = batch.column(0)[k].as_py()
                try:
                    records = opened(batch.column(1)[k].as_py())
                except (RecordError, OSError, EOFError):
                    if mode == "FAILFAST":
                        raise
                    continue
                for number, (_, record) in enumerate(records):
                    try:
                        yield volume_id, number, open_record(record) if is_compressed(record) else record
                    except RecordError:
                        if mode == "FAILFAST":
                            raise

    def run(batches):
        held, size = [], 0
        for piece in pieces(batches):
            held.append(piece)
            size += len(piece[2])
            if size >= WALKED_BYTES:
                yield from walked(held)
                held, size = [], 0
        if held:
            yield from walked(held)

    def walked(held):
        part = pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in held], pa.string()), pa.array([n for _, n, _ in held], pa.int64())], ["volume_id", "record_idx"])
        yield from _record_radials(schema, part, *_joined([x for _, _, x in held]), (31,))

    return volumes.select("volume_id", "content").mapInArrow(run, RADIALS)


def scan(volumes: DataFrame, mode: str = "FAILFAST", sweeps: set[int] | None = None) -> DataFrame:
    """Radials of volumes, digital messages only, with sweep_idx; sweeps: ``scan`` of ``trim``, without a second Python worker a task."""
    from squall.operators.fields import segment_sweeps

    return segment_sweeps(volume_radials(volumes, mode, sweeps), ["ordinal"])


# ---- writers -------------------------------------------------------------------


def message_bytes(message_type: int, payload: bytes, mjd: int = 1, ms: int = 0, channel: int = 8, sequence: int = 0) -> bytes:
    """A message: radials as they are, others padded to frames, in as many segments as they need."""
    if message_type == 31:
        half = (L.HEADER_BYTES + len(payload)) // 2
        return L.write(L.MESSAGE_HEADER, {"segment_size": half, "channel": channel, "message_type": 31, "sequence": sequence, "mjd": mjd, "ms": ms, "segment_count": 1, "segment_number": 1}) + payload
    room = L.FRAME_BYTES - L.HEADER_BYTES
    parts = [payload[i : i + room] for i in range(0, len(payload), room)] or [b""]
    out = b""
    for k, part in enumerate(parts):
        header = {"segment_size": (L.HEADER_BYTES + len(part) + 1) // 2, "channel": channel, "message_type": message_type, "sequence": sequence, "mjd": mjd, "ms": ms, "segment_count": len(parts), "segment_number": k + 1}
        out += (L.write(L.MESSAGE_HEADER, header) + part).ljust(L.FRAME_BYTES, b"\0")
    return out


def adaptation_bytes(values: dict) -> bytes:
    """A type 18 payload; absent fields are zero."""
    out = bytearray(L.ADAPTATION_BYTES)
    out[: L.size(L.ADAPTATION_HEADER)] = L.write(L.ADAPTATION_HEADER, values)
    places = [(at, kind, values.get(name)) for name, kind, at in L.ADAPTATION_FIELDS]
    places += [(at, kind, v) for name, kind, offsets in L.ADAPTATION_LISTS for at, v in zip(offsets, values.get(name, ()), strict=False)]
    for at, kind, v in places:
        if v is not None:
            struct.pack_into(">" + kind, out, at, v.encode() if isinstance(v, str) else v)
    return bytes(out)


def radial_bytes(header: dict, moments: dict[str, dict], volume: dict | None = None, radial: dict | None = None, elevation: dict | None = None) -> bytes:
    """A type 31 payload; moments: name to scale, offset, word_size, first_gate_m, gate_interval_m and raw codes."""
    blocks = []
    if volume is not None:
        modern = "zdr_bias" in volume
        body = L.write(L.VOLUME_BLOCK, {**volume, "lrtup": 52 if modern else 44}) + (L.write(L.VOLUME_BLOCK_MORE, volume) if modern else b"")
        blocks.append(b"RVOL" + body)
    if elevation is not None:
        blocks.append(b"RELV" + L.write(L.ELEVATION_BLOCK, {**elevation, "lrtup": 12}))
    if radial is not None:
        modern = "horizontal_calibration" in radial
        body = L.write(L.RADIAL_BLOCK, {**radial, "lrtup": 28 if modern else 20}) + (L.write(L.RADIAL_BLOCK_MORE, radial) if modern else b"")
        blocks.append(b"RRAD" + body)
    for name, m in moments.items():
        wide = m.get("word_size", 8) == 16
        raw = struct.pack(f">{len(m['raw'])}{'H' if wide else 'B'}", *m["raw"])
        head = L.write(L.MOMENT_BLOCK, {**m, "gate_count": len(m["raw"]), "word_size": 16 if wide else 8})
        blocks.append(b"D" + name.encode().ljust(3) + head + raw)
    base = L.size(L.RADIAL_HEADER) + 4 * len(blocks)
    pointers, at = [], base
    for b in blocks:
        pointers.append(at)
        at += len(b)
    return L.write(L.RADIAL_HEADER, {**header, "data_block_count": len(blocks), "radial_length": at}) + struct.pack(f">{len(pointers)}I", *pointers) + b"".join(blocks)


def record_writer(encode, at_once: int = WALKED_ROWS):
    """Arrow batches of rows to those of RECORDS, a record of one message per row, volume_id is the row's key; encode(columns as numpy arrays, of at_once rows at most) gives
    a message's bytes a row (``columnar.messages``); of messages of unlike lengths, a list of (rows of one length, their bytes)."""
    arrow = _arrow_schema(RECORDS)

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, at_once):
                part = batch.slice(first, at_once)
                for name, column in zip(part.schema.names, part.columns, strict=True):
                    if column.null_count:
                        raise ValueError(f"{name} of a message is null")
                given = encode({name: column.to_numpy(zero_copy_only=False) for name, column in zip(part.schema.names, part.columns, strict=True)})
                for own, data in given if isinstance(given, list) else [(None, given)]:
                    n, width = data.shape
                    raw = columnar.binary(data.reshape(-1), np.arange(n) * width, np.full(n, width))
                    same = lambda x, kind: pa.array(np.full(n, x), kind)  # noqa: B023, E731
                    key = part.column("key") if own is None else part.column("key").take(pa.array(own))
                    made = [key.cast(pa.string()), same(0, pa.int32()), same(0, pa.int64()), same(width, pa.int64()), same(False, pa.bool_()), raw, pa.nulls(n, pa.string())]
                    yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return run


def message_records(rows: DataFrame, encode, at_once: int = WALKED_ROWS) -> DataFrame:
    """RECORDS of ``record_writer``."""
    run = record_writer(encode, at_once)
    _ready(rows.sparkSession)
    return rows.mapInArrow(run, RECORDS)


def volume_bytes(records: list[bytes], header: dict | None = None, compressed: bool = True) -> bytes:
    """A volume file of records (each the bytes of its messages)."""
    out = L.write(L.VOLUME_HEADER, {"tape_filename": "AR2V0006.", "extension": "001", "mjd": 1, "icao": "KTLX", **(header or {})})
    for k, r in enumerate(records):
        if compressed:
            packed = bz2.compress(r)
            out += struct.pack(">i", -len(packed) if k == len(records) - 1 else len(packed)) + packed
        else:
            out += r
    return out


def trimmed(content: bytes, sweeps: set[int]) -> bytes:
    """A volume file with only its first (metadata) record and those that hold a radial of the given elevation numbers."""
    data, head = gunzip(content), L.size(L.VOLUME_HEADER)
    kept = []
    for k, (_, record) in enumerate(split_records(data[head:])):
        opened = open_record(record) if is_compressed(record) else record
        has = any(h["message_type"] == 31 and L.read(L.RADIAL_HEADER, p[0])["elevation_number"] in sweeps for h, _, _, p in frame_messages(opened))
        if k == 0 or has:
            kept.append(record)
    return data[:head] + b"".join(kept)


def trim(volumes: DataFrame, sweeps: set[int]) -> DataFrame:
    """Volumes with only the first (metadata) record and those records that hold a radial of the given elevation numbers."""
    return _rows(volumes, lambda row: [{"volume_id": row["volume_id"], "content": trimmed(row["content"], sweeps)}], "volume_id string, content binary")
