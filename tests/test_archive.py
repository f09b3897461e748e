"""Binary volumes: round trips, broken input, every message type."""

import json
import os
import struct

import pytest

from squall.sources import archive as A
from squall.sources import layouts as L


def radial(**more):
    head = {"mjd": 19000, "ms": 5, "azimuth_number": 3, "azimuth_angle": 1.5, "azimuth_resolution_spacing": 2, "elevation_number": 1, "elevation_angle": 0.5}
    moments = {"REF": {"scale": 2.0, "offset": 66.0, "first_gate_m": 2125, "gate_interval_m": 250, "raw": [0, 1, 50, 100]}, "SW": {"scale": 2.0, "offset": 129.0, "raw": [300, 4], "word_size": 16}}
    return A.radial_bytes(head | more, moments, {"latitude": 35.0, "longitude": -97.0, "site_height": 370, "tower_height": 10, "vcp": 212}, {"nyquist_velocity": 2500})


@pytest.mark.parametrize("layout,size", [
    (L.VOLUME_HEADER, 24), (L.MESSAGE_HEADER, 28), (L.RADIAL_HEADER, 32), (L.VOLUME_BLOCK, 40), (L.ELEVATION_BLOCK, 8), (L.RADIAL_BLOCK, 16), (L.MOMENT_BLOCK, 24), (L.PATTERN_HEADER, 22),
    (L.PATTERN_CUT, 46), (L.LEGACY_RADIAL, 100), (L.STATUS, 120), (L.CONTROL_COMMANDS, 52), (L.CENSOR_REGION, 12), (L.LOG_HEADER, 68), (L.ADAPTATION_HEADER, 44),
])
def test_layout_sizes(layout, size):
    assert L.size(layout) == size


def test_radial_round_trip():
    r = A.decode_radial(radial())
    assert r["header"]["azimuth_number"] == 3 and r["volume"]["vcp"] == 212 and "zdr_bias" not in r["volume"]
    assert r["moments"]["REF"]["raw"].tolist() == [0, 1, 50, 100] and r["moments"]["REF"]["first_gate_km"] == pytest.approx(2.125)
    assert r["moments"]["SW"]["raw"].tolist() == [300, 4]


def test_modern_blocks():
    body = A.radial_bytes({"mjd": 1}, {}, {"zdr_bias": 7, "vcp": 12}, {"horizontal_calibration": 1.5})
    r = A.decode_radial(body)
    assert r["volume"]["zdr_bias"] == 7 and r["radial"]["horizontal_calibration"] == 1.5


def test_frames_and_segments():
    status = L.write(L.STATUS, {"vcp": -212, "alarm_3": 17})
    long = bytes(range(256)) * 20
    data = A.message_bytes(31, radial()) + A.message_bytes(2, status) + A.message_bytes(13, long)
    found = list(A.frame_messages(data))
    assert [h["message_type"] for h, *_ in found] == [31, 2, 13]
    assert b"".join(found[2][3]) == long
    body = A.decode_body(2, found[1][3])
    assert body["vcp"] == -212 and body["alarms"][2] == 17


def test_orphan_and_unfinished_segments():
    long = bytes(6000)
    whole = A.message_bytes(13, long)
    orphan = whole[L.FRAME_BYTES :]
    assert list(A.frame_messages(orphan)) == []
    assert [h["message_type"] for h, *_ in A.frame_messages(whole[: L.FRAME_BYTES] + A.message_bytes(2, b"\0" * 120))] == [2]


@pytest.mark.parametrize("data", [b"", b"\1", b"\0" * 27, b"\0" * 100, b"\xff" * 100, os.urandom(5000)])
def test_malformed_messages_do_not_raise(data):
    list(A.frame_messages(data))


def test_records():
    assert A.split_records(b"") == []
    assert A.split_records(b"\0\0\0\0abc") == [(0, b"\0\0\0\0abc")]
    one = struct.pack(">i", -5) + b"BZabc"
    assert A.split_records(one + one) == [(0, one), (9, one)]
    for bad in (b"\0\1", struct.pack(">i", 9) + b"abc", one + struct.pack(">i", 0)):
        with pytest.raises(A.RecordError):
            A.split_records(bad)
    with pytest.raises(A.RecordError):
        A.open_record(one)
    assert A.gunzip(b"plain") == b"plain"
    assert A.chunk_kind(b"AR2V0006.") == "Start" and A.chunk_kind(one) == "IntermediateOrEnd"
    with pytest.raises(A.RecordError):
        A.chunk_kind(b"nothing here")


def test_other_bodies():
    assert A.decode_body(4, [struct.pack(">H", 5) + b"hello"])["text"] == "hello"
    assert A.decode_body(4, [struct.pack(">H", 2) + b"\xff\xfe"])["text"] is None
    assert A.decode_body(9, [struct.pack(">H", 129)])["rda_status"] is True
    assert A.decode_body(8, [struct.pack(">H6H", 1, 1, 2, 3, 4, 5, 6)])["regions"][0]["stop_azimuth"] == 4
    assert A.decode_body(11, [struct.pack(">H", 3) + b"\1\2\3\4"])["pattern"] == "01020304"
    assert A.decode_body(32, [struct.pack(">HHHHII", 1, 0, 2, 2, 10, 20)])["waveforms"] == [{"waveform": 2, "prfs": [10, 20]}]
    assert A.decode_body(33, [L.write(L.LOG_HEADER, {"identifier": "LOG", "compressed_size": 2}) + b"\1\2"])["payload_hex"] == "0102"
    assert A.decode_body(6, [L.write(L.CONTROL_COMMANDS, {"zdr_bias_estimate": -3, "spot_blanking": 4})])["zdr_bias_estimate"] == -3
    assert len(A.decode_body(3, [bytes(960)])["halfwords"]) == 480
    assert A.decode_body(7, [bytes(200)]) is None and A.decode_body(20, [bytes(10)]) is None


def test_bypass_and_clutter_maps():
    words = [0] * (360 * 32)
    words[2 * 32 + 1] = 1 << 3
    raw = L.write(L.MAP_HEADER, {"n_segments": 1}) + struct.pack(">H", 1) + struct.pack(f">{len(words)}H", *words)
    parts = [raw[i : i + 2404] for i in range(0, len(raw), 2404)]
    bits = A.decode_body(13, parts)["segments"][0]["bits"]
    assert A.bypass_flag(bits, 2, 19) and not A.bypass_flag(bits, 2, 18) and A.bypass_flag(bits, 360, 0) is None
    zones = b"".join(struct.pack(">HHH", 1, 2, 511) for _ in range(360))
    body = A.decode_body(15, [L.write(L.MAP_HEADER, {"n_segments": 1}) + zones])
    assert body["segments"][0]["azimuths"][359] == [(2, 511)]


def test_adaptation():
    data = bytearray(9468)
    for name, kind, at in L.ADAPTATION_FIELDS:
        value = {"slatdeg": 35, "slatmin": 30, "slondeg": 97, "slonmin": 15, "slatdir": b"N", "slondir": b"W", "site_name": b"KTLX"}.get(name, b"" if kind.endswith("s") else 0)
        struct.pack_into(">" + kind, data, at, value)
    body = A.decode_body(18, [bytes(data)])
    assert body["site_latitude"] == 35.5 and body["site_longitude"] == -97.25 and body["site_name"] == "KTLX"


def test_legacy_radial():
    head = {"ms": 53477, "mjd": 12785, "azimuth_angle": 3992, "elevation_angle": 104, "elevation_number": 1, "surveillance_first": -500, "surveillance_interval": 1000, "surveillance_gates": 4, "ref_pointer": 100, "doppler_resolution": 4}
    r = A.decode_legacy_radial([L.write(L.LEGACY_RADIAL, head) + bytes([0, 1, 66, 100])])
    assert r["moments"]["REF"]["raw"].tolist() == [0, 1, 66, 100] and r["moments"]["REF"]["first_gate_km"] == pytest.approx(0.5)
    assert r["header"]["azimuth_angle"] == pytest.approx(21.92871, abs=1e-4) and r["header"]["elevation_angle"] == pytest.approx(0.57128906, abs=1e-5)


def test_files_and_modes(spark, tmp_path):
    record = A.message_bytes(31, radial()) + A.message_bytes(31, radial(elevation_number=2))
    good = A.volume_bytes([A.message_bytes(2, bytes(120)), record])
    (tmp_path / "KTLX20240101_000000_V06").write_bytes(good)
    assert A.load(spark, str(tmp_path)).select("elevation_number", "sweep_idx").collect() == [(1, 0), (2, 1)]
    (tmp_path / "broken").write_bytes(good[:-10])
    with pytest.raises(Exception, match="truncated"):
        A.load(spark, str(tmp_path)).count()
    messages = A.decode_records(A.split_volumes(A.read_volumes(spark, str(tmp_path)), "PERMISSIVE"), "PERMISSIVE")
    assert messages.where("_corrupt is not null").select("volume_id").collect() == [("broken",)]
    b = A.bodies(messages).first()
    assert b["type_name"] == "RDAStatusData" and json.loads(b["body"])["vcp"] == 0


def test_listing_and_cache(spark, tmp_path):
    from squall.sources import listing

    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "cache").mkdir()
    for n in ("KTLX20240101_000000_V06", "KTLX20240101_000500_V06", "KTLX20240101_000500_V06_MDM"):
        (tmp_path / "in" / "a" / n).write_bytes(b"x")
    found = listing.volumes_only(listing.list_folder(spark, str(tmp_path / "in")))
    assert found.count() == 2
    assert listing.with_prefix(found, "KTLX", "2024-01-01").count() == 2
    with pytest.raises(listing.MissingData):
        listing.with_prefix(found, "KTLX", "2024-01-01", max_keys=1)
    source = str(tmp_path / "in" / "a" / "KTLX20240101_000000_V06")
    assert listing.cached(spark, source, str(tmp_path / "cache")) == listing.cached(spark, source, str(tmp_path / "cache"))
