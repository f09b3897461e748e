"""Many messages at once against the walk over single ones."""

import bz2
import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from squall.functions import wire
from squall.sources import archive, columnar
from squall.sources import layouts as L


def _radial(k, moments=("REF",), **more):
    raw = {"REF": {"scale": 2.0, "offset": 66.0, "first_gate_m": 2125, "gate_interval_m": 250, "raw": [k % 250, 1, 2]}, "PHI": {"scale": 1.0, "raw": [300 + k, 7], "word_size": 16}}
    head = {"mjd": 18000, "ms": k, "azimuth_number": k, "azimuth_angle": k * 0.5, "azimuth_resolution_spacing": 2, "elevation_number": 3, "elevation_angle": 0.5}
    return archive.message_bytes(31, archive.radial_bytes(head, {m: raw[m] for m in moments}, **more), 18000, k)


def _odd(seed):
    """A record of messages of all kinds, some of them broken or cut."""
    r = random.Random(seed)
    volume = {"latitude": 35.25, "longitude": -97.5, "site_height": -3, "tower_height": 10, "vcp": 212}
    noise = lambda n: bytes(r.randrange(256) for _ in range(n))
    choices = [
        lambda: _radial(r.randrange(700), r.choice([("REF",), ("PHI", "REF"), ()]), volume=r.choice([None, volume, volume | {"zdr_bias": 1}]), elevation={"atmos": -5}),
        lambda: _radial(1, ("PHI",), radial=r.choice([None, {"nyquist_velocity": 999}, {"nyquist_velocity": 999, "horizontal_calibration": 1.0}])),
        lambda: archive.message_bytes(r.choice([2, 3, 4, 6, 7, 9, 11, 12, 32, 33, 50]), noise(r.randrange(200)), 18000, 5),
        lambda: archive.message_bytes(32, struct.pack(">HHHHIIHH", 2, 0, 1, 2, 5, 70000, 2, 0), 18000, 5),
        lambda: archive.message_bytes(4, struct.pack(">H", 6) + "grüß".encode(), 18000, 5),
        lambda: archive.message_bytes(13, noise(3000)),
        lambda: _radial(9)[: r.randrange(30, 120)] if r.random() < 0.5 else _radial(9)[:60] + noise(4) + _radial(9)[64:],
    ]
    weights = r.choice([(6, 3, 3, 1, 1, 0, 0), (3, 1, 3, 1, 1, 1, 1), (0, 0, 1, 1, 1, 0, 0)])
    return b"".join(f() for f in r.choices(choices, weights, k=r.randrange(6))) + bytes(r.choice([0, 0, 11, 40]))


@pytest.fixture(scope="module")
def records(spark):
    rows = []
    for k in range(120):
        data = _odd(k)
        packed = k % 5 == 0
        rows.append((f"v{k}", k % 3, 0, len(data), packed, b"\0\0\0\0" + bz2.compress(data) if packed else data, None))
    return spark.createDataFrame(rows, archive.RECORDS)


def _plain(x):
    if isinstance(x, bytes | bytearray):
        return bytes(x)
    return tuple(map(_plain, x)) if isinstance(x, list | tuple) else x


def test_messages_are_those_of_the_walk(records):
    want = []
    for r in records.collect():
        data = archive.open_record(r["data"]) if r["compressed"] else bytes(r["data"])
        for k, (h, at, n, payloads) in enumerate(archive.frame_messages(data)):
            want.append((r["volume_id"], r["record_idx"], k, r["record_idx"] * 1_000_000 + k, at, n, *(h[x] for x in ("message_type", "channel", "sequence", "mjd", "ms")), len(payloads), _plain(payloads), None))
    got = [_plain(tuple(r)) for r in archive.decode_records(records).collect()]
    assert len(want) > 200
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_radials_in_one_pass(records):
    want = []
    for r in archive.decode_records(records).where("message_type = 31").collect():
        d = archive.decode_radial(bytes(r["payloads"][0]))
        want.append((r["volume_id"], r["ordinal"], d["header"]["azimuth_angle"], d.get("volume", {}).get("latitude"), d.get("elevation", {}).get("atmos"), *(tuple(d["moments"][m]["raw"].tolist()) if m in d["moments"] else None for m in ("REF", "PHI"))))
    messages, whole = archive.radials(archive.decode_records(records)), archive.record_radials(records)
    assert sorted(map(repr, messages.collect())) == sorted(map(repr, whole.collect()))
    got = [(r["volume_id"], r["ordinal"], r["azimuth_deg"], r["latitude"], None if r["atmos_db"] is None else round(r["atmos_db"] * 1000), *(None if r[m] is None else tuple(r[m]["raw"]) for m in ("REF", "PHI"))) for r in whole.collect()]
    assert len(want) > 50
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("types, fields", [
    ((2, 3, 4, 6, 7, 11, 12, 13, 32, 33, 50), "size long, text string, rda_status int, alarms array<int>, halfwords array<int>, state_command int, pattern string, version long, identifier string, payload_hex string, waveforms array<struct<waveform:int,prfs:array<long>>>"),
    ((9,), "code int, " + ", ".join(f"{n} boolean" for n in wire.REQUEST_BITS)),
])
def test_bodies_in_one_pass(records, types, fields):
    typed = archive.record_bodies(records, fields, types).collect()
    plain = archive.bodies(archive.decode_records(records)).where(F.col("message_type").isin(*types)).collect()
    names = [x.split()[0] for x in fields.split(", ")]

    def told(r, body):
        return r["volume_id"], r["ordinal"], r["message_type"], r["ms"], r["type_name"], None if body is None else json.dumps([body.get(n) for n in names])

    want = [told(r, None if r["body"] is None else json.loads(r["body"])) for r in plain]
    got = [told(r, None if r["body"] is None else r["body"].asDict(True)) for r in typed]
    assert len(want) > 5
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_written_rows_are_single_ones():
    c = np.arange(5)
    rows = columnar.messages(6, L.write_many(L.CONTROL_COMMANDS, 5, {"local_vcp": c, "zdr_bias_estimate": c - 3}), 18000, c)
    assert [x.tobytes() for x in rows] == [archive.message_bytes(6, L.write(L.CONTROL_COMMANDS, {"local_vcp": k, "zdr_bias_estimate": k - 3}), 18000, k) for k in range(5)]
    long = np.arange(5 * 6000).reshape(5, 6000).astype(np.uint8)
    assert [x.tobytes() for x in columnar.messages(13, long)] == [archive.message_bytes(13, x.tobytes()) for x in long]
    parts = ({"scale": 2.0, "first_gate_m": 2125}, {"latitude": 35.25, "zdr_bias": 1}, {"nyquist_velocity": 999}, {"atmos": -3})
    many = columnar.radials(5, {"azimuth_number": c}, {"REF": parts[0] | {"raw": np.stack([c, c + 1], 1)}, "PHI": {"word_size": 16, "raw": c[:, None] + 400}}, *parts[1:])
    one = [archive.radial_bytes({"azimuth_number": k}, {"REF": parts[0] | {"raw": [k, k + 1]}, "PHI": {"word_size": 16, "raw": [k + 400]}}, *parts[1:]) for k in range(5)]
    assert [x.tobytes() for x in many] == one
    assert [x.tobytes() for x in columnar.messages(31, many, 18000, c)] == [archive.message_bytes(31, x, 18000, k) for k, x in enumerate(one)]


@pytest.mark.parametrize("name", ["c13_performance_fields", "c28_undecoded", "c27_log_data", "c06_moment_block", "c19_control_commands", "d05_fields_from_radials", "c07_radials", "c26_prf_data"])
def test_bytes_go_to_python_once(spark, name):
    """Messages are written in one Python stage and decoded in one, without JSON between them."""
    from squall.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
    assert "from_json" not in plan
