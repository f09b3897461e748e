"""The front door, on volumes written here."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from squall import api
from squall.functions import wire
from squall.operators import render
from squall.sources import archive as A
from squall.sources import layouts as L


def volume(value: int) -> bytes:
    part = b""
    for k in range(8):
        head = {"mjd": 19000, "ms": k, "azimuth_number": k + 1, "azimuth_angle": k * 45.0, "azimuth_resolution_spacing": 2, "elevation_number": 1 + k // 4, "elevation_angle": 0.5}
        moments = {"REF": {"scale": 2.0, "offset": 66.0, "first_gate_m": 2000, "gate_interval_m": 250, "raw": [value] * 10}}
        site = {"latitude": 35.5, "longitude": -97.25, "site_height": 370, "tower_height": 10, "vcp": 212} if k == 2 else None
        part += A.message_bytes(31, A.radial_bytes(head, moments, site, {"nyquist_velocity": 2650}))
    return A.volume_bytes([A.message_bytes(2, bytes(120)), part])


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("archive")
    folder = top / "2024" / "01" / "02" / "KTLX"
    folder.mkdir(parents=True)
    for k, clock in enumerate(("000000", "003000", "013000")):
        (folder / f"KTLX20240102_{clock}_V06").write_bytes(volume(100 + k))
    (folder / "KTLX20240102_013000_V06_MDM").write_bytes(b"x")
    return str(top)


def first_code(df):
    return df.select(F.col("REF.raw")[0]).first()[0]


def test_choosing(spark, root):
    assert api.list_scans(spark, root, "KTLX", "2024-01-02").count() == 4
    assert first_code(api.download(spark, root, "KTLX20240102_003000_V06")) == 101
    assert first_code(api.download_latest(spark, root, "KTLX", "2024-01-02")) == 102
    assert first_code(api.download_at(spark, root, "KTLX", datetime(2024, 1, 2, 1, 29))) == 101
    with pytest.raises(api.MissingData):
        api.coordinate_system_required(api.download_at(spark, root, "KTLX", datetime(2024, 1, 2)).limit(0))


def test_fields_and_site(spark):
    radials = api.load(spark, volume(100))
    assert radials.select("sweep_idx").distinct().count() == 2 and radials.first().nyquist_ms == 26.5
    gates = api.extract_field(radials, "REF", 1)
    assert gates.count() == 40 and {r.value for r in gates.collect()} == {17.0}
    assert api.extract_fields(radials, "REF").count() == 80 and api.extract_first_field(radials, "REF").select("sweep_idx").distinct().collect() == [(0,)]
    with pytest.raises(api.MissingData):
        api.extract_field(radials, "VEL", 0)
    where = api.coordinate_system_required(radials)
    assert (where.latitude, where.longitude, where.antenna_m) == (35.5, -97.25, 380.0)
    assert api.coordinate_system(radials.where("azimuth_number = 1")) is None
    with pytest.raises(api.MissingData):
        api.coordinate_system_required(radials.where("azimuth_number = 1"))
    assert render.query_pixel(gates, 20, 11, 20, 4.5, where).count() >= 0


def test_sites(spark):
    assert api.site("ktlx")["city"] == "Oklahoma City" and api.site("zzzz") is None
    assert api.sites(spark).count() == 157


def test_retries():
    tries, waits = [], []

    def work():
        tries.append(1)
        if len(tries) < 4:
            raise OSError("not yet")
        return 7

    assert api.with_retries(work, sleep=waits.append) == 7 and waits == [0.5, 0.5, 1.0]
    with pytest.raises(OSError):
        api.with_retries(lambda: (_ for _ in ()).throw(OSError()), sleep=lambda s: None)


def test_images_and_files(spark, tmp_path):
    gates = api.extract_fields(api.load(spark, volume(100)), "REF")
    options = render.RenderOptions.native_for(10).transparent()
    assert options.size == 20
    made = render.render_images(gates, "REF", 4.5, options)
    assert api.save_bytes(made.withColumn("name", F.concat(F.lit("sweep"), "sweep_idx", F.lit(".png"))), "name", "png", str(tmp_path)) == 2
    assert (tmp_path / "sweep0.png").read_bytes()[:4] == b"\x89PNG"


def test_halfword_fields(spark):
    import struct

    raw = struct.pack(">HhIf", 7, -3, 70000, 1.5)
    words = list(struct.unpack(f">{len(raw) // 2}H", raw))
    df = spark.createDataFrame([(words,)], "w array<int>")
    got = df.select(*[c.alias(n) for n, c in wire.halfword_fields(F.col("w"), (("a", 1, "u16"), ("b", 2, "i16"), ("c", 3, "u32"), ("d", 5, "f32"))).items()]).first()
    assert tuple(got) == (7, -3, 70000, 1.5)
    assert L.text(b"ab\xff") is None
