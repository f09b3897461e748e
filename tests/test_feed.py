"""The real-time feed, assembly of what has arrived, adaptation documents, displays and sinks."""

import struct

import pytest
from pyspark.sql import functions as F

from squall import api
from squall.functions import display
from squall.operators import fields, filters, render
from squall.functions.geo import RadarSite
from squall.sources import archive, listing
from squall.sources import layouts as L
from squall.streaming import chunk_stream, feed


def pattern_record(cuts, number=212):
    """A metadata record; cuts: (raw elevation, raw rate, half degree, waveform)."""
    body = b"".join(L.write(L.PATTERN_CUT, {"elevation_angle": e, "azimuth_rate": r, "super_resolution": int(h), "waveform_type": w}) for e, r, h, w in cuts)
    return archive.message_bytes(5, L.write(L.PATTERN_HEADER, {"pattern_type": 2, "pattern_number": number, "n_cuts": len(cuts)}) + body, 18000, 2)


def radial_record(elevation, azimuths, ms=0):
    out = b""
    for k in azimuths:
        head = {"mjd": 18000, "ms": ms + k, "azimuth_number": k + 1, "azimuth_angle": k * 1.0, "azimuth_resolution_spacing": 2, "elevation_number": elevation, "elevation_angle": elevation * 0.5, "radial_status": 1}
        out += archive.message_bytes(31, archive.radial_bytes(head, {"REF": {"scale": 2.0, "offset": 66.0, "gate_interval_m": 250, "raw": [0, 1, 80 + k]}}), 18000, ms + k)
    return out


def chunk_bytes(records):
    """A start chunk, then one record each, as they are uploaded."""
    whole = archive.volume_bytes(records, {"mjd": 18000, "ms": 5000})
    head, parts = whole[: L.size(L.VOLUME_HEADER)], [r for _, r in archive.split_records(whole[L.size(L.VOLUME_HEADER) :])]
    return [head + parts[0], *parts[1:]]


CUTS = [(364, 4000, False, 1), (728, 8000, False, 2)]  # three chunks each: 1 to 7


@pytest.fixture
def root(tmp_path):
    def put(volume, prefix, chunks, sequences, final=7):
        folder = tmp_path / "KTLX" / str(volume)
        folder.mkdir(parents=True, exist_ok=True)
        for k in sequences:
            letter = "S" if k == 1 else "E" if k == final else "I"
            (folder / f"{prefix}-{k:03d}-{letter}").write_bytes(chunks[k - 1])

    put.path = str(tmp_path)
    return put


def chunks_of_volume():
    return chunk_bytes([pattern_record(CUTS)] + [radial_record(1 + k // 3, range(k % 3 * 4, k % 3 * 4 + 4), k * 100) for k in range(6)])


def test_names():
    one = feed.ChunkName.parse("KTLX", 7, "20240102-030405-012-I")
    assert (one.sequence, one.letter, one.prefix, one.name) == (12, "I", "20240102-030405", "20240102-030405-012-I")
    for bad in ("20240102-030405-1-I", "2024010x-030405-012-I", "20240102-030405-abc-I", "20240102-030405-012-X"):
        with pytest.raises(ValueError):
            feed.ChunkName.parse("KTLX", 7, bad)


def test_pattern():
    p = feed.Pattern([{"super_resolution": 1, "waveform_type": 1, "channel_configuration": 0, "azimuth_rate": 4000, "elevation_angle": 364}, {"super_resolution": 0, "waveform_type": 9, "channel_configuration": 3, "azimuth_rate": 0, "elevation_angle": 728}], 212)
    assert p.ranges == [(2, 7), (8, 10)] and p.final_sequence == 10 and p.cut_of(1) is None and p.cut_of(8) == 1
    assert p.kind(2) == ("CS", "ConstantPhase") and p.kind(9) == ("Unknown", "UnknownPhase")
    rate = (4000 & 0x7FF8) * 22.5 / 16384
    within, first = (360 / rate - 0.67) / 6, (364 & 0xFFF8) * 180 / 32768
    assert p.interval_ms(3) == int(within * 1000) and p.interval_ms(2) == int((within + 0.7 + first * 0.08) * 1000)
    assert p.interval_ms(9) == 4000 and p.interval_ms(11) is None  # without a rate: the fallback


def test_feed_from_the_start(spark, root):
    data = chunks_of_volume()
    root(998, "20240102-000000", data, range(1, 8))
    root(999, "20240102-001000", data, [1])
    one, latest, first = api.follow(spark, root.path, "KTLX")
    assert latest.chunk.volume == 999 and latest.chunk.letter == "S" and first is None and one.pattern.number == 212
    assert one.wait_ms() == 8500 and one.next_expected_ms() == latest.chunk.upload_ms + 8500
    assert one.time_until_next_ms(latest.chunk.upload_ms) == 8500 and one.time_until_next_ms(latest.chunk.upload_ms + 9000) is None
    assert one.try_next() is None  # not there yet
    root(999, "20240102-001000", data, range(2, 8))
    got = [one.try_next() for _ in range(6)]
    assert [g.chunk.sequence for g in got] == [2, 3, 4, 5, 6, 7] and got[-1].chunk.letter == "E" and [g.data for g in got] == data[1:]
    assert one.bytes_downloaded == sum(map(len, data)) and one.statistics and one.remaining() == []
    assert one.next_name() == 1 and one.try_next() is None  # the next slot is empty
    root(1, "20231231-000000", data, [1, 2])
    assert one.try_next() is None  # or still holds an older volume
    root(1, "20240102-002000", data, [1, 2, 3])
    joined = one.try_next()
    assert joined.chunk.volume == 1 and joined.chunk.sequence == 3 and one.next_name().name == "20240102-002000-004-I"


def test_feed_joined_midway(spark, root):
    data = chunks_of_volume()
    root(5, "20240102-000000", data, [1, 2, 3])
    one, latest, first = api.follow(spark, root.path, "KTLX")
    assert latest.chunk.sequence == 3 and first.chunk.letter == "S" and first.data == data[0]
    again = feed.ChunkFeed.from_chunk(spark, root.path, feed.ChunkName("KTLX", 5, "20240102-000000", 2, "I", 1000))
    assert again.try_next().chunk.sequence == 3 and again.try_next() is None
    with pytest.raises(listing.ObjectNotFound):
        api.follow(spark, root.path, "KXXX")
    lost = feed.ChunkFeed.from_chunk(spark, root.path, feed.ChunkName("KTLX", 6, "20240102-000000", 2, "I"))
    with pytest.raises(listing.ObjectNotFound):  # no pattern, so no next chunk
        lost.try_next()


def test_feed_looks_again(spark, root):
    data = chunks_of_volume()
    root(5, "20240102-000000", data, [1])
    policy = {"max_attempts": 2, "initial_ms": 10, "multiplier": 2.0, "max_ms": 100}
    one, _, _ = api.follow(spark, root.path, "KTLX", download_policy=policy, discovery_policy=policy)
    slept = []

    def sleep(seconds):
        slept.append(seconds)
        if len(slept) == 2:
            root(5, "20240102-000000", data, [2])

    got = list(one.chunks(sleep))
    assert [(g.chunk.sequence, g.attempts) for g in got] == [(2, 2)] and len(slept) >= 4


def test_assembly_keeps_what_came(spark):
    data = chunks_of_volume()
    rows = [("K", 1, k + 1, bytearray(d), "Start" if k == 0 else "End" if k == 6 else "Intermediate") for k, d in enumerate(data)]
    rows += [("K", 1, 3, bytearray(data[2]), "Intermediate")]  # came twice
    rows += [("K", 2, k + 1, bytearray(data[k]), "Start" if k == 0 else "Intermediate") for k in (0, 1, 4)] + [("K", 3, 2, bytearray(data[1]), "Intermediate")]
    df = spark.createDataFrame(rows, "site string, volume int, sequence int, data binary, chunk_type string").repartition(3)
    whole = chunk_stream.assemble(df)
    got = {r.volume_id: r for r in whole.collect()}
    assert set(got) == {"K-1", "K-2"} and got["K-1"].complete and got["K-1"].n_chunks == 7 and got["K-1"].missing == []
    assert not got["K-2"].complete and got["K-2"].missing == [3, 4]
    radials = archive.scan(whole).groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sweep_idx").alias("sweeps")).collect()
    assert {(r.volume_id, r.n, r.sweeps) for r in radials} == {("K-1", 24, 2), ("K-2", 8, 2)}


def test_adaptation_document():
    places = [(at, struct.calcsize(">" + kind)) for _, kind, at in L.ADAPTATION_FIELDS] + [(at, 4) for _, _, offsets in L.ADAPTATION_LISTS for at in offsets]
    places.sort()
    assert all(a + n <= b for (a, n), (b, _) in zip(places[:-1], places[1:], strict=True)) and places[-1][0] + places[-1][1] <= L.ADAPTATION_BYTES
    values = {name: f"{k:04d}"[:4] if kind.endswith("s") else float(k) if kind in "fd" else k for k, (name, kind, _) in enumerate(L.ADAPTATION_FIELDS)}
    values |= {name: [float(k) for k in range(len(offsets))] for name, _, offsets in L.ADAPTATION_LISTS}
    values["slatdir"], values["slondir"] = "N", "W"
    body = archive.decode_body(18, [p for _, _, _, payloads in archive.frame_messages(archive.message_bytes(18, archive.adaptation_bytes(values))) for p in payloads])
    assert {k: body[k] for k in values} == values and len(body["atten_table"]) == 104 and len(body["v_rnscale"]) == 13
    assert body["site_longitude"] < 0 < body["site_latitude"]
    short = archive.decode_body(18, [archive.adaptation_bytes(values)[:80]])
    assert "lower_dead_limit" not in short and short["a_fuel_conv"] == [0.0, 1.0, 2.0]


def test_one_pass_is_the_same_as_three(spark):
    volume = archive.volume_bytes([pattern_record(CUTS), radial_record(1, range(5)), radial_record(2, range(3), 900)])
    df = spark.createDataFrame([("a", bytearray(volume)), ("b", bytearray(volume[:-40]))], "volume_id string, content binary")
    one = archive.volume_radials(df, "PERMISSIVE")
    three = archive.radials(archive.decode_records(archive.split_volumes(df, "PERMISSIVE"), "PERMISSIVE"), (31,))
    key = lambda r: (r.volume_id, r.ordinal)
    assert sorted(one.collect(), key=key) == sorted(three.collect(), key=key) and one.count() == 8
    with pytest.raises(Exception, match="truncated record"):
        archive.volume_radials(df).count()
    assert archive.volume_radials(df.limit(0)).count() == 0


def test_displays(spark):
    r = spark.createDataFrame([(bytearray(b"ab\xff"), bytearray(b"K1 \0\0"), 0)], "bad binary, padded binary, n int").select(
        display.text(F.col("bad")).alias("strict"), display.text(F.col("bad"), lossy=True).alias("lossy"), display.trimmed(F.col("padded")).alias("trimmed"),
        display.sweep(F.lit(0.25), F.lit(359.75), F.lit(720), F.lit(0.5)).alias("sweep"), display.sweep(F.lit(None), F.lit(None), F.col("n"), F.lit(None)).alias("none"),
        display.sweep(F.lit(0.5), F.lit(359.5), F.lit(360), F.lit(1.0)).alias("whole"), display.scan(F.lit(212), F.lit(3)).alias("scan"), display.hex_dump(F.col("bad"), 2).alias("dump"),
    ).first()
    assert (r.strict, r.lossy, r.trimmed) == (None, "ab�", "K1")
    assert r.whole == "Sweep (0.5-359.5 deg, 360 radials, 1 deg spacing)" and r.none == "Sweep (no radials)" and r.scan == "Scan (212, 3 sweeps)" and r.dump == ["6162", "FF"]


def test_options_and_processors(spark):
    with pytest.raises(render.InvalidParameter):
        render.RenderOptions(4).with_size(4, 0)
    with pytest.raises(render.InvalidParameter):
        render.RenderOptions(4).with_interpolation("cubic")
    with pytest.raises(render.InvalidParameter):
        render.RenderOptions(4).with_extent((1.0, 0.0, 0.0, 1.0))
    with pytest.raises(render.InvalidParameter):
        render.within_extent(spark.range(1), 10.0, render.RenderOptions(4).with_extent((0.0, 0.0, 1.0, 1.0)))
    assert render.RenderOptions(4).with_size(6, 3).with_coordinate_system(RadarSite(1.0, 2.0)).shape == (6, 3)
    g = spark.range(3).withColumn("value", F.lit(1.0))
    double = lambda gates, scan: gates.withColumn("value", F.col("value") * 2)
    assert [r.value for r in filters.ScanPipeline().then(double).then(double).execute(g, g.limit(0)).collect()] == [4.0] * 3
    with pytest.raises(render.InvalidParameter):
        filters.ScanPipeline(lambda gates, scan: gates.drop("value")).execute(g, g)
    with pytest.raises(render.InvalidParameter):
        fields.moment_columns("XYZ")


def test_saved_records_and_messages(spark, tmp_path):
    v = spark.createDataFrame([("a", bytearray(archive.volume_bytes([pattern_record(CUTS), radial_record(1, range(5))])))], "volume_id string, content binary")
    assert api.save_records(v, str(tmp_path / "r")) == 2 and sorted(p.name for p in (tmp_path / "r").iterdir()) == ["a-0000", "a-0001"]
    assert (tmp_path / "r" / "a-0000").read_bytes() == pattern_record(CUTS)
    assert api.save_messages(archive.decode_records(archive.split_volumes(v)), str(tmp_path / "m")) == 6
    assert len(list((tmp_path / "m").glob("*-31"))) == 5
