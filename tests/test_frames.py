"""Relational reassembly against the walk over bytes, and the table functions."""

import random

import numpy as np
import pytest

from squall.sources import archive, columnar, frames
from squall.sources import layouts as L

RECORD = archive.RECORDS


def frame(kind, count, number, payload, sequence):
    head = {"segment_size": (L.HEADER_BYTES + len(payload)) // 2, "channel": 8, "message_type": kind, "sequence": sequence, "mjd": 18000, "ms": sequence, "segment_count": count, "segment_number": number}
    return (L.write(L.MESSAGE_HEADER, head) + payload).ljust(L.FRAME_BYTES, b"\0")


def record(rng):
    """Frames with orphans, restarts, repeats, zero counts, radials in between, and at times a cut end."""
    out = b""
    for k in range(rng.randrange(1, 14)):
        if rng.random() < 0.2:
            body = archive.radial_bytes({"mjd": 18000, "ms": k, "azimuth_number": k + 1, "elevation_number": 1}, {"REF": {"scale": 2.0, "offset": 66.0, "raw": [0, 1, 80 + k]}})
            out += archive.message_bytes(31, body, 18000, k, sequence=k)
        else:
            payload = bytes(rng.randrange(1, 255) for _ in range(2 * rng.randrange(1, 40)))
            out += frame(rng.choice([13, 15, 18]), rng.choice([0, 1, 2, 3, 4]), rng.choice([0, 1, 1, 2, 3]), payload, k)
    return out[: -rng.randrange(1, 3000)] if rng.random() < 0.3 else out


@pytest.mark.parametrize("mode", ["reference", "icd"])
def test_windows_find_what_the_walk_finds(spark, mode):
    rng = random.Random(4)
    data = [record(rng) for _ in range(120)]
    rows = [("v", k, 0, len(x), False, bytearray(x), None) for k, x in enumerate(data)]
    df = spark.createDataFrame(rows, RECORD).repartition(5)
    want = archive.decode_records(df, segment_payload=mode)
    got = frames.reassemble(frames.frame_rows(df, mode))
    names = ["record_idx", "message_idx", "message_type", "channel", "sequence", "mjd", "ms", "n_segments", "payloads"]
    plain = lambda x: sorted((*r[:-1], tuple(map(bytes, r.payloads))) for r in x.select(*names).collect())
    assert plain(got) == plain(want) and want.where("n_segments > 1").count() > 10


def test_no_frames(spark):
    assert frames.reassemble(spark.createDataFrame([], frames.FRAMES)).count() == 0


def test_table_functions(spark):
    frames.register(spark)
    status = archive.message_bytes(2, L.write(L.STATUS, {"rda_status": 16}), 18000, 5)
    volume = archive.volume_bytes([status, status + status])
    spark.createDataFrame([("a", bytearray(volume)), ("n", None)], "id string, content binary").createOrReplaceTempView("frames_test")
    got = spark.sql("select t.id, r.record_idx, r.compressed, m.message_idx, m.message_type, m.ms, m.n_segments, length(m.payload) n from frames_test t, lateral squall_records(t.content) r, lateral squall_messages(r.data) m").collect()
    assert sorted(map(tuple, got)) == [("a", k, True, i, 2, 5, 1, L.FRAME_BYTES - L.HEADER_BYTES) for k, i in ((0, 0), (1, 0), (1, 1))]
    spark.createDataFrame([("bad", bytearray(b"short"))], "id string, content binary").createOrReplaceTempView("frames_bad")
    with pytest.raises(Exception, match="shorter than a volume header"):
        spark.sql("select r.* from frames_bad t, lateral squall_records(t.content) r").collect()


def test_maps_that_end_too_soon(spark):
    size = L.BYPASS_RADIALS * L.BYPASS_WORDS * 2
    payload = L.write(L.MAP_HEADER, {"map_date": 1, "map_minutes": 2, "n_segments": 2}) + b"\0\7" + b"x" * size + b"\0\10" + b"y" * 50
    df = spark.createDataFrame([("v", 0, 0, 13, [bytearray(payload[:5000]), bytearray(payload[5000:])])], "volume_id string, record_idx int, message_idx int, message_type int, payloads array<binary>")
    got = [(r.n_segments, r.number, bytes(r.bits)) for r in frames.bypass_segments(df).collect()]
    assert got == [(2, 7, b"x" * size)]


def maps(rng, mode):
    """A record of bypass maps in frames of any size: some cut short, begun anew, with orphans behind them or radials and other messages between, some with a late header."""
    size, out = L.BYPASS_RADIALS * L.BYPASS_WORDS * 2, b""
    odd = rng.random() < 0.4
    for k in range(rng.randrange(4)):
        whole = rng.randrange(3)
        body = b"".join(rng.randbytes(2 + size) for _ in range(whole)) + rng.randbytes(2 * rng.randrange(40))
        head = L.write(L.MAP_HEADER, {"map_date": 1, "map_minutes": 2, "n_segments": max(0, whole + rng.choice([0, 0, 1, -1]))})
        late = odd and rng.random() < 0.3
        parts, at = [rng.randbytes(2), head + body[:20]] if late else [head + body[:20]], 20
        while at < len(body):
            step = rng.choice([2404, 2404, 2 * rng.randrange(1202), 0])
            parts.append(body[at : at + step])
            at += step
        frames_ = [frame(13, len(parts), i + 1, x, k) for i, x in enumerate(parts)]
        if mode == "icd":
            frames_ = [f[:12] + ((16 + len(x)) // 2).to_bytes(2) + f[14:] for f, x in zip(frames_, parts, strict=True)]
        if rng.random() < 0.2:
            frames_ = frames_[: rng.randrange(len(frames_))]
        if rng.random() < 0.3:
            frames_.append(frame(rng.choice([13, 15]), 3, rng.choice([0, 2, 3]), b"orphan", k))
        if odd and rng.random() < 0.5:
            body = archive.radial_bytes({"mjd": 18000, "ms": k, "azimuth_number": k + 1, "elevation_number": 1}, {"REF": {"scale": 2.0, "offset": 66.0, "raw": [0, 1, 80 + k]}})
            frames_.insert(rng.randrange(len(frames_) + 1), archive.message_bytes(31, body, 18000, k, sequence=k))
        out += b"".join(frames_)
        if rng.random() < 0.3:
            out += archive.message_bytes(2, L.write(L.STATUS, {"rda_status": 16}), 18000, k)
    return out[: -rng.randrange(1, 3000)] if rng.random() < 0.2 else out


@pytest.mark.parametrize("mode", ["reference", "icd"])
def test_maps_of_records_in_one_pass(spark, mode):
    import bz2

    rng = random.Random(11)
    rows = []
    for k in range(90):
        data, packed = maps(rng, mode), k % 6 == 0
        rows.append((f"v{k}", k % 4, 0, len(data), packed, bytearray(b"\0\0\0\0" + bz2.compress(data) if packed else data), None))
    df = spark.createDataFrame([*rows, ("broken", 0, 0, 4, True, bytearray(b"nope"), None)], RECORD).repartition(3)
    plain = lambda x: sorted((*r[:-1], bytes(r.bits)) for r in x.collect())
    want = plain(frames.bypass_segments(archive.decode_records(df, "PERMISSIVE", mode)))
    assert plain(frames.record_bypass_segments(df, "PERMISSIVE", mode)) == want
    assert len(want) > 40 and len({r[2] for r in want}) > 2
    with pytest.raises(Exception, match="not compressed"):
        frames.record_bypass_segments(df, "FAILFAST", mode).collect()
    assert frames.record_bypass_segments(df.limit(0), segment_payload=mode).count() == 0


def test_numbers_of_maps_across_frames(spark):
    """A halfword that is cut by a frame's end, and segments without a byte."""
    size = L.BYPASS_RADIALS * L.BYPASS_WORDS * 2
    payload = L.write(L.MAP_HEADER, {"n_segments": 2}) + b"\1\2" + b"x" * size + b"\3\4" + b"y" * size
    cuts = [0, 6, 6, *range(1000, 6 + 2 + size, 2000), 6 + 2 + size + 1, *range(26_000, len(payload), 2400), len(payload)]
    parts = [payload[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    rows = [("v", 0, 0, 13, list(map(bytearray, parts)))]
    want = [(2, 0x102, b"x" * size), (2, 0x304, b"y" * size)]
    df = spark.createDataFrame(rows, "volume_id string, record_idx int, message_idx int, message_type int, payloads array<binary>")
    assert [(r.n_segments, r.number, bytes(r.bits)) for r in frames.bypass_segments(df).collect()] == want
    data, count, at = np.frombuffer(payload, np.uint8), np.array([len(parts)]), np.array(cuts[:-1])
    of, number, bits, n = columnar.bypass_maps(data, count, at, np.diff(cuts))
    assert [(int(n[k]), int(x), b) for k, x, b in zip(of, number, bits.to_pylist(), strict=True)] == want


def test_maps_go_to_python_once(spark):
    """The query's maps are written, cut, joined and read by one Python worker each; their frames don't go through the JVM."""
    from squall.plans import registry

    plan = registry.QUERIES["b09_segmented_reads"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
