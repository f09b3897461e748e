"""Operators on small hand-made grids."""

import math

import pytest
from pyspark.sql import functions as F

from squall.functions import geo, timing, wire
from squall.operators import cells, fields, filters, render, sampling

SITE = geo.RadarSite(35.3331, -97.2778, 370.0, 10.0)


def field(spark, rows, n_az=360, elevation=0.5, sweep=0, interval=0.25):
    """rows: (az_idx, gate_idx, value); one valid gate each."""
    data = [("v", sweep, elevation, a, a * 360.0 / n_az, 360.0 / n_az, g, 2.0, interval, None if v is None else float(v), "Valid" if v is not None else "NoData") for a, g, v in rows]
    return spark.createDataFrame(data, "volume_id string, sweep_idx int, elevation_deg double, az_idx int, azimuth_deg double, az_spacing_deg double, gate_idx int, first_gate_km double, gate_interval_km double, value double, status string")


def uniform(spark, value, n_az=12, n_gates=6, **more):
    return field(spark, [(a, g, value) for a in range(n_az) for g in range(n_gates)], n_az=n_az, **more)


def test_moment_values(spark):
    df = spark.createDataFrame([(0,), (1,), (50,), (100,)], "raw int")
    got = df.select(fields.moment_value(F.col("raw"), 2.0, 33.0), fields.moment_status(F.col("raw"), 2.0)).collect()
    assert [tuple(r) for r in got] == [(None, "BelowThreshold"), (None, "RangeFolded"), (8.5, "Valid"), (33.5, "Valid")]
    assert [r[0] for r in df.select(fields.moment_value(F.col("raw"), 0.0, 33.0)).collect()] == [0.0, 1.0, 50.0, 100.0]
    cfp = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 7, 8, 10)], "raw int").select(fields.cfp_value(F.col("raw"), 1.0, 0.0), fields.cfp_status(F.col("raw"))).collect()
    assert [r[0] for r in cfp] == [None] * 5 + [8.0, 10.0] and cfp[3][1] == "Reserved(3)"


def test_threshold_keeps_bounds(spark):
    f = field(spark, [(0, 0, 5.0), (0, 1, 4.9), (0, 2, 75.0), (0, 3, 75.1), (0, 4, None)])
    got = f.transform(filters.threshold(5.0, 75.0)).orderBy("gate_idx").select("status").collect()
    assert [r[0] for r in got] == ["Valid", "NoData", "Valid", "NoData", "NoData"]


def test_correlation_mask(spark):
    with pytest.raises(fields.InvalidParameter):
        filters.correlation_mask(None, 0.0)
    f = field(spark, [(0, g, 30.0) for g in range(4)])
    c = field(spark, [(0, 0, 0.99), (0, 1, 0.5), (0, 2, None)])
    got = f.transform(filters.correlation_mask(c, 0.9)).orderBy("gate_idx").select("status").collect()
    assert [r[0] for r in got] == ["Valid", "NoData", "NoData", "Valid"]
    with pytest.raises(fields.InvalidGeometry):
        filters.check_same_azimuths(uniform(spark, 1.0), uniform(spark, 1.0, n_az=11))


def test_median_removes_a_spike(spark):
    f = field(spark, [(a, g, 100.0 if (a, g) == (2, 2) else 30.0) for a in range(6) for g in range(6)], n_az=6)
    out = {(r.az_idx, r.gate_idx): r.value for r in f.transform(filters.median(3, 3)).collect()}
    assert set(out.values()) == {30.0}
    with pytest.raises(fields.InvalidParameter):
        filters.median(2, 3)
    assert filters.median(1, 1)(f) is f


def test_kernel_larger_than_the_ring(spark):
    out = uniform(spark, 7.0, n_az=2, n_gates=2).transform(filters.median(5, 5)).collect()
    assert {r.value for r in out} == {7.0}


def test_gaussian_of_uniform_is_uniform(spark):
    out = uniform(spark, 20.0).transform(filters.gaussian(1.0, 1.0)).collect()
    assert all(math.isclose(r.value, 20.0) for r in out)
    with pytest.raises(fields.InvalidParameter):
        filters.gaussian(0.0, 1.0)


def test_cells(spark):
    assert cells.storm_cells(uniform(spark, 20.0), SITE, 35.0).count() == 0
    wrap = field(spark, [(a, g, 40.0 if g == 3 and a in (358, 359, 0, 1, 2) else 10.0) for a in range(360) for g in range(5)])
    (cell,) = cells.storm_cells(wrap, SITE, 35.0).collect()
    assert cell.gate_count == 5 and cell.max_dbz == 40.0 and cell.cell_id == 0
    assert cells.storm_cells(field(spark, [(0, g, 60.0 if g == 2 else 10.0) for g in range(5)]), SITE, 35.0, 5).count() == 0


def test_labels_of_a_spiral():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(20):
        mask = rng.random((9, 11)) < 0.55
        label = cells.label_grid(mask)
        seen = np.full(mask.shape, -1)
        for a in range(9):
            for g in range(11):
                if mask[a, g] and seen[a, g] < 0:
                    stack = [(a, g)]
                    seen[a, g] = a * 11 + g
                    while stack:
                        x, y = stack.pop()
                        for u, v in (((x + 1) % 9, y), ((x - 1) % 9, y), (x, y + 1), (x, y - 1)):
                            if 0 <= v < 11 and mask[u, v] and seen[u, v] < 0:
                                seen[u, v] = a * 11 + g
                                stack.append((u, v))
        assert (label == seen).all()


def test_storm_relative_velocity(spark):
    df = spark.createDataFrame([(0.0,), (180.0,), (90.0,)], "az double").select(geo.storm_relative(F.lit(10.0), F.col("az"), 180.0, 10.0))
    assert [round(r[0], 6) for r in df.collect()] == [0.0, 20.0, 10.0]
    with pytest.raises(ValueError):
        geo.storm_relative(F.lit(1.0), F.lit(0.0), 0.0, -1.0)


def test_vertical_section_takes_the_greatest(spark):
    both = uniform(spark, 20.0, n_gates=200).unionByName(uniform(spark, 40.0, n_gates=200, sweep=1))
    out = sampling.vertical_section(both, 30.0, 40.0, 3000.0, 20, 10).collect()
    assert out and {r.value for r in out} == {40.0}
    with pytest.raises(fields.InvalidParameter):
        sampling.vertical_section(both, 30.0, 0.0, 3000.0, 20, 10)


def test_nearest_wraps_and_ties(spark):
    axis = sampling.radial_axis(field(spark, [(a, 0, 1.0) for a in range(4)], n_az=4))
    pts = spark.createDataFrame([("v", 0, x) for x in (0.0, 44.9, 45.0, 45.1, 315.1, 359.9)], "volume_id string, sweep_idx int, azimuth_deg double")
    got = {r.azimuth_deg: r.az_idx for r in sampling.nearest_radial(pts, axis).collect()}
    assert got == {0.0: 0, 44.9: 0, 45.0: 0, 45.1: 1, 315.1: 0, 359.9: 0}


def test_rendering_leaves_gaps(spark):
    half = field(spark, [(a, g, 30.0) for a in range(180) for g in range(60)])
    out = render.render_sweep(half, 40, 17.0).collect()
    assert out and all(r.x >= 19 for r in out)
    smooth = render.render_sweep(half, 40, 17.0, bilinear=True).collect()
    assert {round(r.value, 6) for r in smooth} == {30.0}


def test_colours(spark):
    df = spark.createDataFrame([(-50.0,), (5.0,), (7.0,), (99.0,)], "v double")
    c = render.discrete_color(F.col("v"), render.SCALES["REF"])
    assert [r[0] for r in df.select(render.to_byte(c["g"])).collect()] == [0, 255, 255, 255]
    assert df.select(render.lut_index(F.col("v"), 3.0, 3.0)).distinct().collect() == [(0,)]
    png = render.png_bytes(2, 1, bytes(8))
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and png.endswith(b"IEND" + b"\xaeB`\x82")


def test_timing(spark):
    df = spark.range(1)
    got = df.select(timing.sweep_duration(F.lit(21.149)), timing.sweep_duration(F.lit(0.0)), timing.sweep_gap(F.lit(0.5), F.lit(0.9)), timing.sweep_gap(F.lit(6.4), F.lit(15.7))).first()
    assert got[0] == pytest.approx(360 / 21.149 - 0.67) and got[1] is None and got[2] == pytest.approx(0.732) and got[3] == pytest.approx(1.444)
    delays = [r[0] for r in spark.range(6).select(timing.retry_delay_ms(F.col("id"))).orderBy("id").collect()]
    assert delays == [500, 500, 1000, 2000, 4000, None]


def test_segmentation_is_by_change(spark):
    r = spark.createDataFrame([("v", i, e) for i, e in enumerate([1, 1, 2, 2, 1])], "volume_id string, ordinal int, elevation_number int")
    assert [x.sweep_idx for x in fields.segment_sweeps(r, ["ordinal"]).orderBy("ordinal").collect()] == [0, 0, 1, 1, 2]


def test_merge_refuses_other_elevations(spark):
    a = spark.createDataFrame([(1, 1)], "azimuth_number int, elevation_number int")
    b = spark.createDataFrame([(2, 2)], "azimuth_number int, elevation_number int")
    with pytest.raises(Exception, match="elevations differ"):
        fields.merge_sweeps(a, b).collect()


def test_build_numbers(spark):
    got = spark.createDataFrame([(1900,), (190,), (2110,), (113,), (0,)], "raw int").select(wire.build_number(F.col("raw"))).collect()
    assert [r[0] for r in got] == [19.0, 19.0, 21.0, 11.3, 0.0]

