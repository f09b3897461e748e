"""Registered queries on sweeps, gates, samples, cells and rasters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from squall.functions import geo
from squall.operators import cells, fields, filters, render, sampling
from squall.plans import adapters as A
from squall.plans.adapters import CORRELATION, GATES, RAW, R

SITE = geo.RadarSite(35.3331, -97.2778, 370.0, 10.0)
EXTENT = (35.2, -97.45, 35.47, -97.1)
QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---- D: projections, filters ----


@add("d01_moment_decode", f"""select sweep_idx, status, count(*) n, round(min(value), 6) min_value, round(max(value), 6) max_value, round(sum(value), 6) sum_value
 from (select * from {GATES} where value is null or value >= -30e0) group by all""")
def d01(s, d):
    g = A.gates(s, d).where("value is null or value >= -30")
    return r6(g.groupBy("sweep_idx", "status").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.sum("value").alias("sum_value")), "min_value", "max_value", "sum_value")


@add("d02_cfp_decode", f"""select status, count(*) n, round(sum(value), 6) sum_value from (select case when raw2 >= 8 then (raw2 - 8e0) / 2e0 end as value, case when raw2 = 0 then 'FilterNotApplied'
 when raw2 = 1 then 'PointClutterFilterApplied' when raw2 = 2 then 'DualPolOnlyFilterApplied' when raw2 < 8 then 'Reserved(' || raw2 || ')' else 'Valid' end status from {RAW}) group by all""")
def d02(s, d):
    g = A.raw_gates(s, d).select(fields.cfp_value(F.col("raw2"), 2.0, 8.0).alias("value"), fields.cfp_status(F.col("raw2")).alias("status"))
    return r6(g.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum_value")), "sum_value")


@add("d01_unscaled_moment", f"select sweep_idx, count(*) n, round(sum(raw::double), 6) sum_value from {RAW} group by all")
def d01b(s, d):
    g = A.raw_gates(s, d).select("sweep_idx", fields.moment_value(F.col("raw"), 0.0, 33.0).alias("value"), fields.moment_status(F.col("raw"), 0.0).alias("status")).where("status = 'Valid'")
    return r6(g.groupBy("sweep_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum_value")), "sum_value")


def _radial_structs(s, d):
    """Radials with a reflectivity struct, in a shuffled file order, every fifth without it and gate counts that differ."""
    r = A.radials(s, d)
    raw = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 400.0).cast("int"))
    n = F.when(F.col("vec_id") % 3 == 0, 50).otherwise(64)
    m = F.struct(n.alias("gate_count"), F.lit(2.0).alias("first_gate_km"), F.lit(0.25).alias("gate_interval_km"), F.lit(8).alias("word_size"), F.lit(2.0).alias("scale"), F.lit(66.0).alias("offset"), F.slice(raw, F.lit(1), n).alias("raw"))
    return r.select("volume_id", "sweep_idx", "elevation_deg", "azimuth_deg", F.col("az_spacing_deg").alias("azimuth_spacing_deg"), (F.col("vec_id") * 7919 % 104729).alias("ordinal"), F.when(F.col("vec_id") % 5 > 0, m).alias("REF"))


_EXTRACTED = f"""(with r as (select *, vec_id * 7919 % 104729 ordinal, case when vec_id % 3 = 0 then 50 else 64 end own from {R} where vec_id % 5 > 0),
 k as (select *, (row_number() over (partition by sweep_idx order by azimuth_deg, ordinal) - 1)::int i, first(own) over (partition by sweep_idx order by azimuth_deg, ordinal) n from r)
 select sweep_idx, i az_idx, (g - 1)::int gate_idx, case when g <= own then floor(abs(embedding[g]::double) * 400e0)::int end raw from k, range(1, 65) t(g) where g <= n)"""


@add("d04_extract_field", f"""select sweep_idx, az_idx, gate_idx, case when raw >= 2 then (raw - 66e0) / 2e0 end as value,
 case when raw is null then 'NoData' when raw = 0 then 'BelowThreshold' when raw = 1 then 'RangeFolded' else 'Valid' end status from {_EXTRACTED}""")
def d04(s, d):
    return fields.extract_field(_radial_structs(s, d), "REF").select("sweep_idx", "az_idx", "gate_idx", "value", "status")


@add("d06_extract_fields", f"select sweep_idx, count(*) n_gates, (max(az_idx) + 1)::bigint n_radials, (max(gate_idx) + 1)::bigint n_range from {_EXTRACTED} group by all")
def d06(s, d):
    return fields.extract_field(_radial_structs(s, d), "REF").groupBy("sweep_idx").agg(F.count(F.lit(1)).alias("n_gates"), (F.max("az_idx") + 1).cast("long").alias("n_radials"), (F.max("gate_idx") + 1).cast("long").alias("n_range"))


@add("d07_first_field", f"select sweep_idx, count(*) n from {GATES} where sweep_idx = (select min(sweep_idx) from {GATES}) group by all")
def d07(s, d):
    return fields.first_field(A.gates(s, d)).groupBy("sweep_idx").agg(F.count(F.lit(1)).alias("n"))


@add("d08_sweeps_at_elevation", f"select sweep_idx, round(median(elevation_deg), 6) elevation_deg, count(*) n_radials from {R} group by all having abs(median(elevation_deg) - 2.5e0) < 0.05e0")
def d08(s, d):
    r = A.radials(s, d).withColumn("time_ms", F.col("vec_id"))
    return r6(fields.sweeps_at_elevation(fields.sweep_summary(r), 2.5).select("sweep_idx", "elevation_deg", "n_radials"), "elevation_deg")


@add("d09_threshold", f"""select sweep_idx, az_idx, gate_idx, case when status = 'Valid' and (value < -10e0 or value > 20e0) then null else value end as value,
 case when status = 'Valid' and (value < -10e0 or value > 20e0) then 'NoData' else status end status from {GATES}""")
def d09(s, d):
    return A.gates(s, d).transform(filters.threshold(-10.0, 20.0)).select("sweep_idx", "az_idx", "gate_idx", "value", "status")


_PRODUCT_ROWS = ",".join(f"({k}, '{n}', '{label}', '{u}', {lo}::double, {hi}::double)" for k, (n, label, u, lo, hi) in enumerate(fields.PRODUCTS))


@add("d11_product_table", f"select p_partkey, product, label, unit, p_size between low and high as fits from part join (values {_PRODUCT_ROWS}) t(k, product, label, unit, low, high) on k = p_partkey % 7")
def d11(s, d):
    """Parts as values of the seven products: what each is called, and whether the value lies in its range."""
    every = s.createDataFrame([(k, *row) for k, row in enumerate(fields.PRODUCTS)], "k int, product string, label string, unit string, low double, high double")
    p = A.read(s, d, "part").join(F.broadcast(every), F.col("p_partkey") % 7 == F.col("k"))
    return p.select("p_partkey", "product", "label", "unit", F.col("p_size").between(F.col("low"), F.col("high")).alias("fits"))


@add("d15_blank_field", f"select sweep_idx, status, count(*) n, count(value) n_values from (select sweep_idx, 'NoData' status, null::double as value from {GATES}) group by all")
def d15(s, d):
    return fields.blank_like(A.gates(s, d)).groupBy("sweep_idx", "status").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"))


@add("d15_new_empty", f"select g.az_idx::int az_idx, g.az_idx * 0.5e0 azimuth_deg, count(*) n, count(*) filter (g.status = 'Valid') n_valid_before from (select az_idx, gate_idx, any_value(status) status from {GATES} where sweep_idx = 0 group by all) g group by all")
def d15b(s, d):
    """A blank field of the first sweep's size, cell by cell beside it."""
    g = A.gates(s, d).where("sweep_idx = 0").select(F.col("az_idx").alias("a"), F.col("gate_idx").alias("k"), F.col("status").alias("before"))
    size = g.agg((F.max("a") + 1).alias("a"), (F.max("k") + 1).alias("k")).first()  # one row
    blank = fields.blank_field(s, size["a"], size["k"], 0.5, 2.0, 0.25, 0.5).where((F.col("status") == fields.NO_DATA) & F.col("value").isNull())
    both = blank.join(g, (F.col("az_idx") == F.col("a")) & (F.col("gate_idx") == F.col("k")))
    return both.groupBy("az_idx", "azimuth_deg").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("before") == "Valid", 1)).alias("n_valid_before"))


@add("d16_point_access", f"select sweep_idx, value, status from {GATES} where az_idx = 5 and gate_idx = 7")
def d16(s, d):
    return A.gates(s, d).where("az_idx = 5 and gate_idx = 7").select("sweep_idx", "value", "status")


# ---- E: joins ----


@add("e01_cc_mask", f"""select g.sweep_idx, g.status old_status, case when g.status = 'Valid' and c.status is not null and (c.status <> 'Valid' or c.value < 0.8e0) then 'NoData' else g.status end status,
 count(*) n, round(sum(case when g.status = 'Valid' and c.status is not null and (c.status <> 'Valid' or c.value < 0.8e0) then null else g.value end), 6) sum_value
 from {GATES} g left join (select * from {CORRELATION} where gate_idx < 60) c using (sweep_idx, az_idx, gate_idx) group by all""")
def e01(s, d):
    g = A.gates(s, d).withColumn("old_status", F.col("status"))
    m = g.transform(filters.correlation_mask(A.correlation(s, d).where("gate_idx < 60"), 0.8))
    return r6(m.groupBy("sweep_idx", "old_status", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum_value")), "sum_value")


def _points(s, d):
    c = A.read(s, d, "customer")
    return c.select(F.lit("emb").alias("volume_id"), (F.col("c_custkey") % 10).cast("int").alias("sweep_idx"), (F.col("c_custkey") * 0.7391 % 360.0).alias("azimuth_deg"), (F.col("c_custkey") % 200 * 0.1 + 0.5).alias("range_km"), F.col("c_custkey").alias("p"))


_POINTS = "(select 'emb' volume_id, (c_custkey % 10)::int sweep_idx, (c_custkey * 0.7391e0 % 360e0) azimuth_deg, c_custkey % 200 * 0.1e0 + 0.5e0 range_km, c_custkey p from customer)"
_NEAR = f"""(select p, range_km, sweep_idx, arg_min(az_idx, struct_pack(d := d, a := az)) az_idx, min(d) d, min(az_spacing_deg) spacing from (select p, range_km, q.sweep_idx, az_idx, r.azimuth_deg az, az_spacing_deg,
 least(abs(q.azimuth_deg - r.azimuth_deg), 360e0 - abs(q.azimuth_deg - r.azimuth_deg)) d from {_POINTS} q join {R} r on q.sweep_idx = r.sweep_idx) group by all)"""


@add("e02_nearest_azimuth", f"select p, az_idx, round(d, 6) distance_deg from {_NEAR}")
def e02(s, d):
    return r6(sampling.nearest_radial(_points(s, d), sampling.radial_axis(A.gates(s, d))).select("p", "az_idx", "distance_deg"), "distance_deg")


_SAMPLED = f"""(select p, n.sweep_idx, n.az_idx, n.d, n.spacing, g.gate_idx, g.value, g.status from {_NEAR} n join {GATES} g on n.sweep_idx = g.sweep_idx and n.az_idx = g.az_idx
 and floor((range_km - 2e0) / 0.25e0) = g.gate_idx where range_km >= 2e0 and range_km < 18e0)"""


@add("e02_value_at_polar", f"select p, az_idx, gate_idx, value, status from {_SAMPLED}")
def e02b(s, d):
    return sampling.sample(_points(s, d), A.gates(s, d)).select("p", "az_idx", "gate_idx", "value", "status")


@add("e03_nearest_within_gap", f"""select p, az_idx, gate_idx from {_SAMPLED.replace("{R}", R).replace(R, f"(select * from {R} where az_idx % 9 > 3)")} where d <= spacing * 1.5e0""")
def e03(s, d):
    return sampling.sample(_points(s, d), A.gates(s, d).where("az_idx % 9 > 3"), 1.5).select("p", "az_idx", "gate_idx")


@add("e04_bracketing_radials", f"""with r as (select sweep_idx, az_idx lo_idx, azimuth_deg lo, coalesce(lead(az_idx) over w, 0)::int hi_idx, coalesce(lead(azimuth_deg) over w, 360e0) hi, az_spacing_deg from {R}
 window w as (partition by sweep_idx order by azimuth_deg)) select p, lo_idx, hi_idx, round((azimuth_deg - lo) / (hi - lo), 6) fraction
 from (select * replace (case when azimuth_deg = 0 then 360e0 else azimuth_deg end as azimuth_deg) from {_POINTS}) q join r on q.sweep_idx = r.sweep_idx
 and azimuth_deg > lo and azimuth_deg <= hi where hi - lo <= az_spacing_deg * 1.5e0""")
def e04(s, d):
    return r6(sampling.bracketing_radials(_points(s, d), sampling.radial_axis(A.gates(s, d))).select("p", "lo_idx", "hi_idx", "fraction"), "fraction")


@add("e09_pixel_cell", f"""select c_custkey, case when lat between {EXTENT[0]}e0 and {EXTENT[2]}e0 and lon between {EXTENT[1]}e0 and {EXTENT[3]}e0 then least(floor(({EXTENT[2]}e0 - lat) / ({EXTENT[2]}e0 - {EXTENT[0]}e0) * 40), 39)::int end as "row",
 case when lat between {EXTENT[0]}e0 and {EXTENT[2]}e0 and lon between {EXTENT[1]}e0 and {EXTENT[3]}e0 then least(floor((lon - {EXTENT[1]}e0) / ({EXTENT[3]}e0 - {EXTENT[1]}e0) * 30), 29)::int end col
 from (select c_custkey, 35.15e0 + c_custkey % 37 * 0.01e0 lat, -97.5e0 + c_custkey % 53 * 0.009e0 lon from customer)""")
def e09(s, d):
    c = A.read(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 37 * 0.01 + 35.15).alias("lat"), (F.col("c_custkey") % 53 * 0.009 - 97.5).alias("lon"))
    return c.select("c_custkey", *[v.alias(k) for k, v in sampling.grid_cell(F.col("lat"), F.col("lon"), EXTENT, 30, 40).items()])


# ---- F: aggregations ----


@add("f01_value_range", f"select sweep_idx, min(value) filter (status = 'Valid') min_value, max(value) filter (status = 'Valid') max_value from {GATES} group by all")
def f01(s, d):
    return fields.value_range(A.gates(s, d)).drop("volume_id")


@add("f02_median_elevation", f"select sweep_idx, round(median(elevation_deg + az_idx * 0.001e0), 6) elevation_deg from {R} group by all")
def f02(s, d):
    r = A.radials(s, d).withColumn("elevation_deg", F.col("elevation_deg") + F.col("az_idx") * 0.001).withColumn("time_ms", F.col("vec_id"))
    return r6(fields.sweep_summary(r).select("sweep_idx", "elevation_deg"), "elevation_deg")


@add("f03_time_range", f"select sweep_idx, count(*) n_radials, min(vec_id * 13) first_ms, max(vec_id * 13) last_ms from {R} group by all")
def f03(s, d):
    return fields.sweep_summary(A.radials(s, d).withColumn("time_ms", F.col("vec_id") * 13)).select("sweep_idx", "n_radials", "first_ms", "last_ms")


_W, _H = 24, 20
_POLAR = f"""select *, degrees(atan2(sin(dlon) * cos(lat2), cos(lat1) * sin(lat2) - sin(lat1) * cos(lat2) * cos(dlon))) + 360e0 b0,
 2e0 * 6371000e0 * atan2(sqrt(h), sqrt(1e0 - h)) / cos(radians(elevation_deg)) / 1000e0 range_km from (select *, pow(sin((lat2 - lat1) / 2e0), 2) + cos(lat1) * cos(lat2) * pow(sin(dlon / 2e0), 2) h
 from (select *, radians({SITE.latitude}e0) lat1, radians(latitude) lat2, radians(longitude) - radians({SITE.longitude}e0) dlon from pts))"""


def _sampled_sql(points: str) -> str:
    """points(sweep_idx, row, col, azimuth_deg, range_km): greatest valid value per cell."""
    return f"""with q as ({points}), near as (select q.sweep_idx, "row", col, range_km, arg_min(az_idx, struct_pack(d := least(abs(q.azimuth_deg - r.azimuth_deg), 360e0 - abs(q.azimuth_deg - r.azimuth_deg)), a := r.azimuth_deg)) az_idx
 from q join {R} r on q.sweep_idx = r.sweep_idx group by all) select "row", col, max(g.value) as value from near n join {GATES} g on n.sweep_idx = g.sweep_idx and n.az_idx = g.az_idx
 and floor((range_km - 2e0) / 0.25e0) = g.gate_idx where range_km >= 2e0 and range_km < 18e0 and status = 'Valid' group by all"""


@add("f04_composite", _sampled_sql(f"""with tilts as (select distinct sweep_idx, elevation_deg from {R}), pts as (select sweep_idx, elevation_deg, (c // {_W})::int as "row", (c % {_W})::int col,
 {EXTENT[2]}e0 - (c // {_W} + 0.5e0) / {_H} * ({EXTENT[2]}e0 - {EXTENT[0]}e0) latitude, {EXTENT[1]}e0 + (c % {_W} + 0.5e0) / {_W} * ({EXTENT[3]}e0 - {EXTENT[1]}e0) longitude from tilts, range({_W * _H}) t(c))
 select sweep_idx, "row", col, b0 % 360e0 azimuth_deg, range_km from ({_POLAR})"""))
def f04(s, d):
    return sampling.composite(A.gates(s, d), SITE, EXTENT, _W, _H).drop("volume_id")


@add("f05_vertical_section", _sampled_sql(f"""with c0 as (select sweep_idx, elevation_deg, c::int col, (c + 0.5e0) / 60 * 20e0 range_km from (select distinct sweep_idx, elevation_deg from {R}), range(60) t(c)),
 c1 as (select *, (range_km * sin(radians(elevation_deg)) + range_km * range_km / (2e0 * (6371000e0 * 4e0 / 3e0) / 1000e0)) * 1000e0 alt from c0)
 select sweep_idx, floor((1500e0 - alt) / 1500e0 * 25)::int as "row", col, 47.3e0 azimuth_deg, range_km from c1 where alt >= 0 and alt <= 1500e0 and floor((1500e0 - alt) / 1500e0 * 25) < 25"""))
def f05(s, d):
    return sampling.vertical_section(A.gates(s, d), 47.3, 20.0, 1500.0, 60, 25).drop("volume_id")


_CELLS = f"""g as (select sweep_idx, az_idx, gate_idx, value, azimuth_deg, elevation_deg, az_spacing_deg, az_idx * 64 + gate_idx id from {GATES} where status = 'Valid' and value >= 14e0),
 n as (select sweep_idx, max(az_idx) + 1 n from {R} group by all),
 e as (select a.sweep_idx, a.id a, b.id b from g a join n using (sweep_idx) join g b on a.sweep_idx = b.sweep_idx and ((a.gate_idx = b.gate_idx and (b.az_idx = (a.az_idx + 1) % n or a.az_idx = (b.az_idx + 1) % n))
  or (a.az_idx = b.az_idx and abs(a.gate_idx - b.gate_idx) = 1))),
 reach as (select sweep_idx, id a, id b from g union select r.sweep_idx, r.a, e.b from reach r join e on r.sweep_idx = e.sweep_idx and r.b = e.a),
 lab as (select sweep_idx, a id, min(b) cell from reach group by all)"""


@add("f06_storm_cells", f"with recursive {_CELLS} select sweep_idx, cell, count(*) gate_count, max(value) max_dbz, round(avg(value), 6) mean_dbz from lab join g using (sweep_idx, id) group by all having count(*) >= 3")
def f06(s, d):
    c = cells.storm_cells(A.gates(s, d), SITE, 14.0, 3)
    return r6(c.select("sweep_idx", "cell", "gate_count", "max_dbz", "mean_dbz"), "mean_dbz")


@add("f07_cell_properties", f"""with recursive {_CELLS}, p as (select *, 2e0 + gate_idx * 0.25e0 r, radians(azimuth_deg) az, radians(elevation_deg) el from lab join g using (sweep_idx, id)),
 h as (select *, sqrt(r * 1000e0 * r * 1000e0 + (6371000e0 * 4e0 / 3e0) * (6371000e0 * 4e0 / 3e0) + 2e0 * r * 1000e0 * (6371000e0 * 4e0 / 3e0) * sin(el)) - (6371000e0 * 4e0 / 3e0) + 380e0 h from p),
 a as (select *, (6371000e0 * 4e0 / 3e0) * asin(r * 1000e0 * cos(el) / ((6371000e0 * 4e0 / 3e0) + h)) / 6371000e0 dd from h),
 la as (select *, asin(sin(radians({SITE.latitude}e0)) * cos(dd) + cos(radians({SITE.latitude}e0)) * sin(dd) * cos(az)) la from a),
 lo as (select *, radians({SITE.longitude}e0) + atan2(sin(az) * sin(dd) * cos(radians({SITE.latitude}e0)), cos(dd) - sin(radians({SITE.latitude}e0)) * sin(la)) lo from la),
 c as (select sweep_idx, cell, max(value) max_dbz, round(sum(degrees(la) * value) / sum(value), 6) latitude, round(sum(degrees(lo) * value) / sum(value), 6) longitude, round(min(degrees(la)), 6) min_latitude,
 round(max(degrees(lo)), 6) max_longitude, round(sum(radians(az_spacing_deg) * r * 0.25e0), 6) area_km2, round(arg_min(azimuth_deg, struct_pack(v := -value, i := id)), 6) max_azimuth_deg from lo group by all having count(*) >= 3)
 select * exclude (cell), row_number() over (partition by sweep_idx order by max_dbz desc, cell) - 1 cell_id from c""")
def f07(s, d):
    c = cells.storm_cells(A.gates(s, d), SITE, 14.0, 3).withColumn("cell_id", F.col("cell_id").cast("long"))
    names = ["latitude", "longitude", "min_latitude", "max_longitude", "area_km2", "max_azimuth_deg"]
    return r6(c.select("sweep_idx", "max_dbz", *names, "cell_id"), *names)


# ---- G: neighbourhoods ----


@add("g01_median3x3", f"""with g as (select * from {GATES} where status = 'Valid'), n as (select sweep_idx, max(az_idx) + 1 n from {R} group by all),
 near as (select a.sweep_idx, a.az_idx, a.gate_idx, list_sort(list(b.value)) v from g a join n using (sweep_idx), range(-1, 2) x(i), range(-1, 2) y(j), g b
 where b.sweep_idx = a.sweep_idx and b.az_idx = (a.az_idx + i + n) % n and b.gate_idx = a.gate_idx + j group by all) select sweep_idx, az_idx, gate_idx, v[len(v) // 2 + 1] as value from near""")
def g01(s, d):
    return A.gates(s, d).transform(filters.median(3, 3)).where("status = 'Valid'").select("sweep_idx", "az_idx", "gate_idx", "value")


@add("g02_gaussian", f"""with g as (select * from {GATES} where status = 'Valid'), n as (select sweep_idx, max(az_idx) + 1 n from {R} group by all),
 near as (select a.sweep_idx, a.az_idx, a.gate_idx, exp(-0.5e0 * (pow(i / 0.6e0, 2) + pow(j / 0.6e0, 2))) w, b.value v from g a join n using (sweep_idx), range(-2, 3) x(i), range(-2, 3) y(j), g b
 where b.sweep_idx = a.sweep_idx and b.az_idx = (a.az_idx + i + n) % n and b.gate_idx = a.gate_idx + j) select sweep_idx, az_idx, gate_idx, round(sum(v * w) / sum(w), 6) as value from near group by all""")
def g02(s, d):
    return r6(A.gates(s, d).transform(filters.gaussian(0.6, 0.6)).where("status = 'Valid'").select("sweep_idx", "az_idx", "gate_idx", "value"), "value")


@add("g03_sweep_segmentation", """with r as (select vec_id, label + 1 e from embeddings), k as (select *, sum(case when lag = e or lag is null then 0 else 1 end) over (order by vec_id) sweep_idx
 from (select *, lag(e) over (order by vec_id) lag from r)) select sweep_idx::int sweep_idx, min(e)::int elevation_number, count(*) n_radials, min(vec_id) first_vec from k group by sweep_idx""")
def g03(s, d):
    r = A.read(s, d, "embeddings").select(F.lit("emb").alias("volume_id"), "vec_id", (F.col("label") + 1).alias("elevation_number"))
    return fields.segment_sweeps(r, ["vec_id"]).groupBy("sweep_idx").agg(F.min("elevation_number").alias("elevation_number"), F.count(F.lit(1)).alias("n_radials"), F.min("vec_id").alias("first_vec"))


@add("g08_cell_ranks", f"with recursive {_CELLS}, c as (select sweep_idx, cell, max(value) m, count(*) k from lab join g using (sweep_idx, id) group by all having count(*) >= 2) select sweep_idx, cell, row_number() over (partition by sweep_idx order by m desc, cell) - 1 cell_id from c")
def g08(s, d):
    return cells.storm_cells(A.gates(s, d), SITE, 14.0, 2).select("sweep_idx", "cell", F.col("cell_id").cast("long").alias("cell_id"))


# ---- H: sorts, set operations ----


@add("h01_azimuth_order", f"select sweep_idx, vec_id, (row_number() over (partition by sweep_idx order by azimuth_deg, vec_id) - 1) place from {R}")
def h01(s, d):
    w = Window.partitionBy("sweep_idx").orderBy("azimuth_deg", "vec_id")
    return A.radials(s, d).select("sweep_idx", "vec_id", (F.row_number().over(w) - 1).cast("long").alias("place"))


@add("h02_merge_sweeps", f"select sweep_idx, az_idx + 1 azimuth_number, elevation_number from {R}")
def h02(s, d):
    """Halves of every sweep, merged sweep by sweep."""
    r = A.radials(s, d).select("sweep_idx", (F.col("az_idx") + 1).alias("azimuth_number"), "elevation_number")
    return fields.merge_sweeps(r.where("azimuth_number % 2 = 0"), r.where("azimuth_number % 2 = 1"), ["sweep_idx"])


@add("h04_top_cells", f"with recursive {_CELLS}, c as (select sweep_idx, cell, max(value) max_dbz, count(*) gate_count from lab join g using (sweep_idx, id) group by all having count(*) >= 2) select * from c order by max_dbz desc, sweep_idx, cell limit 10")
def h04(s, d):
    return cells.storm_cells(A.gates(s, d), SITE, 14.0, 2).select("sweep_idx", "cell", "max_dbz", "gate_count").orderBy(F.desc("max_dbz"), "sweep_idx", "cell").limit(10)


@add("h05_union_radials", f"select sweep_idx, count(*) n from (select * from {R} where vec_id % 2 = 0 union all select * from {R} where vec_id % 2 = 1) group by all")
def h05(s, d):
    r = A.radials(s, d)
    return r.where("vec_id % 2 = 0").unionByName(r.where("vec_id % 2 = 1")).groupBy("sweep_idx").agg(F.count(F.lit(1)).alias("n"))


@add("h06_first_known_site", f"select sweep_idx, arg_min(vec_id, az_idx) filter (vec_id % 4 = 1) first_vec from {R} group by all")
def h06(s, d):
    r = A.radials(s, d).withColumn("known", F.when(F.col("vec_id") % 4 == 1, F.col("vec_id")))
    return r.groupBy("sweep_idx").agg(F.min_by("known", F.when(F.col("known").isNotNull(), F.col("az_idx"))).alias("first_vec"))


@add("f18_distinct_elevations", f"select round(elevation_deg * 10)::int e10, min(sweep_idx) first_sweep from {R} group by 1")
def f18(s, d):
    r = A.radials(s, d).withColumn("e10", F.round(F.col("elevation_deg") * 10).cast("int"))
    w = Window.partitionBy("e10").orderBy("sweep_idx", "az_idx")
    return r.withColumn("k", F.row_number().over(w)).where("k = 1").select("e10", F.col("sweep_idx").alias("first_sweep"))


# ---- I: geometry ----

_GEO = """h as (select *, sqrt(r * r + (6371000e0 * 4e0 / 3e0) * (6371000e0 * 4e0 / 3e0) + 2e0 * r * (6371000e0 * 4e0 / 3e0) * sin(el)) - (6371000e0 * 4e0 / 3e0) + 380e0 h from p),
 a as (select *, (6371000e0 * 4e0 / 3e0) * asin(r * cos(el) / ((6371000e0 * 4e0 / 3e0) + h)) / 6371000e0 dd from h),
 la as (select *, asin(sin(radians(35.3331e0)) * cos(dd) + cos(radians(35.3331e0)) * sin(dd) * cos(az)) la from a),
 lo as (select *, radians(-97.2778e0) + atan2(sin(az) * sin(dd) * cos(radians(35.3331e0)), cos(dd) - sin(radians(35.3331e0)) * sin(la)) lo from la)"""


@add("i01_polar_to_geo", f"with p as (select sweep_idx, az_idx, gate_idx, (2e0 + gate_idx * 2.5e0) * 1000e0 r, radians(azimuth_deg) az, radians(elevation_deg) el from {RAW}), {_GEO} select sweep_idx, az_idx, gate_idx, round(degrees(la), 6) latitude, round(degrees(lo), 6) longitude, round(h, 3) height_m from lo")
def i01(s, d):
    g = A.raw_gates(s, d).withColumns(geo.polar_to_geo(F.col("azimuth_deg"), F.lit(2.0) + F.col("gate_idx") * 2.5, F.col("elevation_deg"), SITE))
    return g.select("sweep_idx", "az_idx", "gate_idx", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), F.round("height_m", 3).alias("height_m"))


@add("i02_geo_to_polar", f"""with pts as (select c_custkey, 35e0 + c_custkey % 97 * 0.01e0 latitude, -98e0 + c_custkey % 89 * 0.013e0 longitude, 1.5e0 elevation_deg from customer)
 select c_custkey, round(b0 % 360e0, 6) azimuth_deg, round(range_km, 6) range_km from ({_POLAR})""")
def i02(s, d):
    c = A.read(s, d, "customer").select("c_custkey", (F.lit(35.0) + F.col("c_custkey") % 97 * 0.01).alias("lat"), (F.lit(-98.0) + F.col("c_custkey") % 89 * 0.013).alias("lon"))
    p = c.withColumns(geo.geo_to_polar(F.col("lat"), F.col("lon"), 1.5, SITE))
    return r6(p.select("c_custkey", "azimuth_deg", "range_km"), "azimuth_deg", "range_km")


@add("i03_sweep_extent", f"""with p as (select c_custkey n, (c_custkey % 230 + 1) * 1000e0 r, radians(az0) az, 0e0 el, az0 from customer, (values (0e0), (90e0), (180e0), (270e0)) v(az0)), {_GEO}
 select n c_custkey, round(max(degrees(la)) filter (az0 = 0), 6) max_latitude, round(max(degrees(lo)) filter (az0 = 90), 6) max_longitude, round(max(degrees(la)) filter (az0 = 180), 6) min_latitude,
 round(max(degrees(lo)) filter (az0 = 270), 6) min_longitude from lo group by n""")
def i03(s, d):
    p = A.read(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 230 + 1).cast("double").alias("range_km"))
    return r6(p.withColumns(geo.sweep_extent(F.col("range_km"), SITE)).drop("range_km"), "max_latitude", "max_longitude", "min_latitude", "min_longitude")


@add("i05_storm_relative_velocity", f"""select sweep_idx, az_idx, gate_idx, round(value - (15e0 * sin(radians(405e0)) * sin(radians(azimuth_deg)) + 15e0 * cos(radians(405e0)) * cos(radians(azimuth_deg))), 6) as value from {GATES} where status = 'Valid'""")
def i05(s, d):
    g = A.gates(s, d).where("status = 'Valid'")
    return g.select("sweep_idx", "az_idx", "gate_idx", F.round(geo.storm_relative(F.col("value"), F.col("azimuth_deg"), 225.0, 15.0), 6).alias("value"))


@add("i06_max_range", f"select sweep_idx, max(first_gate_km) + count(distinct gate_idx) * max(gate_interval_km) max_range_km from {RAW} group by all")
def i06(s, d):
    a = sampling.radial_axis(A.gates(s, d)).groupBy("sweep_idx").agg(F.max("first_gate_km").alias("f"), F.max("gate_interval_km").alias("i"), F.max("n_gates").alias("n"))
    return a.select("sweep_idx", fields.max_range_km(F.col("f"), F.col("i"), F.col("n")).alias("max_range_km"))


@add("i07_metres_to_km", "select p_partkey, p_size * 0.001e0 range_km from part")
def i07(s, d):
    return A.read(s, d, "part").select("p_partkey", (F.col("p_size") * 0.001).alias("range_km"))


@add("i09_pixel_to_polar", """with p as (select o_orderkey, (o_orderkey // 40 % 40)::int y, (o_orderkey % 40)::int x from orders), q as (select *, sqrt((x - 20e0) * (x - 20e0) + (y - 20e0) * (y - 20e0)) / (40 / 2e0 / 18e0) range_km, case when x = 20 and y = 20 then 180e0 else (degrees(atan2(x - 20e0, -(y - 20e0))) + 360e0) % 360e0 end azimuth_deg from p)
 select o_orderkey, case when range_km <= 18e0 then round(range_km, 6) end range_km, case when range_km <= 18e0 then round(azimuth_deg, 6) end azimuth_deg from q""")
def i09(s, d):
    p = A.read(s, d, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 40 % 40).cast("int").alias("y"), (F.col("o_orderkey") % 40).cast("int").alias("x"))
    return r6(p.withColumns(geo.pixel_to_polar(F.col("x"), F.col("y"), 40, 18.0)).drop("x", "y"), "range_km", "azimuth_deg")


@add("i09_polar_to_pixel", f"select p, round(20e0 + range_km * (20e0 / 18e0) * sin(radians(azimuth_deg)), 6) x, round(20e0 - range_km * (20e0 / 18e0) * cos(radians(azimuth_deg)), 6) y from {_POINTS}")
def i09b(s, d):
    p = _points(s, d)
    return r6(p.withColumns(geo.polar_to_pixel(F.col("azimuth_deg"), F.col("range_km"), 40, 18.0)).select("p", "x", "y"), "x", "y")


@add("i11_bilinear_grid", """with g as (select p_partkey k, p_size::double a, p_size * 2e0 b, p_size * 3e0 c, case when p_partkey % 9 > 0 then p_size * 5e0 end e, p_partkey % 10 * 0.1e0 fx, p_partkey % 7 * 0.1e0 fy from part)
 select k, round((a + (b - a) * fx) + ((c + (e - c) * fx) - (a + (b - a) * fx)) * fy, 6) as value from g""")
def i11(s, d):
    p = A.read(s, d, "part")
    z, k = F.col("p_size").cast("double"), F.col("p_partkey")
    return r6(p.select(k.alias("k"), geo.bilinear(z, z * 2.0, z * 3.0, F.when(k % 9 > 0, z * 5.0), k % 10 * 0.1, k % 7 * 0.1).alias("value")), "value")


# ---- K: rendering ----


def _scale_sql(value: str, product: str, channel: int) -> str:
    levels = sorted(render.SCALES[product], reverse=True)
    return "floor((case " + " ".join(f"when {value} >= {lv[0]}e0 then {lv[channel]}e0" for lv in levels) + f" else {levels[-1][channel]}e0 end) * 255e0)::int"


@add("k01_discrete_color", f"select sweep_idx, az_idx, gate_idx, {_scale_sql('value', 'REF', 1)} r, {_scale_sql('value', 'REF', 2)} g, {_scale_sql('value', 'REF', 3)} b from {GATES} where status = 'Valid'")
def k01(s, d):
    g = A.gates(s, d).where("status = 'Valid'")
    return g.select("sweep_idx", "az_idx", "gate_idx", *[render.to_byte(v).alias(c) for c, v in render.discrete_color(F.col("value"), render.SCALES["REF"]).items()])


@add("k02_continuous_color", f"""select sweep_idx, az_idx, gate_idx, round(case when value <= 0 then 0e0 when value < 30e0 then value / 30e0 when value < 60e0 then 1e0 + (value - 30e0) / 30e0 * -0.5e0 else 0.5e0 end, 6) r from {GATES} where status = 'Valid'""")
def k02(s, d):
    g = A.gates(s, d).where("status = 'Valid'")
    return g.select("sweep_idx", "az_idx", "gate_idx", F.round(render.continuous_color(F.col("value"), ((0.0, 0.0, 0.0, 0.0), (30.0, 1.0, 0.0, 0.0), (60.0, 0.5, 0.0, 0.0)))["r"], 6).alias("r"))


@add("k04_lookup_table", f"select o_orderkey, {_scale_sql('v', 'VEL', 1)} r, {_scale_sql('v', 'VEL', 2)} g, {_scale_sql('v', 'VEL', 3)} b, 255 a from (select o_orderkey, -64e0 + o_orderkey * 7 % 256 / 255e0 * 128e0 v from orders)")
def k04(s, d):
    """Orders coloured by places of a table of 256 entries."""
    table = render.lookup_table(s, render.SCALES["VEL"], -64.0, 64.0).drop("value")
    o = A.read(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7 % 256).cast("int").alias("place"))
    return o.join(F.broadcast(table), F.col("place") == F.col("idx")).select("o_orderkey", "r", "g", "b", "a")


@add("k04_lut_index", f"select sweep_idx, az_idx, gate_idx, greatest(0, least(255, floor((value + 32e0) / 127e0 * 255e0)))::int idx from {GATES} where status = 'Valid'")
def k04b(s, d):
    return A.gates(s, d).where("status = 'Valid'").select("sweep_idx", "az_idx", "gate_idx", render.lut_index(F.col("value"), -32.0, 95.0).alias("idx"))


_LEVELS = ",".join(f"({n}, '{p}', {k}, {lv[0]}::double, {lv[1]}::double, {lv[2]}::double, {lv[3]}::double)" for n, (p, scale) in enumerate(render.SCALES.items()) for k, lv in enumerate(scale))


@add("k05_builtin_scales", f"select p_partkey, product, max(place) place, arg_max(r, place) r, arg_max(g, place) g, arg_max(b, place) b from part join (values {_LEVELS}) t(n, product, place, least, r, g, b) on n = p_partkey % {len(render.SCALES)} and p_size >= least group by all")
def k05(s, d):
    """Parts as values of the built-in scales: the highest level that each reaches."""
    # a level holds up to the least value of all that are above it, so that a part meets one of them
    rows = [(n, p, k, *lv, min((x[0] for x in scale[k + 1 :]), default=float("inf"))) for n, (p, scale) in enumerate(render.SCALES.items()) for k, lv in enumerate(scale)]
    levels = s.createDataFrame(rows, "n int, product string, place int, least double, r double, g double, b double, below double")
    p = A.spread(A.read(s, d, "part").select("p_partkey", "p_size"), "p_partkey")
    p = p.join(F.broadcast(levels), (F.col("p_partkey") % len(render.SCALES) == F.col("n")) & (F.col("p_size") >= F.col("least")) & (F.col("p_size") < F.col("below")))
    top = F.max(F.struct("place", "r", "g", "b")).alias("top")
    return p.groupBy("p_partkey", "product").agg(top).select("p_partkey", "product", "top.place", "top.r", "top.g", "top.b")


_SIZE = 48
_PIXELS = f"""(select (c // {_SIZE})::int y, (c % {_SIZE})::int x, sqrt(pow(c % {_SIZE} - {_SIZE / 2}e0, 2) + pow(c // {_SIZE} - {_SIZE / 2}e0, 2)) / ({_SIZE / 2}e0 / 18e0) range_km,
 (degrees(atan2(c % {_SIZE} - {_SIZE / 2}e0, -(c // {_SIZE} - {_SIZE / 2}e0))) + 360e0) % 360e0 azimuth_deg from range({_SIZE * _SIZE}) t(c))"""
_RENDERED = f"""(with near as (select r.sweep_idx, y, x, range_km, arg_min(az_idx, struct_pack(d := least(abs(q.azimuth_deg - r.azimuth_deg), 360e0 - abs(q.azimuth_deg - r.azimuth_deg)), a := r.azimuth_deg)) az_idx from {_PIXELS} q, {R} r
 where range_km >= 2e0 and range_km < 18e0 group by all) select sweep_idx, y, x, g.value from near n join {GATES} g using (sweep_idx, az_idx) where floor((range_km - 2e0) / 0.25e0) = g.gate_idx and status = 'Valid')"""


@add("k09_render_sweep", f"select * from {_RENDERED}")
def k09(s, d):
    return render.render_sweep(A.gates(s, d), _SIZE, 18.0).select("sweep_idx", "y", "x", "value")


@add("k08_render_radials", f"""with v as (select *, greatest(0, least(255, floor((value + 32e0) / 127e0 * 255e0)))::int i from {_RENDERED}), c as (select *, -32e0 + i / 255e0 * 127e0 q from v)
 select sweep_idx, y, x, {_scale_sql('q', 'REF', 1)} r, {_scale_sql('q', 'REF', 2)} g, {_scale_sql('q', 'REF', 3)} b, 255 a from c""")
def k08(s, d):
    return render.color_pixels(render.render_sweep(A.gates(s, d), _SIZE, 18.0), "REF").select("sweep_idx", "y", "x", "r", "g", "b", "a")


_BILINEAR = f"""(with r as (select sweep_idx, az_idx lo_idx, azimuth_deg lo, coalesce(lead(az_idx) over w, 0)::int hi_idx, coalesce(lead(azimuth_deg) over w, 360e0) hi, az_spacing_deg from {R} window w as (partition by sweep_idx order by azimuth_deg)),
 q as (select sweep_idx, y, x, lo_idx, hi_idx, (az - lo) / (hi - lo) f, (range_km - 2e0) / 0.25e0 gf from (select *, case when azimuth_deg = 0 then 360e0 else azimuth_deg end az from {_PIXELS}) p join r on az > lo and az <= hi
  where hi - lo <= az_spacing_deg * 1.5e0 and range_km >= 2e0 and range_km < 18e0),
 v as (select * from {GATES} where status = 'Valid')
 select q.sweep_idx, y, x, (a.value + (b.value - a.value) * (gf - floor(gf))) + ((c.value + (e.value - c.value) * (gf - floor(gf))) - (a.value + (b.value - a.value) * (gf - floor(gf)))) * f as value from q
 join v a on a.sweep_idx = q.sweep_idx and a.az_idx = lo_idx and a.gate_idx = floor(gf) join v b on b.sweep_idx = q.sweep_idx and b.az_idx = lo_idx and b.gate_idx = floor(gf) + 1
 join v c on c.sweep_idx = q.sweep_idx and c.az_idx = hi_idx and c.gate_idx = floor(gf) join v e on e.sweep_idx = q.sweep_idx and e.az_idx = hi_idx and e.gate_idx = floor(gf) + 1)"""


@add("k09_render_bilinear", f"select sweep_idx, y, x, round(coalesce(b.value, n.value), 6) as value from {_RENDERED} n full join {_BILINEAR} b using (sweep_idx, y, x)")
def k09b(s, d):
    return render.render_sweep(A.gates(s, d), _SIZE, 18.0, bilinear=True).select("sweep_idx", "y", "x", F.round("value", 6).alias("value"))


@add("k10_render_cartesian", f"""with f as ({ORACLES['f04_composite']}) select y, x, f.value from (select (c // 60)::int y, (c % 60)::int x from range(3600) t(c)) p join f on f."row" = least(floor(y / 60e0 * {_H}), {_H - 1}) and f.col = least(floor(x / 60e0 * {_W}), {_W - 1})""")
def k10(s, d):
    field = sampling.composite(A.gates(s, d), SITE, EXTENT, _W, _H)
    return _raster(s, field, _W, _H, 60)


def _raster(s, field, width, height, size):
    p = sampling.grid(s, size, size).withColumnsRenamed({"row": "y", "col": "x"})
    p = p.withColumns({"_r": F.least(F.floor(F.col("y") / float(size) * height), F.lit(height - 1)), "_c": F.least(F.floor(F.col("x") / float(size) * width), F.lit(width - 1))})
    return p.join(field, (F.col("_r") == F.col("row")) & (F.col("_c") == F.col("col"))).select("y", "x", "value")


@add("k11_render_vertical", f"""with f as ({ORACLES['f05_vertical_section']}) select y, x, f.value from (select (c // 60)::int y, (c % 60)::int x from range(3600) t(c)) p join f on f."row" = least(floor(y / 60e0 * 25), 24) and f.col = least(floor(x / 60e0 * 60), 59)""")
def k11(s, d):
    return _raster(s, sampling.vertical_section(A.gates(s, d), 47.3, 20.0, 1500.0, 60, 25), 60, 25, 60)


@add("k13_query_pixel", f"select sweep_idx, y, x, value from {_RENDERED} where y = 20 and x = 30")
def k13(s, d):
    return render.render_sweep(A.gates(s, d), _SIZE, 18.0).where("y = 20 and x = 30").select("sweep_idx", "y", "x", "value")


@add("k14_png_images", f"""select sweep_idx, {_SIZE * _SIZE}::bigint n_pixels, count(*) n_drawn, sum({_scale_sql('v', 'REF', 1)})::bigint sum_r, sum({_scale_sql('v', 'REF', 2)})::bigint sum_g, sum({_scale_sql('v', 'REF', 3)})::bigint sum_b,
 count(*) n_same from (select sweep_idx, -32e0 + greatest(0, least(255, floor((value + 32e0) / 127e0 * 255e0))) / 255e0 * 127e0 v from {_RENDERED}) group by sweep_idx""")
def k14(s, d):
    """Images decoded again, pixel by pixel, beside what was drawn; the background is black."""
    colored = render.color_pixels(render.render_sweep(A.gates(s, d), _SIZE, 18.0), "REF")
    drawn = colored.select(F.col("sweep_idx").alias("s"), F.col("y").alias("dy"), F.col("x").alias("dx"), F.struct("r", "g", "b", "a").alias("ink"))
    p = render.image_pixels(render.images(colored, _SIZE, _SIZE)).withColumn("seen", F.struct("r", "g", "b", "a"))
    both = p.join(drawn, (F.col("sweep_idx") == F.col("s")) & (F.col("y") == F.col("dy")) & (F.col("x") == F.col("dx")), "left")
    black = (F.col("r") + F.col("g") + F.col("b") == 0) & (F.col("a") == 255)
    whole = both.withColumn("ok", F.when(F.col("s").isNull(), black).otherwise(F.to_json("seen") == F.to_json("ink")))
    return whole.where("ok").groupBy("sweep_idx").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.count("s").alias("n_drawn"), *[F.sum(c).alias(f"sum_{c}") for c in "rgb"], F.count(F.when(F.col("s").isNotNull(), 1)).alias("n_same")
    )


# ---- N: processors ----


@add("n04_sweep_pipeline", f"""select sweep_idx, count(*) n, round(sum(value), 6) sum_value from {GATES} where status = 'Valid' and value >= -20e0 and value <= 10e0 group by all""")
def n04(s, d):
    out = filters.SweepPipeline().then(filters.threshold(-20.0, None)).then(filters.threshold(None, 10.0)).execute(A.gates(s, d))
    return r6(out.where("status = 'Valid'").groupBy("sweep_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum_value")), "sum_value")


@add("n03_scan_derived_product", f"with f as ({ORACLES['f04_composite']}) select count(*) n_cells, max(value) max_value, min(value) min_value from f")
def n03(s, d):
    return sampling.composite(A.gates(s, d), SITE, EXTENT, _W, _H).agg(F.count(F.lit(1)).alias("n_cells"), F.max("value").alias("max_value"), F.min("value").alias("min_value"))
