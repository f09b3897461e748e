"""Nearest and bracketing radials, and products sampled from several tilts.

Each radial owns the arc around it that is nearer to it than to its neighbours.
Arcs are dealt to one-degree bins, so that points meet radials by an equi-join
on (field, bin) with a range condition, not by a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squall.functions.geo import EFFECTIVE_RADIUS_M, RadarSite, geo_to_polar
from squall.operators.contracts import AXIS, DIRECTIONS, PLACED, POINTS, checked
from squall.operators.fields import FIELD, VALID, InvalidParameter

_BINS = 360


@checked(gates=PLACED)
def radial_axis(gates: DataFrame) -> DataFrame:
    """One row per radial of each field, with the field's geometry."""
    return gates.groupBy(*FIELD, "az_idx").agg(
        F.first("azimuth_deg").alias("azimuth_deg"), F.first("elevation_deg").alias("elevation_deg"), F.first("az_spacing_deg").alias("az_spacing_deg"),
        F.first("first_gate_km").alias("first_gate_km"), F.first("gate_interval_km").alias("gate_interval_km"), (F.max("gate_idx") + 1).alias("n_gates"),
    )


def _ring(axis: DataFrame) -> DataFrame:
    """Adds the neighbours' azimuths, beyond 0 and 360 where the ring closes."""
    along = Window.partitionBy(*FIELD).orderBy("azimuth_deg", "az_idx")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lag, lead = F.lag("azimuth_deg").over(along), F.lead("azimuth_deg").over(along)
    return axis.withColumns(
        {
            "_before": F.coalesce(lag, F.last("azimuth_deg").over(whole) - 360.0), "_after": F.coalesce(lead, F.first("azimuth_deg").over(whole) + 360.0),
            "_next_idx": F.coalesce(F.lead("az_idx").over(along), F.first("az_idx").over(whole)),
        }
    )


def _dealt(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows for each one-degree bin of the arc, and once more a turn up or down where it passes 0 or 360."""
    turns = df.withColumn("_turn", F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0))))
    turns = turns.withColumns({lo: F.col(lo) + F.col("_turn"), hi: F.col(hi) + F.col("_turn")}).where((F.col(hi) >= 0) & (F.col(lo) < 360))
    first, last = F.greatest(F.floor(lo), F.lit(0)), F.least(F.floor(hi), F.lit(_BINS - 1))
    return turns.withColumn("_bin", F.explode(F.sequence(first, last))).drop("_turn")


@checked(points=DIRECTIONS, axis=AXIS)
def nearest_radial(points: DataFrame, axis: DataFrame) -> DataFrame:
    """points(volume_id, sweep_idx, azimuth_deg in [0, 360), …) with az_idx and distance_deg of the nearest radial; ties go to the lower azimuth."""
    arcs = _ring(axis).withColumns({"_lo": (F.col("_before") + F.col("azimuth_deg")) / 2, "_hi": (F.col("azimuth_deg") + F.col("_after")) / 2})
    arcs = _dealt(arcs.select(*[F.col(k).alias(f"_{k}") for k in FIELD], "az_idx", F.col("azimuth_deg").alias("_az"), "_lo", "_hi"), "_lo", "_hi")
    p = points.withColumn("_pbin", F.floor("azimuth_deg"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in FIELD]
    cond = (F.col("azimuth_deg") > F.col("_lo")) & (F.col("azimuth_deg") <= F.col("_hi"))
    joined = p.join(arcs, [*on, F.col("_pbin") == F.col("_bin"), cond])
    gap = F.abs(F.col("azimuth_deg") - F.col("_az"))
    return joined.withColumn("distance_deg", F.least(gap, 360.0 - gap)).select(*points.columns, "az_idx", "distance_deg")


@checked(points=DIRECTIONS, axis=AXIS)
def bracketing_radials(points: DataFrame, axis: DataFrame, max_gap: float | None = None) -> DataFrame:
    """points with the radials on either side (lo_idx, hi_idx) and the fraction between; arcs over max_gap (1.5 spacings) hold none."""
    arcs = _ring(axis).withColumns({"_lo": F.col("azimuth_deg"), "_hi": F.col("_after")})
    gap = F.lit(max_gap) if max_gap is not None else F.col("az_spacing_deg") * 1.5
    arcs = arcs.where((F.col("_hi") - F.col("_lo") <= gap) & (F.col("_hi") > F.col("_lo")))
    arcs = _dealt(arcs.select(*[F.col(k).alias(f"_{k}") for k in FIELD], F.col("az_idx").alias("lo_idx"), F.col("_next_idx").alias("hi_idx"), "_lo", "_hi"), "_lo", "_hi")
    p = points.withColumn("_pbin", F.floor("azimuth_deg"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in FIELD]
    cond = (F.col("azimuth_deg") > F.col("_lo")) & (F.col("azimuth_deg") <= F.col("_hi"))
    joined = p.join(arcs, [*on, F.col("_pbin") == F.col("_bin"), cond])
    return joined.withColumn("fraction", (F.col("azimuth_deg") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).select(*points.columns, "lo_idx", "hi_idx", "fraction")


@checked(points=POINTS, gates=PLACED)
def sample(points: DataFrame, gates: DataFrame, max_gap_spacings: float | None = None) -> DataFrame:
    """points(volume_id, sweep_idx, azimuth_deg, range_km, …) with az_idx, gate_idx, value and status there.

    Points outside the field's range, and beyond a gap if one is given, are left out.
    """
    axis = radial_axis(gates)
    field = axis.groupBy(*[F.col(k).alias(f"_{k}") for k in FIELD]).agg(
        F.first("first_gate_km").alias("_first"), F.first("gate_interval_km").alias("_step"), F.max("n_gates").alias("_n"), F.first("az_spacing_deg").alias("_spacing")
    )
    p = points.join(field, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in FIELD]).drop(*[f"_{k}" for k in FIELD])
    p = p.where((F.col("range_km") >= F.col("_first")) & (F.col("range_km") < F.col("_first") + F.col("_n") * F.col("_step")))
    p = p.withColumn("gate_idx", F.floor((F.col("range_km") - F.col("_first")) / F.col("_step")).cast("int"))
    near = nearest_radial(p, axis)
    if max_gap_spacings is not None:
        near = near.where(F.col("distance_deg") <= F.col("_spacing") * max_gap_spacings)
    g = gates.select(*[F.col(k).alias(f"_{k}") for k in [*FIELD, "az_idx", "gate_idx"]], "value", "status")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*FIELD, "az_idx", "gate_idx"]]
    return near.join(g, on).select(*points.columns, "az_idx", "gate_idx", "distance_deg", "value", "status")


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    if width < 1 or height < 1:
        raise InvalidParameter("the grid needs rows and columns")
    return spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))


@checked(gates=PLACED)
def composite(gates: DataFrame, site: RadarSite, extent: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """Greatest valid value over all tilts of a volume per cell of a (min lat, min lon, max lat, max lon) grid; row 0 is north.

    Cells without any valid value are left out.
    """
    south, west, north, east = extent
    if width < 1 or height < 1:
        raise InvalidParameter("the grid needs rows and columns")
    tilts = gates.groupBy(*FIELD).agg(F.first("elevation_deg").alias("elevation_deg"))
    # a point per cell and tilt: what the product is asked for; dealt anew, as a few tilts make them all
    points = tilts.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))))
    points = points.withColumns({"row": F.floor(F.col("_cell") / width).cast("int"), "col": (F.col("_cell") % width).cast("int")})
    points = points.withColumns(
        {"latitude": F.lit(north) - (F.col("row") + 0.5) / height * (north - south), "longitude": F.lit(west) + (F.col("col") + 0.5) / width * (east - west)}
    )
    polar = geo_to_polar(F.col("latitude"), F.col("longitude"), F.col("elevation_deg"), site)
    found = sample(points.withColumns(polar).select(*FIELD, "row", "col", "azimuth_deg", "range_km"), gates)
    return found.where(F.col("status") == VALID).groupBy("volume_id", "row", "col").agg(F.max("value").alias("value"))


@checked(gates=PLACED)
def vertical_section(gates: DataFrame, azimuth: float, max_range_km: float, max_altitude_m: float, width: int, height: int) -> DataFrame:
    """Greatest valid value over all tilts per cell of a distance-height grid at one azimuth; row 0 is the top."""
    if max_range_km <= 0 or max_altitude_m <= 0:
        raise InvalidParameter("range and altitude must be positive")
    if width < 1 or height < 1:
        raise InvalidParameter("the grid needs rows and columns")
    tilts = gates.groupBy(*FIELD).agg(F.first("elevation_deg").alias("elevation_deg"))
    points = tilts.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("range_km", (F.col("col") + 0.5) / width * max_range_km)
    altitude = (F.col("range_km") * F.sin(F.radians("elevation_deg")) + F.col("range_km") * F.col("range_km") / (2.0 * EFFECTIVE_RADIUS_M / 1000.0)) * 1000.0
    points = points.withColumn("altitude_m", altitude).where((F.col("altitude_m") >= 0) & (F.col("altitude_m") <= max_altitude_m))
    points = points.withColumn("row", F.floor((F.lit(float(max_altitude_m)) - F.col("altitude_m")) / max_altitude_m * height).cast("int")).where(F.col("row") < height)
    points = points.withColumn("azimuth_deg", F.lit(float(azimuth)))
    found = sample(points.select(*FIELD, "row", "col", "azimuth_deg", "range_km"), gates)
    return found.where(F.col("status") == VALID).groupBy("volume_id", "row", "col").agg(F.max("value").alias("value"))


def grid_cell(latitude, longitude, extent: tuple[float, float, float, float], width: int, height: int) -> dict:
    """Row and column of a position in a grid, clamped at the far edges; null outside."""
    south, west, north, east = extent
    inside = latitude.between(south, north) & longitude.between(west, east)
    row = F.least(F.floor((F.lit(north) - latitude) / (north - south) * height), F.lit(height - 1))
    col = F.least(F.floor((longitude - F.lit(west)) / (east - west) * width), F.lit(width - 1))
    return {"row": F.when(inside, row.cast("int")), "col": F.when(inside, col.cast("int"))}
