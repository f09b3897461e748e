"""Sweeps and gate fields.

A gates table has one row per gate: volume_id, sweep_idx, elevation_deg, az_idx,
azimuth_deg, az_spacing_deg, gate_idx, first_gate_km, gate_interval_km, value
(null unless valid) and status.  A field is one product of one sweep; operators
work on any number of fields at once, per (volume_id, sweep_idx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squall.operators.contracts import KEY, RADIALS, checked, require_moment

FIELD = ["volume_id", "sweep_idx"]
VALID, BELOW, FOLDED, NO_DATA = "Valid", "BelowThreshold", "RangeFolded", "NoData"
CFP_STATUS = {0: "FilterNotApplied", 1: "PointClutterFilterApplied", 2: "DualPolOnlyFilterApplied"}

# Fixed values: (name, label, unit, least, most) of each product.
PRODUCTS = (
    ("REF", "Reflectivity", "dBZ", -32.0, 95.0),
    ("VEL", "Velocity", "m/s", -64.0, 64.0),
    ("SW", "Spectrum Width", "m/s", 0.0, 30.0),
    ("ZDR", "Differential Reflectivity", "dB", -2.0, 6.0),
    ("PHI", "Differential Phase", "°", 0.0, 360.0),
    ("RHO", "Correlation Coefficient", "", 0.0, 1.0),
    ("CFP", "Clutter Filter Power", "dB", -20.0, 20.0),
)


class InvalidParameter(ValueError):
    """A parameter out of its range."""


class InvalidGeometry(ValueError):
    """Fields that do not fit together, or an empty one."""


class MissingData(ValueError):
    """Something that an operator needs is not there."""


#: What a moment of a radial has, whatever its product: one struct column per product.
MOMENT_FIELDS = ("gate_count", "first_gate_km", "gate_interval_km", "word_size", "scale", "offset", "raw")


def moment_columns(product: str) -> dict[str, Column]:
    """The parts of a product's moment as columns, null where a radial lacks it."""
    if product not in {p[0] for p in PRODUCTS}:
        raise InvalidParameter(f"no such product: {product}")
    return {name: F.col(f"{product}.{name}") for name in MOMENT_FIELDS}


def moment_value(raw: Column, scale, offset) -> Column:
    """Decoded value: 0 and 1 are codes, scale 0 means that the raw number is the value."""
    scale, offset = (x if isinstance(x, Column) else F.lit(float(x)) for x in (scale, offset))
    return F.when(scale == 0, raw.cast("double")).when(raw >= 2, (raw - offset) / scale)


def moment_status(raw: Column, scale) -> Column:
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.when(scale == 0, VALID).when(raw == 0, BELOW).when(raw == 1, FOLDED).otherwise(VALID)


def cfp_value(raw: Column, scale, offset) -> Column:
    """Clutter filter power: 0 to 7 are codes, whatever the scale."""
    scale, offset = (x if isinstance(x, Column) else F.lit(float(x)) for x in (scale, offset))
    return F.when(raw >= 8, F.when(scale == 0, raw.cast("double")).otherwise((raw - offset) / scale))


def cfp_status(raw: Column, scale=None) -> Column:
    out = F.when(raw >= 8, VALID)
    for code, name in CFP_STATUS.items():
        out = out.when(raw == code, name)
    return out.otherwise(F.concat(F.lit("Reserved("), raw.cast("string"), F.lit(")")))


@checked(radials={"elevation_number": "number"})
def segment_sweeps(radials: DataFrame, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """Adds sweep_idx: a new sweep begins whenever elevation_number changes in order."""
    along = Window.partitionBy(*(partition or ["volume_id"])).orderBy(*order)
    changed = F.coalesce((F.col("elevation_number") != F.lag("elevation_number").over(along)).cast("int"), F.lit(0))
    return radials.withColumn("_new", changed).withColumn("sweep_idx", F.sum("_new").over(along).cast("int")).drop("_new")


@checked(radials={**KEY, "elevation_number": "number", "elevation_deg": "number", "time_ms": "number"})
def sweep_summary(radials: DataFrame) -> DataFrame:
    """Per sweep: elevation number, median elevation angle, radials and time range."""
    return radials.groupBy(*FIELD).agg(
        F.min("elevation_number").alias("elevation_number"), F.expr("percentile(elevation_deg, 0.5)").alias("elevation_deg"), F.count(F.lit(1)).alias("n_radials"),
        F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"),
    )


@checked(sweeps={"elevation_deg": "number"})
def sweeps_at_elevation(sweeps: DataFrame, degrees: float) -> DataFrame:
    return sweeps.where(F.abs(F.col("elevation_deg") - degrees) < 0.05)


@checked(a={"azimuth_number": "whole", "elevation_number": "whole"}, b={"azimuth_number": "whole", "elevation_number": "whole"})
def merge_sweeps(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Radials of two sweeps (or of two per key) by azimuth number; differing elevations raise when the rows are read."""
    by = by or []
    both = a.unionByName(b)
    span = both.groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(F.min("elevation_number").alias("_lo"), F.max("elevation_number").alias("_hi"))
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    checked_ = both.join(span if by else F.broadcast(span), same).withColumn(
        "elevation_number", F.when(F.col("_lo") == F.col("_hi"), F.col("elevation_number")).otherwise(F.raise_error(F.lit("elevations differ")).cast("int"))
    )
    return checked_.drop("_lo", "_hi", *[f"_{k}" for k in by]).orderBy(*by, "azimuth_number")


@checked(radials=RADIALS)
def extract_field(radials: DataFrame, product: str) -> DataFrame:
    """Gates of one product of every sweep that has it.

    radials: one row per radial with a column per product, each a struct of
    gate_count, first_gate_km, gate_interval_km, scale, offset and raw
    (array<int>).  Radials are put in azimuth order; rows without the product
    are left out; the first such radial's gate count holds for all.
    """
    have = require_moment(radials, product, "extract_field: radials").where(F.col(product).isNotNull())
    along = Window.partitionBy(*FIELD).orderBy("azimuth_deg", "ordinal")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    in_file = Window.partitionBy(*FIELD).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    have = have.withColumn("az_idx", (F.row_number().over(along) - 1).cast("int"))
    have = have.withColumn("_n", F.first(F.col(product)["gate_count"]).over(whole)).withColumn("_e", F.first("elevation_deg").over(in_file))
    m = F.col(product)
    codes = F.slice(F.concat(m["raw"], F.array_repeat(F.lit(None).cast("int"), F.greatest(F.col("_n") - F.size(m["raw"]), F.lit(0)))), F.lit(1), F.col("_n"))
    out = have.select(
        *FIELD, F.col("_e").alias("elevation_deg"), "az_idx", "azimuth_deg", F.col("azimuth_spacing_deg").alias("az_spacing_deg"),
        m["first_gate_km"].alias("first_gate_km"), m["gate_interval_km"].alias("gate_interval_km"), m["scale"].alias("_scale"), m["offset"].alias("_offset"),
        F.posexplode(codes).alias("gate_idx", "_raw"),
    )
    value, status = (cfp_value, cfp_status) if product == "CFP" else (moment_value, moment_status)
    as_status = status(F.col("_raw"), F.col("_scale"))
    if product == "CFP":  # codes of the filter are no data in fields
        as_status = F.when(as_status == VALID, VALID).otherwise(NO_DATA)
    out = out.withColumn("value", value(F.col("_raw"), F.col("_scale"), F.col("_offset"))).withColumn("status", F.when(F.col("_raw").isNull(), NO_DATA).otherwise(as_status))
    return out.drop("_raw", "_scale", "_offset")


@checked(gates=KEY)
def first_field(gates: DataFrame) -> DataFrame:
    """The field of each volume's first sweep."""
    first = gates.groupBy(F.col("volume_id").alias("_v")).agg(F.min("sweep_idx").alias("_s"))
    return gates.join(first, F.col("volume_id").eqNullSafe(F.col("_v")) & (F.col("sweep_idx") == F.col("_s"))).drop("_v", "_s")


def blank_like(gates: DataFrame) -> DataFrame:
    """The same grid without data."""
    return gates.withColumn("value", F.lit(None).cast("double")).withColumn("status", F.lit(NO_DATA))


def blank_field(spark, azimuths: int, gates: int, spacing: float, first_km: float, interval_km: float, elevation: float, volume: str = "blank", sweep: int = 0) -> DataFrame:
    """A grid of given size without data."""
    if azimuths <= 0 or gates <= 0:
        raise InvalidGeometry("a field needs azimuths and gates")
    cell = spark.range(azimuths * gates)
    return cell.select(
        F.lit(volume).alias("volume_id"), F.lit(sweep).alias("sweep_idx"), F.lit(elevation).alias("elevation_deg"), F.floor(F.col("id") / gates).cast("int").alias("az_idx"),
        (F.floor(F.col("id") / gates) * F.lit(spacing)).alias("azimuth_deg"), F.lit(spacing).alias("az_spacing_deg"), (F.col("id") % gates).cast("int").alias("gate_idx"),
        F.lit(first_km).alias("first_gate_km"), F.lit(interval_km).alias("gate_interval_km"), F.lit(None).cast("double").alias("value"), F.lit(NO_DATA).alias("status"),
    )


@checked(gates={"value": "number", "status": "text"})
def value_range(gates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Least and greatest valid value per field; null without any."""
    valid = F.when(F.col("status") == VALID, F.col("value"))
    return gates.groupBy(*(by or FIELD)).agg(F.min(valid).alias("min_value"), F.max(valid).alias("max_value"))


def range_km() -> Column:
    return F.col("first_gate_km") + F.col("gate_idx") * F.col("gate_interval_km")


def max_range_km(first_km: Column, interval_km: Column, gates: Column) -> Column:
    return first_km + gates * interval_km
