"""Colour scales, lookup tables, rasters and PNG files."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.functions.geo import RadarSite, pixel_to_polar, polar_to_geo
from squall.shipping import ship
from squall.operators.contracts import PLACED, checked
from squall.operators.fields import FIELD, PRODUCTS, VALID, InvalidParameter
from squall.operators.sampling import bracketing_radials, grid, radial_axis, sample

# Fixed values: (least value, red, green, blue) of each product's discrete scale.
SCALES = {
    "REF": (
        (0.0, 0.0, 0.0, 0.0), (5.0, 0.0, 1.0, 1.0), (10.0, 0.5294, 0.8078, 0.9216), (15.0, 0.0, 0.0, 1.0), (20.0, 0.0, 1.0, 0.0), (25.0, 0.1961, 0.8039, 0.1961),
        (30.0, 0.1333, 0.5451, 0.1333), (35.0, 0.9333, 0.9333, 0.0), (40.0, 0.9333, 0.8627, 0.5098), (45.0, 0.9333, 0.4627, 0.1294), (50.0, 1.0, 0.1882, 0.1882),
        (55.0, 0.6902, 0.1882, 0.3765), (60.0, 0.6902, 0.1882, 0.3765), (65.0, 0.7294, 0.3333, 0.8275), (70.0, 1.0, 0.0, 1.0), (75.0, 1.0, 1.0, 1.0),
    ),
    "VEL": (
        (-64.0, 0.0, 0.3922, 0.0), (-48.0, 0.0, 0.5451, 0.0), (-32.0, 0.0, 0.8039, 0.0), (-16.0, 0.5647, 0.9333, 0.5647), (-4.0, 0.6627, 0.6627, 0.6627),
        (4.0, 0.6627, 0.6627, 0.6627), (16.0, 1.0, 0.7529, 0.7961), (32.0, 1.0, 0.4118, 0.4118), (48.0, 0.8039, 0.0, 0.0), (64.0, 0.5451, 0.0, 0.0),
    ),
    "SW": (
        (0.0, 0.502, 0.502, 0.502), (4.0, 0.0, 0.0, 0.8039), (8.0, 0.0, 0.8039, 0.8039), (12.0, 0.0, 0.8039, 0.0), (16.0, 0.9333, 0.9333, 0.0), (20.0, 1.0, 0.6471, 0.0),
        (25.0, 1.0, 0.0, 0.0),
    ),
    "ZDR": (
        (-2.0, 0.502, 0.0, 0.502), (-1.0, 0.0, 0.0, 0.8039), (0.0, 0.6627, 0.6627, 0.6627), (0.5, 0.5647, 0.9333, 0.5647), (1.5, 0.9333, 0.9333, 0.0),
        (2.5, 1.0, 0.6471, 0.0), (4.0, 1.0, 0.0, 0.0),
    ),
    "RHO": (
        (0.0, 0.0, 0.0, 0.0), (0.2, 0.3922, 0.0, 0.5882), (0.5, 0.0, 0.0, 0.8039), (0.7, 0.0, 0.5451, 0.5451), (0.85, 0.0, 0.8039, 0.4), (0.92, 0.0, 0.8039, 0.0),
        (0.96, 0.9333, 0.9333, 0.0), (0.98, 0.902, 0.902, 0.902),
    ),
    "PHI": (
        (0.0, 0.502, 0.0, 0.502), (45.0, 0.0, 0.0, 0.8039), (90.0, 0.0, 0.8039, 0.8039), (135.0, 0.0, 0.8039, 0.0), (180.0, 0.9333, 0.9333, 0.0), (225.0, 1.0, 0.6471, 0.0),
        (270.0, 1.0, 0.0, 0.0), (315.0, 1.0, 0.0, 1.0),
    ),
    "CFP": (
        (-20.0, 0.0, 0.0, 0.5451), (-10.0, 0.0, 0.0, 0.8039), (-5.0, 0.6784, 0.8471, 0.902), (-1.0, 0.6627, 0.6627, 0.6627), (1.0, 0.6627, 0.6627, 0.6627),
        (5.0, 1.0, 0.7529, 0.7961), (10.0, 1.0, 0.4118, 0.4118), (20.0, 0.8039, 0.0, 0.0),
    ),
}
RANGES = {name: (low, high) for name, _, _, low, high in PRODUCTS}
LUT_SIZE = 256


def discrete_color(value: Column, scale) -> dict[str, Column]:
    """Channels of the highest level at or below the value; below all, of the lowest; black without levels."""
    levels = sorted(scale, reverse=True)
    if not levels:
        return {c: F.lit(0.0) for c in "rgb"}
    out = {}
    for k, c in enumerate("rgb", 1):
        pick = F.when(value >= levels[0][0], F.lit(levels[0][k]))
        for level in levels[1:]:
            pick = pick.when(value >= level[0], F.lit(level[k]))
        out[c] = pick.otherwise(F.lit(levels[-1][k]))
    return out


def continuous_color(value: Column, stops) -> dict[str, Column]:
    """Channels between the stops around the value, straight lines; the ends hold beyond."""
    stops = sorted(stops)
    out = {}
    for k, c in enumerate("rgb", 1):
        pick = F.when(value <= stops[0][0], F.lit(stops[0][k]))
        for a, b in zip(stops[:-1], stops[1:], strict=True):
            pick = pick.when(value < b[0], F.lit(a[k]) + (value - a[0]) / (b[0] - a[0]) * (b[k] - a[k]))
        out[c] = pick.otherwise(F.lit(stops[-1][k]))
    return out


def color(value: Column, kind: str, levels) -> dict[str, Column]:
    """Channels by a scale of either kind: "discrete" steps or "continuous" lines."""
    if kind not in ("discrete", "continuous"):
        raise InvalidParameter(f"no such scale: {kind}")
    return (discrete_color if kind == "discrete" else continuous_color)(value, levels)


def to_byte(channel: Column) -> Column:
    """Truncated, not rounded."""
    return F.floor(channel * 255.0).cast("int")


def lut_index(value: Column, low, high, size: int = LUT_SIZE) -> Column:
    """Entry for a value: truncated, held within the table; 0 if the range is empty."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    place = F.when(high == low, F.lit(0.0)).otherwise((value - low) / (high - low) * (size - 1))
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor(place))).cast("int")


def lookup_table(spark: SparkSession, scale, low: float, high: float, size: int = LUT_SIZE) -> DataFrame:
    """(idx, value, r, g, b, a) with the colour of size evenly spaced values."""
    if size < 2:
        raise InvalidParameter("a table needs two entries")
    t = spark.range(size).select(F.col("id").cast("int").alias("idx"), (F.lit(low) + F.col("id") / (size - 1) * (high - low)).alias("value"))
    channels = {c: to_byte(v) for c, v in discrete_color(F.col("value"), scale).items()}
    return t.withColumns(channels).withColumn("a", F.lit(255))


def pixels(spark: SparkSession, size: int, max_range_km: float) -> DataFrame:
    """Pixels of a square image with azimuth and range of their whole coordinates."""
    return _polar_pixels(grid(spark, size, size).withColumnsRenamed({"row": "y", "col": "x"}), size, max_range_km)


def _polar_pixels(p: DataFrame, size: int, max_range_km: float, height: int | None = None) -> DataFrame:
    """Pixels with azimuth and range, null beyond the range."""
    return p.withColumns(pixel_to_polar(F.col("x"), F.col("y"), size, max_range_km, height))


@checked(gates=PLACED)
def render_sweep(gates: DataFrame, size: int, max_range_km: float, bilinear: bool = False, height: int | None = None) -> DataFrame:
    """Values per pixel of each field: nearest radial within 1.5 spacings, or between four valid gates where there are any."""
    fields = gates.select(*FIELD).distinct().withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(size * (height or size) - 1))))
    p = _polar_pixels(fields.withColumns({"y": F.floor(F.col("_cell") / size).cast("int"), "x": (F.col("_cell") % size).cast("int")}).drop("_cell"), size, max_range_km, height)
    p = p.where(F.col("range_km") < max_range_km)
    near = sample(p, gates, max_gap_spacings=1.5).where(F.col("status") == VALID).select(*FIELD, "y", "x", "value")
    if not bilinear:
        return near
    axis = radial_axis(gates)
    per = axis.groupBy(*[F.col(k).alias(f"_{k}") for k in FIELD]).agg(F.first("first_gate_km").alias("_first"), F.first("gate_interval_km").alias("_step"))
    q = p.join(per, [F.col(k) == F.col(f"_{k}") for k in FIELD]).withColumn("_g", (F.col("range_km") - F.col("_first")) / F.col("_step")).where(F.col("_g") >= 0)
    q = q.withColumn("_g0", F.floor("_g").cast("int")).drop(*[f"_{k}" for k in FIELD])
    q = bracketing_radials(q, axis)
    corners = q.withColumn("_corner", F.explode(F.array(*[F.struct(F.lit(f"v{a}{g}").alias("name"), F.col(("lo_idx", "hi_idx")[a]).alias("az"), (F.col("_g0") + g).alias("gate")) for a in (0, 1) for g in (0, 1)])))
    values = gates.where(F.col("status") == VALID).select(*[F.col(k).alias(f"_{k}") for k in FIELD], F.col("az_idx").alias("_az"), F.col("gate_idx").alias("_gate"), "value")
    got = corners.join(values, [*[F.col(k) == F.col(f"_{k}") for k in FIELD], F.col("_corner.az") == F.col("_az"), F.col("_corner.gate") == F.col("_gate")])
    four = got.groupBy(*FIELD, "y", "x").agg(F.first("fraction").alias("f"), F.first(F.col("_g") - F.col("_g0")).alias("h"), F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("_corner.name") == c, F.col("value"))).alias(c) for c in ("v00", "v01", "v10", "v11")])
    low, high = F.col("v00") + (F.col("v01") - F.col("v00")) * F.col("h"), F.col("v10") + (F.col("v11") - F.col("v10")) * F.col("h")
    smooth = four.where(F.col("n") == 4).select(*[F.col(k).alias(f"_{k}") for k in FIELD], F.col("y").alias("_y"), F.col("x").alias("_x"), (low + (high - low) * F.col("f")).alias("_smooth"))
    joined = near.join(smooth, [*[F.col(k) == F.col(f"_{k}") for k in FIELD], F.col("y") == F.col("_y"), F.col("x") == F.col("_x")], "full")
    return joined.select(*[F.coalesce(k, f"_{k}").alias(k) for k in [*FIELD, "y", "x"]], F.coalesce("_smooth", "value").alias("value"))


@checked(values={"value": "number"})
def color_pixels(values: DataFrame, product: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Adds r, g, b, a by the product's table (over the product's own range unless one is given)."""
    low, high = (RANGES[product][0] if low is None else low), (RANGES[product][1] if high is None else high)
    table = lookup_table(values.sparkSession, SCALES[product], low, high).select("idx", "r", "g", "b", "a")
    return values.withColumn("idx", lut_index(F.col("value"), low, high)).join(F.broadcast(table), "idx").drop("idx")  # LUT_SIZE rows


@dataclass(frozen=True)
class RenderOptions:
    """Width, height (as wide, if not given), background, sampling, and where the image lies; by default opaque black and nearest gates."""

    size: int
    background: tuple[int, int, int, int] = (0, 0, 0, 255)
    bilinear: bool = False
    height: int | None = None
    extent: tuple[float, float, float, float] | None = None  # least latitude and longitude, greatest latitude and longitude
    site: RadarSite | None = None

    def __post_init__(self):
        if self.size < 1 or self.height is not None and self.height < 1:
            raise InvalidParameter("an image needs pixels")
        if self.extent is not None and not (self.extent[0] <= self.extent[2] and self.extent[1] <= self.extent[3]):
            raise InvalidParameter("an extent's bounds are in order")

    @property
    def shape(self) -> tuple[int, int]:
        return self.size, self.height or self.size

    @classmethod
    def native_for(cls, gates: int) -> RenderOptions:
        """Two pixels per gate of the radius."""
        return cls(2 * gates)

    def transparent(self) -> RenderOptions:
        return replace(self, background=(0, 0, 0, 0))

    def with_background(self, r: int, g: int, b: int, a: int = 255) -> RenderOptions:
        return replace(self, background=(r, g, b, a))

    def with_bilinear(self) -> RenderOptions:
        return replace(self, bilinear=True)

    def with_interpolation(self, name: str) -> RenderOptions:
        if name not in ("nearest", "bilinear"):
            raise InvalidParameter(f"no such interpolation: {name}")
        return replace(self, bilinear=name == "bilinear")

    def with_size(self, width: int, height: int) -> RenderOptions:
        return replace(self, size=width, height=height)

    def with_extent(self, extent: tuple[float, float, float, float]) -> RenderOptions:
        return replace(self, extent=extent)

    def with_coordinate_system(self, site: RadarSite) -> RenderOptions:
        return replace(self, site=site)


def within_extent(values: DataFrame, max_range_km: float, options: RenderOptions) -> DataFrame:
    """Pixels of the image that lie inside the options' extent; all, if there is none."""
    if options.extent is None:
        return values
    if options.site is None:
        raise InvalidParameter("an extent needs a coordinate system")
    width, height = options.shape
    polar = pixel_to_polar(F.col("x"), F.col("y"), width, max_range_km, height)
    at = polar_to_geo(polar["azimuth_deg"], polar["range_km"], 0.0, options.site)
    south, west, north, east = options.extent
    return values.where(at["latitude"].between(south, north) & at["longitude"].between(west, east))


@checked(gates=PLACED)
def render_values(gates: DataFrame, max_range_km: float, options: RenderOptions) -> DataFrame:
    """Values per pixel by the options."""
    width, height = options.shape
    return within_extent(render_sweep(gates, width, max_range_km, options.bilinear, height), max_range_km, options)


@checked(gates=PLACED)
def render_images(gates: DataFrame, product: str, max_range_km: float, options: RenderOptions) -> DataFrame:
    """One PNG per field with the product's own scale."""
    return images(color_pixels(render_values(gates, max_range_km, options), product), *options.shape, options.background)


@checked(gates=PLACED)
def query_pixel(gates: DataFrame, x: int, y: int, size: int, max_range_km: float, site=None) -> DataFrame:
    """What stands at a pixel of each field: azimuth, range, value, status, and the position if a site is given."""
    p = gates.groupBy(*FIELD).agg(F.first("elevation_deg").alias("elevation_deg")).withColumns({"x": F.lit(x), "y": F.lit(y)})
    out = sample(_polar_pixels(p, size, max_range_km), gates)
    return out.withColumns(polar_to_geo(F.col("azimuth_deg"), F.col("range_km"), F.col("elevation_deg"), site)) if site else out


def png_bytes(width: int, height: int, rgba: bytes) -> bytes:
    """A PNG file of eight-bit RGBA pixels."""
    if len(rgba) != width * height * 4:
        raise InvalidParameter("pixels do not fill the image")

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    lines = b"".join(b"\0" + rgba[y * width * 4 : (y + 1) * width * 4] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def images(colored: DataFrame, width: int, height: int, background: tuple[int, int, int, int] = (0, 0, 0, 255)) -> DataFrame:
    """One PNG per field; an image's pixels are bounded by its size."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        from squall.operators.render import png_bytes

        out = np.tile(np.array(background, dtype=np.uint8), (height, width, 1))
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        for k, c in enumerate("rgba"):
            out[y, x, k] = table[c].to_numpy()
        return pa.table({"volume_id": table["volume_id"].slice(0, 1), "sweep_idx": table["sweep_idx"].slice(0, 1), "png": pa.array([png_bytes(width, height, out.tobytes())], pa.binary())})

    kinds = dict(colored.dtypes)
    return colored.groupBy(*FIELD).applyInArrow(run, f"volume_id {kinds['volume_id']}, sweep_idx {kinds['sweep_idx']}, png binary")


def png_pixels(data: bytes):
    """An array (height, width, 4) of the PNG files that ``png_bytes`` makes: eight-bit RGBA, lines unfiltered; checksums are looked at."""
    import numpy as np

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise InvalidParameter("no PNG file")
    at, size, packed = 8, None, b""
    while at < len(data):
        (n,), name = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(name + body):
            raise InvalidParameter(f"broken part {name!r}")
        if name == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed += body
        at += 12 + n
    if size is None or size[2:] != (8, 6, 0, 0, 0):
        raise InvalidParameter("not eight-bit RGBA")
    width, height = size[:2]
    lines = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(height, 1 + width * 4)
    if lines[:, 0].any():
        raise InvalidParameter("filtered lines")
    return lines[:, 1:].reshape(height, width, 4)


def image_pixels(images_: DataFrame) -> DataFrame:
    """Images (volume_id, sweep_idx, png) as rows: volume_id, sweep_idx, y, x, r, g, b, a."""
    kinds = dict(images_.dtypes)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from squall.operators.render import png_pixels

        for batch in batches:
            for k in range(batch.num_rows):
                pixels_ = png_pixels(batch.column(2)[k].as_py())
                height, width = pixels_.shape[:2]
                y, x = np.divmod(np.arange(height * width, dtype=np.int32), np.int32(width))
                keys = [pa.repeat(batch.column(i)[k], height * width) for i in (0, 1)]
                channels = [pa.array(pixels_[:, :, c].ravel().astype(np.int32)) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(y), pa.array(x), *channels], ["volume_id", "sweep_idx", "y", "x", "r", "g", "b", "a"])

    ddl = f"volume_id {kinds['volume_id']}, sweep_idx {kinds['sweep_idx']}, y int, x int, r int, g int, b int, a int"
    return ship(images_.sparkSession) and images_.select("volume_id", "sweep_idx", "png").mapInArrow(run, ddl)
