"""Beam geometry as Column functions (degrees, kilometres; heights in metres)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
EFFECTIVE_RADIUS_M = EARTH_RADIUS_M * 4.0 / 3.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class RadarSite:
    """Where the antenna stands: its height is ground plus tower."""

    latitude: float
    longitude: float
    height_m: float = 0.0
    tower_m: float = 0.0

    @property
    def antenna_m(self) -> float:
        return self.height_m + self.tower_m


def beam_height(range_km, elevation, antenna_m) -> Column:
    r = _c(range_km) * 1000.0
    e = F.lit(EFFECTIVE_RADIUS_M)
    return F.sqrt(r * r + e * e + 2.0 * r * e * F.sin(F.radians(_c(elevation)))) - e + _c(antenna_m)


def polar_to_geo(azimuth, range_km, elevation, site: RadarSite) -> dict[str, Column]:
    """Latitude, longitude and height of a gate, by a 4/3 earth and a great circle."""
    height = beam_height(range_km, elevation, site.antenna_m)
    arc = F.lit(EFFECTIVE_RADIUS_M) * F.asin(_c(range_km) * 1000.0 * F.cos(F.radians(_c(elevation))) / (F.lit(EFFECTIVE_RADIUS_M) + height))
    d = arc / F.lit(EARTH_RADIUS_M)
    lat0, lon0, az = F.radians(F.lit(site.latitude)), F.radians(F.lit(site.longitude)), F.radians(_c(azimuth))
    lat = F.asin(F.sin(lat0) * F.cos(d) + F.cos(lat0) * F.sin(d) * F.cos(az))
    lon = lon0 + F.atan2(F.sin(az) * F.sin(d) * F.cos(lat0), F.cos(d) - F.sin(lat0) * F.sin(lat))
    return {"latitude": F.degrees(lat), "longitude": F.degrees(lon), "height_m": height}


def geo_to_polar(latitude, longitude, elevation, site: RadarSite) -> dict[str, Column]:
    """Forward azimuth and slant range (great-circle distance over the cosine of the elevation)."""
    lat1, lon1 = F.radians(F.lit(site.latitude)), F.radians(F.lit(site.longitude))
    lat2, lon2 = F.radians(_c(latitude)), F.radians(_c(longitude))
    dlat, dlon = lat2 - lat1, lon2 - lon1
    y = F.sin(dlon) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(dlon)
    bearing = F.degrees(F.atan2(y, x))
    a = F.sin(dlat / 2.0) * F.sin(dlat / 2.0) + F.cos(lat1) * F.cos(lat2) * F.sin(dlon / 2.0) * F.sin(dlon / 2.0)
    ground = F.lit(EARTH_RADIUS_M) * 2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))
    return {"azimuth_deg": F.pmod(bearing + 360.0, F.lit(360.0)), "range_km": ground / F.cos(F.radians(_c(elevation))) / 1000.0}


def sweep_extent(max_range_km, site: RadarSite) -> dict[str, Column]:
    """Bounds of a sweep: the gates at its range to the north, east, south and west."""
    at = {az: polar_to_geo(az, max_range_km, 0.0, site) for az in (0.0, 90.0, 180.0, 270.0)}
    return {
        "max_latitude": at[0.0]["latitude"], "max_longitude": at[90.0]["longitude"], "min_latitude": at[180.0]["latitude"], "min_longitude": at[270.0]["longitude"],
    }


def distance_squared(lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular, in squared degrees; longitudes do not wrap."""
    dlat = _c(lat2) - _c(lat1)
    dlon = (_c(lon2) - _c(lon1)) * F.cos(F.radians((_c(lat1) + _c(lat2)) * 0.5))
    return dlat * dlat + dlon * dlon


def storm_relative(velocity, azimuth, storm_from_deg: float, storm_speed: float) -> Column:
    """Velocity less the storm's motion along the beam; the direction is where it comes from."""
    if storm_speed < 0:
        raise ValueError("storm speed must not be negative")
    toward = F.radians(F.lit(float(storm_from_deg) + 180.0))
    u, v = F.lit(float(storm_speed)) * F.sin(toward), F.lit(float(storm_speed)) * F.cos(toward)
    az = F.radians(_c(azimuth))
    return _c(velocity) - (u * F.sin(az) + v * F.cos(az))


def bilinear(v00, v01, v10, v11, fx, fy) -> Column:
    """Of four corners (row, column); null if any is missing."""
    top = _c(v00) + (_c(v01) - _c(v00)) * _c(fx)
    bottom = _c(v10) + (_c(v11) - _c(v10)) * _c(fx)
    return top + (bottom - top) * _c(fy)


def pixel_to_polar(x, y, size: int, max_range_km: float, height: int | None = None) -> dict[str, Column]:
    """Azimuth and range of a pixel of an image (square, or size wide and height high); null beyond the range."""
    height = height or size
    per_km = max(size, height) / 2.0 / max_range_km
    dx, dy = _c(x) - size / 2.0, _c(y) - height / 2.0
    range_km = F.sqrt(dx * dx + dy * dy) / per_km
    # The centre itself looks south, as minus zero does; Spark's atan2 drops the sign of zero.
    azimuth = F.when((dx == 0) & (dy == 0), 180.0).otherwise(F.pmod(F.degrees(F.atan2(dx, -dy)) + 360.0, F.lit(360.0)))
    inside = range_km <= max_range_km
    return {"azimuth_deg": F.when(inside, azimuth), "range_km": F.when(inside, range_km)}


def polar_to_pixel(azimuth, range_km, size: int, max_range_km: float, height: int | None = None) -> dict[str, Column]:
    height = height or size
    per_km = max(size, height) / 2.0 / max_range_km
    az = F.radians(_c(azimuth))
    return {"x": F.lit(size / 2.0) + _c(range_km) * per_km * F.sin(az), "y": F.lit(height / 2.0) - _c(range_km) * per_km * F.cos(az)}
