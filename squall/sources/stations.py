"""Weather-radar sites: a fixed table of identifier, place, state, position and elevation."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.functions import geo

SITE_SCHEMA = "id string, city string, state string, latitude double, longitude double, elevation_m int"

# Fixed values: (id, city, state, latitude, longitude, elevation in metres).
SITES = (
    ("KBMX", "Birmingham", "AL", 33.1722, -86.7698, 197),
    ("KEOX", "Fort Rucker", "AL", 31.4606, -85.4592, 132),
    ("KHTX", "Huntsville", "AL", 34.9306, -86.0833, 536),
    ("KMOB", "Mobile", "AL", 30.6794, -88.2397, 63),
    ("KMXX", "Maxwell AFB", "AL", 32.5367, -85.7897, 122),
    ("KABC", "Bethel", "AK", 60.7919, -161.8764, 48),
    ("KAKQ", "Wakefield", "VA", 36.9839, -77.0072, 34),
    ("KAPX", "Gaylord", "MI", 44.9072, -84.7197, 446),
    ("KACG", "Sitka", "AK", 56.8525, -135.5294, 63),
    ("KAIH", "Middleton Island", "AK", 59.4614, -146.3031, 20),
    ("KAKC", "King Salmon", "AK", 58.6794, -156.6297, 19),
    ("PABC", "Bethel", "AK", 60.7919, -161.8764, 48),
    ("PACG", "Sitka", "AK", 56.8525, -135.5294, 63),
    ("PAEC", "Nome", "AK", 64.5114, -165.295, 16),
    ("PAHG", "Anchorage", "AK", 60.7258, -151.3514, 74),
    ("PAIH", "Middleton Island", "AK", 59.4614, -146.3031, 20),
    ("PAKC", "King Salmon", "AK", 58.6794, -156.6297, 19),
    ("KEMX", "Tucson", "AZ", 31.8939, -110.6303, 1586),
    ("KFSX", "Flagstaff", "AZ", 34.5744, -111.1983, 2261),
    ("KIWA", "Phoenix", "AZ", 33.2892, -111.67, 413),
    ("KYUX", "Yuma", "AZ", 32.4953, -114.6567, 53),
    ("KLZK", "Little Rock", "AR", 34.8364, -92.2622, 173),
    ("KSRX", "Fort Smith", "AR", 35.2906, -94.3619, 195),
    ("KBBX", "Beale AFB", "CA", 39.4961, -121.6317, 53),
    ("KEYX", "Edwards AFB", "CA", 35.0978, -117.5608, 840),
    ("KHNX", "Hanford", "CA", 36.3142, -119.6322, 74),
    ("KMUX", "San Francisco", "CA", 37.1553, -121.8983, 1057),
    ("KNKX", "San Diego", "CA", 32.9189, -117.0419, 291),
    ("KSOX", "Santa Ana Mountains", "CA", 33.8178, -117.6358, 923),
    ("KVBX", "Vandenberg AFB", "CA", 34.8383, -120.3978, 373),
    ("KVTX", "Los Angeles", "CA", 34.4114, -119.1794, 831),
    ("KDAX", "Sacramento", "CA", 38.5011, -121.6778, 9),
    ("KFTG", "Denver", "CO", 39.7867, -104.5458, 1675),
    ("KGJX", "Grand Junction", "CO", 39.0622, -108.2139, 3045),
    ("KPUX", "Pueblo", "CO", 38.4594, -104.1817, 1600),
    ("KOKX", "Upton", "NY", 40.8656, -72.8639, 26),
    ("KAMX", "Miami", "FL", 25.6111, -80.4128, 4),
    ("KEVX", "Eglin AFB", "FL", 30.5644, -85.9214, 43),
    ("KJAX", "Jacksonville", "FL", 30.4847, -81.7019, 10),
    ("KMLB", "Melbourne", "FL", 28.1133, -80.6542, 11),
    ("KTBW", "Tampa Bay", "FL", 27.7056, -82.4017, 13),
    ("KTLH", "Tallahassee", "FL", 30.3975, -84.3289, 19),
    ("KBYX", "Key West", "FL", 24.5975, -81.7031, 3),
    ("KFFC", "Atlanta", "GA", 33.3636, -84.5658, 262),
    ("KJGX", "Robins AFB", "GA", 32.6756, -83.3511, 159),
    ("KVAX", "Moody AFB", "GA", 30.89, -83.0019, 54),
    ("PHKI", "South Kauai", "HI", 21.8939, -159.5522, 55),
    ("PHKM", "Kamuela", "HI", 20.1253, -155.7781, 1161),
    ("PHMO", "Molokai", "HI", 21.1328, -157.1803, 416),
    ("PHWA", "South Shore", "HI", 19.095, -155.5689, 421),
    ("KCBX", "Boise", "ID", 43.4908, -116.2358, 933),
    ("KSFX", "Pocatello", "ID", 43.1058, -112.6861, 1364),
    ("KILX", "Lincoln", "IL", 40.1506, -89.3369, 177),
    ("KLOT", "Chicago", "IL", 41.6044, -88.0847, 202),
    ("KIND", "Indianapolis", "IN", 39.7075, -86.2803, 241),
    ("KIWX", "Fort Wayne", "IN", 41.3586, -85.7, 293),
    ("KVWX", "Evansville", "IN", 38.2603, -87.7247, 155),
    ("KDMX", "Des Moines", "IA", 41.7311, -93.7228, 299),
    ("KDVN", "Davenport", "IA", 41.6117, -90.5808, 230),
    ("KDDC", "Dodge City", "KS", 37.7608, -99.9689, 790),
    ("KGLD", "Goodland", "KS", 39.3669, -101.7003, 1113),
    ("KICT", "Wichita", "KS", 37.6544, -97.4428, 407),
    ("KTWX", "Topeka", "KS", 38.9969, -96.2325, 417),
    ("KHPX", "Fort Campbell", "KY", 36.7369, -87.285, 177),
    ("KJKL", "Jackson", "KY", 37.5908, -83.3131, 415),
    ("KLVX", "Louisville", "KY", 37.9753, -85.9439, 219),
    ("KPAH", "Paducah", "KY", 37.0683, -88.7722, 119),
    ("KHGX", "Houston", "TX", 29.4719, -95.0792, 5),
    ("KLCH", "Lake Charles", "LA", 30.1253, -93.2158, 4),
    ("KLIX", "New Orleans", "LA", 30.3367, -89.8256, 7),
    ("KPOE", "Fort Polk", "LA", 31.1556, -92.9756, 124),
    ("KSHV", "Shreveport", "LA", 32.4508, -93.8411, 83),
    ("KCBW", "Caribou", "ME", 46.0392, -67.8067, 227),
    ("KGYX", "Portland", "ME", 43.8914, -70.2567, 125),
    ("KLWX", "Sterling", "VA", 38.9753, -77.4778, 83),
    ("KBOX", "Boston", "MA", 41.9558, -71.1369, 36),
    ("KDTX", "Detroit", "MI", 42.6997, -83.4717, 327),
    ("KGRR", "Grand Rapids", "MI", 42.8939, -85.5447, 237),
    ("KMQT", "Marquette", "MI", 46.5314, -87.5486, 430),
    ("KDLH", "Duluth", "MN", 46.8369, -92.2097, 435),
    ("KMPX", "Minneapolis", "MN", 44.8489, -93.5653, 288),
    ("KDGX", "Brandon", "MS", 32.28, -89.9844, 149),
    ("KGWX", "Columbus AFB", "MS", 33.8967, -88.3289, 145),
    ("KEAX", "Kansas City", "MO", 38.8103, -94.2644, 303),
    ("KLSX", "St. Louis", "MO", 38.6986, -90.6828, 185),
    ("KSGF", "Springfield", "MO", 37.2353, -93.4006, 390),
    ("KBLX", "Billings", "MT", 45.8536, -108.6069, 1097),
    ("KGGW", "Glasgow", "MT", 48.2064, -106.6253, 694),
    ("KMSX", "Missoula", "MT", 47.0411, -113.9864, 2394),
    ("KTFX", "Great Falls", "MT", 47.4597, -111.3853, 1132),
    ("KLNX", "North Platte", "NE", 41.9578, -100.5761, 906),
    ("KOAX", "Omaha", "NE", 41.3203, -96.3667, 350),
    ("KUEX", "Hastings", "NE", 40.3208, -98.4419, 602),
    ("KLRX", "Elko", "NV", 40.74, -116.8025, 2056),
    ("KESX", "Las Vegas", "NV", 35.7011, -114.8914, 1483),
    ("KRGX", "Reno", "NV", 39.7542, -119.4622, 2530),
    ("KABX", "Albuquerque", "NM", 35.1497, -106.8239, 1789),
    ("KFDX", "Cannon AFB", "NM", 34.635, -103.6297, 1417),
    ("KHDX", "Holloman AFB", "NM", 33.0769, -106.12, 1287),
    ("KBGM", "Binghamton", "NY", 42.1997, -75.9847, 490),
    ("KBUF", "Buffalo", "NY", 42.9486, -78.7369, 211),
    ("KENX", "Albany", "NY", 42.5864, -74.0639, 557),
    ("KTYX", "Montague", "NY", 43.7558, -75.68, 562),
    ("KMHX", "Morehead City", "NC", 34.7761, -76.8764, 9),
    ("KRAX", "Raleigh", "NC", 35.6656, -78.4903, 106),
    ("KLTX", "Wilmington", "NC", 33.9892, -78.4292, 19),
    ("KBIS", "Bismarck", "ND", 46.7708, -100.7603, 505),
    ("KMVX", "Fargo", "ND", 47.5281, -97.3256, 301),
    ("KMBX", "Minot AFB", "ND", 48.3925, -100.8644, 455),
    ("KCLE", "Cleveland", "OH", 41.4131, -81.8597, 233),
    ("KILN", "Wilmington", "OH", 39.4203, -83.8217, 322),
    ("KFDR", "Frederick", "OK", 34.3622, -98.9764, 386),
    ("KINX", "Tulsa", "OK", 36.175, -95.5647, 204),
    ("KTLX", "Oklahoma City", "OK", 35.3331, -97.2778, 370),
    ("KVNX", "Vance AFB", "OK", 36.7406, -98.1278, 369),
    ("KMAX", "Medford", "OR", 42.0811, -122.7167, 2290),
    ("KPDT", "Pendleton", "OR", 45.6906, -118.8528, 462),
    ("KRTX", "Portland", "OR", 45.715, -122.9653, 479),
    ("KCCX", "State College", "PA", 40.9231, -78.0039, 733),
    ("KDIX", "Philadelphia", "PA", 39.9469, -74.4108, 45),
    ("KPBZ", "Pittsburgh", "PA", 40.5317, -80.0183, 361),
    ("TJUA", "San Juan", "PR", 18.1156, -66.0781, 867),
    ("KCAE", "Columbia", "SC", 33.9486, -81.1186, 70),
    ("KCLX", "Charleston", "SC", 32.6556, -81.0425, 30),
    ("KGSP", "Greenville", "SC", 34.8833, -82.22, 296),
    ("KABR", "Aberdeen", "SD", 45.4558, -98.4131, 397),
    ("KUDX", "Rapid City", "SD", 44.125, -102.8297, 919),
    ("KFSD", "Sioux Falls", "SD", 43.5878, -96.7289, 436),
    ("KMRX", "Knoxville", "TN", 36.1686, -83.4017, 408),
    ("KNQA", "Memphis", "TN", 35.3447, -89.8733, 86),
    ("KOHX", "Nashville", "TN", 36.2472, -86.5625, 176),
    ("KAMA", "Amarillo", "TX", 35.2333, -101.7092, 1093),
    ("KBRO", "Brownsville", "TX", 25.9158, -97.4189, 7),
    ("KCRP", "Corpus Christi", "TX", 27.7842, -97.5111, 14),
    ("KDFX", "Laughlin AFB", "TX", 29.2722, -100.2803, 345),
    ("KDYX", "Dyess AFB", "TX", 32.5386, -99.2544, 463),
    ("KEPZ", "El Paso", "TX", 31.8731, -106.6978, 1251),
    ("KEWX", "San Antonio", "TX", 29.7039, -98.0286, 193),
    ("KFWS", "Dallas/Fort Worth", "TX", 32.5731, -97.3031, 208),
    ("KGRK", "Fort Hood", "TX", 30.7217, -97.3828, 164),
    ("KLBB", "Lubbock", "TX", 33.6542, -101.8142, 993),
    ("KMAF", "Midland/Odessa", "TX", 31.9433, -102.1892, 874),
    ("KSJT", "San Angelo", "TX", 31.3714, -100.4925, 576),
    ("KICX", "Cedar City", "UT", 37.5911, -112.8622, 3231),
    ("KMTX", "Salt Lake City", "UT", 41.2628, -112.4478, 1969),
    ("KCXX", "Burlington", "VT", 44.5111, -73.1667, 97),
    ("KFCX", "Roanoke", "VA", 37.0242, -80.2744, 874),
    ("KATX", "Seattle", "WA", 48.1944, -122.4958, 151),
    ("KOTX", "Spokane", "WA", 47.6806, -117.6267, 728),
    ("KRLX", "Charleston", "WV", 38.3111, -81.7231, 329),
    ("KARX", "La Crosse", "WI", 43.8228, -91.1911, 389),
    ("KGRB", "Green Bay", "WI", 44.4986, -88.1111, 208),
    ("KMKX", "Milwaukee", "WI", 42.9678, -88.5506, 292),
    ("KCYS", "Cheyenne", "WY", 41.1519, -104.8061, 1868),
    ("KRIW", "Riverton", "WY", 43.0661, -108.4772, 1697),
    ("PGUA", "Andersen AFB", "GU", 13.4544, 144.8111, 78),
    ("KCCX", "State College", "PA", 40.9231, -78.0039, 733),
)


def sites(spark: SparkSession) -> DataFrame:
    """The registry as a table, in its own order."""
    return spark.createDataFrame(list(SITES), SITE_SCHEMA)


def sites_sql() -> str:
    """The registry as a SQL VALUES list named ``sites``, with its order as ``ord``."""
    rows = ",".join(f"({i},'{a}','{b.replace(chr(39), chr(39) * 2)}','{c}',{d!r}::double,{e!r}::double,{f})" for i, (a, b, c, d, e, f) in enumerate(SITES))
    return f"(values {rows}) sites(ord, id, city, state, latitude, longitude, elevation_m)"


# ---- the nearest site -----------------------------------------------------------

#: Degrees of a cell, and the number of cells: 180 by 360 degrees.
CELL = 2
_ROWS, _COLUMNS = 180 // CELL, 360 // CELL
#: The cell of points outside the grid: all sites.
_OUTSIDE = -1


@lru_cache(1)
def cell_candidates() -> tuple[np.ndarray, np.ndarray]:
    """For every cell, the sites (by place in the registry) that may be nearest to some point of it: (offsets, sites).

    A site is left out if even its least distance from the cell is more than another's greatest.
    """
    lat, lon = (np.array([x[k] for x in SITES])[:, None] for k in (3, 4))
    cell = np.arange(_ROWS * _COLUMNS)
    low, west = cell // _COLUMNS * CELL - 90.0, cell % _COLUMNS * CELL - 180.0
    high, east = low + CELL, west + CELL
    north = np.maximum(np.maximum(low - lat, lat - high), 0), np.maximum(abs(lat - low), abs(lat - high))
    across = np.maximum(np.maximum(west - lon, lon - east), 0), np.maximum(abs(lon - west), abs(lon - east))
    # the cosine at the mean of two latitudes, over the cell: greatest where that mean is nearest to the equator
    ends = np.cos(np.radians((low + lat) / 2)), np.cos(np.radians((high + lat) / 2))
    most = np.where((low + lat) * (high + lat) <= 0, 1.0, np.maximum(*ends))
    nearest = north[0] ** 2 + (across[0] * np.minimum(*ends)) ** 2
    farthest = north[1] ** 2 + (across[1] * most) ** 2
    may = nearest <= farthest.min(axis=0) * (1 + 1e-9)
    place, site = np.nonzero(may.T)
    return np.searchsorted(place, np.arange(len(cell) + 1)), site


def _cells(spark: SparkSession) -> DataFrame:
    """(cell, sites): one row a cell, 16,200 and one in all, so that it may be broadcast."""
    at, site = cell_candidates()
    site = np.concatenate([site, np.arange(len(SITES))])
    own = [np.array([x[k] for x in SITES])[site] for k in (3, 4)]
    parts = pa.StructArray.from_arrays([pa.array(own[0]), pa.array(own[1]), pa.array(site.astype(np.int32)), pa.array([SITES[k][0] for k in site])], ["lat", "lon", "place", "id"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(site)).astype(np.int32)), parts)
    return spark.createDataFrame(pa.table({"cell": pa.array(np.append(np.arange(len(at) - 1), _OUTSIDE).astype(np.int32)), "sites": lists}))


def nearest(points: DataFrame, latitude: str = "lat", longitude: str = "lon", name: str = "id") -> DataFrame:
    """Points with the identifier of their nearest site (of equally near ones the first in the registry); null where a coordinate is null or no number."""
    lat, lon = F.col(latitude).cast("double"), F.col(longitude).cast("double")
    known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    inside = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    row, column = F.least(F.floor((lat + 90.0) / CELL), F.lit(_ROWS - 1)), F.least(F.floor((lon + 180.0) / CELL), F.lit(_COLUMNS - 1))
    cell = F.when(known, F.when(inside, row * _COLUMNS + column).otherwise(_OUTSIDE)).cast("int")
    whole = F.struct(*[F.col(c) for c in points.columns]).alias("_point")
    asked = points.select(whole, lat.alias("_lat"), lon.alias("_lon"), cell.alias("_cell"))
    met = asked.join(F.broadcast(_cells(points.sparkSession)), F.col("_cell") == F.col("cell"), "left")
    best = F.array_min(F.transform("sites", lambda s: F.struct(geo.distance_squared(F.col("_lat"), F.col("_lon"), s["lat"], s["lon"]).alias("d"), s["place"].alias("place"), s["id"].alias("id"))))
    return met.select("_point.*", best["id"].alias(name))
