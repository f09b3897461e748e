"""As-of choice, the nearest site and digests in order, against plain Python."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from squall.operators import digests
from squall.sources import listing, stations

START = datetime(2024, 1, 1, 23, 0, 0)


def test_as_of_by_merge(spark):
    rng = random.Random(2)
    time = lambda: rng.choice([None, *[START + timedelta(minutes=rng.randrange(180)) for _ in range(9)]])
    have = [(rng.choice(["A", "B", None]), time(), f"n{rng.randrange(50)}") for _ in range(60)]
    asked = [(k, rng.choice(["A", "B", "C", None]), time()) for k in range(80)]
    asked += asked[:3]  # repeated requests are answered each
    want = []
    for k, site, at in asked:
        fit = [(t, n) for s, t, n in have if s is not None and s == site and t and at and t <= at and t.date() == at.date()]
        want.append((k, max(fit)[1] if fit else None))
    requests = spark.createDataFrame(asked, "request int, site string, at timestamp")
    df = listing.as_of(requests, spark.createDataFrame(have, "site string, time timestamp, name string"))
    assert df.columns == ["request", "site", "at", "name"]
    assert sorted((r.request, r.name or "") for r in df.collect()) == sorted((k, n or "") for k, n in want)
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "Join" not in plan
    assert listing.as_of(requests, spark.createDataFrame([], "site string, time timestamp, name string")).where("name is not null").count() == 0


def distance(lat, lon, s):
    across = (lon - s[4]) * math.cos(math.radians((lat + s[3]) * 0.5))
    return (lat - s[3]) ** 2 + across**2


def test_nearest_site_everywhere(spark):
    rng = random.Random(3)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(3000)] + [(rng.uniform(15, 72), rng.uniform(-170, -65)) for _ in range(5000)]
    points += [(a, b) for a in (-90.0, -1.0, 0.0, 34.0, 90.0) for b in (-180.0, -98.0, 0.0, 180.0)] + [(s[3], s[4]) for s in stations.SITES] + [(95.0, 10.0), (10.0, 270.0), (-100.0, -200.0)]
    df = spark.createDataFrame([(k, a, b, "x") for k, (a, b) in enumerate(points)], "k int, lat double, lon double, cell string")
    got = {r.k: r.id for r in stations.nearest(df).select("k", "id").collect()}
    for k, (a, b) in enumerate(points):
        best = min(range(len(stations.SITES)), key=lambda i: (distance(a, b, stations.SITES[i]), i))
        near = next(s for s in stations.SITES if s[0] == got[k])
        assert got[k] == stations.SITES[best][0] or math.isclose(distance(a, b, near), distance(a, b, stations.SITES[best]), rel_tol=1e-12)
    at, _ = stations.cell_candidates()
    assert (at[1:] > at[:-1]).all()
    odd = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 1.0)], "lat double, lon double")
    assert [r.id for r in stations.nearest(odd).collect()] == [None] * 3 and stations.nearest(odd.limit(0)).count() == 0


def test_digest_of_literal_bytes(spark):
    """Golden values: SHA-256 of the empty string, of abc, and of a million a's in a thousand rows."""
    rows = [("empty", 1, bytearray(b"")), ("empty", 2, None), ("abc", 3, bytearray(b"c")), ("abc", 1, bytearray(b"a")), ("abc", 2, bytearray(b"b"))] + [("long", k, bytearray(b"a" * 1000)) for k in range(1000)]
    df = spark.createDataFrame(rows, "name string, place int, data binary").repartition(7)
    got = {r.name: (r.digest, r.n_bytes) for r in digests.in_order(df, ["name"], ["place"], "data").collect()}
    assert got == {
        "empty": ("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", 0),
        "abc": ("ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", 3),
        "long": ("cdc76e5c9914fb9281a1c7e284d73e67f1809a48a497200e046d39ccc7112cd0", 1_000_000),
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_digests_of_many_keys(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, None]), rng.choice(["x", "y"]), k, bytearray(rng.randbytes(rng.randrange(40)))) for k in range(300)]
    rng.shuffle(rows)
    want = {}
    for a, b, k, data in sorted(rows, key=lambda r: r[2]):
        want.setdefault((a, b), []).append(bytes(data))
    df = spark.createDataFrame(rows, "a int, b string, k int, data binary")
    got = {(r.a, r.b): (r.digest, r.n_bytes) for r in digests.in_order(df, ["a", "b"], ["k"], "data").collect()}
    assert got == {k: (hashlib.sha256(b"".join(v)).hexdigest(), sum(map(len, v))) for k, v in want.items()}
    assert digests.in_order(df.where(F.lit(False)), ["a"], ["k"], "data").count() == 0
