"""Grids on other datums against published points and there and back; arrays against numbers and columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurekit.functions import crs

DDL = "id int, geometry struct<type:string,parts:array<array<array<array<double>>>>>"


def test_published_points():
    """A published worked example of each step: the national grid of an old datum, and a shift by seven parameters."""
    on = crs.grid(27700)
    x, y = on.forward(math, math.radians(0.5 + 2), math.radians(50.5))
    assert (x + on.east, y + on.north) == pytest.approx((577274.99, 69740.50), abs=0.01)
    lat, lon = 52 + 39 / 60 + 27.2531 / 3600, 1 + 43 / 60 + 4.5177 / 3600
    x, y = on.forward(math, math.radians(lon + 2), math.radians(lat))
    assert (x + on.east, y + on.north) == pytest.approx((651409.903, 313177.270), abs=0.002)
    got = crs.shifted(3657660.66, 255768.55, 5201382.11, (0, 0, 4.5, 0, 0, 0.554, 0.219))
    assert got == pytest.approx((3657660.78, 255778.43, 5201387.75), abs=0.01)
    back = crs.shifted(*got, (0, 0, 4.5, 0, 0, 0.554, 0.219), back=True)
    assert back == pytest.approx((3657660.66, 255768.55, 5201382.11), abs=1e-6)


def test_degrees_to_centre_and_back():
    for on in (crs.WGS84, crs.BESSEL, crs.AIRY):
        for lon, lat in ((0, 0), (10, 50), (-179, -80), (33, 89.9)):
            assert on.geodetic(math, *on.geocentric(math, lon, lat)) == pytest.approx((lon, lat), abs=1e-10)


@pytest.mark.parametrize("epsg,lon,lat,moves", [(27700, -1.5, 52.5, 120), (31467, 9.2, 48.8, 150), (31468, 11.5, 48.1, 150), (31256, 16.3, 48.2, 130), (4314, 9.2, 48.8, 150), (4277, -3, 56, 120)])
def test_there_and_back(epsg, lon, lat, moves):
    x, y = crs.converted(math, 4326, epsg, lon, lat)
    assert crs.converted(math, epsg, 4326, x, y) == pytest.approx((lon, lat), abs=5e-8)  # heights count as nought, which costs millimetres
    # The shift is some hundred metres, as these datums differ, and no more.
    own = crs.inverse(math, epsg, x, y)
    apart = math.hypot((own[0] - lon) * 111_000 * math.cos(math.radians(lat)), (own[1] - lat) * 111_000)
    assert 40 < apart < 2 * moves


def test_batches_equal_numbers(spark):
    rng = np.random.default_rng(1)
    shapes = [("Polygon", [[[[8 + a, 47 + b] + [7.0] * (k % 2) for a, b in rng.random((4, 2)).tolist()]] * (1 + k % 3)]) for k in range(30)]
    shapes += [("Point", []), None, ("MultiPolygon", [[], [[]]])]
    df = spark.createDataFrame(list(enumerate(shapes)), DDL).repartition(3)
    for a, b in ((4326, 31467), (3035, 3006), (31467, 31468), (4326, 3035), (32632, 4258)):
        there = crs.reproject(F.col("geometry"), 4326, a) if a != 4326 else F.col("geometry")
        got = {r["id"]: r for r in df.select("id", there.alias("g")).select("id", "g", crs.reproject(F.col("g"), a, b).alias("h")).collect()}
        for r in got.values():
            if r["g"] is None:
                assert r["h"] is None
                continue
            assert r["h"]["type"] == r["g"]["type"] and len(r["h"]["parts"]) == len(r["g"]["parts"])
            for p, q in zip((p for x in r["g"]["parts"] for y in x for p in y), (p for x in r["h"]["parts"] for y in x for p in y), strict=True):
                assert q[:2] == pytest.approx(crs.converted(math, a, b, *p[:2]), rel=1e-12, abs=1e-9) and q[2:] == p[2:]
