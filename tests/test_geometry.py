import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from featurekit.functions import crs
from featurekit.functions import geometry as g
from featurekit.functions.validity import make_valid, problem, repair
from featurekit.functions.wkb import decode, decode_many, encode, encode_many, from_wkb, to_wkb
from featurekit.operators.improve import add_sizes

BOX = [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [1.0, 2.0], [2.0, 2.0], [2.0, 1.0], [1.0, 1.0]]
BOW = [[0.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 2.0], [0.0, 0.0]]


def frame(spark, *shapes):
    return spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], f"id int, geometry {g.DDL}")


def test_measures(spark):
    c = F.col("geometry")
    df = frame(spark, ("Polygon", [[BOX, HOLE]]), ("MultiPolygon", [[BOX], [[[p[0] + 9, p[1]] for p in BOX]]]), ("LineString", [[[[0.0, 0.0], [3.0, 4.0]]]]), ("Point", [[[[1.0, 2.0]]]]), None)
    got = df.select("id", g.area(c), g.length(c), g.bounds(c)).orderBy("id").collect()
    assert [r[1] for r in got] == [11, 24, 0, 0, None]
    assert [r[2] for r in got] == [18, 28, 5, 0, None]
    assert tuple(got[0][3]) == (0, 0, 4, 3) and got[4][3] is None
    assert g.explode_parts(df).groupBy("id").count().orderBy("id").collect()[1]["count"] == 2
    assert tuple(g.total_bounds(df).first()) == (0, 0, 13, 4)


def test_z_is_dropped(spark):
    df = frame(spark, ("Point", [[[[1.0, 2.0, 3.0]]]]))
    assert df.select(g.has_z(F.col("geometry"))).first()[0] is True
    assert df.select(g.drop_z(F.col("geometry"))["parts"][0][0][0]).first()[0] == [1, 2]


def test_sizes_fill_gaps_only(spark):
    df = frame(spark, ("Polygon", [[BOX]]), ("Polygon", [[BOX]])).withColumn("metrics:area", F.when(F.col("id") == 0, 5.0))
    got = add_sizes(df, "EPSG:3857").orderBy("id").collect()
    assert [r["metrics:area"] for r in got] == [5, 12] and got[0]["metrics:perimeter"] == 14


@pytest.mark.parametrize("kind,parts", [("Point", [[[[1.5, -2.0]]]]), ("Polygon", [[BOX, HOLE]]), ("MultiPolygon", [[BOX], [HOLE]]), ("MultiPoint", [[[[1.0, 2.0]]], [[[3.0, 4.0]]]]), ("LineString", [[BOX]]), ("MultiLineString", [[BOX], [HOLE]]), ("Point", [[[[1.0, 2.0, 3.0]]]])])
def test_wkb(spark, kind, parts):
    assert decode(encode(kind, parts)) == (kind, parts)
    df = frame(spark, (kind, parts), None).withColumn("wkb", to_wkb(F.col("geometry")))
    assert df.schema["wkb"].dataType == BinaryType()
    back = df.select("id", from_wkb(F.col("wkb")).alias("x")).orderBy("id").collect()
    assert (back[0]["x"]["type"], back[0]["x"]["parts"]) == (kind, parts) and back[1]["x"] is None


def test_known_projections(spark):
    assert crs.forward(math, 6933, 180, 0)[0] == pytest.approx(17367530.4452, abs=1e-3)
    assert crs.forward(math, 6933, 0, 90)[1] == pytest.approx(7342230.1365, abs=1e-3)
    assert crs.forward(math, 3857, 180, 0)[0] == pytest.approx(20037508.342789244, abs=1e-6)
    # The central meridian of zone 32 lies at 9 degrees, its false easting is 500 km.
    assert crs.forward(math, 25832, 9, 0) == pytest.approx((500000, 0), abs=1e-6)
    for epsg in (3857, 6933, 25832, 32633, 32733):
        lon, lat = (11.5, -33.2) if epsg == 32733 else (11.5, 48.1)
        assert crs.inverse(math, epsg, *crs.forward(math, epsg, lon, lat)) == pytest.approx((lon, lat), abs=1e-8)
    df = frame(spark, ("Point", [[[[11.5, 48.1]]]]))
    moved = df.select(crs.reproject(crs.reproject(F.col("geometry"), 4326, 25832), 25832, 4326)["parts"][0][0][0]).first()[0]
    assert moved == pytest.approx([11.5, 48.1], abs=1e-8)
    with pytest.raises(ValueError, match="No formula"):
        crs.reproject(F.col("geometry"), 4326, 31370)


NEAR = {2154: (2.4, 48.8), 2157: (-6.3, 53.3), 2180: (21, 52.2), 2193: (174.8, -41.3), 3005: (-123.1, 49.3), 3006: (18, 59.3), 3034: (13.4, 52.5), 3035: (5, 50), 3059: (24.1, 56.9), 3067: (24.9, 60.2), 3301: (24.7, 59.4), 3338: (-149.9, 61.2), 3346: (25.3, 54.7), 3347: (-75.7, 45.4), 3577: (149.1, -35.3), 3763: (-9.1, 38.7), 3765: (16, 45.8), 3794: (14.5, 46.1), 3812: (4.4, 50.8), 3978: (-114, 51), 5070: (-77, 38.9), 3948: (2.3, 48.9), 26917: (-79.4, 43.7), 7855: (147.3, -42.9), 28355: (145, -37.8)}


@pytest.mark.parametrize("epsg", [*NEAR, *crs.GRIDS])
def test_grids_go_back_and_keep_what_they_promise(epsg):
    lon, lat = NEAR[epsg]
    x, y = crs.forward(math, epsg, lon, lat)
    assert crs.inverse(math, epsg, x, y) == pytest.approx((lon, lat), abs=3e-10)
    g = crs.grid(epsg)
    if epsg in crs.GRIDS:
        assert crs.forward(math, epsg, g.lon0, g.lat0) == pytest.approx((g.east, g.north), abs=1e-3)
        assert crs.inverse(math, epsg, g.east, g.north) == pytest.approx((g.lon0, g.lat0), abs=1e-8)
    # Steps of a millionth of a degree to the east and north, against those on the ellipsoid.
    d, s = 1e-5, math.sin(math.radians(lat))
    e, n = (np.subtract(crs.forward(math, epsg, lon + a, lat + b), (x, y)) for a, b in ((d, 0), (0, d)))
    east = math.radians(d) * crs.A * math.cos(math.radians(lat)) / math.sqrt(1 - crs.E2 * s * s)
    north = math.radians(d) * crs.A * (1 - crs.E2) / (1 - crs.E2 * s * s) ** 1.5
    if isinstance(g, (crs.Albers, crs.LambertAzimuthal)):
        assert abs(np.cross([*e, 0], [*n, 0])[2]) == pytest.approx(east * north, rel=1e-5)
    else:  # conformal: the same scale both ways, at a right angle
        assert np.hypot(*e) / east == pytest.approx(np.hypot(*n) / north, rel=1e-5) and abs(e @ n) < 1e-5 * np.hypot(*e) * np.hypot(*n)
    if isinstance(g, crs.LambertConic):
        step = np.subtract(crs.forward(math, epsg, lon + d, g.rest[0]), crs.forward(math, epsg, lon, g.rest[0]))
        assert np.hypot(*step) == pytest.approx(math.radians(d) * crs.A * crs._parallel(g.rest[0]), rel=1e-6)


def test_published_example(spark):
    """The worked example of the azimuthal equal-area grid of Europe, and the same over columns."""
    assert crs.forward(math, 3035, 5, 50) == pytest.approx((3962799.45, 2999718.85), abs=0.01)
    df = frame(spark, ("Point", [[[[5.0, 50.0]]]]))
    for epsg in (3035, 2154, 5070, 3006, 3577):
        p = df.select(crs.reproject(F.col("geometry"), "EPSG:4258", epsg)["parts"][0][0][0]).first()[0]
        assert p == pytest.approx(crs.forward(math, epsg, 5, 50), rel=1e-9)


@pytest.mark.parametrize(
    "parts,reason",
    [
        ([[BOX]], None),
        ([[BOX, HOLE]], None),
        ([[BOW]], "Self-intersection"),
        ([[BOX[:-1]]], "Ring is not closed"),
        ([[[[0, 0], [1, 1], [0, 0]]]], "Too few points in geometry component"),
        ([[BOX, [[p[0] + 9, p[1]] for p in HOLE]]], "Hole lies outside shell"),
        ([[[[0, 0], [4, 0], [4, 4], [2, 2], [2, 6], [2, 2], [0, 0]]]], "Self-intersection"),
        ([[[[0, 0], [2, 2], [4, 0], [4, 4], [2, 2], [0, 4], [0, 0]]]], "Ring Self-intersection"),
        ([[[[0, 0], [math.nan, 0], [1, 1], [0, 0]]]], "Invalid Coordinate"),
    ],
)
def test_reasons(parts, reason):
    assert problem("Polygon", parts) == reason


def test_repair(spark):
    kind, parts = repair("Polygon", [[BOW]])
    assert kind == "MultiPolygon" and len(parts) == 2 and problem(kind, parts) is None
    df = frame(spark, ("Polygon", [[BOW]]), ("Polygon", [[BOX, HOLE]]), ("Polygon", [[BOX[:-1]]]), ("Polygon", [[[[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]), None)
    fixed = df.withColumn("geometry", make_valid(F.col("geometry")))
    got = [r[0] for r in fixed.select(g.area(F.col("geometry"))).collect()]
    assert got[:4] == pytest.approx([2, 11, 12, 0]) and got[4] is None


def test_repair_with_hole_crossing_the_shell():
    kind, parts = repair("Polygon", [[[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[3, 1], [5, 1], [5, 3], [3, 3], [3, 1]]]])
    assert problem(kind, parts) is None
    area = sum(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2) * (1 if k == 0 else -1) for part in parts for k, r in enumerate(part))
    assert area == pytest.approx(16 - 2 + 2)  # even-odd: the part of the hole outside is filled


def test_hilbert_is_a_walk(spark):
    n = 8
    df = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    path = [(r["x"], r["y"]) for r in df.withColumn("d", g.hilbert(F.col("x"), F.col("y"), 3)).orderBy("d").collect()]
    assert len(set(path)) == n * n
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(path, path[1:]))
    assert g.hilbert_sort(frame(spark, ("Point", [[[[1.0, 2.0]]]]), None)).count() == 2


def test_many_geometries_are_coded_as_one_is(spark):
    shapes = [("Polygon", [[BOX, HOLE]]), ("Polygon", [[BOX]]), ("Point", [[[[1.0, 2.0]]]]), (None, None), ("Polygon", [[BOX[:3] + BOX[:1]]]), ("Point", [[[[1.0, 2.0, 3.0]]]]), ("Point", []), ("MultiPoint", [[[[1.0, 2.0]]]]), ("Polygon", [[[[x + 1.0, y] for x, y in BOX]]]), ("Point", [[[[-7.5, 0.0]]]])]
    raw = encode_many([k for k, _ in shapes], [p for _, p in shapes])
    assert raw == [None if k is None else encode(k, p) for k, p in shapes]
    assert decode_many(raw) == [(None, None) if b is None else decode(b) for b in raw]
