"""Geometry as a native column: ``struct<type: string, parts: array<array<array<array<double>>>>>``, parts of rings of
points of coordinates. All functions here are Catalyst expressions; a null geometry gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DDL = "struct<type:string,parts:array<array<array<array<double>>>>>"
#: The same as a type object, which workers can make without a session.
TYPE = T.StructType([T.StructField("type", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))))])
BBOX_DDL = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def geometry(kind: Column | str, parts: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(parts.isNotNull(), F.struct(kind.alias("type"), parts.alias("parts"))).cast(DDL)


def point(x: Column, y: Column) -> Column:
    return geometry("Point", F.when(x.isNotNull() & y.isNotNull(), F.array(F.array(F.array(F.array(x.cast("double"), y.cast("double")))))))


def ring(*xy: tuple[Column, Column]) -> Column:
    return F.array(*(F.array(x.cast("double"), y.cast("double")) for x, y in xy))


def polygon(*rings: Column) -> Column:
    return geometry("Polygon", F.array(F.array(*rings)))


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return polygon(ring((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)))


def geometry_type(g: Column) -> Column:
    return g["type"]


def points(g: Column) -> Column:
    """All points of all rings of all parts."""
    return F.flatten(F.flatten(g["parts"]))


def bounds(g: Column) -> Column:
    """The row's bounding box; null for an empty geometry."""
    at = lambda f, i: f(F.transform(points(g), lambda p: p[i]))
    box = F.struct(at(F.array_min, 0).alias("xmin"), at(F.array_min, 1).alias("ymin"), at(F.array_max, 0).alias("xmax"), at(F.array_max, 1).alias("ymax"))
    return F.when(F.size(points(g)) > 0, box)


def _steps(r: Column) -> Column:
    """Each point of a line with the one after it."""
    return F.zip_with(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def ring_area(r: Column) -> Column:
    """Signed area of a closed ring, positive against the clock."""
    return _sum(F.transform(_steps(r), lambda s: s["a"][0] * s["b"][1] - s["b"][0] * s["a"][1])) / 2


def area(g: Column) -> Column:
    """Shells less holes; 0 for points and lines."""
    of_part = lambda p: F.abs(ring_area(p[0])) - _sum(F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda h: F.abs(ring_area(h))))
    return F.when(g["type"].isin("Polygon", "MultiPolygon"), _sum(F.transform(g["parts"], of_part))).when(g.isNotNull(), 0.0)


def length(g: Column) -> Column:
    """Length of all rings or lines; 0 for points."""
    of_ring = lambda r: _sum(F.transform(_steps(r), lambda s: F.sqrt(F.pow(s["b"][0] - s["a"][0], 2) + F.pow(s["b"][1] - s["a"][1], 2))))
    total = _sum(F.transform(F.flatten(g["parts"]), of_ring))
    return F.when(g["type"].isin("Point", "MultiPoint"), 0.0).when(g.isNotNull(), total)


def map_points(g: Column, fn) -> Column:
    """The geometry with ``fn`` applied to every point (an array of coordinates)."""
    moved = F.transform(g["parts"], lambda part: F.transform(part, lambda r: F.transform(r, fn)))
    return F.when(g.isNotNull(), F.struct(g["type"].alias("type"), moved.alias("parts")))


def drop_z(g: Column) -> Column:
    """Only the first two coordinates of every point."""
    return map_points(g, lambda p: F.slice(p, 1, 2))


def has_z(g: Column) -> Column:
    return F.exists(points(g), lambda p: F.size(p) > 2)


def single(g: Column) -> Column:
    """Parts as geometries of their own."""
    kind = F.regexp_replace(g["type"], "^Multi", "")
    return F.when(g["type"].startswith("Multi"), F.transform(g["parts"], lambda p: F.struct(kind.alias("type"), F.array(p).alias("parts")))).otherwise(F.array(g))


def explode_parts(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """One row per part of a multi-part geometry, other columns repeated; rows of null or empty ones stay as they are."""
    return df.withColumn(geom, F.explode_outer(F.when(F.size(F.col(geom)["parts"]) > 0, single(F.col(geom))).otherwise(F.array(F.col(geom)))))


def total_bounds(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """One row: the box of all rows."""
    b = bounds(F.col(geom))
    return df.select(b.alias("b")).agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


def hilbert(x: Column, y: Column, level: int = 16) -> Column:
    """Distance along the Hilbert curve of cell (x, y), both from 0 to 2 ** level - 1."""
    n = 1 << level

    def step(acc: Column, i: Column) -> Column:
        s = F.call_function("shiftright", F.lit(n // 2).cast("long"), i)
        rx = F.when(acc["x"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        ry = F.when(acc["y"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        d = acc["d"] + s * s * F.lit(3).cast("long") * rx - s * s * F.when(rx == 1, ry).otherwise(F.lit(0).cast("long")) + F.when(rx == 0, s * s * ry).otherwise(F.lit(0).cast("long"))
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, F.lit(n - 1) - acc["x"]).otherwise(acc["x"]), F.when(flip, F.lit(n - 1) - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).cast("long").alias("x"), F.when(ry == 0, fx).otherwise(fy).cast("long").alias("y"), d.cast("long").alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(level - 1)), start, step)["d"]


def hilbert_key(g: Column, box: tuple[float, float, float, float], level: int = 16) -> Column:
    """The key of the centre of the row's box within ``box``, by which rows near each other lie near in order."""
    b, top = bounds(g), (1 << level) - 1
    cell = lambda lo, hi, a, z: F.least(F.greatest(F.floor(((a + z) / 2 - lo) / (hi - lo) * (top + 1)) if hi > lo else F.lit(0), F.lit(0)), F.lit(top)).cast("long")
    return hilbert(cell(box[0], box[2], b["xmin"], b["xmax"]), cell(box[1], box[3], b["ymin"], b["ymax"]), level)


def hilbert_sort(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """Rows in Hilbert order of their geometries, null ones last. One pass finds the total bounds, then a range shuffle."""
    row = total_bounds(df, geom).first()
    if row is None or row["xmin"] is None:
        return df
    key = "__hilbert"
    return df.withColumn(key, hilbert_key(F.col(geom), tuple(row))).orderBy(F.col(key).asc_nulls_last()).drop(key)


def from_geojson(kind: Column, coordinates_json: Column) -> Column:
    """A geometry of a GeoJSON type and its coordinates as JSON text, read at the depth that the type has."""
    at = lambda depth: F.from_json(coordinates_json, "array<" * depth + "double" + ">" * depth)
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(at(1)))))
        .when(kind == "MultiPoint", F.transform(at(2), lambda p: F.array(F.array(p))))
        .when(kind == "LineString", F.array(F.array(at(2))))
        .when(kind == "MultiLineString", F.transform(at(3), lambda x: F.array(x)))
        .when(kind == "Polygon", F.array(at(3)))
        .when(kind == "MultiPolygon", at(4))
    )
    return geometry(kind, parts)


def to_geojson(g: Column) -> Column:
    """GeoJSON text of a geometry."""
    p, kind = g["parts"], g["type"]
    text = (
        F.when(kind == "Point", F.to_json(p[0][0][0]))
        .when(kind == "MultiPoint", F.to_json(F.transform(p, lambda x: x[0][0])))
        .when(kind == "LineString", F.to_json(p[0][0]))
        .when(kind == "MultiLineString", F.to_json(F.transform(p, lambda x: x[0])))
        .when(kind == "Polygon", F.to_json(p[0]))
        .when(kind == "MultiPolygon", F.to_json(p))
    )
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), text, F.lit("}"))
