"""Geometry clean-up of a table (G of the inventory): reproject, repair, explode, rename, measure."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurekit.functions import crs as crs_
from featurekit.functions import geometry as g
from featurekit.functions.validity import is_valid, make_valid
from featurekit.operators.columns import ref
from featurekit.operators.columns import rename as rename_columns
from featurekit.table import FeatureTable

METRICS_SCHEMA = "/geometry-metrics-extension/v0.1.0/schema.yaml"


def change_crs(t: FeatureTable, crs: str) -> FeatureTable:
    if not t.crs:
        raise ValueError("The table has no CRS")
    return t.with_(df=t.df.withColumn(t.geometry, crs_.reproject(F.col(t.geometry), t.crs, crs)), crs=crs)


def fix_geometries(df: DataFrame, geom: str = "geometry") -> DataFrame:
    return df.withColumn(geom, make_valid(F.col(geom)))


def keep_valid_polygons(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """Rows of valid single polygons."""
    return df.filter((g.geometry_type(F.col(geom)) == "Polygon") & F.coalesce(is_valid(F.col(geom)), F.lit(False)))


def add_sizes(df: DataFrame, crs: str | None = "EPSG:4326", geom: str = "geometry") -> DataFrame:
    """metrics:area and metrics:perimeter where they are missing; measured in EPSG:6933 unless the system is metric."""
    shape = F.col(geom) if crs and crs_.is_metric(crs) else crs_.reproject(F.col(geom), crs or 4326, 6933)
    old = lambda name: ref(name).cast("double") if name in df.columns else F.lit(None).cast("double")
    sizes: dict[str, Column] = {"metrics:area": F.coalesce(old("metrics:area"), g.area(shape)), "metrics:perimeter": F.coalesce(old("metrics:perimeter"), g.length(shape))}
    return df.withColumns(sizes)


def improve(t: FeatureTable, rename: Mapping[str, str] | None = None, sizes: bool = False, fix: bool = False, explode: bool = False, crs: str | None = None) -> FeatureTable:
    """In this order: reproject, repair, explode multi-part geometries, rename, add sizes."""
    if crs:
        t = change_crs(t, crs)
    if fix:
        t = t.transform(fix_geometries, t.geometry)
    if explode:
        t = t.transform(g.explode_parts, t.geometry)
    if rename:
        t = t.with_(df=rename_columns(t.df, rename), collection=t.collection.renamed(rename))
    if sizes:
        t = t.with_(df=add_sizes(t.df, t.crs, t.geometry), collection=t.collection.with_extension(METRICS_SCHEMA))
    return t
