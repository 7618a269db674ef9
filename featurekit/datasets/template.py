"""A converter to start from; copy it and change what the source needs."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurekit.plans.convert import AdminConverter


class Template(AdminConverter):
    id = "xx"
    short_name = "Country"
    title = "Field boundaries for Country"
    description = "What the dataset holds."
    sources = "https://example.org/fields.zip"
    columns = {"geometry": "geometry", "FID": "id", "AREA_M2": "metrics:area", "VALID_FROM": "determination:datetime"}
    column_filters = {"TYPE": lambda c: (c.isin("water"), True)}
    column_migrations = {"AREA_M2": lambda c: c * 0.0001, "VALID_FROM": lambda c: F.to_timestamp(c, "d.M.yyyy")}
    missing_schemas = {"properties": {"metrics:area": {"type": "float", "minimum": 0}}}
