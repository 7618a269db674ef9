"""A feature table: rows as a lazy DataFrame, dataset-level metadata beside them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from featurekit.schema.collection import Collection


@dataclass(frozen=True)
class FeatureTable:
    """``df`` holds the features; ``collection`` what holds for all of them; ``crs`` the system of ``geometry``."""

    df: DataFrame
    collection: Collection = field(default_factory=Collection)
    crs: str | None = "EPSG:4326"
    geometry: str = "geometry"

    def transform(self, fn: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> FeatureTable:
        return replace(self, df=fn(self.df, *args, **kwargs))

    def with_(self, **changes: Any) -> FeatureTable:
        return replace(self, **changes)

    @property
    def columns(self) -> list[str]:
        return self.df.columns
