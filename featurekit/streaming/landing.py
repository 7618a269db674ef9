"""Conversion of files as they land in a folder: the row-level plan of a converter over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from featurekit.functions.wkb import to_wkb
from featurekit.plans.convert import Converter
from featurekit.sources.geojson import read_features


def read_lines(spark: SparkSession, folder: str, types: dict[str, str]) -> DataFrame:
    """A stream of features from newline-delimited GeoJSON files of a folder; ``types`` are the properties' types."""
    return read_features(spark.readStream.text(folder).select(F.parse_json("value").alias("f")), types)


def convert_stream(source: DataFrame, converter: Converter, target: str, checkpoint: str) -> StreamingQuery:
    """Appends converted features to Parquet, geometry as WKB, by micro-batch; each batch is sorted by place."""

    def write(batch: DataFrame, number: int) -> None:
        t = converter.plan(batch)
        # A batch that runs again after a failure replaces its own folder.
        t.df.withColumn("geometry", to_wkb(F.col("geometry"))).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by time window and key, batch or stream; in a stream, rows later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
