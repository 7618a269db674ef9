"""Row groups of files that several tasks write."""

import pytest
from pyspark.sql import functions as F

from featurekit.functions import geometry as g
from featurekit.sources import geoparquet
from featurekit.table import FeatureTable


@pytest.mark.parametrize("rows", [260_001, 100_000, 24_999])
def test_full_groups(spark, tmp_path, rows):
    df = spark.range(0, rows, 1, 7).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("collection"), g.point(F.col("id"), F.col("id")).alias("geometry"))
    geoparquet.write_geoparquet(FeatureTable(df), str(tmp_path / "out"), compression="snappy", full=True)
    files = list((tmp_path / "out").glob("*.parquet"))
    f = geoparquet.footer(str(tmp_path / "out"))
    assert (f.rows, f.groups) == (rows, -(-rows // 25_000))
    assert spark.read.parquet(str(tmp_path / "out")).select("id").distinct().count() == rows
    assert rows < 200_000 or len(files) > 1
