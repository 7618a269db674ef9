"""Footers read by tasks, and files that a box leaves out."""

import pytest
from pyspark.sql import functions as F

from featurekit.functions import geometry as g
from featurekit.sources import geoparquet
from featurekit.table import FeatureTable


@pytest.mark.parametrize("version", ["1.1.0", "1.0.0"])
def test_only_files_that_meet_a_box_are_planned(spark, tmp_path, monkeypatch, version):
    """With a covering column by its statistics; without one, by the box in the metadata, or not at all."""
    df = spark.range(0, 4000).select(F.col("id").cast("string").alias("id"), F.lit("c").alias("collection"), g.point(F.col("id").cast("double"), F.col("id") % 7 * 1.0).alias("geometry"))
    path = str(tmp_path / "many")
    geoparquet.write_geoparquet(FeatureTable(df.repartitionByRange(40, F.col("id").cast("int"))), path, version=version)
    found = geoparquet.footers(spark, path).collect()
    assert len(found) == 40 and sum(r["rows"] for r in found) == 4000
    monkeypatch.setattr(geoparquet, "FEW", 3)
    by_tasks, here = geoparquet.footer(path, spark), geoparquet.footer(path)
    assert by_tasks == here and here.rows == 4000 and geoparquet.footer(path, sums=False).rows < 4000
    for box in ((1000.0, 2.0, 1100.0, 4.0), (-9.0, -9.0, -1.0, 99.0), (3999.0, 0.0, 5000.0, 9.0)):
        t = geoparquet.read_geoparquet(spark, path, box=box)
        want = {str(i) for i in range(4000) if box[0] <= i <= box[2] and box[1] <= i % 7 <= box[3]}
        assert {r["id"] for r in t.df.select("id").collect()} == want
        if version == "1.1.0":
            assert len(t.df.inputFiles()) <= (3 if want else 40)
    one = geoparquet.read_geoparquet(spark, path, box=(1000.0, 0.0, 1001.0, 9.0), properties=["id"]).df
    assert one.columns == ["id"]
