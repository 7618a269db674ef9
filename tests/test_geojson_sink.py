"""The GeoJSON sink: parts that tasks write, joined in order; feature files with settled names."""

import json
import os

from pyspark.sql import functions as F

from featurekit.functions import geometry as g
from featurekit.schema.collection import Collection
from featurekit.sources import geojson
from featurekit.table import FeatureTable


def rows(spark, n, parts):
    df = spark.range(0, n, 1, parts).select(F.col("id").cast("string").alias("id"), F.concat(F.lit('na"me\n'), "id").alias("name"), g.point(F.col("id").cast("double"), F.lit(1.0)).alias("geometry"))
    return FeatureTable(df, Collection({"title": "é"}))


def test_parts_are_joined_in_order(spark, tmp_path):
    for n, parts, indent in ((50, 7, None), (3, 8, 2), (0, 3, None)):
        path = tmp_path / "deep" / f"{n}.json"
        geojson.write_geojson(rows(spark, n, parts), str(path), indent=indent)
        doc = json.loads(path.read_text(encoding="utf-8"))
        assert doc["title"] == "é" and [f["id"] for f in doc["features"]] == [str(i) for i in range(n)]
        assert all(f["properties"]["name"] == f'na"me\n{i}' for i, f in enumerate(doc["features"]))
        assert geojson.read_geojson(spark, str(path)).df.count() == n
    assert sorted(p.name for p in (tmp_path / "deep").iterdir()) == ["0.json", "3.json", "50.json"]
    geojson.write_geojson(rows(spark, 2, 1), str(tmp_path / "deep" / "50.json"))  # over an old one
    assert len(json.loads((tmp_path / "deep" / "50.json").read_text())["features"]) == 2


def test_nothing_is_left_where_a_task_fails(spark, tmp_path):
    t = rows(spark, 9, 3)
    bad = t.with_(df=t.df.withColumn("name", F.when(F.col("id") == "7", F.raise_error(F.lit("no"))).otherwise(F.col("name"))))
    (tmp_path / "a.json").write_text("old")
    try:
        geojson.write_geojson(bad, str(tmp_path / "a.json"))
    except Exception as e:
        assert "no" in str(e)
    assert os.listdir(tmp_path) == ["a.json"] and (tmp_path / "a.json").read_text() == "old"


def test_feature_files_have_settled_names(spark, tmp_path):
    ids = ["a", "b/c", "a", None, "", "..", "a~3", "b c", "é", "a"]
    df = spark.createDataFrame([(i, v, k) for i, (k, v) in enumerate(zip(ids, range(len(ids)), strict=True))], "o int, v int, id string").repartitionByRange(4, "o").sortWithinPartitions("o").drop("o")
    for indent in (None, 2):
        folder = str(tmp_path / f"each{indent}")
        files = geojson.write_features(FeatureTable(df), folder, indent=indent)
        assert [os.path.basename(f) for f in files] == ["a.json", "b_c.json", "a~3.json", "4.json", "5.json", "6.json", "a_3.json", "b_c~8.json", "é.json", "a~10.json"]
        assert sorted(os.listdir(folder)) == sorted(os.path.basename(f) for f in files)
        assert [json.load(open(f))["properties"]["v"] for f in files] == list(range(10))
    assert len(geojson.write_features(FeatureTable(df), str(tmp_path / "few"), num=3)) == 3
