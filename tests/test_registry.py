import pytest

from featurekit.registry import Encoding, Registry


def test_encodings():
    r = Registry()
    assert r.encoding("a.geojson").name == "GeoJSON" and r.encoding("b.parquet").columnar
    with pytest.raises(ValueError, match="Unsupported"):
        r.encoding("c.shp")
    own = Encoding("Own", (".own", ".json"), None, None, None)
    r.register(own)
    assert r.encoding("x.json") is own and Registry().encoding("x.json").name == "GeoJSON"
