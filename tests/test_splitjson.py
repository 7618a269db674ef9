"""The splittable GeoJSON scan against json.loads, with cuts at every place."""

import json
import random

import pytest
from pyspark.sql import functions as F

from featurekit.sources import geojson, splitjson

ODD = ["", "a", 'q"q', "back\\slash", "\\\\", '\\"', "]}[{,", "é日𝄞", "\n\t", '"features":[', "\\" * 70 + '"', "x" * 300]


def document(seed, n, **members):
    rng = random.Random(seed)
    features = [
        {"type": "Feature", "id": str(i), "geometry": {"type": "Point", "coordinates": [i, -i]}, "properties": {"name": rng.choice(ODD), "tags": [rng.choice(ODD), {"k": [1, [2]]}], "n": i}}
        for i in range(n)
    ]
    before = {"title": rng.choice(ODD), "links": [{"href": rng.choice(ODD)}], "type": "FeatureCollection", "empty": []}
    return before | {"features": features, "last": {"features": [1, {"a": rng.choice(ODD)}]}, "list": [[], [{}]]} | members


def read(spark, path, size):
    found = splitjson.layout(spark, str(path), size)
    return found, [json.loads(r["value"]) for r in splitjson.scan(spark, found).collect()]


@pytest.mark.parametrize("indent,ascii_only", [(None, True), (2, False)])
def test_ranges_of_any_size_give_the_same_features(spark, tmp_path, indent, ascii_only):
    path = tmp_path / "a.json"
    doc = document(1, 60)
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    for size in (97, 1000, 1 << 20):
        found, features = read(spark, path, size)
        assert features == doc["features"]
        assert found.members == {k: v for k, v in doc.items() if k != "features"}


@pytest.mark.parametrize("chunk", [1, 3, 7, 50])
def test_states_at_every_cut(monkeypatch, tmp_path, chunk):
    """Every cut's state by both cases equals a scan character by character; elements are taken once each."""
    path = tmp_path / "a.json"
    doc = document(2, 12)
    raw = json.dumps(doc).encode()
    path.write_bytes(raw)
    monkeypatch.setattr(splitjson.chunks, "__defaults__", (chunk,))
    states, inside, depth, escaped = [], False, 0, False
    for b in raw:
        states.append((inside, depth))
        c = chr(b)
        if inside:
            inside, escaped = (inside, not escaped) if c == "\\" else (not (c == '"' and not escaped), False)
        elif c == '"':
            inside = True
        else:
            depth += (c in "[{") - (c in "]}")
    opens = raw.index(b'"features": [{"type"') + 12
    whole = json.dumps(doc["features"]).encode()
    closes = opens + len(whole) - 1
    with splitjson._opened(str(path)) as f:
        for step in (31, 200):
            cuts = [*dict.fromkeys(splitjson.aligned(f, p, len(raw)) for p in range(0, len(raw), step)), len(raw)]
            got = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                assert raw[a - 1 : a] != b"\\" or a == 0
                parity, cases = splitjson.summed_up(f, a, b)
                end = states[b] if b < len(raw) else (False, 0)
                assert (states[a][0] ^ bool(parity), states[a][1] + cases[states[a][0]][0]) == end
                got += splitjson.elements(f, splitjson.Range(a, b, *states[a], 0), opens, closes)
            assert [json.loads(x) for x in got] == doc["features"]


def test_first_features_read_no_further(spark, tmp_path):
    """With num the middle of the file is not looked at: it may even be broken."""
    path = tmp_path / "a.json"
    doc = document(3, 2000)
    raw = json.dumps(doc)
    middle = len(raw) // 2
    path.write_text(raw[:middle] + "\x00" * 10 + raw[middle:])
    found, features, kind = geojson.scan(spark, str(path), num=5)
    assert [json.loads(r[0]) for r in features.select(F.to_json("f")).collect()] == doc["features"][:5] and kind == "FeatureCollection"
    assert dict(found.items()) == {k: v for k, v in doc.items() if k not in geojson.MEMBERS}
    assert geojson.scan(spark, str(path), num=0)[1].count() == 0
    assert geojson.read_geojson(spark, str(path), num=3, properties=["n", "id"]).df.collect() == [("0", 0), ("1", 1), ("2", 2)]


def test_odd_documents(spark, tmp_path):
    path = tmp_path / "a.json"

    def put(text):
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    for text in ('{"type":"FeatureCollection","features":[]}', '{"features": [ \n ] , "type":"FeatureCollection"}', '{"type":"FeatureCollection"}'):
        for size in (5, 1000):
            assert read(spark, put(text), size)[1] == []
        assert geojson.scan(spark, str(path), num=3)[1].count() == 0
    assert read(spark, put(b"\xef\xbb\xbf" + b'{"type":"FeatureCollection","features":[{"a":1} ,null]}'), 8)[1] == [{"a": 1}, None]
    one = {"type": "Feature", "id": "x", "geometry": None, "properties": {"a": [1]}, "title": "t", "more": {"b": [2]}}
    found, features = read(spark, put(json.dumps(one)), 10)
    assert features == [one] and found.kind == "Feature" and found.members["more"] == {"b": [2]}
    bad = ['{"type":"FeatureCollection","features":[{"a":"}]}', '{"type":"Point","coordinates":[1,2]}', "[1,2]", "", "nothing", '{"type":"FeatureCollection","features":{"a":1}}', '{"type":"Feature"}{"type":"Feature"}']
    for text in bad:
        with pytest.raises(ValueError):
            splitjson.layout(spark, put(text), 16)
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING|PARSE"):  # brackets are counted by a scan, matched by the parser
        geojson.scan(spark, put('{"type":"FeatureCollection","features":[{]}}'))[1].collect()
    with pytest.raises(FileNotFoundError):
        splitjson.layout(spark, str(tmp_path / "none.json"))


def test_folders_are_read_document_by_document(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"type": "Feature", "id": str(i), "geometry": None, "properties": {"n": i}}))
    assert sorted(r["n"] for r in geojson.read_geojson(spark, str(tmp_path)).df.collect()) == [0, 1, 2]
