"""GeoJSON texts to shapes; broken ones as flagged rows."""

import json

from limnospark.operators import spatial as SP
from limnospark.sources import geojson as GJ

SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
HOLE = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]


def feature(geometry, **properties):
    return json.dumps({"type": "Feature", "geometry": geometry, "properties": properties})


TEXTS = {
    "polygon": feature({"type": "Polygon", "coordinates": [SQUARE, HOLE]}, name="p", size=3),
    "multi": feature({"type": "MultiPolygon", "coordinates": [[SQUARE], [[[9, 9, 100], [10, 9, 100], [10, 10, 100], [9, 9, 100]]]]}, name="m"),
    "line": json.dumps({"type": "LineString", "coordinates": [[0, 0], [1, 1.5], [2, 0]]}),
    "lines": json.dumps({"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5], [6, 6]]]}),
    "nothing": feature(None, name="n"),
    "point": json.dumps({"type": "Point", "coordinates": [1, 2]}),
    "cut": '{"type": "Polygon", "coordinates": [[[0, 0], [1,',
    "word": json.dumps({"type": "Polygon", "coordinates": [[["a", 0], [1, 1], [2, 2]]]}),
    "short": json.dumps({"type": "LineString", "coordinates": [[1], [2, 2]]}),
    "flat": json.dumps({"type": "Polygon", "coordinates": [[0, 0], [1, 1]]}),
    "empty": "", "null": None, "text": "no json",
}


def test_shapes_and_flags(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id string, text string")
    got = {r["id"]: r for r in GJ.read_texts(df, "text", {"name": "string", "size": "int"}).collect()}
    assert set(got) == set(TEXTS)
    assert {k for k, r in got.items() if r["ok"]} == {"polygon", "multi", "line", "lines", "nothing"}
    xy = lambda r: [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in r["shape"]]
    assert xy(got["polygon"]) == [[[tuple(map(float, p)) for p in SQUARE], [tuple(map(float, p)) for p in HOLE]]]
    assert [len(part) for part in xy(got["multi"])] == [1, 1] and xy(got["multi"])[1][0][0] == (9.0, 9.0)
    assert xy(got["line"]) == [[[(0.0, 0.0), (1.0, 1.5), (2.0, 0.0)]]] and len(xy(got["lines"])) == 2
    assert got["nothing"]["shape"] is None and got["nothing"]["name"] == "n" and got["polygon"]["size"] == 3
    assert all(r["shape"] is None and r["kind"] is None for r in got.values() if not r["ok"])


def test_files_to_joins(spark, tmp_path):
    (tmp_path / "a.geojsonl").write_text("\n".join(t.replace("\n", " ") for t in TEXTS.values() if t) + "\n\n")
    read = GJ.read_files(spark, str(tmp_path), {"name": "string"})
    assert read.count() == len([t for t in TEXTS.values() if t])
    areas = read.where("ok and kind like '%Polygon'").select("name", "shape")
    pts = spark.createDataFrame([(1, 3.0, 3.1), (2, 1.5, 1.6), (3, 9.9, 9.5), (4, 20.0, 20.0)], "id long, x double, y double")
    got = sorted((r["id"], r["name"]) for r in SP.points_in_shapes(pts, areas, "x", "y", "shape").select("id", "name").collect() if r["name"])
    assert got == [(1, "m"), (1, "p"), (2, "m"), (3, "m")]
    lines = GJ.paths(read.where("ok and kind like '%Line%'").withColumnRenamed("text", "lid"), "lid")
    assert lines.count() == 3
