"""Vector source (A4): GeoJSON texts, a feature or a bare geometry per row.

Polygon, MultiPolygon, LineString and MultiLineString become one shape: an
array of parts, a part an array of rings (its outline first, then its holes),
a ring an array of struct(x, y). A line is a part of one ring that is its
path. Each text is parsed by declared schemas; a text that is broken, names
another type, or holds a place without two finite numbers gives a row with
``ok`` false and no shape, and a NULL geometry one with ``ok`` true and no
shape, so no row is lost and no file fails for one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: type -> depth of its coordinates (places are arrays of numbers).
DEPTHS = {"LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}
SHAPE = "array<array<array<struct<x: double, y: double>>>>"


def _parsed(text: Column, depth: int) -> Column:
    kind = "array<" * depth + "double" + ">" * depth
    return F.from_json(text, kind, {"mode": "PERMISSIVE"})


def _places(path: Column) -> Column:
    return F.transform(path, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def read_texts(df: DataFrame, text: str, attributes: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``kind``, ``shape``, ``ok`` and, from the properties of a
    feature, the columns of ``attributes`` (name -> type)."""
    body = F.col(text)
    doc = F.get_json_object(body, "$.type")
    feature = doc == "Feature"
    kind = F.when(feature, F.get_json_object(body, "$.geometry.type")).otherwise(doc)
    coords = F.when(feature, F.get_json_object(body, "$.geometry.coordinates")).otherwise(F.get_json_object(body, "$.coordinates"))
    out = df.withColumns({"kind": kind, "_coords": coords, "_feature": F.coalesce(feature, F.lit(False))})
    shapes = {
        "LineString": lambda c: F.array(F.array(_places(_parsed(c, 2)))),
        "MultiLineString": lambda c: F.transform(_parsed(c, 3), lambda line: F.array(_places(line))),
        "Polygon": lambda c: F.array(F.transform(_parsed(c, 3), _places)),
        "MultiPolygon": lambda c: F.transform(_parsed(c, 4), lambda part: F.transform(part, _places)),
    }
    shape = F.lit(None).cast(SHAPE)
    for name, f in shapes.items():
        shape = F.when((F.col("kind") == name) & F.col("_coords").isNotNull(), f(F.col("_coords")).cast(SHAPE)).otherwise(shape)
    out = out.withColumn("shape", shape)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    broken = F.exists("shape", lambda part: part.isNull() | F.exists(part, lambda ring: ring.isNull() | F.exists(
        ring, lambda p: p.isNull() | bad(p["x"]) | bad(p["y"]))))
    nothing = F.col("_feature") & F.col("kind").isNull() & F.coalesce(F.get_json_object(body, "$.properties").isNotNull(), F.lit(False))
    whole = F.col("shape").isNotNull() & ~F.coalesce(broken, F.lit(True))
    out = out.withColumn("ok", F.coalesce(whole | nothing, F.lit(False)))
    out = out.withColumns({"shape": F.when(F.col("ok"), F.col("shape")), "kind": F.when(F.col("ok"), F.col("kind"))})
    for name, type_ in (attributes or {}).items():
        out = out.withColumn(name, F.get_json_object(body, f"$.properties.{name}").try_cast(type_))
    return out.drop("_coords", "_feature")


def read_files(spark: SparkSession, path: str, attributes: dict[str, str] | None = None) -> DataFrame:
    """Files with a feature per line (a line that ends in a comma too)."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), ",$", "").alias("text")).where("text <> ''")
    return read_texts(lines, "text", attributes)


def paths(df: DataFrame, *keep: str, shape: str = "shape", out: str = "path") -> DataFrame:
    """A row per path of line shapes."""
    return df.select(*keep, F.explode(F.flatten(shape)).alias(out))
