"""GeoJSON and TopoJSON features as rows: feature_id, rings, properties.

Both are read as whole-text JSON and taken apart by JSON functions; TopoJSON's
arcs, differences of integers, are summed up and strung together by array
functions.  Line and point geometries have no rings.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.functions import geometry

FEATURES = "struct<features:array<struct<id:string,geometry:string,properties:map<string,string>>>,geometry:string,type:string,properties:map<string,string>>"
POLYGON, MULTI = "struct<coordinates:array<array<array<double>>>>", "struct<coordinates:array<array<array<array<double>>>>>"


def _point(x: Column, y: Column) -> Column:
    return F.named_struct(F.lit("x"), x, F.lit("y"), y)


def rings_of(geo: Column) -> Column:
    """Rings of a GeoJSON geometry in text; null for other kinds."""
    points = lambda r: F.transform(r, lambda p: _point(F.get(p, 0), F.get(p, 1)))
    kind = F.get_json_object(geo, "$.type")
    one = F.transform(F.from_json(geo, POLYGON)["coordinates"], points)
    many = F.transform(F.flatten(F.from_json(geo, MULTI)["coordinates"]), points)
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many).cast(geometry.RINGS)


def parse_geojson(texts: DataFrame, column: str = "value") -> DataFrame:
    """Features of collections, or the one feature or bare geometry that a text is."""
    v = F.from_json(F.col(column), FEATURES)
    kind = F.get_json_object(column, "$.type")
    single = F.array(F.struct(F.get_json_object(column, "$.id").alias("id"), F.when(kind == "Feature", v["geometry"]).otherwise(F.col(column)).alias("geometry"), v["properties"].alias("properties")))
    rows = texts.select(F.posexplode(F.when(kind == "FeatureCollection", v["features"]).otherwise(single)).alias("i", "f"))
    return rows.select(F.coalesce(F.col("f.id"), F.col("i").cast("string")).alias("feature_id"), rings_of(F.col("f.geometry")).alias("rings"), F.col("f.properties").alias("properties")).where("rings is not null")


TOPOLOGY = "struct<transform:struct<scale:array<double>,translate:array<double>>,arcs:array<array<array<double>>>,objects:map<string,string>>"
PARTS = "struct<type:string,geometries:array<struct<type:string,id:string,arcs:string,properties:map<string,string>>>,arcs:string,id:string,properties:map<string,string>>"


def parse_topojson(texts: DataFrame, column: str = "value") -> DataFrame:
    """Polygons of a topology's objects, their arcs decoded."""
    t = F.from_json(F.col(column), TOPOLOGY)
    scale, move = t["transform"]["scale"], t["transform"]["translate"]

    def points(arc: Column) -> Column:
        raw = F.transform(arc, lambda p: _point(F.get(p, 0), F.get(p, 1)))
        step = lambda acc, p: F.concat(acc, F.array(_point(F.element_at(acc, -1)["x"] + p["x"], F.element_at(acc, -1)["y"] + p["y"])))
        zero = F.array(_point(F.lit(0.0), F.lit(0.0)))
        summed = F.aggregate(raw, zero, step)
        placed = F.transform(F.slice(summed, F.lit(2), F.size(arc)), lambda p: _point(p["x"] * F.get(scale, 0) + F.get(move, 0), p["y"] * F.get(scale, 1) + F.get(move, 1)))
        return F.when(scale.isNull(), raw).otherwise(placed)

    rows = texts.select(F.transform(t["arcs"], points).alias("arcs"), F.explode(F.map_values(t["objects"])).alias("o"))
    rows = rows.withColumn("o", F.from_json("o", PARTS))
    each = F.when(F.col("o.type") == "GeometryCollection", F.col("o.geometries")).otherwise(F.array(F.struct(F.col("o.type").alias("type"), F.col("o.id").alias("id"), F.col("o.arcs").alias("arcs"), F.col("o.properties").alias("properties"))))
    rows = rows.select("arcs", F.posexplode(each).alias("i", "g"))
    paths = F.when(F.col("g.type") == "Polygon", F.from_json("g.arcs", "array<array<int>>")).when(F.col("g.type") == "MultiPolygon", F.flatten(F.from_json("g.arcs", "array<array<array<int>>>")))
    # a negative number is the arc of its complement, backwards; arcs share their end points
    arc = lambda k: F.when(k < 0, F.reverse(F.get(F.col("arcs"), -k - 1))).otherwise(F.get(F.col("arcs"), k))
    ring = lambda ks: F.flatten(F.transform(ks, lambda k, i: F.when(i == 0, arc(k)).otherwise(F.slice(arc(k), F.lit(2), F.greatest(F.size(arc(k)) - 1, F.lit(0))))))
    return rows.select(F.coalesce(F.col("g.id"), F.col("i").cast("string")).alias("feature_id"), F.transform(paths, ring).cast(geometry.RINGS).alias("rings"), F.col("g.properties").alias("properties")).where("rings is not null")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON or TopoJSON files, each as its own type says."""
    texts = spark.read.text(path, wholetext=True)
    kind = F.get_json_object("value", "$.type")
    return parse_geojson(texts.where(kind != "Topology")).unionByName(parse_topojson(texts.where(kind == "Topology")))


def read_raw(spark: SparkSession, path: str) -> dict:
    """One file's JSON as it stands, for serving."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def total_bounds(features: DataFrame) -> DataFrame:
    """min_x, min_y, max_x and max_y over all features."""
    b = features.select(geometry.bounds(F.col("rings")).alias("b"))
    return b.agg(F.min("b.min_x").alias("min_x"), F.min("b.min_y").alias("min_y"), F.max("b.max_x").alias("max_x"), F.max("b.max_y").alias("max_y"))


def xml_bounds(texts: DataFrame, column: str = "value") -> DataFrame:
    """south, west, north and east of a tile map resource; null where there is no bounding box."""
    at = lambda a: F.xpath_string(F.col(column), F.lit(f"//BoundingBox/@{a}"))
    rest = [c for c in texts.columns if c != column]
    return texts.select(*rest, *(at(a).try_cast("double").alias(n) for a, n in (("miny", "south"), ("minx", "west"), ("maxy", "north"), ("maxx", "east"))))
