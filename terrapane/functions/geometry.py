"""Polygons as arrays of rings, and their relations to rectangles, as Column expressions.

A geometry is array<array<struct<x, y>>>: all rings of all its polygons, holes
among them, each closed or not.  By the even-odd rule a point is inside if a ray
from it crosses an odd number of edges, whatever ring they belong to.  Sets are
closed: touching counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def edges(rings: Column) -> Column:
    """array<struct(ax, ay, bx, by)> of all rings, each closed to its first point."""

    def of(r: Column) -> Column:
        return F.transform(r, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.coalesce(F.get(r, i + 1), F.get(r, F.lit(0)))["x"].alias("bx"), F.coalesce(F.get(r, i + 1), F.get(r, F.lit(0)))["y"].alias("by")))

    return F.flatten(F.transform(rings, of))


def bounds(rings: Column) -> Column:
    """struct(min_x, min_y, max_x, max_y) of all vertices."""
    p = F.flatten(rings)
    of = lambda c, f: f(F.transform(p, lambda v: v[c]))
    return F.struct(of("x", F.array_min).alias("min_x"), of("y", F.array_min).alias("min_y"), of("x", F.array_max).alias("max_x"), of("y", F.array_max).alias("max_y"))


def contains(edge_list: Column, x: Column, y: Column) -> Column:
    """Even-odd rule for a point; points on an edge are left to the edges' own test."""
    crossed = F.filter(edge_list, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0))))
    return F.size(crossed) % 2 == 1


def segment_meets_box(e: Column, w: Column, s: Column, east: Column, n: Column) -> Column:
    """Separating axes of a segment and a closed rectangle: x, y and the segment's normal."""
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    side = lambda x, y: dx * (y - e["ay"]) - dy * (x - e["ax"])
    corners = [side(w, s), side(w, n), side(east, s), side(east, n)]
    return (
        (F.least(e["ax"], e["bx"]) <= east) & (F.greatest(e["ax"], e["bx"]) >= w) & (F.least(e["ay"], e["by"]) <= n) & (F.greatest(e["ay"], e["by"]) >= s)
        & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)
    )


def meets_box(rings: Column, w: Column, s: Column, east: Column, n: Column) -> Column:
    """Whether a geometry and a closed rectangle share a point: an edge meets it, or it lies within."""
    e = edges(rings)
    return F.exists(e, lambda x: segment_meets_box(x, w, s, east, n)) | contains(e, w, s)


def rectangle(w: Column, s: Column, e: Column, n: Column) -> Column:
    """The rings of a rectangle."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(p(w, s), p(e, s), p(e, n), p(w, n), p(w, s)))
