"""Selections by bounds and polygons.

A join of many regions with tiles goes through 0.1 degree cells: a region is
exploded into the cells it can touch, a tile stands in the cell of its lower
corner, and an equi-join on the cell is refined by the exact predicate.  A plain
theta join of the two would be a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapane.functions import geometry, grid

BOUNDS = ("min_lon_c", "min_lat_c", "max_lon_c", "max_lat_c")


def _cells(low: Column, high: Column) -> Column:
    """Cells whose tile can reach from ``low`` to ``high``: also the one below."""
    cell = lambda c: F.floor(c / F.lit(float(grid.CELL_C))).cast("int")
    return F.sequence(cell(low - grid.CELL_C), cell(high))


def binned(regions: DataFrame, tiles: DataFrame, keep: Column | None = None) -> DataFrame:
    """region x tile pairs whose bounds touch, by an equi-join on cells; ``keep`` refines them.

    A tile has one cell, so a pair comes up once.
    """
    spread = regions.withColumn("__x", F.explode(_cells(F.col(BOUNDS[0]), F.col(BOUNDS[2])))).withColumn("__y", F.explode(_cells(F.col(BOUNDS[1]), F.col(BOUNDS[3]))))
    cell = lambda c: F.floor(F.col(c) / F.lit(float(grid.CELL_C))).cast("int")
    at = tiles.withColumns({"__x": cell("lon_c"), "__y": cell("lat_c")})
    pairs = spread.join(at, ["__x", "__y"]).drop("__x", "__y")
    return pairs if keep is None else pairs.where(keep)


def _box() -> tuple[Column, ...]:
    lon, lat = F.col("lon_c"), F.col("lat_c")
    return lon, lat, lon + grid.CELL_C, lat + grid.CELL_C


def overlapping(regions: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pairs that share an area."""
    return binned(regions, tiles, grid.overlaps(*_box(), *(F.col(c) for c in BOUNDS)))


def snapped(regions: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pairs whose tile's corner lies in the region's bounds, snapped outwards to tenths.

    The older prefilter, kept for parity: it misses tiles that start left of or
    below the snapped bounds.
    """
    (w, e), (s, n) = (grid.snapped(F.col(BOUNDS[a]), F.col(BOUNDS[b])) for a, b in ((0, 2), (1, 3)))
    wide = regions.withColumns({"__w": w, "__s": s, "__e": e, "__n": n})
    grown = wide.withColumns({BOUNDS[0]: F.col("__w"), BOUNDS[1]: F.col("__s"), BOUNDS[2]: F.col("__e"), BOUNDS[3]: F.col("__n")})
    inside = F.col("lon_c").between(F.col("__w"), F.col("__e")) & F.col("lat_c").between(F.col("__s"), F.col("__n"))
    return binned(grown, tiles, inside).drop("__w", "__s", "__e", "__n")


def meeting(regions: DataFrame, tiles: DataFrame, unit: float = 1.0) -> DataFrame:
    """Pairs whose polygon (``rings``) and tile share a point; ``unit`` scales hundredths to the rings' unit."""
    w, s, e, n = (c.cast("double") * unit for c in _box())
    return binned(regions, tiles, geometry.meets_box(F.col("rings"), w, s, e, n))


def tiles_of(regions: DataFrame, tiles: DataFrame, unit: float = 1.0, year: int | None = None) -> DataFrame:
    """Tiles that meet any of the regions, each once: what a union of the regions meets."""
    if year is not None:
        tiles = tiles.where(F.col("year") == year)
    return meeting(regions, tiles, unit).select(*tiles.columns).distinct()


def with_masks(tiles: DataFrame, masks: DataFrame) -> DataFrame:
    """Tiles with the land mask of their place; tiles without one go."""
    return tiles.join(masks, ["lon_c", "lat_c"])
