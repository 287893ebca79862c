"""Mosaics: extent, placement, winners where tiles overlap, and whole pipelines.

Cells are rows (band, row, col, value, tile order); where tiles overlap, the
winner is an aggregate by cell (``max_by`` or ``min_by`` over the order) that
combines map-side, so a cell's candidates never have to meet whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapane.functions import crs as systems
from terrapane.functions import grid, pixel
from terrapane.operators import reproject, spatial

CELL = ("band", "row", "col")


def extent(tiles: DataFrame, *keys: str) -> DataFrame:
    """Bounds, density and size of the mosaic of ``tiles`` (lon_c, lat_c, tile_h, tile_w), by keys if any.

    The density is that of the first tile by latitude and longitude; all tiles
    are taken to have its shape.
    """
    lon, lat = grid.degrees(F.col("lon_c")), grid.degrees(F.col("lat_c"))
    order = F.struct("lat_c", "lon_c")
    ends = tiles.groupBy(*keys).agg(
        F.min(lon).alias("min_lon"), F.min(lat).alias("min_lat"), (F.max(lon) + F.lit(0.1)).alias("max_lon"), (F.max(lat) + F.lit(0.1)).alias("max_lat"),
        F.min_by("tile_w", order).alias("first_w"), F.min_by("tile_h", order).alias("first_h"),
    )
    dense = ends.withColumns({"ppd_x": F.col("first_w") / F.lit(0.1), "ppd_y": F.col("first_h") / F.lit(0.1)})
    sized = dense.withColumns({"width": ((F.col("max_lon") - F.col("min_lon")) * F.col("ppd_x")).cast("int"), "height": ((F.col("max_lat") - F.col("min_lat")) * F.col("ppd_y")).cast("int")})
    return sized.withColumns({"px": (F.col("max_lon") - F.col("min_lon")) / F.col("width"), "py": (F.col("max_lat") - F.col("min_lat")) / F.col("height")}).drop("first_w", "first_h")


def placed(tiles: DataFrame, extents: DataFrame, *keys: str) -> DataFrame:
    """``x`` and ``y`` of each tile's upper left pixel in its mosaic; rows count from the north."""
    lon, lat = grid.degrees(F.col("lon_c")), grid.degrees(F.col("lat_c"))
    joined = tiles.join(extents, list(keys)) if keys else tiles.join(F.broadcast(extents))
    x = ((lon - F.col("min_lon")) * F.col("ppd_x")).cast("int")
    y = ((F.col("max_lat") - lat - F.lit(0.1)) * F.col("ppd_y")).cast("int")
    return joined.withColumns({"x": x, "y": y})


def clipped_to(cells: DataFrame, height: Column | int, width: Column | int) -> DataFrame:
    """Cells within the mosaic."""
    h, w = (v if isinstance(v, Column) else F.lit(v) for v in (height, width))
    return cells.where((F.col("row") >= 0) & (F.col("row") < h) & (F.col("col") >= 0) & (F.col("col") < w))


def last_wins(cells: DataFrame, order: str | Column, keys: Sequence[str] = CELL) -> DataFrame:
    """The last tile's value of each cell, zeros too."""
    return cells.groupBy(*keys).agg(F.max_by("value", order).alias("value"))


def first_wins(cells: DataFrame, order: str | Column, keys: Sequence[str] = CELL) -> DataFrame:
    """The first nonzero value of each cell, since zero is no data; zero if there is none."""
    data = F.col("value") != 0
    by = F.col(order) if isinstance(order, str) else order
    return cells.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(data, F.col("value")), F.when(data, by)), F.lit(0.0)).alias("value"))


def finished(cells: DataFrame, normalize: bool = True) -> DataFrame:
    """Band, row, col and u8 of a merged mosaic; without normalizing, values are still clipped."""
    return (pixel.normalized_globally(cells) if normalize else cells).select(*CELL, pixel.to_u8(F.col("value")).alias("u8"))


def region_mosaic(pixels: DataFrame, tiles: DataFrame, masks: DataFrame, bands: Sequence[int], row: Column, col: Column, order: Column, on: str = "tile", normalize: bool = True) -> DataFrame:
    """The mosaic of a region: chosen tiles that have a land mask, their bands, first wins, one range for all.

    ``pixels`` has q and scale and the tile in column ``on``; ``tiles`` and
    ``masks`` are the region's, joined by place.  ``row`` and ``col`` map a pixel
    to the target grid and ``order`` ranks candidates.
    """
    bands = pixel.checked_bands(bands, exactly=3)
    chosen = spatial.with_masks(tiles, masks).select(on).distinct()
    kept = pixels.join(chosen, on, "left_semi")
    cells = pixel.exploded(kept, bands).withColumns({"row": row, "col": col, "__order": order})
    return finished(first_wins(cells, "__order"), normalize)


def tile_image(pixels: DataFrame, bands: Sequence[int], normalize: bool = True, tile: Sequence[str] = ("tile",)) -> DataFrame:
    """u8 bands of single tiles, each normalized for itself."""
    rows = pixel.exploded(pixels, bands)
    rows = pixel.normalized_by_tile(rows, tile) if normalize else rows
    return rows.withColumn("u8", pixel.to_u8(F.col("value"))).drop("value")


def polygon_mosaic(pixels: DataFrame, placed_tiles: DataFrame, bands: Sequence[int], height: int, width: int, order: Column, tile: Sequence[str] = ("tile",), normalize: bool = True) -> DataFrame:
    """The mosaic of tiles normalized one by one, the last on top.

    ``pixels`` has py and px, ``placed_tiles`` the tile's x and y.
    """
    rows = pixel.exploded(pixels, pixel.checked_bands(bands, exactly=3))
    rows = pixel.normalized_by_tile(rows, tile) if normalize else rows
    cells = rows.join(placed_tiles, list(tile)).withColumns({"row": F.col("y") + F.col("py"), "col": F.col("x") + F.col("px"), "value": pixel.clipped(F.col("value")), "__order": order})
    return last_wins(clipped_to(cells, height, width), "__order").select(*CELL, pixel.to_u8(F.col("value")).alias("u8"))


def mask_mosaic(cells: DataFrame, order: str) -> DataFrame:
    """Merged land masks as 0 and 255."""
    return pixel.visible(first_wins(cells, order, ("row", "col")).withColumn("value", F.col("value").cast("int")))


def pyramid_counts(tiles: DataFrame, zooms: Sequence[int]) -> DataFrame:
    """Tiles of the catalogue in each web-map tile, by their lower corner."""
    at = tiles.withColumn("z", F.explode(F.array(*map(F.lit, zooms)))).withColumn("__s", grid.slippy(grid.degrees(F.col("lon_c")), grid.degrees(F.col("lat_c")), F.col("z")))
    return at.groupBy("z", F.col("__s.x").alias("x"), F.col("__s.y").alias("y")).agg(F.count(F.lit(1)).alias("n"))


WORLD = 2 * math.pi * systems.A  # the web map's side in its own metres
WEB = "EPSG:3857"
PIXEL = ("z", "x", "y", "band", "py", "px")


def averaging_zoom(transform: Sequence[float], height: int, width: int, crs: str, size: int = 256, points: int = 9) -> int:
    """The deepest zoom whose pixels are 1.5 times as large as a raster's, or -1.

    Any square of 1.5 pixels holds a pixel's centre, so down to this zoom means
    over centres leave no gap; beyond it each pixel is looked up.  The raster's
    largest pixel at ``points`` squared places counts.
    """
    a, b, c, d, e, f = transform
    i, j = (n.reshape(-1) for n in np.meshgrid(np.linspace(0, width - 1, points), np.linspace(0, height - 1, points)))
    to = systems.between(crs, WEB, np)
    at = [to((i + k) * a + (j + n) * b + c, (i + k) * d + (j + n) * e + f) for k, n in ((0, 0), (1, 0), (0, 1))]
    sides = np.concatenate([np.hypot(at[k][0] - at[0][0], at[k][1] - at[0][1]) for k in (1, 2)])
    return max(-1, math.floor(math.log2(WORLD / (size * 1.5 * sides[np.isfinite(sides)].max()))))


def _web(x: Column, y: Column, zoom: Column | int, size: int) -> tuple[Column, Column]:
    """Pixel column and row of web-map metres at a zoom, not yet whole."""
    n = F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom) * size
    return (x / WORLD + 0.5) * n, (0.5 - y / WORLD) * n


def _by_tile(rows: DataFrame, size: int, *more: str) -> DataFrame:
    """Pixels (z, __x, __y over the whole map) as places within web tiles."""
    parts = {"x": F.floor(F.col("__x") / size).cast("int"), "y": F.floor(F.col("__y") / size).cast("int"), "px": (F.col("__x") % size).cast("int"), "py": (F.col("__y") % size).cast("int")}
    return rows.select("z", "band", "__x", "__y", *more).withColumns(parts).select(*PIXEL, *more)


def averaged(cells: DataFrame, transform: Sequence[float], crs: str, zooms: Sequence[int], size: int = 256) -> DataFrame:
    """PIXEL and mean ``value`` of the source cells (band, py, px, u8) whose centres a web-map pixel holds.

    The deepest zoom groups the cells; each other zoom sums the one below it, a
    quarter of its rows, and Spark computes a zoom's exchange once.
    """
    a, b, c, d, e, f = transform
    i, j = F.col("px") + 0.5, F.col("py") + 0.5
    x, y = _web(*systems.between(crs, WEB)(i * a + j * b + c, i * d + j * e + f), max(zooms), size)
    key = ("band", "__x", "__y")
    most = size * 2 ** max(zooms)
    at = cells.select("band", F.floor(x).alias("__x"), F.floor(y).alias("__y"), F.col("u8").cast("double").alias("u8")).where(F.col("__x").between(0, most - 1) & F.col("__y").between(0, most - 1))
    level = at.groupBy(*key).agg(F.sum("u8").alias("s"), F.count(F.lit(1)).alias("n"))
    out = None
    for z in range(max(zooms), min(zooms) - 1, -1):
        if z < max(zooms):
            halves = level.select("band", F.shiftright("__x", 1).alias("__x"), F.shiftright("__y", 1).alias("__y"), "s", "n")
            level = halves.groupBy(*key).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        if z in zooms:
            made = _by_tile(level.withColumns({"z": F.lit(z), "value": F.col("s") / F.col("n")}), size, "value")
            out = made if out is None else out.unionByName(made)
    return out


def looked_up(cells: DataFrame, transform: Sequence[float], crs: str, zooms: Sequence[int], size: int = 256) -> DataFrame:
    """PIXEL and ``value`` of the web-map pixels whose centres lie in the raster: that of the cell there.

    Each cell makes the pixels around its own outline and keeps those whose
    centres, mapped back, lie in it: no join, no shuffle, each pixel once.
    """
    a, b, c, d, e, f = transform
    p, q, r, s, t, u = reproject.inverted(tuple(transform))
    to, back = systems.between(crs, WEB), systems.between(WEB, crs)
    rows = cells.select("band", "py", "px", F.col("u8").cast("double").alias("value"), F.explode(F.array(*map(F.lit, zooms))).alias("z"))
    corners = [to((F.col("px") + k) * a + (F.col("py") + n) * b + c, (F.col("px") + k) * d + (F.col("py") + n) * e + f) for k in (0, 1) for n in (0, 1)]
    web = [_web(x, y, F.col("z"), size) for x, y in corners]
    most = F.pow(F.lit(2.0), F.col("z")).cast("long") * size - 1
    # a pixel more on each side: the outline of a cell may be bent
    first = lambda k: F.greatest(F.lit(0).cast("long"), F.floor(F.least(*(v[k] for v in web))) - 1)
    last = lambda k: F.least(most, F.floor(F.greatest(*(v[k] for v in web))) + 1)
    boxed = rows.withColumns({"x0": first(0), "x1": last(0), "y0": first(1), "y1": last(1)}).where("x0 <= x1 and y0 <= y1")
    each = boxed.withColumn("__x", F.explode(F.sequence("x0", "x1"))).withColumn("__y", F.explode(F.sequence("y0", "y1")))
    side = F.pow(F.lit(2.0), F.col("z")) * size
    x, y = back(((F.col("__x") + 0.5) / side - 0.5) * WORLD, (0.5 - (F.col("__y") + 0.5) / side) * WORLD)
    own = each.withColumns({"__j": F.floor(x * s + y * t + u), "__i": F.floor(x * p + y * q + r)}).where("__j = py and __i = px")
    return _by_tile(own, size, "value")


def pyramid(cells: DataFrame, transform: Sequence[float], height: int, width: int, crs: str, zooms: Sequence[int], size: int = 256) -> DataFrame:
    """PIXEL and value of a raster's web-map pixels: means where these are larger than its own, the cell there elsewhere.

    ``cells`` has band, py, px and u8.  Every web pixel within the raster has a
    value at every zoom.
    """
    edge = averaging_zoom(transform, height, width, crs, size)
    wide, deep = [z for z in zooms if z <= edge], [z for z in zooms if z > edge]
    parts = [how(cells, transform, crs, some, size) for how, some in ((averaged, wide), (looked_up, deep)) if some]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
