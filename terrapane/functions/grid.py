"""Names and arithmetic of the 0.1 degree grid and its 5 degree blocks.

Coordinates are integer hundredths of a degree (``lon_c``, ``lat_c``), so that
equality, joins and names are exact: formatting a double to two decimals rounds
its decimal form in Spark and its binary form elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL_C = 10  # hundredths of a degree
BLOCK = 5  # degrees

# The formats of names and paths.
GRID_PREFIX = "grid_"
GRID_NAME = r"^grid_(-?[0-9]+\.[0-9]+)_(-?[0-9]+\.[0-9]+)"
BLOCK_FILE = r"^registry_([0-9]{4})_lon(-?[0-9]+)_lat(-?[0-9]+)\.txt$"
TILES_BLOCK_FILE = r"^registry_tiles_lon(-?[0-9]+)_lat(-?[0-9]+)\.txt$"
REGISTRY_FOLDER = "registry"


def hundredths(degrees: Column) -> Column:
    """Degrees as a double to hundredths."""
    return F.round(degrees * 100).cast("int")


def degrees(c: Column) -> Column:
    return c.cast("double") / F.lit(100.0)


def two_decimals(c: Column) -> Column:
    """Hundredths as text with two decimals; there is no negative zero."""
    a = F.abs(c)
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.floor(a / 100).cast("string"), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))


def tile_name(lon_c: Column, lat_c: Column) -> Column:
    """``grid_{lon}_{lat}``, longitude first."""
    return F.concat(F.lit(GRID_PREFIX), two_decimals(lon_c), F.lit("_"), two_decimals(lat_c))


def embedding_path(year: Column, lon_c: Column, lat_c: Column) -> Column:
    name = tile_name(lon_c, lat_c)
    return F.concat(year.cast("string"), F.lit("/"), name, F.lit("/"), name, F.lit(".npy"))


def scales_path(year: Column, lon_c: Column, lat_c: Column) -> Column:
    name = tile_name(lon_c, lat_c)
    return F.concat(year.cast("string"), F.lit("/"), name, F.lit("/"), name, F.lit("_scales.npy"))


def landmask_path(lon_c: Column, lat_c: Column) -> Column:
    return F.concat(tile_name(lon_c, lat_c), F.lit(".tiff"))


def block_of(c: Column) -> Column:
    """The block's lower corner in whole degrees, for hundredths on either side of zero."""
    return (F.floor(c / F.lit(100.0 * BLOCK)) * BLOCK).cast("int")


def block_file(year: Column, block_lon: Column, block_lat: Column) -> Column:
    return F.concat(F.lit("registry_"), year.cast("string"), F.lit("_lon"), block_lon.cast("string"), F.lit("_lat"), block_lat.cast("string"), F.lit(".txt"))


def tiles_block_file(block_lon: Column, block_lat: Column) -> Column:
    return F.concat(F.lit("registry_tiles_lon"), block_lon.cast("string"), F.lit("_lat"), block_lat.cast("string"), F.lit(".txt"))


def registry_path(base: Column | str, file: Column) -> Column:
    """The file in its flat folder below a base."""
    return F.concat_ws("/", F.lit(base) if isinstance(base, str) else base, F.lit(REGISTRY_FOLDER), file)


def parsed_grid_name(name: Column) -> Column:
    """struct(lon, lat) of a name's leading coordinates; null if it has none."""
    hit = lambda k: F.regexp_extract(name, GRID_NAME, k)
    return F.when(name.rlike(GRID_NAME), F.struct(hit(1).cast("double").alias("lon"), hit(2).cast("double").alias("lat")))


def split_grid_name(name: Column) -> Column:
    """struct(lon, lat) of a name that is the prefix and just two numbers, in any notation; else null."""
    parts = F.split(F.substr(name, F.lit(len(GRID_PREFIX) + 1)), "_")
    lon, lat = (F.get(parts, k).try_cast("double") for k in (0, 1))
    return F.when(F.startswith(name, F.lit(GRID_PREFIX)) & (F.size(parts) == 2) & lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def parsed_block_file(name: Column) -> Column:
    """struct(year, block_lon, block_lat); null for tile registries, indexes and others."""
    hit = lambda k: F.regexp_extract(name, BLOCK_FILE, k).cast("int")
    return F.when(name.rlike(BLOCK_FILE), F.struct(hit(1).alias("year"), hit(2).alias("block_lon"), hit(3).alias("block_lat")))


def is_registry_file(name: Column) -> Column:
    return name.rlike(r"^registry_.*\.txt$")


def is_year(name: Column) -> Column:
    return name.rlike("^[0-9]{4}$")


def blocks_between(low: Column, high: Column) -> Column:
    """Lower corners of all blocks from one coordinate to another, both in hundredths and included."""
    return F.when(high >= low, F.sequence(block_of(low), block_of(high), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))


def snapped(low: Column, high: Column) -> tuple[Column, Column]:
    """Bounds in hundredths, outwards to the grid of tenths."""
    return (F.floor(low / F.lit(10.0)) * 10).cast("int"), (F.ceil(high / F.lit(10.0)) * 10).cast("int")


def overlaps(w1: Column, s1: Column, e1: Column, n1: Column, w2: Column, s2: Column, e2: Column, n2: Column) -> Column:
    """Rectangles that share an area; touching is not enough."""
    return (w1 < e2) & (e1 > w2) & (s1 < n2) & (n1 > s2)


def tile_box(lon_c: Column, lat_c: Column, anchor: str = "corner") -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat) in degrees; coordinates name the lower corner or the centre."""
    back = {"corner": 0, "center": CELL_C // 2}[anchor]
    w, s = degrees(lon_c - back), degrees(lat_c - back)
    return F.struct(w.alias("min_lon"), s.alias("min_lat"), (w + F.lit(0.1)).alias("max_lon"), (s + F.lit(0.1)).alias("max_lat"))


def tile_route(path: Column) -> Column:
    """What follows ``/tiles/`` in a request's path, whole; null for other paths."""
    return F.when(F.startswith(path, F.lit("/tiles/")), F.substr(path, F.lit(len("/tiles/") + 1)))


def slippy(lon: Column, lat: Column, zoom: Column) -> Column:
    """struct(x, y) of the web-map tile that holds a point, in degrees."""
    n = F.pow(F.lit(2.0), zoom)
    y = (1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * n
    whole = lambda v: F.greatest(F.lit(0), F.least(F.floor(v), n - 1)).cast("int")
    return F.struct(whole((lon + 180) / 360 * n).alias("x"), whole(y).alias("y"))
