"""The client: one root folder, its catalogue, its tiles, and what is made of them.

Nothing is read when an engine is made.  Catalogues are lazy DataFrames over the
registries; fetching a tile reads just its two files.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.functions import crs as systems
from terrapane.functions import geometry, grid, pixel
from terrapane.operators import catalog, mosaic, registry, spatial
from terrapane.sources import geotiff, npy, png, vector

Bounds = tuple[float, float, float, float]


class Engine:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.registry = f"{self.root}/{grid.REGISTRY_FOLDER}"
        self.arrays = f"{self.root}/{registry.EMBEDDINGS}"
        self.mask_files = f"{self.root}/{registry.MASKS}"

    # catalogue

    def _entries(self, pattern: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.registry}/{pattern}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path):
            return self.spark.createDataFrame([], "path string, hash string")
        return catalog.parse_lines(self.spark.read.text(f"{self.registry}/{pattern}"))

    def catalog(self) -> DataFrame:
        """year, lat, lon, lon_c, lat_c, block and hash of every embedding, always complete."""
        rows = catalog.parsed_embeddings(self._entries("registry_[0-9]*_lon*_lat*.txt"))
        return catalog.with_blocks(rows.withColumns({"lon_c": grid.hundredths(F.col("lon")), "lat_c": grid.hundredths(F.col("lat"))}))

    def landmasks(self) -> DataFrame:
        rows = catalog.parsed_masks(self._entries("registry_tiles_lon*_lat*.txt"))
        return catalog.with_blocks(rows.withColumns({"lon_c": grid.hundredths(F.col("lon")), "lat_c": grid.hundredths(F.col("lat"))}))

    def list_embeddings(self, limit: int | None = None) -> DataFrame:
        return catalog.listed(self.catalog().select("year", "lat_c", "lon_c"), limit)

    def count_embeddings(self) -> int:
        return self.catalog().count()

    def years(self) -> list[int]:
        return [r["year"] for r in catalog.years(self.catalog()).collect()]

    def needs_fetch(self, copy: str) -> DataFrame:
        """Registry paths that a local copy of the arrays lacks or has with other contents."""
        return registry.stale_paths(self._entries("registry_[0-9]*_lon*_lat*.txt"), registry.files(self.spark, copy, "*.npy", content=True))

    def _array_entries(self) -> DataFrame:
        """One hash a path, as for an update."""
        return registry.known(self.spark, self.registry, "registry_[0-9]*_lon*_lat*.txt")

    # single tiles

    def embedding(self, lat: float, lon: float, year: int = 2024, bands: Sequence[int] | None = None, snap: bool = False) -> DataFrame:
        """py, px and embedding of one tile; ``snap`` moves a point to the tile that holds it."""
        lon_c, lat_c = (math.floor(v * 10 + 1e-9) * 10 + 5 if snap else round(v * 100) for v in (lon, lat))
        known = self.catalog().where((F.col("year") == year) & (F.col("lon_c") == lon_c) & (F.col("lat_c") == lat_c))
        if known.isEmpty():
            raise LookupError(f"no tile at {lat}, {lon} in {year}")
        name = f"grid_{lon_c / 100:.2f}_{lat_c / 100:.2f}"
        return npy.read_pixels(self.spark, f"{self.arrays}/{year}/{name}", bands=bands, dequantize=True, entries=self._array_entries()).select("py", "px", "embedding")

    def _folders(self, tiles: DataFrame) -> list[str]:
        """The folders of tiles; only these are listed and read."""
        rows = tiles.select(F.concat_ws("/", F.col("year").cast("string"), grid.tile_name(F.col("lon_c"), F.col("lat_c"))).alias("d")).distinct().collect()  # a row for each tile of the request
        if not rows:
            raise LookupError("no tile meets the region")
        return [f"{self.arrays}/{r['d']}" for r in rows]

    def _pixels(self, tiles: DataFrame, bands: Sequence[int]) -> DataFrame:
        """year, lon_c, lat_c, py, px, q, scale of tiles; q holds the chosen bands alone, in order."""
        return npy.read_pixels(self.spark, self._folders(tiles), bands=bands, entries=self._array_entries())

    def export_tile(self, lat: float, lon: float, out: str, year: int = 2024, bands: Sequence[int] = (0, 1, 2), normalize: bool = True) -> None:
        """One tile as an RGB GeoTIFF in EPSG:4326."""
        bands = pixel.checked_bands(bands, exactly=3)
        lon_c, lat_c = round(lon * 100), round(lat * 100)
        tile = self.catalog().where((F.col("year") == year) & (F.col("lon_c") == lon_c) & (F.col("lat_c") == lat_c))
        px = self._pixels(tile, bands).cache()
        height, width = px.agg(F.max("py") + 1, F.max("px") + 1).first()
        cells = mosaic.tile_image(px.withColumn("tile", F.lit(0)), range(3), normalize).withColumnsRenamed({"py": "row", "px": "col"})
        geotiff.write_mosaic(cells, out, [0, 1, 2], height, width, geotiff.from_bounds(lon, lat, lon + 0.1, lat + 0.1, width, height), "EPSG:4326")
        px.unpersist()

    # regions

    def region_tiles(self, features: DataFrame, year: int | None = None) -> DataFrame:
        """Tiles that meet any feature's polygon."""
        b = geometry.bounds(F.col("rings"))
        edge = lambda c, f: f(b[c] * 100).cast("int")
        regions = features.withColumns({"min_lon_c": edge("min_x", F.floor), "min_lat_c": edge("min_y", F.floor), "max_lon_c": edge("max_x", F.ceil), "max_lat_c": edge("max_y", F.ceil)})
        return spatial.tiles_of(regions, self.catalog(), unit=0.01, year=year)

    def region_image(self, path: str, out: str, bands: Sequence[int] = (0, 1, 2), normalize: bool = True, year: int = 2024) -> None:
        """Tiles that meet a file's polygons, normalized one by one, as one RGB GeoTIFF."""
        bands = pixel.checked_bands(bands, exactly=3)
        tiles = self.region_tiles(vector.read(self.spark, path), year).select("year", "lon_c", "lat_c").cache()
        px = self._pixels(tiles, bands).cache()
        shapes = px.groupBy("lon_c", "lat_c").agg((F.max("py") + 1).alias("tile_h"), (F.max("px") + 1).alias("tile_w"))
        if shapes.select("tile_h", "tile_w").distinct().count() > 1:
            raise ValueError("the tiles differ in shape")
        ends = mosaic.extent(shapes)
        e = ends.first()
        placed = mosaic.placed(shapes, ends).select("lon_c", "lat_c", "x", "y")
        order = F.struct("lat_c", "lon_c")
        cells = mosaic.polygon_mosaic(px, placed, range(3), e["height"], e["width"], order, ("lon_c", "lat_c"), normalize)
        geotiff.write_mosaic(cells, out, [0, 1, 2], e["height"], e["width"], geotiff.from_bounds(e["min_lon"], e["min_lat"], e["max_lon"], e["max_lat"], e["width"], e["height"]), "EPSG:4326")
        px.unpersist()
        tiles.unpersist()

    def _georeferenced(self, bounds: Bounds) -> DataFrame:
        """lon_c, lat_c, crs, size and transform of the land masks that overlap bounds."""
        near = catalog.within(self.landmasks(), tuple(round(v * 100) for v in bounds))
        rows = near.select("lon_c", "lat_c", "path").collect()  # a row for each tile of the request
        if not rows:
            raise LookupError("no land mask overlaps the bounds")
        head = geotiff.read_meta(self.spark, [f"{self.mask_files}/{r['path']}" for r in rows])
        at = grid.split_grid_name(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.tiff$", ""))
        t = lambda k: F.get("transform", F.lit(k))
        return head.select(grid.hundredths(at["lon"]).alias("lon_c"), grid.hundredths(at["lat"]).alias("lat_c"), F.col("path").alias("mask"), F.coalesce("crs", F.lit("EPSG:4326")).alias("crs"), F.col("height").alias("tile_h"), F.col("width").alias("tile_w"), t(0).alias("a"), t(2).alias("c"), t(4).alias("e"), t(5).alias("f"))

    def _target(self, refs: list, target_crs: str) -> tuple[tuple, int, int]:
        """One grid that holds all tiles, at the finest of their suggested resolutions."""
        grids = []
        for r in refs:
            box = (r["c"], r["f"] + r["e"] * r["tile_h"], r["c"] + r["a"] * r["tile_w"], r["f"])
            grids.append(systems.suggested_grid(r["crs"], target_crs, r["tile_w"], r["tile_h"], box))
        size = min(t[0] for t, _, _ in grids)
        west, north = min(t[2] for t, _, _ in grids), max(t[5] for t, _, _ in grids)
        east, south = max(t[2] + t[0] * w for t, w, _ in grids), min(t[5] + t[4] * h for t, _, h in grids)
        return (size, 0.0, west, 0.0, -size, north), max(1, math.ceil((north - south) / size - 1e-6)), max(1, math.ceil((east - west) / size - 1e-6))

    def region_mosaic(self, bounds: Bounds, out: str, target_crs: str = "EPSG:4326", bands: Sequence[int] = (0, 1, 2), normalize: bool = True, year: int = 2024) -> None:
        """Tiles over bounds, resampled, merged (first wins), normalized together, as one RGB GeoTIFF."""
        bands = pixel.checked_bands(bands, exactly=3)
        systems.code(target_crs)
        tiles = catalog.within(self.catalog(), tuple(round(v * 100) for v in bounds), year).select("year", "lon_c", "lat_c").distinct()
        refs = self._georeferenced(bounds).join(tiles, ["lon_c", "lat_c"]).cache()
        rows = refs.collect()
        if not rows:
            raise LookupError("no tile over the bounds has a land mask")
        target, height, width = self._target(rows, target_crs)
        cells = npy.read_onto(self.spark, self._folders(refs), refs, bands, target, height, width, target_crs, self._array_entries())
        merged = mosaic.first_wins(cells, F.struct("lat_c", "lon_c"))
        geotiff.write_mosaic(mosaic.finished(merged, normalize), out, [0, 1, 2], height, width, target, target_crs)
        refs.unpersist()

    def landmask_mosaic(self, bounds: Bounds, out: str, target_crs: str = "EPSG:4326") -> None:
        """Land masks over bounds, resampled to the nearest pixel and merged, 0 and 255."""
        refs = self._georeferenced(bounds).cache()
        rows = refs.collect()
        target, height, width = self._target(rows, target_crs)
        cells = geotiff.read_onto(refs, target, height, width, target_crs)
        merged = mosaic.mask_mosaic(cells.withColumn("__order", F.struct("lat_c", "lon_c")), "__order")
        geotiff.write_mosaic(merged.select(F.lit(0).alias("band"), "row", "col", F.col("value").alias("u8")), out, [0], height, width, target, target_crs)
        refs.unpersist()

    def web_tiles(self, image: str, out: str, zooms: Sequence[int] = range(1, 16), overwrite: bool = True) -> int:
        """The z/x/y pyramid of an RGB GeoTIFF; existing tiles are kept unless ``overwrite``."""
        head = geotiff.read_meta(self.spark, image).first()
        cells = geotiff.read_pixels(self.spark, image).select("band", "py", "px", F.col("value").alias("u8"))
        made = mosaic.pyramid(cells, head["transform"], head["height"], head["width"], head["crs"] or "EPSG:4326", list(zooms))
        return png.write_tiles(png.tiles(made, list(range(head["bands"]))), out, overwrite)

    def has_tiles(self, folder: str) -> bool:
        """Whether a folder is there and has zoom folders."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(path) and any(s.isDirectory() for s in fs.listStatus(path))

    def coverage_map(self, out: str) -> None:
        geotiff.put(self.spark, out, png.coverage_map(catalog.coverage(self.catalog())))
