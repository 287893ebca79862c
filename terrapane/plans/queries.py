"""One query for each operator, composed from the library over the derived inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.functions import geometry, grid, pixel
from terrapane.operators import catalog, mosaic, registry, reproject, spatial
from terrapane.plans import views as v
from terrapane.sources import vector

BANDS = (10, 20, 30)
#: A 2x upsampling of the 20 x 20 raster that is shifted by a quarter of a source pixel.
SOURCE, TARGET, SIZE = (1.0, 0.0, 0.0, 0.0, -1.0, 20.0), (0.5, 0.0, 0.25, 0.0, -0.5, 20.25), 40
BOX = (-123, 5040, 200, 5230)


def q01_registry_parse(s: SparkSession, d: str) -> DataFrame:
    return catalog.parse_lines(v.registry_lines(s, d), "line").select("line_no", "path", F.btrim("hash").alias("hash"))


def q02_hash_lookup(s: SparkSession, d: str) -> DataFrame:
    master = v.block_files(s, d).where(F.length("name") % 2 == 0).select(F.col("name").alias("path"), F.sha2(F.col("name").cast("binary"), 256).alias("hash"))
    return catalog.with_hash(v.block_files(s, d), master)


def q03_block_prune(s: SparkSession, d: str) -> DataFrame:
    return catalog.in_block(catalog.with_blocks(v.tiles(s, d)), 2024, 123, 5110).select("year", "lon_c", "lat_c")


def q04_block_name_parse(s: SparkSession, d: str) -> DataFrame:
    return catalog.block_names(v.block_files(s, d)).select("name", "year", "block_lon", "block_lat")


def q05_geojson_bounds(s: SparkSession, d: str) -> DataFrame:
    """Regions written as GeoJSON features and read back."""
    deg = lambda c: F.col(c) / F.lit(100.0)
    point = lambda x, y: F.array(deg(x), deg(y))
    w, so, e, n = spatial.BOUNDS
    ring = F.array(point(w, so), point(e, so), point(e, n), point(w, n), point(w, so))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("region_id").cast("string").alias("id"), F.create_map(F.lit("name"), F.col("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    features = vector.parse_geojson(v.regions(s, d).select(F.to_json(feature).alias("value")))
    b = geometry.bounds(F.col("rings"))
    return features.select(F.col("feature_id").cast("int").alias("region_id"), F.col("properties")["name"].alias("name"), b["min_x"].alias("min_x"), b["min_y"].alias("min_y"), b["max_x"].alias("max_x"), b["max_y"].alias("max_y"))


def q06_file_scan_parse(s: SparkSession, d: str) -> DataFrame:
    return catalog.scanned_arrays(v.paths(s, d)).select("path", "year", "lon", "lat", "block_lon", "block_lat")


def q07_registry_load_lastwins(s: SparkSession, d: str) -> DataFrame:
    return catalog.last_wins(catalog.parse_lines(v.registry_lines(s, d), "line")).select("path", F.btrim("hash").alias("hash"))


def q08_xml_bounds(s: SparkSession, d: str) -> DataFrame:
    dec = lambda c: (F.col(c) / F.lit(100.0)).cast("decimal(10,2)").cast("string")
    w, so, e, n = spatial.BOUNDS
    xml = F.concat(F.lit('<TileMap><BoundingBox minx="'), dec(w), F.lit('" miny="'), dec(so), F.lit('" maxx="'), dec(e), F.lit('" maxy="'), dec(n), F.lit('"/></TileMap>'))
    return vector.xml_bounds(v.regions(s, d).select("region_id", xml.alias("value")))


def q09_needs_fetch(s: SparkSession, d: str) -> DataFrame:
    return registry.stale_paths(v.registry_new(s, d), v.registry_old(s, d)).select("path")


def q10_dequantize(s: SparkSession, d: str) -> DataFrame:
    return v.pixels(s, d).select("pix", F.posexplode(pixel.dequantized(F.col("q"), F.col("scale"))).alias("band", "x")).select("pix", "band", F.col("x").cast("double").alias("value"))


def q11_point_fetch(s: SparkSession, d: str) -> DataFrame:
    return pixel.exploded(v.pixels(s, d).where("tile = 3")).select("pix", "band", "value")


def q12_band_select(s: SparkSession, d: str) -> DataFrame:
    b = pixel.band_values(F.col("q"), F.col("scale"), BANDS)
    return v.pixels(s, d).select("pix", *(F.get(b, k)["value"].alias(n) for k, n in enumerate(("r", "g", "b"))))


def q13_tile_path(s: SparkSession, d: str) -> DataFrame:
    return v.tiles(s, d).select("year", "lon_c", "lat_c", grid.embedding_path(F.col("year"), F.col("lon_c"), F.col("lat_c")).alias("path"))


def q14_clip_quantize(s: SparkSession, d: str) -> DataFrame:
    return pixel.exploded(v.pixels(s, d)).select("pix", "band", pixel.to_u8(F.col("value")).alias("u8"))


def q15_tile_box(s: SparkSession, d: str) -> DataFrame:
    b = grid.tile_box(F.col("lon_c"), F.col("lat_c"))
    return v.tiles(s, d).select("year", "lon_c", "lat_c", *(b[c].alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")))


def _shaped(s: SparkSession, d: str) -> DataFrame:
    """Tiles with a shape that differs from place to place."""
    return v.tiles(s, d).withColumns({"tile_h": F.expr("cast(11 + (lat_c div 10) % 7 as int)"), "tile_w": F.expr("cast(13 + pmod(lon_c div 10, 5) as int)")})


def q16_mosaic_extent(s: SparkSession, d: str) -> DataFrame:
    return mosaic.extent(_shaped(s, d), "year").select("year", "min_lon", "min_lat", "max_lon", "max_lat", "width", "height", "px", "py")


def q17_bbox_select(s: SparkSession, d: str) -> DataFrame:
    return catalog.within(v.tiles(s, d), BOX, year=2020).select("year", "lon_c", "lat_c")


def q18_region_range_join(s: SparkSession, d: str) -> DataFrame:
    r = v.regions(s, d)
    n = lambda right, name: spatial.overlapping(r, right).groupBy("region_id").agg(F.count(F.lit(1)).alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return r.select("region_id").join(n(v.tiles(s, d), "n_tiles"), "region_id", "left").join(n(v.masks(s, d), "n_masks"), "region_id", "left").select("region_id", zero("n_tiles"), zero("n_masks"))


def q19_legacy_prefilter(s: SparkSession, d: str) -> DataFrame:
    return spatial.snapped(v.regions(s, d), v.tiles(s, d)).groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))


def q20_catalog_parse(s: SparkSession, d: str) -> DataFrame:
    return catalog.parsed_embeddings(v.paths(s, d)).select("path", "year", "lat", "lon")


def q21_polygon_join(s: SparkSession, d: str) -> DataFrame:
    """Right triangles with the tiles that they meet."""
    w, so, e, n = (F.col(c).cast("double") for c in spatial.BOUNDS)
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    triangles = v.regions(s, d).withColumn("rings", F.array(F.array(p(w, so), p(e, so), p(w, n))))
    return spatial.meeting(triangles, v.tiles(s, d)).select("region_id", "year", "lon_c", "lat_c")


def q22_tile_mask_join(s: SparkSession, d: str) -> DataFrame:
    return spatial.with_masks(v.tiles(s, d), v.masks(s, d)).select("year", "lon_c", "lat_c", "land")


def q23_registry_new(s: SparkSession, d: str) -> DataFrame:
    return registry.new_paths(v.registry_new(s, d), v.registry_old(s, d)).select("path")


def q24_registry_upsert(s: SparkSession, d: str) -> DataFrame:
    return registry.merged(v.registry_old(s, d), v.registry_new(s, d))


def q25_counts(s: SparkSession, d: str) -> DataFrame:
    return catalog.counts(v.tiles(s, d), v.masks(s, d))


def q26_years(s: SparkSession, d: str) -> DataFrame:
    return catalog.years(v.tiles(s, d))


def q26b_coverage(s: SparkSession, d: str) -> DataFrame:
    return catalog.coverage(v.tiles(s, d))


def q27_global_norm(s: SparkSession, d: str) -> DataFrame:
    return pixel.normalized_globally(pixel.exploded(v.pixels(s, d), BANDS)).select("pix", "band", pixel.to_u8(F.col("value")).alias("u8"))


def q28_tile_norm(s: SparkSession, d: str) -> DataFrame:
    return mosaic.tile_image(v.pixels(s, d), BANDS).select("tile", "pix", "band", "u8")


def q29_block_group(s: SparkSession, d: str) -> DataFrame:
    return catalog.grouped_by_block(catalog.with_blocks(v.tiles(s, d)), "year")


def _resampled(s: SparkSession, d: str, how) -> DataFrame:
    row, col = reproject.source_position(TARGET, SOURCE)
    return how(v.raster(s, d), reproject.target_cells(s, SIZE, SIZE), row, col)


def q30_reproject_nearest(s: SparkSession, d: str) -> DataFrame:
    return _resampled(s, d, reproject.nearest)


def q31_reproject_bilinear(s: SparkSession, d: str) -> DataFrame:
    return _resampled(s, d, reproject.bilinear).select("row", "col", F.round("value", 6).alias("value"))


def _resampled_whole(s: SparkSession, d: str, how) -> DataFrame:
    """``_resampled`` over all rows of the table: the target is twice as high as the source."""
    source = v.raster_whole(s, d)
    height = (source.agg(F.max("py")).first()[0] or 0) + 1
    row, col = reproject.source_position(TARGET, SOURCE)
    return how(source, reproject.target_cells(s, 2 * height, SIZE), row, col)


def q30b_reproject_nearest_whole(s: SparkSession, d: str) -> DataFrame:
    return _resampled_whole(s, d, reproject.nearest)


def q31b_reproject_bilinear_whole(s: SparkSession, d: str) -> DataFrame:
    return _resampled_whole(s, d, reproject.bilinear).select("row", "col", F.round("value", 6).alias("value"))


def q32_mask_visible(s: SparkSession, d: str) -> DataFrame:
    return pixel.visible(v.masks(s, d), "land")


def q33_sha256(s: SparkSession, d: str) -> DataFrame:
    return registry.hashed(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text").select("doc_id", "hash")


def q34_registry_list(s: SparkSession, d: str) -> DataFrame:
    name = grid.block_file(F.col("year"), F.col("block_lon"), F.col("block_lat"))
    return registry.entries_by_file(catalog.scanned_arrays(v.paths(s, d)), name)


def q35_placement(s: SparkSession, d: str) -> DataFrame:
    t = _shaped(s, d)
    return mosaic.placed(t, mosaic.extent(t, "year"), "year").select("year", "lon_c", "lat_c", "x", "y")


def q36_mosaic_last(s: SparkSession, d: str) -> DataFrame:
    return mosaic.last_wins(v.placements(s, d), "tile", ("cell",))


def q37_mosaic_first(s: SparkSession, d: str) -> DataFrame:
    return mosaic.first_wins(v.placements(s, d), "tile", ("cell",)).select("cell", F.col("value").cast("int").alias("value"))


def q38_region_mosaic(s: SparkSession, d: str) -> DataFrame:
    """A region's tiles that have land, three bands, the first nonzero value where tiles overlap, one range."""
    tiles = v.tiles(s, d).select("lon_c", "lat_c", ((F.col("lon_c") + 495) / 10).cast("int").alias("tile"))
    land = v.masks(s, d).where("land = 1").select("lon_c").distinct()
    chosen = tiles.join(land, "lon_c", "left_semi")
    same = chosen.select("lon_c", "lat_c").distinct()
    row = F.expr("cast(floor(pix / 8.0) as int) % 8")
    col = F.expr("cast(3 * tile + pix % 8 as int)")
    return mosaic.region_mosaic(v.pixels(s, d), chosen, same, BANDS, row, col, F.col("tile") * 1_000_000 + F.col("pix"))


def q38b_region_resampled(s: SparkSession, d: str) -> DataFrame:
    """All tiles resampled from degrees to the web map's metres, bilinearly; the first nonzero value where they overlap."""
    tiles = v.strips(s, d)
    height = 16 * ((tiles.agg(F.max("tile")).first()[0] or 0) + 1) + 10
    cells = reproject.rows_onto(tiles, (9.0, 0.0, 556590.0, 0.0, -9.0, 6446285.0), height, 27, "EPSG:4326", "EPSG:3857", 3)
    return mosaic.first_wins(cells, "tile").withColumn("value", F.round("value", 4))


def q39_xyz_pyramid(s: SparkSession, d: str) -> DataFrame:
    return mosaic.pyramid_counts(v.tiles(s, d), range(1, 9))


def q39b_xyz_pyramid_whole(s: SparkSession, d: str) -> DataFrame:
    """All zooms of the reference's pyramid."""
    return mosaic.pyramid_counts(v.tiles(s, d), range(1, 16))


def q39c_pyramid_pixels(s: SparkSession, d: str) -> DataFrame:
    """Pixels of a raster of all rows at four zooms: two of means, two of pixels smaller than the raster's own."""
    cells = v.raster_whole(s, d).select(F.lit(0).alias("band"), "py", "px", F.floor(F.col("value") * 100).alias("u8"))
    height = (cells.agg(F.max("py")).first()[0] or 0) + 1
    return mosaic.pyramid(cells, (0.0005, 0.0, 5.003, 0.0, -0.0005, 50.0), height, 20, "EPSG:4326", [8, 10, 12, 13])


def q40_list_limit(s: SparkSession, d: str) -> DataFrame:
    return catalog.listed(v.tiles(s, d), 10)


def q41_master_concat(s: SparkSession, d: str) -> DataFrame:
    return v.registry_old(s, d).unionByName(v.registry_new(s, d))


def q42_registry_names(s: SparkSession, d: str) -> DataFrame:
    t = catalog.with_blocks(v.tiles(s, d))
    one, two = grid.block_file(F.col("year"), F.col("block_lon"), F.col("block_lat")), grid.tiles_block_file(F.col("block_lon"), F.col("block_lat"))
    return t.select("year", "lon_c", "lat_c", one.alias("name"), two.alias("tiles_name"), grid.registry_path("/base", one).alias("path"), grid.registry_path("/base", two).alias("tiles_path"))


def q43_tile_route(s: SparkSession, d: str) -> DataFrame:
    """Each address's path, its segments' number, the last segment, and the route of a request for it below ``/tiles``."""
    path = F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", path.alias("path"), F.size(parts).alias("n_parts"), F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")).alias("last_part"), grid.tile_route(F.concat(F.lit("/tiles"), path)).alias("rest"))


def q44_block_range(s: SparkSession, d: str) -> DataFrame:
    w, so, e, n = (F.col(c) for c in spatial.BOUNDS)
    return v.regions(s, d).select("region_id", F.explode(catalog.block_range(w, so, e, n)).alias("b")).select("region_id", "b.block_lon", "b.block_lat")


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
