"""The same queries in SQL, on the base tables alone."""

from __future__ import annotations

VIEWS = {
    "v_tiles": "SELECT DISTINCT (2017 + o_orderkey % 8)::int AS year, (-500 + 10 * (o_custkey % 100) + 5)::int AS lon_c, (5000 + 10 * (o_orderkey % 53) + 5)::int AS lat_c FROM orders",
    "v_masks": "SELECT DISTINCT (-500 + 10 * (c_custkey % 100) + 5)::int AS lon_c, (5000 + 10 * ((c_custkey * 7) % 53) + 5)::int AS lat_c, (c_custkey % 2)::int AS land FROM customer",
    "v_regions": "SELECT n_nationkey AS region_id, n_name AS name, (-480 + 37 * n_nationkey)::int AS min_lon_c, (5003 + 19 * n_nationkey)::int AS min_lat_c, (-480 + 37 * n_nationkey + 40 + 25 * n_regionkey)::int AS max_lon_c, (5003 + 19 * n_nationkey + 30 + 10 * n_regionkey)::int AS max_lat_c FROM nation",
    "v_reg_old": "SELECT concat('2024/grid_', p_partkey::varchar, '.npy') AS path, sha256(p_name) AS hash FROM part WHERE p_partkey % 3 <> 0",
    "v_reg_new": "SELECT concat('2024/grid_', p_partkey::varchar, '.npy') AS path, sha256(CASE WHEN p_partkey % 7 = 0 THEN concat(p_name, 'x') ELSE p_name END) AS hash FROM part WHERE p_partkey % 5 <> 0",
    "v_reglines": "SELECT p_partkey AS line_no, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat('# ', p_name) WHEN 2 THEN concat('file', (p_partkey % 50)::varchar, '.npy') ELSE concat('  file', (p_partkey % 50)::varchar, '.npy ', sha256(p_name), ' ') END AS line FROM part",
    "v_blockfiles": "SELECT DISTINCT CASE WHEN o_orderkey % 9 = 0 THEN concat('registry_tiles_lon', bl, '_lat', bb, '.txt') WHEN o_orderkey % 11 = 0 THEN 'registry_index.txt' ELSE concat('registry_', (2017 + o_orderkey % 8)::varchar, '_lon', bl, '_lat', bb, '.txt') END AS name FROM (SELECT o_orderkey, (5 * (o_custkey % 72) - 180)::varchar AS bl, (5 * (o_orderkey % 36) - 90)::varchar AS bb FROM orders)",
    "v_paths": "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN concat(y,'/',g,'/',g,'_scales.npy') WHEN 1 THEN concat(y,'/',g,'.npy') WHEN 2 THEN concat('x',y,'/',g,'/',g,'.npy') WHEN 3 THEN concat(y,'/tile_1_2/',g,'.npy') WHEN 4 THEN concat(y,'/grid_abc_1.05/',g,'.npy') ELSE concat(y,'/',g,'/',g,'.npy') END AS path FROM (SELECT o_orderkey, (2017 + o_orderkey % 8)::varchar AS y, concat('grid_', printf('%.2f', (o_custkey * 37 % 36000 - 18000)::double / 100), '_', printf('%.2f', (o_orderkey * 13 % 18000 - 9000)::double / 100)) AS g FROM orders)",
    "v_pixels": "SELECT vec_id AS pix, label AS tile, list_transform(embedding, lambda x: round(x::double * 127)::tinyint) AS q, (1 + vec_id % 4)::float * 0.001953125::float AS scale FROM embeddings",
    "v_values": "SELECT pix, tile, b AS band, q[b + 1]::double * scale::double AS value FROM (SELECT *, unnest(range(len(q)))::int AS b FROM v_pixels)",
    "v_place": "SELECT (vec_id % 60)::int AS cell, label AS tile, max(round(embedding[1]::double * 8)::int)::int AS value FROM embeddings GROUP BY 1, 2",
    "v_grid": "SELECT (vec_id // 20)::int AS py, (vec_id % 20)::int AS px, embedding[1]::double AS value FROM embeddings WHERE vec_id < 400",
    "v_shaped": "SELECT *, (11 + (lat_c // 10) % 7)::int AS tile_h, (13 + (((trunc(lon_c / 10.0)::int % 5) + 5) % 5))::int AS tile_w FROM v_tiles",
    "v_extent": "SELECT year, min(lon_c::double / 100.0::double) AS min_lon, min(lat_c::double / 100.0::double) AS min_lat, max(lon_c::double / 100.0::double) + 0.1::double AS max_lon, max(lat_c::double / 100.0::double) + 0.1::double AS max_lat, arg_min(tile_w, lat_c::bigint * 100000 + lon_c)::double / 0.1::double AS ppd_x, arg_min(tile_h, lat_c::bigint * 100000 + lon_c)::double / 0.1::double AS ppd_y FROM v_shaped GROUP BY year",
}
NEEDS = {"v_values": ["v_pixels"], "v_shaped": ["v_tiles"], "v_extent": ["v_tiles", "v_shaped"]}

_LINE = "trim(line)"
_PARSED = f"SELECT line_no, split_part({_LINE}, ' ', 1) AS path, trim(substr({_LINE}, instr({_LINE}, ' ') + 1)) AS hash FROM v_reglines WHERE {_LINE} <> '' AND NOT starts_with({_LINE}, '#') AND contains({_LINE}, ' ')"
_BLOCK = "(floor({} / 500.0) * 5)::int"
_NAME = "concat('grid_', printf('%.2f', lon_c::double / 100), '_', printf('%.2f', lat_c::double / 100))"
_SCAN = r"SELECT path, split_part(path, '/', 1)::int AS year, regexp_extract(p, '^grid_(-?[0-9]+\.[0-9]+)_(-?[0-9]+\.[0-9]+)', 1)::double AS lon, regexp_extract(p, '^grid_(-?[0-9]+\.[0-9]+)_(-?[0-9]+\.[0-9]+)', 2)::double AS lat FROM (SELECT path, string_split(path, '/')[-2] AS p FROM v_paths) WHERE regexp_matches(split_part(path, '/', 1), '^[0-9]{4}$') AND regexp_matches(p, '^grid_(-?[0-9]+\.[0-9]+)_(-?[0-9]+\.[0-9]+)')"
_U8 = "trunc(least(1.0, greatest(0.0, {})) * 255)::int"
_BLOCKS = f"concat('registry_', year::varchar, '_lon', {_BLOCK.format('lon_c')}::varchar, '_lat', {_BLOCK.format('lat_c')}::varchar, '.txt')"
_TBLOCKS = f"concat('registry_tiles_lon', {_BLOCK.format('lon_c')}::varchar, '_lat', {_BLOCK.format('lat_c')}::varchar, '.txt')"
_OVER = "t.lon_c < max_lon_c AND t.lon_c + 10 > min_lon_c AND t.lat_c < max_lat_c AND t.lat_c + 10 > min_lat_c"
_DST = "SELECT (i // 40)::int AS row, (i % 40)::int AS col, 20.0::double - (((i // 40) + 0.5) * -0.5 + 20.25) AS y, ((i % 40) + 0.5) * 0.5 + 0.25 AS x FROM range(1600) r(i)"

_RAW = {
    "q01_registry_parse": (["v_reglines"], _PARSED),
    "q02_hash_lookup": (["v_blockfiles"], "SELECT name, CASE WHEN length(name) % 2 = 0 THEN sha256(name) END AS hash FROM v_blockfiles"),
    "q03_block_prune": (["v_tiles"], f"SELECT year, lon_c, lat_c FROM v_tiles WHERE year = 2024 AND {_BLOCK.format('lon_c')} = 0 AND {_BLOCK.format('lat_c')} = 50"),
    "q04_block_name_parse": (["v_blockfiles"], r"SELECT name, regexp_extract(name, r, 1)::int AS year, regexp_extract(name, r, 2)::int AS block_lon, regexp_extract(name, r, 3)::int AS block_lat FROM (SELECT name, '^registry_([0-9]{4})_lon(-?[0-9]+)_lat(-?[0-9]+)\.txt$' AS r FROM v_blockfiles) WHERE regexp_matches(name, '^registry_([0-9]{4})_lon(-?[0-9]+)_lat(-?[0-9]+)\.txt$')".replace(", r, ", r", '^registry_([0-9]{4})_lon(-?[0-9]+)_lat(-?[0-9]+)\.txt$', ")),
    "q05_geojson_bounds": (["v_regions"], "SELECT region_id::int AS region_id, name, min_lon_c / 100.0::double AS min_x, min_lat_c / 100.0::double AS min_y, max_lon_c / 100.0::double AS max_x, max_lat_c / 100.0::double AS max_y FROM v_regions"),
    "q06_file_scan_parse": (["v_paths"], f"SELECT *, (floor(lon / 5) * 5)::int AS block_lon, (floor(lat / 5) * 5)::int AS block_lat FROM ({_SCAN})"),
    "q07_registry_load_lastwins": (["v_reglines"], f"SELECT path, arg_max(hash, line_no) AS hash FROM ({_PARSED}) GROUP BY path"),
    "q08_xml_bounds": (["v_regions"], "SELECT region_id, regexp_extract(x, 'miny=\"([^\"]*)\"', 1)::double AS south, regexp_extract(x, 'minx=\"([^\"]*)\"', 1)::double AS west, regexp_extract(x, 'maxy=\"([^\"]*)\"', 1)::double AS north, regexp_extract(x, 'maxx=\"([^\"]*)\"', 1)::double AS east FROM (SELECT region_id, concat('<BoundingBox minx=\"', (min_lon_c / 100.0)::decimal(10,2), '\" miny=\"', (min_lat_c / 100.0)::decimal(10,2), '\" maxx=\"', (max_lon_c / 100.0)::decimal(10,2), '\" maxy=\"', (max_lat_c / 100.0)::decimal(10,2), '\"/>') AS x FROM v_regions)"),
    "q09_needs_fetch": (["v_reg_old", "v_reg_new"], "SELECT n.path FROM v_reg_new n LEFT JOIN v_reg_old o USING (path) WHERE o.hash IS NULL OR o.hash <> n.hash"),
    "q10_dequantize": (["v_values"], "SELECT pix, band, value FROM v_values"),
    "q11_point_fetch": (["v_values"], "SELECT pix, band, value FROM v_values WHERE tile = 3"),
    "q12_band_select": (["v_pixels"], "SELECT pix, q[11]::double * scale::double AS r, q[21]::double * scale::double AS g, q[31]::double * scale::double AS b FROM v_pixels"),
    "q13_tile_path": (["v_tiles"], f"SELECT year, lon_c, lat_c, concat(year::varchar, '/', {_NAME}, '/', {_NAME}, '.npy') AS path FROM v_tiles"),
    "q14_clip_quantize": (["v_values"], f"SELECT pix, band, {_U8.format('value')} AS u8 FROM v_values"),
    "q15_tile_box": (["v_tiles"], "SELECT year, lon_c, lat_c, lon_c / 100.0::double AS min_lon, lat_c / 100.0::double AS min_lat, lon_c / 100.0::double + 0.1::double AS max_lon, lat_c / 100.0::double + 0.1::double AS max_lat FROM v_tiles"),
    "q16_mosaic_extent": (["v_extent"], "SELECT year, min_lon, min_lat, max_lon, max_lat, width, height, (max_lon - min_lon) / width AS px, (max_lat - min_lat) / height AS py FROM (SELECT *, trunc((max_lon - min_lon) * ppd_x)::int AS width, trunc((max_lat - min_lat) * ppd_y)::int AS height FROM v_extent)"),
    "q17_bbox_select": (["v_tiles"], "SELECT year, lon_c, lat_c FROM v_tiles WHERE year = 2020 AND lon_c < 200 AND lon_c + 10 > -123 AND lat_c < 5230 AND lat_c + 10 > 5040"),
    "q18_region_range_join": (["v_tiles", "v_masks", "v_regions"], f"SELECT region_id, (SELECT count(*) FROM v_tiles t WHERE {_OVER})::bigint AS n_tiles, (SELECT count(*) FROM v_masks t WHERE {_OVER})::bigint AS n_masks FROM v_regions"),
    "q19_legacy_prefilter": (["v_tiles", "v_regions"], "SELECT region_id, count(*) AS n FROM v_regions JOIN v_tiles t ON t.lon_c BETWEEN floor(min_lon_c / 10.0) * 10 AND ceil(max_lon_c / 10.0) * 10 AND t.lat_c BETWEEN floor(min_lat_c / 10.0) * 10 AND ceil(max_lat_c / 10.0) * 10 GROUP BY region_id"),
    "q20_catalog_parse": (["v_paths"], "SELECT path, year, lat, lon FROM (SELECT path, try_cast(split_part(path, '/', 1) AS int) AS year, try_cast(split_part(g, '_', 3) AS double) AS lat, try_cast(split_part(g, '_', 2) AS double) AS lon FROM (SELECT path, split_part(path, '/', 2) AS g FROM v_paths WHERE ends_with(path, '.npy') AND NOT ends_with(path, '_scales.npy') AND len(string_split(path, '/')) >= 3) WHERE starts_with(g, 'grid_') AND len(string_split(g, '_')) = 3) WHERE year IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL"),
    "q21_polygon_join": (["v_tiles", "v_regions"], "SELECT region_id, t.year, t.lon_c, t.lat_c FROM v_regions JOIN v_tiles t ON t.lon_c <= max_lon_c AND t.lon_c + 10 >= min_lon_c AND t.lat_c <= max_lat_c AND t.lat_c + 10 >= min_lat_c AND (t.lon_c - min_lon_c) * (max_lat_c - min_lat_c) + (t.lat_c - min_lat_c) * (max_lon_c - min_lon_c) <= (max_lon_c - min_lon_c) * (max_lat_c - min_lat_c)"),
    "q22_tile_mask_join": (["v_tiles", "v_masks"], "SELECT year, lon_c, lat_c, land FROM v_tiles JOIN v_masks USING (lon_c, lat_c)"),
    "q23_registry_new": (["v_reg_old", "v_reg_new"], "SELECT path FROM v_reg_new ANTI JOIN v_reg_old USING (path)"),
    "q24_registry_upsert": (["v_reg_old", "v_reg_new"], "SELECT path, coalesce(n.hash, o.hash) AS hash, CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'kept' WHEN o.hash <> n.hash THEN 'changed' ELSE 'same' END AS status FROM v_reg_old o FULL OUTER JOIN v_reg_new n USING (path)"),
    "q25_counts": (["v_tiles", "v_masks"], "SELECT (SELECT count(*) FROM v_tiles) AS n_embeddings, (SELECT count(*) FROM v_masks) AS n_masks"),
    "q26_years": (["v_tiles"], "SELECT DISTINCT year FROM v_tiles"),
    "q26b_coverage": (["v_tiles"], "SELECT DISTINCT lat_c, lon_c FROM v_tiles"),
    "q27_global_norm": (["v_values"], f"SELECT pix, band, {_U8.format('CASE WHEN value <> 0 AND hi > lo THEN (value - lo) / (hi - lo) ELSE value END')} AS u8 FROM v_values JOIN (SELECT band, min(value) FILTER (WHERE value <> 0) AS lo, max(value) FILTER (WHERE value <> 0) AS hi FROM v_values GROUP BY band) USING (band) WHERE band IN (10, 20, 30)"),
    "q28_tile_norm": (["v_values"], f"SELECT tile, pix, band, {_U8.format('CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE value END')} AS u8 FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM v_values WHERE band IN (10, 20, 30) WINDOW w AS (PARTITION BY tile, band))"),
    "q29_block_group": (["v_tiles"], f"SELECT year, {_BLOCK.format('lon_c')} AS block_lon, {_BLOCK.format('lat_c')} AS block_lat, count(*) AS n FROM v_tiles GROUP BY 1, 2, 3"),
    "q30_reproject_nearest": (["v_grid"], f"SELECT row, col, value FROM ({_DST}) d JOIN v_grid g ON g.py = floor(y) AND g.px = floor(x)"),
    "q31_reproject_bilinear": (["v_grid"], f"SELECT row, col, round(s, 6) AS value FROM (SELECT row, col, sum((w * value)::decimal(20,12))::double / sum(w::decimal(20,12))::double AS s, bool_or(py = iy AND px = ix) AS i FROM (SELECT row, col, floor(y) AS iy, floor(x) AS ix, floor(y - 0.5) + dy AS ny, floor(x - 0.5) + dx AS nx, (CASE dy WHEN 1 THEN y - 0.5 - floor(y - 0.5) ELSE 1 - (y - 0.5 - floor(y - 0.5)) END) * (CASE dx WHEN 1 THEN x - 0.5 - floor(x - 0.5) ELSE 1 - (x - 0.5 - floor(x - 0.5)) END) AS w FROM ({_DST}) d, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx)) n JOIN v_grid g ON g.py = ny AND g.px = nx WHERE w > 0 GROUP BY row, col) WHERE i"),
    "q32_mask_visible": (["v_masks"], "SELECT lon_c, lat_c, CASE WHEN min(land) OVER () >= 0 AND max(land) OVER () <= 1 THEN land * 255 ELSE land END AS land FROM v_masks"),
    "q33_sha256": ([], "SELECT doc_id, sha256(text) AS hash FROM documents"),
    "q34_registry_list": (["v_paths"], f"SELECT concat('registry_', year::varchar, '_lon', (floor(lon / 5) * 5)::int::varchar, '_lat', (floor(lat / 5) * 5)::int::varchar, '.txt') AS name, count(*) AS n FROM ({_SCAN}) GROUP BY 1"),
    "q35_placement": (["v_extent"], "SELECT year, lon_c, lat_c, trunc((lon_c / 100.0::double - min_lon) * ppd_x)::int AS x, trunc((max_lat - lat_c / 100.0::double - 0.1::double) * ppd_y)::int AS y FROM v_shaped JOIN v_extent USING (year)"),
    "q36_mosaic_last": (["v_place"], "SELECT cell, arg_max(value, tile) AS value FROM v_place GROUP BY cell"),
    "q37_mosaic_first": (["v_place"], "SELECT cell, coalesce(arg_min(value, tile) FILTER (WHERE value <> 0), 0)::int AS value FROM v_place GROUP BY cell"),
    "q38_region_mosaic": (["v_tiles", "v_masks", "v_values"], f"""SELECT band, row, col, {_U8.format('CASE WHEN value <> 0 AND hi > lo THEN (value - lo) / (hi - lo) ELSE value END')} AS u8
FROM (SELECT *, min(value) FILTER (WHERE value <> 0) OVER w AS lo, max(value) FILTER (WHERE value <> 0) OVER w AS hi
      FROM (SELECT band, row, col, coalesce(arg_min(value, tile * 1000000 + pix) FILTER (WHERE value <> 0), 0) AS value
            FROM (SELECT band, floor(pix / 8.0)::int % 8 AS row, (3 * tile + pix % 8)::int AS col, value, tile, pix FROM v_values
                  WHERE band IN (10, 20, 30) AND tile IN (SELECT (t.lon_c + 495) // 10 FROM v_tiles t JOIN v_masks m ON m.lon_c = t.lon_c AND m.land = 1))
            GROUP BY band, row, col) WINDOW w AS (PARTITION BY band))"""),
    "q39_xyz_pyramid": (["v_tiles"], "SELECT z::int AS z, greatest(0, least(floor((lon_c / 100.0::double + 180) / 360 * n), n - 1))::int AS x, greatest(0, least(floor((1 - asinh(tan(radians(lat_c / 100.0::double))) / pi()) / 2 * n), n - 1))::int AS y, count(*) AS n FROM (SELECT *, pow(2.0::double, z) AS n FROM v_tiles, range(1, 9) r(z)) GROUP BY 1, 2, 3"),
    "q40_list_limit": (["v_tiles"], "SELECT *, (SELECT greatest(count(*) - 10, 0) FROM v_tiles)::bigint AS remaining FROM (SELECT * FROM v_tiles ORDER BY year, lat_c, lon_c LIMIT 10)"),
    "q41_master_concat": (["v_reg_old", "v_reg_new"], "SELECT path, hash FROM v_reg_old UNION ALL SELECT path, hash FROM v_reg_new"),
    "q42_registry_names": (["v_tiles"], f"SELECT year, lon_c, lat_c, {_BLOCKS} AS name, {_TBLOCKS} AS tiles_name, concat('/base/registry/', {_BLOCKS}) AS path, concat('/base/registry/', {_TBLOCKS}) AS tiles_path FROM v_tiles"),
    "q43_tile_route": ([], "SELECT page_id, path, len(p)::int AS n_parts, coalesce(p[-1], '') AS last_part, CASE WHEN starts_with('/tiles' || path, '/tiles/') THEN substr('/tiles' || path, 8) END AS rest FROM (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages))"),
    "q44_block_range": (["v_regions"], "SELECT region_id, block_lon::int AS block_lon, block_lat::int AS block_lat FROM (SELECT region_id, block_lon, unnest(range((floor(min_lat_c / 500.0) * 5)::int, (floor(max_lat_c / 500.0) * 5)::int + 5, 5)) AS block_lat FROM (SELECT *, unnest(range((floor(min_lon_c / 500.0) * 5)::int, (floor(max_lon_c / 500.0) * 5)::int + 5, 5)) AS block_lon FROM v_regions))"),
}


def _with(names: list[str], sql: str) -> str:
    """The statement with the views that it needs in front."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "".join(f"{'WITH' if k == 0 else ','} {n} AS ({VIEWS[n]})\n" for k, n in enumerate(order)) + sql


#: The whole jobs of queries whose own SQL takes a part: all rows of the raster, all zooms.
VIEWS["v_grid_whole"] = "SELECT (vec_id // 20)::int AS py, (vec_id % 20)::int AS px, embedding[1]::double AS value FROM embeddings"
_DST_WHOLE = _DST.replace("range(1600) r(i)", "(SELECT unnest(range((SELECT 80 * (max(vec_id) // 20 + 1) FROM embeddings))) AS i)")
for _whole, _part in {"q30b_reproject_nearest_whole": "q30_reproject_nearest", "q31b_reproject_bilinear_whole": "q31_reproject_bilinear"}.items():
    _RAW[_whole] = (["v_grid_whole"], _RAW[_part][1].replace(_DST, _DST_WHOLE).replace("v_grid g", "v_grid_whole g"))
_RAW["q39b_xyz_pyramid_whole"] = (["v_tiles"], _RAW["q39_xyz_pyramid"][1].replace("range(1, 9)", "range(1, 16)"))

_RAW["q38b_region_resampled"] = ([], """SELECT band, row, col, round(coalesce(arg_min(value, tile) FILTER (WHERE value <> 0), 0), 4) + 0.0 AS value FROM (
SELECT tile, band, row, col, sum(w * v) / sum(w) AS value FROM (
  SELECT t.tile, b::int AS band, row, col, wy * wx AS w, e.embedding[b + 1]::double AS v, (vec_id // 20) % 10 = floor(y) AND vec_id % 20 = floor(x) AS own
  FROM (SELECT *, CASE dy WHEN 1 THEN round(y - 0.5, 9) - floor(round(y - 0.5, 9)) ELSE 1 - (round(y - 0.5, 9) - floor(round(y - 0.5, 9))) END AS wy, CASE dx WHEN 1 THEN round(x - 0.5, 9) - floor(round(x - 0.5, 9)) ELSE 1 - (round(x - 0.5, 9) - floor(round(x - 0.5, 9))) END AS wx,
          floor(round(y - 0.5, 9)) + dy AS ny, floor(round(x - 0.5, 9)) + dx AS nx
        FROM (SELECT tile, row, col, (50.0::double - 0.0008::double * tile - lat) / 0.0001::double AS y, (lon - 5.0::double) / 0.0001::double AS x
              FROM (SELECT i::int AS row, j::int AS col, degrees(atan(sinh((6446285.0::double - (i + 0.5::double) * 9) / 6378137.0::double))) AS lat, degrees((556590.0::double + (j + 0.5::double) * 9) / 6378137.0::double) AS lon
                    FROM (SELECT unnest(range((SELECT 16 * (max(vec_id) // 200 + 1) + 10 FROM embeddings))) AS i), range(27) c(j)),
                   (SELECT DISTINCT vec_id // 200 AS tile FROM embeddings)), (VALUES (0), (1)) p(dy), (VALUES (0), (1)) q(dx)
        WHERE y >= 0 AND y < 10 AND x >= 0 AND x < 20) t
  JOIN embeddings e ON e.vec_id // 200 = t.tile AND (e.vec_id // 20) % 10 = ny AND e.vec_id % 20 = nx, range(3) r(b))
GROUP BY tile, band, row, col HAVING bool_or(own)) GROUP BY band, row, col""")
_WORLD = "(2 * pi() * 6378137.0::double)"
_RAW["q39c_pyramid_pixels"] = (["v_grid_whole"], f"""SELECT z::int AS z, (gx // 256)::int AS x, (gy // 256)::int AS y, 0 AS band, (gy % 256)::int AS py, (gx % 256)::int AS px, value FROM (
SELECT z, floor((6378137.0 * radians((px + 0.5::double) * 0.0005 + 5.003) / {_WORLD} + 0.5) * 256 * pow(2, z))::bigint AS gx, floor((0.5 - 6378137.0 * asinh(tan(radians((py + 0.5::double) * -0.0005 + 50.0))) / {_WORLD}) * 256 * pow(2, z))::bigint AS gy, sum(floor(value * 100))::double / count(*) AS value
FROM v_grid_whole, (VALUES (8), (10)) a(z) GROUP BY ALL
UNION ALL
SELECT z, gx, gy, floor(value * 100)::double FROM (
  SELECT z, gx, gy, floor((degrees(((gx + 0.5::double) / s - 0.5) * 2 * pi()) - 5.003) / 0.0005) AS i, floor((50.0 - degrees(atan(sinh((0.5 - (gy + 0.5::double) / s) * 2 * pi())))) / 0.0005) AS j
  FROM (SELECT z, s, gx, unnest(range(floor((0.5 - asinh(tan(radians(50.0::double))) / 2 / pi()) * s)::bigint, floor((0.5 - asinh(tan(radians(50.0 - 0.0005::double * h))) / 2 / pi()) * s)::bigint + 1)) AS gy
        FROM (SELECT z, s, h, unnest(range(floor((5.003::double / 360 + 0.5) * s)::bigint, floor((5.013::double / 360 + 0.5) * s)::bigint + 1)) AS gx
              FROM (SELECT z, 256 * pow(2, z) AS s, (SELECT max(py) + 1 FROM v_grid_whole) AS h FROM (VALUES (12), (13)) b(z)))))
JOIN v_grid_whole g ON g.px = i AND g.py = j)""")

ORACLE = {name: _with(*parts) for name, parts in _RAW.items()}
