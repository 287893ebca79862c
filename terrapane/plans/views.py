"""Catalogue-shaped inputs from the driver's tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.functions import grid


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, lon_c and lat_c of a catalogue."""
    return _t(spark, sf_dir, "orders").selectExpr("2017 + cast(o_orderkey % 8 as int) AS year", "cast(-500 + 10 * (o_custkey % 100) + 5 as int) AS lon_c", "cast(5000 + 10 * (o_orderkey % 53) + 5 as int) AS lat_c").distinct()


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").selectExpr("cast(-500 + 10 * (c_custkey % 100) + 5 as int) AS lon_c", "cast(5000 + 10 * ((c_custkey * 7) % 53) + 5 as int) AS lat_c", "cast(c_custkey % 2 as int) AS land").distinct()


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS region_id", "n_name AS name", "cast(-480 + 37 * n_nationkey as int) AS min_lon_c", "cast(5003 + 19 * n_nationkey as int) AS min_lat_c",
        "cast(-480 + 37 * n_nationkey + 40 + 25 * n_regionkey as int) AS max_lon_c", "cast(5003 + 19 * n_nationkey + 30 + 10 * n_regionkey as int) AS max_lat_c",
    )


def registry_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").where("p_partkey % 3 <> 0").selectExpr("concat('2024/grid_', cast(p_partkey as string), '.npy') AS path", "sha2(cast(p_name as binary), 256) AS hash")


def registry_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").where("p_partkey % 5 <> 0").selectExpr("concat('2024/grid_', cast(p_partkey as string), '.npy') AS path", "sha2(cast(CASE WHEN p_partkey % 7 = 0 THEN concat(p_name, 'x') ELSE p_name END as binary), 256) AS hash")


def registry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").selectExpr(
        "p_partkey AS line_no",
        "CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat('# ', p_name) WHEN 2 THEN concat('file', cast(p_partkey % 50 as string), '.npy')"
        " ELSE concat('  file', cast(p_partkey % 50 as string), '.npy ', sha2(cast(p_name as binary), 256), ' ') END AS line",
    )


def block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(5 * (o_custkey % 72) - 180 as string) AS bl", "cast(5 * (o_orderkey % 36) - 90 as string) AS bb")
    return s.selectExpr("CASE WHEN o_orderkey % 9 = 0 THEN concat('registry_tiles_lon', bl, '_lat', bb, '.txt') WHEN o_orderkey % 11 = 0 THEN 'registry_index.txt' ELSE concat('registry_', cast(2017 + o_orderkey % 8 as string), '_lon', bl, '_lat', bb, '.txt') END AS name").distinct()


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid.tile_name(F.expr("cast(o_custkey * 37 % 36000 - 18000 as int)"), F.expr("cast(o_orderkey * 13 % 18000 - 9000 as int)"))
    y = F.expr("cast(2017 + o_orderkey % 8 as string)")

    def of(k: Column) -> Column:
        name, n = k["g"], k["n"]
        path = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
        odd = (path(k["y"], "/", name, "/", name, "_scales.npy"), path(k["y"], "/", name, ".npy"), path("x", k["y"], "/", name, "/", name, ".npy"), path(k["y"], "/tile_1_2/", name, ".npy"), path(k["y"], "/grid_abc_1.05/", name, ".npy"))
        out = F.when(n == 0, odd[0])
        for i, p in enumerate(odd[1:], 1):
            out = out.when(n == i, p)
        return out.otherwise(path(k["y"], "/", name, "/", name, ".npy"))

    # bound as a lambda's argument, the name is built once and not in every branch
    bound = F.transform(F.array(F.struct(y.alias("y"), g.alias("g"), (F.col("o_orderkey") % 8).alias("n"))), of)
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.get(bound, F.lit(0)).alias("path"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pix, tile, q and scale."""
    q = F.transform("embedding", lambda x: F.round(x.cast("double") * 127).cast("tinyint"))
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pix"), F.col("label").alias("tile"), q.alias("q"), (F.expr("cast(1 + vec_id % 4 as float)") * F.lit(0.001953125).cast("float")).cast("float").alias("scale"))


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, tile and value, with real zeros."""
    v = F.round(F.get("embedding", F.lit(0)).cast("double") * 8).cast("int")
    return _t(spark, sf_dir, "embeddings").groupBy(F.expr("cast(vec_id % 60 as int)").alias("cell"), F.col("label").alias("tile")).agg(F.max(v).alias("value"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 20 x 20 raster: py, px, value."""
    return _t(spark, sf_dir, "embeddings").where("vec_id < 400").select(F.expr("cast(vec_id div 20 as int)").alias("py"), F.expr("cast(vec_id % 20 as int)").alias("px"), F.get("embedding", F.lit(0)).cast("double").alias("value"))


def raster_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster 20 pixels wide of all rows: py, px, value."""
    return _t(spark, sf_dir, "embeddings").select(F.expr("cast(vec_id div 20 as int)").alias("py"), F.expr("cast(vec_id % 20 as int)").alias("px"), F.get("embedding", F.lit(0)).cast("double").alias("value"))


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 10 x 20 pixels that overlap by two rows, going south from 50 degrees: tile, py, px, values (three bands), a, c, e, f."""
    values = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    at = {"a": F.lit(0.0001), "c": F.lit(5.0), "e": F.lit(-0.0001), "f": F.lit(50.0) - F.lit(0.0008) * F.col("tile")}
    return _t(spark, sf_dir, "embeddings").select(F.expr("vec_id div 200").alias("tile"), F.expr("cast(vec_id div 20 % 10 as int)").alias("py"), F.expr("cast(vec_id % 20 as int)").alias("px"), values.alias("values")).withColumns(at)
