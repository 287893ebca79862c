"""Every query with SQL against DuckDB: names, types and values."""

import duckdb
import pytest

import __spark_entry__ as entry
from terrapane.plans.oracles import ORACLE
from terrapane.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "smallint": "SMALLINT"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def normal(rows):
    return sorted(tuple("null" if v is None else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = normal(df.select(*cols).collect())
    kinds = dict(duck.execute(f"SELECT column_name, column_type FROM (DESCRIBE {ORACLE[name]})").fetchall())
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    want = normal(duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall())
    assert got == want and got


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["band", "row", "col", "u8"] and df.count() > 0


def test_pyramid_has_all_zooms(spark, sf):
    from terrapane.plans import views

    rows = QUERIES["q39b_xyz_pyramid_whole"](spark, sf).groupBy("z").sum("n").collect()
    assert {r[0]: r[1] for r in rows} == dict.fromkeys(range(1, 16), views.tiles(spark, sf).count())


def test_resampling_reads_all_rows(spark, tmp_path, duck):
    """1,010 rows: the last source row is half full."""
    duck.execute(f"COPY (SELECT i AS vec_id, [(i % 97)::float, 0::float] AS embedding FROM range(1010) r(i)) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    own = duck.cursor()
    own.execute(f"CREATE TEMP VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    for name in ("q30b_reproject_nearest_whole", "q31b_reproject_bilinear_whole"):
        df = QUERIES[name](spark, str(tmp_path))
        got = normal(df.select("row", "col", "value").collect())
        assert len(got) > 3900 and got == normal(own.execute(f"SELECT row, col, value FROM ({ORACLE[name]})").fetchall())


def test_tiles_with_gaps_are_resampled(spark, tmp_path, duck):
    """Rows that are missing, twice there, null or outside; the last tile ends within a row."""
    value = "((i * 37) % 101 - 50)::float / 8"
    duck.execute(f"""COPY (SELECT CASE i WHEN 5 THEN NULL WHEN 6 THEN -7 ELSE i END AS vec_id,
        CASE WHEN i % 41 = 0 THEN NULL WHEN i % 43 = 0 THEN [{value}] ELSE [{value}, 1 + {value}, i % 2] END AS embedding
        FROM (SELECT i FROM range(1056) r(i) WHERE (i * 7919) % 11 > 2 UNION ALL SELECT i FROM range(0, 1056, 9) r(i))) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)""")
    own = duck.cursor()
    own.execute(f"CREATE TEMP VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = normal(QUERIES["q38b_region_resampled"](spark, str(tmp_path)).select("band", "row", "col", "value").collect())
    assert len(got) > 3000 and got == normal(own.execute(f"SELECT band, row, col, value FROM ({ORACLE['q38b_region_resampled']})").fetchall())


def test_plans(spark, sf):
    """Shapes of plans that matter at scale."""
    plan = lambda n: QUERIES[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for n in QUERIES:
        assert "CartesianProduct" not in plan(n), n
    assert "NestedLoop" not in plan("q18_region_range_join") and "NestedLoop" not in plan("q21_polygon_join")
    assert "TakeOrderedAndProject" in plan("q40_list_limit")


def test_blocks_prune_partitions(spark, sf, tmp_path):
    from terrapane.operators import catalog
    from terrapane.plans import views

    catalog.partitioned(views.tiles(spark, sf), f"{tmp_path}/catalog")
    all_ = spark.read.parquet(f"{tmp_path}/catalog")
    near = catalog.within(all_, (10, 5010, 40, 5030), 2021)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "block_lon" in plan.split("PartitionFilters")[1].split("]")[0]
    same = catalog.within(views.tiles(spark, sf), (10, 5010, 40, 5030), 2021)
    assert sorted(map(tuple, near.select("year", "lon_c", "lat_c").collect())) == sorted(map(tuple, same.select("year", "lon_c", "lat_c").collect()))
