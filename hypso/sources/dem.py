"""A long-form raster derived from lineitem: four one-degree cells of n x n samples.

Long form is the data model of all raster operators: cell, file_seq, i (row, north first),
j (column, west first) and z (null: void). A header row per cell has its extent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS, SIDE = 4, 64


def dem(spark: SparkSession, sf_dir: str, n: int = SIDE) -> DataFrame:
    """The dense grid: samples that no row falls on are void. One shuffle, with partial sums."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    samples = (
        items.groupBy((F.col("l_linenumber") % CELLS).cast("long").alias("file_seq"), (F.col("l_partkey") % n).alias("i"), (F.col("l_orderkey") % n).alias("j"))
        .agg(F.sum(cents).alias("s"), F.count(F.lit(1)).alias("k"))
        .selectExpr("file_seq", "i", "j", "(s div k) div 10000 - 500 AS z")
    )
    grid = spark.range(CELLS * n * n).selectExpr(f"id div {n * n} AS file_seq", f"id div {n} % {n} AS i", f"id % {n} AS j")
    cell = F.concat(F.lit("N"), (43 + F.expr("file_seq div 2")).cast("string"), F.lit("E00"), (6 + F.col("file_seq") % 2).cast("string"))
    return grid.join(samples, ["file_seq", "i", "j"], "left").select(cell.alias("cell"), "file_seq", "i", "j", "z")


def header(dem_: DataFrame, n: int = SIDE) -> DataFrame:
    """Extent and increments of each cell (a row per raster file)."""
    return dem_.select("cell", "file_seq").distinct().selectExpr("cell", "file_seq", f"{n} AS n", "6.0D + file_seq % 2 AS min_lon", "43.0D + file_seq div 2 AS min_lat", "7.0D + file_seq % 2 AS max_lon", "44.0D + file_seq div 2 AS max_lat", f"1.0D / {n - 1} AS inc")


def dem_sql(n: int = SIDE) -> str:
    """The same as common table expressions for another engine."""
    return f"""grid AS (SELECT a.x AS file_seq, b.x AS i, c.x AS j FROM range({CELLS}) a(x), range({n}) b(x), range({n}) c(x)),
samples AS (SELECT CAST(l_linenumber % {CELLS} AS BIGINT) AS file_seq, l_partkey % {n} AS i, l_orderkey % {n} AS j,
  ((sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // count(*)) // 10000 - 500)::BIGINT AS z FROM lineitem GROUP BY 1, 2, 3),
dem AS (SELECT 'N' || (43 + g.file_seq // 2) || 'E00' || (6 + g.file_seq % 2) AS cell, g.file_seq, g.i, g.j, s.z
  FROM grid g LEFT JOIN samples s ON g.file_seq = s.file_seq AND g.i = s.i AND g.j = s.j)"""
