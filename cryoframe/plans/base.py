"""Registry of runnable queries and the point table they read.

Each query is registered with the SQL that gives the same answer on the same tables.
Points are a projection of ``lineitem``; nothing is made up beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cryoframe.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

IDS = ["pa", "pb", "pc", "pd"]
CELL_SPAN = 10007


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on an input of few files; an input of many partitions is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def query(name: str, sql: str | None = None, *, floats: str = "", digits: int = 6):
    """Register a query. ``floats`` are the columns rounded to ``digits`` on both sides."""
    cols = floats.split()

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            df = fn(spark, sf_dir)
            return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            replaced = ", ".join(f"round({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in cols)
            ORACLE[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql}) AS result" if cols else sql
        return fn

    return register


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Altimetry points over ``lineitem``: a true rate of -0.5 m a year, a slope in x, spikes of 25 m.

    Heights, discounts and taxes are whole multiples of powers of two (5/512 stands for a hundredth), so their sums are
    exact: no order of rows, number of cores or engine changes a mean, and ties are ties everywhere.
    """
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    fine = lambda c: F.round(F.col(c) * 100) * F.lit(5.0 / 512)
    x = F.pmod(part * 97, F.lit(CELL_SPAN)) * F.lit(10.0)
    y = F.pmod(order * 31, F.lit(CELL_SPAN)) * F.lit(10.0)
    year = F.year("l_shipdate")
    h = (
        F.lit(500.0) - F.lit(0.5) * (year - 1998) + F.lit(1 / 8192) * (x - 50000.0)
        + (F.col("l_quantity") - 25.0) * F.lit(1 / 128) + F.when(order % 211 == 0, 25.0).otherwise(0.0)
    )
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_suppkey").select(
        (order * 8 + F.col("l_linenumber")).alias("pa"),
        part.alias("pb"),
        F.col("l_suppkey").alias("pc"),
        F.datediff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date")).alias("pd"),
        x.alias("x"),
        y.alias("y"),
        (year + (F.dayofyear("l_shipdate") - 1) / F.lit(365.25)).alias("t_year"),
        year.alias("year"),
        F.month("l_shipdate").alias("month"),
        h.alias("h"),
        (fine("l_tax") + 13 / 256).alias("s_elv"),
        F.col("l_linenumber").cast("int").alias("beam"),
        F.pmod(F.col("l_suppkey"), F.lit(5)).cast("int").alias("mask_class"),
        order.alias("granule"),
        F.col("l_shipdate").alias("ts"),
        fine("l_discount").alias("disc"),
        F.col("l_quantity").alias("qty"),
        F.col("l_returnflag").alias("rflag"),
        fine("l_tax").alias("tax"),
    )


# The same projection for the oracle, as a common table expression.
PTS = """pts AS (
  SELECT l_orderkey*8+l_linenumber AS pa, l_partkey AS pb, l_suppkey AS pc,
    datediff('day', TIMESTAMP '1992-01-01', l_shipdate)::INT AS pd,
    (l_partkey*97)%10007*10.0E0 AS x, (l_orderkey*31)%10007*10.0E0 AS y,
    year(l_shipdate)+(dayofyear(l_shipdate)-1)/365.25E0 AS t_year,
    year(l_shipdate)::INT AS "year", month(l_shipdate)::INT AS "month",
    500.0E0-0.5E0*(year(l_shipdate)-1998)+1.220703125E-4*((l_partkey*97)%10007*10.0E0-50000.0E0)
      +(l_quantity-25.0E0)*0.0078125E0+CASE WHEN l_orderkey%211=0 THEN 25.0E0 ELSE 0.0E0 END AS h,
    round(l_tax*100)*0.009765625E0+0.05078125E0 AS s_elv, l_linenumber::INT AS beam, (l_suppkey%5)::INT AS mask_class,
    l_orderkey AS granule, l_shipdate AS ts, round(l_discount*100)*0.009765625E0 AS disc, l_quantity AS qty, l_returnflag AS rflag, round(l_tax*100)*0.009765625E0 AS tax
  FROM lineitem)"""


def with_pts(body: str, *more: str) -> str:
    """``WITH pts AS (...), more... body``."""
    return "WITH " + ", ".join([PTS, *more]) + " " + body


def tile_nodes_sql(tile: float, step: float, source: str = "pts") -> str:
    """Lattice nodes of the active tiles."""
    n = int(tile / step)
    return (
        f"tiles AS (SELECT DISTINCT floor(x/{tile}E0)::BIGINT AS tile_i, floor(y/{tile}E0)::BIGINT AS tile_j FROM {source}), "
        f"nodes AS (SELECT tile_i*{tile}E0+{step / 2}E0+a.i*{step}E0 AS node_x, tile_j*{tile}E0+{step / 2}E0+b.i*{step}E0 AS node_y, tile_i, tile_j "
        f"FROM tiles, (SELECT unnest(range(0,{n})) AS i) a, (SELECT unnest(range(0,{n})) AS i) b)"
    )


def lonlat(df: DataFrame) -> DataFrame:
    return df.withColumn("lon", F.lit(-115.0) + F.col("x") * 2.0e-4).withColumn("lat", F.lit(-77.5) + F.col("y") * 4.5e-5)


LONLAT = "-115.0E0+x*2.0E-4 AS lon, -77.5E0+y*4.5E-5 AS lat"


