"""Cubes as tables of pixels (image, stokes, channel, y, x, v), made from the given tables by fixed rules.

emb3d: channel = vec_id div 50, y = vec_id mod 50, x = place in the vector. emb3d_nan: the same with NaN at a regular
pattern of pixels. li4d: stokes from the return flag, channel = months since 1992-01, y and x from supplier and part.
Filters on channel and y become ranges of vec_id, which reach the Parquet scan before the vectors are taken apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, WIDTH = 50, 64


def emb3d_pixels(vectors: DataFrame) -> DataFrame:
    """channel, y, x, v of a table or stream with the columns of embeddings."""
    df = vectors.select("vec_id", F.posexplode("embedding").alias("x", "v"))
    channel = F.floor(F.col("vec_id") / ROWS).cast("int")
    return df.select(channel.alias("channel"), (F.col("vec_id") % ROWS).cast("int").alias("y"), "x", F.col("v").cast("double").alias("v"))


def emb3d_nan_pixels(vectors: DataFrame) -> DataFrame:
    gap = (F.col("y") * 7 + F.col("x") * 13 + F.col("channel")) % 11 == 0
    return emb3d_pixels(vectors).withColumn("v", F.when(gap, float("nan")).otherwise(F.col("v")))


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of whole planes: the rows that a channel lacks are zeros. Only ids are compared."""
    first = F.floor(F.col("vec_id") / ROWS) * ROWS
    ids = vectors.select(first.alias("first")).distinct().select(F.explode(F.sequence("first", F.col("first") + ROWS - 1)).alias("vec_id"))
    absent = ids.join(vectors.select("vec_id"), "vec_id", "left_anti")
    zeros = F.array_repeat(F.lit(0.0), WIDTH).cast("array<float>").alias("embedding")
    return vectors.select("vec_id", "embedding").unionByName(absent.select("vec_id", zeros))


def _vectors(spark: SparkSession, sf_dir: str, channels: tuple[int, int] | None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return of_channels(df, channels) if channels else df


def of_channels(vectors: DataFrame, channels: tuple[int, int]) -> DataFrame:
    """channels: a half-open range, pushed to the scan as a range of vec_id."""
    return vectors.where((F.col("vec_id") >= channels[0] * ROWS) & (F.col("vec_id") < channels[1] * ROWS))


def emb3d(spark: SparkSession, sf_dir: str, channels: tuple[int, int] | None = None) -> DataFrame:
    return emb3d_pixels(_vectors(spark, sf_dir, channels))


def emb3d_nan(spark: SparkSession, sf_dir: str, channels: tuple[int, int] | None = None) -> DataFrame:
    return emb3d_nan_pixels(_vectors(spark, sf_dir, channels))


def li4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity by (stokes, channel, y, x): a sparse cube with one aggregation over lineitem."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    month = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1
    stokes = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    key = [stokes.alias("stokes"), month.cast("int").alias("channel"), (F.col("l_suppkey") % 64).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x")]
    sums = df.groupBy(*key).agg(F.sum(F.round(F.col("l_quantity") * 100).cast("long")).alias("s"), F.count("*").alias("n"))
    return sums.select("stokes", "channel", "y", "x", (F.col("s") / 100.0 / F.col("n")).alias("v"))


# The same in SQL, for the oracle; NaN is NULL there. px: emb3d_nan, pf: emb3d, li: li4d.
SQL = """e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding)))::INTEGER AS x FROM embeddings),
pf AS (SELECT (vec_id // 50)::INTEGER AS channel, (vec_id % 50)::INTEGER AS y, x, v FROM e),
px AS (SELECT channel, y, x, CASE WHEN (y * 7 + x * 13 + channel) % 11 = 0 THEN NULL ELSE v END AS v FROM pf),
li AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS stokes,
  ((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1)::INTEGER AS channel, (l_suppkey % 64)::INTEGER AS y, (l_partkey % 64)::INTEGER AS x,
  sum(round(l_quantity * 100)::BIGINT) / 100.0 / count(*) AS v FROM lineitem GROUP BY 1, 2, 3, 4)"""
