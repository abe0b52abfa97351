"""Slabs, downsampled planes, tiles and histograms of cubes; every operator is grouped by the plane, so planes run in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite


def slab(px: DataFrame, **ranges: tuple[int, int] | int) -> DataFrame:
    """Pixels inside half-open ranges of the named axes; a number selects one place."""
    for axis, r in ranges.items():
        px = px.where(F.col(axis) == r) if isinstance(r, int) else px.where((F.col(axis) >= r[0]) & (F.col(axis) < r[1]))
    return px


def block_mean(px: DataFrame, factor: int, planes: list[str]) -> DataFrame:
    """Mean of the finite pixels of each factor x factor block; edge blocks may be partial; none finite: NULL."""
    key = [*planes, F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")]
    f = finite(F.col("v"))
    return px.groupBy(*key).agg(F.avg(f).alias("v")).select(*planes, "y", "x", "v")


def pyramid(px: DataFrame, levels: int, planes: list[str]) -> DataFrame:
    """block_mean for factors 1, 2, 4 ... in one pass: sums and counts of a level are made from the level below."""
    f = finite(F.col("v"))
    at = px.groupBy(*planes, "y", "x").agg(F.sum(f).alias("s"), F.count(f).alias("n"))
    out = None
    for k in range(levels):
        if k:
            at = at.groupBy(*planes, F.shiftright("y", 1).alias("y"), F.shiftright("x", 1).alias("x")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        level = at.select(F.lit(1 << k).alias("mip"), *planes, "y", "x", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("v"))
        out = level if out is None else out.unionByName(level)
    return out


def tiles(px: DataFrame, size: int, planes: list[str]) -> DataFrame:
    """Pixels with their tile (ty, tx) and their place inside it (dy, dx)."""
    return px.select(
        *planes, F.floor(F.col("y") / size).cast("int").alias("ty"), F.floor(F.col("x") / size).cast("int").alias("tx"),
        (F.col("y") % size).alias("dy"), (F.col("x") % size).alias("dx"), "v",
    )


def nan_runs(cut: DataFrame, planes: list[str]) -> DataFrame:
    """Run lengths of NaN in each tile, row by row; the first run counts pixels that aren't NaN and may be 0."""
    key = [*planes, "ty", "tx"]
    w = Window.partitionBy(*key).orderBy("dy", "dx")
    df = cut.withColumn("gap", F.isnan("v").cast("int"))
    df = df.withColumn("flip", (F.col("gap") != F.coalesce(F.lag("gap").over(w), F.lit(0))).cast("int"))
    df = df.withColumn("run", F.sum("flip").over(w).cast("int"))
    runs = df.groupBy(*key, "run").agg(F.count("*").alias("length"))
    first = runs.groupBy(*key).agg(F.min("run").alias("m")).where("m > 0").select(*key, F.lit(0).alias("run"), F.lit(0).cast("long").alias("length"))
    return runs.unionByName(first)


def nan_fill(cut: DataFrame, planes: list[str]) -> DataFrame:
    """NaN pixels get the mean of what is not NaN in their 4 x 4 block; a block of NaN alone stays NULL."""
    w = Window.partitionBy(*planes, "ty", "tx", F.floor(F.col("dy") / 4), F.floor(F.col("dx") / 4))
    good = F.when(~F.isnan("v"), F.col("v"))
    return cut.select(*planes, "ty", "tx", "dy", "dx", F.coalesce(good, F.avg(good).over(w)).alias("v"))


def bounds(px: DataFrame, planes: list[str]) -> DataFrame:
    f = finite(F.col("v"))
    return px.groupBy(*planes).agg(F.min(f).alias("lo"), F.max(f).alias("hi"), F.count("*").alias("pixels"), F.count(f).alias("good"))


def _bin(v: Column) -> Column:
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.col("bins") - 1, F.floor((v - F.col("lo")) / width))).cast("int")


def histogram(px: DataFrame, planes: list[str], bins: int | None = None, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Counts by bin of each plane: by default sqrt(pixels) bins, at least 2, from the smallest to the largest finite value.

    Fixed bounds leave out what is outside; the upper bound belongs to the last bin; a constant plane is all in bin 0.
    """
    edge = bounds(px, planes)
    edge = edge.withColumn("bins", F.lit(bins) if bins else F.greatest(F.lit(2), F.floor(F.sqrt("pixels"))).cast("int"))
    if lo is not None:
        edge = edge.withColumns({"lo": F.lit(float(lo)), "hi": F.lit(float(hi))})
    df = px.withColumn("v", finite(F.col("v"))).join(edge.select(*planes, "lo", "hi", "bins"), planes)
    df = df.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    return df.groupBy(*planes, _bin(F.col("v")).alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("bins").alias("bins"))


def histogram_moments(hist: DataFrame, planes: list[str]) -> DataFrame:
    """Mean and population deviation of each plane as its bins' centres give them."""
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    c = F.col("lo") + (F.col("bin") + 0.5) * width
    s = hist.groupBy(*planes).agg(F.sum("n").alias("n"), F.sum(F.col("n") * c).alias("s"), F.sum(F.col("n") * c * c).alias("q"))
    mean = F.col("s") / F.col("n")
    return s.select(*planes, mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("sigma"))
