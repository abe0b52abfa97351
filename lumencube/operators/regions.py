"""Region clips, statistics, profiles and moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite


def nine(f: Column, beam: float = 1.0) -> list[Column]:
    """Sum, flux density, mean, RMS, sigma, sum of squares, min, max, extremum of finite values; none: NULL."""
    lo, hi = F.min(f), F.max(f)
    return [
        F.sum(f).alias("sum"), (F.sum(f) / beam).alias("flux_density"), F.avg(f).alias("mean"),
        F.sqrt(F.avg(f * f)).alias("rms"), F.stddev_pop(f).alias("sigma"), F.sum(f * f).alias("sum_sq"),
        lo.alias("min"), hi.alias("max"), F.when(F.abs(hi) >= F.abs(lo), hi).otherwise(lo).alias("extrema"),
    ]


def region_stats(px: DataFrame, inside: Column, by: list[str], beam: float = 1.0) -> DataFrame:
    f = finite(F.col("v"))
    return px.where(inside).groupBy(*by).agg(F.count(f).alias("n"), *nine(f, beam))


def clip(boxes: DataFrame) -> DataFrame:
    """boxes (x0, y0, x1, y1 as doubles; img_h, img_w): half-open pixel ranges of the clipped box and its mask's shape."""
    lo = lambda c: F.greatest(F.lit(0), F.floor(c)).cast("int")
    df = boxes.withColumns({
        "cx0": lo("x0"), "cy0": lo("y0"), "cx1": F.least("img_w", F.ceil("x1")).cast("int"), "cy1": F.least("img_h", F.ceil("y1")).cast("int"),
    })
    empty = (F.col("cx1") <= F.col("cx0")) | (F.col("cy1") <= F.col("cy0"))
    size = lambda a, b: F.when(empty, 0).otherwise(F.col(b) - F.col(a)).cast("int")
    return df.withColumns({"mask_h": size("cy0", "cy1"), "mask_w": size("cx0", "cx1")})


def progressive(px: DataFrame, inside: Column, step: int) -> DataFrame:
    """What a client holds after each slab of `step` channels: channels done, their pixels, sum and mean so far."""
    f = finite(F.col("v"))
    each = px.where(inside).groupBy(F.floor(F.col("channel") / step).cast("int").alias("slab")).agg(
        F.countDistinct("channel").alias("c"), F.sum(f).alias("s"), F.count(f).alias("n")
    )
    w = Window.orderBy("slab")  # one row a slab
    return each.select(
        "slab", F.sum("c").over(w).alias("channels"), F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("sum"),
        (F.sum("s").over(w) / F.sum("n").over(w)).alias("mean"),
    )


def moments(
    px: DataFrame, crval: float = 1.0e9, cdelt: float = 1.0e6, crpix: float = 1.0, channels: tuple[int, int] | None = None,
    values: tuple[float, float] | None = None, planes: tuple[str, ...] = (),
) -> DataFrame:
    """The 13 moments of each (y, x), and of each of `planes`, over the channels with finite values.

    c is a channel's coordinate in MHz; channels: a half-open range; values: only pixels inside this closed range count.
    Weighted coordinate and dispersion are NULL where the values add up to 0, dispersion also where its square is negative.
    The median holds all values of a (y, x) at once: as many as there are channels.
    """
    if channels:
        px = px.where((F.col("channel") >= channels[0]) & (F.col("channel") < channels[1]))
    px = px.withColumn("v", finite(F.col("v"))).where("v is not null")
    if values:
        px = px.where(F.col("v").between(*values))
    first = (crval + (1 - crpix) * cdelt) / 1e6  # sums of squares are taken from the first channel's coordinate on
    px = px.withColumn("d", F.col("channel") * (cdelt / 1e6)).withColumn("c", F.lit(first) + F.col("d"))
    key = [*planes, "y", "x"]
    at = Window.partitionBy(*key)
    run = F.sum("v").over(at.orderBy("channel"))
    px = px.withColumns({"dev": F.abs(F.col("v") - F.avg("v").over(at)), "half": run * 2 >= F.sum("v").over(at)})
    v, c, d = F.col("v"), F.col("c"), F.col("d")
    total = F.sum(v)
    m1 = F.when(total != 0, F.sum(v * d) / total)
    square = F.when(total != 0, F.sum(v * d * d) / total) - m1 * m1
    return px.groupBy(*key).agg(
        F.avg(v).alias("mean"), (total * abs(cdelt) / 1e6).alias("integrated"), (m1 + first).alias("weighted_coord"), F.when(square >= 0, F.sqrt(square)).alias("dispersion"),
        F.median(v).alias("median"), F.min(F.when(F.col("half"), c)).alias("median_coord"), F.stddev_pop(v).alias("std"),
        F.sqrt(F.avg(v * v)).alias("rms"), F.avg("dev").alias("abs_dev"), F.max(v).alias("max"), F.max_by(c, F.struct(v, -F.col("channel"))).alias("max_coord"),
        F.min(v).alias("min"), F.min_by(c, F.struct(v, F.col("channel"))).alias("min_coord"),
    )
