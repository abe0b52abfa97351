"""Contours, position-velocity cuts, vector overlays, source estimates, animation frames and tile payloads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite
from .planes import block_mean


def contour_crossings(px: DataFrame, levels: list[float], planes: list[str], smooth: int = 1, band: int = 256) -> DataFrame:
    """Where the line between two neighbouring pixels' centres crosses a level, by linear interpolation.

    An edge goes from (y, x) to its neighbour along `axis`; an edge with a missing or non-finite end has no crossing.
    smooth: the contours are those of the means of smooth x smooth blocks, y and x being the block's; at_y and at_x are
    places in the plane. Pixels are shuffled once, in squares of `band`; those at a square's lower edges go to the square
    before it, too. Inside a square two windows, by row and by column, find the neighbours.
    """
    if smooth > 1:
        px = block_mean(px, smooth, planes)
    y, x, tile = F.col("y"), F.col("x"), lambda c: F.floor(c / band).cast("int")
    own = F.struct(tile(y).alias("ty"), tile(x).alias("tx"))
    left = F.when((x % band == 0) & (x > 0), F.struct(tile(y).alias("ty"), (tile(x) - 1).alias("tx")))
    above = F.when((y % band == 0) & (y > 0), F.struct((tile(y) - 1).alias("ty"), tile(x).alias("tx")))
    dealt = px.select(*planes, "y", "x", finite(F.col("v")).alias("v"), F.explode(F.array_compact(F.array(own, left, above))).alias("s"))
    key = [*planes, "ty", "tx"]
    dealt = dealt.select(*planes, "s.ty", "s.tx", "y", "x", "v").repartition(*key)
    row, column = Window.partitionBy(*key, "y").orderBy("x"), Window.partitionBy(*key, "x").orderBy("y")
    after = lambda w, c: F.when(F.lead(c).over(w) == F.col(c) + 1, F.lead("v").over(w))
    near = dealt.withColumn("bx", after(row, "x")).withColumn("by", after(column, "y"))
    # What came from the next square has its edges there.
    near = near.where((F.col("ty") == tile(y)) & (F.col("tx") == tile(x)))
    ends = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("bx").alias("b")), F.struct(F.lit("y").alias("axis"), F.col("by").alias("b"))))
    edges = near.select(*planes, "y", "x", F.col("v").alias("a"), ends.alias("e")).select(*planes, "y", "x", "a", "e.axis", "e.b")
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    edges = edges.where((F.col("a") < F.col("level")) != (F.col("b") < F.col("level")))
    t = (F.col("level") - F.col("a")) / (F.col("b") - F.col("a"))
    along = lambda axis: (F.col(axis) + F.when(F.col("axis") == axis, t).otherwise(0.0)) * smooth + (smooth - 1) / 2
    return edges.select(*planes, "level", "axis", "y", "x", along("y").alias("at_y"), along("x").alias("at_x"))


def pv_cut(px: DataFrame, start: tuple[float, float], stop: tuple[float, float], width: float) -> DataFrame:
    """Mean of the finite pixels by channel and whole step along the line from start to stop (x, y), at most width / 2 off it.

    A pixel's step is a closed form of its place: one filter and one aggregation, no join with points of the line.
    """
    length = math.hypot(stop[0] - start[0], stop[1] - start[1])
    ux, uy = (stop[0] - start[0]) / length, (stop[1] - start[1]) / length
    dx, dy, f = F.col("x") - start[0], F.col("y") - start[1], finite(F.col("v"))
    along, off = dx * ux + dy * uy, F.abs(dy * ux - dx * uy)
    df = px.where((along >= 0) & (along < length) & (off <= width / 2)).groupBy("channel", F.floor(along).cast("int").alias("step"))
    return df.agg(F.count(f).alias("n"), F.avg(f).alias("v"))


def vectors(iqu: DataFrame, factor: int, planes: list[str], threshold: float, error: float = 0.0) -> DataFrame:
    """Polarised intensity and angle (degrees) of block means where I reaches the threshold; `error` takes the bias away.

    iqu: stokes 0 Q, 1 U, 2 I. A block needs all three; one whose intensity the bias exceeds has intensity 0.
    """
    at = lambda k: F.max(F.when(F.col("stokes") == k, F.col("v")))
    b = block_mean(iqu, factor, ["stokes", *planes]).groupBy(*planes, "y", "x").agg(at(0).alias("q"), at(1).alias("u"), at(2).alias("i"))
    b = b.where(f"q IS NOT NULL AND u IS NOT NULL AND i >= {threshold}")
    q, u = F.col("q"), F.col("u")
    return b.select(*planes, "y", "x", F.sqrt(F.greatest(F.lit(0.0), q * q + u * u - error * error)).alias("intensity"), F.degrees(F.atan2(u, q) * 0.5).alias("angle"))


def source_estimate(px: DataFrame, inside: Column, by: list[str]) -> DataFrame:
    """One Gaussian a group from the moments of its positive pixels: flux, centre, and widths at half maximum along x and y."""
    df = px.where(inside).withColumn("w", finite(F.col("v"))).where("w > 0")
    x, y, weight = F.col("x").cast("double"), F.col("y").cast("double"), F.col("w")
    s = df.groupBy(*by).agg(F.sum(weight).alias("s"), F.sum(weight * x).alias("sx"), F.sum(weight * y).alias("sy"), F.sum(weight * x * x).alias("sxx"), F.sum(weight * y * y).alias("syy"))
    mean = lambda c: F.col(c) / F.col("s")
    wide = lambda a: 2 * math.sqrt(2 * math.log(2)) * F.sqrt(F.greatest(F.lit(0.0), mean(f"s{a}{a}") - mean(f"s{a}") * mean(f"s{a}")))
    return s.select(*by, F.col("s").alias("flux"), mean("sx").alias("x"), mean("sy").alias("y"), wide("x").alias("fwhm_x"), wide("y").alias("fwhm_y"))


def frames(requests: DataFrame) -> DataFrame:
    """requests (id, first, last, start, delta, steps): the channel that each step of an animation shows; it loops at both ends."""
    n = F.col("last") - F.col("first") + 1
    df = requests.where("last >= first AND steps > 0").withColumn("step", F.explode(F.sequence(F.lit(0), (F.col("steps") - 1).cast("int"))))
    return df.select("id", "step", (F.col("first") + F.pmod(F.col("start") - F.col("first") + F.col("step") * F.col("delta"), n)).alias("channel"))


def tile_payload(filled: DataFrame, planes: list[str]) -> DataFrame:
    """One row a tile: its samples row by row as 32-bit floats (NULL where none is known), without compression."""
    cell = F.struct("dy", "dx", finite(F.col("v")).cast("float").alias("m"))
    return filled.groupBy(*planes, "ty", "tx").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["m"]).alias("payload"))



def polarisation(q: Column, u: Column, v: Column, i: Column) -> dict[str, Column]:
    """Linear and total polarised intensity, their fractions of I, and the angle in degrees; a fraction of I = 0 is NULL."""
    linear, total = F.sqrt(q * q + u * u), F.sqrt(q * q + u * u + v * v)
    part = lambda p: F.when(i != 0, p / i)
    return {"plinear": linear, "ptotal": total, "pflinear": part(linear), "pftotal": part(total), "pangle": F.degrees(F.atan2(u, q) * 0.5)}
