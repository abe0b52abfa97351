"""Scalar expressions of the cube engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """NaN and the infinities as NULL, so that Spark's aggregates leave them out."""
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def tile_id(layer: Column, y: Column, x: Column) -> Column:
    """A tile's packed coordinate: 8 bits of layer, 12 of y, 12 of x."""
    return F.shiftleft(layer, 24).bitwiseOR(F.shiftleft(y, 12)).bitwiseOR(x)


def tile_parts(code: Column) -> tuple[Column, Column, Column]:
    """layer, y, x of a packed coordinate."""
    return F.shiftright(code, 24).bitwiseAND(0xFF), F.shiftright(code, 12).bitwiseAND(0xFFF), code.bitwiseAND(0xFFF)


def layer_to_mip(layer: Column, height: Column, width: Column, tile: int = 256) -> Column:
    """The downsampling factor of a layer, at least 1: the pyramid has one tile at layer 0."""
    most = F.greatest(F.ceil(width / tile), F.ceil(height / tile)).cast("double")
    return F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.ceil(F.log2(most)) - layer)).cast("int")


def mip_to_layer(mip: Column, height: Column, width: Column, tile: int = 256) -> Column:
    most = F.greatest(F.ceil(width / tile), F.ceil(height / tile)).cast("double")
    return F.greatest(F.lit(0), F.ceil(F.log2(most / mip))).cast("int")


def beam_area(major: float | None, minor: float | None, pixel: float | None) -> float:
    """Pixels in a beam, 1 when the header lacks a part."""
    return math.pi * major * minor / (4 * math.log(2)) / pixel if major and minor and pixel else 1.0


def in_rectangle(x: Column, y: Column, cx: float, cy: float, w: float, h: float, degrees: float = 0.0) -> Column:
    """Whether a pixel's centre is inside a rectangle turned counter-clockwise; lower edges count, upper ones don't."""
    a = math.radians(degrees)
    dx, dy = x + 0.5 - cx, y + 0.5 - cy
    u, v = dx * math.cos(a) + dy * math.sin(a), dy * math.cos(a) - dx * math.sin(a)
    return (u >= -w / 2) & (u < w / 2) & (v >= -h / 2) & (v < h / 2)


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a pixel's centre is inside a polygon, by the number of edges that a ray to the right crosses."""
    px, py, n = x + 0.5, y + 0.5, F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            over = (py >= min(y1, y2)) & (py < max(y1, y2)) & (px < x1 + (py - y1) * (x2 - x1) / (y2 - y1))
            n = n + over.cast("int")
    return n % 2 == 1
