"""Gaussian smoothing of planes stored as blocks: each block gets a margin from its neighbours and is smoothed in one task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gaussian(blocks: DataFrame, planes: list[str], sigma: float, size: int = 256, reach: float = 3.0, shape: tuple[int, int] | None = None) -> DataFrame:
    """blocks (planes and blocks.BLOCK of `size`) with each pixel as the mean of the finite pixels around it, under Gaussian
    weights up to ceil(reach * sigma) pixels off along each axis; NaN where there are none. data is an array of doubles.

    The margin is at most a block wide, so a block's pixels go to at most nine places; only strips of it move besides
    itself. A pixel without a value gets one from its neighbours; places outside the image count as without values. shape:
    height and width of the image, all of whose places get a value from pixels near them, in blocks that aren't there or
    are cut short too; without it each block has the places that it came with.
    """
    radius = math.ceil(reach * sigma)
    if radius > size:
        raise ValueError(f"a kernel of {radius} pixels is wider than a block of {size}")
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    fields = [blocks.schema[p] for p in planes]
    kinds = [("by", T.IntegerType()), ("bx", T.IntegerType()), ("own", T.BooleanType()), ("y0", T.IntegerType()), ("x0", T.IntegerType()), ("height", T.IntegerType()), ("width", T.IntegerType()), ("data", T.ArrayType(T.FloatType()))]
    dealt = T.StructType([*fields, *(T.StructField(n, k) for n, k in kinds)])

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                by, bx, y0, x0, h, w = (b.column(c)[i].as_py() for c in ("by", "bx", "y0", "x0", "height", "width"))
                v, rows = b.column("data")[i].values.to_numpy(zero_copy_only=False).reshape(h, w), []
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        # What the neighbour at (dy, dx) needs: its pixels are within the radius of this part.
                        ys = slice(0, h) if dy == 0 else slice(0, min(radius, h)) if dy < 0 else slice(max(0, size - radius), h)
                        xs = slice(0, w) if dx == 0 else slice(0, min(radius, w)) if dx < 0 else slice(max(0, size - radius), w)
                        part = v[ys, xs]
                        if part.size and by + dy >= 0 and bx + dx >= 0:
                            rows.append((by + dy, bx + dx, dy == dx == 0, y0 + ys.start, x0 + xs.start, *part.shape, part.ravel()))
                columns = [pa.array(c, dealt_arrow.field(n).type) for c, (n, _) in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.repeat(b.column(p)[i], len(rows)) for p in planes), *columns], names=dealt.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    dealt_arrow = to_arrow_schema(dealt)
    out = T.StructType([*fields, *(T.StructField(n, k) for n, k in kinds if n not in ("own", "data")), T.StructField("data", T.ArrayType(T.DoubleType()))])

    def smooth(key: tuple, t: pa.Table) -> pa.Table:
        own = t.filter(t["own"])
        by, bx = (int(k.as_py()) for k in key[-2:])
        if shape:
            y0, x0 = by * size, bx * size
            h, w = min(size, shape[0] - y0), min(size, shape[1] - x0)
        else:
            y0, x0, h, w = (own[c][0].as_py() if own.num_rows else 0 for c in ("y0", "x0", "height", "width"))
        if h <= 0 or w <= 0:  # a place beyond the image
            return to_arrow_schema(out).empty_table()
        wide = np.full((h + 2 * radius, w + 2 * radius), np.nan)
        for i in range(t.num_rows):
            py, px, ph, pw = (t[c][i].as_py() for c in ("y0", "x0", "height", "width"))
            part, y, x = t["data"][i].values.to_numpy(zero_copy_only=False).reshape(ph, pw), py - y0 + radius, px - x0 + radius
            ys, xs = slice(max(0, y), min(wide.shape[0], y + ph)), slice(max(0, x), min(wide.shape[1], x + pw))
            wide[ys, xs] = part[ys.start - y : ys.stop - y, xs.start - x : xs.stop - x]
        ok = np.isfinite(wide)
        sums = [np.apply_along_axis(np.convolve, 1, np.apply_along_axis(np.convolve, 0, a, weights, "valid"), weights, "valid") for a in (np.where(ok, wide, 0.0), ok.astype(float))]
        found = np.where(sums[1] > 1e-12, sums[0] / np.maximum(sums[1], 1e-12), np.nan)
        place = [pa.array([v], pa.int32()) for v in (by, bx, y0, x0, h, w)]
        return pa.table([*(pa.repeat(k, 1) for k in key[:-2]), *place, pa.array([found.ravel()], pa.list_(pa.float64()))], schema=to_arrow_schema(out))

    return blocks.select(*planes, "by", "bx", "y0", "x0", "height", "width", "data").mapInArrow(strips, dealt).groupBy(*planes, "by", "bx").applyInArrow(smooth, out)
