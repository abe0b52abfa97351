"""Tiles on request: a list of tile codes -> run lengths of NaN, filled samples and shape, a row a tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import layer_to_mip, tile_parts
from .planes import block_mean

TILE = "code int, height int, width int, runs array<int>, payload binary"


def run_lengths(gap: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal values, row by row; the first counts False and may be 0."""
    flat = np.concatenate([[False], gap.ravel()])
    turns = np.flatnonzero(flat[1:] != flat[:-1])
    return np.diff(np.concatenate([[0], turns, [gap.size]])).astype(np.int32)


def fill_gaps(tile: np.ndarray, size: int = 4) -> np.ndarray:
    """NaN samples get the mean of what is not NaN in their size x size block; a block of NaN alone stays as it is."""
    h, w = tile.shape
    padded = np.full((-(-h // size) * size, -(-w // size) * size), np.nan)
    padded[:h, :w] = tile
    cells = padded.reshape(padded.shape[0] // size, size, padded.shape[1] // size, size)
    good = ~np.isnan(cells)
    n = good.sum((1, 3), keepdims=True)
    mean = np.where(good, cells, 0.0).sum((1, 3), keepdims=True) / np.maximum(n, 1)
    return np.where(good | (n == 0), cells, mean).reshape(padded.shape)[:h, :w]


def requested_tiles(px: DataFrame, requests: DataFrame, height: int, width: int, planes: list[str], tile: int = 256) -> DataFrame:
    """planes, code, height, width, runs, payload of every requested tile of every plane that has pixels in it.

    requests: (code), packed layer, y and x; a layer's factor comes from the size of the plane. Only pixels that lie in a
    requested tile are averaged. A client's list of codes is small, and Spark broadcasts it by its own threshold; a long one
    is joined by a shuffle.
    payload: 32-bit little-endian samples row by row, NaN where none is known, edge tiles being smaller.
    """
    layer, ty, tx = tile_parts(F.col("code"))
    mip = layer_to_mip(layer, F.lit(height), F.lit(width), tile)
    wanted = requests.select("code").distinct().select("code", mip.alias("mip"), ty.alias("ty"), tx.alias("tx"))
    factors = sorted(r["mip"] for r in wanted.select("mip").distinct().collect())  # one a layer
    out = None
    for f in factors:
        at = lambda c, f=f: F.floor(F.col(c) / (f * tile)).cast("int")
        some = wanted.where(F.col("mip") == f).select("code", "ty", "tx")
        cut = px.withColumns({"ty": at("y"), "tx": at("x")}).join(some, ["ty", "tx"])
        small = block_mean(cut, f, ["code", *planes]) if f > 1 else cut.select("code", *planes, "y", "x", "v")
        out = small if out is None else out.unionByName(small)
    if out is None:
        out = px.select(F.lit(0).alias("code"), *planes, "y", "x", "v").where("false")
    kinds = dict(out.dtypes)

    def one(key: tuple, t: pa.Table) -> pa.Table:
        y, x = (t[c].to_numpy() % tile for c in ("y", "x"))
        samples = np.full((int(y.max()) + 1, int(x.max()) + 1), np.nan)
        samples[y, x] = t["v"].cast(pa.float64()).fill_null(float("nan")).to_numpy()
        head = {c: pa.array([k.as_py()], t.schema.field(c).type) for c, k in zip([*planes, "code"], key, strict=True)}
        body = fill_gaps(samples).astype("<f4").tobytes()
        size = {n: pa.array([s], pa.int32()) for n, s in zip(("height", "width"), samples.shape, strict=True)}
        runs = pa.array([run_lengths(np.isnan(samples)).tolist()], pa.list_(pa.int32()))
        return pa.table({**head, **size, "runs": runs, "payload": pa.array([body], pa.binary())})

    schema = ", ".join(f"{p} {kinds[p]}" for p in planes) + ", " + TILE
    return out.groupBy(*planes, "code").applyInArrow(one, schema)


def samples(tiles: DataFrame) -> DataFrame:
    """tiles with samples (array<float>) in place of payload."""
    names = [c for c in tiles.columns if c != "payload"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [np.frombuffer(p, "<f4") for p in b.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(values, pa.list_(pa.float32()))], names=[*names, "samples"])

    schema = ", ".join(f"{n} {dict(tiles.dtypes)[n]}" for n in names) + ", samples array<float>"
    return tiles.mapInArrow(decode, schema)
