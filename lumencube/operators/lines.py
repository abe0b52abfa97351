"""Contours as ordered lines: marching squares over blocks, then list ranking of the crossings.

A crossing lies on the edge between two neighbouring pixels' centres. Inside each square of four centres a line goes from
one crossing to the next with the higher values on its left, so every crossing has at most one successor, and lines join
across the borders of blocks by the edges' numbers alone. Pointers are then doubled: a round joins each crossing with the one
its pointer has reached, so a line of n crossings takes log2(n) rounds, of as many rows as there are crossings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.store import scratch


def _steps(v: np.ndarray, y0: int, x0: int, level: float) -> list[np.ndarray]:
    """Columns edge, next, at_y, at_x (of the edge), end_y, end_x (of the next): a row a step inside a square of four centres.

    An edge's number: y in the upper 31 bits, then x, then 1 for an edge along y. A square with a missing corner has none;
    in a saddle the mean of the corners tells which of them are joined.
    """
    a, b, c, d = v[:-1, :-1], v[:-1, 1:], v[1:, 1:], v[1:, :-1]
    whole = np.isfinite(a) & np.isfinite(b) & np.isfinite(c) & np.isfinite(d)
    high = [whole & (p >= level) for p in (a, b, c, d)]
    y, x = (p.astype(np.int64) for p in np.meshgrid(np.arange(v.shape[0] - 1) + y0, np.arange(v.shape[1] - 1) + x0, indexing="ij"))
    part = lambda p, q: (level - p) / np.where(q == p, 1.0, q - p)
    code = lambda y, x, along: (y << 32) | (x << 1) | along
    # Each side: its number, place, and whether the line enters or leaves there.
    sides = {
        "top": (code(y, x, 0), y + 0.0, x + part(a, b), high[0] & ~high[1] & whole, high[1] & ~high[0] & whole),
        "bottom": (code(y + 1, x, 0), y + 1.0, x + part(d, c), high[2] & ~high[3] & whole, high[3] & ~high[2] & whole),
        "left": (code(y, x, 1), y + part(a, d), x + 0.0, high[3] & ~high[0] & whole, high[0] & ~high[3] & whole),
        "right": (code(y, x + 1, 1), y + part(b, c), x + 1.0, high[1] & ~high[2] & whole, high[2] & ~high[1] & whole),
    }
    saddle = whole & (high[0] == high[2]) & (high[1] == high[3]) & (high[0] != high[1])
    joined = saddle & ((a + b + c + d) / 4 >= level)  # the high corners are
    out = []
    for enter, (e, ey, ex, comes, _) in sides.items():
        for leave, (n, ny, nx, _, goes) in sides.items():
            if enter != leave:
                around_b_or_d = {enter, leave} in ({"top", "right"}, {"bottom", "left"})
                around_a_or_c = {enter, leave} in ({"top", "left"}, {"bottom", "right"})
                # Corners that a saddle keeps apart are each cut off by a step of their own.
                cut_b_and_d = (joined & high[0]) | (~joined & high[1])
                here = comes & goes & (~saddle | (cut_b_and_d if around_b_or_d else ~cut_b_and_d if around_a_or_c else False))
                k = np.nonzero(here)
                out.append([p[k] for p in (e, n, ey, ex, ny, nx)])
    return [np.concatenate(p) for p in zip(*out, strict=True)]


def steps(blocks: DataFrame, planes: list[str], levels: list[float]) -> DataFrame:
    """planes, level and _steps() of all blocks; each block gets the first row and column of the blocks after it."""
    names = [*planes, "by", "bx", "own", "y0", "x0", "height", "width", "data"]
    fields = {f.name: f for f in blocks.schema.fields}
    dealt = T.StructType([fields.get(n, T.StructField("own", T.BooleanType())) for n in names])
    arrow = to_arrow_schema(dealt)

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                by, bx, y0, x0, h, w = (b.column(c)[i].as_py() for c in ("by", "bx", "y0", "x0", "height", "width"))
                v = b.column("data")[i].values.to_numpy(zero_copy_only=False).reshape(h, w)
                rows = [(by - dy, bx - dx, dy == dx == 0, y0, x0, *p.shape, p.ravel()) for dy, dx, p in ((0, 0, v), (1, 0, v[:1]), (0, 1, v[:, :1]), (1, 1, v[:1, :1])) if by >= dy and bx >= dx]
                columns = [pa.array(c, arrow.field(n).type) for c, n in zip(zip(*rows, strict=True), names[len(planes) :], strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.repeat(b.column(p)[i], len(rows)) for p in planes), *columns], names=names)

    found = ("edge", "next", "at_y", "at_x", "end_y", "end_x")
    kinds = [T.LongType()] * 2 + [T.DoubleType()] * 4
    schema = T.StructType([*(fields[p] for p in planes), T.StructField("level", T.DoubleType()), *(T.StructField(n, k) for n, k in zip(found, kinds, strict=True))])

    def march(key: tuple, t: pa.Table) -> pa.Table:
        own, tables = t.filter(t["own"]), []
        if own.num_rows:
            y0, x0, h, w = (own[c][0].as_py() for c in ("y0", "x0", "height", "width"))
            v = np.full((h + 1, w + 1), np.nan)
            for i in range(t.num_rows):
                py, px, ph, pw = (t[c][i].as_py() for c in ("y0", "x0", "height", "width"))
                ys, xs = slice(py - y0, min(h + 1, py - y0 + ph)), slice(px - x0, min(w + 1, px - x0 + pw))
                v[ys, xs] = t["data"][i].values.to_numpy(zero_copy_only=False).reshape(ph, pw)[: ys.stop - ys.start, : xs.stop - xs.start]
            for level in levels:
                columns = _steps(v, y0, x0, level)
                head = [pa.repeat(k, len(columns[0])) for k in key[: len(planes)]]
                tables.append(pa.table([*head, pa.repeat(pa.scalar(float(level)), len(columns[0])), *map(pa.array, columns)], names=schema.names))
        return pa.concat_tables(tables) if tables else to_arrow_schema(schema).empty_table()

    return blocks.select(*[n for n in names if n != "own"]).mapInArrow(strips, dealt).groupBy(*planes, "by", "bx").applyInArrow(march, schema)


def lines(blocks: DataFrame, planes: list[str], levels: list[float]) -> DataFrame:
    """planes, level, line, closed, place, edge, at_y, at_x: every crossing with its line and its place from the line's end on.

    edge: the number of the edge that it lies on, y in the upper 31 bits, then x, then 1 for an edge along y.
    line: a closed line's smallest edge, an open one's last edge. Closed lines are cut at that edge. Crossings on squares
    with a missing corner alone belong to no line. Values equal to a level count as above it. A plane of NaN has no rows.
    """
    spark, root, key = blocks.sparkSession, scratch(blocks.sparkSession, "lines"), [*planes, "level"]

    def kept(df: DataFrame) -> DataFrame:
        path = f"{root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def doubled(state: DataFrame) -> DataFrame:
        """state (key, edge, to, least, hops) with pointers followed until none reaches further."""
        while True:
            ahead = state.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("edge").alias("_edge"), F.col("to").alias("_to"), F.col("least").alias("_least"), F.col("hops").alias("_hops"))
            on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key] + [F.col("to") == F.col("_edge")]
            new = state.join(ahead, on, "left")
            new = kept(new.select(*key, "edge", F.col("_to").alias("to"), F.least("least", F.coalesce("_least", "least")).alias("least"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), (F.col("_least") < F.col("least")).alias("lower"), F.col("to").isNotNull().alias("moved"), "first"))
            open_left, lower = new.agg(F.count(F.when(F.col("moved") & F.col("to").isNull(), 1)), F.count(F.when(F.col("lower"), 1))).first()
            state = new.drop("lower", "moved")
            if not open_left and not lower:
                return state

    found = kept(steps(blocks, planes, levels))
    ends = found.select(*key, F.col("next").alias("edge"), F.col("end_y").alias("at_y"), F.col("end_x").alias("at_x"))
    last = ends.join(found.select(*key, "edge"), [*key, "edge"], "left_anti").withColumn("next", F.lit(None).cast("long"))
    nodes = kept(found.select(*key, "edge", "next", "at_y", "at_x").unionByName(last))
    start = lambda to: nodes.select(*key, "edge", to.alias("to"), F.coalesce(F.least("edge", "next"), "edge").alias("least"), F.when(to.isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("next").alias("first"))
    once = doubled(start(F.col("next")))
    rings = once.where("to IS NOT NULL").select(*key, "edge", F.col("least").alias("line"), F.col("first").alias("next"))
    paths = once.where("to IS NULL").select(*key, "edge", "hops")
    # A closed line is cut before its smallest edge and ranked like an open one.
    cut = F.when(F.col("next") != F.col("line"), F.col("next"))
    opened = rings.select(*key, "edge", cut.alias("to"), F.lit(0).cast("long").alias("least"), F.when(cut.isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("line").alias("first"))
    ranked = doubled(opened).select(*key, "edge", F.col("first").alias("line"), F.lit(True).alias("closed"), F.col("hops").alias("place"))
    tails = _to_ends(paths, nodes, key, kept)
    out = ranked.unionByName(tails.select(*key, "edge", "line", F.lit(False).alias("closed"), F.col("hops").alias("place")))
    return out.join(nodes.select(*key, "edge", "at_y", "at_x"), [*key, "edge"])


def _to_ends(paths: DataFrame, nodes: DataFrame, key: list[str], kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """paths (key, edge, hops) plus line, the edge without a successor that each reaches."""
    state = kept(paths.join(nodes.select(*key, "edge", "next"), [*key, "edge"]).select(*key, "edge", "hops", F.coalesce("next", "edge").alias("line")))
    while True:
        ahead = state.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("edge").alias("_edge"), F.col("line").alias("_line"))
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key] + [F.col("line") == F.col("_edge")]
        new = kept(state.join(ahead, on).select(*key, "edge", "hops", F.col("_line").alias("line"), (F.col("_line") != F.col("line")).alias("moved")))
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            return state
