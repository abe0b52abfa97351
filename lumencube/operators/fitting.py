"""Fits of Gaussian components to images by the Levenberg-Marquardt method, all groups at once.

A round is one job over the blocks: a task evaluates the model and its derivatives on each block under the block's group's
trial parameters and gives the block's share of the normal equations; Spark sums the shares by group; a row a group then
takes or refuses its trial and makes the next one. What moves are sums as wide as the parameters, never pixels; the driver
asks only whether a group is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import scratch

PARTS = ("amplitude", "x", "y", "sigma_x", "sigma_y", "angle")  # angle: radians, of the sigma_x axis from x towards y


def model(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and derivatives (a column a parameter) of the components and the background, which is the last parameter."""
    total, columns = np.full(len(x), p[-1]), []
    for a, x0, y0, sx, sy, t in p[:-1].reshape(-1, len(PARTS)):
        c, s = np.cos(t), np.sin(t)
        u, v = (x - x0) * c + (y - y0) * s, (y - y0) * c - (x - x0) * s
        e = np.exp(-0.5 * (u * u / sx**2 + v * v / sy**2))
        du, dv = -a * e * u / sx**2, -a * e * v / sy**2  # by u and by v
        total = total + a * e
        columns += [e, -du * c + dv * s, -du * s - dv * c, a * e * u * u / sx**3, a * e * v * v / sy**3, du * v - dv * u]
    return total, np.stack([*columns, np.ones(len(x))], 1)


def _shares(blocks: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """by and sums: of each group the sums over its blocks of the normal matrix, the right side, the cost and the pixels."""
    fields = [blocks.schema[c] for c in by]
    schema = T.StructType([*fields, T.StructField("s", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                p, wide = b.column("trial")[i].values.to_numpy(), b.column("width")[i].as_py()
                v = b.column("data")[i].values.to_numpy(zero_copy_only=False).astype(np.float64)
                at = np.flatnonzero(np.isfinite(v))
                value, j = model(p, b.column("x0")[i].as_py() + at % wide, b.column("y0")[i].as_py() + at // wide)
                r = v[at] - value
                rows.append(np.concatenate([(j.T @ j).ravel(), j.T @ r, [r @ r, len(at)]]))
            own = [b.column(c) for c in by]
            yield pa.RecordBatch.from_arrays([*own, pa.array(rows, pa.list_(pa.float64()))], names=schema.names)

    both = blocks.join(state.where("NOT done").select(*by, "trial"), by).select(*by, "y0", "x0", "width", "data", "trial")
    each = both.mapInArrow(run, schema).select(*by, F.posexplode("s").alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").alias("v"))
    listed = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s"))  # as many as there are sums
    return listed.select(*by, F.col("s.v").alias("sums"))


def _step(rows: DataFrame, tolerance: float) -> DataFrame:
    """The next state of groups with their sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                n, sums = len(r.trial), np.asarray(r.sums)
                cost, pixels, done, damp = sums[-2], int(sums[-1]), False, r.damp
                now = dict(params=r.params, cost=r.cost, normal=r.normal, pixels=pixels)
                fell = r.cost - cost
                if np.isfinite(cost) and fell >= 0:  # the first cost is infinite
                    now |= dict(params=r.trial, cost=cost, normal=sums[:-2])
                    done, damp = bool(np.isfinite(r.cost) and fell <= tolerance * cost), max(damp / 10, 1e-12)
                else:
                    damp *= 10
                a, g = np.asarray(now["normal"])[: n * n].reshape(n, n), np.asarray(now["normal"])[n * n :]
                trial = np.asarray(now["params"]) + np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-300)), g, rcond=None)[0]
                done = done or damp > 1e12 or pixels < n
                out.append([list(now["params"]), list(trial), float(now["cost"]), list(now["normal"]), damp, pixels, done, r.rounds + 1])
            names = ["params", "trial", "cost", "normal", "damp", "pixels", "done", "rounds"]
            yield pd.concat([b.drop(columns=[*names, "sums"]), pd.DataFrame(out, columns=names, index=b.index)], axis=1)[columns]

    columns = [c for c in rows.columns if c != "sums"]
    return rows.mapInPandas(run, T.StructType([rows.schema[c] for c in columns]))


def fit(blocks: DataFrame, start: DataFrame, by: list[str], tolerance: float = 1e-9, most_rounds: int = 60) -> DataFrame:
    """by, component (from 0), the six PARTS, background, rms, pixels, rounds, converged: a row a component of each group.

    blocks: by and blocks.BLOCK; start: by, components (array of struct of PARTS: first guesses) and background. Pixels that
    aren't finite take no part. A group ends when a round lowers its cost by no more than tolerance of it; converged is
    false where `most_rounds` came first, or there are fewer pixels than parameters. Groups of start without blocks, and
    null keys, have no rows. sigma_x is the larger one, angle lies in (-90, 90] degrees.
    """
    spark = blocks.sparkSession
    first = F.concat(F.flatten(F.transform("components", lambda c: F.array(*[c[p].cast("double") for p in PARTS]))), F.array(F.col("background").cast("double")))
    empty = F.array().cast("array<double>")
    state = start.select(*by, first.alias("params"), first.alias("trial"), F.lit(float("inf")).alias("cost"), empty.alias("normal"), F.lit(1e-3).alias("damp"), F.lit(0).cast("long").alias("pixels"), F.lit(False).alias("done"), F.lit(0).alias("rounds"))
    root = scratch(spark, "fit")

    def kept(df: DataFrame) -> DataFrame:
        path = f"{root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    state = kept(state)
    ended = []
    for _ in range(most_rounds):
        state = kept(_step(state.where("NOT done").join(_shares(blocks, state, by), by), tolerance))
        ended.append(state.where("done"))
        if state.where("NOT done").isEmpty():
            break
    out = state.where("NOT done")
    for df in ended:
        out = out.unionByName(df)
    n = len(PARTS)
    each = out.withColumn("component", F.explode(F.sequence(F.lit(0), ((F.size("params") - 1) / n - 1).cast("int"))))
    part = {p: F.get("params", F.col("component") * n + i) for i, p in enumerate(PARTS)}
    sx, sy = F.abs(part["sigma_x"]), F.abs(part["sigma_y"])
    turn = F.degrees(part["angle"]) + F.when(sx >= sy, 0.0).otherwise(90.0)
    angle = -(F.pmod(90.0 - turn, F.lit(180.0)) - 90.0)
    good = F.col("done") & (F.col("pixels") >= F.size("params")) & (F.col("damp") <= 1e12)
    return each.select(
        *by, "component", part["amplitude"].alias("amplitude"), part["x"].alias("x"), part["y"].alias("y"), F.greatest(sx, sy).alias("sigma_x"), F.least(sx, sy).alias("sigma_y"),
        angle.alias("angle"), F.element_at("params", -1).alias("background"), F.sqrt(F.col("cost") / F.col("pixels")).alias("rms"), "pixels", "rounds", good.alias("converged"),
    )
