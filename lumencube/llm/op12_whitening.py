"""Whitening of embeddings by shifted CholeskyQR.

Rows are made integer and centred exactly. A pass sums, in tasks, the Gram matrix of the rows divided by all triangular
factors found so far (a triangular solve a factor); its Cholesky factor is the next factor. The first Gram matrix is
shifted by a multiple of the rounding error, so that its Cholesky factor exists for any condition number; the passes after
it repair what the shift did. When the Gram matrix is a projection (its eigenvalues are 1, or 0 for directions without
variance), the product of the factors is the R of a QR decomposition of the centred rows, and the singular value
decomposition of that small matrix gives the eigenvectors and eigenvalues of the covariance, whose own condition number
never enters. The driver holds matrices of dimension x dimension alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SCALE = 64  # the 1000000 that is added to each integer entry cancels in all that is made of them
CLOSE = 1e-10  # of a Gram matrix to a projection
MOST_PASSES = 12
ROWS = 4096  # that a solve takes at a time


def integer_rows(batch: pa.RecordBatch, dim: int | None = None) -> tuple[pa.Array, np.ndarray]:
    """The ids, and floor(64 c) of each entry, of the rows whose vector is there with finite entries alone; shorter vectors end in zeros."""
    lists = batch.column("embedding")
    flat = lists.values
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    at = lists.offsets.to_numpy().astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    keep = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]]))
    width = (at[1:] - at[:-1])[keep]
    dim = int(width.max(initial=0)) if dim is None else dim
    c = np.zeros((len(keep), dim))
    if len(keep) and dim:
        inside = np.arange(dim) < width[:, None]
        c[inside] = values[(at[keep][:, None] + np.arange(dim))[inside]]
    scaled = np.floor(c * SCALE)
    if np.abs(scaled).max(initial=0) >= 2.0**53:
        raise ArithmeticError("an entry of 2^47 or more has no exact integer form")
    return batch.column("vec_id").take(pa.array(keep)), scaled.astype(np.int64)


class Moments:
    """Of the integer rows: how many (n), their dimension, exact sums and ranges."""

    def __init__(self, rows: DataFrame):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, x = integer_rows(b)
                if len(x):
                    sums = x.sum(0) if np.abs(x).max(initial=0) < 2**40 else x.astype(object).sum(0)
                    d = x.shape[1]
                    columns = [pa.array([len(x)] * (d + 1)), pa.array(range(-1, d), pa.int32()), pa.array([Decimal(0), *map(Decimal, map(int, sums))], pa.decimal128(38, 0))]
                    columns += [pa.array([0, *f(x, 0).tolist()], pa.int64()) for f in (np.min, np.max)]
                    yield pa.RecordBatch.from_arrays(columns, names=["n", "i", "s", "lo", "hi"])

        found = rows.mapInArrow(run, "n long, i int, s decimal(38,0), lo long, hi long").groupBy("i")
        # A row a dimension, and one (-1) that counts all rows: shorter vectors count as 0 in the dimensions they lack.
        got = {r["i"]: r for r in found.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
        self.n = int(got[-1]["n"]) if got else 0
        self.dim = max(len(got) - 1, 0)
        self.sums = [int(got[i]["s"]) for i in range(self.dim)]
        self.low = [min(got[i]["lo"], 0) if got[i]["n"] < self.n else got[i]["lo"] for i in range(self.dim)]
        self.high = [max(got[i]["hi"], 0) if got[i]["n"] < self.n else got[i]["hi"] for i in range(self.dim)]
        far = [max(self.n * h - s, s - self.n * lo) for h, lo, s in zip(self.high, self.low, self.sums, strict=True)]
        self.short = max([self.n * max(map(abs, [0, *self.low, *self.high])), *far], default=0) < 2**63
        self.short_squares = self.short and sum(v * v for v in far) < 2**63

    def away(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: 64-bit integers where they suffice, else Python's."""
        kind = np.int64 if self.short else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def squares(self, x: np.ndarray) -> pa.Array:
        """Sum over the dimensions of (n x - S)^2, exact."""
        d = self.away(x)
        if self.short_squares:
            return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
        d = d.astype(object)
        return pa.array([Decimal(int(v)) for v in (d * d).sum(1)], pa.decimal128(38, 0))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.away(x) / self.n).astype(np.float64)


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows q with q r = a, for an upper triangular r: forward substitution, a column of all rows at a time."""
    q = np.empty_like(a)
    for j in range(len(r)):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def gram(rows: DataFrame, dim: int, of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """Sum over all rows of q'q, where of(batch) gives the rows q in blocks: a matrix a task, summed by Spark entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            for q in of(b):
                total += q.T @ q
        upper = pa.array([total[i, i:] for i in range(dim)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), upper], names=["i", "v"])

    entries = rows.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("k", "v"))
    out = np.zeros((dim, dim))
    for r in entries.groupBy("i", "k").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["i"] + r["k"]] = out[r["i"] + r["k"], r["i"]] = r["v"]
    return out


def factor(g: np.ndarray, n: int, first: bool) -> np.ndarray:
    """An upper triangular r with r'r = g; g is shifted in the first pass, and where it is singular to rounding."""
    d, unit, values = len(g), np.finfo(np.float64).eps / 2, np.linalg.eigvalsh(g)
    shift = 11 * (n * d + d * (d + 1)) * unit * values[-1]
    if not first and values[0] > shift:
        return np.linalg.cholesky(g).T
    while True:  # a Gram matrix of summed rounding errors may need more
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


class Whitening:
    """Fitted to all rows of (vec_id, embedding): components (columns, unit length), eigenvalues of the covariance, rank, trace."""

    def __init__(self, rows: DataFrame):
        self.moments = m = Moments(rows)
        self.components, self.values, self.rank, self.passes = np.zeros((m.dim, 0)), np.zeros(0), 0, 0
        self.trace, self.factors = 0.0, []
        if not m.n or not m.dim or m.low == m.high:  # no variance at all
            self.components, self.values = np.eye(m.dim), np.zeros(m.dim)
            return
        while True:
            g = gram(rows, m.dim, self.orthogonalised)
            self.passes += 1
            self.trace = self.trace or float(np.trace(g)) / m.n
            if self.passes > 1 and np.abs(g @ g - g).max() <= CLOSE:
                break
            if self.passes == MOST_PASSES:
                raise ArithmeticError(f"rows aren't orthogonal after {self.passes} passes")
            self.factors.append(factor(g, m.n, first=self.passes == 1))
        self.rank = int(round(float(np.trace(g))))
        if self.rank == m.dim:
            r = np.linalg.cholesky(g).T
        else:  # without the directions that have no variance
            share, at = np.linalg.eigh(g)
            r = (np.sqrt(share[-self.rank :])[:, None] * at[:, -self.rank :].T) if self.rank else np.zeros((1, m.dim))
        for f in reversed(self.factors):
            r = r @ f
        _, sigma, vt = np.linalg.svd(r)
        self.components, self.values = vt.T, np.zeros(m.dim)
        self.values[: self.rank] = sigma[: self.rank] ** 2 / m.n

    def orthogonalised(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        _, x = integer_rows(batch, self.moments.dim)
        for k in range(0, len(x), ROWS):
            q = self.moments.centred(x[k : k + ROWS])
            for r in self.factors:
                q = solved(q, r)
            yield q

    def whitened(self, x: np.ndarray, most: int) -> np.ndarray:
        """Centred rows projected on the first components that have variance, each over its standard deviation."""
        k = min(most, self.rank)
        return self.moments.centred(x) @ self.components[:, :k] / np.sqrt(self.values[:k])


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """A row for each vector of (vec_id, embedding) and each of its first `most` components: vec_id, component (from 1),
    n, deviation (decimal(38,0)), whitened, explained, identity_error.

    Rows whose vector is null, or holds null or non-finite entries, take no part. Shorter vectors count as padded with
    zeros, empty ones as zeros. Repeated rows count each; a null vec_id stays null. Components without variance (fewer
    different rows than dimensions, or constant and dependent dimensions) have rows with whitened null and explained 0, and
    are left out of identity_error. Components of equal eigenvalues are any basis of their space. Other columns aren't read.
    Vectors without a dimension, and an empty table, give no rows. Entries of 2^47 or more raise ArithmeticError. The table
    is read once for the sums, once a pass (three to five) and twice at the end, so it should be a table, not a long plan.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = Whitening(rows)
    m, width = fit.moments, min(most, fit.moments.dim)
    known = min(most, fit.rank)

    def of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        _, x = integer_rows(batch, m.dim)
        for k in range(0, len(x), ROWS):
            yield fit.whitened(x[k : k + ROWS], most)

    # Whitened rows have mean zero but for rounding, as they are projections of centred ones.
    error = float(np.abs(gram(rows, known, of) / m.n - np.eye(known)).max()) if known else 0.0
    explained = (fit.values[:width] / fit.trace).tolist() if fit.trace else [0.0] * width

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = integer_rows(b, m.dim)
            for k in range(0, len(x), ROWS):
                some = x[k : k + ROWS]
                w = np.full((len(some), width), np.nan)
                w[:, :known] = fit.whitened(some, most)
                w = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * width, pa.int32()), pa.array(w.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([ids.slice(k, ROWS), m.squares(some), w], names=["vec_id", "deviation", "w"])

    out = rows.mapInArrow(project, "vec_id long, deviation decimal(38,0), w array<double>")
    out = out.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    share = F.element_at(F.array(*[F.lit(e) for e in explained]) if explained else F.array(F.lit(0.0)), F.col("component"))
    out = out.withColumn("component", (F.col("k") + 1).cast("int"))
    return out.select("vec_id", "component", F.lit(m.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whiten(), with deviation as a long: where it doesn't fit one (some 10^7 rows on), the cast raises an error."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
