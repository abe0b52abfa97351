"""Histograms in two levels: a sketch a block, made in one scan, from which any plane's, cube's or part's histogram follows.

A sketch counts finite values by floor(v / 2^e), where e is the smallest exponent for which its range takes at most `most`
numbers. Sketches merge exactly: with a larger exponent the numbers are shifted right, so a group's counts are those of
floor(v / 2^E) for the group's own E, however its blocks were cut and in whatever order they merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_EXPONENT = -1022  # of a double that is no subnormal


def sketches(blocks: DataFrame, keys: list[str], most: int = 1024) -> DataFrame:
    """keys, pixels, n, lo, hi, exponent, first, counts: a row a block of blocks (keys and blocks.BLOCK).

    counts[i]: how many finite values v have floor(v / 2^exponent) = first + i. A block without any has nulls.
    """
    kinds = [("pixels", T.LongType()), ("n", T.LongType()), ("lo", T.DoubleType()), ("hi", T.DoubleType()), ("exponent", T.IntegerType()), ("first", T.LongType()), ("counts", T.ArrayType(T.LongType()))]
    schema = T.StructType([*(blocks.schema[k] for k in keys), *(T.StructField(n, k) for n, k in kinds)])

    def one(v: np.ndarray) -> tuple:
        ok = v[np.isfinite(v)]
        if not len(ok):
            return len(v), 0, None, None, None, None, None
        lo, hi = float(ok.min()), float(ok.max())
        e = exponent_of(lo, hi, most)
        k = np.floor(np.ldexp(ok, -e)).astype(np.int64)
        return len(v), len(ok), lo, hi, e, int(k.min()), np.bincount(k - k.min())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            rows = [one(d.values.to_numpy(zero_copy_only=False).astype(np.float64)) for d in b.column("data")]
            columns = [pa.array(c, to_arrow_type(k)) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], to_arrow_type(k)) for _, k in kinds]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *columns], names=schema.names)

    return blocks.select(*keys, "data").mapInArrow(run, schema)


def exponent_of(lo: float, hi: float, most: int) -> int:
    """The smallest e for which floor(hi / 2^e) - floor(lo / 2^e) < most (and both are numbers of at most 53 bits)."""
    top = max(abs(lo), abs(hi))
    e = max(LEAST_EXPONENT, int(np.floor(np.log2(top))) - 52 if top else LEAST_EXPONENT)
    if hi > lo:
        e = max(e, int(np.floor(np.log2(hi - lo) - np.log2(most))) - 1)
    while np.floor(np.ldexp(hi, -e)) - np.floor(np.ldexp(lo, -e)) >= most or np.abs(np.ldexp(top, -e)) >= 2.0**53:
        e += 1
    return e


def merged(made: DataFrame, by: list[str], most: int = 1024) -> DataFrame:
    """by, pixels, n, lo, hi, exponent, number, count of groups of sketches: a row a number floor(v / 2^exponent) that occurs.

    made: sketches, stored, as they are read twice (the pixels aren't). Counts meet by group and number, with partial sums.
    """
    if not by:
        return merged(made.withColumn("_all", F.lit(0)), ["_all"], most).drop("_all")
    edge = made.groupBy(*by).agg(F.sum("pixels").alias("pixels"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("exponent").alias("least"))
    number = lambda v, e: F.floor(v * F.pow(F.lit(2.0), -e))
    # A group's range fits at its widest block's exponent, or at one that its own width tells up to three: the first that does.
    wide = F.col("hi") - F.col("lo")
    guess = F.greatest(F.col("least"), F.when(wide > 0, F.floor(F.log2(wide) - F.log2(F.lit(float(most)))).cast("int") - 1).otherwise(F.col("least")))
    fits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: guess + k), lambda e: number(F.col("hi"), e) - number(F.col("lo"), e) < most)
    edge = edge.withColumn("exponent", F.get(fits, F.lit(0))).select(*[F.col(c).alias(f"_{c}") for c in by], "pixels", F.col("n").alias("all"), "lo", "hi", "exponent")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    own = made.where("n > 0").select(*by, F.col("exponent").alias("e"), "first", F.posexplode("counts").alias("i", "c")).where("c > 0")
    own = own.join(edge.select(*[f"_{c}" for c in by], "exponent"), on)
    shifted = F.floor((F.col("first") + F.col("i")) * F.pow(F.lit(2.0), F.col("e") - F.col("exponent")))
    counts = own.groupBy(*by, shifted.alias("number")).agg(F.sum("c").alias("count"))
    return counts.join(edge, on).select(*by, "pixels", F.col("all").alias("n"), "lo", "hi", "exponent", "number", "count")


def histogram(counts: DataFrame, by: list[str], bins: Column | int | None = None) -> DataFrame:
    """by, bin, n, least, most, lo, hi, bins: about how many values each bin has, and bounds of the exact number.

    Bins as those of planes.histogram(): by default sqrt(pixels), at least 2, from the smallest to the largest value. A
    number's values are dealt to the bins that its interval meets in proportion, rounded nowhere. least counts the
    intervals that lie wholly in a bin, most those that meet it: the error is at most most - least, the counts of the two
    intervals at the bin's ends.
    """
    width = F.pow(F.lit(2.0), F.col("exponent"))
    many = F.greatest(F.lit(2), F.floor(F.sqrt("pixels"))).cast("int") if bins is None else F.lit(bins) if isinstance(bins, int) else bins
    df = counts.withColumns({"bins": many, "a": F.greatest(F.col("lo"), F.col("number") * width), "z": F.least(F.col("hi"), (F.col("number") + 1) * width)})
    step = (F.col("hi") - F.col("lo")) / F.col("bins")
    at = lambda v: F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.greatest(F.lit(0), F.least(F.col("bins") - 1, F.floor((v - F.col("lo")) / F.nullif(step, F.lit(0.0)))))).cast("int")
    # The upper end belongs to the next interval, but for the largest value's.
    last = F.when(F.col("z") >= F.col("hi"), at(F.col("hi"))).otherwise(F.greatest(at(F.col("a")), F.ceil((F.col("z") - F.col("lo")) / F.nullif(step, F.lit(0.0))).cast("int") - 1))
    df = df.withColumns({"from": at(F.col("a")), "to": F.least(F.col("bins") - 1, last)}).withColumn("bin", F.explode(F.sequence("from", F.greatest("from", "to"))))
    left, right = F.col("lo") + F.col("bin") * step, F.col("lo") + (F.col("bin") + 1) * step
    part = F.when(F.col("to") <= F.col("from"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least("z", right) - F.greatest("a", left)) / (F.col("z") - F.col("a")))
    whole = F.col("to") <= F.col("from")
    out = df.groupBy(*by, "bin").agg(
        F.sum(F.col("count") * part).alias("n"), F.sum(F.when(whole, F.col("count")).otherwise(0)).alias("least"), F.sum("count").alias("most"),
        F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("bins").alias("bins"),
    )
    return out.select(*by, "bin", "n", F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"), "lo", "hi", "bins")
