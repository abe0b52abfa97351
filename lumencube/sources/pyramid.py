"""A stored pyramid: levels of block means that are kept up to date from changed blocks alone.

Level k has a cell for 2^k x 2^k pixels, as the sum and the number of its finite values, so that means of coarser cells are
exact, and the number of its pixels, so that cells without any are told from those without values. A row is a square of `size` x `size` cells of a plane, with its place (by, bx) and that place's number in Z-order; four
squares of a level make one of the next. A version holds the squares that it changes, in folders by level and zone (a run
of 64 numbers in Z-order), which a read prunes; the newest version of a square counts. A version is there once its mark is
written, which is last, so that a job that fails leaves nothing that is read.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import locate, read_file, write_file

ZONE_BITS = 6  # of the Z-order number, inside a zone
SQUARE = [("by", "int"), ("bx", "int"), ("sums", "array<double>"), ("counts", "array<int>"), ("cells", "array<int>")]


def z_order(by: Column, bx: Column, bits: int = 20) -> Column:
    """The bits of both numbers in turn, so that near places have near numbers."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        bit = lambda c, i=i: F.shiftright(c, i).bitwiseAND(F.lit(1)).cast("long")
        out = out.bitwiseOR(F.shiftleft(bit(bx), 2 * i)).bitwiseOR(F.shiftleft(bit(by), 2 * i + 1))
    return out


def _schema(planes: list[T.StructField]) -> T.StructType:
    kinds = {"int": T.IntegerType(), "array<double>": T.ArrayType(T.DoubleType()), "array<int>": T.ArrayType(T.IntegerType())}
    return T.StructType([*planes, *(T.StructField(n, kinds[k]) for n, k in SQUARE)])


def squares(blocks: DataFrame, planes: list[str], size: int) -> DataFrame:
    """Level 0 of blocks (planes and blocks.BLOCK of `size`): a square a block."""
    fields = [blocks.schema[p] for p in planes]

    def run(batches):
        for b in batches:
            sums, counts, cells = [], [], []
            for data, wide in zip(b.column("data"), b.column("width").to_pylist(), strict=True):
                v = data.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wide)
                s, n, c = np.zeros((size, size)), np.zeros((size, size), np.int32), np.zeros((size, size), np.int32)
                ok, at = np.isfinite(v), (slice(0, v.shape[0]), slice(0, wide))
                s[at], n[at], c[at] = np.where(ok, v, 0.0), ok, data.values.is_valid().to_numpy(zero_copy_only=False).reshape(v.shape)
                sums.append(s.ravel())
                counts.append(n.ravel())
                cells.append(c.ravel())
            own = [b.column(c) for c in (*planes, "by", "bx")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sums, pa.list_(pa.float64())), *(pa.array(c, pa.list_(pa.int32())) for c in (counts, cells))], names=[*planes, *(n for n, _ in SQUARE)])

    return blocks.select(*planes, "by", "bx", "width", "data").mapInArrow(run, _schema(fields))


def parents(children: DataFrame, planes: list[str], size: int) -> DataFrame:
    """The squares above: of each, its up to four children meet in one task."""
    fields, half = [children.schema[p] for p in planes], size // 2

    def one(key: tuple, t: pa.Table) -> pa.Table:
        sums, counts, cells = np.zeros((size, size)), np.zeros((size, size), np.int32), np.zeros((size, size), np.int32)
        for by, bx, *found in zip(t["by"].to_pylist(), t["bx"].to_pylist(), t["sums"], t["counts"], t["cells"], strict=True):
            at = (slice(by % 2 * half, by % 2 * half + half), slice(bx % 2 * half, bx % 2 * half + half))
            for out, values in zip((sums, counts, cells), found, strict=True):
                out[at] = values.values.to_numpy().reshape(half, 2, half, 2).sum((1, 3))
        head = {p: pa.array([k.as_py()], t.schema.field(p).type) for p, k in zip(planes, key, strict=False)}
        place = {n: pa.array([k.as_py()], pa.int32()) for n, k in zip(("by", "bx"), key[-2:], strict=True)}
        return pa.table({**head, **place, "sums": pa.array([sums.ravel()], pa.list_(pa.float64())), **{n: pa.array([a.ravel()], pa.list_(pa.int32())) for n, a in (("counts", counts), ("cells", cells))}})

    up = lambda c: F.shiftright(c, 1).cast("int")
    keys = [*(F.col(p) for p in planes), up("by").alias("by_up"), up("bx").alias("bx_up")]
    return children.groupBy(*keys).applyInArrow(one, _schema(fields))


def versions(path: str) -> list[int]:
    """The versions that are marked, in order."""
    fs, inside = locate(f"{path}/_marks")
    if fs.get_file_info(inside).type != pafs.FileType.Directory:
        return []
    return sorted(int(i.base_name) for i in fs.get_file_info(pafs.FileSelector(inside)) if i.base_name.isdigit())


def _store(df: DataFrame, path: str, version: int, level: int) -> None:
    df = df.withColumn("z", z_order(F.col("by"), F.col("bx"))).withColumn("zone", F.shiftright("z", ZONE_BITS))
    df.repartition("zone").sortWithinPartitions("z").write.partitionBy("zone").parquet(f"{path}/version={version}/level={level}")


def _stored(spark: SparkSession, path: str, version: int, level: int, schema: T.StructType) -> DataFrame:
    schema = T.StructType([*schema.fields, T.StructField("z", T.LongType()), T.StructField("zone", T.LongType())])
    return spark.read.schema(schema).parquet(f"{path}/version={version}/level={level}")


def _level(spark: SparkSession, path: str, version: int, level: int) -> DataFrame | None:
    fs, inside = locate(f"{path}/version={version}/level={level}")
    if fs.get_file_info(inside).type != pafs.FileType.Directory:
        return None
    schema = T.StructType.fromJson(_about(path)["schema"])
    return _stored(spark, path, version, level, schema).withColumn("version", F.lit(version))


def level(spark: SparkSession, path: str, k: int, planes: list[str], near: Column | None = None) -> DataFrame:
    """The squares of a level as the newest version of each has them; near: a condition on zone and z, applied to every scan."""
    found = [df for v in versions(path) if (df := _level(spark, path, v, k)) is not None]
    found = [df.where(near) if near is not None else df for df in found]
    out, key = found[0], [*planes, "by", "bx"]
    if len(found) == 1:
        return out.drop("version")
    for df in found[1:]:
        out = out.unionByName(df)
    later = found[1]
    for df in found[2:]:
        later = later.unionByName(df)
    # Only what later versions changed is compared: keys alone, no sums.
    newest = later.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.max("version").alias("_newest"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    kept = out.join(newest, on, "left").where("_newest IS NULL OR version = _newest")
    return kept.drop("version", "_newest", *[f"_{c}" for c in key])


def _about(path: str) -> dict:
    """levels, height, width and the schema of squares, as version 0 has them."""
    return json.loads(read_file(f"{path}/_marks/0"))


def write(spark: SparkSession, blocks: DataFrame, path: str, planes: list[str], size: int = 256) -> int:
    """Writes version 0 of all blocks, level by level until a plane is one square; returns how many levels."""
    df, k = squares(blocks, planes, size), 0
    while True:
        _store(df, path, 0, k)
        stored = _stored(spark, path, 0, k, df.schema)
        top = stored.agg(F.greatest(F.max("by"), F.max("bx"))).first()[0]
        k += 1
        if not top:  # one square a plane, or none at all
            height, width = blocks.agg(F.max(F.col("y0") + F.col("height")), F.max(F.col("x0") + F.col("width"))).first()
            write_file(f"{path}/_marks/0", json.dumps({"levels": k, "height": height or 0, "width": width or 0, "schema": df.schema.jsonValue()}).encode())
            return k
        df = parents(stored, planes, size)


def update(spark: SparkSession, changed: DataFrame, path: str, planes: list[str], size: int = 256) -> int:
    """Writes the next version: the changed blocks (planes and BLOCK, all of a block's pixels) and their ancestors alone.

    Without any there is no new version. Blocks lie inside the area of version 0. Of a level, the squares beside the changed ones are read by the zones and
    Z-order numbers that their parents span.
    """
    version = versions(path)[-1] + 1
    if changed.isEmpty():
        return version - 1
    _store(squares(changed, planes, size), path, version, 0)
    for k in range(1, _about(path)["levels"]):
        new = _stored(spark, path, version, k - 1, T.StructType.fromJson(_about(path)["schema"]))
        lo, hi = new.agg(F.min(F.shiftright("z", 2)), F.max(F.shiftright("z", 2))).first()
        lo, hi = 4 * lo, 4 * hi + 3  # children of the parents
        near = F.col("zone").between(lo >> ZONE_BITS, hi >> ZONE_BITS) & F.col("z").between(lo, hi)
        key = [*planes, "by", "bx"]
        up = new.select(*[F.col(p).alias(f"_{p}") for p in planes], F.shiftright("by", 1).alias("_y"), F.shiftright("bx", 1).alias("_x")).distinct()
        on = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in planes] + [F.shiftright("by", 1) == F.col("_y"), F.shiftright("bx", 1) == F.col("_x")]
        beside = level(spark, path, k - 1, planes, near).join(up, on, "left_semi")
        own = new.select(*[F.col(c).alias(f"_{c}") for c in key])
        beside = beside.join(own, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left_anti")
        children = new.select(*key, "sums", "counts", "cells").unionByName(beside.select(*key, "sums", "counts", "cells"))
        _store(parents(children, planes, size), path, version, k)
    write_file(f"{path}/_marks/{version}", b"{}")
    return version


def means(spark: SparkSession, path: str, planes: list[str], factor: int, box: tuple[int, int, int, int] | None = None, size: int = 256) -> DataFrame:
    """planes, y, x, v: means over factor x factor pixels, from the coarsest stored level whose cells they are made of.

    box: x0, y0, x1, y1 of pixels, half-open; only squares that meet it are read. Cells without finite values give NULL, those without pixels no row.
    """
    k, about = 0, _about(path)
    while k + 1 < about["levels"] and factor % (1 << (k + 1)) == 0:
        k += 1
    near, rest, span = None, factor >> k, size << k
    if box:
        x0, y0, x1, y1 = box
        near = F.col("bx").between(x0 // span, (x1 - 1) // span) & F.col("by").between(y0 // span, (y1 - 1) // span)
        places = [z for z in (_z(y0 // span, x0 // span), _z((y1 - 1) // span, (x1 - 1) // span))]  # the box's least and greatest number
        near = F.col("zone").between(places[0] >> ZONE_BITS, places[1] >> ZONE_BITS) & F.col("z").between(*places) & near
    df = level(spark, path, k, planes, near).select(*planes, "by", "bx", F.posexplode(F.arrays_zip("sums", "counts", "cells")).alias("at", "c"))
    y, x = F.col("by") * size + F.floor(F.col("at") / size), F.col("bx") * size + F.col("at") % size
    df = df.select(*planes, y.cast("int").alias("y"), x.cast("int").alias("x"), F.col("c.sums").alias("s"), F.col("c.counts").alias("n")).where("c.cells > 0")
    if box:
        inside = lambda c, a, z: (F.col(c) >= a // (1 << k)) & (F.col(c) < -(-z // (1 << k)))
        df = df.where(inside("x", x0, x1) & inside("y", y0, y1))
    if rest > 1:
        key = [*planes, F.floor(F.col("y") / rest).cast("int").alias("y"), F.floor(F.col("x") / rest).cast("int").alias("x")]
        df = df.groupBy(*key).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return df.select(*planes, "y", "x", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("v"))


def _z(by: int, bx: int) -> int:
    return sum(((bx >> i & 1) << 2 * i) | ((by >> i & 1) << 2 * i + 1) for i in range(20))
