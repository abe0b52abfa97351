"""FITS images as tables: pixels() and cards(), also as the formats "fits" and "fits_header"; write_planes is the sink.

Pixels: file, time, stokes, channel, y, x, v (double; BSCALE and BZERO applied, BLANK is NaN). pixels() reads all headers
in tasks into an index, a row an image; bands of rows are made from it by expressions and dealt to tasks by their bytes, so
small files share a task and one larger than memory is read by many. Ranges of time, stokes, channel and y choose the bands,
so a plane or a slab of a large cube costs its own bytes alone. The formats plan on the driver instead: for a few files.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from .store import list_files, locate, scratch, write_file

BLOCK, CARD = 2880, 80
# The format's sample types (big-endian) and the start of an axis's type.
SAMPLES = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
ROLES = {"FREQ": "channel", "VRAD": "channel", "VELO": "channel", "VOPT": "channel", "WAVE": "channel", "STOKES": "stokes", "TIME": "time"}
PIXELS = "file string, time int, stokes int, channel int, y int, x int, v double"
CARDS = "file string, hdu int, card int, key string, value string, type string, comment string"
ROW_AXES = ("time", "stokes", "channel", "y")


def parse_card(text: str) -> tuple[str, str | None, str | None, str | None]:
    """key, value, type (BOOL, INT, FLOAT, STRING; none without a value) and comment of an 80-character card."""
    key, rest = text[:8].strip(), text[10:]
    if text[8:10] != "= ":
        return key, None, None, text[8:].strip() or None
    body = rest.lstrip()
    if body.startswith("'"):
        at = 1
        while at < len(body) and not (body[at] == "'" and body[at + 1 : at + 2] != "'"):
            at += 2 if body[at] == "'" else 1
        value, kind, rest = body[1:at].replace("''", "'").rstrip(), "STRING", body[at + 1 :].partition("/")[2]
    else:
        value, _, rest = (s.strip() for s in body.partition("/"))
        kind = "BOOL" if value in ("T", "F") else "INT" if value.lstrip("+-").isdigit() else "FLOAT" if value else None
        value = value.replace("D", "E") if kind == "FLOAT" else value or None
    return key, value, kind, rest.strip() or None


def headers(f) -> Iterator[tuple[list[tuple], dict[str, str], int]]:
    """cards, values by key, and where the data starts, of each HDU; data is passed over, not read."""
    at, size = 0, f.size()
    while at + BLOCK <= size:
        cards, values, more = [], {}, True
        while more and at + BLOCK <= size:
            f.seek(at)
            text, at = f.read(BLOCK).decode("latin-1"), at + BLOCK
            for i in range(0, BLOCK, CARD):
                card = parse_card(text[i : i + CARD])
                if card[0] == "END":
                    more = False
                    break
                if card[0]:
                    cards.append(card)
                    if card[1] is not None:
                        values.setdefault(card[0], card[1])
        if "BITPIX" not in values:
            return
        yield cards, values, at
        at += -(-data_bytes(values) // BLOCK) * BLOCK


def shape(values: dict[str, str]) -> list[int]:
    return [int(values[f"NAXIS{i + 1}"]) for i in range(int(values.get("NAXIS", 0)))]


def data_bytes(values: dict[str, str]) -> int:
    n = shape(values)
    count = int(np.prod(n, dtype=np.int64)) if n else 0
    return abs(int(values["BITPIX"])) // 8 * int(values.get("GCOUNT", 1)) * (int(values.get("PCOUNT", 0)) + count)


def images(path: str) -> list[tuple[int, dict[str, str], int]]:
    """hdu, header values and start of the data of a file's images; tables and empty units are left out."""
    fs, inside = locate(path)
    with fs.open_input_file(inside) as f:
        return [(k, v, at) for k, (_, v, at) in enumerate(headers(f)) if data_bytes(v) and v.get("XTENSION") not in ("BINTABLE", "TABLE")]


def first_image(path: str) -> tuple[dict[str, str], int] | None:
    """Header values and start of the data of a file's first image."""
    return next(((v, at) for _, v, at in images(path)), None)


def axes_of(path: str, values: dict[str, str]) -> tuple[int, int, list[tuple[str | None, int]], dict[str, int]]:
    """Width, height, (role, size) of the further axes, and the first place of each role. An axis without a known type takes a
    role that is left; with more axes than time, stokes and channel there is no such cube."""
    n = shape(values) + [1] * max(0, 2 - int(values["NAXIS"]))
    roles = [next((r for k, r in ROLES.items() if values.get(f"CTYPE{i + 3}", "").upper().startswith(k)), None) for i in range(len(n) - 2)]
    spare = [r for r in ("channel", "stokes", "time") if r not in roles]
    roles = [r or (spare.pop(0) if spare and size > 1 else None) for r, size in zip(roles, n[2:], strict=True)]
    if any(r is None and size > 1 for r, size in zip(roles, n[2:], strict=True)) or len({r for r in roles if r}) < sum(r is not None for r in roles):
        raise ValueError(f"{path}: more axes than time, stokes and channel")
    return n[0], n[1], list(zip(roles, n[2:], strict=True)), {r: int(values.get(f"FIRST{r[:3].upper()}", 0)) for r in ("channel", "stokes", "time")}


def samples(raw: np.ndarray, bitpix: int, bscale: float | None, bzero: float | None, blank: float | None) -> np.ndarray:
    v = raw.astype("f8")
    if blank is not None and bitpix > 0:
        v[raw == int(blank)] = np.nan
    return v * (1.0 if bscale is None else bscale) + (bzero or 0.0)


class _Reader(D.DataSourceReader):
    """What both sources share: the files of the path."""

    def __init__(self, options: dict):
        self.options = options

    def files(self) -> list[str]:
        return list_files(self.options["path"], (".fits", ".fit", ".fts"))


class PixelReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.ranges: dict[str, tuple[int, int]] = {}

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """Ranges of the axes that rows follow; every filter is given back, and Spark applies it again."""
        for f in filters:
            axis, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if len(axis) == 1 and axis[0] in ROW_AXES and isinstance(value, int):
                lo, hi = self.ranges.get(axis[0], (0, 1 << 62))
                if isinstance(f, D.EqualTo | D.GreaterThanOrEqual | D.GreaterThan):
                    lo = max(lo, value + isinstance(f, D.GreaterThan))
                if isinstance(f, D.EqualTo | D.LessThanOrEqual | D.LessThan):
                    hi = min(hi, value + (not isinstance(f, D.LessThan)))
                self.ranges[axis[0]] = (lo, hi)
            yield f

    def _cut(self, axis: str, n: int) -> range:
        lo, hi = self.ranges.get(axis, (0, n))
        return range(max(0, lo), min(n, hi))

    def partitions(self) -> list[D.InputPartition]:
        """Each: a file, its sample type and scaling, its width, and runs of rows (offset, rows, time, stokes, channel, y)."""
        most, out = int(float(self.options.get("band_mb", 32)) * (1 << 20)), []
        paths = self.files()
        with ThreadPoolExecutor(32) as pool:
            images = list(pool.map(first_image, paths))
        for path, image in zip(paths, images, strict=True):
            if image is None:
                continue
            values, start = image
            try:
                width, height, further, base = axes_of(path, values)
            except ValueError:  # index() tells what it is
                continue
            sample = abs(int(values["BITPIX"])) // 8
            scale = [float(values[k]) if k in values else None for k in ("BSCALE", "BZERO", "BLANK")]
            rows, per_part, runs, held = self._cut("y", height), max(1, most // (width * sample)), [], 0
            for plane in range(math.prod(size for _, size in further)):
                at, left = dict(base), plane
                for role, size in further:
                    if role:
                        at[role] += left % size
                    left //= size
                if any(not self.ranges.get(r, (at[r], at[r] + 1))[0] <= at[r] < self.ranges.get(r, (at[r], at[r] + 1))[1] for r in at):
                    continue
                for y in range(rows.start, rows.stop, per_part):
                    k = min(per_part, rows.stop - y)
                    if held and held + k > per_part:
                        out.append(D.InputPartition((path, values["BITPIX"], scale, width, runs)))
                        runs, held = [], 0
                    runs.append((start + (plane * height + y) * width * sample, k, at["time"], at["stokes"], at["channel"], y))
                    held += k
            if runs:
                out.append(D.InputPartition((path, values["BITPIX"], scale, width, runs)))
        return out or [D.InputPartition(None)]

    def read(self, partition: D.InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, bitpix, (bscale, bzero, blank), width, runs = partition.value
        kind = np.dtype(SAMPLES[int(bitpix)])
        fs, inside = locate(path)
        with fs.open_input_file(inside) as f:
            for offset, k, time, stokes, channel, y in runs:
                some = max(1, 250_000 // width)  # rows a batch
                for r in range(0, k, some):
                    n = min(some, k - r)
                    f.seek(offset + r * width * kind.itemsize)
                    raw = np.frombuffer(f.read(n * width * kind.itemsize), kind)
                    v = samples(raw, int(bitpix), bscale, bzero, blank)
                    same = lambda value: pa.array(np.full(n * width, value, "i4"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(path), n * width), same(time), same(stokes), same(channel), pa.array(np.repeat(np.arange(y + r, y + r + n, dtype="i4"), width)),
                         pa.array(np.tile(np.arange(width, dtype="i4"), n)), pa.array(v)],
                        ["file", "time", "stokes", "channel", "y", "x", "v"],
                    )


class CardReader(_Reader):
    def partitions(self) -> list[D.InputPartition]:
        files = self.files()
        return [D.InputPartition(files[i : i + 100]) for i in range(0, len(files), 100)] or [D.InputPartition([])]

    def read(self, partition: D.InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            fs, inside = locate(path)
            with fs.open_input_file(inside) as f:
                for hdu, (cards, _, _) in enumerate(headers(f)):
                    for i, card in enumerate(cards):
                        yield (path, hdu, i, *card)


class FitsSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> PixelReader:
        return PixelReader(self.options)


class FitsHeaderSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits_header"

    def schema(self) -> str:
        return CARDS

    def reader(self, schema) -> CardReader:
        return CardReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FitsSource)
    spark.dataSource.register(FitsHeaderSource)


INDEX = "file string, hdu int, nth int, start long, width int, height int, bitpix int, bscale double, bzero double, blank double, planes long, " + ", ".join(
    f"{r}_first int, {r}_step long, {r}_size int" for r in ("time", "stokes", "channel")
) + ", problem string"


def index(spark: SparkSession, path: str) -> DataFrame:
    """A row an image of the files at a path, made by tasks that read headers alone: where its data starts, its shape and scale,
    and of each role the first place, how many planes further the next one is, and the size.

    An image that no cube can be made of, and a file whose headers can't be read, is a row with its problem, the rest being
    NULL; other files aren't touched by it.
    """
    names = [f.split()[0] for f in INDEX.split(", ")]

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file in b["file"]:
                rows, odd = [], lambda text, *at, file=file: (file, *at, *[None] * (len(names) - 2 - len(at)), text)
                try:
                    found = images(file)
                except (ValueError, KeyError, OSError) as problem:
                    rows, found = [odd(repr(problem))], []
                for nth, (hdu, values, start) in enumerate(found):
                    try:
                        width, height, further, base = axes_of(file, values)
                    except (ValueError, KeyError) as problem:
                        rows.append(odd(str(problem), hdu, nth))
                        continue
                    step, of = 1, {r: (first, 1, 1) for r, first in base.items()}
                    for role, size in further:
                        if role:
                            of[role] = (base[role], step, size)
                        step *= size
                    scale = [float(values[k]) if k in values else None for k in ("BSCALE", "BZERO", "BLANK")]
                    rows.append((file, hdu, nth, start, width, height, int(values["BITPIX"]), *scale, step, *(v for r in ("time", "stokes", "channel") for v in of[r]), None))
                whole = {n: "Int64" for n, k in (f.split() for f in INDEX.split(", ")) if k in ("int", "long")}
                yield pd.DataFrame(rows, columns=names).astype(whole | {"bscale": float, "bzero": float, "blank": float})

    files = list_files(path, (".fits", ".fit", ".fts"))
    named = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 512)))
    table = scratch(spark, "fits-index")
    named.mapInPandas(describe, INDEX).write.parquet(table)
    return spark.read.schema(INDEX).parquet(table)


def pixels(spark: SparkSession, path: str, nth: int = 0, band_mb: float = 32, **ranges: tuple[int, int]) -> DataFrame:
    """file, time, stokes, channel, y, x, v of each file's nth image, inside half-open ranges of the named axes (not x).

    Bands of at most band_mb are read; each task gets about as many bytes, of many small files or a part of a large one.
    """
    size, most = F.abs("bitpix") / 8, int(band_mb * (1 << 20))
    df = index(spark, path).where((F.col("nth") == nth) & F.col("problem").isNull()).withColumn("plane", F.explode(F.sequence(F.lit(0).cast("long"), F.col("planes") - 1)))
    for role in ("time", "stokes", "channel"):
        place = F.col(f"{role}_first") + F.floor(F.col("plane") / F.col(f"{role}_step")) % F.col(f"{role}_size")
        df = df.withColumn(role, place.cast("int"))
        if role in ranges:
            df = df.where((F.col(role) >= ranges[role][0]) & (F.col(role) < ranges[role][1]))
    lo, hi = ranges.get("y", (0, 1 << 30))
    df = df.withColumns({"y_lo": F.greatest(F.lit(0), F.lit(lo)), "y_hi": F.least("height", F.lit(hi)), "step": F.greatest(F.lit(1), F.floor(most / (F.col("width") * size)).cast("int"))})
    df = df.where("y_hi > y_lo").withColumn("y", F.explode(F.sequence("y_lo", F.col("y_hi") - 1, "step")))
    bands = df.select(
        "file", "bitpix", "bscale", "bzero", "blank", "width", "time", "stokes", "channel", "y", F.least(F.col("step"), F.col("y_hi") - F.col("y")).alias("rows"),
        (F.col("start") + (F.col("plane") * F.col("height") + F.col("y")) * F.col("width") * size).cast("long").alias("at"),
    )
    total = bands.agg(F.sum(F.col("rows") * F.col("width") * F.abs("bitpix") / 8)).first()[0] or 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                kind, width = np.dtype(SAMPLES[r["bitpix"]]), r["width"]
                fs, inside = locate(r["file"])
                with fs.open_input_file(inside) as f:
                    some = max(1, 250_000 // width)  # rows a batch
                    for k in range(0, r["rows"], some):
                        n = min(some, r["rows"] - k)
                        f.seek(r["at"] + k * width * kind.itemsize)
                        v = samples(np.frombuffer(f.read(n * width * kind.itemsize), kind), r["bitpix"], r["bscale"], r["bzero"], r["blank"])
                        first = r["y"] + k
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(pa.scalar(r["file"]), n * width), *(pa.repeat(pa.scalar(r[c], pa.int32()), n * width) for c in ("time", "stokes", "channel")),
                             pa.array(np.repeat(np.arange(first, first + n, dtype="i4"), width)), pa.array(np.tile(np.arange(width, dtype="i4"), n)), pa.array(v)],
                            ["file", "time", "stokes", "channel", "y", "x", "v"],
                        )

    return bands.repartition(max(1, -(-int(total) // most))).mapInArrow(read, PIXELS)


def cards(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("fits_header").load(path)


def _card(key: str, value: object) -> bytes:
    plain = ("F", "T")[value] if isinstance(value, bool) else repr(value)
    text = "'" + value.replace("'", "''").ljust(8) + "'" if isinstance(value, str) else plain.rjust(20)
    return f"{key:<8}= {text}".ljust(CARD).encode()


def write_planes(px: DataFrame, path: str, height: int, width: int, header: dict[str, object] | None = None) -> DataFrame:
    """Writes px (stokes, channel, y, x, v) as one file of 32-bit samples a plane; pixels that aren't there are NaN.

    Returns stokes, channel, file, bytes: one row a plane. A task holds one plane. FIRSTCHA and FIRSTSTO keep the place in
    the cube, so the folder reads back as the cube it was. The write happens when the result is first used.
    """
    extra = dict(header or {})

    def one(key: tuple, t: pa.Table) -> pa.Table:
        stokes, channel = (k.as_py() for k in key)
        plane = np.full((height, width), np.nan, ">f4")
        plane[t["y"].to_numpy(), t["x"].to_numpy()] = t["v"].cast(pa.float64()).to_numpy()
        keys = {"SIMPLE": True, "BITPIX": -32, "NAXIS": 4, "NAXIS1": width, "NAXIS2": height, "NAXIS3": 1, "NAXIS4": 1, "CTYPE3": "FREQ", "CTYPE4": "STOKES"}
        keys |= {"FIRSTCHA": channel, "FIRSTSTO": stokes} | extra
        head = b"".join(_card(k, v) for k, v in keys.items()) + b"END".ljust(CARD)
        body = plane.tobytes()
        content = head.ljust(-(-len(head) // BLOCK) * BLOCK) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")
        name = f"{path}/plane-{stokes}-{channel}.fits"
        write_file(name, content)
        return pa.table({"stokes": pa.array([stokes], pa.int32()), "channel": pa.array([channel], pa.int32()), "file": [name], "bytes": pa.array([len(content)], pa.int64())})

    px = px.selectExpr("CAST(stokes AS INT) stokes", "CAST(channel AS INT) channel", "y", "x", "v").where(f"y >= 0 AND y < {height} AND x >= 0 AND x < {width}")
    return px.groupBy("stokes", "channel").applyInArrow(one, "stokes int, channel int, file string, bytes long")
