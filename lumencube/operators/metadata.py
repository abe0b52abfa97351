"""Header-derived fields, region text, file typing, chunk plans and session state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIGHT = 299792458.0
# Polarisation codes, file extensions, and the forms of region lines.
STOKES = {1: "I", 2: "Q", 3: "U", 4: "V", -1: "RR", -2: "LL", -3: "RL", -4: "LR", -5: "XX", -6: "YY", -7: "XY", -8: "YX"}
EXTENSIONS = {"fits": "FITS", "fit": "FITS", "fts": "FITS", "hdf5": "HDF5", "h5": "HDF5", "zarr": "CASA", "crtf": "CRTF", "reg": "DS9_REG"}
AXIS_ROLES = {"RA": "longitude", "GLON": "longitude", "DEC": "latitude", "GLAT": "latitude", "FREQ": "channel", "VRAD": "channel", "VELO": "channel", "STOKES": "stokes", "TIME": "time"}
BOX = r"^centerbox\s*\[\[\s*([0-9.]+)pix,\s*([0-9.]+)pix\s*\],\s*\[\s*([0-9.]+)pix,\s*([0-9.]+)pix\s*\]\]"
SYMBOL = r"^symbol\s*\[\[\s*([0-9.]+)pix,\s*([0-9.]+)pix\s*\]"


def axis_ends(crval: Column, cdelt: Column, crpix: Column, n: Column) -> tuple[Column, Column]:
    """The smaller and larger coordinate of an axis's first and last pixel."""
    a, z = crval + (1 - crpix) * cdelt, crval + (n - crpix) * cdelt
    return F.least(a, z), F.greatest(a, z)


def frequency_text(lo: Column, hi: Column) -> Column:
    unit = F.when(hi > 1e9, "GHz").when(hi > 1e6, "MHz").otherwise("Hz")
    scale = F.when(hi > 1e9, 1e9).when(hi > 1e6, 1e6).otherwise(1.0)
    return F.concat(F.lit("["), F.round(lo / scale, 4), F.lit(", "), F.round(hi / scale, 4), F.lit("] "), unit)


def radio_velocity(f: Column, rest: Column) -> Column:
    """km/s; NULL without a positive rest frequency."""
    return F.when(rest > 0, LIGHT * (rest - f) / rest / 1000)


def stokes_name(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in STOKES.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def file_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("UNKNOWN")
    for k, v in EXTENSIONS.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def entry_type(value: Column) -> Column:
    """BOOL, INT, FLOAT or STRING of a header value as text; NULL without one."""
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([EeDd][+-]?[0-9]+)?$"
    return (
        F.when(value.isNull(), None).when(value.isin("T", "F"), "BOOL").when(value.rlike("^[+-]?[0-9]+$"), "INT").when(value.rlike(number), "FLOAT").otherwise("STRING")
    )


def axis_role(ctype: Column) -> Column:
    """The role of an axis by the start of its type."""
    out = F.lit(None).cast("string")
    for start, role in AXIS_ROLES.items():
        out = F.when(F.upper(ctype).startswith(start), role).otherwise(out)
    return out


def beam_record(major: Column, minor: Column, angle: Column) -> Column:
    """Beam in arc seconds and degrees, for all channels and polarisations (-1); NULL without a major axis."""
    return F.when(major.isNotNull(), F.struct((major * 3600).alias("major"), (minor * 3600).alias("minor"), angle.alias("angle"), F.lit(-1).alias("channel"), F.lit(-1).alias("stokes")))


def sexagesimal(degrees: Column, hours: bool, places: int = 3) -> Column:
    """Degrees as h:m:s (right ascension, wrapped at 24 h) or signed d:m:s (declination), to `places` places of a second."""
    unit = 10**places
    ticks = F.round((F.pmod(degrees, F.lit(360.0)) * 240 if hours else F.abs(degrees) * 3600) * unit).cast("long")
    ticks = F.pmod(ticks, F.lit(86400 * unit)) if hours else ticks
    sign = F.lit("") if hours else F.when((degrees < 0) & (ticks > 0), "-").otherwise("+")
    part = lambda c, n: F.lpad(F.floor(c).cast("string"), n, "0")
    whole, minutes, seconds = part(ticks / (3600 * unit), 2), F.pmod(ticks, F.lit(3600 * unit)), F.pmod(ticks, F.lit(60 * unit))
    return F.concat(sign, whole, F.lit(":"), part(minutes / (60 * unit), 2), F.lit(":"), part(seconds / unit, 2), F.lit("."), part(F.pmod(ticks, F.lit(unit)), places))


def pixel_centre(v: Column) -> Column:
    """The nearest whole pixel; halves go to the even one."""
    return F.rint(v).cast("int")


def parse_regions(lines: DataFrame) -> DataFrame:
    """lines plus type, cx, cy, w, h, color, line_width, dash_list of boxes and points; other lines are left out.

    White space between the parts of a line is free, as is the mark before a colour; every region's dash list is one 0.
    """
    line, num = F.col("line"), lambda p, k: F.regexp_extract("line", p, k).cast("double")
    box, point = line.rlike(BOX), line.rlike(SYMBOL)
    return lines.where(box | point).select(
        *lines.columns, F.when(box, "RECTANGLE").otherwise("POINT").alias("type"),
        F.when(box, num(BOX, 1)).otherwise(num(SYMBOL, 1)).alias("cx"), F.when(box, num(BOX, 2)).otherwise(num(SYMBOL, 2)).alias("cy"),
        F.when(box, num(BOX, 3)).alias("w"), F.when(box, num(BOX, 4)).alias("h"),
        F.when(F.rlike("line", F.lit("color=#?[0-9A-Fa-f]{6}")), F.concat(F.lit("#"), F.upper(F.regexp_extract("line", "color=#?([0-9A-Fa-f]{6})", 1)))).otherwise("").alias("color"),
        F.coalesce(F.expr(r"try_cast(regexp_extract(line, 'linewidth=([0-9]+)', 1) AS INT)"), F.lit(1)).alias("line_width"), F.array(F.lit(0)).alias("dash_list"),
    )


def region_lines(regions: DataFrame) -> DataFrame:
    """regions (type, cx, cy, w, h, color, line_width) plus line, the text that parse_regions reads; other types have no line."""
    pix = lambda c: F.concat(F.col(c).cast("double").cast("string"), F.lit("pix"))
    pair = lambda a, b: F.concat(F.lit("["), pix(a), F.lit(", "), pix(b), F.lit("]"))
    box = F.concat(F.lit("centerbox ["), pair("cx", "cy"), F.lit(", "), pair("w", "h"), F.lit("]"))
    point = F.concat(F.lit("symbol ["), pair("cx", "cy"), F.lit(", .]"))
    style = F.concat_ws(", ", F.concat(F.lit("color="), F.nullif("color", F.lit(""))), F.concat(F.lit("linewidth="), F.col("line_width").cast("string")))
    shape = F.when(F.col("type") == "RECTANGLE", box).when(F.col("type") == "POINT", point)
    return regions.withColumn("line", F.when(style == "", shape).otherwise(F.concat(shape, F.lit(" "), style)))


def write_regions(regions: DataFrame, path: str) -> None:
    """Writes a folder of files, each with the format's first line: the regions in the order of region_id, over all files by name.

    Ranges of ids are dealt to tasks by their number, so a small export is one file.
    """
    lines = region_lines(regions).where("line IS NOT NULL").select("region_id", "line")
    dealt = lines.repartitionByRange("region_id").sortWithinPartitions("region_id").select("line")

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(batches):
            if k == 0 and b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(["#CRTFv0"])], names=["line"])
            yield b

    dealt.mapInArrow(headed, "line string").write.text(path)


def is_box(corners: Column, tolerance: float = 1e-8) -> Column:
    """Whether a closed ring of points (array of struct x, y; the last one repeats the first) is the box of its bounds."""
    x, y = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    near = lambda a, b: F.abs(a - b) <= tolerance
    lo_x, hi_x, lo_y, hi_y = F.array_min(x), F.array_max(x), F.array_min(y), F.array_max(y)
    at = lambda p, cx, cy: near(p["x"], cx) & near(p["y"], cy)
    has = lambda cx, cy: F.exists(corners, lambda p: at(p, cx, cy))
    every = has(lo_x, lo_y) & has(hi_x, lo_y) & has(hi_x, hi_y) & has(lo_x, hi_y)
    # Neighbours share a coordinate, so the ring does not cross itself.
    step = F.forall(F.sequence(F.lit(0), F.lit(3)), lambda i: near(F.get(x, i), F.get(x, i + 1)) | near(F.get(y, i), F.get(y, i + 1)))
    closed = at(F.get(corners, F.lit(4)), F.get(x, F.lit(0)), F.get(y, F.lit(0)))
    area = ((hi_x - lo_x) > tolerance) & ((hi_y - lo_y) > tolerance)
    return F.coalesce((F.size(corners) == 5) & closed & every & step & area, F.lit(False))


def chunk_plan(requests: DataFrame, axes: int = 5) -> DataFrame:
    """requests (id, shape, chunks, index) -> a row a chunk that the request meets: chunk_id, coords, chunk_slice, out_slice.

    shape and chunks: arrays of an entry an axis, at most `axes`; index: array of struct<start, stop, scalar>. A scalar takes
    one place; a slice is cut at the axis's size, its start and stop being the whole axis where NULL. Empty slices give no
    rows. Slices are half-open (start, stop). Each axis is columns of plain numbers and one explode over its chunks' numbers;
    arrays are made of them at the end.
    """
    df, count = requests, F.size("shape")
    for i in range(axes):
        at, n = F.get("index", F.lit(i)), F.get("shape", F.lit(i)).cast("long")
        start = F.when(at["scalar"], at["start"].cast("long")).otherwise(F.coalesce(at["start"].cast("long"), F.lit(0)))
        stop = F.when(at["scalar"], at["start"].cast("long") + 1).otherwise(F.least(F.coalesce(at["stop"].cast("long"), n), n))
        df = df.withColumns({f"_a{i}": start, f"_z{i}": stop, f"_c{i}": F.get("chunks", F.lit(i)).cast("long")})
        a, z, c = (F.col(f"_{k}{i}") for k in "azc")
        numbers = F.when(z > a, F.sequence(F.floor(a / c), F.floor((z - 1) / c))).otherwise(F.array().cast("array<long>"))
        df = df.withColumn(f"_k{i}", F.explode(F.when(count <= i, F.array(F.lit(None).cast("long"))).otherwise(numbers)))
    own = lambda f: F.slice(F.array(*[f(*(F.col(f"_{k}{i}") for k in "kazc")) for i in range(axes)]), F.lit(1), count)
    lo, hi = lambda k, a, c: F.greatest(a, k * c), lambda k, z, c: F.least(z, (k + 1) * c)
    pair = lambda x, y: F.struct(x.alias("start"), y.alias("stop"))
    return df.select(
        "id", F.concat_ws(".", *[F.col(f"_k{i}").cast("string") for i in range(axes)]).alias("chunk_id"), own(lambda k, a, z, c: k).alias("coords"),
        own(lambda k, a, z, c: pair(lo(k, a, c) - k * c, hi(k, z, c) - k * c)).alias("chunk_slice"), own(lambda k, a, z, c: pair(lo(k, a, c) - a, hi(k, z, c) - a)).alias("out_slice"),
    )


def live_regions(commands: DataFrame, key: list[str], order: list[str], removal: Column) -> DataFrame:
    """The last command of each region that is not a removal; a region that is set again after one is live again."""
    return latest(commands.withColumn("_gone", removal), key, order).where("NOT _gone").drop("_gone")


def catalog_page(table: DataFrame, filters: list[tuple], columns: list[str], sort: str | None = None, descending: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows that meet every filter (column, operator, value[, value]), their columns, sorted (ties by the first column), one page.

    Operators: ==, !=, <, >, <=, >=, range_open (a < x < b), range_closed, contains (text, upper and lower case alike).
    """
    tests = {
        "==": lambda c, a: c == a, "!=": lambda c, a: c != a, "<": lambda c, a: c < a, ">": lambda c, a: c > a, "<=": lambda c, a: c <= a,
        ">=": lambda c, a: c >= a, "range_open": lambda c, a, b: (c > a) & (c < b), "range_closed": lambda c, a, b: c.between(a, b),
        "contains": lambda c, a: F.contains(F.lower(c.cast("string")), F.lit(a.lower())),
    }
    for column, operator, *values in filters:
        table = table.where(tests[operator](F.col(column), *values))
    out = table.select(*columns)
    if sort:
        out = out.orderBy(F.desc(sort) if descending else F.asc(sort), columns[0])
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def latest(commands: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last command of each key: one aggregation, no sort."""
    rest = [c for c in commands.columns if c not in key]
    return commands.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m")).select(*key, "m.*")


def changes(commands: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """Commands that change the state of their key; repeats are left out."""
    before = F.lag(state).over(Window.partitionBy(*key).orderBy(*order))
    return commands.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col(state))).drop("before")
