"""Registered queries of derived headers, chunk plans, tile requests, blocks, regions, catalogs and session state, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import finite
from ..operators import headers as H
from ..operators import metadata as M
from ..operators import overlays as O
from ..operators import regions as R
from ..operators import tiles as T
from ..sources import blocks, cubes, files, fits
from ..sources.store import scratch
from ..streaming import slabs
from .catalogue import _INSIDE, _NINE, _PX, _STATS, _inside, _table, query, rounded
from .extras import _done

# Headers: cards that each row of part stands for
_P = "p_partkey"
_CARDS = {
    "NAXIS": "'4'", "NAXIS1": f"{{s}}(64 + {_P} % 10)", "NAXIS2": f"{{s}}(50 + {_P} % 7)", "NAXIS3": f"{{s}}(1 + {_P} % 12)", "NAXIS4": f"{{s}}(1 + {_P} % 4)",
    "CTYPE1": f"CASE WHEN {_P} % 2 = 0 THEN 'RA---TAN' ELSE 'RA---SIN' END", "CTYPE2": f"CASE WHEN {_P} % 2 = 0 THEN 'DEC--TAN' ELSE 'DEC--SIN' END",
    "CTYPE3": "'FREQ'", "CTYPE4": "'STOKES'", "BITPIX": f"CASE WHEN {_P} % 3 = 0 THEN '16' ELSE '-32' END",
    "CRPIX1": f"concat({{s}}({_P} % 40), '.5')", "CRPIX2": "'20'", "CRPIX3": "'1'", "CRPIX4": "'1'",
    "CRVAL1": f"concat({{s}}({_P} * 37 % 360), '.3')", "CRVAL2": f"concat({{s}}({_P} * 29 % 160 - 80), '.25')", "CRVAL3": f"concat({{s}}(1400000007 + {_P} * 100000), '.0')", "CRVAL4": "'1'",
    "CDELT1": "'-0.002'", "CDELT2": "'0.0015'", "CDELT3": f"CASE WHEN {_P} % 3 = 0 THEN '-250000.0' ELSE '500000.0' END", "CDELT4": "'1'",
    "RESTFRQ": f"CASE WHEN {_P} % 4 <> 0 THEN '1420405752.0' END", "BUNIT": "'Jy/beam'", "RADESYS": "'FK5'", "EQUINOX": f"CASE WHEN {_P} % 5 = 0 THEN '1950.0' ELSE '2000.0' END",
    "SPECSYS": "'LSRK'", "VELREF": f"CASE WHEN {_P} % 2 = 0 THEN '257' ELSE '1' END", "EXTNAME": f"CASE WHEN {_P} % 6 = 0 THEN 'SCI' END",
    "BMAJ": f"CASE WHEN {_P} % 3 = 1 THEN '0.002' END", "BMIN": "'0.001'", "BPA": f"concat({{s}}({_P} % 180), '.5')",
}


def _headers(spark: SparkSession, d: str) -> DataFrame:
    cards = [F.struct(F.lit(k).alias("key"), F.expr(v.replace("{s}", "string")).alias("value")) for k, v in _CARDS.items()]
    part = _table(spark, d, "part").select(F.concat(F.lit("part-"), F.col(_P).cast("string")).alias("file"), F.lit(0).alias("hdu"), F.explode(F.array(*cards)).alias("c"), F.col(_P))
    cards = part.select("file", "hdu", F.col("c.key").alias("key"), F.col("c.value").alias("value"), F.lit(0).alias("card"))
    return H.header_maps(cards)


def _hms(degrees: str, hours: bool, places: int) -> str:
    unit = 10**places
    ticks = f"(round((({degrees}) % 360 + 360) % 360 * 240 * {unit})::BIGINT % {86400 * unit})" if hours else f"round(abs({degrees}) * 3600 * {unit})::BIGINT"
    sign = "''" if hours else f"CASE WHEN ({degrees}) < 0 AND {ticks} > 0 THEN '-' ELSE '+' END"
    parts = [f"{ticks} // {3600 * unit}", f"{ticks} % {3600 * unit} // {60 * unit}", f"{ticks} % {60 * unit} // {unit}", f"{ticks} % {unit}"]
    return f"{sign} || printf('%02d:%02d:%02d.%0{places}d', {', '.join(parts)})"


def _shown(x: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.6f', ({x})::DOUBLE), '0+$', ''), '\\.$', '.0')"


_CORNERS = [(x, y) for x in ("0", "nx - 1") for y in ("0", "ny - 1")]


def _corner(x: str, y: str) -> tuple[str, str]:
    xi, eta, d0 = f"radians(({x} + 1 - px) * -0.002::DOUBLE)", f"radians(({y} + 1 - 20) * 0.0015::DOUBLE)", "radians(de)"
    zeta = f"CASE WHEN p % 2 = 0 THEN 1.0::DOUBLE ELSE sqrt(1 - {xi} * {xi} - {eta} * {eta}) END"
    depth = f"(({zeta}) * cos({d0}) - {eta} * sin({d0}))"
    return f"ra + degrees(atan2({xi}, {depth}))", f"degrees(atan2({eta} * cos({d0}) + ({zeta}) * sin({d0}), sqrt({xi} * {xi} + {depth} * {depth})))"


_HEADER_SQL = f"""WITH h AS (SELECT p_partkey AS p, 64 + p_partkey % 10 AS nx, 50 + p_partkey % 7 AS ny, 1 + p_partkey % 12 AS nf, 1 + p_partkey % 4 AS ns, p_partkey % 40 + 0.5::DOUBLE AS px,
p_partkey * 37 % 360 + 0.3::DOUBLE AS ra, ((p_partkey * 29 % 160 - 80) || '.25')::DOUBLE AS de, 1400000007::DOUBLE + p_partkey * 100000 AS f0, CASE WHEN p_partkey % 3 = 0 THEN -250000.0 ELSE 500000.0 END::DOUBLE AS df FROM part),
f AS (SELECT *, least(f0, f0 + (nf - 1) * df) AS lo, greatest(f0, f0 + (nf - 1) * df) AS hi,
[{', '.join(_hms(_corner(x, y)[0], True, 3) for x, y in _CORNERS)}] AS ras, list_sort([{', '.join(_corner(x, y)[1] for x, y in _CORNERS)}]) AS des FROM h),
e AS (SELECT p, k, name, value FROM (
SELECT p, 1 AS k, 'Name' AS name, 'part-' || p AS value FROM f UNION ALL SELECT p, 2, 'HDU', '0' FROM f UNION ALL SELECT p, 3, 'Extension name', 'SCI' FROM f WHERE p % 6 = 0
UNION ALL SELECT p, 4, 'Data type', CASE WHEN p % 3 = 0 THEN 'int' ELSE 'float' END FROM f UNION ALL SELECT p, 5, 'Shape', '[' || nx || ', ' || ny || ', ' || nf || ', ' || ns || '] (RA, DEC, FREQ, STOKES)' FROM f
UNION ALL SELECT p, 6, 'Number of channels', nf::VARCHAR FROM f UNION ALL SELECT p, 7, 'Number of polarizations', ns::VARCHAR FROM f UNION ALL SELECT p, 8, 'Coordinate type', 'Right Ascension, Declination' FROM f
UNION ALL SELECT p, 9, 'Projection', CASE WHEN p % 2 = 0 THEN 'TAN' ELSE 'SIN' END FROM f UNION ALL SELECT p, 10, 'Image reference pixels', '[' || {_shown('px')} || ', 20]' FROM f
UNION ALL SELECT p, 11, 'Image reference coords', '[' || {_hms('ra', True, 4)} || ', ' || {_hms('de', False, 4)} || ']' FROM f
UNION ALL SELECT p, 12, 'Image ref coords (deg)', '[' || printf('%.3f', ra) || ' deg, ' || printf('%.3f', de) || ' deg]' FROM f UNION ALL SELECT p, 13, 'Pixel increment', '-7.2", 5.4"' FROM f
UNION ALL SELECT p, 14, 'Pixel unit', 'Jy/beam' FROM f UNION ALL SELECT p, 15, 'Celestial frame', CASE WHEN p % 5 = 0 THEN 'FK5, B1950.0' ELSE 'FK5, J2000.0' END FROM f UNION ALL SELECT p, 16, 'Spectral frame', 'LSRK' FROM f
UNION ALL SELECT p, 17, 'Velocity definition', CASE WHEN p % 2 = 0 THEN 'RADIO' ELSE 'OPTICAL' END FROM f UNION ALL SELECT p, 18, 'Restoring beam', '7.2" X 3.6", ' || (p % 180) || '.5 deg' FROM f WHERE p % 3 = 1
UNION ALL SELECT p, 19, 'RA range', '[' || list_min(ras) || ', ' || list_max(ras) || ']' FROM f UNION ALL SELECT p, 20, 'DEC range', '[' || {_hms('des[1]', False, 3)} || ', ' || {_hms('des[4]', False, 3)} || ']' FROM f
UNION ALL SELECT p, 21, 'Frequency range', '[' || printf('%.4f', lo / 1e9) || ', ' || printf('%.4f', hi / 1e9) || '] (GHz)' FROM f
UNION ALL SELECT p, 22, 'Velocity range', '[' || printf('%.4f', 299792458.0::DOUBLE * (1420405752.0::DOUBLE - lo) / 1420405752.0::DOUBLE / 1000) || ', ' || printf('%.4f', 299792458.0::DOUBLE * (1420405752.0::DOUBLE - hi) / 1420405752.0::DOUBLE / 1000) || '] (km/s)' FROM f WHERE p % 4 <> 0
UNION ALL SELECT p, 23, 'Stokes coverage', '[' || array_to_string(['I', 'Q', 'U', 'V'][1:ns], ', ') || ']' FROM f))
"""


@query(_HEADER_SQL + "SELECT 'part-' || p AS file, (row_number() OVER (PARTITION BY p ORDER BY k) - 1)::INTEGER AS place, name, value FROM e")
def header_computed(spark, d):
    info = H.file_info_extended(_headers(spark, d))
    return info.select("file", F.posexplode_outer("entries").alias("place", "e")).select("file", "place", "e.name", "e.value")


@query(_HEADER_SQL + "SELECT 'part-' || p AS file, 0 AS hdu, 4 AS dimensions, nx::INTEGER AS width, ny::INTEGER AS height, nf::INTEGER AS depth, ns::INTEGER AS stokes, 3 AS spectral_axis, 4 AS stokes_axis FROM f")
def header_info_extended(spark, d):
    return H.file_info_extended(_headers(spark, d)).drop("spatial_x", "spatial_y", "entries")


_SKY = {"CTYPE1": "RA---SIN", "CTYPE2": "DEC--SIN", "CRVAL3": 1.42e9, "CDELT3": 1.0e6, "CRPIX3": 1.0, "BUNIT": "Jy/beam", "BMAJ": 0.001, "BMIN": 0.0005, "BPA": 12.5}


@query(_PX + """, h AS (SELECT DISTINCT channel FROM px), k(name, value) AS (VALUES ('HDU', '0'), ('Data type', 'float'), ('Shape', '[64, 50, 1, 1] (RA, DEC, FREQ, STOKES)'), ('Number of channels', '1'),
('Number of polarizations', '1'), ('Projection', 'SIN'), ('Pixel unit', 'Jy/beam'), ('Restoring beam', '3.6" X 1.8", 12.5 deg'), ('Frequency range', '[1.4200, 1.4200] (GHz)'), ('Stokes coverage', '[I]'))
SELECT channel, name, value FROM h, k UNION ALL SELECT channel, 'Name', 'plane-0-' || channel || '.fits' FROM h""")
def fits_computed(spark, d):
    path = scratch(spark, "fits")
    _done(fits.write_planes(cubes.emb3d_nan(spark, d).withColumn("stokes", F.lit(0)), path, cubes.ROWS, 64, _SKY))
    info = H.file_info_extended(H.header_maps(fits.cards(spark, path))).select("file", F.explode_outer("entries").alias("e"))
    names = ("Name", "HDU", "Data type", "Shape", "Number of channels", "Number of polarizations", "Projection", "Pixel unit", "Restoring beam", "Frequency range", "Stokes coverage")
    return info.where(F.col("e.name").isin(*names)).select(F.regexp_extract("file", r"-([0-9]+)\.fits$", 1).cast("int").alias("channel"), "e.name", "e.value")


@query(_PX + ", h AS (SELECT DISTINCT channel FROM px) SELECT 'plane-0-' || channel || '.fits' AS name, 'FITS' AS type, 17280 AS bytes FROM h UNION ALL SELECT 'cube', 'UNKNOWN', 17280 * count(*) FROM h")
def file_listing(spark, d):
    path = scratch(spark, "listing")
    _done(fits.write_planes(cubes.emb3d_nan(spark, d).withColumn("stokes", F.lit(0)), f"{path}/cube", cubes.ROWS, 64))
    found = files.listing(spark, path)
    folders = files.folder_info(found).select(F.element_at(F.split("folder", "/"), -1).alias("name"), F.lit("UNKNOWN").alias("type"), F.col("bytes").cast("long").alias("bytes"))
    return files.entries(found).select("name", "type", F.col("bytes").cast("long").alias("bytes")).unionByName(folders)


_LINES = """SELECT row_number() OVER (ORDER BY c_custkey) AS region_id, CASE WHEN c_custkey % 2 = 0 THEN 'RECTANGLE' ELSE 'POINT' END AS type, c_custkey % 60 + 0.5::DOUBLE AS cx, c_nationkey % 50 + 0.25::DOUBLE AS cy,
CASE WHEN c_custkey % 2 = 0 THEN 4.0::DOUBLE END AS w, CASE WHEN c_custkey % 2 = 0 THEN (1 + c_custkey % 9)::DOUBLE END AS h, '#2EE6D6' AS color, (1 + c_custkey % 3)::INTEGER AS line_width FROM customer"""


@query(_LINES)
def region_files(spark, d):
    """Regions of every customer, exported as one region file, sniffed, read and imported again."""
    c = F.col("c_custkey")
    box = c % 2 == 0
    regions = _table(spark, d, "customer").select(
        c.alias("region_id"), F.when(box, "RECTANGLE").otherwise("POINT").alias("type"), (c % 60 + 0.5).alias("cx"), (F.col("c_nationkey") % 50 + 0.25).alias("cy"),
        F.when(box, 4.0).alias("w"), F.when(box, (1 + c % 9).cast("double")).alias("h"), F.lit("#2EE6D6").alias("color"), (1 + c % 3).cast("int").alias("line_width"),
    )
    path = scratch(spark, "regions")
    M.write_regions(regions, path)
    # Ids of imported regions follow the order of lines, here that of the customers' keys, which run from 1 on.
    return files.import_regions(files.region_lines(spark, path)).drop("line_no", "file", "line", "dash_list")


# Chunk plans and tiles
@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber % 3 AS t, l_partkey % 90 AS a, l_partkey % 90 + l_suppkey % 30 AS z, l_suppkey % 64 AS x FROM lineitem),
t AS (SELECT *, t // 2 AS tc FROM r), y AS (SELECT *, unnest(generate_series(a // 16, (least(z, 100) - 1) // 16)) AS yc FROM t WHERE least(z, 100) > a), c AS (SELECT *, unnest([0, 1, 2, 3]) AS xc FROM y)
SELECT id, tc || '.' || yc || '.' || xc AS chunk_id, (t % 2)::BIGINT AS t_from, (t % 2 + 1)::BIGINT AS t_to, greatest(a, yc * 16) - yc * 16 AS y_from, least(z, least(yc * 16 + 16, 100)) - yc * 16 AS y_to,
greatest(a, yc * 16) - a AS out_y_from, least(z, least(yc * 16 + 16, 100)) - a AS out_y_to, (xc * 16)::BIGINT AS out_x_from, (xc * 16 + 16)::BIGINT AS out_x_to FROM c""")
def chunk_plan_nd(spark, d):
    """One time, a slice of y, all of x, of an array of 3 x 100 x 64 in chunks of 2 x 16 x 16."""
    t, a, n = F.col("l_linenumber") % 3, F.col("l_partkey") % 90, F.col("l_suppkey") % 30
    ends = lambda start, stop, scalar: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(scalar).alias("scalar"))
    none = F.lit(None).cast("long")
    r = _table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array(*map(F.lit, (3, 100, 64))).alias("shape"), F.array(*map(F.lit, (2, 16, 16))).alias("chunks"),
        F.array(ends(t, t, True), ends(a, a + n, False), ends(none, none, False)).alias("index"),
    )
    p = M.chunk_plan(r, 3)
    at = lambda s, i, e: F.get(s, F.lit(i))[e]
    return p.select(
        "id", "chunk_id", at("chunk_slice", 0, "start").alias("t_from"), at("chunk_slice", 0, "stop").alias("t_to"), at("chunk_slice", 1, "start").alias("y_from"), at("chunk_slice", 1, "stop").alias("y_to"),
        at("out_slice", 1, "start").alias("out_y_from"), at("out_slice", 1, "stop").alias("out_y_to"), at("out_slice", 2, "start").alias("out_x_from"), at("out_slice", 2, "stop").alias("out_x_to"),
    )


@query(_PX + """, r AS (SELECT DISTINCT event_id % 3 AS layer, event_id // 3 % 4 AS ty, event_id // 12 % 4 AS tx FROM events),
m AS (SELECT channel, layer, ty, tx, y // (1 << (2 - layer)) % 16 AS dy, x // (1 << (2 - layer)) % 16 AS dx, avg(v) AS v FROM px JOIN r ON y // (16 << (2 - layer)) = ty AND x // (16 << (2 - layer)) = tx GROUP BY ALL),
f AS (SELECT *, (v IS NULL)::INTEGER AS gap, coalesce(v, avg(v) OVER (PARTITION BY channel, layer, ty, tx, dy // 4, dx // 4)) AS filled FROM m),
g AS (SELECT *, (gap <> coalesce(lag(gap) OVER w, 0))::INTEGER AS flip FROM f WINDOW w AS (PARTITION BY channel, layer, ty, tx ORDER BY dy, dx)),
n AS (SELECT *, sum(flip) OVER (PARTITION BY channel, layer, ty, tx ORDER BY dy, dx) AS run FROM g), l AS (SELECT channel, layer, ty, tx, run, count(*) AS length FROM n GROUP BY ALL),
s AS (SELECT channel, layer, ty, tx, CASE WHEN min(run) > 0 THEN '0,' ELSE '' END || string_agg(length::VARCHAR, ',' ORDER BY run) AS runs FROM l GROUP BY ALL)
SELECT channel, ((layer << 24) | (ty << 12) | tx)::INTEGER AS code, (max(dy) + 1)::INTEGER AS height, (max(dx) + 1)::INTEGER AS width, any_value(runs) AS runs,
md5(string_agg(round(filled::FLOAT::DOUBLE * 1e4)::BIGINT::VARCHAR, ',' ORDER BY dy, dx)) AS payload_md5 FROM n JOIN s USING (channel, layer, ty, tx) GROUP BY channel, layer, ty, tx""")
def tile_requests(spark, d):
    e = F.col("event_id")
    code = F.shiftleft(e % 3, 24).bitwiseOR(F.shiftleft(F.floor(e / 3) % 4, 12)).bitwiseOR(F.floor(e / 12) % 4).cast("int")
    t = T.samples(T.requested_tiles(cubes.emb3d_nan(spark, d), _table(spark, d, "events").select(code.alias("code")), cubes.ROWS, 64, ["channel"], 16))
    text = F.concat_ws(",", F.transform("samples", lambda v: F.when(~F.isnan(v), F.round(v.cast("double") * 1e4).cast("long").cast("string"))))
    return t.select("channel", "code", "height", "width", F.array_join(F.transform("runs", lambda r: r.cast("string")), ",").alias("runs"), F.md5(F.encode(text, "UTF-8")).alias("payload_md5"))


@query(_PX + "SELECT channel, " + _NINE.format(beam=1.0) + " FROM px WHERE channel >= 2 AND channel < 8 AND " + _INSIDE + " GROUP BY channel")
def blocks_region_stats(spark, d):
    """Statistics of a region of a cube in blocks; its bounds and channels prune blocks before pixels are made."""
    path = scratch(spark, "blocks")
    blocks.write(cubes.emb3d_nan(spark, d), path, ["channel"], 16)
    px = blocks.read(spark, path, ["channel"], (25.5 - 15.2, 18.05 - 12.85, 25.5 + 15.2, 18.05 + 12.85), 16).where("channel >= 2 AND channel < 8")
    return rounded(R.region_stats(px, _inside(), ["channel"]), *_STATS)


# Regions
_CASES = (
    ("rect", 1, 1, 4, 3), ("clip", -1, -1, 5, 4), ("outside", 10, 10, 15, 15), ("partial", 2, 2, 6, 5), ("fractional", 1.3, 1.7, 3.2, 2.8), ("triangle", 1, 1, 4, 3),
    ("point", 2, 3, 2, 3), ("line", 1, 1, 3, 1), ("huge", -100, -100, 200, 200), ("exact", 0, 0, 3, 3),
)


@query("WITH g(name, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for n, a, b, c, e in _CASES) + """),
i AS (SELECT p_partkey, name, x0, y0, x1, y1, (1 + p_partkey % 12)::INTEGER AS img_h, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE (1 + p_partkey % 11)::INTEGER END AS img_w FROM part, g),
c AS (SELECT *, greatest(0, floor(x0))::INTEGER AS cx0, greatest(0, floor(y0))::INTEGER AS cy0, least(coalesce(img_w, ceil(x1)), ceil(x1))::INTEGER AS cx1, least(img_h, ceil(y1))::INTEGER AS cy1 FROM i)
SELECT p_partkey, name, cx0, cy0, cx1, cy1, CASE WHEN cx1 <= cx0 OR cy1 <= cy0 THEN 0 ELSE cy1 - cy0 END AS mask_h, CASE WHEN cx1 <= cx0 OR cy1 <= cy0 THEN 0 ELSE cx1 - cx0 END AS mask_w FROM c""")
def region_cases(spark, d):
    """Boxes, a triangle, a point and a line on images of many sizes, some without a known width."""
    p = F.col("p_partkey")
    case = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), *[F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), box, strict=True)]) for n, *box in _CASES])).alias("g")
    b = _table(spark, d, "part").select("p_partkey", (1 + p % 12).cast("int").alias("img_h"), F.when(p % 9 != 0, (1 + p % 11).cast("int")).alias("img_w"), case)
    return R.clip(b.select("p_partkey", "img_h", "img_w", "g.*")).drop("x0", "y0", "x1", "y1", "img_h", "img_w")


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 4 <> 0 AND l_quantity > 1 AS box FROM lineitem")
def region_is_box(spark, d):
    """Rings of four corners and back; each fourth one is bent, and one whose width is 1 has no area."""
    w, k = F.col("l_quantity") - 1, F.col("l_linenumber")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero = F.lit(0.0)
    bent = F.when(k % 4 == 0, 0.5).otherwise(0.0)
    ring = F.array(point(zero, zero), point(w, zero), point(w + bent, F.lit(2.0)), point(zero, F.lit(2.0)), point(zero, zero))
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.is_box(ring).alias("box"))


@query(_PX + ", s AS (SELECT channel, " + _NINE.format(beam=1.0) + " FROM px WHERE " + _INSIDE + " GROUP BY channel) SELECT * FROM s")
def progressive_adaptive(spark, d):
    """The region spectrum, run slab by slab with sizes by the time that each takes, as a stream; its rows are those of one run."""
    vectors = _table(spark, d, "embeddings")  # listed once, not for each slab

    def read(a: int, z: int) -> DataFrame:
        return R.region_stats(cubes.emb3d_nan_pixels(cubes.of_channels(vectors, (a, z))), _inside(), ["channel"])

    last = vectors.agg(F.max(F.floor(F.col("vec_id") / cubes.ROWS).cast("int"))).first()[0]
    return rounded(slabs.progressive(spark, 0 if last is None else last + 1, read, first=4).drop("first", "last", "batch"), *_STATS)


@query(_PX + """, c AS (SELECT *, (1.0e9 + channel * 1.0e6) / 1e6 AS c, avg(v) OVER (PARTITION BY y, x) AS m FROM px WHERE v >= -0.2 AND v <= 0.25 AND channel >= 1 AND channel < 8)
SELECT y, x, round(avg(v), 6) AS mean, round(sum(v), 6) AS integrated, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, round(avg(abs(v - m)), 6) AS abs_dev, max(v) AS max, arg_max(c, (v, -channel)) AS max_coord FROM c GROUP BY ALL""")
def moments_masked(spark, d):
    m = R.moments(cubes.emb3d_nan(spark, d, (1, 8)), channels=(1, 8), values=(-0.2, 0.25)).select("y", "x", "mean", "integrated", "median", "std", "abs_dev", "max", "max_coord")
    return rounded(m, "mean", "integrated", "median", "std", "abs_dev")


@query(_PX + """, s AS (SELECT channel, y, x, max(v) FILTER (stokes = 0) AS q, max(v) FILTER (stokes = 1) AS u, max(v) FILTER (stokes = 2) AS i FROM li GROUP BY ALL)
SELECT channel, y, x, round(sqrt(q * q + u * u + u * u / 16), 6) AS ptotal, round(sqrt(q * q + u * u + u * u / 16) / i, 6) AS pftotal FROM s WHERE q IS NOT NULL AND u IS NOT NULL""")
def stokes_total(spark, d):
    """Total polarisation; a quarter of U stands for V, which the cube lacks."""
    at = lambda k: F.max(F.when(F.col("stokes") == k, F.col("v")))
    s = cubes.li4d(spark, d).groupBy("channel", "y", "x").agg(at(0).alias("q"), at(1).alias("u"), at(2).alias("i")).where("q IS NOT NULL AND u IS NOT NULL")
    p = O.polarisation(F.col("q"), F.col("u"), F.col("u") / 4, F.col("i"))
    return rounded(s.select("channel", "y", "x", p["ptotal"].alias("ptotal"), p["pftotal"].alias("pftotal")), "ptotal", "pftotal")


@query(_PX + """, m AS (SELECT channel, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM px GROUP BY ALL),
edges AS (SELECT a.channel, 'x' AS axis, a.y, a.x, a.v AS a, b.v AS b FROM m a JOIN m b ON a.channel = b.channel AND a.y = b.y AND b.x = a.x + 1
UNION ALL SELECT a.channel, 'y', a.y, a.x, a.v, b.v FROM m a JOIN m b ON a.channel = b.channel AND a.x = b.x AND b.y = a.y + 1)
SELECT channel, level, axis, y, x, round((y + CASE WHEN axis = 'y' THEN (level - a) / (b - a) ELSE 0 END) * 2 + 0.5, 5) AS at_y, round((x + CASE WHEN axis = 'x' THEN (level - a) / (b - a) ELSE 0 END) * 2 + 0.5, 5) AS at_x
FROM edges, (VALUES (0.05::DOUBLE)) AS l(level) WHERE a IS NOT NULL AND b IS NOT NULL AND (a < level) <> (b < level)""")
def contours_smoothed(spark, d):
    return rounded(O.contour_crossings(cubes.emb3d_nan(spark, d), [0.05], ["channel"], smooth=2, band=16), "at_y", "at_x", places=5)


# Catalogs
@query("""SELECT p_partkey, p_brand, p_size, p_retailprice FROM part WHERE p_size > 2 AND p_size >= 3 AND p_size < 50 AND p_size <= 49 AND p_size <> 7 AND p_retailprice > 900 AND p_retailprice < 1900
AND p_partkey BETWEEN 5 AND 100000 AND contains(lower(p_brand), 'brand') AND p_retailprice = p_retailprice ORDER BY p_size DESC, p_partkey LIMIT 120 OFFSET 15""")
def catalog_predicates(spark, d):
    filters = [
        ("p_size", ">", 2), ("p_size", ">=", 3), ("p_size", "<", 50), ("p_size", "<=", 49), ("p_size", "!=", 7), ("p_retailprice", "range_open", 900, 1900),
        ("p_partkey", "range_closed", 5, 100000), ("p_brand", "contains", "BRAND"), ("p_retailprice", "==", F.col("p_retailprice")),
    ]
    return M.catalog_page(_table(spark, d, "part"), filters, ["p_partkey", "p_brand", "p_size", "p_retailprice"], "p_size", True, 15, 120)


# Session state
@query(_PX + """, s AS (SELECT user_id, arg_max(event_id % 10, (ts, event_id)) AS channel FROM events GROUP BY user_id), b AS (SELECT channel, min(v) AS lo, max(v) AS hi, count(v) AS good FROM px GROUP BY channel)
SELECT user_id, s.channel::INTEGER AS channel, lo, hi, good FROM s JOIN b ON b.channel = s.channel""")
def image_channels(spark, d):
    """Each session's channel is that of its last command; only channels that some session shows are described."""
    e = _table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 10).cast("int").alias("channel"))
    state = M.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "channel")
    shown = cubes.emb3d_nan(spark, d).join(state.select("channel").distinct(), "channel", "left_semi")
    f = finite(F.col("v"))
    planes = shown.groupBy("channel").agg(F.min(f).alias("lo"), F.max(f).alias("hi"), F.count(f).alias("good"))
    return state.join(planes, "channel").select("user_id", "channel", "lo", "hi", "good")


@query("""WITH l AS (SELECT user_id, event_id % 7 AS region_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL)
SELECT user_id, region_id, event_type, value, event_id FROM l WHERE event_type <> 'error'""")
def regions_removed(spark, d):
    """Regions whose last command is not a removal (events of one type stand for removals)."""
    e = _table(spark, d, "events").select("user_id", (F.col("event_id") % 7).alias("region_id"), "event_type", "value", "event_id", "ts")
    return M.live_regions(e, ["user_id", "region_id"], ["ts", "event_id"], F.col("event_type") == "error").drop("ts")
