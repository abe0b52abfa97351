"""Registered queries of files, streams, overlays and the rest of the metadata, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metadata as M
from ..operators import overlays as O
from ..operators import planes as P
from ..sources import cubes, fits, zarr
from ..sources.store import scratch
from ..streaming import streams as S
from .catalogue import _INSIDE, _PX, _inside, _nulls, _table, query, rounded


# Files: cubes that Spark writes in the format, read again
def _done(written: DataFrame) -> None:
    """Runs the write."""
    written.write.format("noop").mode("overwrite").save()


def _planes(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "fits")
    _done(fits.write_planes(cubes.emb3d_nan(spark, d).withColumn("stokes", F.lit(0)), path, cubes.ROWS, 64, {"BUNIT": "Jy/beam"}))
    return path


@query(_PX + "SELECT channel, y, x, v FROM px WHERE channel >= 1 AND channel < 8 AND y >= 5 AND y < 30")
def fits_slab(spark, d):
    px = fits.pixels(spark, _planes(spark, d), channel=(1, 8), y=(5, 30))
    return _nulls(px.select("channel", "y", "x", "v"))


@query(_PX + ", h AS (SELECT DISTINCT channel FROM px) SELECT channel, k.key, CASE k.key WHEN 'FIRSTCHA' THEN channel::VARCHAR ELSE k.value END AS value, k.type FROM h, (VALUES ('BITPIX', '-32', 'INT'), ('BUNIT', 'Jy/beam', 'STRING'), ('SIMPLE', 'T', 'BOOL'), ('NAXIS1', '64', 'INT'), ('NAXIS2', '50', 'INT'), ('FIRSTCHA', '', 'INT')) AS k(key, value, type)")
def fits_headers(spark, d):
    cards = fits.cards(spark, _planes(spark, d)).where(F.col("key").isin("BITPIX", "BUNIT", "SIMPLE", "NAXIS1", "NAXIS2", "FIRSTCHA"))
    channel = F.regexp_extract("file", r"-([0-9]+)\.fits$", 1).cast("int")
    return cards.select(channel.alias("channel"), "key", "value", "type")


@query(_PX + "SELECT channel, y, x, v FROM px WHERE channel >= 2 AND channel < 7 AND y >= 5 AND y < 30 AND x >= 10 AND x < 41")
def zarr_slab(spark, d):
    px = cubes.emb3d_nan(spark, d).withColumns({"time": F.lit(0), "stokes": F.lit(0)})
    n, path = px.agg(F.max("channel")).first()[0], scratch(spark, "zarr")
    if n is None:
        return px.select("channel", "y", "x", "v")
    shape = {"time": 1, "channel": n + 1, "stokes": 1, "y": cubes.ROWS, "x": 64}
    _done(zarr.write(px, path, shape, {"time": 1, "channel": 4, "stokes": 1, "y": 16, "x": 32}))
    return _nulls(zarr.pixels(spark, path, channel=(2, 7), y=(5, 30), x=(10, 41)).select("channel", "y", "x", "v"))


# Overlays
@query(_PX + """, edges AS (SELECT a.channel, 'x' AS axis, a.y, a.x, a.v AS a, b.v AS b FROM px a JOIN px b ON a.channel = b.channel AND a.y = b.y AND b.x = a.x + 1
UNION ALL SELECT a.channel, 'y', a.y, a.x, a.v, b.v FROM px a JOIN px b ON a.channel = b.channel AND a.x = b.x AND b.y = a.y + 1)
SELECT channel, level, axis, y, x, round(y + CASE WHEN axis = 'y' THEN (level - a) / (b - a) ELSE 0 END, 6) AS at_y, round(x + CASE WHEN axis = 'x' THEN (level - a) / (b - a) ELSE 0 END, 6) AS at_x
FROM edges, (VALUES (-0.1::DOUBLE), (0.15::DOUBLE)) AS l(level) WHERE a IS NOT NULL AND b IS NOT NULL AND (a < level) <> (b < level)""")
def contours(spark, d):
    return rounded(O.contour_crossings(cubes.emb3d_nan(spark, d), [-0.1, 0.15], ["channel"]), "at_y", "at_x")


_L = "sqrt(49.0 * 49.0 + 31.0 * 31.0)"


@query(_PX + f""", c AS (SELECT channel, v, (x - 5.0) * (49.0 / {_L}) + (y - 7.0) * (31.0 / {_L}) AS along, abs((y - 7.0) * (49.0 / {_L}) - (x - 5.0) * (31.0 / {_L})) AS off FROM px)
SELECT channel, floor(along)::INTEGER AS step, count(v) AS n, round(avg(v), 6) AS v FROM c WHERE along >= 0 AND along < {_L} AND off <= 1.45 GROUP BY ALL""")
def pv_image(spark, d):
    return rounded(O.pv_cut(cubes.emb3d_nan(spark, d), (5.0, 7.0), (54.0, 38.0), 2.9), "v")


@query(_PX + """, m AS (SELECT stokes, channel, y // 8 AS y, x // 8 AS x, avg(v) AS v FROM li GROUP BY ALL),
s AS (SELECT channel, y, x, max(v) FILTER (stokes = 0) AS q, max(v) FILTER (stokes = 1) AS u, max(v) FILTER (stokes = 2) AS i FROM m GROUP BY ALL)
SELECT channel, y, x, round(sqrt(greatest(0, q * q + u * u - 2.5 * 2.5)), 6) AS intensity, round(degrees(atan2(u, q) * 0.5), 6) AS angle FROM s WHERE q IS NOT NULL AND u IS NOT NULL AND i >= 20.0""")
def vector_overlay(spark, d):
    return rounded(O.vectors(cubes.li4d(spark, d), 8, ["channel"], 20.0, 2.5), "intensity", "angle")


@query(_PX + """, w AS (SELECT channel, x, y, v AS w FROM px WHERE v > 0 AND """ + _INSIDE + """),
s AS (SELECT channel, sum(w) AS s, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) AS mxx, sum(w * y * y) / sum(w) AS myy FROM w GROUP BY channel)
SELECT channel, round(s, 6) AS flux, round(mx, 6) AS x, round(my, 6) AS y, round(2 * sqrt(2 * ln(2)) * sqrt(greatest(0, mxx - mx * mx)), 6) AS fwhm_x, round(2 * sqrt(2 * ln(2)) * sqrt(greatest(0, myy - my * my)), 6) AS fwhm_y FROM s""")
def gaussian_estimate(spark, d):
    return rounded(O.source_estimate(cubes.emb3d_nan(spark, d), _inside(), ["channel"]), "flux", "x", "y", "fwhm_x", "fwhm_y")


@query("""SELECT p_partkey AS id, step, 3 + (((p_partkey % 40 + step * (p_partkey % 5 - 2)) % 40 + 40) % 40) AS channel FROM part, LATERAL (SELECT unnest(range(1 + p_partkey % 6))::INTEGER AS step)""")
def animation_frames(spark, d):
    p = F.col("p_partkey")
    return O.frames(_table(spark, d, "part").select(p.alias("id"), F.lit(3).cast("long").alias("first"), F.lit(42).cast("long").alias("last"), (p % 40 + 3).alias("start"), (p % 5 - 2).alias("delta"), (1 + p % 6).alias("steps")))


@query(_PX + """, t AS (SELECT channel, y // 16 AS ty, x // 16 AS tx, y % 16 AS dy, x % 16 AS dx, v FROM px),
f AS (SELECT channel, ty, tx, dy, dx, coalesce(v, avg(v) OVER w) AS v FROM t WINDOW w AS (PARTITION BY channel, ty, tx, dy // 4, dx // 4))
SELECT channel, ty, tx, count(*) AS pixels, md5(string_agg(round(v::FLOAT::DOUBLE * 1e4)::BIGINT::VARCHAR, ',' ORDER BY dy, dx)) AS payload_md5 FROM f GROUP BY ALL""")
def tile_payloads(spark, d):
    t = O.tile_payload(P.nan_fill(P.tiles(cubes.emb3d_nan(spark, d), 16, ["channel"]), ["channel"]), ["channel"])
    text = F.concat_ws(",", F.transform("payload", lambda v: F.round(v.cast("double") * 1e4).cast("long").cast("string")))
    return t.select("channel", "ty", "tx", F.size("payload").cast("long").alias("pixels"), F.md5(F.encode(text, "UTF-8")).alias("payload_md5"))


# Metadata
@query("""WITH v AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'T' ELSE 'F' END WHEN 1 THEN '-' || p_partkey WHEN 2 THEN p_partkey || '.5E3' WHEN 3 THEN p_brand END AS value FROM part)
SELECT p_partkey, value, CASE p_partkey % 5 WHEN 0 THEN 'BOOL' WHEN 1 THEN 'INT' WHEN 2 THEN 'FLOAT' WHEN 3 THEN 'STRING' END AS type FROM v""")
def header_entries(spark, d):
    p, k = F.col("p_partkey"), F.col("p_partkey") % 5
    value = F.when(k == 0, F.when(p % 2 == 0, "T").otherwise("F")).when(k == 1, F.concat(F.lit("-"), p.cast("string"))).when(k == 2, F.concat(p.cast("string"), F.lit(".5E3"))).when(k == 3, F.col("p_brand"))
    return _table(spark, d, "part").select("p_partkey", value.alias("value"), M.entry_type(value).alias("type"))


@query("SELECT p_partkey, round((0.001::DOUBLE + p_partkey % 7 * 0.0005::DOUBLE) * 3600, 6) AS major, round((0.001::DOUBLE + p_partkey % 5 * 0.0002::DOUBLE) * 3600, 6) AS minor, (p_partkey % 180)::DOUBLE AS angle, -1 AS channel FROM part WHERE p_partkey % 3 <> 0")
def header_beam(spark, d):
    p = F.col("p_partkey")
    beam = M.beam_record(F.when(p % 3 != 0, 0.001 + p % 7 * 0.0005), 0.001 + p % 5 * 0.0002, (p % 180).cast("double"))
    df = _table(spark, d, "part").select("p_partkey", beam.alias("b")).where("b IS NOT NULL")
    return rounded(df.select("p_partkey", "b.major", "b.minor", "b.angle", "b.channel"), "major", "minor")


@query("""WITH a AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'RA---SIN' WHEN 1 THEN 'DEC--SIN' WHEN 2 THEN 'FREQ-LSR' WHEN 3 THEN 'stokes' WHEN 4 THEN 'GLAT-CAR' ELSE 'OFFSET' END AS ctype FROM part)
SELECT p_partkey, ctype, CASE p_partkey % 6 WHEN 0 THEN 'longitude' WHEN 1 THEN 'latitude' WHEN 2 THEN 'channel' WHEN 3 THEN 'stokes' WHEN 4 THEN 'latitude' END AS role FROM a""")
def axis_roles(spark, d):
    k = F.col("p_partkey") % 6
    ctype = F.when(k == 0, "RA---SIN").when(k == 1, "DEC--SIN").when(k == 2, "FREQ-LSR").when(k == 3, "stokes").when(k == 4, "GLAT-CAR").otherwise("OFFSET")
    return _table(spark, d, "part").select("p_partkey", ctype.alias("ctype"), M.axis_role(ctype).alias("role"))


@query("""WITH d AS (SELECT p_partkey, (p_partkey * 7919 % 720000 - 360000) / 1000.0 AS ra, (p_partkey * 104729 % 180000 - 90000) / 1000.0 AS de FROM part),
m AS (SELECT p_partkey, round(((ra % 360) + 360) % 360 * 240000)::BIGINT % 86400000 AS r, round(abs(de) * 3600000)::BIGINT AS a, de FROM d)
SELECT p_partkey, printf('%02d:%02d:%02d.%03d', r // 3600000, r % 3600000 // 60000, r % 60000 // 1000, r % 1000) AS ra,
CASE WHEN de < 0 THEN '-' ELSE '+' END || printf('%02d:%02d:%02d.%03d', a // 3600000, a % 3600000 // 60000, a % 60000 // 1000, a % 1000) AS dec FROM m""")
def header_sexagesimal(spark, d):
    p = F.col("p_partkey")
    ra, dec = (p * 7919 % 720000 - 360000) / 1000.0, (p * 104729 % 180000 - 90000) / 1000.0
    return _table(spark, d, "part").select("p_partkey", M.sexagesimal(ra, True).alias("ra"), M.sexagesimal(dec, False).alias("dec"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0)::INTEGER AS x, round_even(l_extendedprice / 1000, 0)::INTEGER AS y FROM lineitem")
def point_rounding(spark, d):
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.pixel_centre(F.col("l_quantity") / 2).alias("x"), M.pixel_centre(F.col("l_extendedprice") / 1000).alias("y"))


# Streams
@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def stream_cursor_latest(spark, d):
    e = S.replay(_table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts"), "ts")
    seen = S.land(S.latest(e, ["user_id", "event_type"], ["ts", "event_id"]), "update")  # a batch writes the keys that it changes
    return S.latest(seen, ["user_id", "event_type"], ["batch"]).drop("ts", "batch")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL")
def stream_hourly(spark, d):
    """Windows that the watermark has closed: each is written once, and its state goes."""
    return rounded(S.land(S.windows(S.replay(_table(spark, d, "events"), "ts"), "1 hour"), "append").drop("batch"), "total")


@query("""WITH f AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INTEGER AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM f)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_sessions(spark, d):
    """Sessions that the watermark has closed."""
    return S.land(S.sessions(S.replay(_table(spark, d, "events"), "ts"), "30 minutes"), "append").drop("batch")


@query(_PX + "SELECT channel, count(v) AS n, round(sum(v), 6) AS sum, min(v) AS min, max(v) AS max FROM px WHERE " + _INSIDE + " GROUP BY channel")
def stream_progressive_spectrum(spark, d):
    px = cubes.emb3d_nan_pixels(S.replay(_table(spark, d, "embeddings"), "vec_id"))
    seen = S.land(S.progressive_channels(px, _inside()), "update")
    return rounded(S.latest(seen, ["channel"], ["batch"]).drop("batch"), "sum")


@query("""WITH f AS (SELECT user_id, event_type, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS first_id FROM events GROUP BY ALL)
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first_ts, first_id) AS region_id FROM f""")
def stream_region_ids(spark, d):
    seen = S.land(S.first_seen(S.replay(_table(spark, d, "events"), "ts")), "update")
    last = S.latest(seen, ["user_id", "event_type"], ["batch"])
    ordered = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "event_type"))).alias("r"))  # an entry a type
    return ordered.select("user_id", F.posexplode("r").alias("k", "e")).select("user_id", "e.event_type", (F.col("k") + 1).cast("long").alias("region_id"))


@query("""WITH l AS (SELECT user_id, event_id % 7 AS region_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL)
SELECT user_id, region_id, event_type, value, event_id FROM l WHERE event_type <> 'error'""")
def stream_regions_live(spark, d):
    """Regions that no removal ended, from the changes that every batch writes; events of one type stand for removals."""
    e = _table(spark, d, "events").select("user_id", (F.col("event_id") % 7).alias("region_id"), "event_type", "value", "event_id", "ts")
    seen = S.land(S.latest(S.replay(e, "ts"), ["user_id", "region_id"], ["ts", "event_id"]), "update")
    return M.live_regions(seen, ["user_id", "region_id"], ["batch"], F.col("event_type") == "error").drop("ts", "batch")
