"""All registered queries of the cube engine: name -> how to run it, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import beam_area, finite, in_polygon, in_rectangle, layer_to_mip, mip_to_layer, tile_id, tile_parts
from ..operators import metadata as M
from ..operators import planes as P
from ..operators import regions as R
from ..sources import cubes


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


CATALOGUE: dict[str, Query] = {}
_PX = "WITH " + cubes.SQL + " "
_INSIDE = "(x + 0.5 - 25.5 >= -15.2 AND x + 0.5 - 25.5 < 15.2 AND y + 0.5 - 18.05 >= -12.85 AND y + 0.5 - 18.05 < 12.85)"
TRIANGLE = [(4.0, 3.0), (57.3, 9.2), (30.1, 44.7)]
BEAM = beam_area(4.2, 3.1, 1.5)
_CROSS = " + ".join(
    f"(CASE WHEN y + 0.5 >= {min(a[1], b[1])} AND y + 0.5 < {max(a[1], b[1])} AND x + 0.5 < {a[0]} + (y + 0.5 - {a[1]}) * ({b[0]} - {a[0]}) / ({b[1]} - {a[1]}) THEN 1 ELSE 0 END)"
    for a, b in zip(TRIANGLE, TRIANGLE[1:] + TRIANGLE[:1], strict=True)
)


def _inside() -> Column:
    return in_rectangle(F.col("x"), F.col("y"), 25.5, 18.05, 30.4, 25.7)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        CATALOGUE[f.__name__] = Query(f, sql)
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Results are compared with SQL, whose sums add in another order: to the millionth, here and in the SQL alone."""
    return df.withColumns({c: F.round(c, places) for c in columns})


def _nulls(df: DataFrame, c: str = "v") -> DataFrame:
    return df.withColumn(c, F.when(~F.isnan(c), F.col(c)))


_STATS = ("sum", "flux_density", "mean", "rms", "sigma", "sum_sq")
_NINE = """count(v) AS n, round(sum(v), 6) AS sum, round(sum(v) / {beam}, 6) AS flux_density,
round(avg(v), 6) AS mean, round(sqrt(avg(v * v)), 6) AS rms, round(stddev_pop(v), 6) AS sigma, round(sum(v * v), 6) AS sum_sq,
min(v) AS min, max(v) AS max, CASE WHEN abs(max(v)) >= abs(min(v)) THEN max(v) ELSE min(v) END AS extrema"""


# Selection
@query(_PX + "SELECT channel, y, x, v FROM px WHERE channel = 3")
def plane_select(spark, d):
    return _nulls(P.slab(cubes.emb3d_nan(spark, d, (3, 4)), channel=3))


@query(_PX + "SELECT channel, y, x, v FROM px WHERE channel >= 2 AND channel < 7 AND y >= 5 AND y < 30 AND x >= 10 AND x < 41")
def slab_select(spark, d):
    return _nulls(P.slab(cubes.emb3d_nan(spark, d, (2, 7)), y=(5, 30), x=(10, 41)))


@query(_PX + ", c AS (SELECT DISTINCT channel FROM li WHERE stokes = 1) SELECT c.channel, l.v FROM c LEFT JOIN (SELECT channel, v FROM li WHERE stokes = 1 AND x = 11 AND y = 7) l ON c.channel = l.channel")
def point_spectrum(spark, d):
    li = cubes.li4d(spark, d).where("stokes = 1")
    return li.select("channel").distinct().join(li.where("x = 11 AND y = 7").select("channel", "v"), "channel", "left")


@query(_PX + "SELECT 'x' AS coordinate, x AS pos, v FROM px WHERE channel = 2 AND y = 17 AND x >= 4 AND x < 60 UNION ALL SELECT 'y', y, v FROM px WHERE channel = 2 AND x = 21")
def spatial_profiles(spark, d):
    px = _nulls(P.slab(cubes.emb3d_nan(spark, d, (2, 3)), channel=2))
    along_x = P.slab(px, y=17, x=(4, 60)).select(F.lit("x").alias("coordinate"), F.col("x").alias("pos"), "v")
    return along_x.unionByName(P.slab(px, x=21).select(F.lit("y").alias("coordinate"), F.col("y").alias("pos"), "v"))


@query(_PX + "SELECT x // 2 AS pos, round(avg(v), 6) AS v FROM px WHERE channel = 2 AND y // 2 = 8 GROUP BY 1")
def spatial_profile_mip(spark, d):
    px = P.slab(cubes.emb3d_nan(spark, d, (2, 3)), channel=2, y=(16, 18))
    return rounded(P.block_mean(px, 2, ["channel"]).select(F.col("x").alias("pos"), "v"), "v")


@query("SELECT event_id, trunc(value)::INTEGER AS x, trunc(value * 3 - 40)::INTEGER AS y, (trunc(value) >= 0 AND trunc(value) < 64 AND trunc(value * 3 - 40) >= 0 AND trunc(value * 3 - 40) < 50) AS inside FROM events")
def cursor_in_bounds(spark, d):
    e = _table(spark, d, "events").select("event_id", F.col("value").cast("int").alias("x"), (F.col("value") * 3 - 40).cast("int").alias("y"))
    return e.withColumn("inside", F.col("x").between(0, 63) & F.col("y").between(0, 49))


@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 97 AS start, l_partkey % 97 + l_suppkey % 41 AS stop, 16 AS chunk FROM lineitem),
k AS (SELECT *, unnest(generate_series(start // chunk, (stop - 1) // chunk)) AS k FROM s WHERE stop > start)
SELECT id, k AS chunk_no, greatest(start - k * chunk, 0) AS chunk_from, least(stop - k * chunk, chunk) AS chunk_to,
k * chunk + greatest(start - k * chunk, 0) - start AS out_from, k * chunk + least(stop - k * chunk, chunk) - start AS out_to FROM k""")
def chunk_plan(spark, d):
    s = _table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 97).alias("start"), (F.col("l_partkey") % 97 + F.col("l_suppkey") % 41).alias("stop"), F.lit(16).alias("chunk"))
    ends = F.struct("start", "stop", F.lit(False).alias("scalar"))
    p = M.chunk_plan(s.select("id", F.array(F.lit(200)).alias("shape"), F.array("chunk").alias("chunks"), F.array(ends).alias("index")), 1)
    at = lambda c, e: F.get(c, F.lit(0))[e]
    return p.select("id", F.get("coords", F.lit(0)).alias("chunk_no"), at("chunk_slice", "start").alias("chunk_from"), at("chunk_slice", "stop").alias("chunk_to"), at("out_slice", "start").alias("out_from"), at("out_slice", "stop").alias("out_to"))


# Downsampling and tiles
def _mip_sql(f: int, table: str = "px", by: str = "channel") -> str:
    return _PX + f"SELECT {by}, y // {f} AS y, x // {f} AS x, round(avg(v), 6) AS v FROM {table} GROUP BY ALL"


@query(_mip_sql(2))
def mip_plane_2(spark, d):
    return rounded(P.block_mean(cubes.emb3d_nan(spark, d), 2, ["channel"]), "v")


@query(_mip_sql(8, "li", "stokes, channel"))
def mip_plane_8_sparse(spark, d):
    return rounded(P.block_mean(cubes.li4d(spark, d), 8, ["stokes", "channel"]), "v")


@query(_PX + " UNION ALL ".join(f"SELECT {f} AS mip, channel, y // {f} AS y, x // {f} AS x, round(avg(v), 6) AS v FROM px GROUP BY ALL" for f in (1, 2, 4, 8)))
def mip_pyramid(spark, d):
    return rounded(P.pyramid(cubes.emb3d_nan(spark, d), 4, ["channel"]), "v")


@query("""WITH s AS (SELECT p_partkey, (p_partkey % 5)::INTEGER AS layer, (300 + p_partkey % 7000)::INTEGER AS h, (200 + p_partkey * 7 % 9000)::INTEGER AS w FROM part)
SELECT p_partkey, greatest(1, pow(2, ceil(log2(greatest(ceil(h / 256), ceil(w / 256)))) - layer))::INTEGER AS mip,
greatest(0, ceil(log2(greatest(ceil(h / 256), ceil(w / 256)) / 4)))::INTEGER AS layer_of_4 FROM s""")
def layer_mip(spark, d):
    p = F.col("p_partkey")
    s = _table(spark, d, "part").select(p, (p % 5).cast("int").alias("layer"), (300 + p % 7000).cast("int").alias("h"), (200 + p * 7 % 9000).cast("int").alias("w"))
    return s.select("p_partkey", layer_to_mip(F.col("layer"), F.col("h"), F.col("w")).alias("mip"), mip_to_layer(F.lit(4), F.col("h"), F.col("w")).alias("layer_of_4"))


@query("""SELECT l_orderkey, l_linenumber, ((l_linenumber::BIGINT << 24) | ((l_partkey % 4096) << 12) | (l_suppkey % 4096))::INTEGER AS code,
l_linenumber AS layer, (l_partkey % 4096)::INTEGER AS y, (l_suppkey % 4096)::INTEGER AS x FROM lineitem""")
def tile_codec(spark, d):
    code = tile_id(F.col("l_linenumber"), (F.col("l_partkey") % 4096).cast("int"), (F.col("l_suppkey") % 4096).cast("int"))
    df = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", code.alias("code"))
    layer, y, x = tile_parts(F.col("code"))
    return df.select("*", layer.alias("layer"), y.alias("y"), x.alias("x"))


@query(_PX + "SELECT channel, y // 16 AS ty, x // 16 AS tx, count(*) AS pixels, count(v) AS good, min(v) AS lo, max(v) AS hi FROM px GROUP BY ALL")
def tile_cut(spark, d):
    t = P.tiles(cubes.emb3d_nan(spark, d), 16, ["channel"])
    f = finite(F.col("v"))
    return t.groupBy("channel", "ty", "tx").agg(F.count("*").alias("pixels"), F.count(f).alias("good"), F.min(f).alias("lo"), F.max(f).alias("hi"))


@query(_PX + """, t AS (SELECT channel, y // 16 AS ty, x // 16 AS tx, y % 16 AS dy, x % 16 AS dx, (v IS NULL)::INTEGER AS gap FROM px),
f AS (SELECT *, (gap <> coalesce(lag(gap) OVER w, 0))::INTEGER AS flip FROM t WINDOW w AS (PARTITION BY channel, ty, tx ORDER BY dy, dx)),
r AS (SELECT *, (sum(flip) OVER (PARTITION BY channel, ty, tx ORDER BY dy, dx))::INTEGER AS run FROM f)
SELECT channel, ty, tx, run, count(*) AS length FROM r GROUP BY ALL
UNION ALL SELECT channel, ty, tx, 0, 0 FROM r GROUP BY channel, ty, tx HAVING min(run) > 0""")
def nan_rle(spark, d):
    return P.nan_runs(P.tiles(cubes.emb3d_nan(spark, d), 16, ["channel"]), ["channel"])


@query(_PX + """, t AS (SELECT channel, y // 16 AS ty, x // 16 AS tx, y % 16 AS dy, x % 16 AS dx, v FROM px)
SELECT channel, ty, tx, dy, dx, round(coalesce(v, avg(v) OVER w), 6) AS v FROM t
WINDOW w AS (PARTITION BY channel, ty, tx, dy // 4, dx // 4)""")
def nan_fill_4x4(spark, d):
    return rounded(P.nan_fill(P.tiles(cubes.emb3d_nan(spark, d), 16, ["channel"]), ["channel"]), "v")


# Histograms
_HIST = """, b AS (SELECT {by}, min(v) AS lo, max(v) AS hi, greatest(2, floor(sqrt(count(*))))::INTEGER AS bins FROM {t} GROUP BY {by})
SELECT {cols}, CASE WHEN hi = lo THEN 0 ELSE least(bins - 1, floor((v - lo) / ((hi - lo) / bins))) END::INTEGER AS bin, count(*) AS n, lo, hi, bins
FROM {t} JOIN b USING ({by}) WHERE v IS NOT NULL GROUP BY ALL"""


@query(_PX + "SELECT channel, min(v) AS lo, max(v) AS hi, count(*) AS pixels, count(v) AS good FROM px GROUP BY channel")
def plane_minmax(spark, d):
    return P.bounds(cubes.emb3d_nan(spark, d), ["channel"])


@query(_PX + _HIST.format(by="channel", cols="channel", t="px"))
def cube_histogram_by_channel(spark, d):
    return P.histogram(cubes.emb3d_nan(spark, d), ["channel"])


@query(_PX + _HIST.format(by="stokes", cols="stokes", t="li"))
def histogram_by_stokes(spark, d):
    return P.histogram(cubes.li4d(spark, d), ["stokes"])


@query(_PX + "SELECT channel, least(19, floor((v + 0.3) / (0.6 / 20)))::INTEGER AS bin, count(*) AS n, -0.3::DOUBLE AS lo, 0.3::DOUBLE AS hi, 20 AS bins FROM px WHERE v >= -0.3 AND v <= 0.3 GROUP BY ALL")
def histogram_fixed_bounds(spark, d):
    return P.histogram(cubes.emb3d_nan(spark, d), ["channel"], 20, -0.3, 0.3)


@query(_PX + ", h AS (SELECT * FROM (" + _HIST.format(by="channel", cols="channel", t="px").replace(", b AS", "WITH b AS", 1) + """)), s AS (SELECT channel, sum(n) AS n, sum(n * (lo + (bin + 0.5) * ((hi - lo) / bins))) AS s,
sum(n * (lo + (bin + 0.5) * ((hi - lo) / bins)) * (lo + (bin + 0.5) * ((hi - lo) / bins))) AS q FROM h GROUP BY channel)
SELECT channel, round(s / n, 6) AS mean, round(sqrt(greatest(0, q / n - (s / n) * (s / n))), 6) AS sigma FROM s""")
def histogram_mean_sigma(spark, d):
    m = P.histogram_moments(P.histogram(cubes.emb3d_nan(spark, d), ["channel"]), ["channel"])
    return rounded(m, "mean", "sigma")


# Regions
@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 80 - 10.3 AS x0, l_suppkey % 70 - 8.25 AS y0, l_partkey % 80 - 10.3 + l_quantity AS x1, l_suppkey % 70 - 8.25 + l_quantity / 2 AS y1 FROM lineitem),
c AS (SELECT *, greatest(0, floor(x0))::INTEGER AS cx0, greatest(0, floor(y0))::INTEGER AS cy0, least(64, ceil(x1))::INTEGER AS cx1, least(50, ceil(y1))::INTEGER AS cy1 FROM b)
SELECT l_orderkey, l_linenumber, cx0, cy0, cx1, cy1, CASE WHEN cx1 <= cx0 OR cy1 <= cy0 THEN 0 ELSE cy1 - cy0 END AS mask_h, CASE WHEN cx1 <= cx0 OR cy1 <= cy0 THEN 0 ELSE cx1 - cx0 END AS mask_w FROM c""")
def region_clip(spark, d):
    x0, y0, q = F.col("l_partkey") % 80 - 10.3, F.col("l_suppkey") % 70 - 8.25, F.col("l_quantity")
    b = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x0.alias("x0"), y0.alias("y0"), (x0 + q).alias("x1"), (y0 + q / 2).alias("y1"), F.lit(50).alias("img_h"), F.lit(64).alias("img_w"))
    return R.clip(b).drop("x0", "y0", "x1", "y1", "img_h", "img_w")


@query(_PX + "SELECT channel, y, count(*) AS n, min(x) AS x_from, max(x) AS x_to FROM px WHERE " + _INSIDE + " GROUP BY ALL")
def region_mask_rect(spark, d):
    return cubes.emb3d_nan(spark, d).where(_inside()).groupBy("channel", "y").agg(F.count("*").alias("n"), F.min("x").alias("x_from"), F.max("x").alias("x_to"))


@query(_PX + """SELECT channel, y, count(*) AS n, min(x) AS x_from, max(x) AS x_to FROM px
WHERE abs((x + 0.5 - 30.2) * cos(radians(33)) + (y + 0.5 - 22.7) * sin(radians(33))) < 11.13 AND abs((y + 0.5 - 22.7) * cos(radians(33)) - (x + 0.5 - 30.2) * sin(radians(33))) < 6.07 GROUP BY ALL""")
def region_mask_rotated(spark, d):
    inside = in_rectangle(F.col("x"), F.col("y"), 30.2, 22.7, 22.26, 12.14, 33.0)
    return cubes.emb3d_nan(spark, d).where(inside).groupBy("channel", "y").agg(F.count("*").alias("n"), F.min("x").alias("x_from"), F.max("x").alias("x_to"))


@query(_PX + f"SELECT channel, y, count(*) AS n, min(x) AS x_from, max(x) AS x_to FROM px WHERE ({_CROSS}) % 2 = 1 GROUP BY ALL")
def region_mask_polygon(spark, d):
    inside = in_polygon(F.col("x"), F.col("y"), TRIANGLE)
    return cubes.emb3d_nan(spark, d).where(inside).groupBy("channel", "y").agg(F.count("*").alias("n"), F.min("x").alias("x_from"), F.max("x").alias("x_to"))


@query(_PX + "SELECT channel, " + _NINE.format(beam=1.0) + " FROM px WHERE " + _INSIDE + " GROUP BY channel")
def region_spectrum_9stats(spark, d):
    return rounded(R.region_stats(cubes.emb3d_nan(spark, d), _inside() & F.col("y").between(5, 31), ["channel"]), *_STATS)


@query(_PX + "SELECT stokes, channel, " + _NINE.format(beam=repr(BEAM)) + " FROM li WHERE " + _INSIDE + " GROUP BY ALL")
def region_stat_flux(spark, d):
    return rounded(R.region_stats(cubes.li4d(spark, d), _inside(), ["stokes", "channel"], BEAM), *_STATS)


@query(_PX + "SELECT stokes, channel, count(v) AS n, round(sum(v), 6) AS sum, min(v) AS min, max(v) AS max FROM li GROUP BY ROLLUP(stokes, channel)")
def stats_rollup(spark, d):
    f = finite(F.col("v"))
    return cubes.li4d(spark, d).rollup("stokes", "channel").agg(F.count(f).alias("n"), F.round(F.sum(f), 6).alias("sum"), F.min(f).alias("min"), F.max(f).alias("max"))


@query(_PX + """SELECT channel, count(v) AS num_pixels, count(*) - count(v) AS nan_count, min(x) AS blc_x, min(y) AS blc_y, max(x) AS trc_x, max(y) AS trc_y,
arg_min(x, (v, y, x)) FILTER (v IS NOT NULL) AS min_x, arg_min(y, (v, y, x)) FILTER (v IS NOT NULL) AS min_y, arg_max(x, (v, -y, -x)) FILTER (v IS NOT NULL) AS max_x, arg_max(y, (v, -y, -x)) FILTER (v IS NOT NULL) AS max_y
FROM px WHERE """ + _INSIDE + " GROUP BY channel")
def stats_full(spark, d):
    px = cubes.emb3d_nan(spark, d).where(_inside()).withColumn("v", finite(F.col("v")))
    lo = F.when(F.col("v").isNotNull(), F.struct("v", "y", "x"))
    hi = F.when(F.col("v").isNotNull(), F.struct(F.col("v"), (-F.col("y")).alias("a"), (-F.col("x")).alias("b")))
    return px.groupBy("channel").agg(
        F.count("v").alias("num_pixels"), (F.count("*") - F.count("v")).alias("nan_count"), F.min("x").alias("blc_x"), F.min("y").alias("blc_y"), F.max("x").alias("trc_x"), F.max("y").alias("trc_y"),
        F.min_by("x", lo).alias("min_x"), F.min_by("y", lo).alias("min_y"), F.max_by("x", hi).alias("max_x"), F.max_by("y", hi).alias("max_y"),
    )


@query(_PX + ", e2 AS (SELECT channel // 3 AS slab, count(DISTINCT channel) AS c, sum(v) AS s, count(v) AS n FROM px WHERE " + _INSIDE + """ GROUP BY 1)
SELECT slab, (sum(c) OVER w)::BIGINT AS channels, (sum(n) OVER w)::BIGINT AS n, round(sum(s) OVER w, 6) AS sum, round(sum(s) OVER w / sum(n) OVER w, 6) AS mean FROM e2 WINDOW w AS (ORDER BY slab)""")
def progressive_spectrum(spark, d):
    return rounded(R.progressive(cubes.emb3d_nan(spark, d), _inside(), 3), "sum", "mean")


@query(_PX + """, c AS (SELECT *, (1.0e9 + channel * 1.0e6) / 1e6 AS c, avg(v) OVER (PARTITION BY y, x) AS m FROM px WHERE v IS NOT NULL)
SELECT y, x, round(avg(v), 6) AS mean, round(sum(v), 6) AS integrated, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, round(sqrt(avg(v * v)), 6) AS rms,
round(avg(abs(v - m)), 6) AS abs_dev, max(v) AS max, arg_max(c, (v, -channel)) AS max_coord, min(v) AS min, arg_min(c, (v, channel)) AS min_coord FROM c GROUP BY ALL""")
def moments_plain(spark, d):
    m = R.moments(cubes.emb3d_nan(spark, d)).drop("weighted_coord", "dispersion", "median_coord")
    return rounded(m, "mean", "integrated", "median", "std", "rms", "abs_dev")


@query(_PX + """, c AS (SELECT y, x, channel, v + 1 AS v, (1.0e9 + channel * 1.0e6) / 1e6 AS c FROM px WHERE v IS NOT NULL),
r AS (SELECT *, sum(v) OVER (PARTITION BY y, x ORDER BY channel) * 2 >= sum(v) OVER (PARTITION BY y, x) AS half FROM c),
s AS (SELECT y, x, sum(v * (c - 1000)) / sum(v) AS m, sum(v * (c - 1000) * (c - 1000)) / sum(v) AS q, min(c) FILTER (half) AS median_coord FROM r GROUP BY ALL)
SELECT y, x, round(1000 + m, 4) AS weighted_coord, CASE WHEN q - m * m >= 0 THEN round(sqrt(q - m * m), 4) END AS dispersion, median_coord FROM s""")
def moments_weighted(spark, d):
    px = cubes.emb3d_nan(spark, d).withColumn("v", F.col("v") + 1)
    return rounded(R.moments(px).select("y", "x", "weighted_coord", "dispersion", "median_coord"), "weighted_coord", "dispersion", places=4)


@query(_PX + """, s AS (SELECT channel, y, x, max(v) FILTER (stokes = 0) AS q, max(v) FILTER (stokes = 1) AS u, max(v) FILTER (stokes = 2) AS i FROM li GROUP BY ALL)
SELECT channel, y, x, round(sqrt(q * q + u * u), 6) AS plinear, round(sqrt(q * q + u * u) / i, 6) AS pflinear, round(degrees(0.5 * atan2(u, q)), 6) AS pangle FROM s WHERE q IS NOT NULL AND u IS NOT NULL""")
def stokes_derived(spark, d):
    at = lambda k: F.max(F.when(F.col("stokes") == k, F.col("v")))
    s = cubes.li4d(spark, d).groupBy("channel", "y", "x").agg(at(0).alias("q"), at(1).alias("u"), at(2).alias("i")).where("q IS NOT NULL AND u IS NOT NULL")
    p = F.sqrt(F.col("q") * F.col("q") + F.col("u") * F.col("u"))
    return rounded(s.select("channel", "y", "x", p.alias("plinear"), (p / F.col("i")).alias("pflinear"), F.degrees(F.atan2("u", "q") * 0.5).alias("pangle")), "plinear", "pflinear", "pangle")


@query("SELECT p_partkey, p_retailprice, p_brand FROM part WHERE p_retailprice >= 920 AND p_retailprice < 990 AND contains(p_brand, '3') ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 20")
def catalog_filter_page(spark, d):
    p = _table(spark, d, "part").where((F.col("p_retailprice") >= 920) & (F.col("p_retailprice") < 990) & F.contains("p_brand", F.lit("3")))
    return p.select("p_partkey", "p_retailprice", "p_brand").orderBy(F.desc("p_retailprice"), "p_partkey").offset(20).limit(50)


# Metadata
_AXIS = """WITH h AS (SELECT p_partkey, 1.2e6 * (1 + p_partkey % 2000) AS crval, ((p_partkey % 7) - 3) * 12300.7 AS cdelt, 1.0 + p_partkey % 5 AS crpix, 64 + p_partkey % 100 AS n, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 1.4204e9 END AS rest FROM part),
f AS (SELECT *, least(crval + (1 - crpix) * cdelt, crval + (n - crpix) * cdelt) AS lo, greatest(crval + (1 - crpix) * cdelt, crval + (n - crpix) * cdelt) AS hi FROM h) """


def _axis(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    h = _table(spark, d, "part").select(
        p, (1.2e6 * (1 + p % 2000)).alias("crval"), ((p % 7 - 3) * 12300.7).alias("cdelt"), (1.0 + p % 5).alias("crpix"), (64 + p % 100).alias("n"), F.when(p % 4 != 0, 1.4204e9).alias("rest")
    )
    lo, hi = M.axis_ends(*map(F.col, ("crval", "cdelt", "crpix", "n")))
    return h.select("p_partkey", "rest", lo.alias("lo"), hi.alias("hi"))


@query(_AXIS + """SELECT p_partkey, round(lo / s, 4) AS lo, round(hi / s, 4) AS hi, unit FROM (SELECT *, CASE WHEN hi > 1e9 THEN 1e9 WHEN hi > 1e6 THEN 1e6 ELSE 1.0 END AS s, CASE WHEN hi > 1e9 THEN 'GHz' WHEN hi > 1e6 THEN 'MHz' ELSE 'Hz' END AS unit FROM f)""")
def header_freq_range(spark, d):
    df = _axis(spark, d).withColumn("t", M.frequency_text(F.col("lo"), F.col("hi")))
    part = lambda k: F.regexp_extract("t", r"\[([-0-9.E]+), ([-0-9.E]+)\] (\w+)", k)
    return df.select("p_partkey", part(1).cast("double").alias("lo"), part(2).cast("double").alias("hi"), part(3).alias("unit"))


@query(_AXIS + "SELECT p_partkey, round(299792458.0 * (rest - lo) / rest / 1000, 4) AS v_at_lo, round(299792458.0 * (rest - hi) / rest / 1000, 4) AS v_at_hi FROM f")
def header_vel_range(spark, d):
    v = lambda c: F.round(M.radio_velocity(F.col(c), F.col("rest")), 4)
    return _axis(spark, d).select("p_partkey", v("lo").alias("v_at_lo"), v("hi").alias("v_at_hi"))


@query("SELECT l_orderkey, l_linenumber, CASE (l_partkey % 13 - 8)::INTEGER " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in M.STOKES.items()) + " END AS stokes FROM lineitem")
def stokes_coverage(spark, d):
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.stokes_name(F.col("l_partkey") % 13 - 8).alias("stokes"))


@query("""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS line_no, CASE WHEN l_linenumber % 3 = 0 THEN 'symbol [[' || (l_partkey % 60) || '.5pix, ' || (l_suppkey % 50) || '.0pix], .] color=#00ff7a'
WHEN l_linenumber % 3 = 1 THEN 'centerbox [[' || (l_partkey % 60) || '.0pix, ' || (l_suppkey % 50) || '.5pix], [' || l_quantity::INTEGER || '.0pix, 6.0pix]] coord=J2000, color=#2ee6d6, linewidth=' || l_linenumber ELSE '# note' END AS line FROM lineitem)
SELECT line_no, line, CASE WHEN line LIKE 'centerbox%' THEN 'RECTANGLE' ELSE 'POINT' END AS type, regexp_extract(line, '\\[\\[([0-9.]+)pix', 1)::DOUBLE AS cx, regexp_extract(line, '\\[\\[[0-9.]+pix, ([0-9.]+)pix', 1)::DOUBLE AS cy,
nullif(regexp_extract(line, '\\], \\[([0-9.]+)pix', 1), '')::DOUBLE AS w, nullif(regexp_extract(line, '\\], \\[[0-9.]+pix, ([0-9.]+)pix', 1), '')::DOUBLE AS h, upper(regexp_extract(line, 'color=(#[0-9A-Fa-f]{6})', 1)) AS color,
coalesce(nullif(regexp_extract(line, 'linewidth=([0-9]+)', 1), '')::INTEGER, 1) AS line_width FROM l WHERE line NOT LIKE '#%'""".replace("\\\\", "\\"))
def crtf_parse(spark, d):
    c = lambda e: F.expr(f"CAST({e} AS STRING)")
    x, y = c("l_partkey % 60"), c("l_suppkey % 50")
    symbol = F.concat(F.lit("symbol [["), x, F.lit(".5pix, "), y, F.lit(".0pix], .] color=#00ff7a"))
    box = F.concat(F.lit("centerbox [["), x, F.lit(".0pix, "), y, F.lit(".5pix], ["), c("CAST(l_quantity AS INT)"), F.lit(".0pix, 6.0pix]] coord=J2000, color=#2ee6d6, linewidth="), c("l_linenumber"))
    k = F.col("l_linenumber") % 3
    lines = _table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.when(k == 0, symbol).when(k == 1, box).otherwise("# note").alias("line"))
    return M.parse_regions(lines).drop("dash_list")


_NAMES = "CASE p_partkey % 9 WHEN 0 THEN '.fits' WHEN 1 THEN '.FIT' WHEN 2 THEN '.zarr' WHEN 3 THEN '.h5' WHEN 4 THEN '.crtf' WHEN 5 THEN '.reg' WHEN 6 THEN '.txt' WHEN 7 THEN '.hdf5' ELSE '' END"


@query("WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '.' ELSE '' END || 'cube_' || p_partkey || " + _NAMES + " AS name FROM part) SELECT p_partkey, name, CASE lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.EXTENSIONS.items()) + " ELSE 'UNKNOWN' END AS type FROM n WHERE name NOT LIKE '.%'")
def dir_listing_rules(spark, d):
    n = _table(spark, d, "part").select("p_partkey", F.expr("concat(CASE WHEN p_partkey % 10 = 0 THEN '.' ELSE '' END, 'cube_', CAST(p_partkey AS STRING), " + _NAMES + ") AS name"))
    return n.where(~F.col("name").startswith(".")).select("p_partkey", "name", M.file_type(F.col("name")).alias("type"))


# Session state
@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def session_cursor_latest(spark, d):
    e = _table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return M.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, event_type FROM e WHERE before IS DISTINCT FROM event_type""")
def session_req_changes(spark, d):
    e = _table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return M.changes(e, ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@query("""WITH f AS (SELECT user_id, event_type, min(ts) AS first_ts, min(event_id) AS first_id FROM events GROUP BY ALL)
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first_ts, first_id) AS region_id FROM f""")
def region_upsert_ids(spark, d):
    f = _table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("a"), F.min("event_id").alias("b"))
    from pyspark.sql import Window

    return f.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("a", "b")).cast("long").alias("region_id"))
