"""Null rules, clips and invariants of the cube operators."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumencube.functions.expr import beam_area, finite, layer_to_mip, tile_id, tile_parts
from lumencube.operators import headers as H
from lumencube.operators import metadata as M
from lumencube.operators import overlays as O
from lumencube.operators import planes as P
from lumencube.operators import regions as R
from lumencube.operators import tiles as T
from lumencube.sources import blocks

NAN, INF = float("nan"), float("inf")


def cube(spark, rows):
    return spark.createDataFrame(rows, "channel int, y int, x int, v double")


def test_finite_and_extremes(spark):
    px = cube(spark, [(0, 0, 0, NAN), (0, 0, 1, INF), (0, 0, 2, -5.0), (0, 0, 3, 5.0), (1, 0, 0, NAN)])
    out = {r.channel: r for r in R.region_stats(px, F.lit(True), ["channel"]).collect()}
    assert (out[0].n, out[0]["sum"], out[0].min, out[0].max, out[0].extrema) == (2, 0.0, -5.0, 5.0, 5.0)
    assert out[1].n == 0 and out[1]["sum"] is None and out[1].extrema is None
    assert px.where(finite(F.col("v")).isNull()).count() == 3


def test_block_mean_keeps_partial_edges(spark):
    px = cube(spark, [(0, y, x, NAN if x == 2 else 1.5) for y in range(3) for x in range(3)])
    out = {(r.y, r.x): r.v for r in P.block_mean(px, 2, ["channel"]).collect()}
    assert out == {(0, 0): 1.5, (0, 1): None, (1, 0): 1.5, (1, 1): None}


def test_runs_sum_to_pixels_and_start_with_good_ones(spark):
    px = cube(spark, [(0, 0, x, NAN if x in (0, 3) else 1.0) for x in range(5)])
    runs = [r.length for r in P.nan_runs(P.tiles(px, 8, ["channel"]), ["channel"]).orderBy("run").collect()]
    assert runs == [0, 1, 2, 1, 1]


def test_constant_plane_is_one_bin(spark):
    h = P.histogram(cube(spark, [(0, 0, x, 2.0) for x in range(9)]), ["channel"]).collect()
    assert [(r.bin, r.n) for r in h] == [(0, 9)]


def test_clip_cases(spark):
    boxes = [(-1.0, -1.0, 5.0, 4.0, 3, 4), (10.0, 10.0, 15.0, 15.0, 5, 5), (2.0, 2.0, 6.0, 5.0, 4, 4), (-100.0, -100.0, 200.0, 200.0, 10, 10)]
    out = R.clip(spark.createDataFrame(boxes, "x0 double, y0 double, x1 double, y1 double, img_h int, img_w int")).collect()
    assert [(r.mask_h, r.mask_w) for r in out] == [(3, 4), (0, 0), (2, 2), (10, 10)]


def test_codec_and_pyramid(spark):
    row = spark.range(1).select(tile_id(F.lit(3), F.lit(17), F.lit(4095)).alias("c"))
    assert tuple(row.select(*tile_parts(F.col("c"))).first()) == (3, 17, 4095)
    assert spark.range(1).select(layer_to_mip(F.lit(0), F.lit(1000), F.lit(1025))).first()[0] == 8
    assert math.isclose(beam_area(4, 3, 2), math.pi * 12 / (4 * math.log(2)) / 2) and beam_area(None, 1, 1) == 1.0


def close(a, b):
    return (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9)


@pytest.mark.parametrize("scale", [1e-12, 1e-7, 1.0, 1e20])
def test_faint_and_bright_cubes_keep_their_values(spark, scale):
    values = [[1.0, 2.0, NAN, 4.0], [5.0, 6.0, 7.0, 9.0]]
    px = cube(spark, [(c, y, x, v * scale * (c + 1)) for c in range(2) for y, row in enumerate(values) for x, v in enumerate(row)])
    good = [v * scale for row in values for v in row if v == v]
    s = R.region_stats(px.where("channel = 0"), F.lit(True), ["channel"], 2.0).first()
    assert close(s["sum"], sum(good)) and close(s.flux_density, sum(good) / 2) and close(s.mean, sum(good) / 7) and close(s.sum_sq, sum(v * v for v in good))
    assert close(s.rms, math.sqrt(sum(v * v for v in good) / 7)) and close(s.sigma, math.sqrt(sum((v - sum(good) / 7) ** 2 for v in good) / 7))
    means = {(r.channel, r.y, r.x): r.v for r in P.block_mean(px, 2, ["channel"]).collect()}
    assert close(means[0, 0, 0], 3.5 * scale) and close(means[0, 0, 1], 20 / 3 * scale) and close(means[1, 0, 0], 7.0 * scale)
    second = {(r.y, r.x): r.v for r in P.pyramid(px, 2, ["channel"]).where("mip = 2 and channel = 0").collect()}
    assert len(second) == 2 and all(close(v, means[0, y, x]) for (y, x), v in second.items())
    filled = {(r.dy, r.dx): r.v for r in P.nan_fill(P.tiles(px.where("channel = 0"), 8, ["channel"]), ["channel"]).collect()}
    assert close(filled[0, 2], sum(good) / 7) and close(filled[1, 3], 9.0 * scale)
    m = {(r.y, r.x): r for r in R.moments(px).collect()}
    assert close(m[0, 0].mean, 1.5 * scale) and close(m[0, 0].weighted_coord, 1000 + 2 / 3) and close(m[0, 0].dispersion, math.sqrt(2 / 9)) and close(m[0, 0].integrated, 3 * scale)
    assert close(O.pv_cut(px.where("channel = 0"), (0.0, 0.0), (4.0, 0.0), 0.5).where("step = 1").first().v, 2 * scale)
    payload = O.tile_payload(P.tiles(px.where("channel = 0"), 8, ["channel"]), ["channel"]).first().payload
    assert payload[2] is None and math.isclose(payload[7], 9 * scale, rel_tol=1e-6)
    iqu = px.selectExpr("0 AS channel", "y", "x", "v").crossJoin(spark.createDataFrame([(0,), (1,), (2,)], "stokes int"))
    assert close(O.vectors(iqu, 2, ["channel"], 0.0).where("x = 0").first().intensity, (3.5 + 7.0) / 2 * math.sqrt(2) * scale)


def test_moments_without_weight_are_null(spark):
    m = R.moments(cube(spark, [(0, 0, 0, 1.0), (1, 0, 0, -1.0), (0, 0, 1, 1.0), (1, 0, 1, -0.5), (2, 0, 1, 3.0)])).orderBy("x").collect()
    assert m[0].weighted_coord is None and m[0].dispersion is None and m[1].weighted_coord is not None
    only = R.moments(cube(spark, [(c, 0, 0, float(c)) for c in range(6)]), channels=(1, 5), values=(2.0, 9.0)).first()
    assert (only.min, only.max, only.integrated) == (2.0, 4.0, 9.0)


def test_contours_equal_a_plain_search(spark):
    rng = np.random.default_rng(2)
    v = {(y, x): [NAN, INF, *[float(rng.random())] * 8][rng.integers(0, 10)] for y in range(9) for x in range(11) if rng.random() > 0.05}
    px = cube(spark, [(0, y, x, a) for (y, x), a in v.items()])
    want = set()
    for (y, x), a in v.items():
        for axis, b in (("x", v.get((y, x + 1), NAN)), ("y", v.get((y + 1, x), NAN))):
            if math.isfinite(a) and math.isfinite(b) and (a < 0.5) != (b < 0.5):
                want.add((axis, y, x))
    for band in (4, 256):
        got = O.contour_crossings(px, [0.5], ["channel"], band=band).collect()
        assert len(got) == len(want) and {(r.axis, r.y, r.x) for r in got} == want


def test_region_lines_with_free_spacing(spark):
    texts = ["centerbox[[1pix,2.5pix],[3pix,4pix]] color=2ee6d6", "centerbox  [[ 1pix,   2.5pix ],  [ 3pix, 4pix ]] linewidth=3", "symbol[[7pix,8pix],.]", "symbol  [[ 7.5pix,  8pix ], .] color=#ABCDEF", "circle [[1pix, 2pix], 3pix]", " symbol [[7pix, 8pix], .]"]
    df = spark.createDataFrame(list(enumerate(texts)), "line_no int, line string")
    got = [tuple(r)[2:] for r in M.parse_regions(df).orderBy("line_no").collect()]
    assert got == [
        ("RECTANGLE", 1.0, 2.5, 3.0, 4.0, "#2EE6D6", 1, [0]), ("RECTANGLE", 1.0, 2.5, 3.0, 4.0, "", 3, [0]),
        ("POINT", 7.0, 8.0, None, None, "", 1, [0]), ("POINT", 7.5, 8.0, None, None, "#ABCDEF", 1, [0]),
    ]
    back = M.parse_regions(M.region_lines(M.parse_regions(df).drop("line")).select("line_no", "line")).orderBy("line_no")
    assert [tuple(r)[2:] for r in back.collect()] == got


def test_boxes(spark):
    rings = [
        ([(0, 0), (2, 0), (2, 1), (0, 1), (0, 0)], True), ([(0, 0), (0, 1), (2, 1), (2, 0), (0, 0)], True), ([(0, 0), (2, 1), (2, 0), (0, 1), (0, 0)], False),
        ([(0, 0), (2, 0), (2.1, 1), (0, 1), (0, 0)], False), ([(0, 0), (2, 0), (0, 1), (0, 0)], False), ([(1, 1)] * 5, False), (None, False),
    ]
    df = spark.createDataFrame([([(float(x), float(y)) for x, y in r] if r else None, w) for r, w in rings], "ring array<struct<x:double,y:double>>, want boolean")
    assert df.where(M.is_box(F.col("ring")) != F.col("want")).count() == 0


def plain_plan(shape, chunks, index):
    parts = []
    for n, c, (start, stop, scalar) in zip(shape, chunks, index, strict=True):
        if scalar:
            parts.append([(start // c, start % c, start % c + 1, 0, 1)])
            continue
        start, stop = start or 0, n if stop is None else min(stop, n)
        parts.append([(k, max(start, k * c) - k * c, min(stop, k * c + c, n) - k * c, max(start, k * c) - start, min(stop, k * c + c, n) - start) for k in range(start // c, -(-stop // c))] if stop > start else [])
    return {tuple(p) for p in product(*parts)}


def test_chunk_plans_of_several_axes(spark):
    cases = [
        ((10, 10), (4, 4), [(3, 9, False), (5, None, True)]), ((7, 5, 3), (2, 5, 2), [(None, None, False), (1, 4, False), (2, None, True)]),
        ((9,), (3,), [(4, 40, False)]), ((9, 2), (3, 2), [(5, 5, False), (None, None, False)]), ((1, 4, 1, 100, 64), (1, 4, 1, 16, 32), [(0, None, True), (1, 3, False), (0, None, True), (20, 50, False), (None, None, False)]),
    ]
    rows = [(i, list(s), list(c), x) for i, (s, c, x) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, shape array<int>, chunks array<int>, index array<struct<start:long,stop:long,scalar:boolean>>")
    got = {i: set() for i in range(len(cases))}
    for r in M.chunk_plan(df).collect():
        assert r.chunk_id == ".".join(map(str, r.coords))
        got[r.id].add(tuple((k, a.start, a.stop, b.start, b.stop) for k, a, b in zip(r.coords, r.chunk_slice, r.out_slice, strict=True)))
    assert got == {i: plain_plan(*c) for i, c in enumerate(cases)}


def test_requested_tiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    plane = rng.normal(size=(37, 50))
    plane[rng.random(plane.shape) < 0.3] = np.nan
    plane[0:8, 0:8] = np.nan
    px = cube(spark, [(3, y, x, float(v)) for (y, x), v in np.ndenumerate(plane)])
    codes = [(0,), (2 << 24,), (2 << 24 | 1 << 12 | 2,), (1 << 24 | 1 << 12,), (2 << 24 | 9 << 12,)]
    got = {r.code: r for r in T.samples(T.requested_tiles(px, spark.createDataFrame(codes, "code int"), 37, 50, ["channel"], 16)).collect()}
    assert set(got) == {c for (c,) in codes[:4]}
    for code, r in got.items():
        f = 1 << (2 - (code >> 24))
        mean = np.array([[np.nanmean(b) if np.isfinite(b := plane[y : y + f, x : x + f]).any() else np.nan for x in range(0, 50, f)] for y in range(0, 37, f)])
        ty, tx = code >> 12 & 0xFFF, code & 0xFFF
        tile = mean[ty * 16 : ty * 16 + 16, tx * 16 : tx * 16 + 16]
        assert (r.height, r.width) == tile.shape and sum(r.runs) == tile.size
        marks = np.concatenate([np.full(n, k % 2) for k, n in enumerate(r.runs)])
        assert (marks == np.isnan(tile).ravel()).all()
        have = np.array(r.samples, float).reshape(tile.shape)
        assert np.allclose(have[~np.isnan(tile)], tile[~np.isnan(tile)], rtol=1e-6)
        for y, x in zip(*np.nonzero(np.isnan(tile)), strict=True):
            block = tile[y // 4 * 4 : y // 4 * 4 + 4, x // 4 * 4 : x // 4 * 4 + 4]
            assert np.isnan(have[y, x]) if np.isnan(block).all() else math.isclose(have[y, x], np.nanmean(block), rel_tol=1e-5)


def test_blocks_prune_and_come_back(spark, tmp_path):
    rows = [(c, y, x, float(c * 1000 + y * 30 + x)) for c in range(3) for y in range(21) for x in range(30) if (y, x) != (4, 4)]
    path = str(tmp_path / "blocks")
    blocks.write(cube(spark, rows), path, ["channel"], 8)
    back = blocks.read(spark, path, ["channel"])
    assert {tuple(r) for r in back.where("NOT isnan(v)").collect()} == set(rows) and back.count() == 3 * 21 * 30
    some = blocks.read(spark, path, ["channel"], (9.0, 0.0, 15.5, 7.0), 8).where("channel = 1")
    assert some.count() == 8 * 8 and some.where("x BETWEEN 8 AND 15 AND y < 8").count() == 64
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(bx,1)" in plan and "EqualTo(channel,1)" in plan


def test_live_regions_and_pages(spark):
    rows = [(1, 1, "set", 1), (1, 1, "remove", 2), (1, 2, "set", 3), (2, 1, "remove", 4), (2, 1, "set", 5)]
    df = spark.createDataFrame(rows, "session int, region int, what string, seq int")
    live = M.live_regions(df, ["session", "region"], ["seq"], F.col("what") == "remove").collect()
    assert {(r.session, r.region) for r in live} == {(1, 2), (2, 1)}
    t = spark.createDataFrame([(i, f"Name{i}", float(i % 4)) for i in range(20)], "id int, name string, size double")
    page = M.catalog_page(t, [("size", ">=", 1), ("name", "contains", "NAME1"), ("id", "range_open", 1, 19)], ["id", "size"], "size", True, 1, 3).collect()
    assert [tuple(r) for r in page] == [(15, 3.0), (10, 2.0), (14, 2.0)]


def test_fixed_places_round_what_is_stored(spark):
    # -21607952.91195 and many like it lie a little below or above the half that their shortest decimal shows.
    values = [-21607952.91195, 0.5, -0.00001, 1e22, 0.0, 2.00005, -5554600.35275, 5e-4, -5e-4, 5e-5, -5e-5, 5e-7, 4.9e-5, 5.1e-5] + [k * 1237.1 + (k % 10_000 + 0.5) / 10_000 for k in range(20_000)] + [-(k + 0.0625) for k in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (3, 4, 6):
        got = [r[0] for r in df.select(H.fixed(F.col("v"), places)).collect()]
        assert got == [f"{v:.{places}f}" for v in values]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double").select(H.fixed(F.col("v"), 2)).collect()
    assert [r[0] for r in odd][:2] == ["NaN", "Infinity"]
