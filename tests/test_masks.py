"""Masks of tables of regions and places on the sky against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumencube.operators import headers as H
from lumencube.operators import masks as K
from lumencube.sources import blocks

HEIGHT, WIDTH = 40, 53


def regions_of(spark, rings):
    rows = [(i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate(rings)]
    return spark.createDataFrame(rows, "region_id int, corners array<struct<x: double, y: double>>").repartition(3)


def pixels_of(spans):
    out = {}
    for r in spans.collect():
        own = out.setdefault(r.region_id, set())
        new = {(r.y, x) for x in range(r.x_from, r.x_to)}
        assert not new & own and 0 <= r.y < HEIGHT and 0 <= r.x_from < r.x_to <= WIDTH
        own |= new
    return out


def centre_inside(ring, px, py):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if min(y1, y2) <= py < max(y1, y2) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def clipped_area(ring, x, y):
    """Area of the polygon inside the pixel, by cutting it at the four borders (exact for any simple ring)."""
    for keep, cross in (
        (lambda p: p[0] >= x, lambda a, b: (x, a[1] + (x - a[0]) * (b[1] - a[1]) / (b[0] - a[0]))), (lambda p: p[0] <= x + 1, lambda a, b: (x + 1, a[1] + (x + 1 - a[0]) * (b[1] - a[1]) / (b[0] - a[0]))),
        (lambda p: p[1] >= y, lambda a, b: (a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]), y)), (lambda p: p[1] <= y + 1, lambda a, b: (a[0] + (y + 1 - a[1]) * (b[0] - a[0]) / (b[1] - a[1]), y + 1)),
    ):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1]):
            if keep(a):
                out.append(a)
            if keep(a) != keep(b):
                out.append(cross(a, b))
        ring = out
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2 if len(ring) > 2 else 0.0


def random_rings():
    rng = np.random.default_rng(3)
    out = []
    for k in range(40):  # stars around a centre: simple rings, most of them not convex
        angles = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 9)))
        far = rng.uniform(0.3, 14, len(angles))
        cx, cy = rng.uniform(-5, WIDTH + 5), rng.uniform(-5, HEIGHT + 5)
        out.append([(cx + a * np.cos(t), cy + a * np.sin(t)) for a, t in zip(far, angles)])
    return out


def test_spans_of_random_rings(spark):
    rings = random_rings()
    rings += [[(round(x), round(y)) for x, y in r] for r in rings[:12]]  # corners on the borders of pixels
    table = regions_of(spark, rings)
    inside, touched = pixels_of(K.inside_spans(table, HEIGHT, WIDTH)), pixels_of(K.touched_spans(table, HEIGHT, WIDTH))
    every = [(y, x) for y in range(HEIGHT) for x in range(WIDTH)]
    for i, ring in enumerate(rings):
        assert inside.get(i, set()) == {(y, x) for y, x in every if centre_inside(ring, x + 0.5, y + 0.5)}
        if i < 40:  # where corners are round, an edge may fold onto another
            assert touched.get(i, set()) == {(y, x) for y, x in every if clipped_area(ring, x, y) > 1e-13}
        else:
            assert {(y, x) for y, x in every if clipped_area(ring, x, y) > 1e-9} | inside.get(i, set()) <= touched.get(i, set()) | inside.get(i, set())


def test_spans_of_the_fixtures(spark):
    rings = [[(1, 1), (4, 1), (4, 3), (1, 3)], [(1.3, 1.7), (3.2, 1.7), (3.2, 2.8), (1.3, 2.8)], [(1, 1), (4, 1), (2.5, 3)], [(2, 3)], [(1, 1), (3, 1)], [(-100, -100), (200, -100), (200, 200), (-100, 200)], [(60, 50), (70, 50), (70, 60)], [(1.5, 2.5), (4.5, 2.5)], []]
    table = regions_of(spark, rings)
    inside, touched = pixels_of(K.inside_spans(table, HEIGHT, WIDTH)), pixels_of(K.touched_spans(table, HEIGHT, WIDTH))
    box = {(y, x) for y in (1, 2) for x in (1, 2, 3)}
    assert inside[0] == touched[0] == box and touched[1] == box and inside[1] == {(2, 1), (2, 2)}
    assert touched[2] == box and inside[2] == {p for p in box if centre_inside(rings[2], p[1] + 0.5, p[0] + 0.5)}
    assert touched[3] == {(3, 2)} and touched[4] == {(1, 1), (1, 2), (1, 3)} and touched[7] == {(2, 1), (2, 2), (2, 3), (2, 4)}
    assert 3 not in inside and 4 not in inside and 6 not in touched and 8 not in touched
    assert len(inside[5]) == len(touched[5]) == HEIGHT * WIDTH
    assert K.touched_spans(regions_of(spark, [[(1, 1)]]).where("false"), 5, 5).count() == 0


def test_statistics_of_a_table_of_regions(spark):
    rng = np.random.default_rng(7)
    cube = rng.normal(size=(3, HEIGHT, WIDTH)).astype(np.float32)
    cube[rng.random(cube.shape) < 0.1] = np.nan
    cube[1, 3, 3], cube[2] = np.inf, np.nan
    px = spark.createDataFrame([(c, y, x, float(v)) for (c, y, x), v in np.ndenumerate(cube)], "channel int, y int, x int, v double")
    rings = [r for r in random_rings() if r] + [[(2, 2), (30, 2), (30, 30), (2, 30)]] * 25  # many on one block
    spans = K.inside_spans(regions_of(spark, rings), HEIGHT, WIDTH)
    for size, most in ((16, 40), (64, 4096)):
        got = {(r.channel, r.region_id): r for r in K.masked_stats(blocks.to_blocks(px, ["channel"], size), spans, ["channel"], size, most).collect()}
        want = 0
        for i, ring in enumerate(rings):
            mask = np.array([[centre_inside(ring, x + 0.5, y + 0.5) for x in range(WIDTH)] for y in range(HEIGHT)])
            for c in range(3):
                v = cube[c][mask].astype(float)
                v = v[np.isfinite(v)]
                if mask.any():
                    want += 1
                    r = got[c, i]
                    assert r.n == len(v)
                    if len(v):
                        assert np.allclose([r.sum, r.mean, r.rms, r.sigma, r.sum_sq, r.min, r.max], [v.sum(), v.mean(), np.sqrt((v**2).mean()), v.std(), (v**2).sum(), v.min(), v.max()], atol=1e-9)
                    else:
                        assert r.sum is None and r.mean is None and r.min is None and r.extrema is None
        assert len(got) == want
    plan = K.masked_stats(blocks.to_blocks(px, ["channel"], 16), spans, ["channel"], 16)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_spans_are_sent_once_for_many_planes(spark, tmp_path):
    # Spans beside every plane's block would be sent 60 times, in batches of 10,000 blocks, each with up to 4096 spans.
    cube = np.random.default_rng(8).normal(size=(60, 8, 8)).astype(np.float32)
    px = spark.createDataFrame([(c, y, x, float(v)) for (c, y, x), v in np.ndenumerate(cube)], "channel int, y int, x int, v double")
    spans = spark.range(400).selectExpr("id AS region_id", "int(id % 4) AS y", "explode(array(0, 1, 2)) AS k").selectExpr("region_id", "y + k AS y", "0 AS x_from", "5 AS x_to")
    blocks.write(px, str(tmp_path / "b"), ["channel"], 8)
    stats = K.masked_stats(spark.read.parquet(str(tmp_path / "b")), spans, ["channel"], 8)
    got = {(r.channel, r.region_id): r.sum for r in stats.collect()}
    assert len(got) == 60 * 400 and all(np.isclose(s, cube[c, i % 4 : i % 4 + 3, :5].sum(dtype=float)) for (c, i), s in got.items())
    sent, todo = 0, [stats._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if "pythonDataSent" in str(node.metrics().keys()):
            sent += node.metrics().apply("pythonDataSent").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < sent < 400_000


# Sky: the same by rotation matrices, with the native pole found by a search instead of formulas


def plane(code, phi, theta):
    """x, y (degrees) of native coordinates (degrees)."""
    p, t = np.deg2rad(phi), np.deg2rad(theta)
    if code in ("TAN", "SIN", "ARC", "ZEA", "STG"):
        r = {"TAN": lambda: 1 / np.tan(t), "SIN": lambda: np.cos(t), "ARC": lambda: np.pi / 2 - t, "ZEA": lambda: 2 * np.sin((np.pi / 2 - t) / 2), "STG": lambda: 2 * np.tan((np.pi / 2 - t) / 2)}[code]()
        return np.rad2deg(r * np.sin(p)), np.rad2deg(-r * np.cos(p))
    if code == "AIT":
        g = np.sqrt(2 / (1 + np.cos(t) * np.cos(p / 2)))
        return np.rad2deg(2 * g * np.cos(t) * np.sin(p / 2)), np.rad2deg(g * np.sin(t))
    return {"CAR": (phi, theta), "CEA": (phi, np.rad2deg(np.sin(t))), "MER": (phi, np.rad2deg(np.log(np.tan(np.pi / 4 + t / 2)))), "SFL": (phi * np.cos(t), theta)}[code]


def vector(lon, lat):
    a, d = np.deg2rad(lon), np.deg2rad(lat)
    return np.array([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)])


def turn(axis, degrees):
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    i, j = {"z": (0, 1), "y": (2, 0)}[axis]
    m = np.eye(3)
    m[i, i], m[i, j], m[j, i], m[j, j] = c, -s, s, c
    return m


def rotation(ra_p, dec_p, phi_p):
    """Celestial vectors of native ones: Euler angles."""
    return turn("z", ra_p) @ turn("y", 90 - dec_p) @ turn("z", 180 - phi_p)


@pytest.mark.parametrize("code", ["TAN", "SIN", "ARC", "ZEA", "STG", "CAR", "CEA", "MER", "SFL", "AIT"])
def test_sky_by_rotation_matrices(spark, code):
    """Points are chosen on the native sphere, projected by the forward formulas and turned by matrices; sky() must find them."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    zenithal = code in ("TAN", "SIN", "ARC", "ZEA", "STG")
    for k in range(24):
        ra_p, dec_p, phi_p = rng.uniform(0, 360), rng.uniform(-88, 88), rng.uniform(-180, 180)
        m = rotation(ra_p, dec_p, phi_p)
        ref = m @ vector(0, 90 if zenithal else 0)
        ra0, dec0 = np.rad2deg(np.arctan2(ref[1], ref[0])) % 360, np.rad2deg(np.arcsin(ref[2]))
        cd = rng.uniform(-1, 1, (2, 2)) + np.diag([1.5, 1.5])
        for j in range(3):
            phi, theta = rng.uniform(-170, 170), rng.uniform(20, 89) if zenithal else rng.uniform(-70, 70)
            x, y = plane(code, phi, theta)
            pix = np.linalg.solve(cd, [x, y]) + [10.5, -3.0]
            v = m @ vector(phi, theta)
            name = f"{code}-{k}-{j}"
            cards = {"NAXIS": 2, "CTYPE1": f"RA---{code}", "CTYPE2": f"DEC--{code}", "CRPIX1": 10.5, "CRPIX2": -3.0, "CRVAL1": ra0, "CRVAL2": dec0, "LONPOLE": phi_p, "LATPOLE": dec_p}
            if k % 2:
                cards |= {f"CD{a + 1}_{b + 1}": cd[a, b] for a in (0, 1) for b in (0, 1)}
            else:
                cards |= {"CDELT1": cd[0, 0], "CDELT2": cd[1, 1], "PC1_2": cd[0, 1] / cd[0, 0], "PC2_1": cd[1, 0] / cd[1, 1]}
            rows.append((name, 0, {a: repr(float(b)) if not isinstance(b, (int, str)) else str(b) for a, b in cards.items()}, float(pix[0]), float(pix[1])))
            want[name] = v
    df = spark.createDataFrame(rows, "file string, hdu int, header map<string,string>, px double, py double")
    found = H.sky(H.axis_values(H.with_axes(df)), F.array(F.struct(F.col("px").alias("x"), F.col("py").alias("y")))).select("file", F.col("sky")[0].alias("s"))
    for r in found.collect():
        assert np.abs(vector(r.s.ra, r.s.dec) - want[r.file]).max() < 1e-9, r.file


def sky_at(spark, x, y, **cards):
    df = spark.createDataFrame([("f", 0, {"NAXIS": "2", **{k: str(v) for k, v in cards.items()}})], "file string, hdu int, header map<string,string>")
    return H.sky(H.axis_values(H.with_axes(df)), F.array(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")))).first().sky


def test_sky_in_closed_form(spark):
    base = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRVAL1": 30.0, "CRVAL2": 90.0, "CRPIX1": 1, "CRPIX2": 1, "CDELT1": -1.0, "CDELT2": 1.0}
    at_pole = sky_at(spark, 1, 1, **base)[0]
    assert np.isclose(at_pole.dec, 90)
    down = sky_at(spark, 1, 0, **base)[0]  # below the pole is the reference point's own meridian, as LONPOLE is 0 there
    assert np.isclose(down.dec, 90 - np.rad2deg(np.arctan(np.deg2rad(1)))) and np.isclose(down.ra % 360, 210)
    flat = sky_at(spark, 11, 6, **(base | {"CTYPE1": "RA---CAR", "CTYPE2": "DEC--CAR", "CRVAL2": 0.0}))[0]
    assert np.isclose(flat.ra % 360, 20) and np.isclose(flat.dec, 5)
    turned = sky_at(spark, 2, 1, **(base | {"CRVAL2": 0.0, "CDELT1": -0.001, "CDELT2": 0.001, "CROTA2": 90.0}))[0]
    assert np.isclose(turned.ra, 30, atol=1e-9) and np.isclose(turned.dec, -0.001, atol=1e-9)
    assert sky_at(spark, 1, 1, **(base | {"CTYPE1": "RA---XPH"})) is None
    linear = sky_at(spark, 3, 1, **(base | {"CTYPE1": "RA", "CTYPE2": "DEC"}))[0]
    assert (linear.ra, linear.dec) == (28.0, 90.0)
    beyond = sky_at(spark, 500, 1, **(base | {"CTYPE1": "RA---SIN", "CTYPE2": "DEC--SIN", "CRVAL2": 10.0}))[0]
    assert beyond.dec is None or np.isnan(beyond.dec)
