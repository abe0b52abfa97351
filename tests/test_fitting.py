"""Gaussian components and smoothing against brute force."""

import numpy as np

from lumencube.operators import fitting as G
from lumencube.operators.smoothing import gaussian
from lumencube.sources import blocks


def test_derivatives():
    p = np.array([3.0, 4.2, 5.1, 2.0, 1.3, 0.4, -1.5, 9.0, 2.0, 1.1, 3.0, -0.7, 0.25])
    x, y = (a.ravel().astype(float) for a in np.meshgrid(np.arange(12), np.arange(9)))
    value, j = G.model(p, x, y)
    for k in range(len(p)):
        step = np.zeros(len(p))
        step[k] = 1e-6
        assert np.allclose((G.model(p + step, x, y)[0] - G.model(p - step, x, y)[0]) / 2e-6, j[:, k], atol=1e-7)


def test_planted_sources_come_back(spark):
    rng = np.random.default_rng(2)
    x, y = np.meshgrid(np.arange(60.0), np.arange(50.0))
    rows, starts, want = [], [], {}
    for c in range(4):
        p = np.array([5.0, 18 + c, 20, 5, 2.5, 0.6, 3.0, 38, 30 - c, 6, 3, -0.9, 0.5])
        v = G.model(p, x.ravel(), y.ravel())[0].reshape(x.shape) + rng.normal(0, 0.02, x.shape)
        v[rng.random(x.shape) < 0.1] = np.nan
        rows += [(c, int(b), int(a), float(v[b, a])) for b in range(50) for a in range(60)]
        want[c] = p
        guess = [tuple(float(q + d) for q, d in zip(g, (-1.0, 2.0, -1.5, -1.0, 0.5, 0.2))) for g in p[:-1].reshape(-1, 6)]
        starts.append((c, guess, 0.0))
    rows += [(9, 0, 0, 1.0), (9, 0, 1, 2.0)]  # fewer pixels than parameters
    starts += [(9, starts[0][1], 0.0), (7, starts[0][1], 0.0)]  # and a group without pixels
    px = spark.createDataFrame(rows, "channel int, y int, x int, v double")
    start = spark.createDataFrame(starts, "channel int, components array<struct<amplitude: double, x: double, y: double, sigma_x: double, sigma_y: double, angle: double>>, background double")
    made = blocks.to_blocks(px, ["channel"], 16)
    got = {(r.channel, r.component): r for r in G.fit(made, start, ["channel"]).collect()}
    assert set(got) == {(c, k) for c in (0, 1, 2, 3, 9) for k in (0, 1)}
    for c, p in want.items():
        for k, g in enumerate(p[:-1].reshape(-1, 6)):
            r = got[c, k]
            assert r.converged and abs(r.rms - 0.02) < 0.002 and abs(r.background - 0.5) < 0.01 and r.rounds < 30
            assert np.allclose([r.amplitude, r.x, r.y, r.sigma_x, r.sigma_y], g[:5], atol=0.03) and abs(r.angle - np.rad2deg(g[5])) < 1
    assert not got[9, 0].converged
    assert G.fit(made.where("false"), start, ["channel"]).count() == 0


def test_smoothing_equals_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    cube = rng.normal(size=(2, 37, 43)).astype(np.float32)
    cube[rng.random(cube.shape) < 0.3] = np.nan
    cube[1, :20, :20] = np.nan
    cube[0, 5, 5] = np.inf
    px = spark.createDataFrame([(c, y, x, float(v)) for (c, y, x), v in np.ndenumerate(cube)], "channel int, y int, x int, v double")
    for sigma, size, reach in ((1.0, 16, 3.0), (2.5, 8, 3.0), (0.4, 64, 2.0)):
        r = int(np.ceil(reach * sigma))
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        wide = np.full((2, 37 + 2 * r, 43 + 2 * r), np.nan)
        wide[:, r:-r, r:-r] = cube
        got = {(p.channel, p.y, p.x): p.v for p in blocks.pixels(gaussian(blocks.to_blocks(px, ["channel"], size), ["channel"], sigma, size, reach), ["channel"]).collect()}
        assert len(got) == cube.size
        for (c, y, x), v in got.items():
            part = wide[c, y : y + 2 * r + 1, x : x + 2 * r + 1].astype(float)
            w = np.outer(k, k) * np.isfinite(part)
            want = (np.where(np.isfinite(part), part, 0) * w).sum() / w.sum() if w.sum() > 1e-12 else np.nan
            assert np.isclose(v, want, atol=1e-9, equal_nan=True)


def test_smoothing_reaches_all_of_the_image(spark):
    # Rows 17 to 40 and 46 on aren't there: places up to the kernel's radius beside the others have values all the same.
    cube = np.random.default_rng(5).normal(size=(1, 50, 20)).astype(np.float32)
    cube[:, 17:41], cube[:, 46:] = np.nan, np.nan
    px = spark.createDataFrame([(c, y, x, float(v)) for (c, y, x), v in np.ndenumerate(cube) if np.isfinite(v)], "channel int, y int, x int, v double")
    found = blocks.pixels(gaussian(blocks.to_blocks(px, ["channel"], 16), ["channel"], 1.0, 16, shape=(50, 20)), ["channel"]).collect()
    got = {(p.y, p.x): p.v for p in found if np.isfinite(p.v)}
    assert set(got) == {(y, x) for y in range(50) if y < 20 or 38 <= y < 49 for x in range(20)}
    k = np.exp(-0.5 * np.arange(-3, 4) ** 2.0)
    wide = np.pad(cube[0].astype(float), 3, constant_values=np.nan)
    for (y, x), v in got.items():
        part, w = wide[y : y + 7, x : x + 7], np.outer(k, k)
        assert np.isclose(v, np.nansum(part * w) / (w * np.isfinite(part)).sum(), atol=1e-9)
