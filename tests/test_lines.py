"""Contour lines against the geometry of their fields."""

import numpy as np

from lumencube.operators import overlays as O
from lumencube.operators.lines import lines
from lumencube.sources import blocks


def lines_of(spark, cube, levels, size):
    px = spark.createDataFrame([(c, y, x, float(v)) for (c, y, x), v in np.ndenumerate(cube)], "channel int, y int, x int, v double")
    found = {}
    for r in lines(blocks.to_blocks(px, ["channel"], size), ["channel"], levels).collect():
        found.setdefault((r.channel, r.level, r.line, r.closed), {})[r.place] = (r.at_y, r.at_x)
    return px, found


def test_rings_and_open_lines(spark):
    y, x = np.meshgrid(np.arange(40.0), np.arange(52.0), indexing="ij")
    disc = 10 - np.hypot(y - 19.3, x - 24.1)
    two = np.maximum(6 - np.hypot(y - 12, x - 12), 7 - np.hypot(y - 25, x - 38))
    ramp = x * 1.0 + 0.01 * y  # open lines from border to border
    rng = np.random.default_rng(3)
    noise = rng.normal(size=y.shape).astype(np.float32).astype(float)
    noise[rng.random(y.shape) < 0.05] = np.nan
    cube = np.stack([disc, two, ramp, noise]).astype(np.float32).astype(float)
    px, found = lines_of(spark, cube, [2.5, 0.05], 8)
    for (c, level, _, closed), places in found.items():
        assert sorted(places) == list(range(len(places)))  # every place once
        at = np.array([places[k] for k in range(len(places))])
        gap = np.abs(np.diff(at, axis=0)).max(1, initial=0)
        assert (gap <= 1 + 1e-9).all()  # neighbours on the line share a square
        if closed:
            assert len(at) >= 4 and np.abs(at[0] - at[-1]).max() <= 1 + 1e-9
    kinds = lambda c, level: sorted(k[3] for k in found if k[0] == c and k[1] == level)
    assert kinds(0, 2.5) == kinds(0, 0.05) == [True] and kinds(1, 2.5) == [True, True] and kinds(2, 2.5) == kinds(2, 0.05) == [False]
    ring = next(p for k, p in found.items() if k[:2] == (0, 2.5))
    at = np.array([ring[k] for k in range(len(ring))])
    assert np.abs(np.hypot(at[:, 0] - 19.3, at[:, 1] - 24.1) - 7.5).max() < 0.05
    turn = np.diff(np.unwrap(np.arctan2(at[:, 0] - 19.3, at[:, 1] - 24.1)))
    assert (turn > 0).all() or (turn < 0).all()  # in order round the disc
    # All crossings that lie on a square with four corners are on a line, once.
    want = {(r.channel, r.level, round(r.at_y, 9), round(r.at_x, 9)) for r in O.contour_crossings(px.where("channel < 3"), [2.5, 0.05], ["channel"]).collect()}
    got = [(c, level, round(a, 9), round(b, 9)) for (c, level, _, _), p in found.items() if c < 3 for a, b in p.values()]
    assert set(got) == want and len(got) == len(want)


def test_planes_without_lines(spark):
    for cube in (np.full((1, 9, 9), np.nan), np.zeros((1, 9, 9))):
        assert not lines_of(spark, cube, [0.5], 4)[1]
