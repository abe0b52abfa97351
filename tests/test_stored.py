"""Stored pyramids, histogram sketches, slab streams, session machines, chunk plans and exports against brute force."""

import itertools
import os
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumencube.operators import metadata as M
from lumencube.operators import planes as P
from lumencube.operators import regions as R
from lumencube.operators import sketches as Z
from lumencube.plans.registry import CATALOGUE
from lumencube.sources import blocks, cubes, files, pyramid
from lumencube.streaming import sessions, slabs
from lumencube.streaming import streams as S


def cube_of(seed, shape, gaps=0.2):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=shape).astype(np.float32)
    out[rng.random(shape) < gaps] = np.nan
    return out


def pixels_of(spark, cube):
    return spark.createDataFrame([(c, y, x, float(v)) for (c, y, x), v in np.ndenumerate(cube)], "channel int, y int, x int, v double")


def means_of(plane, f):
    h, w = plane.shape
    out = np.full((-(-h // f) * f, -(-w // f) * f), np.nan)
    out[:h, :w] = plane
    out = out.reshape(out.shape[0] // f, f, -1, f)
    n = np.isfinite(out).sum((1, 3))
    return np.where(n > 0, np.nansum(out, (1, 3)) / np.maximum(n, 1), np.nan)


def same_means(found, cube, f):
    got = np.full((len(cube), *means_of(cube[0], f).shape), np.nan)
    rows = found.collect()
    assert len(rows) == got.size
    for r in rows:
        got[r.channel, r.y, r.x] = np.nan if r.v is None else r.v
    assert np.allclose(got, np.stack([means_of(p, f) for p in cube]), equal_nan=True, atol=1e-9)


def scanned_files(df):
    """Files that the scans of a plan without shuffles read."""
    df.collect()
    leaves, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "numFiles" in str(node.metrics().keys()):
            leaves += node.metrics().apply("numFiles").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return leaves


def test_pyramid_is_kept_up_to_date(spark, tmp_path):
    path, size = str(tmp_path / "p"), 8
    cube = cube_of(1, (2, 150, 130))
    cube[0, :40, :40] = np.nan
    made = pyramid.write(spark, blocks.to_blocks(pixels_of(spark, cube), ["channel"], size), path, ["channel"], size)
    assert made == 6  # 19 x 17 squares, halved until one is left
    for f in (1, 2, 4, 6, 32, 64):
        same_means(pyramid.means(spark, path, ["channel"], f, size=size), cube, f)
    for version in (1, 2):
        cube[1, 16:24, 40:48] = version * 10 + cube_of(version, (8, 8), 0.1)
        if version == 2:
            cube[0, 144:150, 128:130] = 5.0
        changed = pixels_of(spark, cube).where("(channel = 1 AND y >= 16 AND y < 24 AND x >= 40 AND x < 48)" + (" OR (channel = 0 AND y >= 144 AND x >= 128)" if version == 2 else ""))
        assert pyramid.update(spark, blocks.to_blocks(changed, ["channel"], size), path, ["channel"], size) == version
        # The changed squares and their ancestors alone are written.
        for k in range(made):
            stored = spark.read.parquet(f"{path}/version={version}/level={k}").select("channel", "by", "bx").collect()
            want = {(1, 2 >> k, 5 >> k)} | ({(0, 18 >> k, 16 >> k)} if version == 2 else set())
            assert {tuple(r) for r in stored} == want and len(stored) == len(want)
        for f in (1, 2, 4, 6, 32, 64):
            same_means(pyramid.means(spark, path, ["channel"], f, size=size), cube, f)
    box = pyramid.means(spark, path, ["channel"], 2, (33, 10, 61, 31), size).collect()
    whole = np.stack([means_of(p, 2) for p in cube])
    assert {(r.channel, r.y, r.x) for r in box} == {(c, y, x) for c in (0, 1) for y in range(5, 16) for x in range(16, 31)}
    assert all((r.v is None and np.isnan(whole[r.channel, r.y, r.x])) or np.isclose(r.v, whole[r.channel, r.y, r.x]) for r in box)


def test_pyramid_of_planes_that_lack_rows(spark, tmp_path):
    # Plane 1 ends at row 9, plane 2 lacks rows 8 to 11: cells without pixels have no row, those without values have NULL.
    path, size, cube = str(tmp_path / "p"), 8, cube_of(9, (3, 24, 24))
    cube[1, :4, :4] = np.nan
    px = pixels_of(spark, cube).where("NOT (channel = 1 AND y > 8) AND NOT (channel = 2 AND y BETWEEN 8 AND 11)")
    pyramid.write(spark, blocks.to_blocks(px, ["channel"], size), path, ["channel"], size)
    for f in (1, 2, 4, 12):
        got = {(r.channel, r.y, r.x): r.v for r in pyramid.means(spark, path, ["channel"], f, size=size).collect()}
        want = {}
        for r in px.collect():
            want.setdefault((r.channel, r.y // f, r.x // f), []).append(r.v)
        assert set(got) == set(want)
        for k, values in want.items():
            values = [v for v in values if np.isfinite(v)]
            assert (got[k] is None) == (not values) and (not values or np.isclose(got[k], np.mean(values)))


def test_pyramid_reads_near_files_alone(spark, tmp_path):
    path, size = str(tmp_path / "p"), 8
    pyramid.write(spark, blocks.to_blocks(pixels_of(spark, cube_of(2, (1, 256, 256))), ["channel"], size), path, ["channel"], size)
    every = sum(len([f for f in names if f.endswith(".parquet")]) for _, _, names in os.walk(f"{path}/version=0/level=0"))
    near = pyramid.level(spark, path, 0, ["channel"], F.col("zone").between(3, 3))
    assert every == 16 and scanned_files(near) == 1
    plan = pyramid.means(spark, path, ["channel"], 1, (8, 8, 24, 24), size)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(zone" in plan and "PushedFilters: [IsNotNull(z)" in plan.replace("IsNotNull(bx), ", "").replace("IsNotNull(by), ", "")


def test_unmarked_versions_do_not_count(spark, tmp_path):
    path, size = str(tmp_path / "p"), 8
    cube = cube_of(3, (1, 20, 20))
    pyramid.write(spark, blocks.to_blocks(pixels_of(spark, cube), ["channel"], size), path, ["channel"], size)
    os.makedirs(f"{path}/version=1/level=0")
    assert pyramid.versions(path) == [0]
    same_means(pyramid.means(spark, path, ["channel"], 4, size=size), cube, 4)
    none = pixels_of(spark, cube).where("false")
    assert pyramid.write(spark, blocks.to_blocks(none, ["channel"], size), str(tmp_path / "none"), ["channel"], size) == 1
    assert pyramid.means(spark, str(tmp_path / "none"), ["channel"], 2, size=size).count() == 0


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-9, 5.0), (1e12, -3e12)])
def test_sketches_merge_exactly_and_bound_their_error(spark, tmp_path, scale, shift):
    cube = cube_of(4, (3, 60, 70)).astype(float) * scale + shift
    cube[1] = np.where(np.isfinite(cube[1]), 2.5, np.nan)  # a constant plane
    cube[2] = np.nan
    cube[0, 0, :3] = np.inf, -np.inf, np.nan
    cube = cube.astype(np.float32).astype(float)
    px = pixels_of(spark, cube)
    counts = {}
    for size, name in ((16, "a"), (64, "b")):
        made = Z.sketches(blocks.to_blocks(px, ["channel"], size), ["channel"], 128)
        made.write.parquet(str(tmp_path / name))
        made = spark.read.schema(made.schema).parquet(str(tmp_path / name))
        merged = Z.merged(made, ["channel"], 128)
        counts[size] = sorted((r.channel, r.exponent, r.number, r["count"]) for r in merged.collect())
        whole = Z.merged(made, [], 128).collect()
        assert sum(r["count"] for r in whole) == np.isfinite(cube).sum() and len({r.exponent for r in whole}) == 1
    assert counts[16] == counts[64]  # however the blocks are cut
    for c, e, k, n in counts[16]:
        assert n == (np.floor(np.ldexp(cube[c][np.isfinite(cube[c])], -e)) == k).sum()
    exact = {(r.channel, r.bin): r.n for r in P.histogram(px, ["channel"]).collect()}
    about = {(r.channel, r.bin): r for r in Z.histogram(merged, ["channel"]).collect()}
    for key in exact.keys() | about.keys():
        n, r = exact.get(key, 0), about.get(key)
        assert r is not None and r.least <= n <= r.most and r.least - 1e-6 <= r.n <= r.most + 1e-6
    assert np.isclose(sum(r.n for r in about.values()), np.isfinite(cube).sum())


def test_histogram_scans_pixels_once(spark, tmp_path):
    px = pixels_of(spark, cube_of(5, (1, 20, 20)))
    px.write.parquet(str(tmp_path / "px"))
    made = Z.sketches(blocks.to_blocks(spark.read.parquet(str(tmp_path / "px")), ["channel"], 16), ["channel"])
    assert made._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_slabs_as_a_stream(spark):
    px = spark.createDataFrame([(c, 0, 0, float(c)) for c in range(23)], "channel int, y int, x int, v double")
    read = lambda a, z: R.region_stats(P.slab(px, channel=(a, z)), F.lit(True), ["channel"])
    out = slabs.progressive(spark, 23, read, target_ms=1e9, first=4).collect()
    assert sorted(r.channel for r in out) == list(range(23)) and {(r.first, r.last) for r in out} == {(0, 4), (4, 23)} and {r.batch for r in out} == {0, 1}
    one = slabs.progressive(spark, 3, read, target_ms=1e-9, first=1).collect()
    assert sorted((r.first, r.last) for r in one) == [(0, 1), (1, 2), (2, 3)] and all(r.n == 1 and r.mean == r.channel for r in one)
    assert slabs.progressive(spark, 0, read).count() == 0


def test_slab_source_goes_on_where_it_was(tmp_path):
    options = {"channels": "50", "size": "10", "target": "1e9", "memory": str(tmp_path / "m")}
    first = slabs.SlabReader(options)
    assert first.initialOffset() == {"at": 0} and first.latestOffset() == {"at": 10}
    again = slabs.SlabReader(options)
    assert again.latestOffset() == {"at": 20} and again.latestOffset() == {"at": 50} and again.latestOffset() == {"at": 50}
    assert [list(again.read(p)) for p in again.partitions({"at": 10}, {"at": 20})] == [[(10, 20)]] and list(again.read(slabs.Range(3, 3))) == []


def test_slabs_grow_where_every_batch_has_a_fixed_cost(spark, tmp_path):
    options = {"channels": "2000", "size": "4", "target": "1000", "memory": str(tmp_path / "m"), "took": str(tmp_path / "t")}
    reader = slabs.SlabReader(options)
    assert reader.latestOffset() == {"at": 4}
    for took, at in ((3000, 12), (3100, 25), (6500, 28), (2500, 52)):  # of which 2500 are those of an empty slab
        (tmp_path / "t").write_text(f"[{took}, 2500]")
        assert reader.latestOffset() == {"at": at}
    px = spark.createDataFrame([(c, 0, 0, float(c)) for c in range(60)], "channel int, y int, x int, v double")

    def read(a, z):
        time.sleep(0.6)
        return R.region_stats(P.slab(px, channel=(a, z)), F.lit(True), ["channel"])

    out = slabs.progressive(spark, 60, read, target_ms=500, first=2).collect()
    assert sorted(r.channel for r in out) == list(range(60)) and len({r.batch for r in out}) < 25


@pytest.fixture
def short(spark, tmp_path):
    """Channel 0, and 15 rows of channel 1."""
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 65").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_components_of_a_plane_that_lacks_rows(spark, short):
    whole = cubes.whole(spark.read.parquet(f"{short}/embeddings.parquet")).collect()
    assert sorted(r.vec_id for r in whole) == list(range(100)) and all((sum(map(abs, r.embedding)) == 0) == (r.vec_id >= 65) and len(r.embedding) == 64 for r in whole)
    got = {tuple(r) for r in CATALOGUE["gaussian_components"].run(spark, short).collect()}
    assert got == {r for c in (0, 1) for r in ((c, 0, 6, 14 + c, 12 + c, 5, 2, 2, 0, True), (c, 1, 4, 45 - c, 34, 6, 3, -3, 0, True))}


def test_lines_of_a_plane_that_lacks_rows(spark, short):
    # Row 14 of channel 1 is its last one, and cuts the line round the first source; the second one is below.
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{short}/embeddings.parquet/*.parquet'")
    want = {r[0]: r for r in db.execute(CATALOGUE["contour_lines"].sql).fetchall()}
    got = {r.channel: tuple(r) for r in CATALOGUE["contour_lines"].run(spark, short).collect()}
    assert got == want and set(got) == {0, 1} and got[0][2:4] == got[1][2:4] == (2, 2) and got[1][4] < got[0][4] / 2


MINUTE = 60_000_000


def test_session_machine(spark, tmp_path):
    at = lambda m: (10_000 + m) * MINUTE
    rows = [  # session, minute, id, kind, key, value; in four batches
        [(1, 0, 1, "cursor", 0, 10), (1, 5, 2, "region", 3, 0), (1, 6, 3, "region", 4, 0), (2, 1, 4, "require", 7, 0), (3, 2, 5, "cursor", 0, 1)],
        [(1, 9, 6, "remove", 3, 0), (1, 8, 7, "region", 3, 0), (2, 12, 8, "require", 7, 0), (2, 12, 9, "require", 8, 0)],  # an older command comes after a removal
        [(1, 60, 10, "cursor", 0, 99), (2, 41, 11, "cursor", 0, 5)],
        [(4, 200, 12, "region", 1, 0)],
    ]
    schema = "session long, ts timestamp, id long, kind string, key long, value long"
    for k, part in enumerate(rows):
        df = spark.createDataFrame([(s, m, i, kind, key, v) for s, m, i, kind, key, v in part], "session long, m long, id long, kind string, key long, value long")
        df.selectExpr("session", "timestamp_micros((10000 + m) * 60000000) AS ts", "id", "kind", "key", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "c"))
    sizes, target = [], str(tmp_path / "out")
    with sessions.keyed_state(spark):
        q = sessions.summaries(stream, 30).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        q = q.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{target}/batch={k}")).start()
        q.awaitTermination()
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "")
    got = sorted(tuple(r)[:8] for r in spark.read.parquet(target).select("session", "start", "stop", "commands", "cursor", "requirements", "regions", "removed").collect())
    assert got == [
        (1, at(0), at(39), 5, 10, 0, 1, 1), (1, at(60), at(90), 1, 99, 0, 0, 0), (2, at(1), at(71), 4, 5, 2, 0, 0), (3, at(2), at(32), 1, 1, 0, 0, 0),
    ]
    assert max(sizes) > sizes[-1]  # what the ended sessions held is gone


def plain_chunks(shape, chunks, index):
    """Chunks that a request meets, by going through every place."""
    axes = []
    for n, c, (start, stop, scalar) in zip(shape, chunks, index):
        places = [start] if scalar else list(range(start or 0, min(n, n if stop is None else stop)))
        own = []
        for k in sorted({p // c for p in places}):
            here = [i for i, p in enumerate(places) if p // c == k]
            own.append((k, (places[here[0]] - k * c, places[here[-1]] - k * c + 1), (here[0], here[-1] + 1)))
        axes.append(own)
    return sorted((".".join(str(a[0]) for a in combo), [a[1] for a in combo], [a[2] for a in combo]) for combo in itertools.product(*axes))


def test_chunk_plans_of_all_dimensions(spark):
    rng = np.random.default_rng(9)
    rows = [(0, [10, 10], [4, 4], [(3, 9, False), (5, None, True)])]
    for i in range(1, 60):
        dims = int(rng.integers(1, 6))
        shape, chunks = rng.integers(1, 30, dims).tolist(), rng.integers(1, 12, dims).tolist()
        index = []
        for n in shape:
            a, z = sorted(rng.integers(0, n + 3, 2).tolist())
            index.append([(int(rng.integers(0, n)), None, True), (None, None, False), (a, z, False), (a, None, False)][rng.integers(0, 4)])
        rows.append((i, shape, chunks, index))
    df = spark.createDataFrame(rows, "id int, shape array<int>, chunks array<int>, index array<struct<start:int,stop:int,scalar:boolean>>")
    got = {}
    for r in M.chunk_plan(df).collect():
        assert list(map(str, r.coords)) == r.chunk_id.split(".")
        got.setdefault(r.id, []).append((r.chunk_id, [tuple(s) for s in r.chunk_slice], [tuple(s) for s in r.out_slice]))
    for i, shape, chunks, index in rows:
        assert sorted(got.get(i, [])) == plain_chunks(shape, chunks, index), i


def test_export_in_several_files(spark, tmp_path):
    rows = [(i, "RECTANGLE" if i % 2 else "POINT", i + 0.5, 2.0, 3.0 if i % 2 else None, 4.0 if i % 2 else None, "#2EE6D6", 1) for i in range(1, 401)]
    regions = spark.createDataFrame(rows, "region_id long, type string, cx double, cy double, w double, h double, color string, line_width int").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        M.write_regions(regions, str(tmp_path / "r"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    written = sorted(f for f in os.listdir(tmp_path / "r") if f.startswith("part-"))
    full = [f for f in written if os.path.getsize(tmp_path / "r" / f)]
    assert len(full) > 1 and all(open(tmp_path / "r" / f).readline() == "#CRTFv0\n" for f in full)
    back = files.import_regions(files.region_lines(spark, str(tmp_path / "r"))).orderBy("region_id").collect()
    assert [(r.region_id, r.type, r.cx, r.w) for r in back] == [(i, t, x, w) for i, t, x, _, w, *_ in rows]


def test_replay_in_many_files(spark):
    df = spark.range(1000).selectExpr("id AS k", "id * 2 AS v", "if(id % 50 = 0, null, id) AS ord")
    stream = S.replay(df, "ord", parts=3, rows_per_file=70)
    out = S.land(stream, "append")
    got = out.groupBy("batch").agg(F.count("*").alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi")).orderBy("batch").collect()
    assert sum(r.n for r in got) == 1000 and len(got) == 3 and all(a.hi < b.lo for a, b in zip(got, got[1:]))
    assert S.land(S.replay(df.where("false"), "ord"), "append").count() == 0
