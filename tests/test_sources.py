"""FITS and Zarr files, listings and region files against what was written."""

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lumencube.operators import headers as H
from lumencube.sources import codecs, cubes, files, fits, zarr
from lumencube.sources.store import write_file
from lumencube.streaming import streams as S

SF = "/root/testdata/sf0.001"


def header(**keys):
    text = b"".join(fits._card(k, v) for k, v in keys.items()) + b"END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880)


def block(a):
    b = a.tobytes()
    return b.ljust(-(-len(b) // 2880) * 2880, b"\0")


def test_scaled_integers_with_blanks_after_an_empty_unit(spark, tmp_path):
    data = np.arange(2 * 3 * 4 * 5, dtype=">i2").reshape(2, 3, 4, 5)  # stokes, channel, y, x
    data[0, 0, 0, 1] = -32768
    primary = header(SIMPLE=True, BITPIX=8, NAXIS=0)
    keys = {"XTENSION": "IMAGE", "BITPIX": 16, "NAXIS": 4, "NAXIS1": 5, "NAXIS2": 4, "NAXIS3": 3, "NAXIS4": 2, "CTYPE3": "FREQ", "CTYPE4": "STOKES"}
    (tmp_path / "a.fits").write_bytes(primary + header(**keys, BSCALE=0.5, BZERO=10.0, BLANK=-32768) + block(data))
    (tmp_path / "notes.txt").write_text("not an image")
    px = fits.pixels(spark, str(tmp_path))
    assert px.count() == data.size
    out = {(r.stokes, r.channel, r.y, r.x): r.v for r in px.where("channel = 2 and y >= 1 and y < 3").collect()}
    assert len(out) == 2 * 2 * 5
    assert all(v == data[k] * 0.5 + 10 for k, v in out.items())
    assert np.isnan(px.where("stokes = 0 and channel = 0 and y = 0 and x = 1").first().v)
    cards = {(r.hdu, r.key): (r.value, r.type) for r in fits.cards(spark, str(tmp_path)).collect()}
    assert cards[0, "NAXIS"] == ("0", "INT") and cards[1, "BSCALE"] == ("0.5", "FLOAT") and cards[1, "CTYPE3"] == ("FREQ", "STRING")


def test_filters_choose_partitions():
    reader = fits.PixelReader({"path": "/nowhere"})
    kept = list(reader.pushFilters([fits.D.GreaterThan(("channel",), 4), fits.D.LessThan(("channel",), 9), fits.D.EqualTo(("y",), 3), fits.D.EqualTo(("v",), 1.5)]))
    assert len(kept) == 4 and reader.ranges == {"channel": (5, 9), "y": (3, 4)}


def test_small_bands_read_every_row_once(spark, tmp_path):
    data = np.random.default_rng(1).normal(size=(3, 7, 6)).astype(">f4")
    (tmp_path / "c.fits").write_bytes(header(SIMPLE=True, BITPIX=-32, NAXIS=3, NAXIS1=6, NAXIS2=7, NAXIS3=3) + block(data))
    fits.register(spark)
    px = spark.read.format("fits").option("band_mb", 48 / (1 << 20)).load(str(tmp_path / "c.fits"))
    assert px.rdd.getNumPartitions() > 5
    assert {(r.channel, r.y, r.x): np.float32(r.v) for r in px.collect()} == {k: np.float32(v) for k, v in np.ndenumerate(data)}
    assert px.count() == data.size


def test_cards():
    assert fits.parse_card("OBJECT  = 'it''s / here'  / a name".ljust(80)) == ("OBJECT", "it's / here", "STRING", "a name")
    assert fits.parse_card("EXPO    =              1.5D+03".ljust(80))[:3] == ("EXPO", "1.5E+03", "FLOAT")
    assert fits.parse_card("NOTHING =                      / none".ljust(80)) == ("NOTHING", None, None, "none")
    assert fits.parse_card("HISTORY was made".ljust(80)) == ("HISTORY", None, None, "was made")


BLOSC = [{"id": "blosc", "cname": c, "shuffle": k, "blocksize": b} for c in ("lz4", "snappy", "zlib", "zstd") for k, b in ((0, 0), (1, 0), (2, 1200), (-1, 4000))]


@pytest.mark.parametrize("codec", [None, "zlib", "zstd", "lz4", {"id": "blosc", "cname": "lz4", "shuffle": 1, "clevel": 5, "blocksize": 0}, {"id": "blosc", "cname": "zstd", "shuffle": 2, "blocksize": 1000}])
def test_zarr_round_trip_and_pruning(spark, tmp_path, codec):
    px = cubes.emb3d(spark, SF).selectExpr("0 AS time", "0 AS stokes", "channel", "y", "x", "v")
    path = str(tmp_path / "a.zarr")
    written = zarr.write(px, path, {"time": 1, "channel": 10, "stokes": 1, "y": 50, "x": 64}, {"time": 1, "channel": 3, "stokes": 1, "y": 20, "x": 64}, codec=codec).collect()
    assert len(written) == 4 * 3 and zarr.is_zarr(path)
    back = zarr.pixels(spark, path)
    assert back.count() == 10 * 50 * 64
    assert back.where("not isnan(v)").select(*px.columns).exceptAll(px.selectExpr(*[f"CAST({c} AS INT) {c}" for c in px.columns if c != "v"], "v").select(*px.columns)).count() == 0
    os.remove(f"{path}/SKY/0.0.0.0.0")  # a chunk that isn't there has the fill value; one outside the range is not opened
    open(f"{path}/SKY/0.1.0.0.0", "wb").write(b"broken")
    assert zarr.pixels(spark, path, channel=(6, 8), y=(19, 21)).count() == 2 * 2 * 64
    some = zarr.pixels(spark, path, channel=(0, 3))
    assert some.count() == 3 * 50 * 64 and some.where("isnan(v)").count() == some.where("y < 20").count() == 3 * 20 * 64
    assert zarr.pixels(spark, path, channel=(2, 3), y=(18, 22), x=(60, 64)).groupBy("y").count().count() == 4
    assert zarr.pixels(spark, path, channel=(3, 3)).count() == 0


def test_other_codecs_are_refused(tmp_path):
    meta = {"shape": [1], "chunks": [1], "dtype": "<f4", "compressor": {"id": "pcodec"}}
    write_file(f"{tmp_path}/b.zarr/SKY/.zarray", json.dumps(meta).encode())
    with pytest.raises(ValueError, match="pcodec"):
        zarr.describe(f"{tmp_path}/b.zarr")


@pytest.mark.parametrize("config", BLOSC + [{"id": c} for c in ("lz4", "zlib", "gzip", "zstd", "bz2", "lzma")], ids=str)
@pytest.mark.parametrize("width", [1, 4, 8])
def test_codecs_give_back_what_they_take(config, width):
    rng = np.random.default_rng(1)
    smooth = np.cumsum(rng.integers(0, 3, 3001)).astype("<i8").tobytes()
    for raw in (b"", b"abc", smooth, smooth[:4096], smooth[: 4096 * width], rng.bytes(5000), bytes(70_000)):
        assert codecs.plain(codecs.packed(raw, config, width), config) == raw


def test_blosc_containers_made_by_hand():
    """Blocks that are split or not, plain and compressed streams, a shorter last block, shuffles, all by other means than the writer."""
    values = np.arange(300, dtype="<i4") * 70_001
    raw = values.tobytes()
    lz4 = lambda b: pa.Codec("lz4_raw").compress(b).to_pybytes()
    whole = lambda parts: b"".join(len(p).to_bytes(4, "little") + p for p in parts)

    def container(flags, block, blocks):
        starts, at = [], 16 + 4 * len(blocks)
        for b in blocks:
            starts.append(at)
            at += len(b)
        return struct.pack("<BBBBIII", 2, 1, flags, 4, len(raw), block, at) + struct.pack(f"<{len(starts)}I", *starts) + b"".join(blocks)

    bytes_of = lambda v: [bytes(v.tobytes()[k::4]) for k in range(4)]
    planes = bytes_of(values)
    assert codecs.blosc_plain(container(1 | 1 << 5, 1200, [whole([lz4(planes[0]), lz4(planes[1]), planes[2], lz4(planes[3])])])) == raw  # split, one stream plain
    assert codecs.blosc_plain(container(1 | 16 | 3 << 5, 1200, [whole([zlib.compress(b"".join(planes))])])) == raw  # never split
    a, b = values[:160], values[160:]
    assert codecs.blosc_plain(container(1 | 1 << 5, 640, [whole([lz4(p) for p in bytes_of(a)]) if 160 >= 128 else b"", whole([lz4(b"".join(bytes_of(b)))])])) == raw  # the last block is whole
    bits = lambda v: np.array([[x >> k & 1 for x in v.astype("<u4")] for k in range(32)], np.uint8)
    packed = lambda v: b"".join(sum(int(r[8 * j + i]) << i for i in range(8)).to_bytes(1, "little") for r in bits(v) for j in range(len(v) // 8))
    half = values[:160]
    rest = values[160:]  # 140 values don't come in eights: as they are
    assert codecs.blosc_plain(container(4 | 16 | 1 << 5, 640, [whole([lz4(packed(half))]), whole([lz4(rest.tobytes())])])) == raw
    assert codecs.blosc_plain(struct.pack("<BBBBIII", 2, 1, 2 | 1, 4, len(raw), 1200, 16 + len(raw)) + raw) == raw
    for broken in (b"", struct.pack("<BBBBIII", 5, 1, 0, 4, 4, 4, 20) + bytes(8), container(1 | 1 << 5, 1200, [b""])[:18]):
        with pytest.raises((ValueError, struct.error)):
            codecs.blosc_plain(broken)


def test_blosclz_streams_made_by_hand():
    assert codecs.blosclz_plain(bytes([3]) + b"abcd" + bytes([1 << 5, 3]), 7) == b"abcdabc"  # three bytes from four back
    assert codecs.blosclz_plain(bytes([0]) + b"x" + bytes([7 << 5, 255, 10, 0]), 1 + 9 + 265) == b"x" * 275  # a long run
    far = bytes(range(256)) * 40
    literals = b"".join(bytes([31]) + far[k : k + 32] for k in range(0, len(far), 32))
    back = len(far) - 1 - 0x1FFF  # to the very first byte
    stream = literals + bytes([(2 << 5) | 31, 255, back >> 8, back & 255]) + bytes([1]) + b"yz"
    assert codecs.blosclz_plain(stream, len(far) + 6) == far + far[:4] + b"yz"
    with pytest.raises(ValueError, match="before the block"):
        codecs.blosclz_plain(bytes([0]) + b"x" + bytes([1 << 5, 9]), 4)


def test_zarr_cards_and_sparse_chunks(spark, tmp_path):
    px = cubes.emb3d(spark, SF).where("channel = 0 AND y < 20").selectExpr("0 AS time", "0 AS stokes", "channel", "y", "x", "v")
    path, cards = str(tmp_path / "s.zarr"), {"CTYPE1": "RA---TAN", "CRVAL1": 187.25, "CRVAL2": -12.5, "CDELT1": -0.001, "CDELT2": 0.001, "CRPIX1": 33.0, "CRPIX2": 20.5, "PC1_1": 0.8, "PC1_2": -0.6, "PC2_1": 0.6, "PC2_2": 0.8}
    cards |= {"CRVAL4": 1.4e9, "CDELT4": 5e5, "RESTFRQ": 1.42e9, "SPECSYS": "BARYCENT", "BUNIT": "Jy/beam", "RADESYS": "ICRS", "BMAJ": 0.004, "BMIN": 0.002, "BPA": 15.0, "MJD-OBS": 59000.75, "TIMESYS": "UTC", "TELESCOP": "DISH"}
    zarr.write(px, path, {"time": 1, "channel": 1, "stokes": 1, "y": 50, "x": 64}, {"time": 1, "channel": 1, "stokes": 1, "y": 20, "x": 64}, cards=cards, sparse=True).collect()
    assert [n for n in os.listdir(f"{path}/SKY") if n[0] != "."] == ["0.0.0.0.0"]
    assert zarr.pixels(spark, path).count() == 50 * 64 and zarr.pixels(spark, path).where("not isnan(v)").count() == 20 * 64
    got = zarr.headers(spark.createDataFrame([(path,)], "file string")).first().header
    for k, v in cards.items():
        if k != "CDELT4":  # one channel has no step
            assert got[k] == v if isinstance(v, str) else np.isclose(float(got[k]), v, rtol=1e-12), k
    assert got["DATE-OBS"] == "2020-05-31T18:00:00.000" and np.isclose(float(got["PIX_AREA"]), 1e-6) and got["NAXIS4"] == "1"


def test_zarr_header_of_one_pixel_axes(spark, tmp_path):
    path = str(tmp_path / "o.zarr")
    zarr.write_attributes(path, {"x": 1, "y": 4, "stokes": 1, "channel": 1, "time": 1}, {"CDELT1": -0.01, "CDELT2": 0.01, "CRPIX2": 9.0, "BUNIT": "K"})
    write_file(f"{path}/SKY/.zarray", json.dumps({"shape": [1, 1, 1, 1, 4], "chunks": [1] * 5, "dtype": "<f8", "compressor": None}).encode())
    got = zarr.headers(spark.createDataFrame([(path,)], "file string")).first().header
    assert np.isclose(float(got["CDELT1"]), 0.01) and np.isclose(float(got["CRPIX2"]), 9.0) and got["BITPIX"] == "-64" and "DATE-OBS" not in got and "BMAJ" not in got


def test_region_files_and_listing(spark, tmp_path):
    (tmp_path / "a.crtf").write_text("#CRTFv0\ncenterbox [[10.0pix, 20.5pix], [4.0pix, 6.0pix]] color=#2ee6d6, linewidth=2\nellipse [[1pix, 2pix]]\n")
    (tmp_path / "b.crtf").write_text("#CRTFv0\nsymbol [[3.0pix, 7.0pix], .] color=#ff0000\nsymbol [[3.0pix, 7.0pix], .] color=#ff0000\n")
    (tmp_path / "c.reg").write_text("# Region file format: DS9\nbox(1,2,3,4)\n")
    (tmp_path / "empty.reg").write_text("")
    lines = files.region_lines(spark, str(tmp_path))
    kinds = {r.file.rsplit("/", 1)[1]: r.kind for r in files.region_kinds(lines).collect()}
    assert kinds["a.crtf"] == kinds["b.crtf"] == "CRTF" and kinds["c.reg"] == "DS9_REG" and kinds.get("empty.reg", "UNKNOWN") == "UNKNOWN"
    got = files.import_regions(lines, 7).orderBy("region_id").collect()
    assert [(r.region_id, r.type) for r in got] == [(8, "RECTANGLE"), (9, "POINT"), (10, "POINT")]
    info = files.folder_info(files.listing(spark, str(tmp_path))).collect()
    assert len(info) == 1 and info[0]["items"] == 4 and info[0].bytes == sum(f.stat().st_size for f in tmp_path.iterdir())
    write_file(f"{tmp_path}/d.zarr/SKY/0.0", b"12345")
    write_file(f"{tmp_path}/d.zarr/.zattrs", b"{}")
    write_file(f"{tmp_path}/.hidden", b"x")
    found = {r.name: (r.type, r.bytes) for r in files.entries(files.listing(spark, str(tmp_path))).collect()}
    assert found["d.zarr"] == ("CASA", 7) and found["empty.reg"] == ("DS9_REG", 0) and ".hidden" not in found and len(found) == 5
    assert files.listing(spark, f"{tmp_path}/none").count() == 0


def test_state_over_many_batches(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(4).write.parquet(str(tmp_path / "e"))
    stream = S.files(spark, str(tmp_path / "e"), per_batch=1)
    seen = S.land(S.first_seen(stream), "update")
    last = S.latest(seen, ["user_id", "event_type"], ["batch"])
    want = e.groupBy("user_id", "event_type").agg({"ts": "min"}).count()
    assert seen.select("batch").distinct().count() == 4 and last.count() == want
    wrong = last.join(e.selectExpr("user_id", "event_type", "unix_micros(CAST(ts AS TIMESTAMP)) AS t"), ["user_id", "event_type"]).where("t < at").count()
    assert wrong == 0


def zarr_group(path, nested=False, new=True):
    """A small cube with coordinates, directions and a beam: 1 time, 4 frequencies, 1 polarisation, 5 x 6 places."""
    def array(name, data, attributes=None, chunks=None, names=None):
        data = np.asarray(data)
        meta = {"zarr_format": 2, "shape": data.shape, "chunks": chunks or data.shape, "dtype": data.dtype.str, "order": "C", "compressor": None, "filters": None, "fill_value": 0}
        if nested:
            meta["dimension_separator"] = "/"
        write_file(f"{path}/{name}/.zarray", json.dumps(meta).encode())
        write_file(f"{path}/{name}/.zattrs", json.dumps((attributes or {}) | ({"_ARRAY_DIMENSIONS": names} if names else {})).encode())
        step = chunks or data.shape
        for at in np.ndindex(*(-(-n // c) for n, c in zip(data.shape, step))):
            piece = np.zeros(step, data.dtype)
            own = data[tuple(slice(a * c, a * c + c) for a, c in zip(at, step))]
            piece[tuple(slice(0, n) for n in own.shape)] = own
            write_file(f"{path}/{name}/{('/' if nested else '.').join(map(str, at))}", piece.tobytes())

    way = {"reference": {"attrs": {"frame": "fk5", "equinox": "J2000.0"}, "data": [1.0, -0.5]}, "projection": "SIN"}
    way |= {"latpole": {"data": 0.1}, "lonpole": {"data": np.pi}, "pc": {"_value": [[1.0, 0.0], [0.0, 1.0]]}} if new else {"latpole": {"value": 0.1}, "lonpole": {"value": np.pi}, "pc": [[1.0, 0.0], [0.0, 1.0]]}
    data = np.arange(4 * 5 * 6, dtype="<f4").reshape(1, 4, 1, 5, 6)
    sky = {"units": ["Jy/beam"], "obsdate": {"data": 59000.5, "attrs": {"format": "MJD", "scale": "utc"}}, "telescope": {"name": "DISH"}}
    array("SKY", data, sky | ({} if new else {"direction_info": way, "user": {"bmaj": 0.002, "bmin": 0.001, "bpa": 30.0}}), (1, 2, 1, 3, 4), ["time", "frequency", "polarization", "l", "m"])
    ref = {"data": 1.4e9, "attrs": {"units": ["Hz"], "observer": "lsrk"}}
    array("frequency", 1.4e9 + 1e6 * np.arange(4.0), {"reference_value": ref, "rest_frequency": {"data": 1.42e9}})
    array("l", (np.arange(5.0) - 2) * -1e-5)
    array("m", (np.arange(6.0) - 3) * 1e-5)
    array("polarization", np.array([1]))
    array("time", np.array([59000.5]), {"units": ["d"]})
    if new:
        array("BEAM", np.deg2rad([[[[0.002, 0.001, 30.0]]]]))
    write_file(f"{path}/.zattrs", json.dumps({"direction": way} if new else {}).encode())
    return data


@pytest.mark.parametrize("nested, new", [(False, True), (True, False)])
def test_zarr_headers_and_nested_chunks(spark, tmp_path, nested, new):
    path = str(tmp_path / "c.zarr")
    data = zarr_group(path, nested, new)
    got = {(r.channel, r.x, r.y): r.v for r in zarr.pixels(spark, path).collect()}
    assert got == {(c, l, m): v for (_, c, _, l, m), v in np.ndenumerate(data)}
    assert zarr.pixels(spark, path, channel=(2, 3), x=(1, 4)).count() == 3 * 6
    cubes_at = spark.createDataFrame([(path,)], "file string")
    texts = zarr.headers(cubes_at).first().header
    h = {k: (float(v) if re.fullmatch(r"[-+0-9.E]+", v) else v) for k, v in texts.items()}
    assert (h["NAXIS1"], h["NAXIS2"], h["NAXIS4"], h["CTYPE1"], h["BITPIX"], h["RADESYS"]) == (5, 6, 4, "RA---SIN", -32, "FK5")
    assert (h["CRPIX1"], h["CRPIX2"], h["CDELT4"], h["BUNIT"], h["SPECSYS"], h["TELESCOP"]) == (3.0, 4.0, 1e6, "Jy/beam", "LSRK", "DISH")
    assert np.isclose(h["BMAJ"], 0.002) and np.isclose(h["BPA"], 30) and np.isclose(h["CRVAL2"], np.rad2deg(-0.5)) and np.isclose(h["PIX_AREA"], np.rad2deg(1e-5) ** 2)
    info = H.file_info_extended(zarr.headers(cubes_at)).first()
    entries = {e.name: e.value for e in info.entries}
    assert (info.width, info.height, info.depth, info.spectral_axis) == (5, 6, 4, 4) and entries["Frequency range"] == "[1.4000, 1.4030] (GHz)"
    assert entries["Restoring beam"] == '7.2" X 3.6", 30.0 deg' and entries["Celestial frame"] == "FK5, J2000.0" and entries["Shape"].endswith("(RA, DEC, STOKES, FREQ, TIME)")
    assert not zarr.is_casa(path)


def test_all_images_of_a_file(spark, tmp_path):
    one, two = np.arange(6, dtype=">f4").reshape(2, 3), np.arange(8, dtype=">i2").reshape(2, 2, 2)
    sky = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRVAL1": 10.5, "CRVAL2": 0.0, "CRPIX1": 1, "CRPIX2": 1, "CDELT1": -0.001, "CDELT2": 0.001}
    parts = header(SIMPLE=True, BITPIX=-32, NAXIS=2, NAXIS1=3, NAXIS2=2, **sky) + block(one)
    parts += header(XTENSION="BINTABLE", BITPIX=8, NAXIS=2, NAXIS1=4, NAXIS2=3, PCOUNT=0, GCOUNT=1, TFIELDS=0) + block(np.zeros(12, "u1"))
    parts += header(XTENSION="IMAGE", BITPIX=16, NAXIS=3, NAXIS1=2, NAXIS2=2, NAXIS3=2, EXTNAME="SECOND", CTYPE1="X", CTYPE2="Y", CTYPE3="FREQ") + block(two)
    (tmp_path / "m.fits").write_bytes(parts)
    path = str(tmp_path)
    assert {(r.y, r.x): r.v for r in fits.pixels(spark, path).collect()} == dict(np.ndenumerate(one))
    assert {(r.channel, r.y, r.x): r.v for r in fits.pixels(spark, path, nth=1, channel=(1, 2)).collect()} == {(1, y, x): v for (c, y, x), v in np.ndenumerate(two) if c == 1}
    assert fits.pixels(spark, path, nth=1, y=(5, 9)).count() == 0 and fits.pixels(spark, str(tmp_path), nth=7).count() == 0
    info = H.file_info_extended(H.header_maps(fits.cards(spark, path))).orderBy("hdu").collect()
    assert [(r.hdu, r.dimensions, r.width, r.height, r.depth) for r in info] == [(0, 2, 3, 2, 1), (2, 3, 2, 2, 2)]
    first, second = ({e.name: e.value for e in r.entries} for r in info)
    assert first["Image reference coords"] == "[00:42:00.0000, +00:00:00.0000]" and first["RA range"] == "[00:41:59.520, 00:42:00.000]" and first["DEC range"] == "[+00:00:00.000, +00:00:03.600]"
    assert second["Extension name"] == "SECOND" and second["Data type"] == "int" and "RA range" not in second


def test_listings_below_sub_folders(spark, tmp_path):
    for name in ("a/b/x.fits", "a/y.txt", "c/z.reg", "top.fits"):
        write_file(f"{tmp_path}/{name}", b"12")
    got = {r.path.removeprefix(f"{tmp_path}/"): r.bytes for r in files.listing(spark, str(tmp_path)).collect()}
    assert got == {"a/b/x.fits": 2, "a/y.txt": 2, "c/z.reg": 2, "top.fits": 2}
    assert files.is_accessible(str(tmp_path)) and not files.is_accessible(f"{tmp_path}/none")


def test_odd_files_are_listed_and_the_others_read(spark, tmp_path):
    good = header(SIMPLE=True, BITPIX=-32, NAXIS=2, NAXIS1=3, NAXIS2=2) + block(np.arange(6, dtype=">f4"))
    odd = header(SIMPLE=True, BITPIX=-32, NAXIS=6, NAXIS1=1, NAXIS2=1, NAXIS3=2, NAXIS4=2, NAXIS5=2, NAXIS6=2) + block(np.arange(16, dtype=">f4"))
    (tmp_path / "good.fits").write_bytes(good)
    (tmp_path / "odd.fits").write_bytes(odd)
    (tmp_path / "text.fits").write_bytes(b"no card at all")
    found = {r.file.rsplit("/", 1)[1]: r for r in fits.index(spark, str(tmp_path)).collect()}
    assert found["good.fits"].problem is None and (found["good.fits"].width, found["good.fits"].height) == (3, 2)
    assert "more axes" in found["odd.fits"].problem and found["odd.fits"].width is None
    assert sorted(r.v for r in fits.pixels(spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 4, 5]
