"""Fields derived from a header, as one ordered list for each HDU; a header is a map from a card's key to its value as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metadata import STOKES, radio_velocity, sexagesimal


def header_maps(cards: DataFrame) -> DataFrame:
    """file, hdu, header of cards (file, hdu, card, key, value); of a key that repeats the first card counts.

    The map is made by the aggregation itself, so that a filter that Spark pushes below later steps doesn't make it anew.
    """
    some = cards.where("value IS NOT NULL AND key IS NOT NULL")
    every = F.array_sort(F.collect_list(F.struct("key", "card", "value")))  # an HDU's cards
    new = lambda c: F.filter(c, lambda e, i: (i == 0) | (F.get(c, i - 1)["key"] != e["key"]))
    header = F.map_from_entries(let({"c": every}, lambda v: F.transform(new(v["c"]), lambda e: F.struct(e["key"], e["value"]))))
    return some.groupBy("file", "hdu").agg(header.alias("header"))


def text(key: str | Column) -> Column:
    return F.try_element_at("header", F.lit(key) if isinstance(key, str) else key)


def number(key: str | Column) -> Column:
    return text(key).try_cast("double")


def axis_number(start: str) -> Column:
    """1-based number of the last axis whose type begins so; NULL without one, or where the first axis has no type."""
    axes = F.sequence(F.lit(1), F.greatest(F.lit(1), number("NAXIS").cast("int")))
    hits = F.filter(axes, lambda i: F.coalesce(F.startswith(text(F.concat(F.lit("CTYPE"), i.cast("string"))), F.lit(start)), F.lit(False)))
    return F.when(text("CTYPE1").isNotNull() & (number("NAXIS") > 0), F.array_max(hits))


def of_axis(name: str, axis: Column) -> Column:
    return F.concat(F.lit(name), axis.cast("string"))


def fixed(value: Column, places: int) -> Column:
    """A number to so many places, as it is in binary: format_string rounds the shortest decimal that stands for it once more."""
    whole = F.call_function("format_number", value, F.lit("0." + "0" * places))
    half = float(f"5e-{places + 1}")  # the one number that format_number takes for an exact half, whose first digit is rounded
    least = F.concat(F.when(value < 0, "-").otherwise(""), F.lit(f"{half:.{places}f}"))
    return F.when(F.abs(value) == half, least).when(F.abs(value) < float("inf"), whole).otherwise(F.format_string(f"%.{places}f", value))


def shown(value: Column, whole: Column | None = None) -> Column:
    """A number to the millionth, without zeros at its end but for one after the point; as an integer where `whole` holds."""
    point = F.when(value.isNotNull(), F.regexp_replace(F.regexp_replace(fixed(value, 6), "0+$", ""), r"\.$", ".0"))
    return point if whole is None else F.when(whole, value.cast("long").cast("string")).otherwise(point)


def is_whole(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[+-]?[0-9]+$"), F.lit(False))


# Projection codes by the native latitude of their reference point (FITS world coordinates, paper II).
ZENITHAL, CYLINDRICAL = ("TAN", "SIN", "ARC", "ZEA", "STG"), ("CAR", "CEA", "MER", "SFL", "AIT")


def let(values: dict[str, Column] | Column, then: Callable[[Column], Column]) -> Column:
    """then(values), where each value is computed once: an expression that uses a part often doesn't grow with that."""
    row = F.struct(*[v.alias(k) for k, v in values.items()]) if isinstance(values, dict) else values
    return F.get(F.transform(F.array(row), then), F.lit(0))


def plane_matrix(c: Column) -> dict[str, Column]:
    """Degrees on the plane of projection a pixel: of the CD matrix, else CDELT with the PC matrix, else CDELT turned by the
    latitude axis's CROTA. c: struct of the cards."""
    two = [(a, b) for a in ("ra", "dec") for b in ("ra", "dec")]
    has = lambda m: F.coalesce(*[c[f"{m}_{a}_{b}"] for a, b in two]).isNotNull()
    step = {a: F.coalesce(c[f"step_{a}"], F.lit(1.0)) for a in ("ra", "dec")}
    rho = F.radians(F.coalesce(c["crota"], F.lit(0.0)))
    turned = {("ra", "ra"): step["ra"] * F.cos(rho), ("ra", "dec"): -step["dec"] * F.sin(rho), ("dec", "ra"): step["ra"] * F.sin(rho), ("dec", "dec"): step["dec"] * F.cos(rho)}
    pc = lambda a, b: step[a] * F.coalesce(c[f"pc_{a}_{b}"], F.lit(float(a == b)))
    return {f"m_{a}_{b}": F.when(has("cd"), F.coalesce(c[f"cd_{a}_{b}"], F.lit(0.0))).when(has("pc"), pc(a, b)).otherwise(turned[a, b]) for a, b in two}


def native(p: Column, projection: Column) -> Column:
    """Native longitude phi and latitude theta (radians) of a place x, y (radians) on the plane of projection; NULL or NaN off it."""
    x, y, r, z, half = p["x"], p["y"], p["r"], p["z"], F.pi() / 2
    theta = {
        "TAN": F.atan2(F.lit(1.0), r), "SIN": F.acos(r), "ARC": half - r, "ZEA": half - 2 * F.asin(r / 2), "STG": half - 2 * F.atan(r / 2),
        "CAR": y, "SFL": y, "CEA": F.asin(y), "MER": 2 * F.atan(F.exp(y)) - half, "AIT": F.asin(y * z),
    }
    phi = {"CAR": x, "CEA": x, "MER": x, "SFL": x / F.nullif(F.cos(y), F.lit(0.0)), "AIT": 2 * F.atan2(z * x / 2, 2 * z * z - 1)}
    around = F.when(r == 0, 0.0).otherwise(F.atan2(x, -y))
    pick = lambda of: F.coalesce(*[F.when(projection == k, v) for k, v in of.items()])
    return F.struct(pick(phi | dict.fromkeys(ZENITHAL, around)).alias("phi"), pick(theta).alias("theta"))


def with_pole(h: Column, then: Callable[[Column], Column]) -> Column:
    """then(a struct of phi_p, ra_p, dec_p): native longitude of the celestial pole, and right ascension and declination of the
    native pole, in radians. h: struct of projection and ra0, dec0, lonpole, latpole (degrees, NULL where the header has none).
    """
    zenithal = h["projection"].isin(*ZENITHAL)
    default = F.when(h["dec0"] >= F.when(zenithal, 90.0).otherwise(0.0), 0.0).otherwise(180.0)
    start = {"zenithal": zenithal, "phi_p": F.radians(F.coalesce(h["lonpole"], default)), "d0": F.radians(h["dec0"]), "a0": F.radians(h["ra0"]), "wanted": F.radians(F.coalesce(h["latpole"], F.lit(90.0)))}

    # For a reference point on the native equator two native poles fit; the one on the sphere counts, or the one nearer LATPOLE.
    def two(q: Column) -> Column:
        level = F.abs(F.cos(q["phi_p"]))
        middle = F.when(F.cos(q["phi_p"]) >= 0, F.lit(0.0)).otherwise(F.pi())
        return let({"ratio": F.sin(q["d0"]) / F.greatest(level, F.lit(1e-300)), "middle": middle, "level": level}, lambda r: both(q, r))

    def both(q: Column, r: Column) -> Column:
        away = F.when(F.abs(r["ratio"]) <= 1 + 1e-10, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r["ratio"]))))  # none: such a pole doesn't exist
        return let({"up": r["middle"] + away, "down": r["middle"] - away}, lambda u: chosen(q, r, u))

    def chosen(q: Column, r: Column, u: Column) -> Column:
        turned = lambda v: F.when(v > F.pi() + 1e-12, v - 2 * F.pi()).when(v < -F.pi() - 1e-12, v + 2 * F.pi()).otherwise(v)
        valid = lambda v: F.abs(v) <= F.pi() / 2 + 1e-10
        near = lambda v: F.abs(q["wanted"] - v)
        either = let({"up": turned(u["up"]), "down": turned(u["down"])}, lambda t: F.when(valid(t["up"]) & (~valid(t["down"]) | (near(t["up"]) < near(t["down"]))), t["up"]).when(valid(t["down"]), t["down"]))
        found = F.when(q["zenithal"], q["d0"]).when((r["level"] < 1e-12) & (F.abs(q["d0"]) < 1e-12), q["wanted"]).otherwise(either)
        return let({"dec_p": found}, lambda e: placed(q, e["dec_p"]))

    def placed(q: Column, dec_p: Column) -> Column:
        pole, d0 = F.abs(dec_p) > F.pi() / 2 - 1e-10, q["d0"]
        side = F.atan2(F.sin(q["phi_p"]) / F.cos(d0), -F.sin(dec_p) * F.sin(d0) / (F.cos(dec_p) * F.cos(d0)))
        ra_p = (
            F.when(q["zenithal"] | (F.abs(d0) > F.pi() / 2 - 1e-10), q["a0"]).when(pole & (dec_p > 0), q["a0"] + q["phi_p"] - F.pi())
            .when(pole, q["a0"] - q["phi_p"]).otherwise(q["a0"] - side)
        )
        return let({"phi_p": q["phi_p"], "dec_p": dec_p, "ra_p": ra_p}, then)

    return let(start, two)


def celestial(n: Column, pole: Column) -> Column:
    """ra and dec (degrees) of native coordinates phi, theta."""
    turn, theta, dec_p = n["phi"] - pole["phi_p"], n["theta"], pole["dec_p"]
    parts = {
        "north": F.sin(theta) * F.sin(dec_p) + F.cos(theta) * F.cos(dec_p) * F.cos(turn), "aside": -F.cos(theta) * F.sin(turn),
        "to_pole": F.sin(theta) * F.cos(dec_p) - F.cos(theta) * F.sin(dec_p) * F.cos(turn),
    }
    level = lambda v: F.sqrt(v["to_pole"] * v["to_pole"] + v["aside"] * v["aside"])
    return let(parts, lambda v: F.struct(F.degrees(pole["ra_p"] + F.atan2(v["aside"], v["to_pole"])).alias("ra"), F.degrees(F.atan2(v["north"], level(v))).alias("dec")))


def sky(df: DataFrame, places: Column) -> DataFrame:
    """df plus sky, an array of struct<ra, dec> (degrees) of places, an array of struct<x, y> (1-based pixels).

    df: axis_values() of with_axes(). A projection that isn't known gives NULL, as does a pole that doesn't exist; none at
    all counts as linear.
    """
    at = lambda a: F.col(f"axis_{a}").cast("string")
    cards = {f"{n.lower()}_{a}_{b}": number(F.concat(F.lit(n), at(a), F.lit("_"), at(b))) for n in ("PC", "CD") for a in ("ra", "dec") for b in ("ra", "dec")}
    cards |= {"lonpole": number("LONPOLE"), "latpole": number("LATPOLE"), "crota": number(F.concat(F.lit("CROTA"), at("dec"))), "projection": F.regexp_extract("t_ra_CTYPE", "-([A-Z]+)$", 1)}
    cards |= {f"{k}_{a}": F.col(f"n_{a}_{c}") for a in ("ra", "dec") for k, c in (("step", "CDELT"), ("middle", "CRPIX"))} | {"ra0": F.col("n_ra_CRVAL"), "dec0": F.col("n_dec_CRVAL")}
    kept = ("projection", "ra0", "dec0", "lonpole", "latpole", "middle_ra", "middle_dec")

    def of_header(h: Column) -> Column:
        plane = lambda p, a: h[f"m_{a}_ra"] * (p["x"] - h["middle_ra"]) + h[f"m_{a}_dec"] * (p["y"] - h["middle_dec"])
        on_plane = F.transform(places, lambda p: F.struct(plane(p, "ra").alias("x"), plane(p, "dec").alias("y")))
        linear = F.transform(on_plane, lambda p: F.struct((h["ra0"] + p["x"]).alias("ra"), (h["dec0"] + p["y"]).alias("dec")))

        def measured(p: Column, pole: Column) -> Column:
            x, y = F.radians(p["x"]), F.radians(p["y"])
            polar = {"x": x, "y": y, "r": F.sqrt(x * x + y * y), "z": F.sqrt(1 - x * x / 16 - y * y / 4)}
            return let(polar, lambda q: let(native(q, h["projection"]), lambda n: celestial(n, pole)))

        bent = with_pole(h, lambda pole: F.transform(on_plane, lambda p: measured(p, pole)))
        return F.when(h["projection"] == "", linear).when(h["projection"].isin(*ZENITHAL, *CYLINDRICAL), bent)

    return df.withColumn("sky", let(cards, lambda c: let({k: c[k] for k in kept} | plane_matrix(c), of_header)))


# What is read from an axis, and of which axes; each a column, so that later steps refer to it by name.
_PARTS = {"ra": ("NAXIS", "CRPIX", "CRVAL", "CDELT"), "dec": ("NAXIS", "CRPIX", "CRVAL", "CDELT"), "freq": ("NAXIS", "CRPIX", "CRVAL", "CDELT"), "stokes": ("NAXIS", "CRPIX", "CRVAL", "CDELT")}


def axis_values(headers: DataFrame) -> DataFrame:
    """headers with axes plus t_<axis>_<part> (text) and n_<axis>_<part> (number) of every part of the four axes."""
    texts = {f"t_{axis}_{p}": text(of_axis(p, F.col(f"axis_{axis}"))) for axis, parts in _PARTS.items() for p in (*parts, "CTYPE")}
    df = headers.withColumns(texts)
    return df.withColumns({"n" + c[1:]: F.col(c).try_cast("double") for c in texts if not c.endswith("CTYPE")})


def spans(df: DataFrame) -> DataFrame:
    """axis_values plus ras and decs (degrees of the four corners' centres), low and high (ends of the spectral axis)."""
    ends = {a: (F.lit(1.0), F.col(f"n_{a}_NAXIS")) for a in ("ra", "dec")}
    df = sky(df, F.array(*[F.struct(x.alias("x"), y.alias("y")) for x in ends["ra"] for y in ends["dec"]]))
    first = lambda k, d: F.coalesce(F.col(f"n_freq_{k}"), F.lit(float(d)))
    end = lambda p: first("CRVAL", 0) + (p - first("CRPIX", 1)) * first("CDELT", 1)
    df = df.withColumns({"f_first": end(F.lit(1.0)), "f_last": end(F.col("n_freq_NAXIS"))})
    return df.withColumns({"ras": F.transform("sky", lambda p: sexagesimal(p["ra"], True)), "decs": F.array_sort("sky.dec"), "low": F.least("f_first", "f_last"), "high": F.greatest("f_first", "f_last")})


def computed_entries() -> Column:
    """array<struct<name, value, type, number>> in a fixed order from the columns of spans(); what can't be told is left out."""
    pair = lambda a, b, unit="": F.concat(F.lit("["), a, F.lit(f"{unit}, "), b, F.lit(f"{unit}]"))
    axes = F.sequence(F.lit(1), F.greatest(F.lit(1), number("NAXIS").cast("int")))
    shape = F.transform(axes, lambda i: F.coalesce(text(of_axis("NAXIS", i)), F.lit("0")))
    names = F.transform(axes, lambda i: F.coalesce(F.trim(F.split(text(of_axis("CTYPE", i)), "-")[0]), F.lit("N/A")))
    plain = lambda c: shown(F.col(f"n_{c}"), is_whole(F.col(f"t_{c}")))
    equinox = F.when(number("EQUINOX").isNull(), text("EQUINOX")).otherwise(
        F.concat(F.when(number("EQUINOX") < 2000, "B").otherwise("J"), shown(number("EQUINOX"), is_whole(text("EQUINOX"))))
    )
    low, high, rest = F.col("low"), F.col("high"), F.coalesce(number("RESTFRQ"), number("RESTFREQ"))
    scale = F.when(high > 1e9, 1e9).when(high > 1e6, 1e6).otherwise(1.0)
    unit = F.when(high > 1e9, " (GHz)").when(high > 1e6, " (MHz)").otherwise(" (Hz)")
    four = lambda v: F.when(v.isNotNull(), fixed(v, 4))
    three = lambda c: F.when(F.col(c).isNotNull(), fixed(F.col(c), 3))
    of_pol = lambda k: F.coalesce(F.col(f"n_stokes_{k}"), F.lit(1.0))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce(F.col("n_stokes_NAXIS"), F.lit(1.0)).cast("int")))
    known = F.create_map(*[x for k, v in STOKES.items() for x in (F.lit(k), F.lit(v))])
    coverage = F.array_compact(F.transform(places, lambda i: F.try_element_at(known, (of_pol("CRVAL") + (i - of_pol("CRPIX")) * of_pol("CDELT")).cast("int"))))
    on_sky = F.forall("decs", lambda d: d.isNotNull() & ~F.isnan(d)) & F.forall("ras", lambda a: a.isNotNull())
    freq, pol = F.col("axis_freq").isNotNull(), F.col("axis_stokes").isNotNull()
    fields = [
        ("Name", F.element_at(F.split("file", "/"), -1)), ("HDU", F.col("hdu").cast("string")), ("Extension name", text("EXTNAME")),
        ("Data type", F.when(number("BITPIX") < 0, "float").otherwise("int")),
        ("Shape", F.concat(F.lit("["), F.array_join(shape, ", "), F.lit("] ("), F.array_join(names, ", "), F.lit(")"))),
        ("Number of channels", F.when(freq, F.coalesce("t_freq_NAXIS", F.lit("0")))), ("Number of polarizations", F.when(pol, F.coalesce("t_stokes_NAXIS", F.lit("0")))),
        ("Coordinate type", F.lit("Right Ascension, Declination")), ("Projection", F.regexp_replace("t_ra_CTYPE", "RA---", "")),
        ("Image reference pixels", pair(plain("ra_CRPIX"), plain("dec_CRPIX"))),
        ("Image reference coords", pair(sexagesimal(F.col("n_ra_CRVAL"), True, 4), sexagesimal(F.col("n_dec_CRVAL"), False, 4))),
        ("Image ref coords (deg)", pair(three("n_ra_CRVAL"), three("n_dec_CRVAL"), " deg")),
        ("Pixel increment", F.concat(shown(F.col("n_ra_CDELT") * 3600), F.lit('", '), shown(F.col("n_dec_CDELT") * 3600), F.lit('"'))),
        ("Pixel unit", text("BUNIT")), ("Celestial frame", F.concat_ws(", ", text("RADESYS"), equinox)), ("Spectral frame", text("SPECSYS")),
        ("Velocity definition", F.when(number("VELREF") > 256, "RADIO").when(number("VELREF").isNotNull(), "OPTICAL")),
        ("Restoring beam", F.concat(shown(number("BMAJ") * 3600), F.lit('" X '), shown(number("BMIN") * 3600), F.lit('", '), shown(number("BPA"), is_whole(text("BPA"))), F.lit(" deg"))),
        ("RA range", F.when(on_sky, pair(F.array_min("ras"), F.array_max("ras")))),
        ("DEC range", F.when(on_sky, pair(sexagesimal(F.get("decs", F.lit(0)), False), sexagesimal(F.get("decs", F.lit(3)), False)))),
        ("Frequency range", F.when(freq, F.concat(pair(four(low / scale), four(high / scale)), unit))),
        ("Velocity range", F.when(freq, F.concat(pair(four(radio_velocity(low, rest)), four(radio_velocity(high, rest))), F.lit(" (km/s)")))),
        ("Stokes coverage", F.when(pol & (F.size(coverage) > 0), F.concat(F.lit("["), F.array_join(coverage, ", "), F.lit("]")))),
    ]
    whole = ("Number of channels", "Number of polarizations")
    entries = []
    for name, v in fields:
        made = F.struct(F.lit(name).alias("name"), v.alias("value"), F.lit("INT" if name in whole else "STRING").alias("type"), (v.try_cast("double") if name in whole else F.lit(None).cast("double")).alias("number"))
        entries.append(made)
    return F.filter(F.array(*entries), lambda e: e["value"].isNotNull())


def with_axes(headers: DataFrame) -> DataFrame:
    """headers plus axis_ra, axis_dec, axis_freq, axis_stokes (1-based numbers of axes)."""
    return headers.withColumns({f"axis_{k.lower()}": axis_number(k) for k in ("RA", "DEC", "FREQ", "STOKES")})


def file_info_extended(headers: DataFrame) -> DataFrame:
    """A row an HDU that holds an image: dimensions, width, height, depth, stokes, numbers of axes, and the computed entries.

    headers: file, hdu, header. HDUs without axes and tables are left out.
    """
    some = headers.where((number("NAXIS") > 0) & ~F.coalesce(F.trim(text("XTENSION")), F.lit("")).isin("BINTABLE", "TABLE"))
    some = spans(axis_values(with_axes(some)))
    size = lambda axis: F.coalesce(F.col(f"n_{axis}_NAXIS").cast("int"), F.lit(1))
    return some.select(
        "file", "hdu", number("NAXIS").cast("int").alias("dimensions"), number("NAXIS1").cast("int").alias("width"), number("NAXIS2").cast("int").alias("height"),
        size("freq").alias("depth"), size("stokes").alias("stokes"), F.lit(1).alias("spatial_x"), F.lit(2).alias("spatial_y"),
        F.col("axis_freq").alias("spectral_axis"), F.col("axis_stokes").alias("stokes_axis"), computed_entries().alias("entries"),
    )
