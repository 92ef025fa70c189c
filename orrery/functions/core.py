"""Scalar expressions of the domain: time, photometry, sphere, pixels, hashing, text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero points of FLUXCAL and PSF flux, softening factor, five-sigma depths of bands u, g, r, i, z, Y.
FLUXCAL_ZP, PSFFLUX_ZP, SOFTENING_K = 27.5, 31.4, 1.0
M5 = (23.9, 25.0, 24.7, 24.0, 23.3, 22.1)
BANDS = ("u", "g", "r", "i", "z", "Y")
FLUX_FACTOR = 10 ** (0.4 * (PSFFLUX_ZP - FLUXCAL_ZP))
POGSON = 2.5 / math.log(10)
#: Days from MJD 0 to 1970-01-01.
EPOCH_MJD = 40587


def mjd(ts: Column) -> Column:
    """Modified Julian date of a timestamp without zone, exact to a microsecond."""
    return micros(ts) / F.lit(8.64e10)


def micros(ts: Column) -> Column:
    """Microseconds since MJD 0."""
    return F.timestamp_diff("MICROSECOND", F.lit("1858-11-17 00:00:00").cast("timestamp_ntz"), ts)


#: GPS seconds from which TAI - UTC - 19 s has each value.
LEAPS = (
    (0, 0), (46828800, 1), (78364801, 2), (109900802, 3), (173059203, 4), (252028804, 5), (315187205, 6), (346723206, 7), (393984007, 8),
    (425520008, 9), (457056009, 10), (504489610, 11), (551750411, 12), (599184012, 13), (820108813, 14), (914803214, 15), (1025136015, 16), (1119744016, 17), (1167264017, 18),
)


def gps_to_mjd(gps: Column) -> Column:
    """UTC as MJD of GPS seconds, leap seconds included."""
    leap = F.lit(0)
    for start, seconds in LEAPS:
        leap = F.when(gps >= start, F.lit(seconds)).otherwise(leap)
    return F.lit(44244.0) + (gps - leap) / F.lit(86400.0)


def asinh(x: Column) -> Column:
    """Odd form: the built-in one loses large negative arguments."""
    return F.signum(x) * F.asinh(F.abs(x))


def softening(m5: Column | float, k: float = SOFTENING_K) -> Column:
    """Luptitude softening b from a five-sigma depth, in PSF flux units."""
    return F.lit(k) * F.pow(F.lit(10.0), F.lit(0.4) * (F.lit(PSFFLUX_ZP) - m5)) / F.lit(5.0)


def luptitude(flux: Column, b: Column) -> Column:
    return F.lit(PSFFLUX_ZP) - F.lit(POGSON) * (asinh(flux / (F.lit(2.0) * b)) + F.ln(b))


def luptitude_error(flux: Column, error: Column, b: Column) -> Column:
    return F.lit(POGSON) * error / F.sqrt(flux * flux + F.lit(4.0) * b * b)


def luptitude_to_flux(mag: Column, b: Column) -> Column:
    return F.lit(2.0) * b * F.sinh((F.lit(PSFFLUX_ZP) - mag) / F.lit(POGSON) - F.ln(b))


def snr(flux: Column, error: Column) -> Column:
    """Flux over error; null unless both are finite and the error is positive."""
    return F.when(finite(flux) & finite(error) & (error > 0), flux / error)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def band_index(token: Column) -> Column:
    """Index of a band token such as ``LSST-r``; Y and y are the same, case matters else; null if unknown."""
    name = F.regexp_replace(F.trim(token), "^LSST-", "")
    place = F.array_position(F.array(*[F.lit(b) for b in BANDS]), name)
    return F.when(name == "y", 5).otherwise(F.when(place > 0, place - 1)).cast("int")


def unit_vector(ra: Column, dec: Column, *, degrees: bool = True) -> tuple[Column, Column, Column]:
    a, d = (F.radians(ra), F.radians(dec)) if degrees else (ra, dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def ra_dec(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    r = F.sqrt(x * x + y * y + z * z)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / r))))


def uniq_order(uniq: Column) -> Column:
    """HEALPix order of a NUNIQ number."""
    return (F.floor(F.log2(uniq / F.lit(4.0)) / F.lit(2.0))).cast("int")


def uniq_pixel(uniq: Column, order: Column) -> Column:
    return uniq - F.lit(4).cast("long") * F.pow(F.lit(4.0), order).cast("long")


def pixel_area_deg2(order: Column) -> Column:
    return F.lit(4 * math.pi * (180 / math.pi) ** 2) / (F.lit(12.0) * F.pow(F.lit(4.0), order))


def _let(x: Column, then) -> Column:
    """``then`` of x, with x evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(x), then), 1)


def ang2pix_ring(nside: int, ra: Column, dec: Column) -> Column:
    """HEALPix RING pixel of a position in degrees."""
    return _let(F.struct(F.sin(F.radians(dec)).alias("z"), (F.pmod(ra, F.lit(360.0)) / F.lit(90.0)).alias("tt")), lambda v: _ring(nside, v["z"], v["tt"]))


def _ring(nside: int, z: Column, tt: Column) -> Column:
    n = float(nside)
    t1, t2 = F.lit(n) * (F.lit(0.5) + tt), F.lit(n * 0.75) * z
    jp, jm = F.floor(t1 - t2), F.floor(t1 + t2)
    ir = F.lit(nside + 1) + jp - jm
    shift = F.when(ir % 2 == 0, 1).otherwise(0)
    ip = F.pmod(F.floor((jp + jm - F.lit(nside) + shift + 1) / 2), F.lit(4 * nside))
    belt = F.lit(2 * nside * (nside - 1)) + (ir - 1) * F.lit(4 * nside) + ip
    tp = tt - F.floor(tt)
    tmp = F.lit(n) * F.sqrt(F.lit(3.0) * (F.lit(1.0) - F.abs(z)))
    cp, cm = F.floor(tp * tmp), F.floor((F.lit(1.0) - tp) * tmp)
    ring = cp + cm + 1
    step = F.least(F.floor(tt * ring), 4 * ring - 1)
    cap = F.when(z > 0, 2 * ring * (ring - 1) + step).otherwise(F.lit(12 * nside * nside) - 2 * ring * (ring + 1) + step)
    return F.when(F.abs(z) <= F.lit(2 / 3), belt).otherwise(cap).cast("long")


def hash32(key: Column) -> Column:
    """The first four bytes of SHA-256 of a string, as a number; equal in any engine."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def uniform(key: Column) -> Column:
    """A draw in [0, 1) that depends on the key alone."""
    return hash32(key) / F.lit(4294967296.0)


def key_of(*parts: Column | str | int) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def in_bins(x: Column, edges: list[float], *, last_closed: bool = True) -> Column:
    """Number of the half-open bin of x; the last bin is closed on demand; null outside."""
    out = F.lit(None).cast("int")
    for k, (a, b) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        upper = x <= b if last_closed and k == len(edges) - 2 else x < b
        out = F.when((x >= a) & upper, F.lit(k)).otherwise(out)
    return out


#: For each of the twelve base pixels, its row and column on the sphere.
FACE_ROW = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
FACE_COLUMN = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)
MOST_ORDER = 29


def _spread(x: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of x at every second place."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out + F.shiftleft(F.shiftright(x, k).bitwiseAND(1), 2 * k)
    return out


def _gather(x: Column, bits: int) -> Column:
    """Every second bit of x."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out + F.shiftleft(F.shiftright(x, 2 * k).bitwiseAND(1), k)
    return out


def ang2pix_nest(order: int, ra: Column, dec: Column) -> Column:
    """HEALPix NEST pixel of a position in degrees."""
    return _let(F.struct(F.sin(F.radians(dec)).alias("z"), (F.pmod(ra, F.lit(360.0)) / F.lit(90.0)).alias("tt")), lambda v: _nest(order, v["z"], v["tt"]))


def _nest(order: int, z: Column, tt: Column) -> Column:
    nside = 1 << order
    t1, t2 = F.lit(float(nside)) * (F.lit(0.5) + tt), F.lit(nside * 0.75) * z
    jp, jm = F.floor(t1 - t2), F.floor(t1 + t2)
    fp, fm = F.shiftright(jp, order), F.shiftright(jm, order)
    face = F.when(fp == fm, fp.bitwiseOR(4)).when(fp < fm, fp).otherwise(fm + 8)
    x, y = jm.bitwiseAND(nside - 1), F.lit(nside - 1) - jp.bitwiseAND(nside - 1)
    quarter = F.least(F.lit(3).cast("long"), F.floor(tt))
    tp, edge = tt - quarter, F.lit(float(nside)) * F.sqrt(F.lit(3.0) * (F.lit(1.0) - F.abs(z)))
    cp, cm = F.least(F.floor(tp * edge), F.lit(nside - 1).cast("long")), F.least(F.floor((F.lit(1.0) - tp) * edge), F.lit(nside - 1).cast("long"))
    polar = F.abs(z) > F.lit(2 / 3)
    face = F.when(polar, F.when(z >= 0, quarter).otherwise(quarter + 8)).otherwise(face)
    x = F.when(polar, F.when(z >= 0, nside - 1 - cm).otherwise(cp)).otherwise(x)
    y = F.when(polar, F.when(z >= 0, nside - 1 - cp).otherwise(cm)).otherwise(y)
    place = F.struct(face.cast("long").alias("f"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    return _let(place, lambda v: v["f"] * (nside * nside) + _spread(v["x"], order) + F.shiftleft(_spread(v["y"], order), 1))


def pix2ang_nest(order: Column | int, pixel: Column, most: int = MOST_ORDER) -> tuple[Column, Column]:
    """Right ascension and declination in degrees of a NEST pixel's centre; orders may differ by row, up to ``most``."""
    order = F.lit(order) if isinstance(order, int) else order
    nside = F.pow(F.lit(2.0), order).cast("long")
    at = F.struct(nside.alias("n"), F.floor(pixel / (nside * nside)).cast("int").alias("f"), (pixel - F.floor(pixel / (nside * nside)) * nside * nside).alias("i"))
    at = _let(at, lambda v: F.struct(v["n"].alias("n"), v["f"].alias("f"), _gather(v["i"], most).alias("x"), _gather(F.shiftright(v["i"], 1), most).alias("y")))
    angles = _let(at, lambda v: _centre(v["n"], v["f"], v["x"], v["y"]))
    return angles["ra"], angles["dec"]


def _centre(nside: Column, face: Column, x: Column, y: Column) -> Column:
    row = F.element_at(F.array(*[F.lit(v) for v in FACE_ROW]), face + 1) * nside - x - y - 1
    north, south = row < nside, row > 3 * nside
    ring = F.when(north, row).when(south, 4 * nside - row).otherwise(nside)
    cap = 1 - ring * ring / (F.lit(3.0) * nside * nside)
    z = F.when(north, cap).when(south, -cap).otherwise((2 * nside - row) * 2 / (F.lit(3.0) * nside))
    shift = F.when(north | south, F.lit(0).cast("long")).otherwise((row - nside).bitwiseAND(1))
    place = F.floor((F.element_at(F.array(*[F.lit(v) for v in FACE_COLUMN]), face + 1) * ring + x - y + 1 + shift) / 2)
    place = F.when(place > 4 * ring, place - 4 * ring).when(place < 1, place + 4 * ring).otherwise(place)
    return F.struct(((place - (shift + 1) * F.lit(0.5)) * (F.lit(90.0) / ring)).alias("ra"), F.degrees(F.asin(z)).alias("dec"))


def pix2ang_ring(nside: int, pixel: Column) -> tuple[Column, Column]:
    """Right ascension and declination in degrees of a RING pixel's centre."""
    cap, every = 2 * nside * (nside - 1), 12 * nside * nside
    back = F.lit(every) - pixel
    ring_of = lambda x: F.floor((F.lit(1.0) + F.sqrt(x)) / 2)
    n, s = ring_of(2.0 * pixel + 1), ring_of(2.0 * back - 1)
    belt = F.floor((pixel - cap) / (4 * nside)) + nside
    column = F.pmod(pixel - cap, F.lit(4 * nside)) + 1
    half = F.when((belt + nside) % 2 == 1, 1.0).otherwise(0.5)
    third = F.lit(3.0 * nside * nside)
    north, south = pixel < cap, pixel >= every - cap
    z = F.when(north, 1 - n * n / third).when(south, s * s / third - 1).otherwise((2 * nside - belt) * 2 / F.lit(3.0 * nside))
    ra = F.when(north, (pixel + 1 - 2 * n * (n - 1) - 0.5) * 90.0 / n).when(south, (4 * s + 1 - (back - 2 * s * (s - 1)) - 0.5) * 90.0 / s).otherwise((column - half) * 90.0 / nside)
    return ra, F.degrees(F.asin(z))


#: The increment and the two multipliers of SplitMix64.
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _times64(x: Column, by: int) -> Column:
    """Product modulo 2**64 of a long (as bits) and a constant: four products of 32 bits, none of which overflows a decimal."""
    low, high = x.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(x, 32)
    a, b = by & 0xFFFFFFFF, by >> 32
    d = lambda c: c.cast("decimal(20,0)")
    low_low = d(low) * F.lit(a).cast("decimal(10,0)")
    cross = F.pmod(d(low) * F.lit(b).cast("decimal(10,0)") + d(high) * F.lit(a).cast("decimal(10,0)"), F.lit(1 << 32).cast("decimal(20,0)"))
    whole = F.pmod(low_low + cross * F.lit(1 << 32).cast("decimal(10,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)"))
    return signed64(whole)


def signed64(x: Column) -> Column:
    """A whole number below 2**64 as the long of the same bits."""
    return _let(x, lambda v: F.when(v >= F.lit(str(1 << 63)).cast("decimal(38,0)"), v - F.lit(str(1 << 64)).cast("decimal(38,0)")).otherwise(v).cast("long"))


def unsigned64(x: Column) -> Column:
    """A long's bits as a whole number of 0 or more."""
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, d + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(d)


def splitmix64(seed: int, index: Column) -> Column:
    """SplitMix64 of a row's index and a seed, as the long of the same bits."""
    plus = F.lit(str((seed + SPLITMIX[0]) % (1 << 64))).cast("decimal(20,0)")
    x = signed64(F.pmod(unsigned64(index) + plus, F.lit(str(1 << 64)).cast("decimal(38,0)")))
    for shift, by in ((30, SPLITMIX[1]), (27, SPLITMIX[2])):
        mixed = _let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, shift)))
        x = _let(mixed, lambda v: _times64(v, by))
    return _let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)))


#: What a simulator's log says if the survey did not look there.
NO_COVERAGE = ("Every generated event fails NEPOCH>=2", "Could not find SIMLIB HEADER passing GENRANGE_XXX cuts")


def log_outcome(code: Column, detail: Column) -> Column:
    """status and reason of a simulation that ended with an exit code and a log text."""
    text = F.coalesce(detail, F.lit(""))
    expected = F.lit(False)
    for said in NO_COVERAGE:
        expected = expected | text.contains(said)
    failed = F.concat(F.lit("snlc_sim_exit_"), code.cast("string"), F.when(text != "", F.concat(F.lit(": "), text)).otherwise(""))
    return F.struct(F.when(expected, "skipped").otherwise("failed").alias("status"), F.when(expected, "rubin_observation_requirements_not_met").otherwise(failed).alias("reason"))


def canonical_json(*columns: str) -> Column:
    """The columns as JSON text with sorted keys, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def scan_seconds(filters: Column, exposure: Column, tiles: Column, overhead: float, change: float) -> Column:
    """Time of one scan of all tiles in all filters; null unless there are filters, tiles and a positive exposure."""
    n = F.size(filters)
    return F.when((n > 0) & (exposure > 0) & (tiles > 0), n * tiles * (exposure + F.lit(overhead)) + F.greatest(F.lit(0), n - 1) * F.lit(change))
