"""Bins to physical units, coordinate changes, log scales."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangelake.operators.ordered import join_keys, with_position

# Fixed value: metres per second.
LIGHT_SPEED = 299792458
# Fixed value: mean radius of the sphere datum in metres.
EARTH_RADIUS = 6371008.771415


def with_resolutions(cfg: DataFrame) -> DataFrame:
    """Derived figures of a sensor configuration.

    Reads samples, chirps, tx, rx, freq_slope (MHz/us), sample_rate (ksps), start_freq (GHz),
    ramp_end_time and idle_time (us).
    """
    c = F.col
    return cfg.withColumn("bandwidth", c("freq_slope") * 1000.0 / c("sample_rate") * c("samples") * 1e6).withColumns({
        "range_resolution": F.lit(LIGHT_SPEED) / (c("bandwidth") * 2.0),
        "doppler_resolution": F.lit(LIGHT_SPEED)
        / (c("chirps") * 2 * c("tx") * (c("start_freq") * 1e9 + c("bandwidth") / 2) * ((c("ramp_end_time") + c("idle_time")) * 1e-6)),
    }).withColumns({
        "max_range": c("samples") * c("range_resolution"),
        "max_doppler": c("chirps") * c("doppler_resolution") / 2,
        "bytes_per_frame": c("chirps") * c("tx") * c("rx") * c("samples") * 4,
        "angle_step": F.lit(180.0) / (c("chirps") - 1),
    })


def plot_extents(cfg: DataFrame, max_azimuth: float = 60.0) -> DataFrame:
    """Axis limits of the two maps: [low, high, 0, max range]."""
    z, r = F.lit(0.0), F.col("max_range")
    return cfg.withColumns({
        "range_doppler_extents": F.array(-F.col("max_doppler"), F.col("max_doppler"), z, r),
        "range_azimuth_extents": F.array(F.lit(-max_azimuth), F.lit(max_azimuth), z, r),
    })


def lvds_budget(cfg: DataFrame) -> DataFrame:
    """Bytes per chirp on the link against its capacity in one chirp time; adds ``lvds_ok``.

    Reads samples, rx, iq (values per sample), bytes_per_value, lanes, lane_mbps.
    """
    c = F.col
    need = F.ceil((c("samples") * c("rx") * c("iq") * c("bytes_per_value") + 52) / 256.0) * 256
    room = (c("idle_time") + c("ramp_end_time")) * c("lanes") * c("lane_mbps") / 8
    return cfg.withColumns({"lvds_bytes": need.cast("double"), "lvds_capacity": room.cast("double")}).withColumn(
        "lvds_ok", c("lvds_bytes") <= c("lvds_capacity")
    )


def bins_to_units(hits: DataFrame, range_resolution: Column, doppler_resolution: Column, chirps: Column) -> DataFrame:
    """Add ``range_m`` and ``velocity`` about the centre Doppler bin."""
    centre = F.floor(chirps / 2)
    return hits.withColumns({
        "range_m": F.col("range_bin") * range_resolution,
        "velocity": (F.col("doppler_bin") - centre) * doppler_resolution,
    })


def polar_to_xy(df: DataFrame, rng: str = "range_m", angle_deg: str = "angle") -> DataFrame:
    a = F.radians(F.col(angle_deg))
    return df.withColumns({"x": -F.col(rng) * F.sin(a), "y": F.col(rng) * F.cos(a)})


def doa_to_angle(df: DataFrame, doa: str = "doa_index", bins: int = 180) -> DataFrame:
    """Angle index to degrees about boresight; rows without an angle are dropped."""
    d = F.col(doa).cast("double")
    return df.filter(d.isNotNull() & ~F.isnan(d)).withColumn("angle", d / bins * 180 - 90)


def signed_doppler(idx: Column, n: int | Column) -> Column:
    """Index about zero: the upper half becomes negative."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(idx < F.floor(n / 2), idx).otherwise(idx - n)


def wrapped_doppler(idx: Column, n: int) -> Column:
    """Index folded into 0..n-1 for a power of two ``n``."""
    return idx.bitwiseAND(F.lit(n - 1).cast("long"))


def sph_to_cart(df: DataFrame) -> DataFrame:
    """range, azimuth (rad), rate -> x, y, vx, vy, ax, ay."""
    r, a, d = F.col("range"), F.col("azimuth"), F.col("rate")
    return df.withColumns({
        "x": r * F.sin(a), "y": r * F.cos(a), "vx": d * F.sin(a), "vy": d * F.cos(a), "ax": F.lit(0.0), "ay": F.lit(0.0),
    })


def cart_to_sph(df: DataFrame) -> DataFrame:
    """x, y, vx, vy -> range, azimuth (rad, from the y axis), rate."""
    x, y = F.col("x"), F.col("y")
    r = F.sqrt(x * x + y * y)
    azimuth = (
        F.when(y == 0, F.lit(math.pi / 2)).when(y > 0, F.atan(F.try_divide(x, y))).otherwise(F.atan(F.try_divide(x, y)) + math.pi)
    )
    return df.withColumns({
        "range": r, "azimuth": azimuth, "rate": F.try_divide(x * F.col("vx") + y * F.col("vy"), r),
    })


def xyz_to_polar(df: DataFrame) -> DataFrame:
    """x, y, z -> range, azimuth and elevation in degrees; axis points give +-90."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    flat = F.sqrt(x * x + y * y)
    return df.withColumns({
        "range": F.sqrt(x * x + y * y + z * z),
        "azimuth": F.when(y == 0, F.when(x >= 0, 90.0).otherwise(-90.0)).otherwise(F.degrees(F.atan(F.try_divide(x, y)))),
        "elevation": F.when((x == 0) & (y == 0), F.when(z >= 0, 90.0).otherwise(-90.0)).otherwise(
            F.degrees(F.atan(F.try_divide(z, flat)))
        ),
    })


def to_log_scale(
    df: DataFrame, by: Sequence[str], magnitude: Column, dynamic_range: float, kind: str = "power", normalize: bool = False
) -> DataFrame:
    """Add ``db``: 10 (power) or 20 (voltage) log10, floored at the map maximum minus the
    dynamic range. The maximum is one aggregate per map, joined back."""
    factor = 20.0 if kind == "voltage" else 10.0
    named = df.withColumn("_mag", F.abs(magnitude))
    top = named.groupBy(*by).agg(F.max("_mag").alias("_top"))
    joined = join_keys(named, top, by)
    scale = F.col("_top") if normalize else F.lit(1.0)
    log = F.when(F.col("_mag") > 0, F.log10(F.col("_mag") / scale) * factor)
    peak = F.log10(F.col("_top") / scale) * factor
    floor_ = peak - dynamic_range
    return joined.withColumn("db", F.greatest(F.coalesce(log, floor_), floor_)).drop("_mag", "_top")


def map_display_db(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """Display level of a map: 20 log10(|sum over antennas| + 1e-10)."""
    return df.groupBy(*by).agg(F.sum(value).alias("_v")).withColumn(
        "db", F.log10(F.abs(F.col("_v")) + 1e-10) * 20
    ).drop("_v")


def auto_dynamic_range(
    df: DataFrame, by: Sequence[str], magnitude: Column, centre: tuple[int, int], half: tuple[int, int]
) -> DataFrame:
    """Per map: dB below the peak, clipped at the noise level of a window.

    ``centre`` = (range_bin, doppler_bin), ``half`` = half sizes on the same axes.
    """
    r, d = F.col("range_bin"), F.col("doppler_bin")
    power = magnitude * magnitude
    inside = r.between(centre[0] - half[0], centre[0] + half[0]) & d.between(centre[1] - half[1], centre[1] + half[1])
    cells = (2 * half[0] + 1) * (2 * half[1] + 1)
    stats = df.groupBy(*by).agg(F.max(power).alias("_top"), F.sum(F.when(inside, power)).alias("_env"))
    joined = join_keys(df, stats, by)
    floor_ = F.log10(F.col("_env") / cells / F.col("_top")) * 10
    level = F.when(power > 0, F.log10(power / F.col("_top")) * 10)
    return joined.withColumn("db", F.greatest(F.coalesce(level, floor_), floor_)).drop("_top", "_env")


def _ecef(lat: Column, lon: Column, height: Column) -> list[Column]:
    r = height + EARTH_RADIUS
    la, lo = F.radians(lat), F.radians(lon)
    return [r * F.cos(la) * F.cos(lo), r * F.cos(la) * F.sin(lo), r * F.sin(la)]


def _length(v: list[Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def bistatic_params(
    targets: DataFrame,
    radar: tuple[float, float, float],
    transmitter: tuple[float, float, float],
    wavelength: float,
    radar_bearing: float = 0.0,
    direction: str = "direction",
) -> DataFrame:
    """Bistatic range (m), Doppler (Hz) and bearing (deg) of moving targets on a sphere.

    Targets carry lat, lon, alt, speed and ``direction`` (deg from north). The heading is
    the unit vector to the point one metre ahead along the great circle.
    """
    c = F.col
    lit3 = lambda p: [F.lit(float(v)) for v in p]
    rad, ioo = _ecef(*lit3(radar)), _ecef(*lit3(transmitter))
    tgt = _ecef(c("lat"), c("lon"), c("alt"))
    delta = 1.0 / EARTH_RADIUS
    la, lo, az = F.radians(c("lat")), F.radians(c("lon")), F.radians(c(direction))
    ahead_lat = F.asin(F.sin(la) * math.cos(delta) + F.cos(la) * math.sin(delta) * F.cos(az))
    ahead_lon = lo + F.atan2(F.sin(az) * math.sin(delta) * F.cos(la), F.lit(math.cos(delta)) - F.sin(la) * F.sin(ahead_lat))
    ahead = _ecef(F.degrees(ahead_lat), F.degrees(ahead_lon), c("alt"))
    names = {}
    for label, vec in (("t", tgt), ("r", rad), ("i", ioo), ("a", ahead)):
        for k in range(3):
            names[f"_{label}{k}"] = vec[k]
    base = targets.withColumns(names)
    v = lambda label: [c(f"_{label}{k}") for k in range(3)]
    diff = lambda a, b: [x - y for x, y in zip(v(a), v(b))]
    base = base.withColumns({
        "_rt": _length(diff("i", "t")), "_rr": _length(diff("r", "t")), "_l": _length(diff("r", "i")), "_s": _length(diff("a", "t")),
    })
    dot = lambda a, b: sum((x * y for x, y in zip(a, b)), F.lit(0.0))
    heading = diff("a", "t")
    closing = dot(heading, diff("i", "t")) / (c("_s") * c("_rt")) + dot(heading, diff("r", "t")) / (c("_s") * c("_rr"))
    la1, lo1 = math.radians(radar[0]), math.radians(radar[1])
    doa = F.atan2(
        F.sin(la) * math.cos(la1) - F.cos(la) * F.cos(lo - lo1) * math.sin(la1), F.sin(lo - lo1) * F.cos(la)
    )
    out = base.withColumns({
        "bistatic_range": c("_rt") + c("_rr") - c("_l"),
        "doppler": c("speed") / wavelength * closing,
        "bearing": F.lit(180.0) - F.degrees(doa) - radar_bearing,
    })
    return out.drop(*names, "_rt", "_rr", "_l", "_s")


def color_index(
    points: DataFrame, by: Sequence[str], color: Column | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """Add ``color`` 0..255: min-max scaled per frame; without a colour value the row index counts.

    The limits are one aggregate per frame, joined back, so a hot frame stays spread.
    """
    if color is None:
        points = with_position(points, by, order)
        color = F.col("_pos").cast("double")
    named = points.withColumn("_c", color)
    limits = named.groupBy(*by).agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"))
    span = F.when(F.col("_hi") - F.col("_lo") < 1e-9, 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    scaled = F.floor((F.col("_c") - F.col("_lo")) / span * 255).cast("int")
    out = join_keys(named, limits, by).withColumn("color", F.greatest(F.lit(0), F.least(F.lit(255), scaled)))
    return out.drop("_c", "_lo", "_hi", "_pos", "_n")
