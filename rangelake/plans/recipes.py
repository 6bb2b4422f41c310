"""Whole processing recipes from decoded frames to points, and the fused scene.

Every recipe takes long or array rows of many frames and recordings at once; ``keys``
name a frame, for example ["recording", "frame_no"].
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.functions import units as un
from rangelake.functions.complexnum import cplx
from rangelake.operators import angles as an
from rangelake.operators import cfar as cf
from rangelake.operators import clutter as cl
from rangelake.operators import layout as ly
from rangelake.operators import peaks as pk
from rangelake.operators import spectra as sp
from rangelake.operators import telemetry as tm
from rangelake.operators import timealign as ta

# Detection settings of the recipes.
CAPON_BOUNDS = {True: (1.5, 3.0), False: (1.0, 1.5)}  # indoor: (azimuth, range)
SNR_BANDS = [(2, 30), (10, 20), (35, 16.0)]
PEAK_BANDS = [(4, 100), (1, 400)]
HIT_WINDOW = [4, 2, 1, 1]
HIT_DB = {True: 9.0, False: 5.0}
DOPPLER_BETA = {True: 2.0, False: 8.0}
BORDER = 4


@dataclass(frozen=True)
class Sensor:
    """What a recipe needs to know of the configuration."""

    chirps: int
    tx: int
    rx: int
    samples: int
    range_resolution: float
    doppler_resolution: float

    @property
    def antennas(self) -> int:
        return self.tx * self.rx


def _range_bins(cube: DataFrame, keys: Sequence[str], window: str | None, beta: float = 4.0, numbered: bool = False) -> DataFrame:
    """Range spectrum, then the corner turn: keys, vant, range_bin, chirp arrays."""
    return ly.corner_turn(sp.range_fft(cube, window, beta), keys, numbered)


def capon_maps(cube: DataFrame, keys: Sequence[str], cfg: Sensor, est_range: int = 90, resolution: int = 1) -> DataFrame:
    """One row per (keys, range_bin): Capon spectrum, beam weights and the antenna block they came from."""
    rbins = cl.remove_clutter(_range_bins(cube, keys, "hanning", numbered=True))
    cov = an.covariance_beside(an.antenna_block(rbins, keys, cfg.antennas, cfg.chirps), cfg.antennas)
    return an.capon(an.fb_average(cov), cfg.antennas, est_range, resolution)


def capon_points(
    cube: DataFrame, keys: Sequence[str], cfg: Sensor, indoor: bool = True, est_range: int = 90, resolution: int = 1,
    guard: int = 2, noise: int = 10, bounds: tuple[float, float] | None = None, border: int = BORDER, ref_compat: bool = False,
) -> DataFrame:
    """Capon point cloud: keys, range_bin, az_bin, x, y, z, velocity, snr.

    ``cube``: keys, chirp, vant, re, im over samples.
    """
    keys = list(keys)
    # the Doppler bin of a range bin is found beside its spectrum, so nothing is joined back
    rows = an.beam_doppler(capon_maps(cube, keys, cfg, est_range, resolution), cfg.antennas, ref_compat)
    n_az = 2 * est_range // resolution + 1
    heat = rows.select(*keys, "range_bin", "doppler_signed", F.posexplode("spectrum").alias("az_bin", "p")).select(
        *keys, "range_bin", "doppler_signed", F.col("az_bin").cast("long").alias("az_bin"), F.log2("p").alias("value")
    )
    az_bound, rng_bound = bounds or CAPON_BOUNDS[indoor]
    hits = cf.dual_axis_peaks(heat, keys, "az_bin", "range_bin", "value", az_bound, rng_bound, guard, noise)
    hits = pk.skip_border(hits, {"az_bin": n_az, "range_bin": cfg.samples}, border)
    pts = hits.withColumns({
        "range_m": F.col("range_bin") * cfg.range_resolution,
        "angle": (F.col("az_bin") * resolution - est_range).cast("double"),
        "velocity": F.col("doppler_signed") * cfg.doppler_resolution,
        "z": F.lit(0.0),
    })
    return un.polar_to_xy(pts).select(*keys, "range_bin", "az_bin", "range_m", "angle", "x", "y", "z", "velocity", "snr")


def range_doppler_picture(cube: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The range-Doppler picture shown beside the points."""
    return sp.rd_log_map(sp.doppler_fft(cl.remove_clutter(_range_bins(cube, keys, "hanning"))), keys)


def doppler_points(
    cube: DataFrame, keys: Sequence[str], cfg: Sensor, guard: int = 4, noise: int = 16, bounds: tuple[float, float] = (1.5, 2.5),
    snr_bands=None, peak_bands=None, method: str = "Bartlett",
) -> DataFrame:
    """Doppler-map point cloud for three transmitters: zero or more points per detection.

    The noise floor truncates like the integer map it stands for.
    """
    if cfg.tx != 3 or cfg.antennas != 12:
        raise ValueError("this recipe needs 3 transmitters and 12 virtual antennas")
    keys = list(keys)
    det_map, aoa = sp.doppler_processing(_range_bins(cube, keys, "hamming"), keys, "hamming", remove_clutter=True)
    centre = lambda df: df.withColumn("doppler_bin", (F.col("doppler_bin") + cfg.chirps // 2) % cfg.chirps)
    det_map = centre(det_map).withColumn("whole", F.expr("cast(value as bigint)"))
    d = cf.cfar(det_map, [*keys, "range_bin"], ["doppler_bin"], "whole", "ca", guard, noise, bounds[0], "wrap", True, limit=None)
    d = d.withColumn("_d", F.col("value") > F.col("threshold")).drop("noise_floor", "threshold", "detected")
    r = cf.cfar(d, [*keys, "doppler_bin"], ["range_bin"], "whole", "ca", guard, noise, bounds[1], "wrap", True, limit=None)
    det = r.filter(F.col("_d") & (F.col("value") > F.col("threshold"))).select(
        *keys, "range_bin", "doppler_bin", F.col("whole").alias("peak_val"), (F.col("whole") - F.col("noise_floor")).alias("snr")
    )
    rd = det_map.select(*keys, "range_bin", "doppler_bin", "value")
    det = pk.group_doppler(pk.prune_to_peaks(det, rd, keys, cfg.chirps, True), rd, keys, cfg.chirps)
    det = pk.range_prune(det, snr_bands or SNR_BANDS, peak_bands or PEAK_BANDS, 0.5, cfg.samples, cfg.range_resolution)
    cells = centre(ly.long_form(aoa, "doppler_bin"))
    vectors = an.antenna_vectors(cells.join(det.select(*keys, "range_bin", "doppler_bin"), [*keys, "range_bin", "doppler_bin"], "left_semi"), [*keys, "range_bin", "doppler_bin"])
    pts = an.mixed_xyz(vectors.join(det, [*keys, "range_bin", "doppler_bin"]), cfg.range_resolution, method)
    return pts.select(*keys, "range_bin", "doppler_bin", "peak_idx", "x", "y", "z", (F.col("doppler_bin") * cfg.doppler_resolution).alias("velocity"), "snr")


def hit_maps(
    cube: DataFrame, keys: Sequence[str], cfg: Sensor, threshold_db: float = 5.0, window: str | None = None, doppler_beta: float = 2.0,
    remove_clutter: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(complex range-Doppler rows per antenna, hits): spectra and 2-D detection only."""
    keys = list(keys)
    rbins = _range_bins(cube, keys, window)
    if remove_clutter:
        rbins = cl.remove_clutter(rbins)
    rd = sp.doppler_fft(rbins, window, doppler_beta)
    power = ly.long_form(rd, "doppler_bin").groupBy(*keys, "range_bin", "doppler_bin").agg(F.sum(cplx("re", "im").magnitude()).alias("level"))
    hits = cf.cfar_2d(power, keys, "doppler_bin", "range_bin", F.col("level") * F.col("level"), HIT_WINDOW, threshold_db)
    return rd, hits.filter("hit").select(*keys, "range_bin", "doppler_bin", "level", "snr")


def azimuth_map(rd: DataFrame) -> DataFrame:
    """Range-azimuth rows from range-Doppler rows."""
    return sp.azimuth_fft(rd)


def hit_points(cube: DataFrame, keys: Sequence[str], cfg: Sensor, indoor: bool = True, method: str = "Bartlett", spacing: float = 0.5) -> DataFrame:
    """Hits with direction of arrival: keys, range_bin, doppler_bin, doa, angle, x, y, z, velocity, snr."""
    keys = list(keys)
    rd, hits = hit_maps(cube, keys, cfg, HIT_DB[indoor], "kaiser", DOPPLER_BETA[indoor], remove_clutter=not indoor)
    at = [*keys, "range_bin", "doppler_bin"]
    cells = ly.long_form(rd, "doppler_bin").join(hits.select(*at), at, "left_semi")
    vectors = an.antenna_vectors(cells, at, cfg.antennas)
    found = an.doa(vectors, [spacing * i for i in range(cfg.antennas)], method).drop("re", "im")
    angled = un.doa_to_angle(found, "doa")
    placed = un.bins_to_units(angled, F.lit(cfg.range_resolution), F.lit(cfg.doppler_resolution), F.lit(cfg.chirps))
    return un.polar_to_xy(placed).select(*at, "doa", "angle", "x", "y", F.lit(0.0).alias("z"), "velocity", F.lit(1.0).alias("snr"))


RECIPES = {"capon": capon_points, "doppler": doppler_points, "hits": hit_points}


def process(cube: DataFrame, keys: Sequence[str], cfg: Sensor, recipe: str = "capon", **options) -> DataFrame:
    """Point cloud by recipe name."""
    if recipe not in RECIPES:
        raise ValueError(f"recipe {recipe!r} is not known; one of {sorted(RECIPES)}")
    return RECIPES[recipe](cube, keys, cfg, **options)


def detect_objects(images: DataFrame, model, image: str = "payload") -> DataFrame:
    """Boxes of a user's detector: ``model`` maps a list of encoded images to lists of
    (x1, y1, x2, y2, class_id, confidence). It is called once per Arrow batch."""
    schema = "array<struct<x1:double,y1:double,x2:double,y2:double,class_id:int,confidence:double>>"

    names = ("x1", "y1", "x2", "y2", "class_id", "confidence")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for payloads in batches:
            yield pd.Series([[dict(zip(names, box)) for box in boxes] for boxes in model(list(payloads))])

    detect = F.pandas_udf(run, schema)
    keep = [c for c in images.columns if c != image]
    return pk.filter_boxes(images.withColumn("_b", F.explode(detect(F.col(image)))).select(*keep, "_b.*"))


def fused_scene(points: DataFrame, boxes: DataFrame, radar_times: DataFrame, camera_times: DataFrame, by: Sequence[str], tolerance: float | None = None) -> DataFrame:
    """One row per radar frame: nearest camera frame, its objects, the frame's points and the recording's span.

    Points and boxes are summarised per frame before they meet, so frames join one to one.
    """
    by = list(by)
    matched = ta.asof_nearest(radar_times, camera_times, by, tolerance, prefix="camera_")
    per_radar = points.groupBy(*by, "frame_no").agg(
        F.count(F.lit(1)).alias("n_points"), F.max("snr").alias("best_snr"), F.avg("velocity").alias("mean_velocity")
    )
    per_camera = boxes.groupBy(*by, F.col("frame_no").alias("camera_frame_no")).agg(
        F.count(F.lit(1)).alias("n_objects"), F.max("confidence").alias("best_confidence")
    )
    span = tm.recording_summary(radar_times, by)
    joined = matched.join(per_radar, [*by, "frame_no"], "left").join(per_camera, [*by, "camera_frame_no"], "left").join(span.select(*by, "first_ts", "rate"), by, "left")
    return joined.withColumns({
        "n_points": F.coalesce("n_points", F.lit(0)), "n_objects": F.coalesce("n_objects", F.lit(0)), "timeline": F.col("ts") - F.col("first_ts"),
    }).drop("first_ts")
