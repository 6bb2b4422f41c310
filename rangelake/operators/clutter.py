"""Static clutter, DC signature and phase compensation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangelake.functions.complexnum import cplx, unit_phase
from rangelake.functions.kernels import vector_kernel

# Antenna geometry of the near-field model, in millimetres.
WAVELENGTH_MM = 3e8 / 77e9
TX2_GAP_MM = 8.7


def remove_clutter(rcube: DataFrame) -> DataFrame:
    """Subtract the mean over chirps of every row; no shuffle."""
    keys = [c for c in rcube.columns if c not in ("re", "im")]
    # a kernel like its neighbours: the optimizer would push their UDFs into the lambda of an array expression
    clean = vector_kernel(lambda z: z - z.mean(axis=1, keepdims=True))
    return rcube.withColumn("_z", clean("re", "im")).select(*keys, F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def dc_signature(cells: DataFrame, keys: Sequence[str], frame: str, n_frames: int, first_frame: Column) -> DataFrame:
    """Mean of the first ``n_frames`` frames per (keys, chirp parity, range_bin).

    ``cells`` is long: frame, chirp, vant, range_bin, re, im.
    """
    calib = cells.filter(F.col(frame) < first_frame + n_frames)
    return calib.groupBy(*keys, (F.col("chirp") % 2).alias("parity"), "range_bin").agg(
        F.avg("re").alias("dc_re"), F.avg("im").alias("dc_im")
    )


def remove_dc_signature(
    cells: DataFrame, keys: Sequence[str], frame: str, n_frames: int, positive: int, negative: int, n_range: int,
    first_frame: Column | None = None,
) -> DataFrame:
    """Subtract the calibrated DC signature from frames after the calibration frames.

    Only bins 0..positive and the last ``negative`` bins are touched. The signature has
    2 x (positive + 1 + negative) rows per key; it is joined, and Spark broadcasts it
    when its measured size allows.
    """
    start = F.lit(0) if first_frame is None else first_frame
    touched = (F.col("range_bin") <= positive) | (F.col("range_bin") >= n_range - negative)
    mean = dc_signature(cells.filter(touched), keys, frame, n_frames, start)
    live = cells.filter(F.col(frame) >= start + n_frames).withColumn("parity", F.col("chirp") % 2)
    joined = live.join(mean, [*keys, "parity", "range_bin"], "left")
    return joined.withColumns({
        "re": F.col("re") - F.coalesce("dc_re", F.lit(0.0)), "im": F.col("im") - F.coalesce("dc_im", F.lit(0.0)),
    }).drop("parity", "dc_re", "dc_im")


def compensate_doppler(aoa: DataFrame, tx: int, rx: int, n_doppler: int) -> DataFrame:
    """Rotate the antennas of the 2nd and 3rd transmitter back by their share of the Doppler phase.

    ``aoa`` is long: doppler_bin (0..n-1), vant, re, im. With T transmitters, transmitter t
    fires t/T of a chirp repetition late, which is t/T of the Doppler bin's phase.
    """
    if tx == 1:
        return aoa
    if tx not in (2, 3):
        raise ValueError("the number of transmitters is not supported")
    d = F.when(F.col("doppler_bin") < n_doppler / 2, F.col("doppler_bin")).otherwise(F.col("doppler_bin") - n_doppler)
    late = F.floor(F.col("vant") / rx) / F.lit(float(tx))
    turned = cplx("re", "im").times(unit_phase(d * late * (-2 * math.pi / n_doppler)))
    return aoa.withColumns({"re": turned.re, "im": turned.im})


def compensate_rx(aoa: DataFrame, coefficients: Sequence[complex]) -> DataFrame:
    """Multiply each virtual antenna by its bias coefficient (one per antenna, a dozen at most)."""
    pick = lambda part: F.element_at(
        F.array(*[F.lit(float(part(complex(c)))) for c in coefficients]), (F.col("vant") + 1).cast("int")
    )
    out = cplx("re", "im").times(cplx(pick(lambda c: c.real), pick(lambda c: c.imag)))
    return aoa.withColumns({"re": out.re, "im": out.im})


def near_field_phase(range_bin: Column, angle_bin: Column, n_angle: int, range_resolution: float) -> Column:
    """Phase between the spherical path of the second transmitter set and a plane wave."""
    lam = WAVELENGTH_MM
    # Distances to the reference antenna.
    to_b = {"tx2": -lam, "tx1": lam, "rx4": lam + TX2_GAP_MM, "rx1": 2.5 * lam + TX2_GAP_MM}
    r = (range_bin * range_resolution - range_resolution) * 1000
    theta = F.when(angle_bin < n_angle / 2, angle_bin).otherwise(angle_bin - n_angle) * (2.0 / n_angle)
    path = {k: F.sqrt(r * r + g * g - r * theta * (2 * g)) for k, g in to_b.items()}
    extra = (path["tx2"] + path["rx1"]) - (path["rx4"] + path["tx1"])
    return F.when(r > 0, extra * (2 * math.pi / lam) - theta * math.pi).otherwise(F.lit(0.0))


def near_field(
    spectra: DataFrame, n_angle: int, range_resolution: float, start_bin: int, end_bin: int
) -> DataFrame:
    """Combine the spectra of two antenna sets with the near-field rotation on the second.

    ``spectra``: range_bin, angle_bin, re0, im0 (first set), re1, im1 (second set). Outside
    [start_bin, end_bin) the first set passes unchanged.
    """
    psi = near_field_phase(F.col("range_bin"), F.col("angle_bin"), n_angle, range_resolution)
    second = cplx("re1", "im1").times(unit_phase(psi))
    near = F.col("range_bin").between(start_bin, end_bin - 1)
    return spectra.withColumns({
        "re": F.col("re0") + F.when(near, second.re).otherwise(0.0),
        "im": F.col("im0") + F.when(near, second.im).otherwise(0.0),
    }).drop("re0", "im0", "re1", "im1")
