"""Constant-false-alarm-rate detection and hit conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangelake.operators.ordered import ROWS_PER_TASK, reach


def cfar(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    value: str,
    kind: str = "ca",
    guard: int = 4,
    noise: int = 16,
    bound: float = 0.0,
    mode: str = "wrap",
    integer: bool = False,
    k: int = 12,
    scale: float = 1.0,
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``noise_floor``, ``threshold`` and ``detected`` to a 1-D signal per group.

    kind: ``ca`` mean of both sides, ``caso`` smaller side, ``cago`` greater side,
    ``os`` the (k+1)-th smallest cell of both sides times ``scale``.
    mode: ``wrap`` joins the ends of a signal; ``constant`` pads it with zeros.
    ``integer`` truncates the noise floor as integer input does.
    ``limit=None`` says that groups are bounded (a map axis), so no size check runs.
    """
    if kind not in ("ca", "caso", "cago", "os"):
        raise ValueError(f"unknown kind {kind!r}")
    if mode not in ("wrap", "constant"):
        raise ValueError(f"mode {mode!r} is not supported")
    span = guard + noise
    wrap = mode == "wrap" or kind == "os"
    around = reach(df, part, order, span, wrap, limit)
    left = around.window.rowsBetween(-span, -(guard + 1))
    right = around.window.rowsBetween(guard + 1, span)
    if kind == "os":
        cells = F.concat(F.collect_list(value).over(left), F.collect_list(value).over(right))
        done = around.finish({"_cells": cells})
        floor_ = F.element_at(F.sort_array("_cells"), k + 1)
        out = done.withColumn("noise_floor", floor_).drop("_cells")
        threshold = F.col("noise_floor") * scale
    else:
        side = lambda w: F.coalesce(F.sum(value).over(w), F.lit(0)).cast("double")
        done = around.finish({"_l": side(left), "_r": side(right)})
        lo, hi = F.col("_l") / noise, F.col("_r") / noise
        if kind == "ca":
            floor_ = (F.col("_l") + F.col("_r")) / (2 * noise)
        else:
            inner = F.least(lo, hi) if kind == "caso" else F.greatest(lo, hi)
            floor_ = inner if wrap else (
                F.when(F.col("_pos") >= F.col("_n") - span, lo).when(F.col("_pos") < span, hi).otherwise(inner)
            )
        if integer:
            floor_ = F.floor(floor_)
        out = done.withColumn("noise_floor", floor_).drop("_l", "_r")
        threshold = F.col("noise_floor") + bound
    out = out.withColumn("threshold", threshold)
    return out.withColumn("detected", F.col(value) > F.col("threshold")).drop("_pos", "_n")


def cfar_2d(
    df: DataFrame,
    keys: Sequence[str],
    row: str,
    col: str,
    power: Column,
    win: Sequence[int],
    threshold_db: float,
) -> DataFrame:
    """2-D cell averaging on complete maps: adds ``power``, ``noise_power``, ``snr``, ``hit``.

    ``win`` = [half width along col, half height along row, guard width, guard height].
    Box sums are separable: a window along one axis, then along the other; the ring
    is the big box minus the guard box, and only cells inside the map count.
    """
    width, height, guard_w, guard_h = win
    along = Window.partitionBy(*keys, row).orderBy(col)
    across = Window.partitionBy(*keys, col).orderBy(row)
    one = F.lit(1)
    rows = df.withColumn("power", power).withColumns({
        "_bp": F.sum("power").over(along.rowsBetween(-width, width)),
        "_gp": F.sum("power").over(along.rowsBetween(-guard_w, guard_w)),
        "_bc": F.count(one).over(along.rowsBetween(-width, width)),
        "_gc": F.count(one).over(along.rowsBetween(-guard_w, guard_w)),
    })
    big, small = across.rowsBetween(-height, height), across.rowsBetween(-guard_h, guard_h)
    ring = rows.withColumns({
        "_power": F.sum("_bp").over(big) - F.sum("_gp").over(small),
        "_cells": F.sum("_bc").over(big) - F.sum("_gc").over(small),
    })
    limit = 10.0 ** (threshold_db / 10.0)
    return (
        ring.withColumn("noise_power", F.col("_power") / F.col("_cells"))
        .withColumn("snr", F.try_divide(F.col("power"), F.col("noise_power")))
        .withColumn("hit", F.coalesce(F.col("snr") > limit, F.col("power") > 0))
        .drop("_bp", "_gp", "_bc", "_gc", "_power", "_cells")
    )


def dual_axis_peaks(
    df: DataFrame,
    keys: Sequence[str],
    az: str,
    rng: str,
    value: str,
    az_bound: float,
    rng_bound: float,
    guard: int = 2,
    noise: int = 10,
) -> DataFrame:
    """Cells above the threshold along azimuth and along range; ``noise_floor`` and
    ``snr`` come from the range pass. Both axes are bounded map axes."""
    first = cfar(df, [*keys, rng], [az], value, "ca", guard, noise, az_bound, "wrap", limit=None)
    first = first.withColumnRenamed("detected", "_az_hit").drop("noise_floor", "threshold")
    second = cfar(first, [*keys, az], [rng], value, "ca", guard, noise, rng_bound, "wrap", limit=None)
    return with_snr(second.filter(F.col("_az_hit") & F.col("detected")), value).drop("_az_hit", "detected")


def with_snr(df: DataFrame, value: str) -> DataFrame:
    """Add ``snr`` = value - noise floor."""
    return df.withColumn("snr", F.col(value) - F.col("noise_floor"))
