"""Detection and clutter-filter quality metrics on range-Doppler maps.

Maps are long: keys, range_bin, doppler_bin (row index), power. A target row carries
keys, target_range, target_doppler (about zero). Every metric is a conditional sum, so
all of them come from one aggregate per map.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangelake.operators.ordered import join_keys
from pyspark.sql import Window

from rangelake.operators import passive as pv


def zero_row(n_doppler: int) -> int:
    return (n_doppler - 1) // 2


def _db(ratio: Column) -> Column:
    return F.when(ratio > 0, F.log10(ratio) * 10)


def _over(top: Column, bottom: Column) -> Column:
    """Ratio; NULL for a zero denominator."""
    return F.try_divide(top, bottom)


def _box(r: Column, d: Column, half_r: int, half_d: int) -> Column:
    return F.col("range_bin").between(r - half_r, r + half_r) & F.col("doppler_bin").between(d - half_d, d + half_d)


def _target(n_doppler: int) -> tuple[Column, Column]:
    return F.col("target_range"), F.col("target_doppler") + zero_row(n_doppler)


def _mean_in(cond: Column, cells: int) -> Column:
    """Mean power of a box; NULL when the box leaves the map."""
    return F.when(F.sum(F.when(cond, 1).otherwise(0)) == cells, F.sum(F.when(cond, F.col("power"))) / cells)


def _parts(n_doppler: int, win: Sequence[int] | None, win_pos: Sequence[int] | None, delay: int | None, exact_zero: bool) -> dict[str, Column]:
    """Conditional sums shared by the metrics. ``win`` = half range, half Doppler, guard range, guard Doppler."""
    r, d = _target(n_doppler)
    at_target = (F.col("range_bin") == r) & (F.col("doppler_bin") == d)
    zero = zero_row(n_doppler) + (0 if exact_zero else 1)
    on_zero = F.col("doppler_bin") == zero
    null = F.lit(None).cast("double")
    parts = {
        "target": F.sum(F.when(at_target, F.col("power"))),
        "peak": F.max("power"),
        "direct": F.sum(F.when(on_zero & (F.col("range_bin") == 0), F.col("power"))),
        "clutter": null if delay is None else F.sum(F.when(on_zero & (F.col("range_bin") < delay), F.col("power"))),
        "ring": null,
        "noise": null,
    }
    if win is not None:
        size = (2 * win[0] + 1) * (2 * win[1] + 1)
        if len(win) > 2:
            guard = (2 * win[2] + 1) * (2 * win[3] + 1)
            ring = _box(r, d, win[0], win[1]) & ~_box(r, d, win[2], win[3])
            parts["ring"] = _mean_in(ring, size - guard)
        if win_pos is not None:
            where = _box(F.lit(win_pos[0]), F.lit(win_pos[1] + zero_row(n_doppler)), win[0], win[1])
            parts["noise"] = _mean_in(where, size)
    return parts


def _valid(targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Targets with NULL in place of a cell that is invalid (negative range): such maps get the target-free scores."""
    real = F.col("target_range") >= 0
    return targets.select(*keys, *(F.when(real, F.col(c)).alias(c) for c in ("target_range", "target_doppler")))


def map_metrics(
    maps: DataFrame, targets: DataFrame | None, keys: Sequence[str], n_doppler: int, win: Sequence[int] | None = None,
    win_pos: Sequence[int] | None = None, energy: DataFrame | None = None,
) -> DataFrame:
    """delta, mu, noise_floor, peak, dynamic_range and alpha per map; NULL where inputs lack.

    ``energy`` (keys, channel_power) is needed for mu. Targets with a negative range are invalid.
    """
    if targets is None:
        joined = maps.withColumns({"target_range": F.lit(None).cast("long"), "target_doppler": F.lit(None).cast("long")})
    else:
        joined = join_keys(maps, _valid(targets, keys), keys, "left")
    parts = _parts(n_doppler, win, win_pos, None, False)
    agg = joined.groupBy(*keys).agg(*[c.alias(k) for k, c in parts.items()])
    agg = join_keys(agg, energy, keys, "left") if energy is not None else agg.withColumn("channel_power", F.lit(None).cast("double"))
    t = F.col("target")
    return agg.select(
        *keys,
        _db(_over(t, F.col("ring"))).alias("delta"),
        _db(_over(t, F.col("channel_power"))).alias("mu"),
        _db(F.col("noise")).alias("noise_floor"),
        F.col("peak"),
        _over(F.col("peak"), F.col("noise")).alias("dynamic_range"),
        _db(_over(t, F.col("noise"))).alias("alpha"),
    )


def metric_delta(maps, targets, keys, n_doppler, win):
    """Target over the mean power of the ring around it, in dB."""
    return map_metrics(maps, targets, keys, n_doppler, win).select(*keys, "delta")


def metric_mu(maps, targets, keys, n_doppler, energy):
    """Target over channel energy, in dB."""
    return map_metrics(maps, targets, keys, n_doppler, energy=energy).select(*keys, "mu")


def metric_noise_floor(maps, keys, n_doppler, win, win_pos):
    """Mean power of a window in dB."""
    return map_metrics(maps, None, keys, n_doppler, win[:2], win_pos).select(*keys, "noise_floor")


def metric_peak(maps, keys):
    """Power of the strongest cell."""
    return maps.groupBy(*keys).agg(F.max("power").alias("peak"))


def metric_dynamic_range(maps, keys, n_doppler, win, win_pos):
    """Peak power over the mean power of a window (linear)."""
    return map_metrics(maps, None, keys, n_doppler, win[:2], win_pos).select(*keys, "dynamic_range")


def metric_alpha(maps, targets, keys, n_doppler, win, win_pos):
    """Target over a distant noise window, in dB."""
    return map_metrics(maps, targets, keys, n_doppler, win, win_pos).select(*keys, "alpha")


def channel_power(pairs: DataFrame, keys: Sequence[str], prefix: str = "surv") -> DataFrame:
    """Energy of an array channel per CPI: keys, channel_power."""
    sq = lambda name: F.aggregate(F.col(name), F.lit(0.0), lambda acc, x: acc + x * x)
    return pairs.select(*keys, (sq(f"{prefix}_re") + sq(f"{prefix}_im")).alias("channel_power"))


SCORES = ["ca", "r_nf", "mu_imp", "delta_imp", "alpha_imp", "l", "r_dpi", "r_zdc", "p", "d"]


def filter_scorecard(
    before: DataFrame, after: DataFrame, keys: Sequence[str], n_doppler: int, targets: DataFrame | None = None,
    win: Sequence[int] | None = None, win_pos: Sequence[int] | None = None, max_clutter_delay: int | None = None,
    energy_before: DataFrame | None = None, energy_after: DataFrame | None = None, exact_zero: bool = False,
) -> DataFrame:
    """All scores of a clutter filter per map; a score whose inputs are missing is NULL.

    Before and after maps are stacked with a tag and reduced together, so the two full
    maps are never joined. ``exact_zero`` uses the true zero-Doppler row for the direct
    path and zero-Doppler scores instead of the row after it.
    """
    stacked = before.select(*keys, "range_bin", "doppler_bin", "power", F.lit("b").alias("_side")).unionByName(
        after.select(*keys, "range_bin", "doppler_bin", "power", F.lit("a").alias("_side"))
    )
    if targets is None:
        joined = stacked.withColumns({"target_range": F.lit(None).cast("long"), "target_doppler": F.lit(None).cast("long")})
    else:
        joined = join_keys(stacked, _valid(targets, keys), keys, "left")
    parts = _parts(n_doppler, win, win_pos, max_clutter_delay, exact_zero)
    sums = joined.groupBy(*keys, "_side").agg(*[c.alias(k) for k, c in parts.items()])
    pick = lambda side, name: F.max(F.when(F.col("_side") == side, F.col(name))).alias(f"{name}_{side}")
    wide = sums.groupBy(*keys).agg(*[pick(s, n) for s in "ba" for n in parts])
    none = F.lit(None).cast("double")
    for side, energy in (("b", energy_before), ("a", energy_after)):
        name = f"energy_{side}"
        if energy is None:
            wide = wide.withColumn(name, none)
        else:
            wide = join_keys(wide, energy.select(*keys, F.col("channel_power").alias(name)), keys, "left")
    c = F.col
    gain = lambda top, bottom: _db(_over(c(f"{top}_a"), c(f"{bottom}_a"))) - _db(_over(c(f"{top}_b"), c(f"{bottom}_b")))
    loss = lambda name: _db(_over(c(f"{name}_b"), c(f"{name}_a")))
    span = lambda side: _over(c(f"peak_{side}"), c(f"noise_{side}"))
    return wide.select(
        *keys,
        loss("energy").alias("ca"), loss("noise").alias("r_nf"), gain("target", "energy").alias("mu_imp"),
        gain("target", "ring").alias("delta_imp"), gain("target", "noise").alias("alpha_imp"),
        _db(_over(c("target_a"), c("target_b"))).alias("l"), loss("direct").alias("r_dpi"), loss("clutter").alias("r_zdc"),
        loss("peak").alias("p"), _db(span("b") - span("a")).alias("d"),
    )


def scores_as_map(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores as one ``metrics`` map per row holding only those that could be computed."""
    entries = F.filter(F.array(*[F.struct(F.lit(s).alias("key"), F.col(s).alias("value")) for s in SCORES]), lambda e: e["value"].isNotNull())
    return scores.select(*keys, F.map_from_entries(entries).alias("metrics"))


def metrics_on_track(
    maps: DataFrame, track: DataFrame, keys: Sequence[str], n_doppler: int, win: Sequence[int] | None = None,
    win_pos: Sequence[int] | None = None, energy: DataFrame | None = None,
) -> DataFrame:
    """delta, alpha and mu per interval along a track; NULL where an interval has no valid target."""
    return map_metrics(maps, track, keys, n_doppler, win, win_pos, energy).select(*keys, "delta", "alpha", "mu")


def map_size(target: Sequence[int], win: Sequence[int], win_pos: Sequence[int] | None = None) -> tuple[int, int]:
    """(range cells as a power of two, Doppler lines) that hold the target and the window."""
    pow2 = lambda x: 1 << max(0, (int(x) - 1).bit_length())
    rng, dop = pow2(target[0] + win[0]), abs(target[1]) + win[1]
    if win_pos is not None:
        rng, dop = max(rng, pow2(win_pos[0] + win[0])), max(dop, abs(win_pos[1]) + win[1])
    return rng, dop


def scorecard_raw(
    pairs: DataFrame, keys: Sequence[str], method: str, k: int | Column, rd_size: tuple[int, int], dopplers: int = 0,
    targets: DataFrame | None = None, win: Sequence[int] | None = None, win_pos: Sequence[int] | None = None,
    max_clutter_delay: int | None = None, window: str | None = None,
) -> DataFrame:
    """Filter the surveillance channel, map before and after, and score. ``rd_size`` = (range cells, Doppler lines)."""
    r_max, lines = rd_size
    filtered = pv.time_filter(pairs, method, k, dopplers)
    e_before, e_after = channel_power(pairs, keys), channel_power(filtered, keys)
    if window is not None:
        pairs, filtered = pv.taper_surveillance(pairs, window), pv.taper_surveillance(filtered, window)

    def power_map(rows):
        cells = pv.caf_lines(rows, keys, lines, r_max)
        return cells.select(*keys, "range_bin", "doppler_bin", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))

    return filter_scorecard(
        power_map(pairs), power_map(filtered), keys, 2 * lines + 1, targets, win, win_pos, max_clutter_delay, e_before, e_after
    )


def scorecard_by_cpi(pairs: DataFrame, method: str, k: int | Column, rd_size: tuple[int, int], key: str = "cpi", **kwargs) -> DataFrame:
    """Scores of every interval; intervals are independent rows, so they spread over all tasks."""
    return scorecard_raw(pairs, [key], method, k, rd_size, **kwargs)


def sweep_filter_dim(
    pairs: DataFrame, method: str, dims: Sequence[int], rd_size: tuple[int, int], statistic: str = "avg", key: str = "cpi", **kwargs
) -> DataFrame:
    """Scores against filter size, summarised over intervals in linear amplitude, in dB, and
    shifted so that each score's best is 0. Every (size, interval) pair is its own row."""
    makers = {"avg": F.avg, "max": F.max, "median": F.median}
    if statistic not in makers:
        raise ValueError(f"statistic {statistic!r} is not known")
    grid = pairs.withColumn("k", F.explode(F.array(*[F.lit(int(d)) for d in dims])))
    targets = kwargs.pop("targets", None)
    if targets is not None:
        targets = targets.withColumn("k", F.explode(F.array(*[F.lit(int(d)) for d in dims])))
    scores = scorecard_raw(grid, [key, "k"], method, F.col("k"), rd_size, targets=targets, **kwargs)
    stat = scores.groupBy("k").agg(*[(F.log10(makers[statistic](F.pow(F.lit(10.0), F.col(s) / 20))) * 20).alias(s) for s in SCORES])
    # One row per filter size: the window spans the handful of configured sizes.
    whole = Window.partitionBy(F.lit(0))
    return stat.select("k", *[(F.col(s) - F.max(s).over(whole)).alias(s) for s in SCORES])
