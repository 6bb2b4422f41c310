"""Groups of leftover points from which new tracks start, and one whole tracker frame for all sensors at once.

The points of a sensor's frame are bounded by the sensor, so they travel as one row of arrays; a group grows from the first free
point over the later ones that are near its running mean. Everything else is the steps of ``tracking``, put together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangelake.operators import tracking as tk
from rangelake.operators.ordered import join_keys
from rangelake.session import cut_lineage


@dataclass(frozen=True)
class Allocation:
    """Gates of a growing group (velocity; squared distance) and what a group needs: more points, more summed SNR, a faster mean."""

    max_velocity: float = 2.0
    max_distance2: float = 1.0
    points: int = 3
    snr: float = 0.0
    velocity: float = 0.0


@dataclass(frozen=True)
class Tracker:
    """Settings of a tracker; ``life`` goes to ``tracking.life_cycle``."""

    dt: float = 0.05
    v_max: float = 20.0
    volume: float = 4.0
    length: float = 0.0
    width: float = 0.0
    velocity: float = 0.0
    resolution: float = 0.0
    max_acceleration: float = 2.0
    max_tracks: int | None = None
    allocation: Allocation = Allocation()
    life: dict = field(default_factory=dict)


def _unrolled(v_max: float, expected: float, measured: np.ndarray) -> np.ndarray:
    gap = expected - measured
    return measured + np.sign(gap) * np.floor((np.abs(gap) + v_max) / (2 * v_max)) * 2 * v_max


def grown(r: np.ndarray, angle: np.ndarray, doppler: np.ndarray, snr: np.ndarray, v_max: float, how: Allocation, room: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Group of each point (-1: none) and its unrolled velocity. Points come in order; at most ``room`` groups start."""
    group, out = np.full(len(r), -1), np.array(doppler, float)
    free, made = np.ones(len(r), bool), 0
    for seed in range(len(r)):
        if room is not None and made >= room:
            break
        if not free[seed]:
            continue
        own, speeds = [seed], [doppler[seed]]
        mean = np.array([r[seed], angle[seed], doppler[seed]])
        at = seed + 1
        while at < len(r):
            v = _unrolled(v_max, mean[2], doppler[at:])
            apart = mean[0] ** 2 + r[at:] ** 2 - 2 * mean[0] * r[at:] * np.cos(mean[1] - angle[at:])
            near = np.flatnonzero(free[at:] & (np.abs(v - mean[2]) < how.max_velocity) & (apart < how.max_distance2))
            if not len(near):
                break
            own.append(at + int(near[0]))
            speeds.append(v[near[0]])
            mean = np.array([r[own].mean(), angle[own].mean(), np.mean(speeds)])
            at = own[-1] + 1
        if len(own) > how.points and snr[own].sum() > how.snr and abs(mean[2]) > how.velocity:
            group[own], out[own], free[own] = made, speeds, False
            made += 1
    return group, out


class _Sums:
    """Running sums of rows of numbers, added up as ``np.sum`` does it for up to 128 of them, so that means are the same to the bit."""

    def __init__(self, rows: int, parts: int):
        self.whole, self.eights = np.zeros((parts, rows)), np.zeros((8, parts, rows))
        self.last = np.zeros((8, parts, rows))

    def start(self, rows: np.ndarray, values: list[np.ndarray]) -> None:
        self.eights[:, :, rows] = 0.0
        for k, v in enumerate(values):
            self.whole[k, rows] = v
            self.last[0, k, rows] = v

    def add(self, rows: np.ndarray, count: np.ndarray, values: list[np.ndarray]) -> None:
        """One more number to ``rows`` that have ``count`` of them."""
        full = rows[count % 8 == 7]
        for k, v in enumerate(values):
            self.whole[k, rows] += v
            self.last[count % 8, k, rows] = v
        if len(full):
            e = self.eights[:, :, full] + self.last[:, :, full]
            self.eights[:, :, full] = e
            self.whole[:, full] = ((e[0] + e[1]) + (e[2] + e[3])) + ((e[4] + e[5]) + (e[6] + e[7]))


#: Frames of up to so many points grow side by side, so many at a time.
SIDE_POINTS, SIDE_FRAMES = 128, 2048


def _side_by_side(axes: list[np.ndarray], size: np.ndarray, v_max: float, how: Allocation, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`grown` for many frames of up to ``SIDE_POINTS`` points: ``axes`` are (points, frames), frames have ``size`` points.

    A group takes one point after the other that is free and near its running mean, so all frames go over their points in step.
    """
    r, angle, doppler, snr = axes
    most, frames = r.shape
    group, out = np.full(r.shape, -1), doppler.copy()
    free, made = np.arange(most)[:, None] < size, np.zeros(frames, np.int64)
    sums = _Sums(frames, 4)
    for seed in range(most):
        # a group needs more points than are left: none can start
        b = np.flatnonzero(free[seed] & (made < room) & (free[seed:].sum(axis=0) > how.points))
        if not len(b):
            continue
        member, speed = np.zeros((most - seed, len(b)), bool), np.empty((most - seed, len(b)))
        count, at = np.ones(len(b), np.int64), np.arange(len(b))
        member[0], speed[0] = True, doppler[seed, b]
        mean = np.stack([r[seed, b], angle[seed, b], doppler[seed, b]])
        sums.start(at, [*mean, snr[seed, b]])
        for j in range(seed + 1, most):
            i = np.flatnonzero(free[j, b])
            if not len(i):
                continue
            c = b[i]
            m, x = mean[:, i], r[j, c]
            v = _unrolled(v_max, m[2], doppler[j, c])
            apart = m[0] ** 2 + x**2 - 2 * m[0] * x * np.cos(m[1] - angle[j, c])
            near = (np.abs(v - m[2]) < how.max_velocity) & (apart < how.max_distance2)
            i, c, v = i[near], c[near], v[near]
            if len(i):
                sums.add(i, count[i], [r[j, c], angle[j, c], v, snr[j, c]])
                count[i] += 1
                mean[:, i] = sums.whole[:3, i] / count[i]
                member[j - seed, i], speed[j - seed, i] = True, v
        kept = np.flatnonzero((count > how.points) & (sums.whole[3, : len(b)] > how.snr) & (np.abs(mean[2]) > how.velocity))
        if len(kept):
            p, k = np.nonzero(member[:, kept])
            c = b[kept[k]]
            group[seed + p, c], out[seed + p, c], free[seed + p, c] = made[c], speed[p, kept[k]], False
            made[b[kept]] += 1
    return group, out


def _grown_all(axes: list[np.ndarray], offsets: np.ndarray, v_max: float, how: Allocation, room: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`grown` of all frames, whose points lie one after the other from ``offsets`` on."""
    size = np.diff(offsets)
    group, out = np.full(offsets[-1], -1), axes[2].astype(float)
    for k in np.flatnonzero(size > SIDE_POINTS):
        own = slice(offsets[k], offsets[k + 1])
        group[own], out[own] = grown(*(a[own] for a in axes), v_max, how, room[k])
    limit = np.array([np.iinfo(np.int64).max if x is None else x for x in room], np.int64)
    # frames of like size go together, so few places are empty
    small = np.flatnonzero((size > how.points) & (size <= SIDE_POINTS))
    small = small[np.argsort(size[small], kind="stable")]
    for low in range(0, len(small), SIDE_FRAMES):
        k = small[low : low + SIDE_FRAMES]
        n = np.arange(size[k].max())[:, None]
        inside = n < size[k]
        at = np.where(inside, offsets[k] + n, 0)
        g, v = _side_by_side([np.ascontiguousarray(a[at]) for a in axes], size[k], v_max, how, limit[k])
        group[at[inside]], out[at[inside]] = g[inside], v[inside]
    return group, out


def allocate(points: DataFrame, by: Sequence[str], v_max: float, how: Allocation = Allocation(), room: DataFrame | None = None) -> DataFrame:
    """Points (pid, range, angle, doppler, snr) with ``seed``, their new group's number in the frame (NULL: none), and unrolled ``doppler``.

    ``room`` (by, room) limits the groups that may start. Points go by ``pid``; NULL measurements form no group.
    """
    axes = ("range", "angle", "doppler", "snr")
    whole = F.lit(True)
    for a in axes:
        whole = whole & F.col(a).isNotNull()
    rest = [c for c in points.columns if c not in (*by, *axes)]
    rows = points.filter(whole).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pid", *axes, *(c for c in rest if c != "pid")))).alias("_p"))
    limited = rows.withColumn("room", F.lit(None).cast("int")) if room is None else join_keys(rows, room.select(*by, F.col("room").cast("int").alias("room")), by, "left")

    def run(r: pa.Array, a: pa.Array, d: pa.Array, s: pa.Array, room: pa.Array) -> pa.Array:
        offsets = r.offsets.to_numpy().astype(np.int64)
        flat = [x.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False) for x in (r, a, d, s)]
        seed, doppler = _grown_all(flat, offsets - offsets[0], v_max, how, room.to_pylist())
        cuts = pa.array((offsets - offsets[0]).astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (seed.astype(float), doppler)], names=["seed", "doppler"])

    kernel = F.arrow_udf(run, returnType="struct<seed:array<double>,doppler:array<double>>")
    dealt = limited.withColumn("_g", kernel(*(f"_p.{a}" for a in axes), "room"))
    each = dealt.select(*by, F.explode(F.arrays_zip("_p", F.col("_g.seed").alias("seed"), F.col("_g.doppler").alias("v"))).alias("_z"))
    seed = F.when(F.col("_z.seed") >= 0, F.col("_z.seed").cast("int"))
    own = {c: F.col(f"_z._p.{c}") for c in (*axes, *rest)} | {"doppler": F.col("_z.v")}
    got = each.select(*by, *(own[c].alias(c) for c in points.columns if c not in by), seed.alias("seed"))
    return got.unionByName(points.filter(~whole).withColumn("seed", F.lit(None).cast("int")))


#: Columns of a track between frames, besides those that name its sensor.
TRACK = (
    "uid long, s array<double>, p array<double>, variance double, rate double, first_range double, spread array<double>, seen long, frames long, age long, "
    "phase string, state string, hits int, misses int, c array<double>, ec array<double>, log_det double"
)


def track_frame(tracks: DataFrame, points: DataFrame, by: Sequence[str], tick: int, how: Tracker) -> tuple[DataFrame, DataFrame]:
    """(tracks after the frame, points with ``uid``): predict, gate, associate, allocate, measure, correct and life cycle of all sensors.

    ``points``: one frame of each sensor that has one now (by, pid, range, angle, doppler, snr); a frame without points is a
    row whose measurements are NULL. Tracks of other sensors stay as they are. Tracks that ended come back once, as ``free``.
    ``tick`` numbers frames of the whole job and names new tracks, so a repeated frame names them alike. Predicted tracks and
    judged points are read several times, so they are stored: a frame is four small jobs, not one plan that repeats them.
    """
    by = list(by)
    columns = [*by, *(c.split(" ")[0] for c in TRACK.split(", "))]
    alive = tracks.filter("state <> 'free'").select(*columns)
    frames = points.select(*by).distinct()
    idle = join_keys(alive, frames, by, "left_anti")
    busy = join_keys(alive, frames, by, "left_semi")
    ahead = cut_lineage(tk.predict(busy, how.dt).withColumns({"age": F.col("age") + 1, "frames": F.col("frames") + 1}))
    gates = tk.gate_size(ahead, how.volume, how.length, how.width, how.velocity)
    judged = tk.associate(points, gates.select(*by, "uid", "h", "ec", "log_det", "g"), by).drop("score")
    judged = cut_lineage(judged)

    room = None
    if how.max_tracks is not None:
        room = busy.groupBy(*by).agg((F.lit(how.max_tracks) - F.count(F.lit(1))).alias("room"))
        room = join_keys(frames, room, by, "left").select(*by, F.coalesce("room", F.lit(how.max_tracks)).alias("room"))
    taken, left = judged.filter("uid IS NOT NULL"), judged.filter("uid IS NULL").drop("uid")
    fresh = allocate(left, by, how.v_max, how.allocation, room)
    named = fresh.withColumn("uid", F.lit(tick << 20) + F.col("seed"))
    assigned = cut_lineage(taken.withColumn("seed", F.lit(None).cast("int")).unionByName(named))

    # points of new tracks are those with a seed
    own = tk.measure(assigned.filter("uid IS NOT NULL"), [*by, "uid"])
    groups = tk.measure(assigned.filter("seed IS NOT NULL"), [*by, "uid"])
    none = F.lit(None).cast("array<double>")
    started = tk.start(groups, how.v_max, 0.0, how.max_acceleration).withColumns({"h": F.col("mean"), "c": none, "ec": none, "log_det": F.lit(None).cast("double")})
    started = started.withColumn("h", F.array(F.col("mean")[0], F.col("mean")[1], F.col("rate"))).drop("n", "mean", "moment")
    met = join_keys(ahead.unionByName(started.select(*ahead.columns)), own, [*by, "uid"], "left").withColumn("n", F.coalesce("n", F.lit(0)))

    hit = tk.settle_velocity(met.filter("n > 0"), how.v_max, how.dt).withColumns({
        "mean": F.array(F.col("mean")[0], F.col("mean")[1], "v"), "variance": F.when(F.col("variance") == 0, (0.5 * how.max_acceleration) ** 2).otherwise(F.col("variance")),
    })
    hit = tk.correct(tk.smooth_spread(hit)).select(*columns, "n")
    still = (F.abs(F.col("s")[2]) < how.resolution) & (F.abs(F.col("s")[3]) < how.resolution)
    missed = met.filter("n = 0").withColumns({
        "s": F.when(still, F.array(F.col("s")[0], F.col("s")[1], *[F.lit(0.0)] * 4)).otherwise(F.col("s")), "variance": F.when(still, 0.0).otherwise(F.col("variance")),
    }).select(*columns, "n")
    after = tk.life_cycle(hit.unionByName(missed), **how.life).select(*columns)
    return after.unionByName(idle), assigned.drop("seed")
