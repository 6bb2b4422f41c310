"""Steps of a group tracker as operations on tables of tracks and points.

A track is a row: ``s`` (x, y, vx, vy, ax, ay), ``p`` (its 6 x 6 covariance, row by row), ``variance`` of the
acceleration (0: stands still), counters and states. A step over all sensors at once is predict, gate, associate,
measure, correct and the two state columns; each is a projection or one grouping by track, so nothing is bounded by a
number of points or tracks. Angles are from the y axis, in radians.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangelake.functions.arrays import let
from rangelake.functions.kernels import _lists, _pack
from rangelake.operators.ordered import ROWS_PER_TASK, Cells, join_keys

# Start covariance; share of new spread at least; points that make an estimate, and a spread; errors of
# unrolled velocity that count as settled and as locked.
INITIAL_COVARIANCE = (0.0, 0.0, 0.5, 0.5, 1.0, 1.0)
MIN_SHARE = 0.1
EST_POINTS = 10
MIN_SPREAD_POINTS = 3
SETTLED, LOCKED = 0.1, 0.1


def unroll_velocity(v_max: Column, expected: Column, measured: Column, ref_compat: bool = False) -> Column:
    """Measured radial velocity moved by whole ambiguity intervals next to the expected one."""
    target = F.greatest(expected, v_max) if ref_compat else expected
    gap = target - measured
    turns = F.floor((F.abs(gap) + v_max) / (v_max * 2))
    return measured + F.signum(gap) * turns * v_max * 2


def spherical(s: Column) -> Column:
    """range, angle, radial velocity of a state as an array."""
    x, y, vx, vy = (s[i] for i in range(4))
    r = F.sqrt(x * x + y * y)
    return F.array(r, F.atan2(x, y), F.coalesce(F.try_divide(x * vx + y * vy, r), F.lit(0.0)))


_Known = tuple[np.ndarray, np.ndarray]


def ahead(dt: float, s_value: np.ndarray, s_known: np.ndarray, p_value: np.ndarray, p_known: np.ndarray, v_value: np.ndarray, v_known: np.ndarray) -> tuple[list[_Known], list[_Known]]:
    """State and covariance one frame ahead, number by number with whether it is known; ``s`` is (6, tracks), ``p`` (36, tracks)."""
    power = np.array([[1, dt, dt * dt / 2], [0, 1, dt], [0, 0, 1]])
    move, push = np.kron(power, np.eye(2)), np.kron(np.outer([dt * dt / 2, dt, 1], [dt * dt / 2, dt, 1]), np.eye(2))

    def total(terms: list[tuple[float, np.ndarray, np.ndarray]]) -> _Known:
        out, known = np.zeros(len(v_value)), np.ones(len(v_value), bool)
        for weight, value, valid in terms:
            if weight:
                out, known = out + value * float(weight), known & valid
        return out, known

    moved = [total([(move[i, k], s_value[k], s_known[k]) for k in range(6)]) for i in range(6)]
    cov = [[total([(move[i, k] * move[j, m], p_value[6 * k + m], p_known[6 * k + m]) for k in range(6) for m in range(6)] + [(push[i, j], v_value, v_known)]) for j in range(6)] for i in range(6)]
    return moved, [((cov[i][j][0] + cov[j][i][0]) / 2, cov[i][j][1] & cov[j][i][1]) for i in range(6) for j in range(6)]


def predict(tracks: DataFrame, dt: float) -> DataFrame:
    """``s`` and ``p`` one frame ahead under constant acceleration, and ``h``: range, angle, radial velocity.

    p becomes F p F' + variance Q, made symmetric. Tracks without variance keep both. A kernel adds the terms up one after the other:
    as columns they are some hundreds, whose planning in every frame took longer than their work.
    """
    def run(s: pa.Array, p: pa.Array, variance: pa.Array) -> pa.Array:
        # a number and whether it is known (not NULL), side by side
        parts = lambda x, size: [np.ascontiguousarray(c.reshape(len(s), size).T) for c in (x.to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False))]
        known = variance.is_valid().to_numpy(zero_copy_only=False)
        made = []
        for cells in ahead(dt, *parts(s.flatten(), 6), *parts(p.flatten(), 36), variance.to_numpy(zero_copy_only=False), known):
            flat = pa.array(np.stack([c for c, _ in cells], 1).ravel(), mask=~np.stack([k for _, k in cells], 1).ravel())
            made.append(pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * len(cells)), flat))
        return pa.StructArray.from_arrays(made, names=["s", "p"])

    s, p, moves = F.col("s"), F.col("p"), F.col("variance") != 0
    none = lambda size: F.array_repeat(F.lit(None).cast("double"), size)
    given = [F.coalesce(F.when(moves, c.cast("array<double>")), none(size)) for c, size in ((s, 6), (p, 36))]
    kernel = F.arrow_udf(run, returnType="struct<s:array<double>,p:array<double>>")
    out = tracks.withColumn("_k", kernel(*given, F.col("variance").cast("double")))
    out = out.withColumns({"s": F.when(moves, F.col("_k.s")).otherwise(s), "p": F.when(moves, F.col("_k.p")).otherwise(p)}).drop("_k")
    return out.withColumn("h", spherical(F.col("s")))


def gate_size(tracks: DataFrame, volume: float, length: float = 0.0, width: float = 0.0, velocity: float = 0.0) -> DataFrame:
    """``g``: the size of the gate (d' ec d < g) of the wanted volume, no wider than the limits; 0 sets no limit.

    ``ec`` is the 3 x 3 inverse group covariance. With ec = L L', the columns of the inverse of L span the unit gate.
    """
    ec = F.col("ec")
    l00 = F.sqrt(ec[0])
    l10, l20 = ec[3] / l00, ec[6] / l00
    l11 = F.sqrt(ec[4] - l10 * l10)
    l21 = (ec[7] - l20 * l10) / l11
    l22 = F.sqrt(ec[8] - l20 * l20 - l21 * l21)
    w10, w20 = -l10 / (l00 * l11), (l10 * l21 - l20 * l11) / (l00 * l11 * l22)
    w21 = -l21 / (l11 * l22)
    box = 4 * math.pi / 3 / F.sqrt(ec[0] * ec[4] * ec[8])
    sizes = [F.pow(F.lit(volume) / box, 2 / 3)]
    if length:
        sizes.append(length**2 / (4 * (1 / ec[0] + w10 * w10 + w20 * w20)))
    if width:
        sizes.append(F.pow(width / (2 * F.col("h")[0] * F.tan(F.sqrt(1 / (l11 * l11) + w21 * w21))), 2))
    if velocity:
        sizes.append(velocity**2 * l22 * l22 / 4)
    return tracks.withColumn("g", F.when(F.col("variance") == 0, 1.0).otherwise(F.least(*sizes) if len(sizes) > 1 else sizes[0]))


def associate(points: DataFrame, predicted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Best track per point: ``uid`` and ``score`` (NULL when no gate holds the point).

    ``predicted``: by, uid, h (range, angle, doppler), ec (3x3 inverse group covariance, row
    by row), log_det, g. A sensor has a bounded number of tracks, so the tracks of a frame
    travel as one array and every point meets them in place; ties go to the earlier track.
    """
    tracks = predicted.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("uid", "h", "ec", "log_det", "g"))).alias("_t"))
    # the numbers of a frame's tracks side by side, made once a frame: 3 of h, 9 of ec, log_det, g
    numbers = F.transform("_t", lambda t: F.array(*(t["h"][i] for i in range(3)), *(t["ec"][i] for i in range(9)), t["log_det"], t["g"]))
    laid = tracks.select(*by, F.col("_t.uid").alias("_uids"), F.flatten(numbers).cast("array<double>").alias("_t"))
    joined = join_keys(points, laid, list(by), "left")
    kernel = F.arrow_udf(_best, returnType="struct<at:int,score:double>")
    axes = [F.col(n).cast("double") for n in ("range", "angle", "doppler")]
    best = joined.withColumn("_b", kernel(*axes, F.coalesce("_t", F.array().cast("array<double>"))))
    return best.withColumns({"uid": F.get("_uids", F.col("_b.at")), "score": F.col("_b.score")}).drop("_t", "_uids", "_b")


def judged(axes: list[np.ndarray], row: np.ndarray, t: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of a point (``row``) and a track's 14 numbers ``t``, in order: the best pair of each point that a gate holds, its point, score and rank."""
    d = [x[row] - t[:, i] for i, x in enumerate(axes)]
    chi2 = np.zeros(len(row))
    for i in range(3):
        for j in range(3):
            chi2 = chi2 + d[i] * d[j] * t[:, 3 + 3 * i + j]
    # NaN is above all numbers; what is NULL fits no gate
    fits = np.flatnonzero(known[:, 13] & ~np.isnan(chi2) & ((chi2 < t[:, 13]) | np.isnan(t[:, 13])))
    score = chi2[fits] + t[fits, 12]
    rank = np.where(known[fits, 12], np.where(np.isnan(score), 2, 1), 0)
    order = np.lexsort((np.where(rank == 1, score, 0.0), rank, row[fits]))
    first = order[np.diff(row[fits][order], prepend=-1) != 0]
    return fits[first], row[fits][first], score[first], rank[first]


def _best(r: pa.Array, angle: pa.Array, doppler: pa.Array, tracks: pa.Array) -> pa.Array:
    """Place and score of the track whose gate holds each point with the least score (a missing one is least, NaN most), the earlier of equals."""
    cuts = tracks.offsets.to_numpy().astype(np.int64)
    flat = tracks.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, 14)
    t = flat.to_numpy(zero_copy_only=False).reshape(-1, 14)
    cuts = (cuts - cuts[0]) // 14
    row = np.repeat(np.arange(len(r)), np.diff(cuts))
    first, own, score, rank = judged([x.to_numpy(zero_copy_only=False) for x in (r, angle, doppler)], row, t, known)
    at, best, none = np.zeros(len(r), np.int32), np.zeros(len(r)), np.ones(len(r), bool)
    at[own], best[own], none[own] = first - cuts[own], score, False
    blank = none.copy()
    blank[own] = rank == 0
    return pa.StructArray.from_arrays([pa.array(at, mask=none), pa.array(best, mask=blank)], names=["at", "score"])


def measure(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per track and frame: ``n``, ``mean`` (range, angle, doppler) and ``moment`` (3 x 3 about the mean) of its points."""
    axes = ("range", "angle", "doppler")
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(a).alias(f"_m{i}") for i, a in enumerate(axes)), *(F.covar_pop(axes[i], axes[j]).alias(f"_c{i}{j}") for i, j in pairs))
    cells = [F.col(f"_c{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)]
    return sums.select(*by, "n", F.array("_m0", "_m1", "_m2").alias("mean"), F.array(*cells).alias("moment"))


def smooth_spread(tracks: DataFrame) -> DataFrame:
    """``seen`` and ``spread`` after a frame's ``n`` points and their ``moment``: more than three points move the spread."""
    seen = F.col("seen") + F.col("n")
    share = F.greatest(F.col("n") / seen, F.lit(MIN_SHARE))
    moved = let(share, lambda a: F.zip_with("spread", "moment", lambda old, new: (1 - a) * old + a * new))
    return tracks.withColumns({"seen": seen, "spread": F.when(F.col("n") > MIN_SPREAD_POINTS, moved).otherwise(F.col("spread"))})


def corrected(s: np.ndarray, p: np.ndarray, h: np.ndarray, mean: np.ndarray, spread: np.ndarray, n: np.ndarray, length_std: float, width_std: float, doppler_std: float) -> list[np.ndarray]:
    """s, p, group covariance, its inverse and the logarithm of its determinant after the correction; matrices go in as matrices and come as rows."""
    rows = len(s)
    x, y, vx, vy = s[:, :4].T
    r = np.hypot(x, y)
    turn = (vx * y - vy * x) / r**3
    j = np.zeros((rows, 3, 6))
    j[:, 0, 0], j[:, 0, 1] = x / r, y / r
    j[:, 1, 0], j[:, 1, 1] = y / r**2, -x / r**2
    j[:, 2, :4] = np.stack([y * turn, -x * turn, x / r, y / r], 1)
    noise = np.zeros((rows, 3, 3))
    noise[:, 0, 0], noise[:, 2, 2] = length_std**2, doppler_std**2
    noise[:, 1, 1] = (2 * np.arctan(0.5 * width_std / h[:, 0])) ** 2
    few = np.where(n > EST_POINTS, 0.0, (EST_POINTS - n) / ((EST_POINTS - 1) * n))
    centre = noise / n[:, None, None] + few[:, None, None] * spread * np.eye(3)
    cross = p @ j.swapaxes(1, 2)
    inner = j @ cross
    gain = cross @ np.linalg.inv(inner + centre)
    group = inner + noise + spread
    return [s + (gain @ (mean - h)[:, :, None])[:, :, 0], (p - gain @ cross.swapaxes(1, 2)).reshape(rows, 36), group.reshape(rows, 9), np.linalg.inv(group).reshape(rows, 9), np.log(np.linalg.det(group))]


def correct(tracks: DataFrame, length_std: float = 0.289, width_std: float = 0.289, doppler_std: float = 1.0) -> DataFrame:
    """Extended Kalman correction of predicted tracks (s, p, h) by ``mean`` of ``n`` points with ``spread``.

    Replaces s and p and adds ``c`` (3 x 3 group covariance), ``ec`` (its inverse) and ``log_det``. Rows are independent.
    """

    def run(s: pa.Array, p: pa.Array, h: pa.Array, mean: pa.Array, spread: pa.Array, n: pa.Array) -> pa.Array:
        rows = len(s)
        size = lambda x, *shape: np.asarray(_lists(x), float).reshape(rows, *shape)
        s, p, h, mean, spread = size(s, 6), size(p, 6, 6), size(h, 3), size(mean, 3), size(spread, 3, 3)
        n = n.to_numpy(zero_copy_only=False).astype(float)
        *parts, log_det = corrected(s, p, h, mean, spread, n, length_std, width_std, doppler_std)
        return pa.StructArray.from_arrays([*(_pack(x) for x in parts), pa.array(log_det)], names=["s", "p", "c", "ec", "log_det"])

    kernel = F.arrow_udf(run, returnType="struct<s:array<double>,p:array<double>,c:array<double>,ec:array<double>,log_det:double>")
    done = tracks.withColumn("_k", kernel("s", "p", "h", "mean", "spread", "n"))
    return done.withColumns({c: F.col(f"_k.{c}") for c in ("s", "p", "c", "ec", "log_det")}).drop("_k")


def settle_velocity(tracks: DataFrame, v_max: float, dt: float, alpha: float = 0.5, confidence: float = SETTLED) -> DataFrame:
    """Unrolled radial velocity ``v`` of the mean measurement, the smoothed ``rate`` of range, and the next ``phase``.

    Columns: phase, rate, h, mean, first_range, frames (since the start). A new track takes its rate; then the range's
    own change, smoothed, says which interval the velocity is in, until change and rate agree; from then on the
    prediction does once velocity and prediction agree.
    """
    phase = F.col("phase")
    change = F.try_divide(F.col("mean")[0] - F.col("first_range"), F.col("frames") * dt)
    smooth = alpha * F.col("rate") + (1 - alpha) * change
    near = lambda a, b, most: F.coalesce(F.abs(F.try_divide(a - b, b)) < most, F.lit(False))
    rate = F.when(phase.isin("rate", "tracking"), smooth).otherwise(F.col("rate"))
    named = tracks.withColumns({"rate": rate, "_change": change})
    aim = F.when(phase == "locked", F.col("h")[2]).otherwise(F.col("rate"))
    v = F.when(phase == "init", F.col("rate")).otherwise(unroll_velocity(F.lit(v_max), aim, F.col("mean")[2]))
    after = (
        F.when(phase == "init", "rate")
        .when((phase == "rate") & near(F.col("_change"), F.col("rate"), confidence), "tracking")
        .when((phase == "tracking") & near(F.col("h")[2], F.col("v"), LOCKED), "locked")
        .otherwise(phase)
    )
    return named.withColumn("v", v).withColumn("phase", after).drop("_change")


def life_cycle(tracks: DataFrame, hits_to_start: int = 3, misses_to_drop: int = 3, misses_to_end: int = 5, strong: int = 20, misses_at_rest: int | None = None, misses_outside: int | None = None) -> DataFrame:
    """state, hits, misses after a frame with ``n`` own points (columns state, hits, misses, n, age, variance).

    A detection becomes active after more than ``hits_to_start`` strong frames and goes after more than
    ``misses_to_drop`` empty ones; an active track goes after more than ``misses_to_end`` (or its age) in a row. With a
    boolean column ``at_place`` (inside a place where targets rest) the two other limits hold for standing tracks there
    and for tracks elsewhere.
    """
    n, new = F.col("n"), F.col("state") == "detection"
    missed = F.when(n == 0, F.col("misses") + 1)
    misses = F.coalesce(missed, F.when(new & (n <= strong), F.col("misses")), F.lit(0))
    hits = F.when(~new, F.col("hits")).when(n > strong, F.col("hits") + 1).when(n == 0, F.greatest(F.lit(0), F.col("hits") - 1)).otherwise(F.col("hits"))
    most = F.lit(misses_to_end)
    if "at_place" in tracks.columns:
        rest, out = (misses_to_end if x is None else x for x in (misses_at_rest, misses_outside))
        most = F.when(~F.col("at_place"), out).when(F.col("variance") == 0, rest).otherwise(misses_to_end)
    ended = (n == 0) & (misses > F.when(new, misses_to_drop).otherwise(F.least(most, F.col("age"))))
    state = F.when(ended, "free").when(new & (n > strong) & (hits > hits_to_start), "active").otherwise(F.col("state"))
    return tracks.withColumns({"state": state, "hits": hits, "misses": misses})


def start(groups: DataFrame, v_max: float, initial_velocity: float = 0.0, max_acceleration: float = 2.0) -> DataFrame:
    """New tracks from groups of points (``mean``: range, angle, doppler), with the columns that the steps use."""
    m = F.col("mean")
    rate = unroll_velocity(F.lit(v_max), F.lit(initial_velocity), m[2])
    made = groups.withColumn("rate", rate)
    east, north = F.sin(m[1]), F.cos(m[1])
    cov = np.diag(INITIAL_COVARIANCE).ravel().tolist()
    return made.withColumns({
        "s": F.array(m[0] * east, m[0] * north, F.col("rate") * east, F.col("rate") * north, F.lit(0.0), F.lit(0.0)),
        "p": F.array(*(F.lit(x) for x in cov)), "variance": F.lit((0.5 * max_acceleration) ** 2), "first_range": m[0],
        "spread": F.array(*[F.lit(0.0)] * 9), "seen": F.lit(0).cast("long"), "frames": F.lit(0).cast("long"), "age": F.lit(0).cast("long"),
        "phase": F.lit("init"), "state": F.lit("detection"), "hits": F.lit(0), "misses": F.lit(0),
    })


def with_sessions(points: DataFrame, sensor: Sequence[str], quiet: int, limit: int | None = ROWS_PER_TASK) -> DataFrame:
    """Add ``session``: first frame after a silence of at least ``quiet`` frames."""
    frames = points.select(*sensor, "frame_no").distinct()
    quiet_before = lambda before: before.isNull() | (F.col("frame_no") - before > quiet)
    cut = Cells(frames, sensor, ["frame_no"], limit)
    before = F.lag("frame_no").over(cut.window)
    rows = cut.rows.withColumn("_start", F.when(before.isNotNull() & quiet_before(before), F.col("frame_no")))
    cells = cut.summary(rows, frame_no=F.min_by("frame_no", "_seq"), _high=F.max_by("frame_no", "_seq"), _inside=F.max_by("_start", F.when(F.col("_start").isNotNull(), F.col("_seq"))))
    cells = cells.withColumn("_border", F.when(quiet_before(F.lag("_high").over(cut.cells)), F.col("frame_no")))
    earlier = F.last(F.coalesce("_inside", "_border"), ignorenulls=True).over(cut.before)
    joined = rows.join(cells.select("_cell", F.coalesce("_border", earlier).alias("_base")), "_cell")
    marked = cut.finish(joined.withColumn("session", F.coalesce(F.last("_start", ignorenulls=True).over(cut.so_far), "_base"))).drop("_start", "_base")
    return join_keys(points, marked, [*sensor, "frame_no"])
