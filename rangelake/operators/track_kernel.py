"""The tracker's frame over numbers: the steps of ``allocation.track_frame`` for the frames of many sensors side by side.

Rows come sorted by sensor and frame. A chunk of them is cut where a frame ends; its sensors take their first frames
together, then their second ones and so on, and tracks of a sensor that goes on in the next chunk are carried over. So a
task holds a chunk and a frame, however long a recording is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rangelake.functions.kernels import _pack
from rangelake.operators import allocation as al
from rangelake.operators import tracking as tk

#: Rows of a chunk, and points that are judged at a time.
CHUNK_ROWS, JUDGED_POINTS = 1 << 20, 1 << 17
_PHASES, _STATES = ("init", "rate", "tracking", "locked"), ("detection", "active", "free")
_INIT, _RATE, _TRACKING, _LOCKED = range(4)
_DETECTION, _ACTIVE, _FREE = range(3)
#: Numbers of a track by name: how many there are, and their kind.
_PARTS = {
    "sensor": (0, np.int64), "uid": (0, np.int64), "s": (6, float), "p": (36, float), "variance": (0, float), "rate": (0, float), "first_range": (0, float), "spread": (9, float),
    "seen": (0, np.int64), "frames": (0, np.int64), "age": (0, np.int64), "phase": (0, np.int64), "state": (0, np.int64), "hits": (0, np.int64), "misses": (0, np.int64),
    "c": (9, float), "ec": (9, float), "log_det": (0, float), "h": (3, float),
}
Tracks = dict[str, np.ndarray]


def none(rows: int = 0) -> Tracks:
    return {k: np.zeros((rows, size) if size else rows, kind) for k, (size, kind) in _PARTS.items()}


def _of(t: Tracks, rows: np.ndarray) -> Tracks:
    return {k: v[rows] for k, v in t.items()}


def _joined(*parts: Tracks) -> Tracks:
    out = {k: np.concatenate([t[k] for t in parts]) for k in _PARTS}
    return _of(out, np.lexsort((out["uid"], out["sensor"])))


def _spherical(s: np.ndarray) -> np.ndarray:
    x, y, vx, vy = s[:, :4].T
    r = np.sqrt(x * x + y * y)
    return np.stack([r, np.arctan2(x, y), np.where(r == 0, 0.0, (x * vx + y * vy) / r)], 1)


def _predicted(t: Tracks, dt: float) -> Tracks:
    moves = np.flatnonzero(t["variance"] != 0)
    s, p, v = t["s"][moves].T, t["p"][moves].T, t["variance"][moves]
    known = lambda x: np.ones(x.shape, bool)
    moved, cov = tk.ahead(dt, s, known(s), p, known(p), v, known(v))
    out = t | {"s": t["s"].copy(), "p": t["p"].copy(), "age": t["age"] + 1, "frames": t["frames"] + 1}
    out["s"][moves], out["p"][moves] = (np.stack([c for c, _ in x], 1) for x in (moved, cov))
    return out | {"h": _spherical(out["s"])}


def _gates(t: Tracks, how: al.Tracker) -> np.ndarray:
    ec = t["ec"].T
    l00 = np.sqrt(ec[0])
    l10, l20 = ec[3] / l00, ec[6] / l00
    l11 = np.sqrt(ec[4] - l10 * l10)
    l21 = (ec[7] - l20 * l10) / l11
    l22 = np.sqrt(ec[8] - l20 * l20 - l21 * l21)
    w10, w20 = -l10 / (l00 * l11), (l10 * l21 - l20 * l11) / (l00 * l11 * l22)
    w21 = -l21 / (l11 * l22)
    size = np.power(how.volume / (4 * math.pi / 3 / np.sqrt(ec[0] * ec[4] * ec[8])), 2 / 3)
    if how.length:
        size = np.fmin(size, how.length**2 / (4 * (1 / ec[0] + w10 * w10 + w20 * w20)))
    if how.width:
        size = np.fmin(size, np.power(how.width / (2 * t["h"][:, 0] * np.tan(np.sqrt(1 / (l11 * l11) + w21 * w21))), 2))
    if how.velocity:
        size = np.fmin(size, how.velocity**2 * l22 * l22 / 4)
    return np.where(t["variance"] == 0, 1.0, size)


def _measured(group: np.ndarray, groups: int, axes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, mean and moment of the points of each group."""
    n = np.bincount(group, minlength=groups)
    per = lambda v: np.bincount(group, v, minlength=groups) / n
    mean = [per(a) for a in axes]
    off = [a - m[group] for a, m in zip(axes, mean)]
    return n, np.stack(mean, 1), np.stack([per(off[i] * off[j]) for i in range(3) for j in range(3)], 1)


def _started(sensor: np.ndarray, uid: np.ndarray, mean: np.ndarray, how: al.Tracker) -> Tracks:
    t = none(len(uid))
    rate = al._unrolled(how.v_max, np.zeros(len(uid)), mean[:, 2])
    east, north = np.sin(mean[:, 1]), np.cos(mean[:, 1])
    t["s"][:, :4] = np.stack([mean[:, 0] * east, mean[:, 0] * north, rate * east, rate * north], 1)
    t["p"][:] = np.diag(tk.INITIAL_COVARIANCE).ravel()
    h = np.stack([mean[:, 0], mean[:, 1], rate], 1)
    return t | {"sensor": sensor, "uid": uid, "variance": np.full(len(uid), (0.5 * how.max_acceleration) ** 2), "rate": rate, "first_range": mean[:, 0].copy(), "h": h}


def _updated(t: Tracks, n: np.ndarray, mean: np.ndarray, moment: np.ndarray, how: al.Tracker) -> Tracks:
    """Tracks with own points: velocity phase, spread and correction."""
    phase, passed = t["phase"], t["frames"] * how.dt
    change = (mean[:, 0] - t["first_range"]) / np.where(passed == 0, np.nan, passed)
    rate = np.where((phase == _RATE) | (phase == _TRACKING), 0.5 * t["rate"] + (1 - 0.5) * change, t["rate"])
    aim = np.where(phase == _LOCKED, t["h"][:, 2], rate)
    v = np.where(phase == _INIT, rate, al._unrolled(how.v_max, aim, mean[:, 2]))
    near = lambda a, b, most: np.abs((a - b) / np.where(b == 0, np.nan, b)) < most
    after = np.where(phase == _INIT, _RATE, phase)
    after = np.where((phase == _RATE) & near(change, rate, tk.SETTLED), _TRACKING, after)
    after = np.where((phase == _TRACKING) & near(t["h"][:, 2], v, tk.LOCKED), _LOCKED, after)
    seen = t["seen"] + n
    share = np.maximum(n / seen, tk.MIN_SHARE)[:, None]
    spread = np.where((n > tk.MIN_SPREAD_POINTS)[:, None], (1 - share) * t["spread"] + share * moment, t["spread"])
    variance = np.where(t["variance"] == 0, (0.5 * how.max_acceleration) ** 2, t["variance"])
    rows = len(n)
    s, p, c, ec, log_det = tk.corrected(
        t["s"], t["p"].reshape(rows, 6, 6), t["h"], np.stack([mean[:, 0], mean[:, 1], v], 1), spread.reshape(rows, 3, 3), n.astype(float), *tk.correct.__defaults__
    )
    return t | {"s": s, "p": p, "variance": variance, "rate": rate, "spread": spread, "seen": seen, "phase": after, "c": c, "ec": ec, "log_det": log_det}


def _rested(t: Tracks, resolution: float) -> Tracks:
    """Tracks without own points: those that hardly move stand still."""
    still = (np.abs(t["s"][:, 2]) < resolution) & (np.abs(t["s"][:, 3]) < resolution)
    s = t["s"].copy()
    s[still, 2:] = 0.0
    return t | {"s": s, "variance": np.where(still, 0.0, t["variance"])}


def _aged(t: Tracks, n: np.ndarray, hits_to_start: int = 3, misses_to_drop: int = 3, misses_to_end: int = 5, strong: int = 20, misses_at_rest: int | None = None, misses_outside: int | None = None) -> Tracks:
    new = t["state"] == _DETECTION
    misses = np.where(n == 0, t["misses"] + 1, np.where(new & (n <= strong), t["misses"], 0))
    hits = np.where(~new, t["hits"], np.where(n > strong, t["hits"] + 1, np.where(n == 0, np.maximum(0, t["hits"] - 1), t["hits"])))
    ended = (n == 0) & (misses > np.where(new, misses_to_drop, np.minimum(misses_to_end, t["age"])))
    state = np.where(ended, _FREE, np.where(new & (n > strong) & (hits > hits_to_start), _ACTIVE, t["state"]))
    return t | {"state": state, "hits": hits, "misses": misses}


def _judged(axes: list[np.ndarray], sensor: np.ndarray, t: Tracks, how: al.Tracker) -> np.ndarray:
    """Row of each point's track, -1 where no gate holds it."""
    out = np.full(len(sensor), -1)
    if not len(t["uid"]):
        return out
    numbers = np.column_stack([t["h"], t["ec"], t["log_det"], _gates(t, how)])
    low, high = (np.searchsorted(t["sensor"], sensor, side) for side in ("left", "right"))
    for a in range(0, len(sensor), JUDGED_POINTS):
        own = slice(a, a + JUDGED_POINTS)
        count = high[own] - low[own]
        row = np.repeat(np.arange(len(count)), count)
        track = np.arange(len(row)) + np.repeat(low[own] - (np.cumsum(count) - count), count)
        pairs = numbers[track]
        first, point, _, _ = tk.judged([x[own] for x in axes], row, pairs, np.ones(pairs.shape, bool))
        out[a + point] = track[first]
    return out


def frame(t: Tracks, sensors: np.ndarray, ticks: np.ndarray, sensor: np.ndarray, axes: list[np.ndarray], whole: np.ndarray, rank: np.ndarray, how: al.Tracker) -> Tracks:
    """Tracks after one frame of each of ``sensors`` (ascending), whose points lie one after the other; ``t`` are their tracks that live.

    ``axes`` are range, angle, doppler and snr, NaN where NULL; ``whole`` says where none of them is, ``rank`` is the order of points in
    which groups grow. Points of a track are added up as they come.
    """
    t = _predicted(t, how.dt)
    track = _judged(axes[:3], sensor, t, how)
    left = np.flatnonzero((track < 0) & whole)
    left = left[np.argsort(rank[left])]
    at = np.searchsorted(sensors, sensor[left])
    cuts = np.searchsorted(at, np.arange(len(sensors) + 1))
    living = np.bincount(np.searchsorted(sensors, t["sensor"]), minlength=len(sensors))
    room = [None] * len(sensors) if how.max_tracks is None else (how.max_tracks - living).tolist()
    seed, speed = al._grown_all([a[left] for a in axes], cuts, how.v_max, how.allocation, room)
    grouped = seed >= 0
    left, at, seed, speed = left[grouped], at[grouped], seed[grouped], speed[grouped]

    # points of new tracks go by sensor and seed after those of the others
    pairs, group = np.unique(np.stack([at, seed], 1).astype(np.int64), axis=0, return_inverse=True)
    taken = np.flatnonzero(track >= 0)
    points = np.concatenate([taken, left])
    own = np.concatenate([track[taken], len(t["uid"]) + group.ravel()])
    measured = [axes[0][points], axes[1][points], np.concatenate([axes[2][taken], speed])]
    n, mean, moment = _measured(own, len(t["uid"]) + len(pairs), measured)
    fresh = slice(len(t["uid"]), None)
    started = _started(sensors[pairs[:, 0]], (ticks[pairs[:, 0]] << 20) + pairs[:, 1], mean[fresh], how)
    t = {k: np.concatenate([t[k], started[k]]) for k in _PARTS}
    hit, missed = np.flatnonzero(n), np.flatnonzero(n == 0)
    done = [_updated(_of(t, hit), n[hit], mean[hit], moment[hit], how), _rested(_of(t, missed), how.resolution)]
    return _joined(*(_aged(x, n[rows], **how.life) for x, rows in zip(done, (hit, missed))))


def _changes(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """True on each row that differs from the one before in ``columns``; NULL equals NULL, NaN equals NaN."""
    out = np.zeros(len(table), bool)
    out[:1] = True
    for c in columns:
        code = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        out[1:] |= np.diff(code) != 0
    return out


class Recording:
    """Goes over sorted rows chunk by chunk and gives the report of each, with ``epoch``, ``step`` and the versions of the table a row stands for."""

    def __init__(self, by: Sequence[str], how: al.Tracker, by_frames: int, schema: pa.Schema):
        self.by, self.how, self.by_frames, self.schema = list(by), how, by_frames, schema
        self.tracks, self.done = none(), 0  # of the sensor that goes on: its tracks and how many frames it has had

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                # the last frame may go on in the next batch
                cut = int(np.flatnonzero(_changes(table, [*self.by, "frame_no"]))[-1])
                if cut:
                    goes_on = not _changes(table.slice(cut - 1, 2), self.by)[1]
                    yield from self.report(table.slice(0, cut), goes_on)
                held = table.slice(cut).combine_chunks().to_batches()
                rows = len(table) - cut
                if not cut:
                    rows = 0  # one frame fills the chunk: look for its end after as many rows again
        if held:
            table = pa.Table.from_batches(held)
            if len(table):
                yield from self.report(table, False)

    def report(self, table: pa.Table, goes_on: bool) -> Iterator[pa.RecordBatch]:
        """``goes_on``: the last sensor has more frames."""
        new_sensor, new_frame = _changes(table, self.by), _changes(table, [*self.by, "frame_no"])
        starts = np.flatnonzero(new_frame)
        ends = np.append(starts[1:], len(table))
        sensor = np.cumsum(new_sensor)[starts] - 1  # of each frame
        first = np.searchsorted(sensor, np.arange(sensor[-1] + 1))
        number = np.arange(len(starts)) - first[sensor]  # within the chunk
        place = number + np.where(sensor == 0, self.done, 0)
        axes, whole = [], np.ones(len(table), bool)
        for c in ("range", "angle", "doppler", "snr"):
            column = table.column(c).combine_chunks().cast(pa.float64())
            whole &= column.is_valid().to_numpy(zero_copy_only=False)
            axes.append(column.fill_null(np.nan).to_numpy(zero_copy_only=False))
        pid = table.column("pid").combine_chunks()
        known = pid.is_valid().to_numpy(zero_copy_only=False)
        rank = np.empty(len(table), np.int64)
        rank[np.lexsort((*axes[::-1], pc.rank(pid, tiebreaker="dense").to_numpy(), known, np.cumsum(new_frame)))] = np.arange(len(table))
        last = np.append(sensor[1:] != sensor[:-1], not goes_on)  # of its sensor
        tracks = self.tracks
        order = np.argsort(number, kind="stable")
        rounds = np.searchsorted(number[order], np.arange(number.max() + 2))
        for a, b in zip(rounds[:-1], rounds[1:]):
            now = order[a:b]  # frames, one of each sensor, in order of sensors
            size = ends[now] - starts[now]
            points = np.arange(size.sum()) + np.repeat(starts[now] - (np.cumsum(size) - size), size)
            busy = np.isin(tracks["sensor"], sensor[now])
            ticks = (place[now] // self.by_frames << 16) + place[now] % self.by_frames + 1
            with np.errstate(all="ignore"):
                after = frame(_of(tracks, busy), sensor[now], ticks, np.repeat(sensor[now], size), [x[points] for x in axes], whole[points], rank[points], self.how)
            if len(after["uid"]):
                yield self.rows(table, after, now[np.searchsorted(sensor[now], after["sensor"])], starts, place, last)
            tracks = _joined(_of(tracks, ~busy), _of(after, after["state"] != _FREE))
        mine = _of(tracks, tracks["sensor"] == sensor[-1]) if goes_on else none()
        self.tracks, self.done = mine | {"sensor": mine["sensor"] * 0}, int(place[-1]) + 1 if goes_on else 0

    def rows(self, table: pa.Table, t: Tracks, at: np.ndarray, starts: np.ndarray, place: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        """Report rows of tracks at the frames ``at``."""
        epoch, step = place[at] // self.by_frames, place[at] % self.by_frames
        # a version holds what a sensor's last frame of the batch left, also where the sensor has no more frames
        stands = last[at] | (step == self.by_frames - 1)
        until = np.where(last[at], np.iinfo(np.int64).max, epoch)
        words = lambda names, code: pa.array(names).take(pa.array(code))
        made = {k: _pack(t[k]) if size else pa.array(t[k]) for k, (size, _) in _PARTS.items()}
        made |= {"phase": words(_PHASES, t["phase"]), "state": words(_STATES, t["state"]), "epoch": pa.array(epoch), "step": pa.array(step)}
        made |= {"_from": pa.array(epoch, mask=~stands), "_until": pa.array(until, mask=~stands)}
        own = table.select([*self.by, "frame_no"]).take(pa.array(starts[at]))
        made |= {c: own.column(c).combine_chunks() for c in own.column_names}
        return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in self.schema], schema=self.schema)
