"""Allocation against a plain loop; the tracker as a stream, as a loop of frames, and with repeated batches."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rangelake.operators import allocation
from rangelake.operators import tracking as tk
from rangelake.operators.allocation import Allocation, Tracker, allocate, track_frame
from rangelake.plans import stream_queries as sq
from rangelake.streaming.tracker import TrackTable, track_recording, track_stream

POINT = "sensor long, frame_no long, pid long, range double, angle double, doppler double, snr double"
FRAME = POINT.replace("frame_no long, ", "")


def unroll(v_max, expected, measured):
    gap = expected - measured
    return measured + math.copysign(1, gap) * math.floor((abs(gap) + v_max) / (2 * v_max)) * 2 * v_max if gap else measured


def loop(points, v_max, how, room=None):
    """Group of each point, point by point, as the greedy rule says."""
    return loop_with_speeds(points, v_max, how, room)[0]


def loop_with_speeds(points, v_max, how, room=None):
    group, made, speeds = [None] * len(points), 0, [p[2] for p in points]
    for n in range(len(points)):
        if group[n] is not None or (room is not None and made >= room):
            continue
        own, total, unrolled = [n], list(points[n][:3]), [points[n][2]]
        mean, snr = list(total), points[n][3]
        for k in range(n + 1, len(points)):
            if group[k] is None:
                r, a, d, s = points[k]
                v = unroll(v_max, mean[2], d)
                if abs(v - mean[2]) < how.max_velocity and mean[0] ** 2 + r * r - 2 * mean[0] * r * math.cos(mean[1] - a) < how.max_distance2:
                    own.append(k)
                    unrolled.append(v)
                    total = [total[0] + r, total[1] + a, total[2] + v]
                    mean, snr = [t / len(own) for t in total], snr + s
        if len(own) > how.points and snr > how.snr and abs(mean[2]) > how.velocity:
            for k, v in zip(own, unrolled):
                group[k], speeds[k] = made, v
            made += 1
    return group, speeds


@pytest.mark.parametrize("room", [None, 2])
def test_allocation(spark, room):
    rng = random.Random(3)
    how = Allocation(max_velocity=1.5, max_distance2=2.0, points=3, snr=12.0, velocity=0.2)
    clouds = {}
    for sensor in range(12):
        centres = [(rng.uniform(2, 12), rng.uniform(-1, 1), rng.uniform(-3, 3)) for _ in range(4)]
        clouds[sensor] = [(c[0] + rng.gauss(0, 0.4), c[1] + rng.gauss(0, 0.05), c[2] + rng.gauss(0, 0.5), rng.uniform(1, 6)) for c in (rng.choice(centres) for _ in range(rng.randint(1, 40)))]
    rows = [(s, i, *p) for s, own in clouds.items() for i, p in enumerate(own)]
    df = spark.createDataFrame([*rows, (None, 0, 1.0, 0.0, 1.0, 9.0), (3, 99, None, None, None, None)], FRAME)
    limits = None if room is None else spark.createDataFrame([(s, room) for s in clouds], "sensor long, room long")
    got = {(r.sensor, r.pid): r.seed for r in allocate(df, ["sensor"], 2.0, how, limits).collect()}
    want = {(s, i): g for s, own in clouds.items() for i, g in enumerate(loop(own, 2.0, how, room))}
    assert got == want | {(None, 0): None, (3, 99): None}
    assert any(g is not None and g > 0 for g in want.values())


# --- one sensor at a time, one track at a time ---------------------------------------------


def plain_start(points, how):
    mean = np.mean(points, axis=0)
    rate = unroll(how.v_max, 0.0, mean[2])
    s = np.array([mean[0] * math.sin(mean[1]), mean[0] * math.cos(mean[1]), rate * math.sin(mean[1]), rate * math.cos(mean[1]), 0, 0])
    return {
        "s": s, "p": np.diag([0, 0, 0.5, 0.5, 1, 1]), "variance": (0.5 * how.max_acceleration) ** 2, "rate": rate, "first": mean[0], "spread": np.zeros((3, 3)), "seen": 0, "frames": 0,
        "age": 0, "phase": "init", "state": "detection", "hits": 0, "misses": 0, "h": np.array([mean[0], mean[1], rate]),
    }


def plain_predict(t, how):
    dt = how.dt
    f = np.kron([[1, dt, dt * dt / 2], [0, 1, dt], [0, 0, 1]], np.eye(2))
    g = np.array([dt * dt / 2, dt, 1])
    if t["variance"]:
        p = f @ t["p"] @ f.T + t["variance"] * np.kron(np.outer(g, g), np.eye(2))
        t["s"], t["p"] = f @ t["s"], (p + p.T) / 2
    x, y, vx, vy = t["s"][:4]
    r = math.hypot(x, y)
    t["h"] = np.array([r, math.atan2(x, y), (x * vx + y * vy) / r])
    t["age"] += 1
    t["frames"] += 1


def plain_update(t, points, how):
    n, life = len(points), how.life
    if n:
        mean, h = np.mean(points, axis=0), t["h"]
        moment = (points - mean).T @ (points - mean) / n
        near = lambda a, b: b != 0 and abs((a - b) / b) < 0.1
        if t["phase"] == "init":
            v, t["phase"] = t["rate"], "rate"
        elif t["phase"] in ("rate", "tracking"):
            change = (mean[0] - t["first"]) / (t["frames"] * how.dt)
            t["rate"] = 0.5 * t["rate"] + 0.5 * change
            v = unroll(how.v_max, t["rate"], mean[2])
            if t["phase"] == "rate":
                t["phase"] = "tracking" if near(change, t["rate"]) else "rate"
            elif near(h[2], v):
                t["phase"] = "locked"
        else:
            v = unroll(how.v_max, h[2], mean[2])
        u = np.array([mean[0], mean[1], v])
        t["variance"] = t["variance"] or (0.5 * how.max_acceleration) ** 2
        t["seen"] += n
        if n > 3:
            a = max(n / t["seen"], 0.1)
            t["spread"] = (1 - a) * t["spread"] + a * moment
        noise = np.diag([0.289**2, (2 * math.atan(0.5 * 0.289 / h[0])) ** 2, 1.0])
        few = 0 if n > 10 else (10 - n) / (9 * n)
        x, y, vx, vy = t["s"][:4]
        r = math.hypot(x, y)
        j = np.zeros((3, 6))
        j[0, :2], j[1, :2] = [x / r, y / r], [y / r**2, -x / r**2]
        turn = (vx * y - vy * x) / r**3
        j[2, :4] = [y * turn, -x * turn, x / r, y / r]
        inner = j @ t["p"] @ j.T
        gain = t["p"] @ j.T @ np.linalg.inv(inner + noise / n + few * np.diag(np.diag(t["spread"])))
        t["s"], t["p"] = t["s"] + gain @ (u - h), t["p"] - gain @ j @ t["p"]
        group = inner + noise + t["spread"]
        t["ec"], t["log_det"] = np.linalg.inv(group), math.log(np.linalg.det(group))
    elif abs(t["s"][2]) < how.resolution and abs(t["s"][3]) < how.resolution:
        t["s"], t["variance"] = np.array([*t["s"][:2], 0, 0, 0, 0]), 0.0
    if t["state"] == "detection":
        if n > life["strong"]:
            t["misses"], t["hits"] = 0, t["hits"] + 1
            if t["hits"] > life["hits_to_start"]:
                t["state"] = "active"
        elif n == 0:
            t["misses"], t["hits"] = t["misses"] + 1, max(0, t["hits"] - 1)
            if t["misses"] > life["misses_to_drop"]:
                t["state"] = "free"
    else:
        t["misses"] = 0 if n else t["misses"] + 1
        if t["misses"] > min(life["misses_to_end"], t["age"]):
            t["state"] = "free"


def plain_track(frames, ticks, how):
    """(frame, uid) -> track over the frames of one sensor: lists of (range, angle, doppler, snr) in order."""
    tracks, report = {}, {}
    for (number, points), tick in zip(frames, ticks):
        tracks = {u: t for u, t in tracks.items() if t["state"] != "free"}
        mine = {}
        for t in tracks.values():
            plain_predict(t, how)
        left = []
        for p in points:
            fits = []
            for u, t in tracks.items():
                d = np.array(p[:3]) - t["h"]
                chi = d @ t["ec"] @ d
                box = 4 * math.pi / 3 / math.sqrt(np.prod(np.diag(t["ec"])))
                if chi < ((how.volume / box) ** (2 / 3) if t["variance"] else 1.0):
                    fits.append((chi + t["log_det"], u))
            if fits:
                mine.setdefault(min(fits)[1], []).append(p[:3])
            else:
                left.append(p)
        group, speeds = loop_with_speeds(left, how.v_max, how.allocation, how.max_tracks - len(tracks))
        for p, g, v in zip(left, group, speeds):
            if g is not None:
                mine.setdefault((tick << 20) + g, []).append((p[0], p[1], v))
        for u in set(mine) - set(tracks):
            tracks[u] = plain_start(np.array(mine[u]), how)
        for u, t in tracks.items():
            plain_update(t, np.array(mine.get(u, [])), how)
            report[number, u] = (t["state"], t["phase"], t["seen"], *t["s"][:4], t["log_det"])
    return report


@pytest.fixture(scope="module")
def table_points(sf):
    """sensor -> frame -> points in order of pid, as the registered queries make them."""
    rows = pq.read_table(f"{sf}/lineitem.parquet").to_pylist()
    out = {}
    for r in rows:
        p = (1 + float(r["l_quantity"]) / 5, (float(r["l_discount"]) - 0.05) * 20, (float(r["l_tax"]) - 0.02) * 50, float(r["l_extendedprice"]) / 10000)
        out.setdefault(r["l_suppkey"], {}).setdefault(r["l_linenumber"], []).append((r["l_orderkey"] * 8 + r["l_linenumber"], p))
    return {s: {f: sorted(own) for f, own in frames.items()} for s, frames in out.items()}


def test_allocated_groups_values(spark, sf, table_points):
    got = {(r.sensor, r.frame_no, r.pid): r.seed for r in entry.queries()["allocated_groups"](spark, sf).collect()}
    want = {(s, f, pid): g for s, frames in table_points.items() for f, own in frames.items() for (pid, _), g in zip(own, loop([p for _, p in own], sq.TRACKER.v_max, sq.ALLOCATION))}
    assert got == want and sum(g is not None for g in want.values()) > 100


def test_tracked_recording_values(spark, sf, table_points):
    got = {(r.sensor, r.frame_no, r.uid): r for r in entry.queries()["tracked_recording"](spark, sf).collect()}
    want = {}
    for sensor, frames in table_points.items():
        order = [(f, [p for _, p in own]) for f, own in sorted(frames.items())]
        ticks = [(k // 3 << 16) + k % 3 + 1 for k in range(len(order))]
        want |= {(sensor, f, u): t for (f, u), t in plain_track(order, ticks, sq.TRACKER).items()}
    assert set(got) == set(want) and len(want) > 50
    for k, (state, phase, seen, *numbers) in want.items():
        r = got[k]
        assert (r.state, r.phase, r.seen) == (state, phase, seen)
        assert [r.x, r.y, r.vx, r.vy, r.log_det] == pytest.approx(numbers, abs=2e-3)
    assert {t[0] for t in want.values()} == {"detection", "active"}  # ends are in the scene below


def scene(frames=6, sensors=(1, 2), gone=4, seed=1):
    """One target a sensor with changing points, seen until frame ``gone``; then frames without points."""
    rng, rows = np.random.default_rng(seed), []
    for f in range(frames):
        for s in sensors:
            x, y, vx, vy = -1.0 + 0.02 * f * s, 5.0 + 0.06 * f, 0.4 * s, 1.2
            if f >= gone:
                rows.append((s, f, 0, None, None, None, None))
                continue
            for i in range(24):
                px, py = x + rng.normal(0, 0.05), y + rng.normal(0, 0.05)
                r = math.hypot(px, py)
                rows.append((s, f, i, r, math.atan2(px, py), float((px * vx + py * vy) / r), 5.0))
    return rows


HOW = Tracker(volume=40.0, allocation=Allocation(points=5, max_distance2=2.0), life={"strong": 10, "misses_to_end": 1, "hits_to_start": 1})


def table(spark, folder):
    return TrackTable(spark, str(folder), {"sensor": "long"})


def described(report):
    return sorted((r.sensor, r.frame_no, r.uid, r.state, r.hits, r.misses, *np.round(r.s, 6)) for r in report.collect())


def test_stream_equals_the_steps(spark, tmp_path):
    rows = scene()
    points = spark.createDataFrame(rows, POINT)
    for part in range(3):
        points.filter(f"frame_no div 2 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p={part}")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/p=*")
    live = table(spark, tmp_path / "live")
    query = track_stream(stream, live, HOW).trigger(availableNow=True).start()
    assert query.awaitTermination(600)
    got = described(live.report())

    # the steps by hand, two frames a batch
    tracks, want = spark.createDataFrame([], live.schema), []
    for f in range(6):
        own = points.filter(F.col("frame_no") == f).drop("frame_no")
        tracks, _ = track_frame(tracks, own, ["sensor"], (f // 2 << 16) + f % 2 + 1, HOW)
        tracks = spark.createDataFrame(tracks.collect(), live.schema)
        want += [(r.sensor, f, r.uid, r.state, r.hits, r.misses, *np.round(r.s, 6)) for r in tracks.collect()]
    assert got == sorted(want)

    # one track a sensor, active while it is seen, near the truth, and ended once afterwards
    assert {(r[0], r[2]) for r in got} == {(1, 1 << 20), (2, 1 << 20)}
    states = [r[3] for r in got if r[0] == 1]
    assert states[1:5] == ["active"] * 4 and states[-1] == "free" and states.count("free") == 1
    for s in (1, 2):
        last = next(r for r in got if r[0] == s and r[1] == 3)
        assert last[6:8] == pytest.approx([-1.0 + 0.06 * s, 5.18], abs=0.15)

    # a batch that runs again changes nothing
    live.advance(points.filter("frame_no div 2 = 2"), 2, HOW)
    assert described(live.report()) == got


def test_recording_and_other_sensors(spark, tmp_path):
    """Frames of a recording one by one; a sensor that pauses keeps its track, an empty table has none."""
    rows = scene(frames=3, gone=3) + [(3, 1, i, 6.0 + 0.01 * i, 0.1, 1.0, 5.0) for i in range(12)] + [(4, 0, i, 3.0 * i, 0.0, 1.0, 5.0) for i in range(4)]
    report = described(track_recording(spark.createDataFrame(rows, POINT), table(spark, tmp_path / "a"), HOW))
    assert {r[0] for r in report} == {1, 2, 3} and sum(r[0] == 3 for r in report) == 1
    tracks = table(spark, tmp_path / "a")
    assert tracks.version(2).filter("sensor = 3").count() == 1
    tracks.advance(spark.createDataFrame([], POINT), 3, HOW)
    assert tracks.version(3).count() == tracks.version(2).count()


def test_no_more_tracks_than_wanted(spark):
    rows = [(1, 10 * t + i, 3.0 + 4 * t, 0.01 * i, 1.0, 5.0) for t in range(3) for i in range(8)]
    points, empty = spark.createDataFrame(rows, FRAME), TrackTable(spark, "/nowhere", {"sensor": "long"}).version(-1)
    count = lambda most: track_frame(empty, points, ["sensor"], 1, Tracker(max_tracks=most, allocation=Allocation(points=5)))[0].count()
    assert [count(m) for m in (None, 2, 0)] == [3, 2, 0]


def test_frames_grow_side_by_side_as_one_by_one():
    rng = np.random.default_rng(7)
    size = np.array([0, 1, 3, 128, 129, 200, *rng.integers(0, 90, 60)])
    cuts = np.concatenate([[0], np.cumsum(size)])
    axes = [1 + rng.integers(1, 51, cuts[-1]) / 5, rng.integers(-5, 6, cuts[-1]) / 5, rng.integers(-2, 7, cuts[-1]) / 2, rng.random(cuts[-1]) * 10]
    room = [None if k % 2 else k % 5 for k in range(len(size))]
    for how in (sq.ALLOCATION, Allocation(max_velocity=4.0, max_distance2=300.0, points=2)):
        group, speed = allocation._grown_all(axes, cuts, 5.0, how, room)
        for a, b, r in zip(cuts[:-1], cuts[1:], room):
            want, speeds = allocation.grown(*(x[a:b] for x in axes), 5.0, how, r)
            assert group[a:b].tolist() == want.tolist() and speed[a:b].tolist() == speeds.tolist()


def test_association_keeps_the_order_of_missing_and_equal_scores(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, None, 0.0, 0.0), (1, 3, 9.0, 0.0, 0.0), (2, 4, 0.0, 0.0, 0.0), (None, 5, 0.0, 0.0, 0.0)], "sensor int, pid int, range double, angle double, doppler double")
    unit = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    far, nan = [5.0, 0.0, 0.0], float("nan")
    tracks = spark.createDataFrame([
        (1, 7, [0.0] * 3, unit, 0.5, 4.0), (1, 8, [0.0] * 3, unit, 0.5, 4.0), (1, 9, far, unit, nan, nan), (1, 10, [0.0, None, 0.0], unit, -9.0, 4.0),
        (None, 11, [0.0] * 3, unit, None, 4.0), (None, 12, [0.0] * 3, unit, -1.0, 4.0), (None, 13, [0.0] * 3, unit, 0.0, None),
    ], "sensor int, uid long, h array<double>, ec array<double>, log_det double, g double")
    out = tk.associate(points, tracks, ["sensor"])
    got = {r.pid: (r.uid, r.score) for r in out.collect()}
    assert out.columns == ["sensor", "pid", "range", "angle", "doppler", "uid", "score"]
    assert got[1] == (7, 0.5) and got[2] == got[4] == (None, None) and got[5] == (11, None)
    assert got[3][0] == 9 and math.isnan(got[3][1])
