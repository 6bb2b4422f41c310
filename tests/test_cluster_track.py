"""Clustering against brute force, tracking invariants, detector surface."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangelake.operators import cluster as cu
from rangelake.operators import tracking as tk
from rangelake.plans import recipes as rc


def brute(points, radius, m):
    """Textbook DBSCAN: labels by first core point, border to the lowest cluster."""
    p = np.asarray(points, float)
    near = [np.flatnonzero(((p - q) ** 2).sum(axis=1) <= radius**2) for q in p]
    core = [len(n) >= m for n in near]
    label = [-1] * len(p)
    k = 0
    for i in range(len(p)):
        if not core[i] or label[i] != -1:
            continue
        stack = [i]
        label[i] = k
        while stack:
            for j in near[stack.pop()]:
                if label[j] == -1:
                    label[j] = k
                    if core[j]:
                        stack.append(j)
        k += 1
    return label


def dense_cloud(seed, n=160):
    rng = np.random.default_rng(seed)
    blobs = [rng.normal(c, s, (n // 4, 2)) for c, s in (((0, 0), 0.4), ((3, 0), 0.2), ((0, 4), 0.8))]
    line = np.stack([np.linspace(-3, 6, n // 4), np.full(n // 4, -3.0)], axis=1)
    dup = np.repeat([[0.0, 0.0]], 10, axis=0)
    return np.concatenate([*blobs, line, dup])


@pytest.mark.parametrize("radius,m,kernel", [(0.3, 2, 0), (0.3, 4, 0), (0.25, 1, 0), (0.6, 6, 0), (0.3, 2, 1024), (0.25, 1, 1024), (0.6, 6, 1024), (0.3, 4, 100)])
def test_dbscan_matches_brute_force(spark, radius, m, kernel):
    """kernel 0 sends every group through the grid, 100 splits them over both ways."""
    clouds = {g: dense_cloud(g, 160 if g else 60) for g in range(3)}
    df = spark.createDataFrame([(g, i, float(x), float(y)) for g, c in clouds.items() for i, (x, y) in enumerate(c)], "g long, pid long, x double, y double")
    got = cu.dbscan(df, ["g"], [F.col("x"), F.col("y")], "pid", radius, m, kernel_points=kernel).collect()
    for g, c in clouds.items():
        mine = {r.pid: r.cluster_label for r in got if r.g == g}
        assert [mine[i] for i in range(len(c))] == brute(c, radius, m)


def test_overfull_cells_are_refined(spark, monkeypatch):
    monkeypatch.setattr(cu, "_PAIRS_PER_CELL_PAIR", 4)
    cloud = dense_cloud(7)
    df = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(cloud)], "g long, pid long, x double, y double")
    got = cu.dbscan(df, ["g"], [F.col("x"), F.col("y")], "pid", 0.3, 3, kernel_points=0).orderBy("pid").collect()
    assert [r.cluster_label for r in got] == brute(cloud, 0.3, 3)


@pytest.mark.parametrize("kernel_points", [1024, 5])
def test_null_keys_and_lost_coordinates(spark, kernel_points):
    nan = float("nan")
    rows = [(g, i, *p) for g in (None, 1) for i, p in enumerate([(0.0, 0.0), (0.1, 0.0), (0.1, 0.0), (nan, 0.0), (None, 0.1), (5.0, 5.0), (0.2, 0.1)])]
    df = spark.createDataFrame(rows, "g long, pid long, x double, y double")
    got = cu.dbscan(df, ["g"], [F.col("x"), F.col("y")], "pid", 0.5, 2, kernel_points=kernel_points)
    assert sorted((r.g is None, r.pid, r.cluster_label) for r in got.collect()) == sorted((g is None, i, l) for g in (None, 1) for i, l in enumerate([0, 0, 0, -1, -1, -1, 0]))
    assert got.columns == [*df.columns, "cluster_label"]


def test_few_points_are_noise(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 1.0, 0.0)], "g long, pid long, x double, y double, velocity double")
    assert cu.cluster_points(df, ["g"], "pid", 0.5, 2, 0.0).first().cluster_label == -1


def test_association(spark):
    schema = "f long, cluster_label long, center array<double>, size array<double>, avg_velocity double"
    old = spark.createDataFrame([(1, 0, [0.0, 0.0], [1.0, 1.0], 1.0), (1, 1, [5.0, 5.0], [1.0, 1.0], -2.0)], schema)
    new = spark.createDataFrame([(1, 0, [0.2, 0.0], [2.0, 2.0], 1.1), (1, 1, [5.0, 5.3], [2.0, 2.0], -2.1), (1, 2, [50.0, 0.0], [2.0, 2.0], 1.0)], schema)
    out = {r.cluster_label: r for r in cu.associate_clusters(new, old, ["f"], 1.0, 0.5).collect()}
    assert out[0].prev_label == 0 and out[0].size == [1.75, 1.75]
    assert out[1].prev_label == 1 and out[2].prev_label is None and out[2].size == [2.0, 2.0]


def test_tracks_follow_a_target(spark):
    """Steps put together frame by frame: a track started from the first group keeps to the true state."""
    rng = np.random.default_rng(1)
    truth = lambda f: np.array([-1.0 + 0.02 * f, 5.0 + 0.06 * f, 0.4, 1.2])
    tracks = None
    for f in range(8):
        x, y, vx, vy = truth(f)
        rows = []
        for _ in range(24):
            px, py = x + rng.normal(0, 0.05), y + rng.normal(0, 0.05)
            r = math.hypot(px, py)
            rows.append((1, r, math.atan2(px, py), float((px * vx + py * vy) / r)))
        found = tk.measure(spark.createDataFrame(rows, "uid long, range double, angle double, doppler double"), ["uid"])
        if tracks is None:
            tracks = tk.start(found, 20.0)
        else:
            ahead = tk.predict(tracks.drop("n", "mean", "moment"), 0.05).join(found, "uid").withColumns({"age": F.col("age") + 1, "frames": F.col("frames") + 1})
            moved = tk.settle_velocity(ahead, 20.0, 0.05).withColumn("mean", F.array(F.col("mean")[0], F.col("mean")[1], "v"))
            tracks = tk.life_cycle(tk.correct(tk.smooth_spread(moved)), strong=20)
        tracks = spark.createDataFrame(tracks.collect(), tracks.schema)
    r = tracks.first()
    assert r.s[:2] == pytest.approx(truth(7)[:2], abs=0.1) and r.s[2:4] == pytest.approx([0.4, 1.2], abs=0.4)
    assert r.state == "active" and r.seen == 7 * 24 and np.allclose(np.array(r.c).reshape(3, 3) @ np.array(r.ec).reshape(3, 3), np.eye(3))


def test_unroll(spark):
    df = spark.createDataFrame([(9.0, -1.0), (0.5, 0.2), (-9.0, 1.0)], "e double, m double")
    got = [r.v for r in df.select(tk.unroll_velocity(F.lit(2.0), F.col("e"), F.col("m")).alias("v")).collect()]
    assert all(abs(v - e) <= 2.0 for v, e in zip(got, (9.0, 0.5, -9.0)))


def test_user_detector(spark):
    images = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"bb"))], "frame_no long, payload binary")
    model = lambda batch: [[(1.6, 2.0, 11.9, 22.0, 2, 0.9), (0.0, 0.0, 1.0, 1.0, 9, 0.9), (0.0, 0.0, 1.0, 1.0, 0, 0.4)][: len(b) + 1] for b in batch]
    out = rc.detect_objects(images, model).collect()
    assert [(r.x, r.y, r.w, r.h, r.object_type) for r in out] == [(1, 2, 10, 20, "car")] * 2
