"""Cluster association: many frames at a time against a plain loop, large frames through the grid, and one shuffle for the query."""

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from rangelake.operators import cluster as cu

SCHEMA = "f long, cluster_label long, center array<double>, size array<double>, avg_velocity double"


def plain(new, old, eps, v_factor):
    """Sorted (frame, label, prev_label) as the rule says; a row is (frame, label, center, size, velocity)."""
    won = {}
    for f, label, center, _, v in new:
        mine = [o for o in old if f is not None and o[0] == f]
        rated = [(abs(v - o[4]), o[4], o[1]) for o in mine if v is not None and o[4] is not None]
        if rated and min(rated)[0] < min(v_factor, abs(v)) and any(center and o[2] and math.dist(center, o[2]) < eps for o in mine):
            key = (f, min(rated)[2])
            won[key] = min(label, won.get(key, label))
    carried = {(f, label): prev for (f, prev), label in won.items()}
    return sorted(((f, label, carried.get((f, label))) for f, label, *_ in new), key=str)


def frames(rng, sizes, spread):
    def row(f, k):
        v = None if rng.random() < 0.05 else rng.choice([-1, 1]) * rng.randint(1, 60) / 16
        return (f, k, None if rng.random() < 0.05 else [rng.uniform(-spread, spread), rng.uniform(-spread, spread)], [8.0, 16.0], v)

    sides = [[row(f, k) for f, n in enumerate(own) for k in rng.sample(range(n * 2), n)] for own in sizes]
    return [side + [(None, 1, [0.0, 0.0], [8.0, 16.0], 1.0)] for side in sides]


@pytest.mark.parametrize("at_once", [cu._PAIRS_AT_ONCE, 7])
def test_association_like_a_loop(spark, monkeypatch, at_once):
    rng = random.Random(2)
    new, old = frames(rng, [[rng.randint(0, 7) for _ in range(150)] for _ in range(2)], 3.0)
    numbers = [pa.array([[r[i] if i != 2 else r[2] and r[2][k] for r in side if r[0] == f] for f in range(150)], t) for side in (new, old) for i, k, t in ((1, 0, pa.list_(pa.int64())), (2, 0, pa.list_(pa.float64())), (2, 1, pa.list_(pa.float64())), (4, 0, pa.list_(pa.float64())))]
    want = plain(new, old, 1.5, 1.0)
    assert sum(p is not None for *_, p in want) > 50
    monkeypatch.setattr(cu, "_PAIRS_AT_ONCE", at_once)
    got = cu._carried(1.5, 1.0, pa.array([True] * 150), *numbers).to_pylist()
    labels = numbers[0].to_pylist()
    assert sorted(((f, labels[f][c["at"]], c["prev"]) for f, own in enumerate(got) for c in own), key=str) == [w for w in want if w[0] is not None]
    rows = cu.associate_clusters(spark.createDataFrame(new, SCHEMA), spark.createDataFrame(old, SCHEMA), ["f"], 1.5, 1.0).collect()
    assert sorted(((r.f, r.cluster_label, r.prev_label) for r in rows), key=str) == want
    assert {(r.prev_label is None, tuple(r.size)) for r in rows} == {(True, (8.0, 16.0)), (False, (7.0, 14.0))}


def test_large_frames_take_the_grid():
    rng = np.random.default_rng(4)
    cuts = np.array([0, 300, 300, 310, 1310])
    px, py = rng.uniform(-20, 20, (2, 1310))
    px[5], py[700] = np.nan, np.inf
    frame = np.repeat(np.arange(4), 200)
    x, y = rng.uniform(-25, 25, (2, 800))
    x[3] = np.nan
    want = [any((x[i] - px[j]) ** 2 + (y[i] - py[j]) ** 2 < 0.81 for j in range(cuts[f], cuts[f + 1])) for i, f in enumerate(frame)]
    got = cu._near_any(frame, x, y, cuts, px, py, 0.9)
    assert got.tolist() == want and 100 < sum(want) < 500


def test_clusters_are_sent_once(spark, tmp_path):
    """The line items go through one shuffle; clusters, cells and candidates of a frame go through none."""
    rng = np.random.default_rng(6)
    n = 4000
    columns = {"l_orderkey": rng.integers(0, 1000, n), "l_linenumber": rng.integers(1, 8, n).astype(np.int32), "l_quantity": rng.integers(1, 51, n) * 1.0, "l_extendedprice": rng.uniform(900, 90000, n), "l_discount": rng.integers(0, 11, n) / 100}
    pq.write_table(pa.table(columns), tmp_path / "lineitem.parquet")
    out = entry.queries()["associated_clusters"](spark, str(tmp_path))
    rows = out.collect()
    assert len(rows) == len(set(zip(columns["l_orderkey"], columns["l_linenumber"]))) and any(r.prev_label is not None for r in rows)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    kinds = [line.lstrip(" +-:*") for line in plan.split("\n")]
    assert sum(k.startswith("Exchange") for k in kinds) == 1 and not any("Join" in k for k in kinds)
