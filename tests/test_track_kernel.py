"""The tracker over a recording: the kernel against the steps over tables, chunk by chunk, and nothing but tracks is stored."""

import math
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rangelake.operators import track_kernel
from rangelake.operators.allocation import Allocation, Tracker
from rangelake.session import work_folder
from rangelake.streaming.tracker import TrackTable, track_recording

POINT = "sensor long, frame_no long, pid long, range double, angle double, doppler double, snr double"
TIGHT = Tracker(dt=0.1, v_max=3.0, volume=40.0, length=6.0, width=4.0, velocity=9.0, resolution=0.05, max_tracks=3, allocation=Allocation(points=4, max_distance2=2.0, max_velocity=1.5), life={"strong": 6, "misses_to_end": 1, "hits_to_start": 1, "misses_to_drop": 0})
WIDE = Tracker(volume=30.0, allocation=Allocation(points=5, max_distance2=2.0), life={"strong": 10})


def scene(seed=2):
    """Targets that move, rest, hide and end; frames without points, sensors that start late, one without a number; points that miss a value."""
    rng, rows = np.random.default_rng(seed), []
    for sensor in (None, 1, 2, 3, 4, 7):
        targets = [(-1.0 + k, 4.0 + 2 * k, rng.uniform(-0.5, 0.5) * (k != 1), rng.uniform(0.5, 2.0) * (k != 1)) for k in range(4)]
        for f in range(0 if sensor != 4 else 3, 7):
            if (sensor, f) in ((2, 3), (2, 4), (3, 5)):
                rows.append((sensor, f, 0, None, None, None, None))
                continue
            pid = 0
            for k, (x, y, vx, vy) in enumerate(targets):
                for _ in range(0 if k == 2 and f in (3, 4) else rng.integers(3, 16)):
                    px, py = x + 0.1 * f * vx + rng.normal(0, 0.06), y + 0.1 * f * vy + rng.normal(0, 0.06)
                    r = math.hypot(px, py)
                    rows.append((sensor, f, pid, r, None if rng.random() < 0.03 else math.atan2(px, py), float((px * vx + py * vy) / r) % 6 - 3, float(rng.uniform(1, 9))))
                    pid += 1
    return rows


def described(rows):
    out = {}
    for r in rows:
        d = r.asDict()
        names = sorted(set(d) - {"phase", "state"})
        numbers = [x for n in names for x in (d[n] if isinstance(d[n], list) else [d[n]])]
        out[r.sensor, d.get("frame_no"), r.uid] = (r.state, r.phase, [math.nan if x is None else x for x in numbers])
    return out


def same(got, want):
    assert set(got) == set(want) and want
    for k, (state, phase, numbers) in want.items():
        assert got[k][:2] == (state, phase), k
        assert got[k][2] == pytest.approx(numbers, rel=1e-7, abs=1e-7, nan_ok=True), k


@pytest.mark.parametrize("how", [TIGHT, WIDE])
def test_recording_like_the_steps(spark, tmp_path, how):
    points = spark.createDataFrame(scene(), POINT)
    place = F.dense_rank().over(Window.partitionBy("sensor").orderBy("frame_no")) - 1
    numbered = spark.createDataFrame(points.withColumn("n", F.floor(place / 3)).collect(), POINT + ", n long")
    steps, kernel = (TrackTable(spark, f"{tmp_path}/{n}", {"sensor": "long"}) for n in ("steps", "kernel"))
    for n in range(3):
        steps.advance(numbered.filter(F.col("n") == n).drop("n"), n, how)
    report = track_recording(points, kernel, how, by_frames=3)
    assert report.columns == steps.report().columns and report.dtypes == steps.report().dtypes
    same(described(report.collect()), described(steps.report().collect()))
    for n in range(3):
        same(described(kernel.version(n).collect()), described(steps.version(n).collect()))
    # a stream may go on from there
    more = spark.createDataFrame([(1, 9, i, 6.0 + 0.01 * i, 0.1, 1.0, 5.0) for i in range(12)], POINT)
    for t in (steps, kernel):
        t.advance(more, 3, how)
    same(described(kernel.report().collect()), described(steps.report().collect()))
    same(described(kernel.version(3).collect()), described(steps.version(3).collect()))


@pytest.mark.parametrize("rows, batch", [(1, 1), (20, 7), (90, 64)])
def test_chunks_give_the_same(monkeypatch, rows, batch):
    table = pa.table(list(map(list, zip(*sorted(scene(), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))))), names=["sensor", "frame_no", "pid", "range", "angle", "doppler", "snr"])
    schema = to_arrow_schema(StructType.fromDDL("sensor long, frame_no long, uid long, state string, seen long, s array<double>, _from long, _until long, epoch long, step long"))
    told = lambda batches: sorted(str(r) for b in track_kernel.Recording(["sensor"], TIGHT, 3, schema).run(iter(batches)) for r in b.to_pylist())
    want = told(table.to_batches())
    monkeypatch.setattr(track_kernel, "CHUNK_ROWS", rows)
    assert told(table.to_batches(max_chunksize=batch)) == want and len(want) > 60


def test_a_recording_stores_tracks_only(spark, tmp_path):
    """Points and judged points are not kept in the shared folder frame by frame."""
    kept = lambda: sum(1 for p in Path(work_folder(spark).removeprefix("file:")).rglob("part-*"))
    before = kept()
    report = track_recording(spark.createDataFrame(scene(), POINT), TrackTable(spark, f"{tmp_path}/t", {"sensor": "long"}), WIDE)
    assert report.count() and kept() == before
    assert {p.name.split("=")[0] for p in (tmp_path / "t").iterdir()} == {"report", "version"}
