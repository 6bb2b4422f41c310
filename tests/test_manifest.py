"""Manifests and replay in time order, on real files and real tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangelake.sources import manifest as mf


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two recordings whose files were written newest first; equal times in both; an empty file, a foreign name."""
    root = tmp_path_factory.mktemp("manifest")
    for name, shift in (("b", 0), ("a", 3)):
        (root / name / "deep").mkdir(parents=True)
        for i in reversed(range(20)):
            place = root / name / ("deep" if i % 2 else "")
            (place / f"{i + shift:010d}_{i * 1000:05d}_{i + shift:012d}.bin").write_bytes(np.arange(4, dtype="<i2").tobytes() + bytes([i]))
    (root / "a" / "0000000099_00000_000000000099.bin").write_bytes(b"")
    (root / "a" / "notes.bin").write_bytes(b"x")
    return str(root)


def run(stream, out, checkpoint, batches=None):
    """Drain (or stop after some batches); what each batch brought, in order."""
    seen = []

    def keep(batch, epoch):
        rows = [(r.ts, r.frame_no) for r in batch.select("ts", "frame_no").collect()]
        seen.append((epoch, rows))
        if batches is not None and len(seen) > batches:
            raise RuntimeError("the machine goes down")
        out.append(rows)

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    except Exception:
        assert batches is not None
    query.stop()
    return seen


def test_manifest(spark, folder, tmp_path):
    table = mf.write_manifest(spark, folder, str(tmp_path / "m"))
    rows = table.collect()
    assert len(rows) == 40 and [(r.ts, r.frame_no) for r in rows] == sorted((r.ts, r.frame_no) for r in rows)
    assert {r.length for r in rows} == {9}
    late = mf.with_payload(table.filter("frame_no >= 20 AND ts > 20")).collect()
    assert {(r.frame_no, bytes(r.payload)[-1]) for r in late} == {(r.frame_no, r.frame_no - 3) for r in rows if r.frame_no >= 20}


def test_replay_goes_on_after_a_failure(spark, folder, tmp_path):
    table = mf.write_manifest(spark, folder, str(tmp_path / "m"))
    want = sorted((r.ts, r.frame_no) for r in table.collect())
    got, state = [], str(tmp_path / "state")
    stream = lambda: mf.replay(spark, str(tmp_path / "m"), rate=5, interval=1)
    run(stream(), got, state, batches=3)
    assert [x for rows in got for x in sorted(rows)] == want[: sum(map(len, got))] and len(got) == 3
    run(stream(), got, state)
    assert [x for rows in got for x in sorted(rows)] == want
    assert all(5 <= len(rows) <= 6 for rows in got[:-1])
    assert [rows for _, rows in run(stream(), got, state) if rows] == []


def test_ties_stay_together_and_frames_are_skipped(spark, tmp_path):
    rows = spark.range(30).select(F.lit("r").alias("recording"), F.floor(F.col("id") / 6).alias("frame_no"), F.floor(F.col("id") / 6).cast("double").alias("ts"))
    mf.in_time_order(rows, str(tmp_path / "m"))
    got = []
    run(mf.replay(spark, str(tmp_path / "m"), rate=2, interval=2, skip=2), got, str(tmp_path / "s"))
    assert [sorted(r) for r in got if r] == [[(k, k)] * 6 for k in (0.0, 2.0, 4.0)]


def test_an_empty_manifest(spark, tmp_path):
    rows = spark.createDataFrame([], "recording string, frame_no long, ts double")
    mf.in_time_order(rows, str(tmp_path / "m"))
    got = []
    run(mf.replay(spark, str(tmp_path / "m")), got, str(tmp_path / "s"))
    assert [r for rows in got for r in rows] == []  # the first batch may be empty


def test_replay_catches_up_with_many_intervals_a_batch(spark, tmp_path):
    """Intervals are cut as one by one, ties included; a restart goes on with the numbers; few batches."""
    rows = spark.range(100).select(F.floor(F.col("id") / F.when(F.col("id") < 30, 6).otherwise(1)).alias("frame_no")).withColumn("ts", F.col("frame_no").cast("double"))
    mf.in_time_order(rows, str(tmp_path / "m"))
    keys = sorted(r.frame_no for r in rows.collect())
    got, seen = [], []

    def keep(batch, epoch):
        if len(seen) == 2:
            seen.append("down")
            raise RuntimeError("the machine goes down")
        seen.append(epoch)
        got.extend((r.frame_no, r.interval_no) for r in batch.collect())

    for _ in range(2):
        stream = mf.replay(spark, str(tmp_path / "m"), rate=2, interval=2, at_once=5)
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "s")).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        except Exception:
            assert "down" in seen
        query.stop()
    assert len(got) == 100 and [k for k, _ in sorted(got)] == keys
    cuts, at = [], 0
    while at < len(keys):
        end = min(at + 4, len(keys))
        while end < len(keys) and keys[end] == keys[end - 1]:
            end += 1
        cuts.append(keys[at:end])
        at = end
    assert sorted(got) == [(k, n) for n, own in enumerate(cuts) for k in own]
    assert len(seen) <= 8
