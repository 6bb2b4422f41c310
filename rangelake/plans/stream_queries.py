"""Queries: the supplied tables read as streams and run over everything available."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangelake.plans.registry import SENSOR_A, TELEMETRY, query
from rangelake.operators import allocation
from rangelake.session import drain, drain_batches, drain_windows, work_folder
from rangelake.sources import adapters as ad
from rangelake.sources import manifest as mf
from rangelake.streaming import jobs, tracker


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream with an event time."""
    schema = ad.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("event_time", F.col("ts").cast("timestamp"))


@query("streamed_gap_counts", f"""SELECT stream, seq, missed, CAST(SUM(missed) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS missed_total
 FROM (SELECT stream, seq, greatest(0, COALESCE(seq - lag(seq) OVER (PARTITION BY stream ORDER BY seq) - 1, 0)) AS missed FROM ({TELEMETRY}))""")
def streamed_gap_counts(spark, sf):
    log = _events(spark, sf).filter("event_id % 7 <> 3").select((F.col("user_id") % 4).cast("long").alias("stream"), F.col("event_id").alias("seq"))
    return drain(jobs.gap_counter(log))


@query("streamed_rate", """SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, CAST(user_id AS BIGINT) AS sensor, COUNT(*) AS frames FROM events GROUP BY 1, 2""")
def streamed_rate(spark, sf):
    frames = _events(spark, sf).select(F.col("user_id").cast("long").alias("sensor"), "event_time")
    out = drain_windows(jobs.rate_windows(frames, "sensor", length="1 day", delay="1 hour"), ["start", "end", "sensor"])
    return out.select(F.expr("unix_micros(start) div 86400000000").alias("day"), "sensor", "frames")


@query("streamed_runtime", """SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, CAST(user_id AS BIGINT) AS sensor, round(AVG(value), 4) AS avg_runtime, COUNT(*) AS frames FROM events GROUP BY 1, 2""")
def streamed_runtime(spark, sf):
    frames = _events(spark, sf).select(F.col("user_id").cast("long").alias("sensor"), "event_time", "value")
    out = drain_windows(jobs.runtime_windows(frames, "sensor", F.col("value"), length="1 day", delay="1 hour"), ["start", "sensor"])
    return out.select(F.expr("unix_micros(start) div 86400000000").alias("day"), "sensor", F.round("avg_runtime", 4).alias("avg_runtime"), "frames")


_GATE = "SELECT CAST(user_id AS BIGINT) AS sensor, epoch_us(ts) / 1e6 AS ts, CASE event_type WHEN 'purchase' THEN 'on' ELSE 'off' END AS command FROM events WHERE event_type IN ('purchase', 'error')"


@query("streamed_recording", f"SELECT a.sensor, a.frame_no FROM ({SENSOR_A}) a ASOF JOIN ({_GATE}) c ON a.sensor = c.sensor AND a.ts >= c.ts WHERE c.command = 'on'")
def streamed_recording(spark, sf):
    log = ad.table(spark, sf, "events").filter(F.col("event_type").isin("purchase", "error")).select(
        F.col("user_id").cast("long").alias("sensor"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", "on").otherwise("off").alias("command"),
    )
    frames = _events(spark, sf).filter(F.col("event_type").isin("click", "view", "signup")).select(
        F.col("user_id").cast("long").alias("sensor"), F.col("event_id").cast("long").alias("frame_no"), (F.unix_micros("event_time") / 1e6).alias("ts")
    )
    return drain(jobs.recording_gate(frames, jobs.recording_spans(log, ["sensor"]), ["sensor"]).select("sensor", "frame_no"))


# A pair leaves once no older partner can come: the watermark minus the interval.
@query("streamed_fusion", """WITH r AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type IN ('click', 'view')), c AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type IN ('purchase', 'error')),
w AS (SELECT least((SELECT MAX(t) FROM r), (SELECT MAX(t) FROM c)) - 3600000000 AS mark)
SELECT CAST(r.user_id AS BIGINT) AS sensor, CAST(r.event_id AS BIGINT) AS frame_no, CAST(c.event_id AS BIGINT) AS camera_frame FROM r ASOF JOIN c ON r.user_id = c.user_id AND r.t >= c.t, w WHERE r.t - c.t <= 21600000000 AND r.t <= w.mark - 21600000000""")
def streamed_fusion(spark, sf):
    pick = lambda kinds, name: _events(spark, sf).filter(F.col("event_type").isin(kinds)).select(
        F.col("user_id").cast("long").alias("sensor"), F.col("event_id").cast("long").alias(name), "event_time"
    )
    out = jobs.fuse_streams(pick(["click", "view"], "frame_no"), pick(["purchase", "error"], "cam_no"), "sensor", max_gap="6 hours", delay="1 hour")
    return drain(out.select("sensor", "frame_no", F.col("camera.cam_no").alias("camera_frame")))


@query("latest_per_sensor", "SELECT CAST(user_id AS BIGINT) AS sensor, CAST(MAX(event_id) AS BIGINT) AS seq, COUNT(*) - 1 AS dropped FROM events GROUP BY 1")
def latest_per_sensor(spark, sf):
    batch = ad.table(spark, sf, "events").select(F.col("user_id").cast("long").alias("sensor"), F.col("event_id").cast("long").alias("seq"))
    return jobs.latest_only(batch, ["sensor"])


# Batches of ten seconds at 120 frames a second.
@query("replayed_frames", f"SELECT sensor, frame_no, round(ts, 3) AS ts, CAST((row_number() OVER (ORDER BY ts, frame_no) - 1) // 1200 AS BIGINT) AS batch FROM ({SENSOR_A})")
def replayed_frames(spark, sf):
    folder = f"{work_folder(spark)}/manifest-{uuid.uuid4().hex}"
    mf.in_time_order(ad.sensor_a(spark, sf).select("sensor", "frame_no", "ts"), folder)
    out = drain_batches(mf.replay(spark, folder, rate=120, interval=10, at_once=250))
    return out.select("sensor", "frame_no", F.round("ts", 3).alias("ts"), F.col("interval_no").alias("batch"))


def track_points(spark, sf):
    """Points of one sensor a supplier, a frame a line number."""
    x = lambda c: F.col(c).cast("double")
    return ad.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("sensor"), F.col("l_linenumber").cast("long").alias("frame_no"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("pid"),
        (1 + x("l_quantity") / 5).alias("range"), ((x("l_discount") - 0.05) * 20).alias("angle"), ((x("l_tax") - 0.02) * 50).alias("doppler"), (x("l_extendedprice") / 10000).alias("snr"),
    )


ALLOCATION = allocation.Allocation(max_velocity=2.0, max_distance2=1.5, points=3, snr=8.0, velocity=0.2)
TRACKER = allocation.Tracker(dt=0.5, v_max=5.0, volume=30.0, max_tracks=8, allocation=ALLOCATION, life={"strong": 3, "hits_to_start": 1, "misses_to_drop": 1, "misses_to_end": 2})


@query("allocated_groups")
def allocated_groups(spark, sf):
    return allocation.allocate(track_points(spark, sf), ["sensor", "frame_no"], TRACKER.v_max, ALLOCATION).select("sensor", "frame_no", "pid", "seed", F.round("doppler", 4).alias("doppler"))


@query("tracked_recording")
def tracked_recording(spark, sf):
    table = tracker.TrackTable(spark, f"{work_folder(spark)}/tracks-{uuid.uuid4().hex}", {"sensor": "long"})
    report = tracker.track_recording(track_points(spark, sf), table, TRACKER, by_frames=3)
    rounded = lambda c, i: F.round(F.col(c)[i], 4)
    return report.select("sensor", "frame_no", "uid", "state", "phase", "seen", *(rounded("s", i).alias(n) for i, n in enumerate(("x", "y", "vx", "vy"))), F.round("log_det", 3).alias("log_det"))
