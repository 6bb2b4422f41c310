"""Queries: time alignment, playback timeline and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangelake.operators import telemetry as tm
from rangelake.operators import timealign as ta
from rangelake.plans.registry import CONTROL, RD_MAP, SENSOR_A, SENSOR_B, TELEMETRY, query, rnd
from rangelake.sources import adapters as ad

_SENSOR_T = SENSOR_A.replace("'click', 'view', 'signup'", "'signup'")
_SENSOR_R = SENSOR_A.replace("'click', 'view', 'signup'", "'click', 'view'")


@query("common_start", f"""SELECT COALESCE(a.sensor, b.sensor) AS sensor, round(a.s, 3) AS start_a, round(b.s, 3) AS start_b,
 round(CASE WHEN a.s IS NULL THEN b.s WHEN b.s IS NULL THEN a.s ELSE greatest(a.s, b.s) END, 3) AS start_ts
 FROM (SELECT sensor, MIN(ts) AS s FROM ({SENSOR_A}) GROUP BY 1) a FULL JOIN (SELECT sensor, MIN(ts) AS s FROM ({SENSOR_B}) GROUP BY 1) b ON a.sensor = b.sensor""")
def common_start(spark, sf):
    out = ta.common_start(ad.sensor_a(spark, sf), ad.sensor_b(spark, sf), ["sensor"])
    return out.select("sensor", *[rnd(c, 3).alias(c) for c in ("start_a", "start_b", "start_ts")])


_NEAREST = f"""WITH a AS ({SENSOR_A}), b AS ({SENSOR_B}),
p AS (SELECT a.sensor, a.frame_no, a.ts, b.frame_no AS pf, b.ts AS pt FROM a ASOF LEFT JOIN b ON a.sensor = b.sensor AND a.ts >= b.ts),
q AS (SELECT a.frame_no, b.frame_no AS nf, b.ts AS nt FROM a ASOF LEFT JOIN b ON a.sensor = b.sensor AND a.ts <= b.ts),
j AS (SELECT p.sensor, p.frame_no, p.ts, pf, pt, nf, nt, CASE WHEN nf IS NULL OR p.ts - pt <= nt - p.ts THEN 1 ELSE 2 END AS pick FROM p JOIN q ON p.frame_no = q.frame_no)"""


@query("asof_nearest", _NEAREST + """ SELECT sensor, frame_no, CASE pick WHEN 1 THEN pf ELSE nf END AS match_frame,
 round(abs(ts - CASE pick WHEN 1 THEN pt ELSE nt END), 3) AS gap FROM j""")
def asof_nearest(spark, sf):
    out = ta.asof_nearest(ad.sensor_a(spark, sf).drop("value"), ad.sensor_b(spark, sf).drop("value"), ["sensor"])
    return out.select("sensor", "frame_no", F.col("r_frame_no").alias("match_frame"), rnd(F.abs(F.col("ts") - F.col("r_ts")), 3).alias("gap"))


@query("asof_nearest_tolerance", _NEAREST + """ SELECT sensor, frame_no, CASE WHEN abs(ts - CASE pick WHEN 1 THEN pt ELSE nt END) <= 3600
 THEN CASE pick WHEN 1 THEN pf ELSE nf END END AS match_frame FROM j""")
def asof_nearest_tolerance(spark, sf):
    out = ta.asof_nearest(ad.sensor_a(spark, sf).drop("value"), ad.sensor_b(spark, sf).drop("value"), ["sensor"], 3600.0)
    return out.select("sensor", "frame_no", F.col("r_frame_no").alias("match_frame"))


@query("due_frames", f"""WITH a AS ({SENSOR_A}), b AS ({SENSOR_B}),
st AS (SELECT sensor, MIN(ts) AS s FROM b GROUP BY 1), f AS (SELECT b.sensor, b.frame_no, b.ts - st.s AS pos FROM b JOIN st ON b.sensor = st.sensor),
t AS (SELECT sensor, frame_no, value * 3600 AS pos FROM a)
SELECT t.sensor, t.frame_no, f.frame_no AS due_frame FROM t ASOF LEFT JOIN f ON t.sensor = f.sensor AND t.pos >= f.pos""")
def due_frames(spark, sf):
    frames = ad.sensor_b(spark, sf).drop("value")
    starts = frames.groupBy("sensor").agg(F.min("ts").alias("start_ts"))
    ticks = ad.sensor_a(spark, sf).select("sensor", "frame_no", (F.col("value") * 3600).alias("position"))
    out = ta.due_frames(ticks, frames.select("sensor", "ts", "frame_no"), starts, ["sensor"], "position")
    return out.select("sensor", "frame_no", F.col("r_frame_no").alias("due_frame"))


@query("fused_latest", f"""WITH t AS ({_SENSOR_T}), r AS ({_SENSOR_R}), c AS ({SENSOR_B}),
x AS (SELECT t.sensor, t.frame_no, t.ts, r.frame_no AS radar_frame FROM t ASOF LEFT JOIN r ON t.sensor = r.sensor AND t.ts >= r.ts)
SELECT x.sensor, x.frame_no, x.radar_frame, c.frame_no AS camera_frame FROM x ASOF LEFT JOIN c ON x.sensor = c.sensor AND x.ts >= c.ts""")
def fused_latest(spark, sf):
    events = ad._sensor
    ticks, radar, camera = events(spark, sf, ["signup"]), events(spark, sf, ["click", "view"]), ad.sensor_b(spark, sf)
    out = ta.fuse_latest(ticks.drop("value"), radar.drop("value"), camera.drop("value"), ["sensor"])
    return out.select("sensor", "frame_no", F.col("radar_frame_no").alias("radar_frame"), F.col("camera_frame_no").alias("camera_frame"))


_PLACED = f"SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY ts, frame_no) - 1 AS pos, COUNT(*) OVER (PARTITION BY sensor) AS n FROM ({SENSOR_A})"


@query("seek_frame", f"SELECT sensor, frame_no, round(ts, 3) AS ts FROM ({_PLACED}) WHERE pos = 7")
def seek_frame(spark, sf):
    return ta.seek(ad.sensor_a(spark, sf), ["sensor"], frame=7).select("sensor", "frame_no", rnd("ts", 3).alias("ts"))


@query("seek_percent", f"SELECT sensor, frame_no, round(ts, 3) AS ts FROM ({_PLACED}) WHERE pos = CAST(floor(0.37::DOUBLE * (n - 1)) AS BIGINT)")
def seek_percent(spark, sf):
    return ta.seek(ad.sensor_a(spark, sf), ["sensor"], percent=37).select("sensor", "frame_no", rnd("ts", 3).alias("ts"))


@query("seek_time", f"""SELECT sensor, frame_no, round(ts, 3) AS ts FROM ({SENSOR_A})
 QUALIFY row_number() OVER (PARTITION BY sensor ORDER BY abs(ts - 1705000000), ts, frame_no) = 1""")
def seek_time(spark, sf):
    return ta.seek(ad.sensor_a(spark, sf), ["sensor"], time=1705000000.0).select("sensor", "frame_no", rnd("ts", 3).alias("ts"))


@query("frame_drops", f"""SELECT stream, seq, missed, CAST(SUM(missed) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS missed_total
 FROM (SELECT stream, seq, greatest(0, COALESCE(seq - lag(seq) OVER (PARTITION BY stream ORDER BY seq) - 1, 0)) AS missed FROM ({TELEMETRY}))""")
def frame_drops(spark, sf):
    return tm.frame_drops(ad.telemetry_log(spark, sf), ["stream"]).select("stream", "seq", "missed", "missed_total")


_LAT = f"""SELECT stream, seq, (display_ns - capture_ns) / 1e6 AS e2e_ms, (enqueue_ns - capture_ns) / 1e6 AS capture_to_queue_ms,
 (recv_ns - enqueue_ns) / 1e6 AS queue_to_analyser_ms, (end_ns - recv_ns) / 1e6 AS analyse_ms, (main_ns - end_ns) / 1e6 AS analyser_to_main_ms,
 (display_ns - main_ns) / 1e6 AS main_to_display_ms FROM ({TELEMETRY}) WHERE capture_ns > 0 AND enqueue_ns > 0 AND recv_ns > 0 AND end_ns > 0 AND main_ns > 0 AND display_ns > 0"""
_STAGES = ["e2e_ms", "capture_to_queue_ms", "queue_to_analyser_ms", "analyse_ms", "analyser_to_main_ms", "main_to_display_ms"]


@query("stage_latency", _LAT)
def stage_latency(spark, sf):
    return tm.stage_latency(ad.telemetry_log(spark, sf)).select("stream", "seq", *_STAGES)


@query("latency_summary", f"""SELECT stream, COUNT(*) AS frames, round(AVG(e2e_ms), 4) AS mean_ms, quantile_disc(e2e_ms, 0.5) AS p50_ms,
 quantile_disc(e2e_ms, 0.99) AS p99_ms, MAX(e2e_ms) AS max_ms FROM ({_LAT}) GROUP BY 1""")
def latency_summary(spark, sf):
    return tm.latency_summary(ad.telemetry_log(spark, sf), ["stream"]).withColumn("mean_ms", rnd("mean_ms"))


@query("rolling_rate", f"""SELECT sensor, frame_no, round(COUNT(*) OVER (PARTITION BY sensor ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) / 86400.0, 7) AS fps
 FROM (SELECT CAST(user_id AS BIGINT) AS sensor, CAST(event_id AS BIGINT) AS frame_no, epoch_us(ts) AS us FROM events)""")
def rolling_rate(spark, sf):
    events = ad.table(spark, sf, "events").select(
        F.col("user_id").cast("long").alias("sensor"), F.col("event_id").cast("long").alias("frame_no"), "ts"
    )
    out = tm.rolling_fps(events, ["sensor"], F.unix_micros(F.col("ts").cast("timestamp")), 86400.0, 8)
    return out.select("sensor", "frame_no", rnd("fps", 7).alias("fps"))


_RUN = f"SELECT stream, seq, CAST((end_ns - recv_ns) AS DOUBLE) / 1e6 AS ms, row_number() OVER (PARTITION BY stream ORDER BY seq) - 1 AS pos FROM ({TELEMETRY})"


@query("block_runtime", f"SELECT stream, pos // 150 AS block, round(AVG(ms), 4) AS avg_runtime FROM ({_RUN}) GROUP BY 1, 2 HAVING COUNT(*) = 150")
def block_runtime(spark, sf):
    ms = (F.col("end_ns") - F.col("recv_ns")) / 1e6
    return tm.avg_runtime(ad.telemetry_log(spark, sf), ["stream"], ["seq"], ms).withColumn("avg_runtime", rnd("avg_runtime"))


@query("cumulative_runtime", f"SELECT stream, seq, round(AVG(ms) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS cumulative_avg FROM ({_RUN})")
def cumulative_runtime(spark, sf):
    ms = (F.col("end_ns") - F.col("recv_ns")) / 1e6
    out = tm.cumulative_runtime(ad.telemetry_log(spark, sf), ["stream"], ["seq"], ms)
    return out.select("stream", "seq", rnd("cumulative_avg").alias("cumulative_avg"))


_LINE = f"""c AS ({CONTROL}), s AS (SELECT *, COALESCE(last_value(CASE command WHEN 'play' THEN 1.0 WHEN 'pause' THEN 0.0 WHEN 'stop' THEN 0.0 END IGNORE NULLS) OVER w, 0.0) AS on_,
 COALESCE(last_value(CASE command WHEN 'speed' THEN arg END IGNORE NULLS) OVER w, 1.0) AS speed FROM c WINDOW w AS (PARTITION BY session ORDER BY wall, seq ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, COALESCE((wall - lag(wall) OVER w) * lag(on_ * speed) OVER w, 0.0) AS adv FROM s WINDOW w AS (PARTITION BY session ORDER BY wall, seq)),
r AS (SELECT *, SUM(adv) OVER (PARTITION BY session ORDER BY wall, seq ROWS UNBOUNDED PRECEDING) AS run FROM a),
l AS (SELECT session, wall, seq, command, speed, on_ > 0 AS playing,
 COALESCE(last_value(CASE command WHEN 'seek' THEN arg WHEN 'stop' THEN 0.0 END - run IGNORE NULLS) OVER (PARTITION BY session ORDER BY wall, seq ROWS UNBOUNDED PRECEDING), 0.0) + run AS position FROM r)"""


@query("playback_timeline", f"WITH {_LINE} SELECT session, seq, command, CAST(speed AS DOUBLE) AS speed, playing, round(CAST(position AS DOUBLE), 2) + 0.0 AS position FROM l")
def playback_timeline(spark, sf):
    return tm.timeline(ad.control_log(spark, sf), ["session"]).select("session", "seq", "command", "speed", "playing", rnd("position", 2).alias("position"))


@query("seek_events", f"""WITH {_LINE}, z AS (SELECT session, wall, seq, round(CAST(position AS DOUBLE), 2) AS position FROM l), p AS (SELECT *, lag(position) OVER (PARTITION BY session ORDER BY wall, seq) AS q FROM z)
SELECT session, seq, position + 0.0 AS position FROM p WHERE position < q - 0.05 OR abs(position - q) > 0.5 OR position = 0""")
def seek_events(spark, sf):
    line = tm.timeline(ad.control_log(spark, sf), ["session"]).withColumn("position", rnd("position", 2))
    return tm.detect_seeks(line, ["session"]).select("session", "seq", "position")


@query("robust_levels", f"""WITH m AS ({RD_MAP}), a AS (SELECT map, quantile_cont(CAST(value AS DOUBLE), 0.01) AS p1, quantile_cont(CAST(value AS DOUBLE), 0.99) AS p99, MIN(value) AS lo, MAX(value) AS hi FROM m GROUP BY 1)
SELECT map, round(CASE WHEN p1 < p99 THEN p1 ELSE lo END, 4) + 0.0 AS level_min, round(CASE WHEN p1 < p99 THEN p99 WHEN lo < hi THEN hi ELSE lo + 1 END, 4) + 0.0 AS level_max FROM a""")
def robust_levels(spark, sf):
    out = tm.robust_levels(ad.rd_map(spark, sf), ["map"], "value")
    return out.select("map", rnd("level_min").alias("level_min"), rnd("level_max").alias("level_max"))


@query("recording_summary", f"""SELECT sensor, frames, round(first_ts, 3) AS first_ts, round(last_ts, 3) AS last_ts, round(last_ts - first_ts, 3) AS duration,
 round((frames - 1) / (last_ts - first_ts), 7) AS rate, round(CAST(done AS DOUBLE) / frames * 100, 4) AS progress_percent FROM
 (SELECT sensor, COUNT(*) AS frames, MIN(ts) AS first_ts, MAX(ts) AS last_ts, SUM(CASE WHEN ts < 1705000000 THEN 1 ELSE 0 END) AS done FROM ({SENSOR_A}) GROUP BY 1)""")
def recording_summary(spark, sf):
    out = tm.recording_summary(ad.sensor_a(spark, sf), ["sensor"], at=F.lit(1705000000.0))
    return out.select("sensor", "frames", *[rnd(c, d).alias(c) for c, d in (("first_ts", 3), ("last_ts", 3), ("duration", 3), ("rate", 7), ("progress_percent", 4))])
