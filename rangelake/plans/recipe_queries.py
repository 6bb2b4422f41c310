"""Queries: whole recipes on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangelake.operators import angles as an
from rangelake.operators import cfar as cf
from rangelake.operators import clutter as cl
from rangelake.operators import peaks as pk
from rangelake.functions import units as un
from rangelake.plans import recipes as rc
from rangelake.plans.registry import BOXES, IQ, SENSOR_A, SENSOR_B, SQL, POINTS, query, rnd
from rangelake.sources import adapters as ad

CFG = rc.Sensor(chirps=25, tx=1, rx=4, samples=32, range_resolution=0.7, doppler_resolution=0.29)


# Bartlett form of the flagship: clutter, covariance, beam power, dual-axis detection, position.
_CLEAN = f"(SELECT frame_no, vant, chirp, sample AS range_bin, re - AVG(re) OVER w AS re, im - AVG(im) OVER w AS im FROM ({IQ}) WINDOW w AS (PARTITION BY frame_no, vant, sample))"
_POWER = f"""SELECT frame_no, range_bin, k AS az_bin, SUM(p) / 25 AS power FROM (SELECT frame_no, range_bin, chirp, k, pow(SUM(re * cos(a) - im * sin(a)), 2) + pow(SUM(re * sin(a) + im * cos(a)), 2) AS p
 FROM (SELECT c.*, k, pi() * vant * sin(radians(k * 5.0 - 85)) AS a FROM {_CLEAN} c, (SELECT unnest(range(0, 35)) AS k)) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""
_LINE = lambda part, order, size, name: f"""{name} AS (SELECT a.frame_no, a.range_bin, a.az_bin, SUM(b.value) / 8.0 AS nf FROM m a JOIN (SELECT unnest([-6, -5, -4, -3, 3, 4, 5, 6]) AS o) ON TRUE
 JOIN m b ON a.frame_no = b.frame_no AND a.{part} = b.{part} AND b.{order} = (a.{order} + o + {size}) % {size} GROUP BY 1, 2, 3)"""
_FLAG = f"""WITH m AS (SELECT frame_no, range_bin, az_bin, log2(power) AS value FROM ({_POWER})), {_LINE('range_bin', 'az_bin', 35, 'az')}, {_LINE('az_bin', 'range_bin', 32, 'rg')}
SELECT m.frame_no, m.range_bin, m.az_bin, round(m.value - rg.nf, 4) + 0.0 AS snr, round(-m.range_bin * 0.7::DOUBLE * sin(radians(m.az_bin * 5.0 - 85)), 4) + 0.0 AS x, round(m.range_bin * 0.7::DOUBLE * cos(radians(m.az_bin * 5.0 - 85)), 4) + 0.0 AS y
FROM m JOIN az USING (frame_no, range_bin, az_bin) JOIN rg ON m.frame_no = rg.frame_no AND m.range_bin = rg.range_bin AND m.az_bin = rg.az_bin
WHERE m.value > az.nf + 0.2 AND m.value > rg.nf + 0.3 AND m.range_bin BETWEEN 4 AND 27 AND m.az_bin BETWEEN 4 AND 30"""


@query("beamformed_point_cloud", _FLAG)
def beamformed_point_cloud(spark, sf):
    cov = an.covariance(cl.remove_clutter(ad.rcube(spark, sf, numbered=True)), ["frame_no"], 4, ad.CHIRPS)
    power = an.beam_power(cov, 4, 85, 5)
    heat = power.select("frame_no", "range_bin", F.posexplode("spectrum").alias("az_bin", "p")).select(
        "frame_no", "range_bin", F.col("az_bin").cast("long").alias("az_bin"), F.log2("p").alias("value")
    )
    hits = cf.dual_axis_peaks(heat, ["frame_no"], "az_bin", "range_bin", "value", 0.2, 0.3, 2, 4)
    hits = pk.skip_border(hits, {"az_bin": 35, "range_bin": 32}, 4)
    pts = un.polar_to_xy(hits.withColumns({"range_m": F.col("range_bin") * 0.7, "angle": F.col("az_bin") * 5.0 - 85}))
    return pts.select("frame_no", "range_bin", "az_bin", rnd("snr").alias("snr"), rnd("x").alias("x"), rnd("y").alias("y"))


@query("capon_point_cloud")
def capon_point_cloud(spark, sf):
    out = rc.process(ad.iq_rows(spark, sf), ["frame_no"], CFG, "capon", resolution=3, bounds=(0.2, 0.3), noise=4)
    return out.select("frame_no", "range_bin", "az_bin", *[rnd(c).alias(c) for c in ("x", "y", "z", "velocity", "snr")])


@query("doppler_point_cloud")
def doppler_point_cloud(spark, sf):
    # three transmitters: interleaved chirps of four receivers
    cube = ad.interleaved_rows(spark, sf, 3, 8, ["frame_no"])
    cfg = rc.Sensor(8, 3, 4, 32, 0.7, 0.29)
    loose = [(2, 0), (10, 0), (35, 0)]
    out = rc.process(cube, ["frame_no"], cfg, "doppler", guard=1, noise=2, bounds=(0.5, 0.5), snr_bands=loose, peak_bands=[(0, 0), (0, 0)])
    return out.select("frame_no", "range_bin", "doppler_bin", "peak_idx", *[rnd(c).alias(c) for c in ("x", "y", "z", "velocity", "snr")])


@query("hit_point_cloud")
def hit_point_cloud(spark, sf):
    out = rc.process(ad.iq_rows(spark, sf), ["frame_no"], CFG, "hits", indoor=False)
    return out.select("frame_no", "range_bin", "doppler_bin", "doa", *[rnd(c).alias(c) for c in ("x", "y", "velocity")])


# Spectra written as sums: range transform, clutter, Doppler transform, magnitude over antennas, 2-D detection.
_R = f"""SELECT frame_no, chirp, vant, r, SUM(re * cos(2 * pi() * r * sample / 32) + im * sin(2 * pi() * r * sample / 32)) AS re, SUM(im * cos(2 * pi() * r * sample / 32) - re * sin(2 * pi() * r * sample / 32)) AS im
FROM ({IQ}), (SELECT unnest(range(0, 32)) AS r) GROUP BY 1, 2, 3, 4"""
_RDC = f"""SELECT frame_no, vant, r, (d + 12) % 25 AS d, SUM(re * cos(2 * pi() * d * chirp / 25) + im * sin(2 * pi() * d * chirp / 25)) AS re, SUM(im * cos(2 * pi() * d * chirp / 25) - re * sin(2 * pi() * d * chirp / 25)) AS im
FROM (SELECT frame_no, chirp, vant, r, re - AVG(re) OVER w AS re, im - AVG(im) OVER w AS im FROM ({_R}) WINDOW w AS (PARTITION BY frame_no, vant, r)), (SELECT unnest(range(0, 25)) AS d) GROUP BY 1, 2, 3, 4"""


@query("hit_maps", f"""WITH p AS (SELECT frame_no, r, d, pow(SUM(sqrt(re * re + im * im)), 2) AS power FROM ({_RDC}) GROUP BY 1, 2, 3),
s AS (SELECT a.frame_no, a.r, a.d, a.power, AVG(b.power) AS noise FROM p a JOIN p b ON a.frame_no = b.frame_no AND abs(a.r - b.r) <= 4 AND abs(a.d - b.d) <= 2 AND NOT (abs(a.r - b.r) <= 1 AND abs(a.d - b.d) <= 1) GROUP BY 1, 2, 3, 4)
SELECT frame_no, r AS range_bin, d AS doppler_bin, round(sqrt(power), 4) AS level FROM s WHERE power / noise > {10 ** 0.15!r}""")
def hit_maps(spark, sf):
    _, hits = rc.hit_maps(ad.iq_rows(spark, sf), ["frame_no"], CFG, 1.5)
    return hits.select("frame_no", "range_bin", "doppler_bin", rnd("level").alias("level"))


_KAISER = lambda i, n, beta: f"(list_sum(list_transform(range(0, 30), lambda q: pow({beta} / 2 * sqrt(greatest(0.0, 1 - pow(2 * {i} / {n - 1}.0 - 1, 2))), 2 * q) / (gamma(q + 1.0) * gamma(q + 1.0)))) / list_sum(list_transform(range(0, 30), lambda q: pow({beta} / 2, 2 * q) / (gamma(q + 1.0) * gamma(q + 1.0)))))"
_KR = f"""SELECT frame_no, chirp, vant, r, SUM(w * (re * cos(2 * pi() * r * sample / 32) + im * sin(2 * pi() * r * sample / 32))) AS re, SUM(w * (im * cos(2 * pi() * r * sample / 32) - re * sin(2 * pi() * r * sample / 32))) AS im
FROM (SELECT *, {_KAISER('sample', 32, '4.0')} AS w FROM ({IQ})), (SELECT unnest(range(0, 32)) AS r) GROUP BY 1, 2, 3, 4"""
_KRD = f"""SELECT frame_no, vant, r, (d + 12) % 25 AS d, SUM(w * (re * cos(2 * pi() * d * chirp / 25) + im * sin(2 * pi() * d * chirp / 25))) AS re, SUM(w * (im * cos(2 * pi() * d * chirp / 25) - re * sin(2 * pi() * d * chirp / 25))) AS im
FROM (SELECT frame_no, chirp, vant, r, {_KAISER('chirp', 25, '8.0')} AS w, re - AVG(re) OVER g AS re, im - AVG(im) OVER g AS im FROM ({_KR}) WINDOW g AS (PARTITION BY frame_no, vant, r)), (SELECT unnest(range(0, 25)) AS d) GROUP BY 1, 2, 3, 4"""
SQL["hit_point_cloud"] = f"""WITH z AS MATERIALIZED ({_KRD}), p AS (SELECT frame_no, r, d, pow(SUM(sqrt(re * re + im * im)), 2) AS power FROM z GROUP BY 1, 2, 3),
s AS (SELECT a.frame_no, a.r, a.d, a.power, AVG(b.power) AS noise FROM p a JOIN p b ON a.frame_no = b.frame_no AND abs(a.r - b.r) <= 4 AND abs(a.d - b.d) <= 2 AND NOT (abs(a.r - b.r) <= 1 AND abs(a.d - b.d) <= 1) GROUP BY 1, 2, 3, 4),
h AS (SELECT * FROM s WHERE power / noise > {10 ** 0.5!r}),
y AS (SELECT h.frame_no, h.r, h.d, t, pow(SUM(re * cos(pi() * vant * cos(radians(t))) + im * sin(pi() * vant * cos(radians(t)))), 2) + pow(SUM(im * cos(pi() * vant * cos(radians(t))) - re * sin(pi() * vant * cos(radians(t)))), 2) AS q
 FROM h JOIN z ON h.frame_no = z.frame_no AND h.r = z.r AND h.d = z.d, (SELECT unnest(range(0, 180)) AS t) GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY h.frame_no, h.r, h.d ORDER BY q DESC, t) = 1)
SELECT frame_no, r AS range_bin, d AS doppler_bin, t AS doa, round(-r * 0.7::DOUBLE * sin(radians(t - 90)), 4) + 0.0 AS x, round(r * 0.7::DOUBLE * cos(radians(t - 90)), 4) + 0.0 AS y, round((d - 12) * 0.29::DOUBLE, 4) + 0.0 AS velocity FROM y"""


@query("fused_scene", f"""WITH a AS ({SENSOR_A}), b AS ({SENSOR_B}), s AS (SELECT sensor, MIN(ts) AS t0, COUNT(*) AS n, MAX(ts) AS t1 FROM a GROUP BY 1),
p AS (SELECT a.sensor, a.frame_no, a.ts, b.frame_no AS pf, b.ts AS pt FROM a ASOF LEFT JOIN b ON a.sensor = b.sensor AND a.ts >= b.ts),
q AS (SELECT a.frame_no, b.frame_no AS nf, b.ts AS nt FROM a ASOF LEFT JOIN b ON a.sensor = b.sensor AND a.ts <= b.ts),
j AS (SELECT p.sensor, p.frame_no, p.ts, CASE WHEN nf IS NULL OR p.ts - pt <= nt - p.ts THEN pf ELSE nf END AS camera_frame FROM p JOIN q ON p.frame_no = q.frame_no),
c AS (SELECT frame_no, COUNT(*) AS n_points, AVG(vel) AS mv FROM ({POINTS}) GROUP BY 1), o AS (SELECT frame_no, COUNT(*) AS n_objects FROM ({BOXES}) WHERE class_id IN (0, 1, 2, 3) AND confidence > 0.5 GROUP BY 1)
SELECT j.sensor, j.frame_no, camera_frame, round(j.ts - t0, 2) AS timeline, COALESCE(n_points, 0) AS n_points, round(mv, 4) + 0.0 AS mean_velocity, COALESCE(n_objects, 0) AS n_objects
FROM j JOIN s ON j.sensor = s.sensor LEFT JOIN c ON c.frame_no = j.frame_no LEFT JOIN o ON o.frame_no = j.camera_frame""")
def fused_scene(spark, sf):
    a, b = ad.sensor_a(spark, sf).drop("value"), ad.sensor_b(spark, sf).drop("value")
    owner = a.unionByName(b).select("sensor", "frame_no")
    points = ad.points(spark, sf).select("frame_no", F.col("vel").alias("velocity"), F.col("x").alias("snr")).join(owner, "frame_no")
    boxes = pk.filter_boxes(ad.boxes_raw(spark, sf)).join(owner, "frame_no")
    out = rc.fused_scene(points, boxes, a, b, ["sensor"])
    return out.select(
        "sensor", "frame_no", F.col("camera_frame_no").alias("camera_frame"), rnd("timeline", 2).alias("timeline"), "n_points", rnd("mean_velocity").alias("mean_velocity"), "n_objects"
    )
