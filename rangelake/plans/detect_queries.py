"""Queries: CFAR, hit maps, peak grouping, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangelake.operators import cfar as cf
from rangelake.operators import peaks as pk
from rangelake.sources import adapters as ad
from rangelake.plans.registry import BOXES, POINTS, RD_MAP, SIGNAL, SIGNAL_BIG, query, rnd


def _det(df):
    return df.filter("detected").select(
        "part", "ord", "v", rnd("noise_floor").alias("noise_floor"), rnd("threshold").alias("threshold"),
        rnd(F.col("v") - F.col("noise_floor")).alias("snr"),
    )


def _wrap_sql(signal: str, guard: int, noise: int, floor_sql: str, threshold: str = "noise_floor + 20") -> str:
    span = guard + noise
    return f"""WITH s AS ({signal}), p AS (SELECT part, ord, v, row_number() OVER (PARTITION BY part ORDER BY ord) - 1 AS pos,
  count(*) OVER (PARTITION BY part) AS n FROM s),
x AS (SELECT part, ord, v, pos, pos AS idx, TRUE AS own FROM p
  UNION ALL SELECT part, ord, v, pos, pos + n, FALSE FROM p WHERE pos < {span}
  UNION ALL SELECT part, ord, v, pos, pos - n, FALSE FROM p WHERE pos >= n - {span}),
w AS (SELECT *, SUM(v) OVER (PARTITION BY part ORDER BY idx ROWS BETWEEN {span} PRECEDING AND {guard + 1} PRECEDING) AS l,
  SUM(v) OVER (PARTITION BY part ORDER BY idx ROWS BETWEEN {guard + 1} FOLLOWING AND {span} FOLLOWING) AS r FROM x),
f AS (SELECT part, ord, v, {floor_sql} AS noise_floor FROM w WHERE own)
SELECT part, ord, v, round(noise_floor, 4) + 0.0 AS noise_floor, round({threshold}, 4) + 0.0 AS threshold, round(v - noise_floor, 4) + 0.0 AS snr
FROM f WHERE v > {threshold}"""


def _const_sql(signal: str, guard: int, noise: int, floor_sql: str) -> str:
    span = guard + noise
    return f"""WITH s AS ({signal}), p AS (SELECT part, ord, v, row_number() OVER o - 1 AS pos, count(*) OVER (PARTITION BY part) AS n,
  COALESCE(SUM(v) OVER (PARTITION BY part ORDER BY ord ROWS BETWEEN {span} PRECEDING AND {guard + 1} PRECEDING), 0) AS l,
  COALESCE(SUM(v) OVER (PARTITION BY part ORDER BY ord ROWS BETWEEN {guard + 1} FOLLOWING AND {span} FOLLOWING), 0) AS r
  FROM s WINDOW o AS (PARTITION BY part ORDER BY ord)),
f AS (SELECT part, ord, v, {floor_sql} AS noise_floor FROM p)
SELECT part, ord, v, round(noise_floor, 4) + 0.0 AS noise_floor, round(noise_floor + 20, 4) + 0.0 AS threshold, round(v - noise_floor, 4) + 0.0 AS snr
FROM f WHERE v > noise_floor + 20"""


@query("cfar_ca_wrap", _wrap_sql(SIGNAL, 1, 3, "(l + r) / 6.0"))
def cfar_ca_wrap(spark, sf):
    return _det(cf.cfar(ad.signal(spark, sf), ["part"], ["ord"], "v", "ca", 1, 3, 20))


@query("cfar_ca_constant", _const_sql(SIGNAL, 1, 3, "(l + r) / 6.0"))
def cfar_ca_constant(spark, sf):
    return _det(cf.cfar(ad.signal(spark, sf), ["part"], ["ord"], "v", "ca", 1, 3, 20, "constant"))


@query("cfar_caso_wrap", _wrap_sql(SIGNAL, 1, 3, "least(l / 3.0, r / 3.0)"))
def cfar_caso_wrap(spark, sf):
    return _det(cf.cfar(ad.signal(spark, sf), ["part"], ["ord"], "v", "caso", 1, 3, 20))


_EDGE = "CASE WHEN pos >= n - 4 THEN l / 3.0 WHEN pos < 4 THEN r / 3.0 ELSE {}(l / 3.0, r / 3.0) END"


@query("cfar_caso_constant", _const_sql(SIGNAL, 1, 3, _EDGE.format("least")))
def cfar_caso_constant(spark, sf):
    return _det(cf.cfar(ad.signal(spark, sf), ["part"], ["ord"], "v", "caso", 1, 3, 20, "constant"))


@query("cfar_cago_wrap", _wrap_sql(SIGNAL, 1, 3, "greatest(l / 3.0, r / 3.0)"))
def cfar_cago_wrap(spark, sf):
    return _det(cf.cfar(ad.signal(spark, sf), ["part"], ["ord"], "v", "cago", 1, 3, 20))


@query("cfar_cago_constant", _const_sql(SIGNAL, 1, 3, _EDGE.format("greatest")))
def cfar_cago_constant(spark, sf):
    return _det(cf.cfar(ad.signal(spark, sf), ["part"], ["ord"], "v", "cago", 1, 3, 20, "constant"))


@query("cfar_ca_integer", _wrap_sql(SIGNAL, 1, 3, "floor((l + r) / 6.0)"))
def cfar_ca_integer(spark, sf):
    return _det(cf.cfar(ad.signal(spark, sf), ["part"], ["ord"], "v", "ca", 1, 3, 20, integer=True))


_OS_SQL = f"""WITH s AS ({SIGNAL}), p AS (SELECT part, ord, v, row_number() OVER (PARTITION BY part ORDER BY ord) - 1 AS pos,
  count(*) OVER (PARTITION BY part) AS n FROM s),
x AS (SELECT part, ord, v, pos, pos AS idx, TRUE AS own FROM p
  UNION ALL SELECT part, ord, v, pos, pos + n, FALSE FROM p WHERE pos < 3
  UNION ALL SELECT part, ord, v, pos, pos - n, FALSE FROM p WHERE pos >= n - 3),
w AS (SELECT part, ord, v, own, list_concat(
   array_agg(v) OVER (PARTITION BY part ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
   array_agg(v) OVER (PARTITION BY part ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS c FROM x),
f AS (SELECT part, ord, v, list_sort(c)[4] AS noise_floor FROM w WHERE own)
SELECT part, ord, v, round(CAST(noise_floor AS DOUBLE), 4) + 0.0 AS noise_floor, round(noise_floor * 1.1::DOUBLE, 4) + 0.0 AS threshold,
  round(CAST(v - noise_floor AS DOUBLE), 4) + 0.0 AS snr FROM f WHERE v > noise_floor * 1.1::DOUBLE"""


@query("cfar_os", _OS_SQL)
def cfar_os(spark, sf):
    return _det(cf.cfar(ad.signal(spark, sf), ["part"], ["ord"], "v", "os", 0, 3, k=3, scale=1.1))


_BIG_CFAR_SQL = f"""WITH d AS ({_wrap_sql(SIGNAL_BIG, 2, 8, "(l + r) / 16.0")})
SELECT part, COUNT(*) AS hits, SUM(v) AS hit_sum, round(SUM(threshold), 2) + 0.0 AS threshold_sum FROM d GROUP BY part"""


@query("cfar_supplier_profile", _BIG_CFAR_SQL)
def cfar_supplier_profile(spark, sf):
    hits = cf.cfar(ad.signal_big(spark, sf), ["part"], ad.BIG_ORDER, "v", "ca", 2, 8, 20)
    return hits.filter("detected").groupBy("part").agg(
        F.count(F.lit(1)).alias("hits"), F.sum("v").alias("hit_sum"),
        rnd(F.sum(rnd("threshold")), 2).alias("threshold_sum"),
    )


_CFAR2D_SQL = f"""WITH m AS ({RD_MAP}), a AS (SELECT *, CAST(value AS DOUBLE) * value AS power FROM m),
b AS (SELECT *, SUM(power) OVER (PARTITION BY map, doppler_bin ORDER BY range_bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS bp,
 SUM(power) OVER (PARTITION BY map, doppler_bin ORDER BY range_bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS gp,
 COUNT(*) OVER (PARTITION BY map, doppler_bin ORDER BY range_bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS bc,
 COUNT(*) OVER (PARTITION BY map, doppler_bin ORDER BY range_bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS gc FROM a),
c AS (SELECT *, SUM(bp) OVER (PARTITION BY map, range_bin ORDER BY doppler_bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
  - SUM(gp) OVER (PARTITION BY map, range_bin ORDER BY doppler_bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS p,
 SUM(bc) OVER (PARTITION BY map, range_bin ORDER BY doppler_bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
  - SUM(gc) OVER (PARTITION BY map, range_bin ORDER BY doppler_bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS k FROM b)
SELECT map, range_bin, doppler_bin, round(power, 4) + 0.0 AS power, round(p / k, 4) + 0.0 AS noise_power FROM c
WHERE (p > 0 AND power / (p / k) > power_limit) OR (p = 0 AND power > 0)""".replace("power_limit", repr(10 ** 0.5))


def _map_cfar(spark, sf):
    v = F.col("value").cast("double")
    return cf.cfar_2d(ad.rd_map(spark, sf), ["map"], "doppler_bin", "range_bin", v * v, [4, 2, 1, 1], 5.0)


@query("cfar_map_2d", _CFAR2D_SQL)
def cfar_map_2d(spark, sf):
    return _map_cfar(spark, sf).filter("hit").select(
        "map", "range_bin", "doppler_bin", rnd("power").alias("power"), rnd("noise_power").alias("noise_power")
    )


def _axis_pass(other: str, axis: str, size: int, name: str) -> str:
    """Noise floor along one axis that closes in a ring: 1 guard and 4 noise cells on each side, by sums over windows."""
    return f"""{name}x AS (SELECT map, {other}, {axis}, {axis} AS idx, TRUE AS own, value FROM m UNION ALL SELECT map, {other}, {axis}, {axis} - {size}, FALSE, value FROM m WHERE {axis} >= {size - 5}
  UNION ALL SELECT map, {other}, {axis}, {axis} + {size}, FALSE, value FROM m WHERE {axis} < 5),
{name} AS (SELECT map, {other}, {axis}, noise_floor FROM (SELECT *, (SUM(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) + SUM(value) OVER (w ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING)) / 8.0 AS noise_floor
  FROM {name}x WINDOW w AS (PARTITION BY map, {other} ORDER BY idx)) WHERE own)"""


_DUAL_SQL = f"""WITH m AS ({RD_MAP}), {_axis_pass("range_bin", "doppler_bin", 32, "az")}, {_axis_pass("doppler_bin", "range_bin", 64, "rg")}
SELECT m.map, m.range_bin, m.doppler_bin, m.value, round(rg.noise_floor, 4) + 0.0 AS noise_floor, round(m.value - rg.noise_floor, 4) + 0.0 AS snr
FROM m JOIN az ON m.map = az.map AND m.range_bin = az.range_bin AND m.doppler_bin = az.doppler_bin JOIN rg ON m.map = rg.map AND m.range_bin = rg.range_bin AND m.doppler_bin = rg.doppler_bin
WHERE m.value > az.noise_floor + 30 AND m.value > rg.noise_floor + 40"""


def _detections(spark, sf):
    """Detections on the range-Doppler maps: peak_val, snr, noise_floor."""
    hits = cf.dual_axis_peaks(ad.rd_map(spark, sf), ["map"], "doppler_bin", "range_bin", "value", 30, 40, 1, 4)
    return hits.select("map", "range_bin", "doppler_bin", F.col("value").alias("peak_val"), "noise_floor", "snr")


@query("dual_axis_hits", _DUAL_SQL)
def dual_axis_hits(spark, sf):
    return _detections(spark, sf).select(
        "map", "range_bin", "doppler_bin", F.col("peak_val").alias("value"), rnd("noise_floor").alias("noise_floor"), rnd("snr").alias("snr")
    )


@query("border_skipped_hits", f"SELECT * FROM ({_DUAL_SQL}) WHERE range_bin BETWEEN 4 AND 59 AND doppler_bin BETWEEN 4 AND 27")
def border_skipped_hits(spark, sf):
    return pk.skip_border(dual_axis_hits(spark, sf), {"range_bin": 64, "doppler_bin": 32}, 4)


# A weaker detection list: every cell above a fixed level.
_RAW_DET = f"SELECT map, range_bin, doppler_bin, value AS peak_val, CAST(value - 10 AS DOUBLE) AS snr FROM ({RD_MAP}) WHERE value > 20"


def _raw_det(spark, sf):
    return ad.rd_map(spark, sf).filter("value > 20").select(
        "map", "range_bin", "doppler_bin", F.col("value").alias("peak_val"), (F.col("value") - 10).cast("double").alias("snr")
    )


@query("range_pruned_hits", f"""SELECT * FROM ({_RAW_DET}) WHERE range_bin BETWEEN 2 AND 60 AND
 ((range_bin * 0.7 < 10 AND snr > 60) OR (range_bin * 0.7 >= 10 AND range_bin * 0.7 < 21 AND snr > 40) OR (range_bin * 0.7 > 21 AND snr > 25))
 AND NOT ((peak_val < 90 AND range_bin * 0.7 < 4) OR (peak_val < 60 AND range_bin * 0.7 < 15))""".replace("0.7", "0.7::DOUBLE"))
def range_pruned_hits(spark, sf):
    return pk.range_prune(_raw_det(spark, sf), [(10, 60), (21, 40), (35, 25)], [(4, 90), (15, 60)], 2, 60, 0.7)


_NEIGH = f"""WITH m AS ({RD_MAP}), c AS (SELECT map, range_bin, doppler_bin, value,
 lag(value, 1) OVER w AS p1, lag(value, 2) OVER w AS p2, lead(value, 1) OVER w AS n1, lead(value, 2) OVER w AS n2
 FROM (SELECT map, range_bin, doppler_bin, doppler_bin AS idx, value FROM m UNION ALL SELECT map, range_bin, doppler_bin, doppler_bin - 32, value FROM m WHERE doppler_bin >= 30
   UNION ALL SELECT map, range_bin, doppler_bin, doppler_bin + 32, value FROM m WHERE doppler_bin < 2)
 WINDOW w AS (PARTITION BY map, range_bin ORDER BY idx) QUALIFY idx BETWEEN 0 AND 31)
SELECT map, range_bin, doppler_bin, value AS peak_val, CAST(value - 10 AS DOUBLE) AS snr FROM c WHERE value > 20 AND """


@query("local_peaks", _NEIGH + "value > p1 AND value > n1")
def local_peaks(spark, sf):
    return pk.prune_to_peaks(_raw_det(spark, sf), ad.rd_map(spark, sf), ["map"], 32)


@query("local_peaks_with_neighbor", _NEIGH + "((value > p1 AND value > n1) OR (value > n2 AND value > p1) OR (value > p2 AND value > n1))")
def local_peaks_with_neighbor(spark, sf):
    return pk.prune_to_peaks(_raw_det(spark, sf), ad.rd_map(spark, sf), ["map"], 32, True)


@query("doppler_grouped_peaks", _NEIGH + "value > greatest(p1, n1)")
def doppler_grouped_peaks(spark, sf):
    return pk.group_doppler(_raw_det(spark, sf), ad.rd_map(spark, sf), ["map"], 32)


def _grouped_sql(source: str, lo: int, hi: int, signed: bool) -> str:
    extra = ", CASE WHEN doppler_bin < 16 THEN doppler_bin ELSE doppler_bin - 32 END AS doppler_signed" if signed else ""
    return f"""WITH m AS ({RD_MAP}), d AS ({_RAW_DET}), s AS ({source}),
o AS (SELECT unnest([-1, 0, 1]) AS dr), q AS (SELECT unnest([-1, 0, 1]) AS dd),
a AS (SELECT d.map, d.range_bin, d.doppler_bin, d.peak_val, d.snr, MAX(s.v) AS around FROM d JOIN o ON TRUE JOIN q ON NOT (dr = 0 AND dd = 0)
 LEFT JOIN s ON s.map = d.map AND s.range_bin = d.range_bin + dr AND s.doppler_bin = (d.doppler_bin + dd + 32) % 32
 WHERE d.range_bin BETWEEN {lo} AND {hi} GROUP BY 1, 2, 3, 4, 5)
SELECT map, range_bin, doppler_bin, peak_val, snr{extra} FROM a WHERE COALESCE(around, 0) <= peak_val"""


@query("grouped_peaks_map", _grouped_sql("SELECT map, range_bin, doppler_bin, value AS v FROM m WHERE range_bin BETWEEN 3 AND 60", 3, 60, True))
def grouped_peaks_map(spark, sf):
    return pk.group_peaks_map(_raw_det(spark, sf), ad.rd_map(spark, sf), ["map"], 32, 3, 60)


@query("grouped_peaks_list", _grouped_sql("SELECT map, range_bin, doppler_bin, peak_val AS v FROM d", 3, 60, False))
def grouped_peaks_list(spark, sf):
    return pk.group_peaks_list(_raw_det(spark, sf), ["map"], 32, 3, 60)


@query("filtered_boxes", f"""SELECT frame_no, class_id, confidence, CAST(trunc(x1) AS INTEGER) AS x, CAST(trunc(y1) AS INTEGER) AS y,
 CAST(trunc(x2) AS INTEGER) - CAST(trunc(x1) AS INTEGER) AS w, CAST(trunc(y2) AS INTEGER) - CAST(trunc(y1) AS INTEGER) AS h,
 CASE class_id WHEN 0 THEN 'person' WHEN 1 THEN 'bicycle' WHEN 2 THEN 'car' WHEN 3 THEN 'motorcycle' ELSE 'unknown' END AS object_type
 FROM ({BOXES}) WHERE class_id IN (0, 1, 2, 3) AND confidence > 0.5""")
def filtered_boxes(spark, sf):
    return pk.filter_boxes(ad.boxes_raw(spark, sf))


@query("boundary_gate", f"SELECT frame_no, x, y, vel FROM ({POINTS}) WHERE (x > -10 AND x < 10 AND y > 5 AND y < 40) OR (x > 12 AND x < 20 AND y > 30 AND y < 60)")
def boundary_gate(spark, sf):
    return pk.in_boundary(ad.points(spark, sf), [(-10, 10, 5, 40), (12, 20, 30, 60)]).select("frame_no", "x", "y", "vel")


# Boxes of 25 sensors from the nations; sensors 25 to 29 have none.
@query("boundary_labels", f"""WITH p AS (SELECT frame_no % 30 AS sensor, frame_no, x, y, vel FROM ({POINTS})),
b AS (SELECT CAST(n_nationkey AS BIGINT) AS sensor, -10.0 + n_regionkey AS l, 5.0 + n_nationkey AS r, 5.0 AS b, 30.0 + n_nationkey AS t FROM nation
  UNION ALL SELECT CAST(n_nationkey AS BIGINT), 0.5 * n_nationkey, 40.0, 20.0, 60.0 FROM nation WHERE n_nationkey % 2 = 0)
SELECT sensor, frame_no, x, y, vel, CASE WHEN sensor >= 25 THEN NULL WHEN EXISTS (SELECT 1 FROM b WHERE b.sensor = p.sensor AND x > l AND x < r AND y > b.b AND y < t) THEN 'inside' ELSE 'behind the wall' END AS boundary FROM p""")
def boundary_labels(spark, sf):
    nation = ad.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("sensor"), F.col("n_regionkey").cast("double").alias("r"))
    k = F.col("sensor").cast("double")
    one = nation.select("sensor", (F.col("r") - 10).alias("left"), (k + 5).alias("right"), F.lit(5.0).alias("bottom"), (k + 30).alias("top"))
    two = nation.filter("sensor % 2 = 0").select("sensor", (k * 0.5).alias("left"), F.lit(40.0).alias("right"), F.lit(20.0).alias("bottom"), F.lit(60.0).alias("top"))
    points = ad.points(spark, sf).withColumn("sensor", F.col("frame_no") % 30)
    return pk.boundary_labels(points, one.unionByName(two), ["sensor"], 4.0).select("sensor", "frame_no", "x", "y", "vel", "boundary")


@query("capped_objects", f"SELECT * FROM ({_RAW_DET}) QUALIFY row_number() OVER (PARTITION BY map ORDER BY range_bin, doppler_bin) <= 100")
def capped_objects(spark, sf):
    return pk.cap_objects(_raw_det(spark, sf), ["map"], ["range_bin", "doppler_bin"], 100)
