"""Queries: steering, covariance, spectra, peaks, positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangelake.operators import angles as an
from rangelake.operators import clutter as cl
from rangelake.operators import layout as ly
from rangelake.operators import spectra as sp
from rangelake.plans.registry import CONFIG, IQ, query, rnd
from rangelake.sources import adapters as ad


@query("steering_table", f"""SELECT config, angle_idx, antenna, round(cos(-pi() * antenna * sin(radians(angle_idx * 10.0 - 90))), 4) + 0.0 AS s_re,
 round(sin(-pi() * antenna * sin(radians(angle_idx * 10.0 - 90))), 4) + 0.0 AS s_im
FROM ({CONFIG}), (SELECT unnest(range(0, 19)) AS angle_idx), (SELECT unnest(range(0, 12)) AS antenna) WHERE antenna < tx * rx""")
def steering_table(spark, sf):
    cfg = ad.sensor_config(spark, sf).select("config", "tx", "rx")
    return an.steering(cfg, 90, 10, F.col("tx") * F.col("rx"), digits=4).select("config", "angle_idx", "antenna", "s_re", "s_im")


_COV = f"""SELECT a.frame_no, a.sample AS range_bin, a.vant AS i, b.vant AS j, SUM(a.re * b.re + a.im * b.im) / 25 AS re, SUM(a.im * b.re - a.re * b.im) / 25 AS im
FROM ({IQ}) a JOIN ({IQ}) b ON a.frame_no = b.frame_no AND a.chirp = b.chirp AND a.sample = b.sample GROUP BY 1, 2, 3, 4"""
_FB = f"SELECT c.frame_no, c.range_bin, c.i, c.j, (c.re + d.re) / 2 AS re, (c.im - d.im) / 2 AS im FROM cov c JOIN cov d ON c.frame_no = d.frame_no AND c.range_bin = d.range_bin AND d.i = 3 - c.i AND d.j = 3 - c.j"


def _matrix(df, side):
    cells = ly.long_form(df.select("frame_no", "range_bin", "re", "im"), "cell").filter("re IS NOT NULL")
    return cells.select(
        "frame_no", "range_bin", F.expr(f"cell div {side}").alias("i"), (F.col("cell") % side).alias("j"), rnd("re").alias("re"), rnd("im").alias("im")
    )


def _cov(spark, sf, blank=False):
    return an.covariance(ad.rcube(spark, sf, numbered=True), ["frame_no"], 4, ad.CHIRPS, blank)


@query("spatial_covariance", f"SELECT frame_no, range_bin, i, j, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM ({_COV})")
def spatial_covariance(spark, sf):
    return _matrix(_cov(spark, sf, blank=True), 4)


@query("forward_backward_covariance", f"WITH cov AS ({_COV}) SELECT frame_no, range_bin, i, j, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM ({_FB})")
def forward_backward_covariance(spark, sf):
    return _matrix(an.fb_average(_cov(spark, sf, blank=True)), 4)


@query("smoothed_covariance", f"""WITH cov AS ({_COV}), s AS (SELECT frame_no, range_bin, i - p AS i, j - p AS j, AVG(re) AS re, AVG(im) AS im FROM cov, (SELECT unnest([0, 1]) AS p)
 WHERE i - p BETWEEN 0 AND 2 AND j - p BETWEEN 0 AND 2 GROUP BY 1, 2, 3, 4)
SELECT s.frame_no, s.range_bin, s.i, s.j, round((s.re + t.re) / 2, 4) + 0.0 AS re, round((s.im - t.im) / 2, 4) + 0.0 AS im
FROM s JOIN s t ON s.frame_no = t.frame_no AND s.range_bin = t.range_bin AND t.i = 2 - s.i AND t.j = 2 - s.j""")
def smoothed_covariance(spark, sf):
    return _matrix(an.spatial_smooth(_cov(spark, sf, blank=True), 4, 2, backward=True), 3)


# Antenna vectors: one per (frame, chirp, sample).
def _vectors(spark, sf):
    cells = ad.iq_cube(spark, sf)
    return an.antenna_vectors(cells, ["frame_no", "chirp", "sample"], ad.VANTS)


_VEC = "frame_no, chirp, sample"
_BART = f"""SELECT {_VEC}, k, re * re + im * im AS p FROM (SELECT {_VEC}, k, SUM(re * cos(pi() * vant * s) - im * sin(pi() * vant * s)) AS re,
 SUM(re * sin(pi() * vant * s) + im * cos(pi() * vant * s)) AS im FROM ({IQ}), (SELECT k, sin(radians(k * 5.0 - 85)) AS s FROM (SELECT unnest(range(0, 35)) AS k)) GROUP BY {_VEC}, k)"""


@query("bartlett_spectrum", f"SELECT {_VEC}, k AS angle_idx, round(p, 4) + 0.0 AS power FROM ({_BART})")
def bartlett_spectrum(spark, sf):
    s = an.bartlett(_vectors(spark, sf), 85, 5, 4)
    return s.select("frame_no", "chirp", "sample", F.posexplode("spectrum").alias("angle_idx", "p")).select(
        "frame_no", "chirp", "sample", F.col("angle_idx").cast("long").alias("angle_idx"), rnd("p").alias("power")
    )


_PK = f"SELECT *, lag(p) OVER w AS a, lead(p) OVER w AS b, MAX(p) OVER (PARTITION BY {_VEC}) AS top FROM ({_BART}) WINDOW w AS (PARTITION BY {_VEC} ORDER BY k)"


@query("spectrum_peaks", f"""SELECT v.frame_no, v.chirp, v.sample, COALESCE(num_peaks, 0) AS num_peaks, COALESCE(first_peak, -1) AS first_peak, round(COALESCE(total_power, 0), 4) + 0.0 AS total_power
FROM (SELECT DISTINCT {_VEC} FROM ({IQ})) v LEFT JOIN (SELECT {_VEC}, COUNT(*) AS num_peaks, MIN(k) AS first_peak, SUM(p) AS total_power FROM ({_PK})
 WHERE a IS NOT NULL AND b IS NOT NULL AND p > a AND p > b AND p >= 0.251188643150958 * top GROUP BY {_VEC}) q ON v.frame_no = q.frame_no AND v.chirp = q.chirp AND v.sample = q.sample""")
def spectrum_peaks(spark, sf):
    out = an.peak_search(an.bartlett(_vectors(spark, sf), 85, 5, 4))
    first = F.when(F.col("num_peaks") > 0, F.col("peaks")[0]["loc"]).otherwise(F.lit(-1))
    return out.select("frame_no", "chirp", "sample", "num_peaks", first.alias("first_peak"), rnd("total_power").alias("total_power"))


def _fold_sql(compare: str) -> str:
    """Hysteresis peak search as one recursive walk over all spectra at once."""
    return f"""WITH RECURSIVE sp AS MATERIALIZED (SELECT {_VEC}, list(p ORDER BY k) AS s, MAX(p) * 0.251188643150958 AS lim FROM ({_BART}) GROUP BY {_VEC}),
w AS (SELECT {_VEC}, 0 AS i, 0.0::DOUBLE AS top, 0 AS loc, 0 AS run, 'inf'::DOUBLE AS low, FALSE AS up, -1 AS ext, CAST([] AS STRUCT(loc BIGINT, value DOUBLE, width BIGINT)[]) AS peaks FROM sp
 UNION ALL SELECT frame_no, chirp, sample, i + 1, CASE WHEN rises THEN v ELSE t END, l, r, CASE WHEN falls THEN v ELSE m END, CASE WHEN falls THEN FALSE WHEN rises THEN TRUE ELSE up END,
  CASE WHEN rises AND ext < 0 THEN i ELSE ext END, CASE WHEN falls AND t {compare} lim THEN list_append(peaks, struct_pack(loc := CAST(l AS BIGINT), value := t, width := CAST(i - r AS BIGINT))) ELSE peaks END
 FROM (SELECT *, up AND v < t / 1.2::DOUBLE AS falls, NOT up AND v > m * 1.2::DOUBLE AS rises FROM
  (SELECT *, CASE WHEN v > top THEN v ELSE top END AS t, CASE WHEN v > top THEN i % 35 ELSE loc END AS l, CASE WHEN v > top THEN i ELSE run END AS r, least(low, v) AS m FROM
   (SELECT w.*, sp.lim, sp.s[i % 35 + 1] AS v FROM w JOIN sp ON w.frame_no = sp.frame_no AND w.chirp = sp.chirp AND w.sample = sp.sample WHERE i < 35 + greatest(ext, 0))))),
f AS (SELECT {_VEC}, arg_max(peaks, i) AS peaks FROM w GROUP BY {_VEC})"""


@query("hysteresis_peaks", _fold_sql(">=") + f""" SELECT {_VEC}, CAST(len(peaks) AS BIGINT) AS num_peaks, COALESCE(peaks[1].loc, -1) AS first_peak, COALESCE(peaks[2].loc, -1) AS second_peak FROM f""")
def hysteresis_peaks(spark, sf):
    out = an.bf_multi_det(_vectors(spark, sf), 85, 5, 4)
    pick = lambda i: F.coalesce(F.get("peaks", F.lit(i))["loc"], F.lit(-1).cast("long"))
    return out.select("frame_no", "chirp", "sample", "num_peaks", pick(0).alias("first_peak"), pick(1).alias("second_peak"))


@query("peaks_with_variance", _fold_sql(">") + f""", u AS (SELECT {_VEC}, unnest(peaks) AS p, list_sum(list_transform(peaks, lambda x: x.value)) AS total_power FROM f)
SELECT {_VEC}, p.loc AS loc, round(p.value, 4) + 0.0 AS value, p.width AS width, round(2 * 5 * p.width * 2.5 * sqrt(1 / (20000 * p.value / total_power)), 4) + 0.0 AS variance, CAST(p.loc * 5 - 85 AS DOUBLE) AS angle FROM u""")
def peaks_with_variance(spark, sf):
    out = an.bf_multi(_vectors(spark, sf), 85, 5, 4)
    return out.select("frame_no", "chirp", "sample", "loc", rnd("value").alias("value"), "width", rnd("variance").alias("variance"), F.col("angle").cast("double"))


@query("one_point_beam", f"""SELECT {_VEC}, round(SUM(re * cos(a) - im * sin(a)), 4) + 0.0 AS b_re, round(SUM(re * sin(a) + im * cos(a)), 4) + 0.0 AS b_im
FROM (SELECT *, -pi() * vant * sin(radians(CAST((chirp % 13) * 15 - 90 AS DOUBLE))) AS a FROM ({IQ})) GROUP BY {_VEC}""")
def one_point_beam(spark, sf):
    out = an.bf_one_point(_vectors(spark, sf), F.col("chirp") % 13, 90, 15, 4)
    return out.select("frame_no", "chirp", "sample", rnd("b_re").alias("b_re"), rnd("b_im").alias("b_im"))


@query("single_peak_index", f"SELECT {_VEC}, k AS max_index FROM ({_BART}) QUALIFY row_number() OVER (PARTITION BY {_VEC} ORDER BY p DESC, k) = 1")
def single_peak_index(spark, sf):
    return an.bf_single_det(_vectors(spark, sf), 85, 5, 4).select("frame_no", "chirp", "sample", "max_index")


@query("single_peak_variance", f"""WITH b AS ({_BART}), t AS (SELECT {_VEC}, list(p ORDER BY k) AS s, MAX(p) / 2 AS half, SUM(p) AS total FROM b GROUP BY {_VEC}),
i AS (SELECT {_VEC}, SUM(re * re + im * im) AS input FROM ({IQ}) GROUP BY {_VEC}), m AS (SELECT *, list_position(s, list_max(s)) - 1 AS mx FROM t),
r AS (SELECT *, COALESCE(list_min(list_filter(range(0, 35), lambda d: s[(mx + d) % 35 + 1] < half)), 35) AS rt, COALESCE(list_min(list_filter(range(0, 35), lambda d: s[(mx - d + 35) % 35 + 1] < half)), 35) AS lf FROM m),
q AS (SELECT *, list_sum(list_transform(range(0, rt), lambda d: s[(mx + d) % 35 + 1])) + COALESCE(list_sum(list_transform(range(1, lf), lambda d: s[(mx - d + 35) % 35 + 1])), 0) AS sig FROM r)
SELECT q.frame_no, q.chirp, q.sample, rt + lf - 1 AS span, round(5 * (rt + lf - 1) * sqrt(1 / (2 * input * 4 * sig / (0.1::DOUBLE * total))), 4) + 0.0 AS variance
FROM q JOIN i ON q.frame_no = i.frame_no AND q.chirp = i.chirp AND q.sample = i.sample""")
def single_peak_variance(spark, sf):
    out = an.bf_single(_vectors(spark, sf), 0.1, 5, 85, 4)
    return out.select("frame_no", "chirp", "sample", "span", rnd("variance").alias("variance"))


# Two antennas are enough for a closed-form inverse in SQL: each frame as two arrays of two.
_C2 = f"""SELECT frame_no, i // 2 AS pair, range_bin, SUM(CASE WHEN i = j THEN re END) / 2 AS d, SUM(CASE WHEN i < j THEN re END) AS ore, SUM(CASE WHEN i < j THEN im END) AS oim
FROM ({_COV.replace("a.sample = b.sample", "a.sample = b.sample AND a.vant // 2 = b.vant // 2")}) GROUP BY 1, 2, 3"""


@query("capon_two_antennas", f"""SELECT frame_no, pair, range_bin, k AS angle_idx, round((d * d - ore * ore - oim * oim) / (2 * d - 2 * (ore * cos(p) - oim * sin(p))), 4) + 0.0 AS power
FROM ({_C2}), (SELECT k, -pi() * sin(radians(k * 10.0 - 90)) AS p FROM (SELECT unnest(range(0, 19)) AS k))""")
def capon_two_antennas(spark, sf):
    pairs = ad.rcube(spark, sf, numbered=True).withColumn("pair", F.expr("vant div 2")).withColumn("vant", F.col("vant") % 2)
    cov = an.fb_average(an.covariance(pairs, ["frame_no", "pair"], 2, ad.CHIRPS))
    out = an.capon(cov, 2, 90, 10)
    return out.select("frame_no", "pair", "range_bin", F.posexplode("spectrum").alias("angle_idx", "p")).select(
        "frame_no", "pair", "range_bin", F.col("angle_idx").cast("long").alias("angle_idx"), rnd("p").alias("power")
    )


def _cov4(spark, sf):
    return an.fb_average(_cov(spark, sf))


@query("capon_peaks")
def capon_peaks(spark, sf):
    out = an.capon(_cov4(spark, sf), 4)
    return out.select("frame_no", "range_bin", rnd(F.array_max("spectrum")).alias("peak"), (F.array_position("spectrum", F.array_max("spectrum")) - 91).cast("long").alias("angle"))


@query("music_peaks")
def music_peaks(spark, sf):
    out = an.music(_cov4(spark, sf), 4, 1)
    top = F.array_max("spectrum")  # a frame with a missing sample has no spectrum
    return out.select("frame_no", "range_bin", F.when(~F.isnan(top), F.array_position("spectrum", top) - 91).cast("long").alias("angle"))


@query("root_music_angles")
def root_music_angles(spark, sf):
    return an.root_music(_cov4(spark, sf), 4, 1).select("frame_no", "range_bin", rnd(F.col("angles")[0], 3).alias("angle"))


@query("esprit_angles")
def esprit_angles(spark, sf):
    return an.esprit(_cov4(spark, sf), 4, 1).select("frame_no", "range_bin", rnd(F.col("angles")[0], 3).alias("angle"))


# Twelve virtual antennas: three chirps of four antennas side by side.
def _vectors12(spark, sf):
    rows = ad.interleaved_rows(spark, sf, 3, 8, ["frame_no", "chirp"])
    cells = rows.select("frame_no", "chirp", "vant", F.posexplode(F.arrays_zip("re", "im")).alias("sample", "z")).select(
        "frame_no", "chirp", "vant", F.col("sample").cast("long").alias("sample"), "z.re", "z.im"
    )
    return an.antenna_vectors(cells, ["frame_no", "chirp", "sample"]).withColumnRenamed("sample", "range_bin")


_V12 = f"SELECT g // 24 AS frame_no, g % 24 // 3 AS chirp, sample AS range_bin, g % 3 * 4 + vant AS vant, re, im FROM (SELECT *, frame_no * 25 + chirp AS g FROM ({IQ})) QUALIFY COUNT(*) OVER (PARTITION BY g // 3, sample) = 12"
_K3 = "frame_no, chirp, range_bin"


@query("naive_positions", f"""WITH v AS ({_V12}), a AS (SELECT {_K3}, k, SUM(re * cos(2 * pi() * k * vant / 64) + im * sin(2 * pi() * k * vant / 64)) AS ar, SUM(im * cos(2 * pi() * k * vant / 64) - re * sin(2 * pi() * k * vant / 64)) AS ai
 FROM v, (SELECT unnest(range(0, 64)) AS k) WHERE vant < 8 GROUP BY {_K3}, k QUALIFY row_number() OVER (PARTITION BY {_K3} ORDER BY ar * ar + ai * ai DESC, k) = 1),
e AS (SELECT {_K3}, k, SUM(re * cos(pi() * k * (vant - 8) / 2) + im * sin(pi() * k * (vant - 8) / 2)) AS er, SUM(im * cos(pi() * k * (vant - 8) / 2) - re * sin(pi() * k * (vant - 8) / 2)) AS ei
 FROM v, (SELECT unnest(range(0, 4)) AS k) WHERE vant >= 8 GROUP BY {_K3}, k QUALIFY row_number() OVER (PARTITION BY {_K3} ORDER BY er * er + ei * ei DESC, k) = 1),
p AS (SELECT a.frame_no, a.chirp, a.range_bin, CASE WHEN a.k > 31 THEN a.k - 64 ELSE a.k END / 32.0::DOUBLE AS wx, ar * er + ai * ei AS cr, ai * er - ar * ei AS ci FROM a JOIN e ON a.frame_no = e.frame_no AND a.chirp = e.chirp AND a.range_bin = e.range_bin),
q AS (SELECT *, atan2(cr * sin(2 * pi() * wx) + ci * cos(2 * pi() * wx), cr * cos(2 * pi() * wx) - ci * sin(2 * pi() * wx)) / pi() AS wz FROM p), z AS (SELECT *, 1 - wx * wx - wz * wz AS g FROM q)
SELECT {_K3}, round(CASE WHEN g > 0 THEN wx ELSE wx / sqrt(wx * wx + wz * wz) END, 4) + 0.0 AS x, round(CASE WHEN g > 0 THEN sqrt(g) ELSE 0 END, 4) + 0.0 AS y, round(CASE WHEN g > 0 THEN wz ELSE wz / sqrt(wx * wx + wz * wz) END, 4) + 0.0 AS z FROM z""")
def naive_positions(spark, sf):
    out = an.naive_xyz(_vectors12(spark, sf))
    return out.select("frame_no", "chirp", "range_bin", rnd("x").alias("x"), rnd("y").alias("y"), rnd("z").alias("z"))


def _mixed(spark, sf, method):
    out = an.mixed_xyz(_vectors12(spark, sf), 0.7, method)
    return out.select("frame_no", "chirp", "range_bin", "peak_idx", *[rnd(c).alias(c) for c in ("theta", "phi", "x", "y", "z")])


# Steps of five degrees over +-85; antennas 0..7 give the azimuth spectrum.
_V8 = f"""SELECT {_K3}, k, re * re + im * im AS p FROM (SELECT {_K3}, k, SUM(re * cos(pi() * vant * s) - im * sin(pi() * vant * s)) AS re, SUM(re * sin(pi() * vant * s) + im * cos(pi() * vant * s)) AS im
FROM ({_V12}), (SELECT k, sin(radians(k * 5.0 - 85)) AS s FROM (SELECT unnest(range(0, 35)) AS k)) WHERE vant < 8 GROUP BY {_K3}, k)"""
_MIXED = _fold_sql(">").replace(_BART, _V8).replace("sample", "range_bin").replace("0.251188643150958", "0.9::DOUBLE")


@query("mixed_positions_steps", _MIXED + f""", u AS (SELECT {_K3}, unnest(peaks) AS p, unnest(range(0, len(peaks))) AS peak_idx, list_sum(list_transform(peaks, lambda x: x.value)) AS total FROM f),
g AS (SELECT {_K3}, peak_idx, p.loc AS loc, radians(p.loc * 5.0 - 85) AS th FROM u WHERE 2 * 5 * p.width * 2.5 * sqrt(1 / (20000 * p.value / total)) < 10),
e AS (SELECT v.frame_no, v.chirp, v.range_bin, peak_idx, th, SUM(CASE WHEN v.vant >= 8 THEN re * cos(a) - im * sin(a) END) AS er, SUM(CASE WHEN v.vant >= 8 THEN re * sin(a) + im * cos(a) END) AS ei,
 SUM(CASE WHEN v.vant BETWEEN 2 AND 5 THEN re * cos(a) - im * sin(a) END) AS ar, SUM(CASE WHEN v.vant BETWEEN 2 AND 5 THEN re * sin(a) + im * cos(a) END) AS ai
 FROM (SELECT g.*, v.vant, v.re, v.im, -pi() * CASE WHEN v.vant >= 8 THEN v.vant - 8 ELSE v.vant - 2 END * sin(th) AS a FROM g JOIN ({_V12}) v ON v.frame_no = g.frame_no AND v.chirp = g.chirp AND v.range_bin = g.range_bin) v GROUP BY 1, 2, 3, 4, 5),
el AS (SELECT *, asin(atan2(ai * er - ar * ei, ar * er + ai * ei) / pi()) AS el FROM e), q AS (SELECT *, degrees(asin(sin(-th) * cos(el))) AS theta FROM el)
SELECT {_K3}, peak_idx, round(theta, 4) + 0.0 AS theta, round(degrees(el), 4) + 0.0 AS phi, round(sin(radians(theta)) * range_bin * 0.7::DOUBLE, 4) + 0.0 AS x, round(cos(radians(theta)) * range_bin * 0.7::DOUBLE, 4) + 0.0 AS y, round(tan(el) * range_bin * 0.7::DOUBLE, 4) + 0.0 AS z FROM q""")
def mixed_positions_steps(spark, sf):
    out = an.mixed_xyz(_vectors12(spark, sf), 0.7, "Bartlett", 85, 5)
    return out.select("frame_no", "chirp", "range_bin", "peak_idx", *[rnd(c).alias(c) for c in ("theta", "phi", "x", "y", "z")])


@query("mixed_positions_bartlett")
def mixed_positions_bartlett(spark, sf):
    return _mixed(spark, sf, "Bartlett")


@query("mixed_positions_capon")
def mixed_positions_capon(spark, sf):
    return _mixed(spark, sf, "Capon")


_AOA = f"""SELECT frame_no, vant, sample AS range_bin, d AS doppler_bin, SUM(re * cos(2 * pi() * d * chirp / 25) + im * sin(2 * pi() * d * chirp / 25)) AS re, SUM(im * cos(2 * pi() * d * chirp / 25) - re * sin(2 * pi() * d * chirp / 25)) AS im
FROM ({IQ}), (SELECT unnest(range(0, 25)) AS d) GROUP BY 1, 2, 3, 4"""


@query("azimuth_positions", f"""WITH c AS (SELECT frame_no, range_bin, doppler_bin, vant, re * cos(a) - im * sin(a) AS re, re * sin(a) + im * cos(a) AS im FROM
 (SELECT *, -2 * pi() / 25 * (CASE WHEN doppler_bin < 12.5 THEN doppler_bin ELSE doppler_bin - 25 END) * (vant // 2) / 2.0 AS a FROM ({_AOA}))),
f AS (SELECT frame_no, range_bin, doppler_bin, k, pow(SUM(re * cos(2 * pi() * k * vant / 16) + im * sin(2 * pi() * k * vant / 16)), 2) + pow(SUM(im * cos(2 * pi() * k * vant / 16) - re * sin(2 * pi() * k * vant / 16)), 2) AS p
 FROM c, (SELECT unnest(range(0, 16)) AS k) GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY frame_no, range_bin, doppler_bin ORDER BY p DESC, k) = 1),
g AS (SELECT *, CASE WHEN k > 7 THEN k - 16 ELSE k END AS s FROM f)
SELECT frame_no, range_bin, doppler_bin, s AS angle_idx, round(sqrt(p / (32 * 16 * 25)), 4) AS peak_val, round(range_bin * 0.7::DOUBLE * s / 8.0, 4) + 0.0 AS x,
 round(sqrt(greatest(pow(range_bin * 0.7::DOUBLE, 2) - pow(range_bin * 0.7::DOUBLE * s / 8.0, 2), 0)), 4) + 0.0 AS y FROM g""")
def azimuth_positions(spark, sf):
    aoa = ly.long_form(sp.doppler_fft(ad.rcube(spark, sf), shift=False), "doppler_bin")
    vectors = an.antenna_vectors(cl.compensate_doppler(aoa, 2, 2, 25), ["frame_no", "range_bin", "doppler_bin"])
    out = an.azimuth_xy(vectors, 16, 32, 25, 0.7)
    return out.select("frame_no", "range_bin", "doppler_bin", "angle_idx", rnd("peak_val").alias("peak_val"), rnd("x").alias("x"), rnd("y").alias("y"))


_Y = f"""SELECT {_VEC}, t, SUM(re * cos(f) + im * sin(f)) AS yr, SUM(im * cos(f) - re * sin(f)) AS yi, SUM(re * re + im * im) AS nn, SUM(CASE WHEN vant = 0 THEN re END) AS a0r, SUM(CASE WHEN vant = 0 THEN im END) AS a0i
FROM (SELECT *, pi() * vant * cos(radians(t)) AS f FROM ({IQ}), (SELECT unnest(range(0, 180)) AS t)) GROUP BY {_VEC}, t"""
_ARG = "QUALIFY row_number() OVER (PARTITION BY frame_no, chirp, sample ORDER BY {} DESC, t) = 1"


@query("doa_bartlett", f"SELECT {_VEC}, t AS doa FROM ({_Y}) {_ARG.format('yr * yr + yi * yi')}")
def doa_bartlett(spark, sf):
    return an.doa(_vectors(spark, sf), [0, 0.5, 1.0, 1.5], "Bartlett").select("frame_no", "chirp", "sample", "doa")


@query("doa_capon", f"SELECT {_VEC}, t AS doa FROM ({_Y}) {_ARG.format('1 / (4 - (yr * yr + yi * yi) / (1.001 * nn))')}")
def doa_capon(spark, sf):
    return an.doa(_vectors(spark, sf), [0, 0.5, 1.0, 1.5], "Capon").select("frame_no", "chirp", "sample", "doa")


@query("doa_music", f"SELECT {_VEC}, t AS doa FROM ({_Y}) {_ARG.format('1 / greatest(4 - (yr * yr + yi * yi) / nn, 1e-12)')}")
def doa_music(spark, sf):
    return an.doa(_vectors(spark, sf), [0, 0.5, 1.0, 1.5], "MUSIC").select("frame_no", "chirp", "sample", "doa")


_MEM = "1 / (pow(1 - (yr * a0r + yi * a0i) / (1.001 * nn), 2) + pow((yi * a0r - yr * a0i) / (1.001 * nn), 2))"


@query("doa_mem", f"SELECT {_VEC}, t AS doa FROM ({_Y}) {_ARG.format(_MEM)}")
def doa_mem(spark, sf):
    return an.doa(_vectors(spark, sf), [0, 0.5, 1.0, 1.5], "MEM").select("frame_no", "chirp", "sample", "doa")


@query("doa_lpm", f"SELECT {_VEC}, t AS doa FROM ({_Y}) {_ARG.format(_MEM)}")
def doa_lpm(spark, sf):
    return an.doa(_vectors(spark, sf), [0, 0.5, 1.0, 1.5], "LPM").select("frame_no", "chirp", "sample", "doa")
