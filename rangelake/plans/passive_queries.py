"""Queries: passive radar and quality metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangelake.operators import metrics as mt
from rangelake.operators import passive as pv
from rangelake.plans.registry import CHANNELS, RD_MAP, SQL, query, rnd
from rangelake.sources import adapters as ad

PAIRS = f"""SELECT cpi, n, MAX(CASE WHEN channel = 0 THEN re END) AS rr, MAX(CASE WHEN channel = 0 THEN im END) AS ri,
 MAX(CASE WHEN channel = 1 THEN re END) AS sr, MAX(CASE WHEN channel = 1 THEN im END) AS si FROM ({CHANNELS}) GROUP BY 1, 2"""
_CH4 = """SELECT vec_id // 20 AS cpi, vec_id % 4 AS channel, ((vec_id % 20) // 4) * 32 + i AS n,
  CAST(embedding[2*i+1] AS DOUBLE) AS re, CAST(embedding[2*i+2] AS DOUBLE) AS im FROM embeddings, (SELECT unnest(range(0, 32)) AS i)"""


@query("isolated_channels", f"""SELECT 'reference' AS role, cpi, 0 AS channel, n, round(re, 6) AS re FROM ({_CH4}) WHERE channel = 2
UNION ALL SELECT 'surveillance', cpi, CASE WHEN channel > 2 THEN channel - 1 ELSE channel END, n, round(re, 6) FROM ({_CH4}) WHERE channel <> 2""")
def isolated_channels(spark, sf):
    from rangelake.operators.layout import long_form

    iq = long_form(ad.channel_rows(spark, sf, 4), "n")
    ref, surv = pv.isolate_channels(iq, 2)
    both = ref.withColumns({"channel": F.lit(0).cast("long"), "role": F.lit("reference")}).unionByName(surv.withColumn("role", F.lit("surveillance")))
    return both.select("role", "cpi", "channel", "n", rnd("re", 6).alias("re"))


@query("delayed_signal", f"""SELECT cpi, channel, n, round(COALESCE(lag(re, 5) OVER w, 0), 6) + 0.0 AS re, round(COALESCE(lag(im, 5) OVER w, 0), 6) + 0.0 AS im
FROM ({CHANNELS}) WINDOW w AS (PARTITION BY cpi, channel ORDER BY n)""")
def delayed_signal(spark, sf):
    out = pv.shift_signal(ad.iq_channels(spark, sf), ["cpi", "channel"], ["n"], 5, ["re", "im"])
    return out.select("cpi", "channel", "n", rnd("re", 6).alias("re"), rnd("im", 6).alias("im"))


@query("filter_subspace", """SELECT cpi, (d + 2) * k + j AS index, d AS doppler, j AS delay FROM (SELECT DISTINCT vec_id // 20 AS cpi, vec_id // 20 % 3 + 2 AS k FROM embeddings),
 (SELECT unnest(range(-2, 3)) AS d), (SELECT unnest(range(0, 5)) AS j) WHERE j < k""")
def filter_subspace(spark, sf):
    dims = ad.table(spark, sf, "embeddings").select(F.expr("vec_id div 20").alias("cpi")).distinct()
    out = pv.subspace(dims.withColumn("k", F.col("cpi") % 3 + 2), F.col("k"), 2)
    return out.select("cpi", "index", "doppler", "delay")


@query("correlation_matrix", f"""WITH p AS ({PAIRS}) SELECT a.cpi, i.v AS row, j.v AS col, round(SUM(a.rr * b.rr + a.ri * b.ri) / 320, 6) + 0.0 AS re, round(SUM(a.rr * b.ri - a.ri * b.rr) / 320, 6) + 0.0 AS im
FROM p a JOIN (SELECT unnest(range(0, 4)) AS v) i ON a.n + i.v <= 319 JOIN (SELECT unnest(range(0, 4)) AS v) j ON TRUE
JOIN p b ON b.cpi = a.cpi AND b.n = a.n + i.v - j.v GROUP BY 1, 2, 3""")
def correlation_matrix(spark, sf):
    out = pv.corr_matrix(ad.iq_pairs(spark, sf), ["cpi"], 4)
    return out.select("cpi", "row", "col", rnd("re", 6).alias("re"), rnd("im", 6).alias("im"))


_TOEP = f"""SELECT a.cpi, l.v AS lag, SUM(a.rr * b.rr + a.ri * b.ri) / 320 AS re, SUM(a.ri * b.rr - a.rr * b.ri) / 320 AS im FROM p a JOIN (SELECT unnest(range(0, 4)) AS v) l ON TRUE JOIN p b ON a.cpi = b.cpi AND a.n = b.n + l.v GROUP BY 1, 2"""


@query("correlation_matrix_completed", f"""WITH p AS ({PAIRS}), c AS ({_TOEP})
SELECT c.cpi, i.v AS row, j.v AS col, round(re, 6) + 0.0 AS re, round(CASE WHEN i.v >= j.v THEN im ELSE -im END, 6) + 0.0 AS im
FROM c, (SELECT unnest(range(0, 4)) AS v) i, (SELECT unnest(range(0, 4)) AS v) j WHERE c.lag = abs(i.v - j.v)""")
def correlation_matrix_completed(spark, sf):
    out = pv.corr_matrix(ad.iq_pairs(spark, sf), ["cpi"], 4, toeplitz=True)
    return out.select("cpi", "row", "col", rnd("re", 6).alias("re"), rnd("im", 6).alias("im"))


_X = f"""SELECT a.cpi, l.v AS lag, SUM(a.sr * b.rr + a.si * b.ri) AS re, SUM(a.si * b.rr - a.sr * b.ri) AS im
FROM p a JOIN (SELECT unnest(range(0, 8)) AS v) l ON TRUE JOIN p b ON a.cpi = b.cpi AND a.n = b.n + l.v GROUP BY 1, 2"""


@query("cross_correlation", f"WITH p AS ({PAIRS}), x AS ({_X}) SELECT cpi, lag, round(re / 320, 6) + 0.0 AS re, round(-im / 320, 6) + 0.0 AS im FROM x")
def cross_correlation(spark, sf):
    out = pv.xcorr(ad.iq_pairs(spark, sf), ["cpi"], 8)
    return out.select("cpi", "lag", rnd("re", 6).alias("re"), rnd("im", 6).alias("im"))


@query("pruned_correlation", f"WITH p AS ({PAIRS}), x AS ({_X}) SELECT cpi, lag, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM x")
def pruned_correlation(spark, sf):
    out = pv.pruned_correlation(ad.iq_pairs(spark, sf), ["cpi"], 8)
    return out.select("cpi", "lag", rnd("re").alias("re"), rnd("im").alias("im"))


def _surv_long(pairs):
    from rangelake.operators.layout import long_form

    out = long_form(pairs.select("cpi", F.col("surv_re").alias("re"), F.col("surv_im").alias("im")), "n")
    return out.select("cpi", "n", rnd("re").alias("re"), rnd("im").alias("im"))


# With one tap the filters reduce to one complex weight, which SQL can state.
def _one_tap(conj: bool) -> str:
    del conj
    return f"""WITH p AS ({PAIRS}), w AS (SELECT cpi, SUM(sr * rr + si * ri) / SUM(rr * rr + ri * ri) AS wr, SUM(si * rr - sr * ri) / SUM(rr * rr + ri * ri) AS wi FROM p GROUP BY 1)
SELECT p.cpi, n, round(sr - (rr * wr - ri * wi), 4) + 0.0 AS re, round(si - (rr * wi + ri * wr), 4) + 0.0 AS im FROM p JOIN w ON p.cpi = w.cpi"""


@query("wiener_one_tap", _one_tap(True))
def wiener_one_tap(spark, sf):
    return _surv_long(pv.wiener_smi(ad.iq_pairs(spark, sf), 1))


def _projected(taps: int, dopplers: int) -> str:
    """The copies are taken out one after another (Gram-Schmidt): of the channel and of the copies that are left."""
    minus = lambda x, q, dot: f"""struct_pack(
      re := list_transform({x}.re, lambda v, i: v - ({dot}.a * {q}.re[i] - {dot}.b * {q}.im[i])), im := list_transform({x}.im, lambda v, i: v - ({dot}.a * {q}.im[i] + {dot}.b * {q}.re[i])))"""
    dot = lambda q, x: f"""struct_pack(
      a := (list_inner_product({q}.re, {x}.re) + list_inner_product({q}.im, {x}.im)) / (list_inner_product({q}.re, {q}.re) + list_inner_product({q}.im, {q}.im)),
      b := (list_inner_product({q}.re, {x}.im) - list_inner_product({q}.im, {x}.re)) / (list_inner_product({q}.re, {q}.re) + list_inner_product({q}.im, {q}.im)))"""
    return f"""WITH RECURSIVE p AS ({PAIRS}),
c AS (SELECT p.cpi, t.v AS n, d.v AS d, j.v AS j, COALESCE(q.rr, 0) AS r, COALESCE(q.ri, 0) AS i, pi() * d.v * t.v / 320 AS a FROM (SELECT DISTINCT cpi FROM p) p, (SELECT unnest(range(0, 320)) AS v) t,
  (SELECT unnest(range({-dopplers}, {dopplers + 1})) AS v) d, (SELECT unnest(range(0, {taps})) AS v) j LEFT JOIN p q ON q.cpi = p.cpi AND q.n = t.v - j.v),
l AS (SELECT cpi, d, j, struct_pack(re := list(r * cos(a) - i * sin(a) ORDER BY n), im := list(r * sin(a) + i * cos(a) ORDER BY n)) AS q FROM c GROUP BY 1, 2, 3),
w AS (
  SELECT l.cpi, list(q ORDER BY d, j) AS qs, any_value(s.s) AS s FROM l JOIN (SELECT cpi, struct_pack(re := list(sr ORDER BY n), im := list(si ORDER BY n)) AS s FROM p GROUP BY 1) s ON s.cpi = l.cpi GROUP BY 1
  UNION ALL
  SELECT cpi, list_transform(qs[2:], lambda q: {minus("q", "h", dot("h", "q"))}), {minus("s", "h", "ds")} FROM (SELECT *, {dot("h", "s")} AS ds FROM (SELECT *, qs[1] AS h FROM w WHERE len(qs) > 0)))
SELECT cpi, n, round(s.re[n + 1], 4) + 0.0 AS re, round(s.im[n + 1], 4) + 0.0 AS im FROM w, (SELECT unnest(range(0, 320)) AS n) WHERE len(qs) = 0"""


@query("wiener_smi", _projected(8, 0))
def wiener_smi(spark, sf):
    return _surv_long(pv.wiener_smi(ad.iq_pairs(spark, sf), 8))


# Two taps: the 2x2 Hermitian-Toeplitz system has a closed solution.
@query("wiener_mre_two_taps", f"""WITH p AS ({PAIRS}), c AS (SELECT a.cpi, SUM(CASE WHEN l = 0 THEN a.rr * b.rr + a.ri * b.ri END) AS c0,
 SUM(CASE WHEN l = 1 THEN a.rr * b.rr + a.ri * b.ri END) AS c1r, SUM(CASE WHEN l = 1 THEN a.ri * b.rr - a.rr * b.ri END) AS c1i,
 SUM(CASE WHEN l = 0 THEN a.sr * b.rr + a.si * b.ri END) AS r0r, SUM(CASE WHEN l = 0 THEN a.si * b.rr - a.sr * b.ri END) AS r0i,
 SUM(CASE WHEN l = 1 THEN a.sr * b.rr + a.si * b.ri END) AS r1r, SUM(CASE WHEN l = 1 THEN a.si * b.rr - a.sr * b.ri END) AS r1i
 FROM p a JOIN (SELECT unnest([0, 1]) AS l) ON TRUE JOIN p b ON a.cpi = b.cpi AND a.n = b.n + l GROUP BY 1),
w AS (SELECT cpi, (c0 * r0r - (c1r * r1r + c1i * r1i)) / d AS w0r, (c0 * r0i - (c1r * r1i - c1i * r1r)) / d AS w0i,
 (c0 * r1r - (c1r * r0r - c1i * r0i)) / d AS w1r, (c0 * r1i - (c1r * r0i + c1i * r0r)) / d AS w1i FROM (SELECT *, c0 * c0 - c1r * c1r - c1i * c1i AS d FROM c))
SELECT p.cpi, p.n, round(p.sr - (p.rr * w0r - p.ri * w0i) - COALESCE(q.rr * w1r - q.ri * w1i, 0), 4) + 0.0 AS re,
 round(p.si - (p.rr * w0i + p.ri * w0r) - COALESCE(q.rr * w1i + q.ri * w1r, 0), 4) + 0.0 AS im
FROM p JOIN w ON p.cpi = w.cpi LEFT JOIN p q ON q.cpi = p.cpi AND q.n = p.n - 1""")
def wiener_mre_two_taps(spark, sf):
    return _surv_long(pv.wiener_smi_mre(ad.iq_pairs(spark, sf), 2))


@query("eca_batches_one_tap", f"""WITH p AS (SELECT *, n // 80 AS b FROM ({PAIRS})), w AS (SELECT p.cpi, k.b, SUM(sr * rr + si * ri) / SUM(rr * rr + ri * ri) AS wr, SUM(si * rr - sr * ri) / SUM(rr * rr + ri * ri) AS wi
 FROM p JOIN (SELECT unnest(range(0, 4)) AS b) k ON p.n >= k.b * 80 - 10 AND p.n < k.b * 80 + 90 GROUP BY 1, 2)
SELECT p.cpi, n, round(sr - (rr * wr - ri * wi), 4) + 0.0 AS re, round(si - (rr * wi + ri * wr), 4) + 0.0 AS im FROM p JOIN w ON p.cpi = w.cpi AND p.b = w.b""")
def eca_batches_one_tap(spark, sf):
    return _surv_long(pv.eca(ad.iq_pairs(spark, sf), 1, 0, batches=4, margin=10))


@query("eca_subspace", _projected(4, 1))
def eca_subspace(spark, sf):
    return _surv_long(pv.time_filter(ad.iq_pairs(spark, sf), "ECA", 4, 1))


def _beam_long(beams):
    from rangelake.operators.layout import long_form

    out = long_form(beams.select("cpi", "re", "im"), "n")
    return out.select("cpi", "n", rnd("re").alias("re"), rnd("im").alias("im"))


_STEER = "2 * pi() * 0.5 * channel * cos(radians(60.0))"


@query("steered_beam", f"""SELECT cpi, n, round(SUM(re * cos(a) + im * sin(a)) / 2, 4) + 0.0 AS re, round(SUM(im * cos(a) - re * sin(a)) / 2, 4) + 0.0 AS im
FROM (SELECT *, {_STEER} AS a FROM ({_CH4})) GROUP BY 1, 2""")
def steered_beam(spark, sf):
    return _beam_long(pv.beamform(ad.channel_rows(spark, sf, 4), ["cpi"], [0, 0.5, 1.0, 1.5], "Beam steering", 60.0))


@query("adaptive_beams")
def adaptive_beams(spark, sf):
    rows, pos = ad.channel_rows(spark, sf, 4), [0, 0.5, 1.0, 1.5]
    parts = [
        pv.beamform(rows, ["cpi"], pos, "MVDR", 60.0), pv.beamform(rows, ["cpi"], pos, "Principal eigenvalue", 60.0, peigs=2),
        pv.beamform(rows, ["cpi"], pos, "Max SIR", constraints=([60.0, 100.0], [1.0, 0.0])),
    ]
    out = parts[0].withColumn("method", F.lit("MVDR"))
    for p, name in zip(parts[1:], ("Principal eigenvalue", "Max SIR")):
        out = out.unionByName(p.withColumn("method", F.lit(name)))
    mean = lambda c: F.aggregate(F.zip_with("re", "im", lambda x, y: x * x + y * y), F.lit(0.0), lambda acc, x: acc + x) / F.size(c)
    return out.select("method", "cpi", rnd(mean("re")).alias("beam_power"))


def _caf(turn: str, doppler: str, where: str) -> str:
    """Long cross-ambiguity: sum over m of surv[m + tau] * conj(ref[m]) * exp(-j turn m)."""
    return f"""WITH p AS ({PAIRS}), g AS ({doppler}), c AS (SELECT g.doppler_bin, a.cpi, a.n - b.n AS range_bin, g.f, b.n AS m,
 a.sr * b.rr + a.si * b.ri AS cr, a.si * b.rr - a.sr * b.ri AS ci FROM p a JOIN p b ON a.cpi = b.cpi AND a.n - b.n BETWEEN 0 AND 7, g)
SELECT cpi, doppler_bin, range_bin, round(SUM(cr * cos({turn}) + ci * sin({turn})), 4) + 0.0 AS re, round(SUM(ci * cos({turn}) - cr * sin({turn})), 4) + 0.0 AS im FROM c {where} GROUP BY 1, 2, 3"""


_GRID = "SELECT doppler_bin, CAST(doppler_bin - 4 AS DOUBLE) AS f FROM (SELECT unnest(range(0, 9)) AS doppler_bin)"


def _rounded(cells):
    return cells.select("cpi", "doppler_bin", "range_bin", rnd("re").alias("re"), rnd("im").alias("im"))


@query("ambiguity_time_domain", _caf("2 * pi() * f * 0.25 * m / 100", _GRID, ""))
def ambiguity_time_domain(spark, sf):
    return _rounded(pv.caf_td(ad.iq_pairs(spark, sf), ["cpi"], 100.0, 1.0, 0.25, 8))


@query("ambiguity_frequency_domain", _caf("2 * pi() * f * m / 640", _GRID, ""))
def ambiguity_frequency_domain(spark, sf):
    return _rounded(pv.caf_fd(ad.iq_pairs(spark, sf), ["cpi"], 640.0, 4.0, 8))


@query("ambiguity_batched", _caf("2 * pi() * f * (m // 8) / 80", _GRID, ""))
def ambiguity_batched(spark, sf):
    return _rounded(pv.caf_batched(ad.iq_pairs(spark, sf), ["cpi"], 640.0, 4.0, 8))


# --- metrics on maps --------------------------------------------------------------------

_BEFORE = f"SELECT map, range_bin, doppler_bin, CAST(value AS DOUBLE) * value AS power FROM ({RD_MAP})"
_AFTER = f"SELECT map, range_bin, doppler_bin, pow(value * (0.4 + (range_bin + 2 * doppler_bin) % 5 * 0.1), 2) AS power FROM ({RD_MAP})".replace("0.4", "0.4::DOUBLE").replace("0.1)", "0.1::DOUBLE)")
_TARGETS = "SELECT DISTINCT l_orderkey // 500 AS map, CASE WHEN (l_orderkey // 500) % 7 = 3 THEN -1 ELSE (l_orderkey // 500) % 40 + 12 END AS tr, (l_orderkey // 500) % 9 - 4 AS td FROM lineitem"
_ENERGY = """SELECT l_orderkey // 500 AS map, SUM(pow(CAST(l_extendedprice AS DOUBLE) / 1000, 2)) AS eb, SUM(pow(CAST(l_extendedprice AS DOUBLE) / 1000 * (1 - CAST(l_discount AS DOUBLE)), 2)) AS ea FROM lineitem GROUP BY 1"""
_BOX = lambda r, d, hr, hd: f"(range_bin BETWEEN {r} - {hr} AND {r} + {hr} AND doppler_bin BETWEEN {d} - {hd} AND {d} + {hd})"
_RING = f"({_BOX('tr', 'td + 15', 6, 4)} AND NOT {_BOX('tr', 'td + 15', 1, 1)})"
_NOISE = _BOX("30", "12", 6, 4)
_SUMS = f"""SELECT {{keys}}, SUM(CASE WHEN range_bin = tr AND doppler_bin = td + 15 THEN power END) AS target, MAX(power) AS peak,
 SUM(CASE WHEN doppler_bin = 16 AND range_bin = 0 THEN power END) AS direct, SUM(CASE WHEN doppler_bin = 16 AND range_bin < 10 THEN power END) AS clutter,
 CASE WHEN SUM(CASE WHEN {_RING} THEN 1 ELSE 0 END) = 108 THEN SUM(CASE WHEN {_RING} THEN power END) / 108 END AS ring, SUM(CASE WHEN {_NOISE} THEN power END) / 117 AS noise"""
_DB = lambda x: f"round(10 * log10(NULLIF({x}, 0)), 3) + 0.0"
WIN, WIN_POS = [6, 4, 1, 1], [30, -3]


def _maps(spark, sf):
    v = F.col("value").cast("double")
    grid = ad.rd_map(spark, sf)
    factor = F.lit(0.4) + (F.col("range_bin") + 2 * F.col("doppler_bin")) % 5 * 0.1
    return grid.withColumn("power", v * v), grid.withColumn("power", v * factor * v * factor)


def _map_targets(spark, sf):
    m = ad.table(spark, sf, "lineitem").select(F.expr("l_orderkey div 500").alias("map")).distinct()
    return m.select(
        "map", F.when(F.col("map") % 7 == 3, -1).otherwise(F.col("map") % 40 + 12).alias("target_range"), (F.col("map") % 9 - 4).alias("target_doppler")
    )


def _energy(spark, sf, after: bool):
    x = F.col("l_extendedprice").cast("double") / 1000
    if after:
        x = x * (1 - F.col("l_discount").cast("double"))
    return ad.table(spark, sf, "lineitem").groupBy(F.expr("l_orderkey div 500").alias("map")).agg(F.sum(x * x).alias("channel_power"))


_VALID = f"SELECT map, CASE WHEN tr >= 0 THEN tr END AS tr, CASE WHEN tr >= 0 THEN td END AS td FROM ({_TARGETS})"
_METRICS = f"""WITH t AS ({_VALID}), m AS ({_BEFORE}), e AS ({_ENERGY}), s AS ({_SUMS.format(keys='m.map')} FROM m JOIN t ON m.map = t.map GROUP BY 1)
SELECT s.map, {_DB('target / ring')} AS delta, {_DB('target / eb')} AS mu, {_DB('noise')} AS noise_floor, peak, round(peak / noise, 3) + 0.0 AS dynamic_range, {_DB('target / noise')} AS alpha FROM s JOIN e ON s.map = e.map"""


@query("map_metrics", _METRICS)
def map_metrics(spark, sf):
    out = mt.map_metrics(_maps(spark, sf)[0], _map_targets(spark, sf), ["map"], 32, WIN, WIN_POS, _energy(spark, sf, False))
    return out.select("map", "peak", *[rnd(c, 3).alias(c) for c in ("delta", "mu", "noise_floor", "dynamic_range", "alpha")])


def _single(name: str, cols: str):
    return f"SELECT map, {cols} FROM ({_METRICS})"


@query("metric_delta", _single("delta", "delta"))
def metric_delta(spark, sf):
    return mt.metric_delta(_maps(spark, sf)[0], _map_targets(spark, sf), ["map"], 32, WIN).withColumn("delta", rnd("delta", 3))


@query("metric_mu", _single("mu", "mu"))
def metric_mu(spark, sf):
    return mt.metric_mu(_maps(spark, sf)[0], _map_targets(spark, sf), ["map"], 32, _energy(spark, sf, False)).withColumn("mu", rnd("mu", 3))


@query("metric_noise_floor", f"SELECT map, {_DB(f'SUM(CASE WHEN {_NOISE} THEN power END) / 117')} AS noise_floor FROM ({_BEFORE}) GROUP BY 1")
def metric_noise_floor(spark, sf):
    return mt.metric_noise_floor(_maps(spark, sf)[0], ["map"], 32, WIN, WIN_POS).withColumn("noise_floor", rnd("noise_floor", 3))


@query("metric_peak", f"SELECT map, MAX(power) AS peak FROM ({_BEFORE}) GROUP BY 1")
def metric_peak(spark, sf):
    return mt.metric_peak(_maps(spark, sf)[0], ["map"])


@query("metric_dynamic_range", f"SELECT map, round(MAX(power) / (SUM(CASE WHEN {_NOISE} THEN power END) / 117), 3) + 0.0 AS dynamic_range FROM ({_BEFORE}) GROUP BY 1")
def metric_dynamic_range(spark, sf):
    return mt.metric_dynamic_range(_maps(spark, sf)[0], ["map"], 32, WIN, WIN_POS).withColumn("dynamic_range", rnd("dynamic_range", 3))


@query("metric_alpha", _single("alpha", "alpha"))
def metric_alpha(spark, sf):
    return mt.metric_alpha(_maps(spark, sf)[0], _map_targets(spark, sf), ["map"], 32, WIN, WIN_POS).withColumn("alpha", rnd("alpha", 3))


@query("metrics_on_track", _single("track", "delta, alpha, mu"))
def metrics_on_track(spark, sf):
    out = mt.metrics_on_track(_maps(spark, sf)[0], _map_targets(spark, sf), ["map"], 32, WIN, WIN_POS, _energy(spark, sf, False))
    return out.select("map", *[rnd(c, 3).alias(c) for c in ("delta", "alpha", "mu")])


@query("filter_scorecard", f"""WITH t AS ({_VALID}), b0 AS ({_BEFORE}), a0 AS ({_AFTER}), e AS ({_ENERGY}),
b AS ({_SUMS.format(keys='b0.map')} FROM b0 JOIN t ON b0.map = t.map GROUP BY 1), a AS ({_SUMS.format(keys='a0.map')} FROM a0 JOIN t ON a0.map = t.map GROUP BY 1)
SELECT b.map, {_DB('eb / ea')} AS ca, {_DB('b.noise / a.noise')} AS r_nf, {_DB('a.target / NULLIF(b.target, 0) * eb / ea')} AS mu_imp, {_DB('a.target / NULLIF(b.target, 0) * b.ring / a.ring')} AS delta_imp,
 {_DB('a.target / NULLIF(b.target, 0) * b.noise / a.noise')} AS alpha_imp, {_DB('a.target / NULLIF(b.target, 0)')} AS l, {_DB('b.direct / NULLIF(a.direct, 0)')} AS r_dpi, {_DB('b.clutter / NULLIF(a.clutter, 0)')} AS r_zdc, {_DB('b.peak / a.peak')} AS p,
 CASE WHEN b.peak / b.noise - a.peak / a.noise > 0 THEN {_DB('greatest(b.peak / b.noise - a.peak / a.noise, 0)')} END AS d FROM b JOIN a ON a.map = b.map JOIN e ON e.map = b.map""")
def filter_scorecard(spark, sf):
    before, after = _maps(spark, sf)
    out = mt.filter_scorecard(
        before, after, ["map"], 32, _map_targets(spark, sf), WIN, WIN_POS, 10, _energy(spark, sf, False), _energy(spark, sf, True)
    )
    return out.select("map", *[rnd(c, 3).alias(c) for c in mt.SCORES])


_SCORE_NAMES = ["ca", "r_nf", "mu_imp", "delta_imp", "alpha_imp", "l", "r_dpi", "r_zdc", "p", "d"]


@query("scorecard_entries", f"WITH cards AS ({SQL['filter_scorecard']}) " + "SELECT map, name, value FROM (" + " UNION ALL ".join(f"SELECT map, '{n}' AS name, {n} AS value FROM cards" for n in _SCORE_NAMES) + ") WHERE value IS NOT NULL")
def scorecard_entries(spark, sf):
    cards = mt.scores_as_map(filter_scorecard(spark, sf), ["map"])
    return cards.select("map", F.explode("metrics").alias("name", "value"))


def _cpi_targets(pairs):
    return pairs.select("cpi", (F.col("cpi") % 5 + 8).alias("target_range"), (F.col("cpi") % 3 - 1).alias("target_doppler"))


@query("raw_scorecard")
def raw_scorecard(spark, sf):
    pairs = ad.iq_pairs(spark, sf)
    out = mt.scorecard_by_cpi(
        pairs, "ECA", 4, (32, 8), dopplers=1, targets=_cpi_targets(pairs), win=[4, 4, 1, 1], win_pos=[20, 2], max_clutter_delay=4, window="Hamming"
    )
    return out.select("cpi", *[rnd(c, 3).alias(c) for c in mt.SCORES])


@query("filter_size_sweep")
def filter_size_sweep(spark, sf):
    pairs = ad.iq_pairs(spark, sf)
    out = mt.sweep_filter_dim(pairs, "SMI-MRE", [1, 2, 4, 8], (32, 8), "avg", targets=_cpi_targets(pairs), win=[4, 4, 1, 1], win_pos=[20, 2], max_clutter_delay=4)
    return out.select("k", *[rnd(c, 3).alias(c) for c in mt.SCORES])
