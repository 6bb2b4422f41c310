"""Kernels and recipes on synthetic scenes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangelake.functions.tapers import KINDS, weight
from rangelake.operators import angles as an
from rangelake.operators import layout as ly
from rangelake.operators import passive as pv
from rangelake.operators import spectra as sp
from rangelake.plans import recipes as rc

C, S, M = 32, 64, 8
CFG = rc.Sensor(C, 2, 4, S, 0.5, 0.2)


def scene(spark, targets, frames=1, noise=0.05, seed=3, antennas=M):
    """Rows per (chirp, antenna) of tones plus noise and one static reflector."""
    rng = np.random.default_rng(seed)
    rows = []
    n = np.arange(S)
    for f in range(frames):
        for c in range(C):
            for k in range(antennas):
                z = np.exp(2j * np.pi * 40 * n / S)
                for r0, d0, theta in targets:
                    z = z + np.exp(2j * np.pi * (r0 * n / S + d0 * c / C)) * np.exp(-1j * np.pi * k * np.sin(np.deg2rad(theta)))
                z = z + noise * (rng.standard_normal(S) + 1j * rng.standard_normal(S))
                rows.append((f, c, k, z.real.tolist(), z.imag.tolist()))
    return spark.createDataFrame(rows, "frame_no long, chirp long, vant long, re array<double>, im array<double>")


def test_transform_keeps_energy(spark):
    cube = scene(spark, [(10, 5, 20)])
    power = lambda df: sum(sum(a * a + b * b for a, b in zip(r.re, r.im)) for r in df.collect())
    assert power(sp.range_fft(cube)) == pytest.approx(power(cube) * S)


def test_tapers_match_numpy(spark):
    n = 33
    df = spark.range(n).select("id")
    for kind, ref in (("hanning", np.hanning(n)), ("hamming", np.hamming(n)), ("blackman", np.blackman(n)), ("bartlett", np.bartlett(n)), ("kaiser", np.kaiser(n, 4.0))):
        got = [r.w for r in df.select("id", weight(kind, F.col("id").cast("double"), F.lit(n)).alias("w")).orderBy("id").collect()]
        assert got == pytest.approx(ref.tolist(), abs=1e-9)
    assert len(KINDS) == 9


def test_payload_layout(spark):
    chirps, tx, rx, samples = 3, 2, 4, 5
    raw = np.arange(chirps * tx * samples * 2 * rx)
    want = raw.reshape(chirps, tx, samples, 2, rx).transpose(0, 1, 4, 2, 3)
    df = spark.createDataFrame([(0, raw.tolist())], "frame_no long, samples array<int>")
    for r in ly.to_cube(df, chirps, tx, rx, samples).collect():
        assert r.re == want[r.chirp, r.tx, r.rx, :, 0].tolist()
        assert r.im == want[r.chirp, r.tx, r.rx, :, 1].tolist()
    with pytest.raises(Exception):
        ly.to_cube(df, chirps, tx, rx, samples + 1).collect()


@pytest.fixture(scope="module")
def covariance(spark):
    cube = scene(spark, [(10, 5, 20)])
    rbins = ly.corner_turn(sp.range_fft(cube), ["frame_no"])
    return an.covariance(rbins, ["frame_no"], M).filter("range_bin = 10")


@pytest.mark.parametrize("method", ["capon", "music", "beam_power"])
def test_spectrum_peaks_at_the_angle(covariance, method):
    cov = an.fb_average(covariance)
    out = {"capon": lambda: an.capon(cov, M), "music": lambda: an.music(cov, M, 1), "beam_power": lambda: an.beam_power(cov, M)}[method]()
    spec = np.array(out.first().spectrum)
    assert abs(int(spec.argmax()) - 90 - 20) <= 1


def test_search_free_angles(covariance):
    assert an.root_music(covariance, M, 1).first().angles[0] == pytest.approx(20, abs=1)
    assert an.esprit(covariance, M, 1, 2).first().angles[0] == pytest.approx(20, abs=1)
    for call in (lambda: an.music(covariance, M, M), lambda: an.esprit(covariance, M, 1, 5)):
        with pytest.raises(ValueError):
            call()


def test_capon_weights_pass_the_angle(covariance):
    row = an.capon(an.fb_average(covariance), M, loading=1e-6).first()
    assert len(row.w_re) == M and len(row.spectrum) == 181


def test_smoothing_matches_numpy(covariance):
    r = covariance.first()
    m = (np.array(r.re) + 1j * np.array(r.im)).reshape(M, M)
    want = np.mean([m[i: i + 6, i: i + 6] for i in range(3)], axis=0)
    got = an.spatial_smooth(covariance, M, 3).first()
    assert np.allclose(np.array(got.re) + 1j * np.array(got.im), want.ravel())


def test_capon_recipe_finds_moving_target_only(spark):
    pts = rc.capon_points(scene(spark, [(12, 6, 20)]), ["frame_no"], CFG, bounds=(0.5, 1.0)).collect()
    best = max(pts, key=lambda p: p.snr)
    assert best.range_bin == 12 and abs(best.angle - 20) <= 2
    assert best.velocity == pytest.approx(6 * 0.2)
    assert all(abs(p.range_bin - 40) > 1 for p in pts)
    assert best.x == pytest.approx(-12 * 0.5 * np.sin(np.deg2rad(best.angle)))


def test_hit_recipe(spark):
    pts = rc.process(scene(spark, [(12, 6, 20)]), ["frame_no"], CFG, "hits", indoor=False).collect()
    best = [p for p in pts if p.range_bin == 12 and p.doppler_bin == 6 + C // 2]
    # phase -pi k sin(20) equals pi k cos(doa) at doa = 110
    assert best and abs(best[0].doa - 110) <= 1
    assert best[0].velocity == pytest.approx(6 * 0.2)


def test_doppler_recipe_needs_three_transmitters(spark):
    cube = scene(spark, [(12, 6, 20)])
    with pytest.raises(ValueError):
        rc.process(cube, ["frame_no"], CFG, "doppler")
    with pytest.raises(ValueError):
        rc.process(cube, ["frame_no"], CFG, "other")


def test_mixed_positions_bartlett(spark):
    # azimuth row 0..7, elevation row 8..11 above antennas 2..5
    theta, wz = np.deg2rad(15), 0.1
    a = np.exp(-1j * np.pi * np.arange(8) * np.sin(theta))
    z = np.concatenate([a, a[2:6] * np.exp(-1j * np.pi * wz)])
    df = spark.createDataFrame([(1, 20, z.real.tolist(), z.imag.tolist())], "det long, range_bin long, re array<double>, im array<double>")
    for method in ("Bartlett", "Capon"):
        p = an.mixed_xyz(df, 0.5, method).collect()
        assert len(p) == 1
        assert p[0].phi == pytest.approx(np.degrees(np.arcsin(wz)), abs=0.5)
        assert p[0].theta == pytest.approx(-15, abs=1)


def pair(spark, n=256, seed=5):
    rng = np.random.default_rng(seed)
    ref = rng.standard_normal(n) + 1j * rng.standard_normal(n)
    echo = np.zeros(n, complex)
    for k, w in ((0, 2.0), (1, 0.7j), (3, -0.4)):
        echo[k:] += w * ref[: n - k]
    target = np.concatenate([np.zeros(9), ref[: n - 9]]) * np.exp(2j * np.pi * 4 * np.arange(n) / (2 * n)) * 0.1
    surv = echo + target
    row = [x.tolist() for x in (ref.real, ref.imag, surv.real, surv.imag)]
    schema = "cpi long, ref_re array<double>, ref_im array<double>, surv_re array<double>, surv_im array<double>"
    return ref, surv, target, spark.createDataFrame([(0, *row)], schema)


def surveillance(df):
    r = df.first()
    return np.array(r.surv_re) + 1j * np.array(r.surv_im)


@pytest.mark.parametrize("make", [
    lambda p: pv.wiener_smi(p, 4), lambda p: pv.wiener_smi_mre(p, 4), lambda p: pv.eca(p, 4, 0), lambda p: pv.time_filter(p, "ECA", 4, 1),
    lambda p: pv.eca(p, 4, 0, batches=4, margin=16),
])
def test_filters_remove_clutter_and_keep_the_target(spark, make):
    ref, surv, target, pairs = pair(spark)
    left = surveillance(make(pairs))
    assert np.linalg.norm(left) < 0.2 * np.linalg.norm(surv)
    assert np.linalg.norm(left - target) < np.linalg.norm(target)


def test_filter_names(spark):
    pairs = pair(spark)[3]
    with pytest.raises(NotImplementedError):
        pv.time_filter(pairs, "NLMS", 4)
    with pytest.raises(ValueError):
        pv.time_filter(pairs, "other", 4)


def test_ambiguity_maps_agree_and_find_the_target(spark):
    ref, surv, target, pairs = pair(spark)
    clean = pv.eca(pairs, 4, 0)
    maps = [
        pv.caf_fd(clean, ["cpi"], 512.0, 8.0, 16), pv.caf_td(clean, ["cpi"], 512.0, 8.0, 1.0, 16), pv.caf_batched(clean, ["cpi"], 512.0, 8.0, 16),
    ]
    tables = []
    for m in maps:
        rows = m.withColumn("p", F.col("re") ** 2 + F.col("im") ** 2).collect()
        top = max(rows, key=lambda r: r.p)
        assert (top.doppler_bin - 8, top.range_bin) == (4, 9)
        tables.append({(r.doppler_bin, r.range_bin): complex(r.re, r.im) for r in rows})
    assert all(abs(tables[0][k] - tables[1][k]) < 1e-6 for k in tables[0])


def test_beams(spark):
    rng = np.random.default_rng(2)
    pos = [0, 0.5, 1.0, 1.5]
    want, other = pv.array_response(pos, 60), pv.array_response(pos, 110)
    s, j = (rng.standard_normal(400) + 1j * rng.standard_normal(400) for _ in range(2))
    x = np.outer(want, s) + 3 * np.outer(other, j) + 0.01 * rng.standard_normal((4, 400))
    df = spark.createDataFrame([(0, k, x[k].real.tolist(), x[k].imag.tolist()) for k in range(4)], "cpi long, channel long, re array<double>, im array<double>")
    w = lambda b: np.array(b.first().w_re) + 1j * np.array(b.first().w_im)
    null = w(pv.beamform(df, ["cpi"], pos, "Max SIR", constraints=([60, 110], [1, 0])))
    assert abs(null.conj() @ other) < 1e-3 * abs(null.conj() @ want)
    steer = w(pv.beamform(df, ["cpi"], pos, "Beam steering", 60.0))
    assert abs(steer.conj() @ want) == pytest.approx(2.0)
    with pytest.raises(ValueError):
        pv.beamform(df, ["cpi"], pos, "MVDR", None)
    with pytest.raises(NotImplementedError):
        pv.beamform(df, ["cpi"], pos, "DOA aided Max SIR")
