"""Intervals in blocks against whole-interval numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangelake.operators import intervals as iv

SCHEMA = "cpi long, ref_re array<double>, ref_im array<double>, surv_re array<double>, surv_im array<double>"


def signals(seed: int, n: int, k: int = 5):
    rng = np.random.default_rng(seed)
    ref = np.convolve(rng.standard_normal(n) + 1j * rng.standard_normal(n), [1, 0.4j, 0.2])[:n]
    taps = rng.standard_normal(k) + 1j * rng.standard_normal(k)
    noise = 0.1 * (rng.standard_normal(n) + 1j * rng.standard_normal(n))
    return ref, np.convolve(ref, taps)[:n] + noise


def table(spark, pairs):
    return spark.createDataFrame([(c, *(x.tolist() for x in (r.real, r.imag, s.real, s.imag))) for c, (r, s) in pairs.items()], SCHEMA)


def copies(r, k, dopplers, t):
    out = []
    for d in range(-dopplers, dopplers + 1):
        for i in range(k):
            at = t - i
            out.append(np.where((at >= 0) & (at < len(r)), r[np.clip(at, 0, len(r) - 1)], 0) * np.exp(1j * np.pi * d * t / len(r)))
    return np.array(out)


def dense(r, s, k, dopplers=0, batches=1, margin=0):
    size, out = len(r) // batches, s.astype(complex)
    for low in range(0, len(r), size):
        t = np.arange(low - margin, low + size + margin)
        lines = copies(r, k, dopplers, t)
        seen = np.where((t >= 0) & (t < len(s)), s[np.clip(t, 0, len(s) - 1)], 0)
        w = np.linalg.solve(lines.conj() @ lines.T, lines.conj() @ seen)
        own = np.arange(low, low + size)
        out[own] -= w @ copies(r, k, dopplers, own)
    return out


def back(df, a="surv"):
    return {r["cpi"]: np.array(r[f"{a}_re"]) + 1j * np.array(r[f"{a}_im"]) for r in iv.gathered(df, ["cpi"]).collect()}


CASES = [
    {"k": 6}, {"k": 1}, {"k": 4, "dopplers": 2}, {"k": 5, "batches": 4, "margin": 9}, {"k": 3, "dopplers": 1, "batches": 6, "margin": 20}, {"k": 30, "margin": 30},
]


@pytest.mark.parametrize("size", [1 << 15, 100, 64])
@pytest.mark.parametrize("case", CASES, ids=str)
def test_projection(spark, case, size):
    """Blocks shorter than, equal to and longer than batches; intervals that end at and inside a block."""
    pairs = {1: signals(1, 960), 2: signals(2, 600), None: signals(3, 300)}
    got = back(iv.project_out(iv.blocks_of(table(spark, pairs), size), ["cpi"], size=size, **case))
    for c, (r, s) in pairs.items():
        assert np.allclose(got[c], dense(r, s, **case), atol=1e-7)


@pytest.mark.parametrize("size", [1 << 15, 70])
def test_completed_matrix_and_recursion(spark, size):
    r, s = signals(4, 500, 9)
    k = 40
    got = back(iv.project_out(iv.blocks_of(table(spark, {1: (r, s)}), size), ["cpi"], k, toeplitz=True, size=size))[1]
    lags = np.array([np.vdot(r[: len(r) - m], r[m:]) for m in range(k)])
    cross = np.array([np.vdot(r[: len(r) - m], s[m:]) for m in range(k)])
    w = np.linalg.solve(iv._hermitian(lags), cross)
    assert np.allclose(iv.levinson(lags, cross), w)
    assert np.allclose(got, s - np.convolve(r, w)[: len(r)])


def test_recursion_on_many_taps():
    rng = np.random.default_rng(5)
    x = rng.standard_normal(40_000) + 1j * rng.standard_normal(40_000)
    spectrum = np.fft.fft(x, 1 << 17)
    lags = np.fft.ifft(spectrum * spectrum.conj())[:2048] + 1
    right = rng.standard_normal(2048) + 1j * rng.standard_normal(2048)
    assert np.allclose(iv._hermitian(lags) @ iv.levinson(lags, right), right)


@pytest.mark.parametrize("size", [1 << 15, 90])
def test_matrix_lags_and_map(spark, size):
    pairs = {1: signals(6, 450), 2: signals(7, 200)}
    blocks = iv.blocks_of(table(spark, pairs), size)
    gram = {(x.cpi, x.row, x.col): complex(x.re, x.im) for x in iv.correlation_matrix(blocks, ["cpi"], 7, size=size).collect()}
    lags = {(x.cpi, x.lag): complex(x.re, x.im) for x in iv.cross_correlation(blocks, ["cpi"], 7, size).collect()}
    turns = np.array([-0.3, 0.0, 0.02, 0.5])
    cells = {(x.cpi, x.doppler_bin, x.range_bin): complex(x.re, x.im) for x in iv.ambiguity(blocks, ["cpi"], lambda n: turns, 6, size).collect()}
    for c, (r, s) in pairs.items():
        lines = copies(r, 7, 0, np.arange(len(r)))
        assert np.allclose([[gram[c, i, j] for j in range(7)] for i in range(7)], lines.conj() @ lines.T / len(r))
        assert np.allclose([lags[c, m] for m in range(7)], lines.conj() @ s)
        turned = [r * np.exp(1j * x * np.arange(len(r))) for x in turns]
        assert np.allclose([[cells[c, d, m] for m in range(6)] for d in range(4)], [[np.vdot(x[: len(r) - m], s[m:]) for m in range(6)] for x in turned])


def test_a_long_interval_is_never_one_row(spark):
    """A million samples from rows of one sample: no row holds more than a block, and the clutter goes."""
    n, size = 1_000_000, 1 << 14
    samples = spark.range(n).select(F.lit(1).alias("cpi"), F.col("id").alias("n"), F.randn(1).alias("ref_re"), F.randn(2).alias("ref_im"), F.randn(3).alias("x"), F.randn(4).alias("y"))
    samples = samples.select("cpi", "n", "ref_re", "ref_im", (F.col("ref_re") * 3 + F.col("x") * 0.1).alias("surv_re"), (F.col("ref_im") * 3 + F.col("y") * 0.1).alias("surv_im"))
    done = iv.project_out(iv.blocks_of_samples(samples, ["cpi"], size=size), ["cpi"], 64, size=size)
    power = F.aggregate(F.zip_with("surv_re", "surv_im", lambda a, b: a * a + b * b), F.lit(0.0), lambda a, x: a + x)
    got = done.agg(F.count(F.lit(1)).alias("blocks"), F.max(F.size("surv_re")).alias("longest"), F.sum(F.size("surv_re")).alias("n"), F.sum(power).alias("power")).first()
    assert (got.blocks, got.longest, got.n) == (-(-n // size), size, n)
    assert got.power / n == pytest.approx(0.02, rel=0.02)


def test_what_does_not_fit(spark):
    blocks = iv.blocks_of(table(spark, {1: signals(8, 300)}), 50)
    for case in ({"k": 60}, {"k": 3, "batches": 7}, {"k": 40, "batches": 10}):
        with pytest.raises(Exception, match="larger size|multiple of the batch|exceeds the batch"):
            iv.project_out(blocks, ["cpi"], size=50, **case).collect()
    with pytest.raises(ValueError):
        iv.project_out(blocks, ["cpi"], 3, dopplers=1, toeplitz=True)
