"""Queries without SQL against plain numpy on the raw vectors."""

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

Q = entry.queries()


@pytest.fixture(scope="module")
def vectors(sf):
    t = pq.read_table(f"{sf}/embeddings.parquet").sort_by("vec_id")
    return dict(zip(t["vec_id"].to_pylist(), np.array(t["embedding"].to_pylist(), float)))


@pytest.fixture(scope="module")
def pairs(vectors):
    """cpi -> (reference, surveillance)."""
    out = {}
    for cpi in sorted({v // 20 for v in vectors}):
        ids = [v for v in range(cpi * 20, cpi * 20 + 20) if v in vectors]
        flat = [np.concatenate([vectors[v] for v in ids if v % 2 == c]) for c in (0, 1)]
        out[cpi] = tuple(x[0::2] + 1j * x[1::2] for x in flat)
    return out


@pytest.fixture(scope="module")
def covariances(vectors):
    """(frame, range) -> forward-backward covariance of four antennas."""
    cube = {}
    for v, x in vectors.items():
        cube.setdefault(v // 100, {})[(v % 4, v % 100 // 4)] = x[0::2] + 1j * x[1::2]
    out = {}
    flip = np.eye(4)[::-1]
    for frame, cells in cube.items():
        chirps = sorted({c for _, c in cells})
        block = np.array([[cells[a, c] for c in chirps] for a in range(4)])  # antenna, chirp, range
        for r in range(block.shape[2]):
            z = block[:, :, r]
            m = z @ z.conj().T / z.shape[1]
            out[frame, r] = (m + flip @ m.conj() @ flip) / 2
    return out


def filtered(pairs, copies):
    """What least squares leaves of the surveillance channel."""
    out = {}
    for cpi, (r, s) in pairs.items():
        a = np.array(copies(r)).T
        left = s - a @ np.linalg.lstsq(a, s, rcond=None)[0]
        out |= {(cpi, n): z for n, z in enumerate(left)}
    return out


def delayed(r, k):
    return np.concatenate([np.zeros(k), r[: len(r) - k]])


@pytest.mark.parametrize(("name", "copies"), [
    ("wiener_smi", lambda r: [delayed(r, k) for k in range(8)]),
    ("eca_subspace", lambda r: [delayed(r, k) * np.exp(1j * np.pi * d * np.arange(len(r)) / len(r)) for d in (-1, 0, 1) for k in range(4)]),
])
def test_clutter_filters(spark, sf, pairs, name, copies):
    want = filtered(pairs, copies)
    got = {(r.cpi, r.n): r.re + 1j * r.im for r in Q[name](spark, sf).collect()}
    assert set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 2e-4


def grid():
    return np.exp(-1j * np.pi * np.outer(np.sin(np.deg2rad(np.arange(-90, 91))), np.arange(4)))


def near(got, spectrum, angle):
    """The reported angle has the largest value, up to rounding and ties."""
    assert spectrum[angle + 90] >= spectrum.max() * (1 - 1e-6)
    del got


def test_capon_peaks(spark, sf, covariances):
    rows = Q["capon_peaks"](spark, sf).collect()
    assert len(rows) == len(covariances)
    for r in rows:
        inverse = np.linalg.inv(covariances[r.frame_no, r.range_bin])
        spectrum = 1 / np.abs(np.einsum("ki,ij,kj->k", grid().conj(), inverse, grid()))
        assert r.peak == pytest.approx(spectrum.max(), rel=1e-3, abs=2e-4)
        near(r, spectrum, r.angle)


def test_music_peaks(spark, sf, covariances):
    for r in Q["music_peaks"](spark, sf).collect():
        noise = np.linalg.eigh(covariances[r.frame_no, r.range_bin])[1][:, :3]
        near(r, 1 / (np.abs(grid().conj() @ noise) ** 2).sum(1), r.angle)


def test_root_music_and_esprit_angles(spark, sf, covariances):
    """The angle is that of a root of the noise polynomial, and of the turn between two sub-arrays."""
    for r in Q["root_music_angles"](spark, sf).collect():
        noise = np.linalg.eigh(covariances[r.frame_no, r.range_bin])[1][:, :3]
        c = noise @ noise.conj().T
        roots = np.roots([np.trace(c, k) for k in range(3, -4, -1)])
        angles = np.rad2deg(np.arcsin(np.clip(-np.angle(roots) / np.pi, -1, 1)))
        assert np.abs(np.abs(angles) - abs(r.angle)).min() < 0.01
    for r in Q["esprit_angles"](spark, sf).collect():
        signal = np.linalg.eigh(covariances[r.frame_no, r.range_bin])[1][:, 3]
        turn = np.vdot(signal[:3], signal[1:]) / np.vdot(signal[:3], signal[:3])
        assert abs(abs(np.rad2deg(np.arcsin(np.angle(turn) / np.pi))) - abs(r.angle)) < 0.01


def test_adaptive_beams(spark, sf, vectors):
    got = {(r.method, r.cpi): r.beam_power for r in Q["adaptive_beams"](spark, sf).collect()}
    response = lambda deg: np.exp(2j * np.pi * np.array([0, 0.5, 1.0, 1.5]) * np.cos(np.deg2rad(deg)))
    for cpi in {c for _, c in got}:
        ids = [v for v in range(cpi * 20, cpi * 20 + 20) if v in vectors]
        flat = [np.concatenate([vectors[v] for v in ids if v % 4 == c]) for c in range(4)]
        x = np.array([f[0::2] + 1j * f[1::2] for f in flat])
        cov = x @ x.conj().T / x.shape[1]
        main = np.linalg.eigh(cov)[1][:, -2:]
        a = np.array([response(60.0), response(100.0)]).T
        weights = {
            "MVDR": np.linalg.inv(cov) @ response(60.0), "Principal eigenvalue": main @ main.conj().T @ response(60.0),
            "Max SIR": np.linalg.inv(a @ a.conj().T + 1e-6 * np.eye(4)) @ a[:, 0],
        }
        for method, w in weights.items():
            w = w * 2 / np.abs(w).sum()
            assert got[method, cpi] == pytest.approx((np.abs(w.conj() @ x) ** 2).mean(), rel=1e-3, abs=6e-5)


def test_filter_sweep_energy(spark, sf, pairs):
    """The clutter attenuation of the sweep: energy ratios of the filtered channel, averaged as amplitudes, best at 0 dB."""
    got = {r.k: r.ca for r in Q["filter_size_sweep"](spark, sf).collect()}
    want = {}
    for k in (1, 2, 4, 8):
        ratios = []
        for r, s in pairs.values():
            lag = lambda y, x: np.array([np.vdot(x[: len(x) - i], y[i:]) for i in range(k)])
            first, cross = lag(r, r), lag(s, r)
            matrix = np.array([[first[i - j] if i >= j else first[j - i].conj() for j in range(k)] for i in range(k)])
            w = np.linalg.solve(matrix, cross)
            left = s - sum(w[i] * delayed(r, i) for i in range(k))
            ratios.append(10 * np.log10((np.abs(s) ** 2).sum() / (np.abs(left) ** 2).sum()))
        want[k] = 20 * np.log10(np.mean(10 ** (np.array(ratios) / 20)))
    assert got == pytest.approx({k: w - max(want.values()) for k, w in want.items()}, abs=2e-3)
