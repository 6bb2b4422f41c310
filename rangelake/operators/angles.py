"""Angle and position estimation.

An antenna vector is one row with arrays ``re, im`` over virtual antennas; a
covariance is one row with the M x M matrix flattened row by row in ``re, im``; a
spectrum is one row with ``spectrum`` over angle steps. All are bounded by the array
geometry. Spark groups, joins and gathers; kernels do products and small solves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangelake.functions.arrays import let
from rangelake.functions.complexnum import cplx
from rangelake.functions.kernels import COMPLEX_VECTOR, _lists, _pack, matrix_kernel, place, vector_kernel

# Side-lobe level (-6 dB power), wiggle factor, 3 dB width factor, input SNR.
SIDELOBE = 0.251188643150958
GAMMA = 1.2
WIDTH_3DB = 2.5
INPUT_SNR = 10000


def steering_matrix(est_range: float, resolution: float, n_ant: int) -> np.ndarray:
    """(angles, antennas) phases -pi * k * sin(angle), angles from -range to +range degrees."""
    angles = np.deg2rad(-est_range + resolution * np.arange(int(round(2 * est_range / resolution + 1))))
    return np.exp(-1j * np.pi * np.outer(np.sin(angles), np.arange(n_ant)))


def steering(cfg: DataFrame, est_range: float, resolution: float, antennas: Column, digits: int | None = None) -> DataFrame:
    """Steering table of each configuration row: angle_idx, antenna, s_re, s_im, rounded to ``digits``.

    A row becomes hundreds, so the rows are dealt first: a small file of them is a single task. The phases depend on the number of
    antennas alone: they are made once for each number that occurs, which sensors bound, and the rows take them from there.
    """
    n = int(round(2 * est_range / resolution + 1))
    table = cfg.select(antennas.alias("_antennas")).distinct().withColumn("angle_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "antenna", F.explode(F.sequence(F.lit(0), (F.col("_antennas") - 1).cast("int")))
    )
    phase = F.sin(F.radians(F.col("angle_idx") * resolution - est_range)) * F.col("antenna") * -math.pi
    value = (lambda c: c) if digits is None else (lambda c: F.round(c, digits) + F.lit(0.0))
    table = table.select(
        "_antennas", F.col("angle_idx").cast("long").alias("angle_idx"), F.col("antenna").cast("long").alias("antenna"),
        value(F.cos(phase)).alias("s_re"), value(F.sin(phase)).alias("s_im"),
    )
    dealt = cfg.repartition(4 * cfg.sparkSession.sparkContext.defaultParallelism)
    return dealt.withColumn("_antennas", antennas).join(F.broadcast(table), "_antennas").drop("_antennas")


def antenna_block(rcube: DataFrame, keys: Sequence[str], antennas: int | None = None, chirps: int | None = None) -> DataFrame:
    """Corner-turned rows (vant, chirp arrays) gathered per (keys, range_bin): flattened
    [antenna, chirp] arrays and ``antennas``.

    With ``antennas`` and ``chirps``, numbered rows (a ``chirp`` array beside re, im) are placed by antenna and chirp: a recording
    may have holes or end within a frame. What was not recorded is 0, also in ``seen`` (else 1).
    """
    if antennas is not None:
        return _placed_block(rcube, keys, antennas, chirps)
    block = F.array_sort(F.collect_list(F.struct("vant", "re", "im")))
    return rcube.groupBy(*keys, "range_bin").agg(block.alias("_b")).select(
        *keys, "range_bin", F.size("_b").alias("antennas"), F.flatten("_b.re").alias("re"), F.flatten("_b.im").alias("im")
    )


def _placed_block(rcube: DataFrame, keys: Sequence[str], antennas: int, chirps: int) -> DataFrame:
    def run(vant: pa.Array, chirp: pa.Array, re: pa.Array, im: pa.Array) -> pa.Array:
        entry = np.repeat(np.arange(len(vant)), np.diff(vant.offsets.to_numpy()))
        inside, numbers = chirp.flatten(), vant.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(inside.offsets.to_numpy())
        at = (np.repeat(entry, sizes), np.repeat(numbers, sizes), inside.flatten().to_numpy(zero_copy_only=False))
        values = [x.flatten().flatten().to_numpy(zero_copy_only=False) for x in (re, im)]
        grids = [place((len(vant), antennas, chirps), at, v) for v in (*values, np.ones(len(at[0])))]
        grids[2] = np.minimum(grids[2], 1)
        return pa.StructArray.from_arrays([_pack(g.reshape(len(vant), -1)) for g in grids], names=["re", "im", "seen"])

    kernel = F.arrow_udf(run, returnType="struct<re:array<double>,im:array<double>,seen:array<double>>")
    rows = rcube.filter(F.col("vant").isNotNull()).groupBy(*keys, "range_bin").agg(F.collect_list(F.struct("vant", "chirp", "re", "im")).alias("_b"))
    return rows.withColumn("_z", kernel("_b.vant", "_b.chirp", "_b.re", "_b.im")).select(
        *keys, "range_bin", F.lit(antennas).alias("antennas"), *[F.col(f"_z.{c}").alias(c) for c in ("re", "im", "seen")]
    )


def antenna_vectors(cells: DataFrame, keys: Sequence[str], antennas: int | None = None) -> DataFrame:
    """Long cells (vant, re, im) gathered to one antenna vector per key.

    With ``antennas`` a vector has that many elements, each at its place: an antenna that did not record reads 0 (a recording may
    end within a chirp), what came twice adds up.
    """
    if antennas is not None:
        own = lambda m, c: F.when(F.col("vant") == m, c)
        whole = lambda c: F.array(*[
            F.when(F.count(own(m, F.lit(1))) > 0, F.sum(own(m, F.col(c)))).otherwise(0.0) for m in range(antennas)
        ])
        return cells.groupBy(*keys).agg(whole("re").alias("re"), whole("im").alias("im"))
    block = F.array_sort(F.collect_list(F.struct("vant", "re", "im")))
    return cells.groupBy(*keys).agg(block.alias("_b")).select(*keys, F.col("_b.re").alias("re"), F.col("_b.im").alias("im"))


def _block_covariance(antennas: int):
    def run(z: np.ndarray) -> np.ndarray:
        x = z.reshape(len(z), antennas, -1)
        return (x @ x.conj().transpose(0, 2, 1) / x.shape[2]).reshape(len(z), -1)

    return vector_kernel(run)


def _seen_covariance(antennas: int):
    """Like ``_block_covariance``, NULL where two antennas have no chirp in common."""

    def run(re: pa.Array, im: pa.Array, seen: pa.Array) -> pa.Array:
        x, s = np.asarray(_lists(re)) + 1j * np.asarray(_lists(im)), np.asarray(_lists(seen))
        x, s = x.reshape(len(x), antennas, -1), s.reshape(len(x), antennas, -1)
        r, none = x @ x.conj().transpose(0, 2, 1) / x.shape[2], ((s @ s.transpose(0, 2, 1)) == 0).ravel()
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * antennas**2)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(v.ravel(), mask=none)) for v in (r.real, r.imag)], names=["re", "im"])

    return F.arrow_udf(run, returnType=COMPLEX_VECTOR)


def covariance(rcube: DataFrame, keys: Sequence[str], antennas: int, chirps: int | None = None, blank: bool = False) -> DataFrame:
    """Spatial covariance X X^H / chirps per (keys, range_bin).

    With ``chirps``, numbered rows of incomplete frames are taken as in :func:`antenna_block`; with ``blank``, cells of antennas that
    have no chirp in common are NULL instead of 0.
    """
    if chirps is not None:
        block = antenna_block(rcube, keys, antennas, chirps).drop("antennas")
        z = _seen_covariance(antennas)("re", "im", "seen") if blank else _block_covariance(antennas)("re", "im")
        return _complex(block, z).drop("seen")
    return _complex(antenna_block(rcube, keys).drop("antennas"), _block_covariance(antennas)("re", "im"))


def covariance_beside(block: DataFrame, antennas: int) -> DataFrame:
    """Covariance of antenna blocks, with the block kept as ``x_re, x_im`` in the same row."""
    kept = block.drop("antennas", "seen").withColumnsRenamed({"re": "x_re", "im": "x_im"})
    return kept.withColumn("_z", _block_covariance(antennas)("x_re", "x_im")).withColumns(
        {"re": F.col("_z.re"), "im": F.col("_z.im")}
    ).drop("_z")


def beam_doppler(rows: DataFrame, antennas: int, ref_compat: bool = False) -> DataFrame:
    """Add ``doppler_signed``: strongest Doppler bin of a block x_re, x_im combined by w_re, w_im."""

    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        x = np.asarray(_lists(a)) + 1j * np.asarray(_lists(b))
        w = np.asarray(_lists(c)) + 1j * np.asarray(_lists(d))
        if not len(x):
            return pa.array([], pa.int64())
        z = np.fft.fft(np.einsum("bac,ba->bc", x.reshape(len(x), antennas, -1), w), axis=1)
        n = z.shape[1]
        k = np.array([int(np.argmax(v)) for v in (z if ref_compat else np.abs(z))])
        return pa.array(np.where(k < n // 2, k, k - n), pa.int64())

    return rows.withColumn("doppler_signed", F.arrow_udf(run, returnType="bigint")("x_re", "x_im", "w_re", "w_im"))


def _complex(df: DataFrame, z: Column) -> DataFrame:
    keys = [c for c in df.columns if c not in ("re", "im")]
    return df.withColumn("_z", z).select(*keys, F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def fb_average(cov: DataFrame) -> DataFrame:
    """Forward-backward average: mean of the matrix and the conjugate of its 180 degree turn."""
    return cov.withColumns({
        "_re": F.zip_with("re", F.reverse("re"), lambda a, b: (a + b) * 0.5),
        "_im": F.zip_with("im", F.reverse("im"), lambda a, b: (a - b) * 0.5),
    }).drop("re", "im").withColumnsRenamed({"_re": "re", "_im": "im"})


def spatial_smooth(cov: DataFrame, antennas: int, subarrays: int, backward: bool = False) -> DataFrame:
    """Mean over overlapping sub-arrays of the covariance (of its cells that are not NULL), optionally with its backward twin."""
    if not 1 <= subarrays <= antennas:
        raise ValueError("the number of sub-arrays does not fit the array")
    side = antennas - subarrays + 1

    def smooth(name: str) -> Column:
        cell = lambda c, p: F.element_at(F.col(name), ((F.floor(c / side) + p) * antennas + c % side + p + 1).cast("int"))
        known = lambda c: F.filter(F.transform(F.sequence(F.lit(0), F.lit(subarrays - 1)), lambda p: cell(c, p)), lambda x: x.isNotNull())
        mean = lambda cells: F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(F.size(cells), F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda c: mean(known(c)))

    out = cov.withColumns({"_re": smooth("re"), "_im": smooth("im")}).drop("re", "im").withColumnsRenamed({"_re": "re", "_im": "im"})
    return fb_average(out) if backward else out


def bartlett(vectors: DataFrame, est_range: float = 90, resolution: float = 1, antennas: int = 8) -> DataFrame:
    """Add ``spectrum`` |a^H x|^2 over the angle grid."""
    a = steering_matrix(est_range, resolution, antennas)
    run = lambda z: np.abs(z @ a.conj().T) ** 2
    return vectors.withColumn("spectrum", vector_kernel(run, "array<double>")("re", "im"))


def _inverse(r: np.ndarray, loading: float) -> np.ndarray:
    m = r.shape[1]
    if loading:
        scale = np.trace(r, axis1=1, axis2=2).real / m
        r = r + loading * scale[:, None, None] * np.eye(m)
    try:
        return np.linalg.inv(r)
    except np.linalg.LinAlgError:  # fewer snapshots than antennas: the inverse on what the snapshots span
        return np.linalg.pinv(r, hermitian=True) if len(r) == 1 else np.concatenate([_inverse(x[None], 0.0) for x in r])


def capon(cov: DataFrame, antennas: int, est_range: float = 90, resolution: float = 1, loading: float = 0.0) -> DataFrame:
    """Capon ``spectrum`` |1 / (a^H R^-1 a)| and beam weights ``w_re, w_im`` (R^-1 a / (a^H R^-1 a),
    summed over the grid). One batched inverse serves both."""
    a = steering_matrix(est_range, resolution, antennas)

    def run(r: np.ndarray) -> np.ndarray:
        first = _inverse(r, loading) @ a.T
        den = 1.0 / np.einsum("ka,bak->bk", a.conj(), first)
        weights = np.einsum("bak,bk->ba", first, den)
        return np.concatenate([np.abs(den), weights], axis=1)

    keys = [c for c in cov.columns if c not in ("re", "im")]
    n = len(a)
    return cov.withColumn("_z", matrix_kernel(run)("re", "im")).select(
        *keys, F.slice("_z.re", 1, n).alias("spectrum"),
        F.slice("_z.re", n + 1, antennas).alias("w_re"), F.slice("_z.im", n + 1, antennas).alias("w_im"),
    )


def beam_weights(capon_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Capon weight arrays to one row per antenna: keys, range_bin, vant, w_re, w_im."""
    return capon_rows.select(*keys, "range_bin", F.posexplode(F.arrays_zip("w_re", "w_im")).alias("vant", "w")).select(
        *keys, "range_bin", F.col("vant").cast("long").alias("vant"), F.col("w.w_re").alias("w_re"), F.col("w.w_im").alias("w_im")
    )


def beam_power(cov: DataFrame, antennas: int, est_range: float = 90, resolution: float = 1) -> DataFrame:
    """Bartlett ``spectrum`` a^H R a of a covariance: the mean beam power over its snapshots."""
    a = steering_matrix(est_range, resolution, antennas)
    run = lambda r: np.abs(np.einsum("ka,bak->bk", a.conj(), r @ a.T))
    return cov.withColumn("spectrum", matrix_kernel(run, "array<double>")("re", "im"))


def _check_sources(n_src: int, antennas: int) -> None:
    if n_src >= antennas:
        raise ValueError("the number of sources must be less than the number of antennas")


def _eigenvectors(r: np.ndarray) -> np.ndarray:
    """Eigenvectors of Hermitian matrices, by rising eigenvalue; those of a matrix with a missing cell are NaN."""
    whole = np.isfinite(r).all(axis=(1, 2))
    out = np.full(r.shape, complex(np.nan, np.nan))
    out[whole] = np.linalg.eigh(r[whole])[1]
    return out


def music(cov: DataFrame, antennas: int, n_src: int, est_range: float = 90, resolution: float = 1) -> DataFrame:
    """MUSIC ``spectrum`` from the noise subspace."""
    _check_sources(n_src, antennas)
    a = steering_matrix(est_range, resolution, antennas)

    def run(r: np.ndarray) -> np.ndarray:
        noise = _eigenvectors(r)[:, :, : antennas - n_src]
        leak = noise.conj().transpose(0, 2, 1) @ a.T
        return 1.0 / (np.abs(leak) ** 2).sum(axis=1)

    return cov.withColumn("spectrum", matrix_kernel(run, "array<double>")("re", "im"))


def _angles_from(z: np.ndarray, step: int = 1) -> np.ndarray:
    return np.sort(np.rad2deg(np.arcsin(np.clip(-np.angle(z) / (np.pi * step), -1, 1))))


def root_music(cov: DataFrame, antennas: int, n_src: int) -> DataFrame:
    """Add ``angles``: degrees of the ``n_src`` polynomial roots nearest the unit circle from inside."""
    _check_sources(n_src, antennas)

    def run(r: np.ndarray) -> np.ndarray:
        out = []
        for noise in _eigenvectors(r)[:, :, : antennas - n_src]:
            if np.isnan(noise).any():
                out.append(np.full(n_src, np.nan))
                continue
            c = noise @ noise.conj().T
            roots = np.roots([np.trace(c, offset=k) for k in range(antennas - 1, -antennas, -1)])
            inside = roots[np.abs(roots) <= 1.0]
            best = inside[np.argsort(np.abs(inside))[-n_src:]]
            out.append(np.pad(_angles_from(best), (0, n_src - len(best)), constant_values=np.nan))
        return np.array(out)

    return cov.withColumn("angles", matrix_kernel(run, "array<double>")("re", "im"))


def esprit(cov: DataFrame, antennas: int, n_src: int, displacement: int = 1) -> DataFrame:
    """Add ``angles``: degrees from the rotation between two displaced sub-arrays."""
    _check_sources(n_src, antennas)
    if not 0 < displacement <= antennas / 2:
        raise ValueError("the displacement must lie between 1 and half of the array")

    def run(r: np.ndarray) -> np.ndarray:
        out = []
        for signal in _eigenvectors(r)[:, :, antennas - n_src:]:
            if np.isnan(signal).any():
                out.append(np.full(n_src, np.nan))
                continue
            turn = np.linalg.lstsq(signal[: antennas - displacement], signal[displacement:], rcond=None)[0]
            out.append(_angles_from(np.linalg.eigvals(turn), displacement))
        return np.array(out)

    return cov.withColumn("angles", matrix_kernel(run, "array<double>")("re", "im"))


# --- peak search ---------------------------------------------------------------------


def peak_search(spectra: DataFrame, level: float = SIDELOBE) -> DataFrame:
    """Add ``peaks`` (interior local maxima at or above ``level`` x maximum: loc, value),
    ``num_peaks`` and ``total_power``."""
    s = F.col("spectrum")
    at = lambda i: F.element_at(s, (i + 1).cast("int"))
    inner = F.sequence(F.lit(1), F.size(s) - 2)
    locs = let(F.array_max(s) * level, lambda floor: F.filter(
        inner, lambda i: (at(i) > at(i - 1)) & (at(i) > at(i + 1)) & (at(i) >= floor)
    ))
    return spectra.withColumn(
        "peaks", F.transform(locs, lambda i: F.struct(i.cast("long").alias("loc"), at(i).alias("value")))
    ).withColumns({
        "num_peaks": F.size("peaks").cast("long"),
        "total_power": F.aggregate("peaks", F.lit(0.0), lambda acc, p: acc + p["value"]),
    })


def _legs(curve: np.ndarray, gamma: float, floor: float, strict: bool) -> list[tuple[int, float, int]]:
    """Peaks (place, value, width) of a closed curve that stand out by the factor ``gamma`` on both sides.

    The curve is cut into legs: a climb starts where it exceeds the lowest value since the last descent by ``gamma``, a
    descent where it is below the highest value of the climb by ``gamma``. Both ends come from running extrema, and the
    curve is read on past its end up to where the first climb started.
    """
    n = len(curve)
    twice = np.concatenate([curve, curve])
    end, first, out = n, None, []
    low_from, record, place = 0, 0.0, 0  # start of the descent; highest value and its place before the climb
    seen = 0
    while True:
        part = twice[low_from:end]
        climbs = np.flatnonzero(part > np.minimum.accumulate(part) * gamma)
        climbs = climbs[climbs > 0] if seen else climbs
        if not len(climbs):
            return out
        start = low_from + int(climbs[0])
        before = twice[seen : start + 1]
        if len(before) and before.max() > record:
            place = seen + int(before.argmax())
        if first is None:
            first, end = start, n + start
        part = twice[start:end]
        tops = np.maximum.accumulate(part)
        falls = 1 + np.flatnonzero(part[1:] < tops[1:] / gamma)
        if not len(falls):
            return out
        stop = start + int(falls[0])
        record = float(tops[falls[0]])
        if record > twice[start]:
            place = start + int(twice[start:stop].argmax())
        if record > floor or not strict and record == floor:
            out.append((place % n, record, stop - place))
        low_from = seen = stop


def _hysteresis(gamma: float, level: float, strict: bool):
    """Arrow UDF: array<struct<loc, value, width>> of each spectrum."""

    def run(spectra: pa.Array) -> pa.Array:
        found = [[] if not len(c) else _legs(c, gamma, c.max() * level, strict) for c in _lists(spectra)]
        flat = [p for peaks in found for p in peaks]
        rows = pa.StructArray.from_arrays(
            [pa.array([p[0] for p in flat], pa.int64()), pa.array([p[1] for p in flat], pa.float64()), pa.array([p[2] for p in flat], pa.int64())], names=["loc", "value", "width"]
        )
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)), rows)

    return F.arrow_udf(run, returnType="array<struct<loc:bigint,value:double,width:bigint>>")


def peak_search_full(spectra: DataFrame, gamma: float = GAMMA, level: float = SIDELOBE, slots: int | None = None) -> DataFrame:
    """Add ``peaks`` (loc, value, width) by hysteresis search and ``num_peaks``; ``slots`` keeps the first few."""
    found = _hysteresis(gamma, level, False)("spectrum")
    return spectra.withColumn("peaks", F.slice(found, 1, slots) if slots else found).withColumn("num_peaks", F.size("peaks").cast("long"))


def peak_search_variance(spectra: DataFrame, level: float = SIDELOBE, gamma: float = GAMMA) -> DataFrame:
    """Like :func:`peak_search_full`, peaks strictly above the level, with ``total_power`` of the peaks."""
    return spectra.withColumn("peaks", _hysteresis(gamma, level, True)("spectrum")).withColumns({
        "num_peaks": F.size("peaks").cast("long"),
        "total_power": F.aggregate("peaks", F.lit(0.0), lambda acc, p: acc + p["value"]),
    })


def peak_variance(
    searched: DataFrame, resolution: float, width_3db: float = WIDTH_3DB, input_snr: float = INPUT_SNR
) -> DataFrame:
    """One row per peak: peak_idx, loc, value, width and ``variance`` from width and relative power."""
    keep = [c for c in searched.columns if c not in ("peaks", "spectrum")]
    rows = searched.select(*keep, F.posexplode("peaks").alias("peak_idx", "p")).select(
        *keep, F.col("peak_idx").cast("long").alias("peak_idx"), "p.loc", "p.value", "p.width"
    )
    snr = F.col("value") / F.col("total_power") * (2 * input_snr)
    return rows.withColumn("variance", F.col("width") * (2 * resolution * width_3db) * F.sqrt(F.lit(1.0) / snr))


def bf_one_point(vectors: DataFrame, angle_idx: Column, est_range: float, resolution: float, antennas: int) -> DataFrame:
    """Add ``b_re, b_im``: sum of steering x signal at one angle step per row."""
    theta = F.radians(angle_idx * resolution - est_range)
    z = _steered(F.col("re"), F.col("im"), theta, antennas)
    return vectors.withColumns({"b_re": z.re, "b_im": z.im})


def _steered(re: Column, im: Column, theta: Column, antennas: int, offset: int = 0):
    total = cplx(F.lit(0.0), F.lit(0.0))
    for m in range(antennas):
        phase = F.sin(theta) * (-math.pi * m)
        total = total.plus(cplx(re[offset + m], im[offset + m]).times(cplx(F.cos(phase), F.sin(phase))))
    return total


def bf_single_det(vectors: DataFrame, est_range: float = 90, resolution: float = 1, antennas: int = 8) -> DataFrame:
    """Add ``max_index``: angle step of the largest Bartlett power (first on a tie)."""
    s = bartlett(vectors, est_range, resolution, antennas)
    return s.withColumn("max_index", F.array_position("spectrum", F.array_max("spectrum")).cast("long") - 1)


def bf_single(
    vectors: DataFrame, noise: float, resolution: float, est_range: float = 90, antennas: int = 8
) -> DataFrame:
    """Single known peak: ``max_index``, 3 dB ``span`` around it (circular) and ``variance``."""
    found = bf_single_det(vectors, est_range, resolution, antennas)
    s, n = F.col("spectrum"), F.size("spectrum")
    half = F.array_max(s) * 0.5
    k = F.col("max_index").cast("int")
    ahead = F.concat(F.slice(s, k + 1, n), F.slice(s, F.lit(1), k))
    length = lambda run: F.coalesce(
        F.nullif(F.array_position(let(half, lambda h: F.transform(run, lambda x: x < h)), F.lit(True)), F.lit(0)), n + 1
    ) - 1
    add = lambda run, m: F.aggregate(F.slice(run, F.lit(1), m.cast("int")), F.lit(0.0), lambda acc, x: acc + x)
    power = F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda acc, x: acc + x)
    found = found.withColumn("_ahead", ahead).withColumn(
        "_behind", F.concat(F.slice("_ahead", 1, 1), F.reverse(F.slice("_ahead", F.lit(2), n - 1)))
    )
    found = found.withColumns({"_right": length(F.col("_ahead")), "_left": length(F.col("_behind"))})
    found = found.withColumns({
        "span": (F.col("_right") + F.col("_left") - 1).cast("long"),
        "_signal": add(F.col("_ahead"), F.col("_right")) + add(F.col("_behind"), F.col("_left")) - F.element_at("_ahead", 1),
        "_total": F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x),
        "_input": power,
    })
    inverse = F.col("_input") * 2 * antennas * F.col("_signal") / (F.col("_total") * noise)
    return found.withColumn("variance", F.col("span") * resolution * F.sqrt(F.lit(1.0) / inverse)).drop(
        "_ahead", "_behind", "_right", "_left", "_signal", "_total", "_input"
    )


def bf_multi_det(
    vectors: DataFrame, est_range: float = 90, resolution: float = 1, antennas: int = 8, gamma: float = GAMMA,
    level: float = SIDELOBE, search: bool = True,
) -> DataFrame:
    """Bartlett spectrum and, on request, its peaks; without a search ``num_peaks`` is -1."""
    s = bartlett(vectors, est_range, resolution, antennas)
    return peak_search_full(s, gamma, level) if search else s.withColumn("num_peaks", F.lit(-1).cast("long"))


def bf_multi(
    vectors: DataFrame, est_range: float = 90, resolution: float = 1, antennas: int = 8, gamma: float = GAMMA,
    level: float = SIDELOBE, width_3db: float = WIDTH_3DB, input_snr: float = INPUT_SNR,
) -> DataFrame:
    """One row per Bartlett peak with its variance and ``angle`` in degrees."""
    searched = peak_search_variance(bartlett(vectors, est_range, resolution, antennas), level, gamma)
    rows = peak_variance(searched.drop("re", "im"), resolution, width_3db, input_snr)
    return rows.withColumn("angle", F.col("loc") * resolution - est_range)


# --- positions -----------------------------------------------------------------------


def naive_xyz(vectors: DataFrame, tx: int = 3, rx: int = 4, fft_size: int = 64) -> DataFrame:
    """Unit direction ``x, y, z`` from the azimuth peak and the phase to the elevation row."""
    if tx <= 2:
        raise ValueError("position needs a configuration with more than 2 transmitters")

    def run(z: np.ndarray) -> np.ndarray:
        rows = np.arange(len(z))
        azimuth = np.fft.fft(z[:, : 2 * rx], fft_size, axis=1)
        elevation = np.fft.fft(z[:, 2 * rx: 3 * rx], axis=1)
        k = np.abs(azimuth).argmax(axis=1)
        e = np.abs(elevation).argmax(axis=1)
        return np.stack([k + 0j, azimuth[rows, k], elevation[rows, e]], axis=1)

    out = vectors.withColumn("_p", vector_kernel(run)("re", "im"))
    k = F.col("_p.re")[0]
    # the phase step is pi times the direction cosine
    out = out.withColumn("_x", F.when(k > fft_size // 2 - 1, k - fft_size).otherwise(k) * (2.0 / fft_size))
    turn = F.col("_x") * (2 * math.pi)
    one = cplx(F.col("_p.re")[1], F.col("_p.im")[1])
    two = cplx(F.col("_p.re")[2], F.col("_p.im")[2])
    wz = one.times(two.conj()).times(cplx(F.cos(turn), F.sin(turn))).phase()
    out = out.withColumn("_zz", wz / math.pi)
    inner = F.lit(1.0) - F.col("_x") * F.col("_x") - F.col("_zz") * F.col("_zz")
    norm = F.sqrt(F.col("_x") * F.col("_x") + F.col("_zz") * F.col("_zz"))
    return out.withColumns({
        "x": F.when(inner > 0, F.col("_x")).otherwise(F.try_divide(F.col("_x"), norm)),
        "y": F.when(inner > 0, F.sqrt(F.greatest(inner, F.lit(0.0)))).otherwise(0.0),
        "z": F.when(inner > 0, F.col("_zz")).otherwise(F.try_divide(F.col("_zz"), norm)),
    }).drop("_p", "_x", "_zz")


def mixed_xyz(
    vectors: DataFrame, range_resolution: float, method: str = "Capon", est_range: float = 90, resolution: float = 1,
    max_variance: float = 10.0, loading: float = 1e-3,
) -> DataFrame:
    """Zero or more points per detection: azimuth by beamforming over antennas 0..7, elevation by
    the phase between rungs 2..5 and 8..11. Adds azimuth ``theta``, elevation ``phi`` (deg), x, y, z.

    ``vectors`` carries 12-antenna vectors, ``range_bin`` and whatever identifies a detection.
    """
    if method not in ("Capon", "Bartlett"):
        raise ValueError("method must be 'Capon' or 'Bartlett'")
    a = steering_matrix(est_range, resolution, 8)

    def run(z: np.ndarray) -> np.ndarray:
        if z.shape[1] != 12:
            raise ValueError("12 virtual antennas are required")
        x = z[:, :8]
        if method == "Bartlett":
            return np.abs(x @ a.conj().T) ** 2
        r = x[:, :, None] * x[:, None, :].conj()
        r = 0.5 * (r + r[:, ::-1, ::-1].conj())
        first = _inverse(r, loading) @ a.T
        return np.abs(1.0 / np.einsum("ka,bak->bk", a.conj(), first))

    searched = peak_search_variance(vectors.withColumn("spectrum", vector_kernel(run, "array<double>")("re", "im")), 0.9)
    rows = peak_variance(searched, resolution).filter(F.col("variance") < max_variance)
    theta = F.radians(F.col("loc") * resolution - est_range)
    upper = _steered(F.col("re"), F.col("im"), theta, 4, 8)
    lower = _steered(F.col("re"), F.col("im"), theta, 4, 2)
    rows = rows.withColumn("_e", F.asin(lower.times(upper.conj()).phase() / math.pi)).withColumn("_a", -theta)
    rows = rows.withColumns({"phi": F.degrees("_e"), "theta": F.degrees(F.asin(F.sin("_a") * F.cos("_e")))})
    r = F.col("range_bin") * range_resolution
    return rows.withColumns({
        "x": F.sin(F.radians("theta")) * r, "y": F.cos(F.radians("theta")) * r, "z": F.tan(F.radians("phi")) * r,
    }).drop("_e", "_a", "re", "im", "num_peaks", "total_power")


def azimuth_xy(
    vectors: DataFrame, n_angle: int, n_range: int, n_doppler: int, range_resolution: float, range_bias: float = 0.0
) -> DataFrame:
    """Azimuth re-processing of detections: zero-padded transform of compensated antenna vectors,
    strongest bin, position. Adds angle_idx, peak_val, x, y."""

    def run(z: np.ndarray) -> np.ndarray:
        power = np.abs(np.fft.fft(z, n_angle, axis=1)) ** 2
        k = power.argmax(axis=1)
        return np.stack([k, power[np.arange(len(k)), k]], axis=1)

    out = vectors.withColumn("_p", vector_kernel(run, "array<double>")("re", "im"))
    k = F.col("_p")[0]
    s = F.when(k > n_angle / 2 - 1, k - n_angle).otherwise(k)
    r = F.greatest(F.col("range_bin") * range_resolution - range_bias, F.lit(0.0))
    out = out.withColumns({
        "angle_idx": s.cast("long"), "peak_val": F.sqrt(F.col("_p")[1] / (n_range * n_angle * n_doppler)), "x": r * s * (2.0 / n_angle),
    })
    return out.withColumn("y", F.sqrt(F.greatest(r * r - F.col("x") * F.col("x"), F.lit(0.0)))).drop("_p", "re", "im")


def doa(vectors: DataFrame, positions: Sequence[float], method: str = "Bartlett", loading: float = 1e-3) -> DataFrame:
    """Add ``doa``: angle step 0..179 of the strongest response of each antenna vector.

    The covariance of one vector has rank 1, so with diagonal loading its inverse is
    closed-form and every method needs only y = s^H a, ||a||^2 and a[0]:
    R^-1 = (I - a a^H / (l + ||a||^2)) / l with l = loading x ||a||^2.
    """
    if method not in ("Fourier", "Bartlett", "Capon", "MEM", "MUSIC", "LPM"):
        raise ValueError(f"unknown method {method!r}")
    s = np.exp(2j * np.pi * np.outer(np.cos(np.deg2rad(np.arange(180))), np.asarray(positions)))
    m = len(positions)

    def run(a: np.ndarray) -> np.ndarray:
        y = a @ s.conj().T
        norm = (np.abs(a) ** 2).sum(axis=1, keepdims=True)
        lam = loading * norm
        if method in ("Fourier", "Bartlett"):
            spectrum = np.abs(y) ** 2
        elif method == "Capon":
            spectrum = lam / (m - np.abs(y) ** 2 / (lam + norm))
        elif method == "MUSIC":
            spectrum = 1.0 / np.maximum(m - np.abs(y) ** 2 / norm, 1e-12)
        else:  # MEM and LPM share the first column of the inverse
            first = (s[:, 0].conj()[None, :] - y * a[:, :1].conj() / (lam + norm)) / lam
            corner = (1.0 - np.abs(a[:, :1]) ** 2 / (lam + norm)) / lam
            spectrum = (np.abs(corner) if method == "LPM" else 1.0) / np.abs(first) ** 2
        return spectrum.argmax(axis=1)[:, None].astype(float)

    return vectors.withColumn("doa", vector_kernel(run, "array<double>")("re", "im")[0].cast("long"))
