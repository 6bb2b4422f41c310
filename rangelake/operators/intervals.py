"""Long processing intervals as rows of blocks: correlations, least-squares clutter filters and ambiguity maps.

An interval of any length is a table of blocks (``block``, the interval's length ``n`` and the block's samples of reference and
surveillance channel). A block takes the few samples that delays reach from its neighbours (``with_halo``), so every
step below is a projection of blocks, followed where a sum over the interval is needed by sums of short vectors.

The normal equations of delayed (and Doppler-shifted) copies need no K x K sums per block. Moving both delays of an inner
product on by one moves its window by one sample, so the matrix follows from its first row and the samples at the
ends of the window: a block adds up vectors of K lags (by transform), and the matrix is completed per interval. A
Hermitian-Toeplitz system is solved by recursion in K^2 steps. Weights go back to the blocks by (interval, block).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangelake.functions.kernels import COMPLEX_VECTOR, _lists, _pack_complex
from rangelake.operators.ordered import join_keys

#: Samples of a block. Filters of more taps, margins and delays of more samples need a larger one.
BLOCK = 1 << 15
PAIR = ("ref_re", "ref_im", "surv_re", "surv_im")


# --- blocks -----------------------------------------------------------------------------


def keys_of(pairs: DataFrame) -> list[str]:
    """The columns that name an interval: all but the sample arrays."""
    return [c for c in pairs.columns if c not in PAIR]


def blocks_of(pairs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Intervals of one row each, cut into blocks: keys, n, block and the sample arrays of at most ``size`` samples."""
    n = F.size("ref_re")
    cut = pairs.withColumn("n", n.cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / size) - 1, F.lit(0).cast("long")))))
    at = (F.col("block") * size + 1).cast("int")
    return cut.select(*keys_of(pairs), "n", "block", *(F.slice(c, at, size).alias(c) for c in PAIR))


def blocks_of_samples(samples: DataFrame, keys: Sequence[str], at: str = "n", size: int = BLOCK) -> DataFrame:
    """The same from one row a sample (keys, ``at`` from 0, the four values): no interval is ever in one row."""
    block = F.expr(f"`{at}` div {size}").alias("block")
    rows = samples.groupBy(*keys, block).agg(F.array_sort(F.collect_list(F.struct(at, *PAIR))).alias("_s"))
    length = samples.groupBy(*keys).agg((F.max(at) + 1).cast("long").alias("n"))
    return join_keys(rows, length, keys).select(*keys, "n", "block", *(F.col(f"_s.{c}").alias(c) for c in PAIR))


def gathered(blocks: DataFrame, keys: Sequence[str], columns: Sequence[str] = PAIR) -> DataFrame:
    """Blocks joined into one row an interval, for intervals that are known to be short."""
    rows = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", *columns))).alias("_b"))
    return rows.select(*keys, *(F.flatten(f"_b.{c}").alias(c) for c in columns))


def with_halo(blocks: DataFrame, keys: Sequence[str], before: int | Column, after: int | Column = 0, size: int = BLOCK, beyond: bool = False) -> DataFrame:
    """Blocks with ``left_re``, ``left_im`` (reference samples before the block) and ``right_re``, ``right_im`` (surveillance samples after it).

    Each block sends its ends to its neighbours: one shuffle by (interval, block), no block is read twice. ``beyond`` keeps
    the block after the last one, where margins and delays reach.
    """
    before, after = (F.lit(x) if isinstance(x, int) else x for x in (before, after))
    fits = F.when((before <= size) & (after <= size), F.lit(0)).otherwise(F.raise_error(F.lit("the block is shorter than the reach; give a larger size")).cast("int"))
    part = lambda shift, arrays: F.struct((F.col("block") + shift).alias("to"), *(a.alias(k) for k, a in arrays.items()))
    none = F.lit(None).cast("array<double>")
    # the last places of a whole block: what the last block lacks reads as zero
    tail = lambda c, k: F.concat(F.slice(c, size - k + 1, k), F.array_repeat(F.lit(0.0), F.least(k, size - F.size(c))))
    empty = {**{c: none for c in PAIR}, "left_re": none, "left_im": none, "right_re": none, "right_im": none}
    sends = [
        part(F.lit(0) + fits, empty | {c: F.col(c) for c in PAIR}),
        part(F.lit(1), empty | {f"left_{x}": tail(f"ref_{x}", F.least(before, F.lit(size))) for x in ("re", "im")}),
        part(F.lit(-1), empty | {f"right_{x}": F.slice(f"surv_{x}", F.lit(1), after) for x in ("re", "im")}),
    ]
    sent = blocks.select(*keys, "n", F.explode(F.array(*sends)).alias("_p")).select(*keys, "n", F.col("_p.to").alias("block"), *(F.col(f"_p.{c}").alias(c) for c in empty))
    met = sent.filter("block >= 0").groupBy(*keys, "n", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in empty))
    met = met if beyond else met.filter(F.col("ref_re").isNotNull())
    return met.select(*keys, "n", "block", *(F.coalesce(c, F.array().cast("array<double>")).alias(c) for c in empty))


# --- kernels ----------------------------------------------------------------------------


def _power_of_two(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())


def lag_products(u: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """sum_t u[t] v[t - m] for m = 0..k-1; ``v`` begins k - 1 samples earlier than ``u``."""
    size = _power_of_two(len(u) + len(v))
    spectrum = np.fft.fft(u[::-1], size) * np.fft.fft(v, size)
    return np.fft.ifft(spectrum)[len(u) - 1 : len(u) - 1 + k][::-1]


def levinson(column: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of T x = right for the Hermitian-Toeplitz matrix of a first column, in K^2 steps."""
    forward, x = np.array([1 / column[0]]), np.array([right[0] / column[0]])
    for n in range(1, len(column)):
        lags = column[n:0:-1]
        miss = lags @ forward
        longer = np.append(forward, 0)
        forward = (longer - miss * longer[::-1].conj()) / (1 - abs(miss) ** 2)
        x = np.append(x, 0) + (right[n] - lags @ x) * forward[::-1].conj()
    return x


def completed(rows: np.ndarray, columns: np.ndarray, high: np.ndarray, low: np.ndarray, turn: float, at: tuple[int, int]) -> np.ndarray:
    """The matrix of inner products with first row ``rows`` and first column ``columns``.

    ``high`` and ``low`` are the last samples before the window's end and before its begin, newest first; ``turn`` is the
    phase a sample that separates the two Doppler shifts, ``at`` the window.
    """
    k = len(rows)
    out = np.empty((k, k), complex)
    out[0], out[:, 0] = rows, columns
    step = np.exp(1j * turn)
    enter, leave = np.exp(1j * turn * (at[0] - 1)), np.exp(1j * turn * (at[1] - 1))
    for i in range(k - 1):
        out[i + 1, 1:] = step * (out[i, :-1] + enter * low[i].conj() * low[:-1] - leave * high[i].conj() * high[:-1])
    return out


def _kernel(fn: Callable, arrays: Sequence[str], *values: str | Column) -> Column:
    """Arrow UDF: ``fn(complex arrays, values...)`` a row, complex vector out. Arrays are pairs of columns ``<name>_re``, ``<name>_im``."""
    m = len(arrays)

    def run(*columns: pa.Array) -> pa.Array:
        parts = [_lists(c) for c in columns[: 2 * m]]
        rest = [c.to_pylist() for c in columns[2 * m :]]
        out = []
        for i in range(len(columns[0])):
            z = [parts[2 * j][i] + 1j * parts[2 * j + 1][i] for j in range(m)]
            out.append(np.asarray(fn(*z, *(r[i] for r in rest)), dtype=complex).ravel())
        return _pack_complex(out)

    return F.arrow_udf(run, returnType=COMPLEX_VECTOR)(*(f"{a}_{x}" for a in arrays for x in ("re", "im")), *values)


def _filled(x: np.ndarray, size: int, front: bool = False) -> np.ndarray:
    """Zeros up to ``size`` samples, behind or in front."""
    return np.concatenate([np.zeros(size - len(x)), x] if front else [x, np.zeros(size - len(x))])


# --- sums over an interval ----------------------------------------------------------------


def summed_cells(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vectors (``z``) added element by element: keys, cell, re, im. Elements are added up where they are made, before any shuffle."""
    cells = rows.select(*keys, F.posexplode(F.arrays_zip(F.col("z.re").alias("re"), F.col("z.im").alias("im"))).alias("cell", "_z"))
    return cells.groupBy(*keys, "cell").agg(F.sum("_z.re").alias("re"), F.sum("_z.im").alias("im"))


def summed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sums as one short vector an interval: keys, sum_re, sum_im."""
    whole = summed_cells(rows, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell", "re", "im"))).alias("_s"))
    return whole.select(*keys, F.col("_s.re").alias("sum_re"), F.col("_s.im").alias("sum_im"))


def _batch(n: Column, batches: int) -> Column:
    """Samples of a batch."""
    return F.when(n % batches == 0, (n / batches).cast("long")).otherwise(F.raise_error(F.lit("the interval is not a multiple of the batch count")).cast("long"))


def _windows(batches: int, margin: int, size: int) -> Column:
    """(window, low, high) of every batch, widened by ``margin``, that a block overlaps."""
    whole, none = _batch(F.col("n"), batches), F.lit(0).cast("long")
    first = F.greatest(none, F.floor((F.col("block") * size - margin) / whole))
    last = F.least(F.lit(batches - 1).cast("long"), F.floor(((F.col("block") + 1) * size - 1 + margin) / whole))
    span = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(span, lambda w: F.struct(w.alias("window"), (w * whole - margin).alias("low"), ((w + 1) * whole + margin).alias("high")))


def _copies(rows: DataFrame, keys: Sequence[str], k: Column, dopplers: int, batches: int, margin: int, size: int) -> DataFrame:
    """keys, n, window, low, high and the vector sums from which the normal equations follow.

    In this order, K values each: lag products for Doppler differences -2D..2D, products with the surveillance channel for
    Doppler shifts -D..D, the samples before the window's end and before its begin.
    """

    def sums(left, ref, surv, block, n, k, low, high):
        start = block * size
        r = np.concatenate([_filled(left, k, True), _filled(ref, size)])  # from start - k
        s = _filled(surv, size)
        a, b = max(start, low), min(start + size, high)
        t = np.arange(a, b)
        own = r[a - start + k : b - start + k]
        back = r[a - start + 1 : b - start + k]  # from a - (k - 1)
        out = [lag_products(own.conj() * np.exp(1j * np.pi * d / n * t), back, k) if b > a else np.zeros(k) for d in range(-2 * dopplers, 2 * dopplers + 1)]
        out += [lag_products(s[a - start : b - start] * np.exp(-1j * np.pi * d / n * t), back.conj(), k) if b > a else np.zeros(k) for d in range(-dopplers, dopplers + 1)]
        for edge, inside in ((high, high - 1), (low, low)):  # samples edge - 1, edge - 2, ... from the block that holds the window's last, or first, sample
            held = start <= inside < start + size
            out.append(r[edge - 1 - start + k - np.arange(k)] if held else np.zeros(k))
        return np.concatenate(out)

    fits = F.when(k - 1 <= F.col("n") / batches, k).otherwise(F.raise_error(F.lit("a delay exceeds the batch")).cast("int"))
    halo = with_halo(rows, keys, fits, 0, size, beyond=True).withColumn("_w", F.explode(_windows(batches, margin, size)))
    z = _kernel(sums, ["left", "ref", "surv"], "block", "n", k, "_w.low", "_w.high")
    return summed(halo.select(*keys, "n", "_w.*", z.alias("z")), [*keys, "n", "window", "low", "high"])


def _equations(z: np.ndarray, k: int, dopplers: int, n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the copies with each other and with the surveillance channel; copies go by Doppler shift, then delay."""
    parts = z.reshape(-1, k)
    lags, cross = parts[: 4 * dopplers + 1], parts[4 * dopplers + 1 : -2]
    last, before = parts[-2], parts[-1]
    shifts = range(-dopplers, dopplers + 1)
    blocks = {
        d: completed(lags[d + 2 * dopplers], lags[2 * dopplers - d].conj(), last, before, np.pi * d / n, (low, high)) for d in range(-2 * dopplers, 2 * dopplers + 1)
    }
    return np.block([[blocks[e - d] for e in shifts] for d in shifts]), cross.ravel()


# --- correlations -------------------------------------------------------------------------


def _cells(rows: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """``z`` as rows: keys, index, re, im."""
    cells = rows.select(*keys, F.posexplode(F.arrays_zip(F.col("z.re").alias("re"), F.col("z.im").alias("im"))).alias(index, "_z"))
    return cells.select(*keys, F.col(index).cast("long").alias(index), F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def _hermitian(column: np.ndarray) -> np.ndarray:
    lag = np.subtract.outer(np.arange(len(column)), np.arange(len(column)))
    return np.where(lag >= 0, column[np.abs(lag)], column[np.abs(lag)].conj())


def correlation_matrix(blocks: DataFrame, keys: Sequence[str], k: int, toeplitz: bool = False, size: int = BLOCK) -> DataFrame:
    """Auto-correlation matrix of the reference over N samples: keys, row, col, re, im. ``toeplitz`` completes it from the first column alone."""

    def matrix(z, n, low, high):
        gram, _ = _equations(z, k, 0, n, low, high)
        return (_hermitian(gram[:, 0]) if toeplitz else gram) / n

    sums = _copies(blocks, keys, F.lit(k), 0, 1, 0, size)
    cells = _cells(sums.select(*keys, _kernel(matrix, ["sum"], "n", "low", "high").alias("z")), keys, "_c")
    return cells.select(*keys, F.expr(f"_c div {k}").alias("row"), (F.col("_c") % k).alias("col"), "re", "im")


def cross_correlation(blocks: DataFrame, keys: Sequence[str], k: int, size: int = BLOCK) -> DataFrame:
    """sum over t of surv[t] conj(ref[t - lag]): keys, n, lag, re, im."""
    sums = _copies(blocks, keys, F.lit(k), 0, 1, 0, size)
    return _cells(sums.select(*keys, "n", _kernel(lambda z: z[k : 2 * k], ["sum"]).alias("z")), [*keys, "n"], "lag")


# --- clutter filters ----------------------------------------------------------------------


def _filtered(blocks: DataFrame, keys: Sequence[str], weights: DataFrame, k: Column, dopplers: int, batches: int, size: int, out: str) -> DataFrame:
    """Blocks with the weighted copies taken out of the surveillance channel, batch by batch, as ``out``_re, ``out``_im."""
    whole = _batch(F.col("n"), batches)
    first, last = F.floor(F.col("window") * whole / size), F.floor(((F.col("window") + 1) * whole - 1) / size)
    # a copy of the weights for each block, so that no interval is one key of the join
    spread = weights.withColumn("block", F.explode(F.sequence(first, last))).groupBy(*keys, "block").agg(F.collect_list(F.struct("window", "z")).alias("_w"))
    met = join_keys(with_halo(blocks, keys, k, 0, size), spread, [*keys, "block"])

    def clean(left, ref, surv, block, n, k, weights):
        start, batch = block * size, n // batches
        r = np.concatenate([_filled(left, k, True), ref])
        done = surv.astype(complex)
        for w in weights:
            a, b = max(start, w["window"] * batch), min(start + len(surv), (w["window"] + 1) * batch)
            t = np.arange(a, b)
            reach = r[a - start + 1 : b - start + k]  # from a - (k - 1)
            z = (np.array(w["z"]["re"]) + 1j * np.array(w["z"]["im"])).reshape(-1, k)
            width = _power_of_two(len(reach) + k)
            spectrum = np.fft.fft(reach, width)
            for d, taps in zip(range(-dopplers, dopplers + 1), z):
                copy = np.fft.ifft(spectrum * np.fft.fft(taps, width))[k - 1 : k - 1 + len(t)]
                done[a - start : b - start] -= copy * np.exp(1j * np.pi * d / n * t) if d else copy
        return done

    named = met.withColumn("_z", _kernel(clean, ["left", "ref", "surv"], "block", "n", k, "_w"))
    columns = {c: F.col(c) for c in PAIR} | {f"{out}_{x}": F.col(f"_z.{x}") for x in ("re", "im")}
    return named.select(*keys, "n", "block", *(c.alias(name) for name, c in columns.items()))


def project_out(
    blocks: DataFrame, keys: Sequence[str], k: int | Column, dopplers: int = 0, batches: int = 1, margin: int = 0, toeplitz: bool = False, size: int = BLOCK, out: str = "surv",
) -> DataFrame:
    """The surveillance channel without what ``k`` delayed copies of the reference, each with Doppler shifts -D..D, explain of it.

    Weights are fitted on each of ``batches`` parts, widened by ``margin`` samples on both sides. With ``toeplitz`` the matrix is
    completed from its first column and solved by recursion, which needs one part and no Doppler shift.
    """
    if toeplitz and (dopplers or batches > 1 or margin):
        raise ValueError("a matrix completed from its column has one batch and no Doppler shift")
    taps = F.lit(k) if isinstance(k, int) else k

    def solve(z, n, low, high, k):
        if toeplitz:
            return levinson(z[:k].conj(), z[k : 2 * k])
        return np.linalg.solve(*_equations(z, k, dopplers, n, low, high))

    sums = _copies(blocks, keys, taps, dopplers, batches, margin, size)
    weights = sums.select(*keys, "n", "window", _kernel(solve, ["sum"], "n", "low", "high", taps).alias("z"))
    return _filtered(blocks, keys, weights, taps, dopplers, batches, size, out)


# --- ambiguity maps -----------------------------------------------------------------------


def ambiguity(blocks: DataFrame, keys: Sequence[str], turns: Callable[[int], np.ndarray], r_max: int, size: int = BLOCK) -> DataFrame:
    """sum over t of conj(ref[t] e^(i turn t)) surv[t + tau], tau < r_max, for each of ``turns(N)``: keys, doppler_bin, range_bin, re, im.

    A block gives its part of every cell; parts are added up before and after one shuffle, so neither an interval nor a
    transform of its length is in one row.
    """

    def lines(ref, surv, right, block, n):
        s = np.concatenate([surv, right])
        width = _power_of_two(len(s) + r_max)
        spectrum, t = np.fft.fft(s, width), block * size + np.arange(len(ref))
        return np.array([np.fft.ifft(spectrum * np.fft.fft(ref * np.exp(1j * turn * t), width).conj())[:r_max] for turn in turns(n)])

    halo = with_halo(blocks, keys, 0, r_max, size)
    cells = summed_cells(halo.select(*keys, _kernel(lines, ["ref", "surv", "right"], "block", "n").alias("z")), keys)
    cell = F.col("cell").cast("long")
    return cells.select(*keys, F.floor(cell / r_max).alias("doppler_bin"), (cell % r_max).alias("range_bin"), "re", "im")
