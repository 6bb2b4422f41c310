"""Taper weights as SQL expressions over a position and a length."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Cosine-sum coefficients of the tapers.
COSINE_SUMS = {
    "hanning": [0.5, 0.5],
    "hamming": [0.54, 0.46],
    "blackman": [0.42, 0.5, 0.08],
    "blackman_harris": [0.35875, 0.48829, 0.14128, 0.01168],
    "flat_top": [0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368],
}
# Names used by the passive-radar side.
IQ_NAMES = {
    "Rectangular": "rectangular", "Flat top": "flat_top", "Hamming": "hamming", "Hann": "hanning",
    "Tukey": "tukey", "Blackman": "blackman", "Blackman-Harris": "blackman_harris",
}
KINDS = [*COSINE_SUMS, "bartlett", "rectangular", "tukey", "kaiser"]


def _bessel_i0(x: Column, terms: int = 40) -> Column:
    """Series of the modified Bessel function of order 0 (exact to double for x <= 20)."""
    quarter = x * x / 4
    step = lambda acc, k: F.struct(
        (acc["term"] * quarter / (k * k)).alias("term"), (acc["sum"] + acc["term"] * quarter / (k * k)).alias("sum")
    )
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: acc["sum"])


def weight(kind: str, i: Column, n: Column, beta: float = 4.0) -> Column:
    """Weight at position ``i`` (0-based) of a symmetric taper of length ``n``."""
    last = (n - 1).cast("double")
    if kind == "rectangular":
        return F.lit(1.0)
    if kind in COSINE_SUMS:
        out = F.lit(0.0)
        for k, a in enumerate(COSINE_SUMS[kind]):
            out = out + F.lit(a * (-1) ** k) * F.cos(i * (2 * math.pi * k) / last)
        return out
    if kind == "bartlett":
        return F.lit(1.0) - F.abs(i * 2 / last - 1)
    if kind == "tukey":
        edge = F.floor(last / 4)
        rise = (F.cos((i * 4 / last - 1) * math.pi) + 1) * 0.5
        fall = (F.cos((i * 4 / last - 3) * math.pi) + 1) * 0.5
        return F.when(i <= edge, rise).when(i < n - 1 - edge, F.lit(1.0)).otherwise(fall)
    if kind == "kaiser":
        t = i * 2 / last - 1
        arg = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - t * t)) * beta
        return _bessel_i0(arg) / float(np.i0(beta))
    raise ValueError(f"unsupported taper {kind!r}; one of {KINDS}")


def taper(vector: Column, kind: str, beta: float = 4.0) -> Column:
    """An array column times the taper of its length."""
    n = F.size(vector)
    return F.transform(vector, lambda x, i: x * weight(kind, i.cast("double"), n, beta))
