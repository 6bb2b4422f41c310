"""Payload layout: flat sample vectors to cubes and back."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangelake.functions.kernels import COMPLEX_VECTOR, _pack, place


def _size(v: int | str | Column) -> Column:
    if isinstance(v, int):
        return F.lit(v)
    return F.col(v) if isinstance(v, str) else v


def _pick(values: Column, index: Column) -> Column:
    return F.element_at(values, (index + 1).cast("int")).cast("double")


def to_cube(frames: DataFrame, chirps, tx, rx, samples, values: str = "samples") -> DataFrame:
    """Flat [chirp, tx, sample, IQ, rx] vectors (I first) to one row per (chirp, tx, rx).

    The sizes may be integers or columns of a joined configuration. All rows of a frame
    come from one array expression, so the flat vector is never copied per output row.
    """
    c_n, t_n, r_n, s_n = (_size(v) for v in (chirps, tx, rx, samples))
    flat = F.col(values)
    whole = F.size(flat) == c_n * t_n * r_n * s_n * 2
    checked = frames.withColumn(values, F.when(whole, flat).otherwise(
        F.raise_error(F.concat(F.lit("payload of "), F.size(flat), F.lit(" values does not fit the configuration")))
    ))

    def at(chirp, t, r, iq):
        return F.transform(
            F.sequence(F.lit(0), s_n - 1), lambda s: _pick(flat, (((chirp * t_n + t) * s_n + s) * 2 + iq) * r_n + r)
        )

    cells = F.transform(
        F.sequence(F.lit(0), c_n * t_n * r_n - 1),
        lambda k: F.struct(
            F.floor(k / (t_n * r_n)).cast("long").alias("chirp"),
            (F.floor(k / r_n) % t_n).cast("long").alias("tx"),
            (k % r_n).cast("long").alias("rx"),
            at(F.floor(k / (t_n * r_n)), F.floor(k / r_n) % t_n, k % r_n, 0).alias("re"),
            at(F.floor(k / (t_n * r_n)), F.floor(k / r_n) % t_n, k % r_n, 1).alias("im"),
        ),
    )
    keys = [c for c in frames.columns if c != values]
    return checked.select(*keys, F.inline(cells))


def organize_iq(frames: DataFrame, chirps: int, rx: int, samples: int, q_first: bool = True, values: str = "samples") -> DataFrame:
    """Two-lane card layout (groups of four: two I, two Q or the reverse) to rows per (chirp, rx)."""
    flat = F.col(values)
    re_off, im_off = (2, 0) if q_first else (0, 2)

    def vector(base, offset):
        return F.transform(
            F.sequence(F.lit(0), F.lit(samples - 1)),
            lambda s: _pick(flat, F.floor((base + s) / 2) * 4 + (base + s) % 2 + offset),
        )

    cells = F.transform(
        F.sequence(F.lit(0), F.lit(chirps * rx - 1)),
        lambda k: F.struct(
            F.floor(k / rx).cast("long").alias("chirp"), (k % rx).cast("long").alias("rx"),
            vector(k * samples, re_off).alias("re"), vector(k * samples, im_off).alias("im"),
        ),
    )
    keys = [c for c in frames.columns if c != values]
    return frames.select(*keys, F.inline(cells))


def separate_tx(cube: DataFrame, tx: int, rx: int) -> DataFrame:
    """Interleaved chirps of several transmitters to virtual antennas: vant, chirp per transmitter."""
    chirp = F.col("chirp")
    return cube.withColumns({
        "vant": ((chirp % tx) * rx + F.col("rx")).cast("long"), "chirp": F.floor(chirp / tx).cast("long"),
    }).drop("rx", "tx")


def virtual_antennas(cube: DataFrame, rx: int) -> DataFrame:
    """(chirp, tx, rx) rows of a decoded payload to (chirp, vant)."""
    return cube.withColumn("vant", (F.col("tx") * rx + F.col("rx")).cast("long")).drop("tx", "rx")


def corner_turn(cube: DataFrame, keys: Sequence[str], numbered: bool = False) -> DataFrame:
    """Rows per (chirp, vant) with sample arrays to rows per (vant, range_bin) with chirp arrays.

    One shuffle of whole arrays on (keys, vant); the bounded chirp x sample block of one
    antenna is transposed inside the row. ``numbered`` keeps the chirps' numbers beside the arrays as ``chirp``.
    """
    block = F.array_sort(F.collect_list(F.struct("chirp", "re", "im")))
    names = [F.col("_b.chirp").alias("chirp")] if numbered else []
    turned = cube.groupBy(*keys, "vant").agg(block.alias("_b")).select(
        *keys, "vant", *names, F.col("_b.re").alias("_re"), F.col("_b.im").alias("_im")
    )
    take = lambda field, s: F.transform(F.col(field), lambda row: F.element_at(row, (s + 1).cast("int")))
    cells = F.transform(
        F.sequence(F.lit(0), F.size(F.col("_re")[0]) - 1),
        lambda s: F.struct(s.cast("long").alias("range_bin"), take("_re", s).alias("re"), take("_im", s).alias("im")),
    )
    return turned.select(*keys, "vant", *(["chirp"] if numbered else []), F.inline(cells))


def on_grid(rcube: DataFrame, chirps: int) -> DataFrame:
    """Numbered chirp arrays (``chirp``, re, im) as arrays over all ``chirps`` of a frame; a chirp that was not recorded is 0."""

    def run(chirp: pa.Array, re: pa.Array, im: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(chirp)), np.diff(chirp.offsets.to_numpy()))
        at = (row, chirp.flatten().to_numpy(zero_copy_only=False))
        parts = [_pack(place((len(chirp), chirps), at, x.flatten().to_numpy(zero_copy_only=False))) for x in (re, im)]
        return pa.StructArray.from_arrays(parts, names=["re", "im"])

    keys = [c for c in rcube.columns if c not in ("chirp", "re", "im")]
    grid = rcube.withColumn("_z", F.arrow_udf(run, returnType=COMPLEX_VECTOR)("chirp", "re", "im"))
    return grid.select(*keys, F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def long_form(df: DataFrame, axis: str) -> DataFrame:
    """Array rows (re, im) to one row per element along ``axis``."""
    keys = [c for c in df.columns if c not in ("re", "im")]
    return df.select(*keys, F.posexplode(F.arrays_zip("re", "im")).alias(axis, "z")).select(
        *keys, F.col(axis).cast("long").alias(axis), F.col("z.re").alias("re"), F.col("z.im").alias("im")
    )
