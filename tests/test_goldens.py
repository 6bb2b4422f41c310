"""Published example values of the detectors."""

import pytest
from pyspark.sql import functions as F

from rangelake.operators import cfar as cf
from rangelake.operators import peaks as pk

SIGNAL = [41, 76, 95, 28, 25, 53, 10, 93, 54, 85]
# Noise floors of the examples.
FLOORS = [
    ("ca", "wrap", 1, 3, [50, 56, 44, 59, 61, 71, 54, 51, 50, 59]),
    ("ca", "constant", 1, 3, [24, 17, 21, 45, 61, 71, 47, 31, 14, 26]),
    ("caso", "wrap", 1, 3, [49, 35, 29, 52, 52, 66, 49, 35, 29, 52]),
    ("caso", "constant", 1, 3, [49, 35, 29, 52, 52, 66, 49, 35, 29, 52]),
    ("cago", "wrap", 1, 3, [52, 77, 60, 67, 70, 77, 60, 67, 70, 66]),
    ("cago", "constant", 1, 3, [49, 35, 29, 52, 70, 77, 49, 35, 29, 52]),
    ("os", "wrap", 0, 3, [85, 54, 53, 53, 76, 54, 54, 53, 76, 76]),
]


@pytest.mark.parametrize("kind,mode,guard,noise,want", FLOORS)
def test_noise_floor(spark, kind, mode, guard, noise, want):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(SIGNAL)], "part long, ord long, v long")
    out = cf.cfar(df, ["part"], ["ord"], "v", kind, guard, noise, 20, mode, True, k=3, scale=1.1)
    got = [int(r.noise_floor) for r in out.orderBy("ord").collect()]
    assert got == want


def test_short_signal_wraps_more_than_once(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 2, 4])], "part long, ord long, v long")
    out = cf.cfar(df, ["part"], ["ord"], "v", "ca", 1, 3, 0).orderBy("ord").collect()
    n = [1, 2, 4]
    want = [sum(n[(i + s * d) % 3] for s in (-1, 1) for d in (2, 3, 4)) / 6 for i in range(3)]
    assert [r.noise_floor for r in out] == pytest.approx(want)


@pytest.mark.parametrize("neighbor,want", [(False, [5]), (True, [5, 3])])
def test_local_peak_is_circular(spark, neighbor, want):
    values = [2, 1, 5, 3, 2]
    rd = spark.createDataFrame([(0, 0, i, v) for i, v in enumerate(values)], "map long, range_bin long, doppler_bin long, value long")
    det = rd.withColumnRenamed("value", "peak_val")
    got = pk.prune_to_peaks(det, rd, ["map"], 5, neighbor).orderBy("doppler_bin").collect()
    assert [r.peak_val for r in got] == want


def test_unknown_arguments(spark):
    df = spark.createDataFrame([(0, 0, 1)], "part long, ord long, v long")
    with pytest.raises(ValueError):
        cf.cfar(df, ["part"], ["ord"], "v", "median")
    with pytest.raises(ValueError):
        cf.cfar(df, ["part"], ["ord"], "v", mode="mirror")


def test_box_window_counts_only_cells_inside(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.random((9, 11))
    df = spark.createDataFrame([(0, i, j, float(m[i, j])) for i in range(9) for j in range(11)], "map long, r long, d long, v double")
    out = cf.cfar_2d(df, ["map"], "r", "d", F.col("v") * F.col("v"), [3, 2, 1, 1], 3.0).collect()
    p = m**2
    for row in out:
        cells = [
            p[i, j] for i in range(9) for j in range(11)
            if abs(i - row.r) <= 2 and abs(j - row.d) <= 3 and not (abs(i - row.r) <= 1 and abs(j - row.d) <= 1)
        ]
        assert row.noise_power == pytest.approx(np.mean(cells))
        assert row.hit == (p[row.r, row.d] / np.mean(cells) > 10**0.3)
