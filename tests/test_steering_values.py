"""Phases are made once for each number of antennas, with the same values for every configuration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangelake.operators import angles as an


def test_steering_of_repeated_and_missing_numbers(spark):
    cfg = spark.createDataFrame([(1, 1, 3), (2, 3, 1), (2, 3, 1), (3, 2, 4), (4, None, 4), (None, 1, 2)], "config int, tx int, rx int")
    out = an.steering(cfg, 90, 10, F.col("tx") * F.col("rx"))
    assert out.columns == ["config", "tx", "rx", "angle_idx", "antenna", "s_re", "s_im"]
    rows = out.collect()
    count = lambda c: sum(r.config == c for r in rows) / 19
    assert [count(c) for c in (1, 2, 3, 4, None)] == [3, 6, 8, 0, 2]
    want = an.steering_matrix(90, 10, 8)
    for r in rows:
        assert complex(r.s_re, r.s_im) == pytest.approx(want[r.angle_idx, r.antenna], abs=1e-12)
    rounded = an.steering(cfg, 90, 10, F.col("tx") * F.col("rx"), digits=2).collect()
    assert {(r.s_re, r.s_im) for r in rounded} == {(np.round(r.s_re, 2) + 0.0, np.round(r.s_im, 2) + 0.0) for r in rows}


def test_phases_are_made_before_rows_multiply(spark):
    cfg = spark.range(40).select(F.col("id").alias("config"), (F.col("id") % 3 + 1).alias("n"))
    plan = an.steering(cfg, 90, 10, F.col("n"), digits=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and plan.index("Join") < plan.index("COS(")
