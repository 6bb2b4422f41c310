"""Prediction in a kernel: values of plain matrices, missing numbers, tracks that stand still, and a short plan."""

import numpy as np
import pytest

from rangelake.operators import tracking as tk

SCHEMA = "uid int, s array<double>, p array<double>, variance double"


def plain(s, p, variance, dt):
    power = np.array([[1, dt, dt * dt / 2], [0, 1, dt], [0, 0, 1]])
    f = np.kron(power, np.eye(2))
    g = np.kron([dt * dt / 2, dt, 1], np.eye(2).T.reshape(2, 2)).reshape(2, 6).T
    p = f @ np.reshape(p, (6, 6)) @ f.T + variance * g @ g.T
    return f @ s, (p + p.T) / 2


def test_prediction_values(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 2, 6).tolist(), rng.normal(0, 1, 36).tolist(), float(i % 3)) for i in range(12)]
    got = {r.uid: r for r in tk.predict(spark.createDataFrame(rows, SCHEMA), 0.5).collect()}
    for uid, s, p, variance in rows:
        want_s, want_p = plain(np.array(s), p, variance, 0.5) if variance else (s, np.reshape(p, (6, 6)))
        assert got[uid].s == pytest.approx(list(want_s)) and got[uid].p == pytest.approx(list(np.ravel(want_p)))
        assert got[uid].h[0] == pytest.approx(np.hypot(*want_s[:2]))


def test_missing_numbers_stay_missing(spark):
    one, cov = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [1.0] * 36
    rows = [(1, [1.0, None, 3.0, 4.0, 5.0, 6.0], cov, 1.0), (2, None, None, 1.0), (3, one, cov, None), (4, None, cov, 0.0), (5, one, [None, *cov[1:]], 1.0)]
    got = {r.uid: r for r in tk.predict(spark.createDataFrame(rows, SCHEMA), 1.0).collect()}
    assert got[1].s == [1.0 + 3.0 + 2.5, None, 8.0, 10.0, 5.0, 6.0]
    assert got[2].s == [None] * 6 and got[2].p == [None] * 36
    assert (got[3].s, got[3].p, got[4].s, got[4].p) == (one, cov, None, cov)
    assert [k for k, x in enumerate(got[5].p) if x is None] == [0] and None not in got[5].s


def test_prediction_is_a_short_plan(spark):
    out = tk.predict(spark.createDataFrame([], SCHEMA), 1.0)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 10_000
