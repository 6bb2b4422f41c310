"""Logs of orders are written batch by batch, however the batches cut orders and logs."""

import pyarrow as pa

from rangelake.plans import source_adapters as sa
from rangelake.sources import tlv


def rows(*orders):
    """One part of an order after the other."""
    n = range(len(orders))
    place = lambda step: pa.array([step * k for k in n], pa.float64())
    cells = [pa.array(orders, pa.int64()), *(place(s) for s in (0.5, 1.0, 1.5, 2.0)), pa.array([k % 500 for k in n], pa.int64()), pa.array([k % 300 for k in n], pa.int64())]
    return pa.RecordBatch.from_arrays(cells, names=["no", "x", "y", "z", "v", "snr", "noise"])


def test_logs_do_not_depend_on_batches():
    whole = rows(0, 0, 1, 6, 63, 63, 63, 64, 64, 130, 191, 193, 193)
    want = pa.Table.from_batches(sa._logs(iter([whole]))).to_pylist()
    assert [r["capture"] for r in want] == [0, 1, 2, 3] and {r["start"] for r in want} == {0}
    assert all(r["own_bytes"] == len(r["content"]) and r["content"][:5] == bytes([2, 1, 4, 3, 4]) for r in want)
    found = [(head[2], head[4]) for r in want for _, head, _ in tlv._packets(r["content"], r["own_bytes"])]
    assert found == [(0, 2), (1, 1), (6, 1), (63, 3), (64, 2), (130, 1), (191, 1), (193, 2)]
    for size in (1, 2, 3, 5, 8):
        cut = [whole.slice(k, size) for k in range(0, len(whole), size)] + [whole.slice(0, 0)]
        assert pa.Table.from_batches(sa._logs(iter(cut))).to_pylist() == want
    assert list(sa._logs(iter([]))) == []


def test_logs_come_from_one_shuffle_and_no_arrays(spark, sf):
    plan = sa.tlv_logs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
