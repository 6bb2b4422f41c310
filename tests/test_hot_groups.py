"""Slicing a hot group gives the same rows as the plain window."""

import pytest
from pyspark.sql import functions as F

from rangelake.operators import cfar as cf
from rangelake.operators import passive as pv
from rangelake.operators import telemetry as tm
from rangelake.operators import timealign as ta
from rangelake.operators import tracking as tk
from rangelake.operators.ordered import carry_last, running_sums, with_cells, with_position
from rangelake.sources import adapters as ad

SMALL = 7


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def same(make):
    a, b = rows(make(None)), rows(make(SMALL))
    assert a and a == b


@pytest.fixture(scope="module")
def skewed(spark, sf):
    """A third of all rows under one key, order values clustered."""
    s = ad.signal(spark, sf)
    return s.withColumn("part", F.when(F.col("ord") % 3 == 0, F.lit(-1)).otherwise(F.col("part"))).withColumn(
        "ord", F.col("ord") + F.when(F.col("ord") > 700, 100000).otherwise(0)
    )


def test_cells_split_a_hot_group(skewed):
    cells = with_cells(skewed, ["part"], ["ord"], SMALL).filter("part = -1")
    assert cells.select("_cell").distinct().count() > 5


def test_position(skewed):
    same(lambda limit: with_position(skewed, ["part"], ["ord"], limit))


@pytest.mark.parametrize("kind", ["ca", "caso", "cago", "os"])
@pytest.mark.parametrize("mode", ["wrap", "constant"])
def test_cfar(skewed, kind, mode):
    same(lambda limit: cf.cfar(skewed, ["part"], ["ord"], "v", kind, 1, 3, 20, mode, k=3, limit=limit))


def test_running_and_carry(skewed):
    same(lambda limit: running_sums(skewed, ["part"], ["ord"], {"total": F.col("v"), "odd": F.when(F.col("v") % 2 == 1, 1)}, limit))
    value = F.when(F.col("v") % 5 == 0, F.col("v"))
    for forward in (True, False):
        same(lambda limit: carry_last(skewed, ["part"], ["ord"], {"x": value}, forward, limit))


def test_shift(skewed):
    for steps in (3, -2):
        same(lambda limit: pv.shift_signal(skewed.withColumn("w", F.col("v").cast("double")), ["part"], ["ord"], steps, ["w"], limit))


def test_asof(spark, sf):
    key = lambda df: df.withColumn("sensor", F.when(F.col("frame_no") % 3 == 0, F.lit(-1)).otherwise(F.col("sensor"))).drop("value")
    a, b = key(ad.sensor_a(spark, sf)), key(ad.sensor_b(spark, sf))
    same(lambda limit: ta.asof_nearest(a, b, ["sensor"], limit=limit))
    same(lambda limit: ta.asof_backward(a, b, ["sensor"], limit=limit))
    same(lambda limit: ta.seek(a, ["sensor"], percent=40, limit=limit))


def test_telemetry(spark, sf):
    log = ad.telemetry_log(spark, sf)
    same(lambda limit: tm.frame_drops(log, ["stream"], limit=limit))
    same(lambda limit: tm.avg_runtime(log, ["stream"], ["seq"], F.col("seq").cast("double"), 10, limit))
    same(lambda limit: tm.cumulative_runtime(log, ["stream"], ["seq"], F.col("seq"), limit))
    control = ad.control_log(spark, sf)
    rounded = lambda limit: tm.timeline(control, ["session"], limit).withColumn("position", F.round("position", 2))
    same(rounded)
    same(lambda limit: tm.detect_seeks(rounded(None), ["session"], limit))


def test_sessions(spark):
    pts = spark.createDataFrame([(1, f) for f in [*range(40), *range(60, 80), *range(200, 230)]], "sensor long, frame_no long")
    same(lambda limit: tk.with_sessions(pts, ["sensor"], 6, limit))
    assert tk.with_sessions(pts, ["sensor"], 6).select("session").distinct().count() == 3


@pytest.mark.parametrize("kind", ["string", "date", "far", "nan", "equal"])
def test_any_order(spark, kind):
    """Strings, dates, one far value, NaN and NULL, equal values; a NULL key is a group."""
    key = {
        "string": F.format_string("k%03d", "id"), "date": F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")), "far": F.when(F.col("id") == 5, 1e18).otherwise(F.col("id").cast("double")),
        "nan": F.when(F.col("id") % 9 == 0, float("nan")).when(F.col("id") % 7 != 0, F.col("id").cast("double")), "equal": F.col("id") * 0,
    }[kind]
    df = spark.range(120).select(F.when(F.col("id") % 2 == 0, F.lit(1)).alias("g"), key.alias("o"), (-F.col("id")).alias("tie"), (F.col("id") % 5).alias("v"))
    cells = with_cells(df, ["g"], ["o", "tie"], 32)
    assert cells.groupBy("g", "_cell").count().agg(F.max("count")).first()[0] < 40
    same(lambda limit: with_position(df, ["g"], ["o", "tie"], limit))
    same(lambda limit: running_sums(df, ["g"], ["o", "tie"], {"total": F.col("v")}, limit))
    same(lambda limit: carry_last(df, ["g"], ["o", "tie"], {"x": F.when(F.col("v") == 3, F.col("tie"))}, True, limit))


def scans(df) -> int:
    """Leaves of the optimised plan."""
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_chains_read_their_rows_twice_at_most(spark, sf, skewed):
    """Rows and summaries come from one stored cut, however many values a plan carries."""
    log, control = ad.telemetry_log(spark, sf), ad.control_log(spark, sf)
    a, b = ad.sensor_a(spark, sf).drop("value"), ad.sensor_b(spark, sf).drop("value")
    line = tm.timeline(control, ["session"])
    plans = [line, tm.detect_seeks(line, ["session"]), tm.frame_drops(log, ["stream"]), ta.asof_nearest(a, b, ["sensor"]), ta.fuse_latest(a, b, b, ["sensor"]), cf.cfar(skewed, ["part"], ["ord"], "v", "ca", 1, 3, 20)]
    assert [scans(p) for p in plans] == [2] * len(plans)


def test_fuse_latest(spark, sf):
    a, b = ad.sensor_a(spark, sf).drop("value"), ad.sensor_b(spark, sf).drop("value")
    same(lambda limit: ta.fuse_latest(a, b, a, ["sensor"], limit=limit))
