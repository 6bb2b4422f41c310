"""Playback timeline, sequence gaps, latency and rate over telemetry logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangelake.operators.ordered import ROWS_PER_TASK, Cells, running_sums, with_position


def frame_drops(events: DataFrame, by: Sequence[str], seq: str = "seq", limit: int | None = ROWS_PER_TASK) -> DataFrame:
    """Add ``missed`` (sequence numbers skipped before a row) and ``missed_total``."""
    skipped = lambda before, now: F.greatest(F.lit(0), F.coalesce(now - before - 1, F.lit(0)))
    cut = Cells(events, by, [seq], limit)
    rows = cut.rows.withColumn("_inside", skipped(F.lag(seq).over(cut.window), F.col(seq)))
    cells = cut.summary(rows, _sum=F.sum("_inside"), _low=F.min_by(seq, "_seq"), _high=F.max_by(seq, "_seq"), _first=F.min("_seq"))
    cells = cells.withColumn("_border", skipped(F.lag("_high").over(cut.cells), F.col("_low")))
    base = F.coalesce(F.sum(F.col("_sum") + F.col("_border")).over(cut.before), F.lit(0)) + F.col("_border")
    joined = rows.join(cells.select("_cell", "_first", "_border", base.alias("_base")), "_cell")
    return cut.finish(joined.withColumns({
        "missed": F.when(F.col("_seq") == F.col("_first"), F.col("_border")).otherwise(F.col("_inside")),
        "missed_total": F.col("_base") + F.sum("_inside").over(cut.so_far),
    })).drop("_inside", "_first", "_border", "_base")


def stage_latency(events: DataFrame) -> DataFrame:
    """Milliseconds spent in each stage, only where every clock is set."""
    clocks = ["capture_ns", "enqueue_ns", "recv_ns", "end_ns", "main_ns", "display_ns"]
    valid = F.lit(True)
    for c in clocks:
        valid = valid & (F.col(c) > 0)
    ms = lambda a, b: (F.col(b) - F.col(a)) / 1e6
    return events.filter(valid).withColumns({
        "e2e_ms": ms("capture_ns", "display_ns"),
        "capture_to_queue_ms": ms("capture_ns", "enqueue_ns"),
        "queue_to_analyser_ms": ms("enqueue_ns", "recv_ns"),
        "analyse_ms": ms("recv_ns", "end_ns"),
        "analyser_to_main_ms": ms("end_ns", "main_ns"),
        "main_to_display_ms": ms("main_ns", "display_ns"),
    })


def latency_summary(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, mean, median, 99th percentile and maximum of the end-to-end latency.

    Percentiles use the mergeable sketch, so nothing is gathered per stream.
    """
    e2e = F.col("e2e_ms")
    return stage_latency(events).groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"),
        F.avg(e2e).alias("mean_ms"),
        F.percentile_approx(e2e, 0.5, 100_000).alias("p50_ms"),
        F.percentile_approx(e2e, 0.99, 100_000).alias("p99_ms"),
        F.max(e2e).alias("max_ms"),
    )


def rolling_fps(
    events: DataFrame, by: Sequence[str], micros: Column, window_s: float = 1.0, slice_windows: int = 64
) -> DataFrame:
    """Add ``fps``: rows in the trailing window per second.

    Time is cut into slices of ``slice_windows`` windows; a row also visits the next
    slice if that slice's first window still reaches it. One slice is one task unit,
    so a long or hot stream spreads over many tasks.
    """
    window = int(window_s * 1e6)
    width = window * slice_windows
    stamped = events.withColumn("_us", micros)
    own = F.expr(f"_us div {width}")
    copies = stamped.withColumn(
        "_slice", F.explode(F.sequence(own, F.expr(f"(_us + {window}) div {width}")))
    ).withColumn("_own", F.col("_slice") == own)
    w = Window.partitionBy(*by, "_slice").orderBy("_us").rangeBetween(-window, 0)
    return (
        copies.withColumn("fps", F.count(F.lit(1)).over(w) / F.lit(window_s)).filter("_own").drop("_us", "_slice", "_own")
    )


def avg_runtime(
    events: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, n: int = 150, limit: int | None = ROWS_PER_TASK
) -> DataFrame:
    """Mean of ``value`` over every full block of ``n`` rows: by, block, avg_runtime."""
    placed = with_position(events.withColumn("_value", value), by, order, limit)
    return (
        placed.groupBy(*by, F.expr(f"_pos div {n}").alias("block"))
        .agg(F.avg("_value").alias("avg_runtime"), F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") == n)
        .drop("_rows")
    )


def cumulative_runtime(
    events: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, limit: int | None = ROWS_PER_TASK
) -> DataFrame:
    """Add ``cumulative_avg``: mean of ``value`` from the first row to each row."""
    sums = running_sums(events, by, order, {"_sum": value.cast("double"), "_rows": F.lit(1)}, limit)
    return sums.withColumn("cumulative_avg", F.col("_sum") / F.col("_rows")).drop("_sum", "_rows")


def timeline(log: DataFrame, by: Sequence[str], limit: int | None = ROWS_PER_TASK) -> DataFrame:
    """Timeline position after each command of a playback log (wall, seq, command, arg).

    Position advances by elapsed wall time x speed while playing, jumps on ``seek``
    and returns to 0 on ``stop``.
    """
    cmd = F.col("command")
    cut = Cells(log, by, ["wall", "seq"], limit)
    rows = cut.rows.withColumns({
        "_on": F.last(F.when(cmd == "play", 1.0).when(cmd.isin("pause", "stop"), 0.0), ignorenulls=True).over(cut.so_far),
        "_speed": F.last(F.when(cmd == "speed", F.col("arg").cast("double")), ignorenulls=True).over(cut.so_far),
    })
    # time passed since the row before, by what is known of switch and speed then; what the cell began with is not known yet
    passed = F.coalesce(F.col("wall") - F.lag("wall").over(cut.window), F.lit(0.0))
    on, speed = F.lag("_on").over(cut.window), F.lag("_speed").over(cut.window)
    rows = rows.withColumns({
        "_known": F.coalesce(passed * on * speed, F.lit(0.0)), "_by_on": F.when(on.isNull(), F.coalesce(passed * speed, F.lit(0.0))).otherwise(0.0),
        "_by_speed": F.when(speed.isNull(), F.coalesce(passed * on, F.lit(0.0))).otherwise(0.0), "_by_both": F.when(on.isNull() & speed.isNull(), passed).otherwise(0.0),
    })
    parts = ["_known", "_by_on", "_by_speed", "_by_both"]
    rows = rows.withColumns({c: F.sum(c).over(cut.so_far) for c in parts})
    to = F.when(cmd == "seek", F.col("arg").cast("double")).when(cmd == "stop", F.lit(0.0))
    rows = rows.withColumn("_jump", F.last(F.when(to.isNotNull(), F.struct(to.alias("to"), *parts)), ignorenulls=True).over(cut.so_far))

    def run(row: Column | None = None) -> Column:
        """Time on the line from the start of the cell to a row, for the switch and speed that the cell began with."""
        a, b, c, d = (F.col(p) if row is None else row[p] for p in parts)
        return a + b * F.col("_on0") + c * F.col("_speed0") + d * F.col("_on0") * F.col("_speed0")

    end = F.max_by(F.struct("wall", "_on", "_speed", "_jump", *parts), "_seq")
    cells = cut.summary(rows, _end=end, _start=F.min_by("wall", "_seq"))
    cells = cells.select("_cell", "_start", "_end.*").withColumns({
        "_on0": F.coalesce(F.last("_on", ignorenulls=True).over(cut.before), F.lit(0.0)),
        "_speed0": F.coalesce(F.last("_speed", ignorenulls=True).over(cut.before), F.lit(1.0)),
    })
    cells = cells.withColumn("_gap", F.coalesce((F.col("_start") - F.lag("wall").over(cut.cells)) * F.col("_on0") * F.col("_speed0"), F.lit(0.0)))
    cells = cells.withColumn("_run0", F.coalesce(F.sum(F.col("_gap") + run()).over(cut.before), F.lit(0.0)) + F.col("_gap"))
    cells = cells.withColumn("_base", F.col("_jump.to") - F.col("_run0") - run(F.col("_jump")))
    cells = cells.withColumn("_base0", F.coalesce(F.last("_base", ignorenulls=True).over(cut.before), F.lit(0.0)))
    carried = ["_on0", "_speed0", "_run0", "_base0"]
    out = rows.join(cells.select("_cell", *carried), "_cell")
    base = F.coalesce(F.col("_jump.to") - F.col("_run0") - run(F.col("_jump")), F.col("_base0"))
    return cut.finish(out.withColumns({
        "speed": F.coalesce("_speed", "_speed0"), "playing": F.coalesce("_on", "_on0") > 0, "position": base + F.col("_run0") + run(),
    })).drop("_on", "_speed", "_jump", *parts, *carried)


def detect_seeks(line: DataFrame, by: Sequence[str], limit: int | None = ROWS_PER_TASK) -> DataFrame:
    """Rows where the position moved back by > 0.05 s, jumped by > 0.5 s, or is 0."""
    cut = Cells(line, by, ["wall", "seq"], limit)
    prev = cut.finish(cut.neighbour({"prev_position": "position"}))
    p, q = F.col("position"), F.col("prev_position")
    return prev.filter((p < q - 0.05) | (F.abs(p - q) > 0.5) | (p == 0))


def robust_levels(cells: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Colour limits per map: 1st and 99th percentile of finite values, else min and max,
    else one unit apart. A map has a fixed number of cells, so exact percentiles are bounded."""
    v = F.col(value).cast("double")
    finite = cells.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    agg = finite.groupBy(*by).agg(
        F.percentile(v, 0.01).alias("_p1"), F.percentile(v, 0.99).alias("_p99"), F.min(v).alias("_lo"), F.max(v).alias("_hi")
    )
    spread = F.col("_p1") < F.col("_p99")
    low = F.when(spread, F.col("_p1")).otherwise(F.col("_lo"))
    high = F.when(spread, F.col("_p99")).when(F.col("_lo") < F.col("_hi"), F.col("_hi")).otherwise(F.col("_lo") + 1.0)
    return agg.select(*by, low.alias("level_min"), high.alias("level_max"))


def recording_summary(frames: DataFrame, by: Sequence[str], ts: str = "ts", at: Column | None = None) -> DataFrame:
    """Frame count, first and last timestamp, duration, mean rate, progress at ``at``."""
    done = F.sum(F.when(F.col(ts) < at, 1).otherwise(0)) if at is not None else F.lit(0)
    agg = frames.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), done.alias("_done")
    )
    length = F.col("last_ts") - F.col("first_ts")
    return agg.withColumns({
        "duration": length,
        "rate": F.when(length > 0, (F.col("frames") - 1) / length),
        "progress_percent": F.col("_done") / F.col("frames") * 100,
    }).drop("_done")
