"""Time alignment of sensor streams: as-of joins, common start, seeking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangelake.operators.ordered import ROWS_PER_TASK, Cells, join_keys, with_position


def common_start(a: DataFrame, b: DataFrame, by: Sequence[str], ts: str = "ts") -> DataFrame:
    """Later of the two first timestamps; the only one present when a stream is missing."""
    first = lambda df, name: df.groupBy(*by).agg(F.min(ts).alias(name))
    both = first(a, "start_a").join(first(b, "start_b"), list(by), "full_outer")
    return both.withColumn("start_ts", F.greatest("start_a", "start_b"))


#: Sides of the common axis: a right row as one that came before, a left row, a right row as one that comes after.
_BEFORE, _LEFT, _AFTER = range(3)


def _line(left: DataFrame, rights: Sequence[DataFrame], by: Sequence[str], ts: str, rid: str, after: bool = False) -> DataFrame:
    """All sides on one axis; right rows travel as structs (``_right0``, ...), and once more as rows to come with ``after``."""
    out = left.withColumns({"_side": F.lit(_LEFT), "_id": F.lit(None).cast("long")})
    for k, right in enumerate(rights):
        row = F.struct(F.col(ts).alias("_at"), *[F.col(c) for c in right.columns if c not in (*by, ts)])
        number = F.col(rid).cast("long")
        sides = [F.struct(F.lit(_BEFORE).alias("_side"), (-number).alias("_id"))] + ([F.struct(F.lit(_AFTER).alias("_side"), number.alias("_id"))] if after else [])
        rows = right.select(*by, F.col(ts), row.alias(f"_right{k}"), F.explode(F.array(*sides)).alias("_as"))
        out = out.unionByName(rows.select(*by, ts, f"_right{k}", "_as.*"), allowMissingColumns=True)
    return out


def _cut(line: DataFrame, by: Sequence[str], ts: str, limit: int | None) -> Cells:
    return Cells(line, by, [ts, "_side", "_id"], limit)


def _came(k: int = 0, side: int = _BEFORE) -> Column:
    return F.when(F.col("_side") == side, F.col(f"_right{k}"))


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    ts: str = "ts",
    rid: str = "frame_no",
    prefix: str = "r_",
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Latest right row at or before each left row; equal times take the smaller id."""
    out = _cut(_line(left, [right], by, ts, rid), by, ts, limit).carry({"_hit": _came()})
    return _unpack(out.filter(F.col("_side") == _LEFT), left, [(right, "_hit", prefix)], by, ts)


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    tolerance: float | None = None,
    ts: str = "ts",
    rid: str = "frame_no",
    prefix: str = "r_",
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Right row with the smallest time distance; a tie takes the earlier row.

    Beyond ``tolerance`` the right columns are NULL.
    """
    line = _line(left, [right], by, ts, rid, after=True)
    both = _cut(line, by, ts, limit).carry({"_prev": _came()}, {"_next": _came(side=_AFTER)})
    before = F.col(ts) - F.col("_prev._at")
    after = F.col("_next._at") - F.col(ts)
    hit = F.when(F.col("_next").isNull() | (before <= after), F.col("_prev")).otherwise(F.col("_next"))
    out = both.filter(F.col("_side") == _LEFT).withColumn("_hit", hit).drop("_prev", "_next")
    if tolerance is not None:
        out = out.withColumn("_hit", F.when(F.abs(F.col(ts) - F.col("_hit._at")) <= tolerance, F.col("_hit")))
    return _unpack(out, left, [(right, "_hit", prefix)], by, ts)


def _unpack(out: DataFrame, left: DataFrame, hits: Sequence[tuple[DataFrame, str, str]], by: Sequence[str], ts: str) -> DataFrame:
    return out.select(*left.columns, *[
        F.col(f"{hit}.{'_at' if c == ts else c}").alias(f"{prefix}{c}")
        for right, hit, prefix in hits for c in (ts, *(c for c in right.columns if c not in (*by, ts)))
    ])


def due_frames(ticks: DataFrame, frames: DataFrame, starts: DataFrame, by: Sequence[str], position: str) -> DataFrame:
    """Frame due at each timeline position: the latest with ts - start <= position.

    ``starts`` (one row per group: by, start_ts) shifts the frames onto the timeline.
    """
    shifted = join_keys(frames, starts.select(*by, "start_ts"), list(by)).withColumn(
        position, F.col("ts") - F.col("start_ts")
    ).drop("start_ts")
    return asof_backward(ticks, shifted, by, ts=position)


def fuse_latest(
    ticks: DataFrame, radar: DataFrame, camera: DataFrame, by: Sequence[str], ts: str = "ts", rid: str = "frame_no", limit: int | None = ROWS_PER_TASK
) -> DataFrame:
    """At each display tick the latest radar row and the latest camera row, carried along one axis together."""
    line = _line(ticks, [radar, camera], by, ts, rid)
    out = _cut(line, by, ts, limit).carry({"_radar": _came(0), "_camera": _came(1)})
    return _unpack(out.filter(F.col("_side") == _LEFT), ticks, [(radar, "_radar", "radar_"), (camera, "_camera", "camera_")], by, ts)


def seek(
    frames: DataFrame,
    by: Sequence[str],
    *,
    frame: int | None = None,
    percent: float | None = None,
    time: float | None = None,
    ts: str = "ts",
    rid: str = "frame_no",
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """The frame to resume from, by index, by percentage of the recording, or by time."""
    if sum(x is not None for x in (frame, percent, time)) != 1:
        raise ValueError("give exactly one of frame, percent, time")
    if time is not None:
        nearest = F.struct(F.abs(F.col(ts) - time).alias("d"), F.col(ts).alias("t"), F.col(rid).alias("i"))
        row = F.struct(*[c for c in frames.columns if c not in by])
        return frames.groupBy(*by).agg(F.min_by(row, nearest).alias("r")).select(*by, "r.*")
    if percent is not None and not 0 <= percent <= 100:
        raise ValueError(f"percent {percent} out of range [0, 100]")
    if frame is not None and frame < 0:
        raise ValueError(f"frame index {frame} out of range")
    placed = with_position(frames, by, [ts, rid], limit)
    target = F.lit(frame) if frame is not None else F.floor(F.lit(percent / 100.0) * (F.col("_n") - 1))
    return placed.filter(F.col("_pos") == target).drop("_pos", "_n")
