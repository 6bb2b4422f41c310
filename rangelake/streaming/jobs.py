"""Structured Streaming jobs over frame, point and telemetry streams.

The replayed recordings have no late data; watermarks are added here only because
Spark needs them to drop state.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rangelake.operators.ordered import Cells
from rangelake.session import cut_lineage


def latest_only(batch: DataFrame, by: Sequence[str], seq: str = "seq") -> DataFrame:
    """Newest row per key of one micro-batch and the number of rows it replaced (``dropped``)."""
    row = F.struct(*[c for c in batch.columns if c not in by])
    return batch.groupBy(*by).agg(F.max_by(row, seq).alias("_r"), (F.count(F.lit(1)) - 1).alias("dropped")).select(*by, "_r.*", "dropped")


def hand_off_latest(stream: DataFrame, by: Sequence[str], sink: Callable[[DataFrame, int], None], seq: str = "seq"):
    """Write only the newest row per key of each micro-batch. Returns the unstarted writer."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: sink(latest_only(batch, by, seq), epoch))


def _keyed(stream: DataFrame, key: str, fn, output: str, state: str, mode: str = "append") -> DataFrame:
    return stream.groupBy(key).applyInPandasWithState(fn, output, state, mode, GroupStateTimeout.NoTimeout)


def _fill(starts: list[int], ends: list[int], number: int) -> int:
    """Take a late number out of the open gaps (sorted, ends inclusive); 1 if it was missing, 0 if it had come before."""
    k = bisect.bisect_right(starts, number) - 1
    if k < 0 or ends[k] < number:
        return 0
    low, high = starts[k], ends[k]
    left, right = ([low], [number - 1]) if low < number else ([], []), ([number + 1], [high]) if number < high else ([], [])
    starts[k : k + 1], ends[k : k + 1] = left[0] + right[0], left[1] + right[1]
    return 1


def gap_counter(stream: DataFrame, key: str = "stream", seq: str = "seq") -> DataFrame:
    """Missing sequence numbers on a live stream: key, seq, missed, missed_total per row.

    ``missed_total`` are the numbers missing so far: a late number that fills a gap takes one off, a repeated one
    changes nothing. State: the largest number, the total, and the open gaps of each key (two vectors in bytes: there may be millions).
    """

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total, *gaps = state.get if state.exists else (None, 0, b"", b"")
        starts, ends = (np.frombuffer(g, np.int64) for g in gaps)
        seqs = np.sort(np.concatenate([f[seq].to_numpy() for f in frames]))
        cut = 0 if last is None else int(np.searchsorted(seqs, last, "right"))
        late: list[int] = []
        if cut:
            starts, ends = starts.tolist(), ends.tolist()
            late = [_fill(starts, ends, int(x)) for x in seqs[:cut]]
        fresh = seqs[cut:]
        before = np.concatenate([[fresh[0] - 1 if last is None else last], fresh[:-1]]) if len(fresh) else fresh
        skipped = np.maximum(fresh - before - 1, 0)
        gaps = skipped > 0
        starts, ends = (np.concatenate([np.asarray(a, np.int64), b]) for a, b in ((starts, before[gaps] + 1), (ends, fresh[gaps] - 1)))
        missed = np.concatenate([np.zeros(cut, np.int64), skipped])
        totals = total + np.cumsum(np.concatenate([-np.array(late, np.int64), skipped]))
        state.update((int(seqs[-1]) if len(fresh) else last, int(totals[-1]), starts.astype(np.int64).tobytes(), ends.astype(np.int64).tobytes()))
        for low in range(0, len(seqs), 100_000):
            part = slice(low, low + 100_000)
            yield pd.DataFrame({key: k[0], seq: seqs[part], "missed": missed[part], "missed_total": totals[part]})

    kind = stream.schema[key].dataType.simpleString()
    return _keyed(stream, key, step, f"{key} {kind}, {seq} long, missed long, missed_total long", "last long, total long, starts binary, ends binary")


def dc_calibration(stream: DataFrame, key: str, n_frames: int, n_range: int, positive: int | None = None, negative: int = 0) -> DataFrame:
    """Subtract the mean of the first ``n_frames`` frames of each key from the later ones.

    Rows: key, frame_no, chirp, vant, re, im (arrays over range). With ``positive`` only bins 0..positive and the last
    ``negative`` bins are touched. State: sums per chirp parity and the numbers of the calibrating frames, so its size is fixed;
    a frame may come in several micro-batches.
    """
    touched = np.ones(n_range, bool) if positive is None else (np.arange(n_range) <= positive) | (np.arange(n_range) >= n_range - negative)

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            first, rows, sums = state.get
            first, rows, sums = list(first), np.array(rows, float), np.array(sums, float).reshape(2, 2, n_range)
        else:
            first, rows, sums = [], np.zeros(2), np.zeros((2, 2, n_range))
        out = []
        for pdf in frames:
            for number, frame in pdf.groupby("frame_no", sort=True):
                parity = (frame["chirp"] % 2).to_numpy()
                parts = np.stack([np.stack(frame[c].to_list()) for c in ("re", "im")], axis=1)
                if number not in first and len(first) < n_frames:
                    first.append(int(number))
                if number in first:
                    for p in (0, 1):
                        rows[p] += (parity == p).sum()
                        sums[p] += parts[parity == p].sum(axis=0)
                else:
                    out.append((frame, parity, parts))
        state.update((first, rows.tolist(), sums.ravel().tolist()))
        # what was calibrated with is known once the batch's own calibrating rows are in
        mean = sums / np.maximum(rows, 1)[:, None, None] * touched
        for frame, parity, parts in out:
            clean = parts - mean[parity]
            yield frame.assign(re=list(clean[:, 0]), im=list(clean[:, 1]))[[key, "frame_no", "chirp", "vant", "re", "im"]]

    kind = stream.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, frame_no long, chirp long, vant long, re array<double>, im array<double>"
    return _keyed(stream, key, step, schema, "first array<long>, rows array<double>, sums array<double>")


def recording_spans(control_log: DataFrame, by: Sequence[str]) -> DataFrame:
    """On-spans of a command table: by, on_ts, off_ts (NULL while still on)."""
    cut = Cells(control_log, by, ["ts", "seq"])
    spans = cut.finish(cut.neighbour({"off_ts": "ts"}, -1))
    return spans.filter(F.col("command") == "on").select(*by, F.col("ts").alias("on_ts"), "off_ts")


def recording_gate(frames: DataFrame, spans: DataFrame, by: Sequence[str], bucket_s: float = 60.0) -> DataFrame:
    """Stream frames that fall into an on-span of a static table (stream-static join).

    A span is cut into buckets about as long as itself: ``bucket_s`` seconds times a power of 16, its level. So it has a few pieces
    however long it is, and a frame meets, at each level there is, the few spans of its own bucket, and the one that is still open.
    NULL keys match.
    """
    by, fan = list(by), 16.0
    s = spans.filter(F.col("off_ts").isNull() | (F.col("off_ts") > F.col("on_ts")))
    s = s.withColumn("_level", F.ceil(F.log(fan, (F.col("off_ts") - F.col("on_ts")) / bucket_s)).cast("int"))
    at = lambda c: F.floor(F.col(c) / (F.pow(F.lit(fan), F.col("_level")) * bucket_s))
    zero = F.array(F.lit(0).cast("long"))
    s = s.withColumn("_bucket", F.explode(F.when(F.col("off_ts").isNull(), zero).otherwise(F.sequence(at("on_ts"), at("off_ts")))))
    s = cut_lineage(s.select(*by, "on_ts", "off_ts", "_level", "_bucket"))
    levels = [r[0] for r in s.select("_level").distinct().collect()]
    s = s.withColumnsRenamed({c: f"_s_{c}" for c in (*by, "_level", "_bucket")})
    cond = (F.col("ts") >= F.col("on_ts")) & (F.col("off_ts").isNull() | (F.col("ts") < F.col("off_ts")))
    for c in (*by, "_level"):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    own = lambda n: F.lit(0).cast("long") if n is None else F.floor(F.col("ts") / (fan**n * bucket_s))
    places = [F.struct(F.lit(n).cast("int").alias("level"), own(n).alias("bucket")) for n in levels]
    places = F.array(*places) if places else F.array().cast("array<struct<level:int,bucket:bigint>>")
    asked = frames.withColumn("_at", F.explode(places)).withColumns({"_level": F.col("_at.level"), "_bucket": F.col("_at.bucket")}).drop("_at")
    met = asked.join(s, cond & (F.col("_bucket") == F.col("_s__bucket")))
    return met.drop(*[f"_s_{c}" for c in (*by, "_level", "_bucket")], "_level", "_bucket", "on_ts", "off_ts")


def fuse_streams(
    radar: DataFrame, camera: DataFrame, by: str, time: str = "event_time", max_gap: str = "1 second", delay: str = "2 seconds"
) -> DataFrame:
    """Each radar row with the latest camera row at most ``max_gap`` older.

    An interval join with watermarks on both sides bounds the state; the latest partner is
    then taken per radar row.
    """
    r = radar.withWatermark(time, delay)
    c = camera.select(F.col(by).alias("_by"), F.col(time).alias("_time"), F.struct(*[x for x in camera.columns if x != by]).alias("camera")).withWatermark("_time", delay)
    gap = F.expr(f"interval {max_gap}")
    pairs = r.join(c, (F.col(by) == F.col("_by")) & (F.col("_time") <= F.col(time)) & (F.col("_time") >= F.col(time) - gap))
    keep = [x for x in radar.columns if x not in (by, time)]
    return pairs.groupBy(by, time, *keep).agg(F.max_by("camera", "_time").alias("camera"))


def rate_windows(stream: DataFrame, by: str, time: str = "event_time", length: str = "1 second", slide: str | None = None, delay: str = "2 seconds") -> DataFrame:
    """Frames per window: sliding when ``slide`` is given, else tumbling."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, delay).groupBy(window, by).agg(F.count(F.lit(1)).alias("frames")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "frames"
    )


def runtime_windows(stream: DataFrame, by: str, value: Column, time: str = "event_time", length: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """Mean runtime per tumbling window."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, length), by).agg(
        F.avg(value).alias("avg_runtime"), F.count(F.lit(1)).alias("frames")
    ).select(F.col("window.start").alias("start"), by, "avg_runtime", "frames")
