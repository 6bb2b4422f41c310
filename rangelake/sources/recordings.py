"""Radar and camera recordings: one file per frame, key in the file name."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangelake.operators.ordered import with_position
from rangelake.operators.timealign import asof_backward

# The frame file name.
NAME = r"(\d{10})_(\d{5})_(\d{12})"
NAME_FORMAT = "%010d_%05d_%012d"


def _split_path(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "recording": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1),
        "file_name": F.regexp_extract("path", r"([^/]+)$", 1),
    })


def parse_names(files: DataFrame, extension: str = "bin") -> DataFrame:
    """Strict names: recording, frame_no, ts (s) from ``path``; other files are left out."""
    whole = rf"^{NAME}\.{extension}$"
    named = _split_path(files).filter(F.col("file_name").rlike(whole))
    part = lambda i: F.regexp_extract("file_name", whole, i).cast("long")
    return named.withColumns({"ts": part(1) + part(2) / 1e5, "frame_no": part(3)}).drop("file_name")


def rejected_names(files: DataFrame, extension: str = "bin") -> DataFrame:
    """Paths the strict scan leaves out, for a warning or a quarantine table."""
    return _split_path(files).filter(~F.col("file_name").rlike(rf"^{NAME}\.{extension}$")).select("recording", "path")


def parse_names_lenient(files: DataFrame, extension: str = "png") -> DataFrame:
    """Names of at least three ``_``-separated parts whose first two are whole numbers; the third
    gives ``frame_no`` if it is a number. Other names are left out."""
    parts = _split_path(files).withColumn("_p", F.split(F.regexp_replace("file_name", rf"\.{extension}$", ""), "_")).filter(F.size("_p") >= 3)
    number = lambda i: F.expr(f"try_cast(_p[{i}] AS bigint)")
    out = parts.withColumns({"_s": number(0), "_f": number(1), "frame_no": number(2)})
    return out.filter(F.col("_s").isNotNull() & F.col("_f").isNotNull()).withColumn(
        "ts", F.col("_s") + F.col("_f") / 1e5
    ).drop("_p", "_s", "_f", "file_name")


def _files(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory)
    )


def read_radar(spark: SparkSession, directory: str, require: bool = False) -> DataFrame:
    """Radar frames of all recordings under a directory: recording, frame_no, ts, path, length, payload.

    Selecting without ``payload`` lists files and reads no content; files without a byte are not
    listed by Spark. ``require`` raises when no
    valid frame exists.
    """
    frames = parse_names(_files(spark, directory, "*.bin")).withColumnRenamed("content", "payload")
    if require and frames.select("frame_no").isEmpty():
        raise FileNotFoundError(f"no radar frame under {directory}")
    return frames.drop("modificationTime")


def read_camera(spark: SparkSession, directory: str, strict: bool = False) -> DataFrame:
    """Camera frames: recording, frame_no, ts, path, length, payload (encoded image)."""
    files = _files(spark, directory, "*.png")
    named = parse_names(files, "png") if strict else parse_names_lenient(files)
    return named.withColumnRenamed("content", "payload").drop("modificationTime")


def with_frame_index(frames: DataFrame) -> DataFrame:
    """Add ``frame_idx``: 0-based order by time inside each recording."""
    return with_position(frames, ["recording"], ["ts", "frame_no"]).withColumnRenamed("_pos", "frame_idx").drop("_n")


def _int16(payload: pa.Array) -> pa.Array:
    if isinstance(payload, pa.ChunkedArray):
        payload = payload.combine_chunks()
    rows = [np.frombuffer(b.as_py() or b"", dtype="<i2", count=len(b.as_py() or b"") // 2) for b in payload]
    flat = np.concatenate(rows) if rows else np.zeros(0, "<i2")
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def decode_frames(frames: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(frames with ``samples`` of little-endian int16, rejected frames with an empty payload)."""
    kernel = F.arrow_udf(_int16, returnType="array<smallint>")
    whole = F.coalesce(F.octet_length(payload), F.lit(0)) > 1
    good = frames.filter(whole).withColumn("samples", kernel(payload)).drop(payload)
    return good, frames.filter(~whole).drop(payload)


def frame_file_name(ts: str = "ts", frame: str = "frame_no", ref_compat: bool = False) -> F.Column:
    """Stem of the file name of a frame, to the nearest of 100,000 parts of a second.

    ``ref_compat`` cuts the binary fraction instead: 3.03 is then 3 and 2999 parts.
    """
    if ref_compat:
        whole = F.floor(ts).cast("long")
        frac = F.floor((F.col(ts) - whole) * 1e5).cast("long")
    else:
        parts = F.round(F.col(ts) * 1e5).cast("long")
        whole = F.floor(parts / 100_000).cast("long")
        frac = F.pmod(parts, F.lit(100_000)).cast("long")
    return F.format_string(NAME_FORMAT, whole, frac, F.col(frame).cast("long"))


def recorded(frames: DataFrame, control_log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Frames that arrive while recording is on, with their ``file_name``.

    ``control_log``: by, ts, seq, command ('on' / 'off'); the latest command at or before a frame rules.
    """
    ruled = asof_backward(frames, control_log.select(*by, "ts", "seq", "command"), by, rid="seq", prefix="_c_")
    return ruled.filter(F.col("_c_command") == "on").drop("_c_ts", "_c_seq", "_c_command").withColumn("file_name", frame_file_name())


def write_recording(frames: DataFrame, control_log: DataFrame, by: Sequence[str], out: str) -> None:
    """Write the recorded frames as Parquet, one folder per key, frames in time order inside files."""
    kept = recorded(frames, control_log, by)
    kept.repartition(*by, F.floor("ts")).sortWithinPartitions(*by, "ts").write.mode("append").partitionBy(*by).parquet(out)


def compact_recording(spark: SparkSession, directory: str, out: str) -> None:
    """Many small frame files to Parquet by recording: columns ts and frame_no then prune by file statistics."""
    frames = read_radar(spark, directory)
    frames.repartition("recording", F.floor(F.col("ts") / 60)).sortWithinPartitions("recording", "ts").write.mode(
        "append"
    ).partitionBy("recording").parquet(out)


# --- replay as a stream ------------------------------------------------------------------

# Replay rate limits and default.
MIN_RATE, MAX_RATE, DEFAULT_RATE = 0.1, 120.0, 10.0


def clamp_rate(rate: float | None) -> float:
    return DEFAULT_RATE if rate is None else max(MIN_RATE, min(MAX_RATE, float(rate)))


def skip_frames(frames: DataFrame, divisor: int) -> DataFrame:
    """Every ``divisor``-th frame by frame number."""
    return frames if divisor <= 1 else frames.filter(F.col("frame_no") % divisor == 0)


def stream_recording(spark: SparkSession, directory: str, files_per_trigger: int = 10, skip: int = 1) -> DataFrame:
    """Radar frames as a stream, a bounded number of files per trigger in arrival order."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (
        spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.bin")
        .option("maxFilesPerTrigger", files_per_trigger).load(directory)
    )
    frames = parse_names(files).withColumnRenamed("content", "payload").drop("modificationTime")
    return skip_frames(frames.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))), skip)
