"""Manifests of recordings, and their replay in time order.

A manifest is a Parquet table of frames (path, ts, frame_no) in time order. It is listed by tasks, folder by folder, so the
driver never holds the names; it prunes by the statistics of its files, and payloads are read by the tasks that need
them. ``frame_replay`` streams it (or any table with ts and frame_no in that layout) in the order of (ts, frame_no).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from rangelake.sources.recordings import clamp_rate, parse_names, skip_frames


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """path, length of all files below a folder: one task lists its entries, then one task each lists a folder's content."""

    def entries(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            for batch in batches:
                for name in batch.column("path").to_pylist():
                    system, root = _system(name)
                    info = system.get_file_info(root)
                    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=deep))
                    found = [i for i in found if not deep or i.type == fs.FileType.File]
                    prefix = name[: len(name) - len(root)] if name.endswith(root) else ""
                    for low in range(0, len(found), 10_000):
                        part = found[low : low + 10_000]
                        yield pa.record_batch([pa.array([prefix + i.path for i in part], pa.string()), pa.array([i.size for i in part], pa.int64())], ["path", "length"])

        return run

    root = spark.createDataFrame([(directory,)], "path string")
    top = root.mapInArrow(entries(False), "path string, length long")
    return top.select("path").repartition("path").mapInArrow(entries(True), "path string, length long")


def in_time_order(frames: DataFrame, out: str) -> None:
    """Write a table with ts and frame_no so that files, and rows in a file, ascend by (ts, frame_no)."""
    frames.repartitionByRange("ts", "frame_no").sortWithinPartitions("ts", "frame_no").write.parquet(out)


def write_manifest(spark: SparkSession, directory: str, out: str, extension: str = "bin") -> DataFrame:
    """The manifest of the frame files below a folder: recording, frame_no, ts, path, length. Files without a byte and other names are left out."""
    frames = parse_names(list_files(spark, directory).filter("length > 0"), extension)
    in_time_order(frames.select("recording", "frame_no", "ts", "path", "length"), out)
    return spark.read.parquet(out)


def with_payload(frames: DataFrame) -> DataFrame:
    """Rows of a manifest with ``payload``, read by the tasks that hold the rows."""
    schema = StructType([*frames.schema.fields, StructField("payload", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a payload may be large: one row a batch
                system, path = _system(batch.column("path")[k].as_py())
                with system.open_input_stream(path) as f:
                    yield batch.slice(k, 1).append_column("payload", pa.array([f.read()], pa.binary()))

    return frames.mapInArrow(run, schema)


class FrameReplay(DataSource):
    """``spark.readStream.format("frame_replay").schema(...).load(manifest)``: rows in the order of (ts, frame_no).

    A batch has the frames of ``interval`` seconds (default 1) at ``rate`` frames a second (0.1 to 120, default 10); rows of equal
    (ts, frame_no) stay together. The offset is the last (ts, frame_no), so a restarted query goes on behind it. To catch up, a batch
    may have up to ``at_once`` whole intervals; a column ``interval_no`` of the schema then numbers them from 0.
    """

    @classmethod
    def name(cls) -> str:
        return "frame_replay"

    def schema(self) -> str:
        return "recording string, frame_no bigint, ts double, path string, length bigint"

    def simpleStreamReader(self, schema: StructType) -> "ReplayReader":
        return ReplayReader(self.options, schema.names)


class ReplayReader(SimpleDataSourceStreamReader):
    """Reads the few manifest rows of a batch; files before the offset are skipped by their statistics."""

    def __init__(self, options: dict, names: list[str]):
        self.path, self.names = options["path"], names
        rate = clamp_rate(float(options["rate"]) if "rate" in options else None)
        self.frames = max(1, round(rate * float(options.get("interval", "1"))))
        self.at_once = max(1, int(options.get("at_once", "1")))

    def _rows(self, test) -> pa.Table:
        import pyarrow.dataset as ds

        system, root = _system(self.path)
        names = [n for n in self.names if n != "interval_no"]
        return ds.dataset(root, filesystem=system, format="parquet").scanner(columns=list(dict.fromkeys([*names, "ts", "frame_no"])), filter=test)

    def _cuts(self, table: pa.Table) -> list[int]:
        """Where the intervals of rows in order begin, and the end: ``frames`` rows each, and those that equal its last."""
        ts, number = (table.column(c).to_numpy() for c in ("ts", "frame_no"))
        changes = np.flatnonzero((ts[1:] != ts[:-1]) | (number[1:] != number[:-1])) + 1
        cuts = [0]
        while cuts[-1] < len(ts):
            k = np.searchsorted(changes, cuts[-1] + self.frames)
            cuts.append(int(changes[k]) if k < len(changes) else len(ts))
        return cuts

    @staticmethod
    def _behind(offset: dict):
        ts, number = pc.field("ts"), pc.field("frame_no")
        if offset["ts"] is None:
            return ts.is_valid() & number.is_valid()
        return (ts > offset["ts"]) | ((ts == offset["ts"]) & (number > offset["frame_no"]))

    def initialOffset(self) -> dict:
        return {"ts": None, "frame_no": None, "intervals": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        some = self._rows(self._behind(start)).head(self.frames * self.at_once)
        if not some.num_rows:
            return iter(()), start
        cuts = self._cuts(some)
        # the last interval may go on behind what was read; of several, it waits for the next batch then
        if len(cuts) > 2 and cuts[-1] - cuts[-2] < self.frames and some.num_rows == self.frames * self.at_once:
            cuts.pop()
        end = {k: some.column(k)[cuts[-1] - 1].as_py() for k in ("ts", "frame_no")} | {"intervals": start.get("intervals", 0) + len(cuts) - 1}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if end["ts"] is None:
            return iter(())
        ts, number = pc.field("ts"), pc.field("frame_no")
        until = (ts < end["ts"]) | ((ts == end["ts"]) & (number <= end["frame_no"]))
        table = self._rows(self._behind(start) & until).to_table()
        if not table.num_rows:
            return iter(())
        if "interval_no" in self.names:
            cuts = self._cuts(table)
            table = table.append_column("interval_no", pa.array(start.get("intervals", 0) + np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))))
        return zip(*(table.column(c).to_pylist() for c in self.names))

    def commit(self, end: dict) -> None:
        """Nothing is kept that a commit could free."""


def replay(spark: SparkSession, manifest: str, rate: float | None = None, interval: float = 1.0, skip: int = 1, at_once: int | None = None) -> DataFrame:
    """The manifest as a stream in time order, every ``skip``-th frame by number, with ``event_time``. ``with_payload`` adds the bytes.

    Run it with a processing-time trigger of ``interval`` seconds for the wanted pace, or of 0 to go as fast as it can; with
    ``at_once``, a batch then has that many intervals, numbered by ``interval_no``.
    """
    spark.dataSource.register(FrameReplay)
    schema = spark.read.parquet(manifest).schema
    if at_once is not None:
        schema = StructType([*schema.fields, StructField("interval_no", LongType())])
    options = {"rate": clamp_rate(rate), "interval": interval, "at_once": at_once or 1}
    stream = spark.readStream.format("frame_replay").schema(schema).options(**options).load(manifest)
    return skip_frames(stream.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))), skip)
