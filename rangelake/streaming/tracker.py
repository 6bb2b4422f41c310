"""The tracker over a stream of points: micro-batches over a versioned table of tracks.

Batch ``n`` reads the tracks as batch ``n - 1`` left them and writes its own version, so a batch that runs again after a failure
starts from the same tracks and replaces what it had written. All sensors take their next frame together; a batch
with several frames of a sensor takes them one after another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from rangelake.operators.allocation import TRACK, Tracker, track_frame
from rangelake.operators.track_kernel import Recording
from rangelake.operators.ordered import join_keys
from rangelake.session import cut_lineage


class TrackTable:
    """Versions of the tracks (``version=n``) and reports of the frames (``report/epoch=n``) below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, by: dict[str, str]):
        self.spark, self.folder, self.by = spark, folder.rstrip("/"), list(by)
        names = ", ".join(f"{k} {t}" for k, t in by.items())
        self.schema = StructType.fromDDL(f"{names}, {TRACK}")
        self.report_schema = StructType.fromDDL(f"{names}, frame_no long, {TRACK}")

    def version(self, n: int) -> DataFrame:
        """The tracks after batch ``n``; none before the first."""
        if n < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/version={n}")

    def report(self) -> DataFrame:
        """Every track at every frame of its sensor, ended ones once as ``free``."""
        return self.spark.read.schema(self.report_schema).parquet(f"{self.folder}/report/epoch=*/step=*")

    def advance(self, batch: DataFrame, epoch: int, how: Tracker) -> None:
        """One micro-batch of points (by, frame_no, pid, range, angle, doppler, snr)."""
        rows = batch.withColumn("_step", F.dense_rank().over(Window.partitionBy(*self.by).orderBy("frame_no")) - 1)
        rows = cut_lineage(rows)
        tracks = self.version(epoch - 1)
        steps = rows.agg(F.max("_step")).first()[0]
        for step in range(0 if steps is None else steps + 1):
            points = rows.filter(F.col("_step") == step).drop("_step")
            after, _ = track_frame(tracks, points.drop("frame_no"), self.by, (epoch << 16) + step + 1, how)
            tracks = cut_lineage(after)
            frames = points.select(*self.by, "frame_no").distinct()
            seen = join_keys(tracks, frames, self.by).select(*self.report_schema.names)
            seen.write.mode("overwrite").parquet(f"{self.folder}/report/epoch={epoch}/step={step}")
        tracks.filter("state <> 'free'").write.mode("overwrite").parquet(f"{self.folder}/version={epoch}")


def track_stream(points: DataFrame, table: TrackTable, how: Tracker = Tracker()) -> DataStreamWriter:
    """The unstarted writer that keeps ``table`` up to date with a stream of points."""
    return points.writeStream.foreachBatch(lambda batch, epoch: table.advance(batch, epoch, how)).option("checkpointLocation", f"{table.folder}/checkpoint")


def track_recording(points: DataFrame, table: TrackTable, how: Tracker = Tracker(), by_frames: int = 1) -> DataFrame:
    """The same over a table of points, ``by_frames`` frames a batch: the report.

    All frames are there, so the points of a sensor are dealt out once and sorted, and a kernel takes the sensors' frames one after
    another; versions are what the report's rows at the end of a batch say.
    """
    axes = ["range", "angle", "doppler", "snr"]
    own = points.select(*table.by, F.col("frame_no").cast("long").alias("frame_no"), "pid", *(F.col(a).cast("double").alias(a) for a in axes))
    rows = own.repartition(*table.by).sortWithinPartitions(*table.by, "frame_no")
    schema = StructType([*table.report_schema.fields, *StructType.fromDDL("_from long, _until long, epoch long, step long").fields])
    by, arrow = table.by, to_arrow_schema(schema)
    told = rows.mapInArrow(lambda batches: Recording(by, how, by_frames, arrow).run(batches), schema)
    folder = f"{table.folder}/report"
    told.write.mode("overwrite").option("compression", "zstd").partitionBy("epoch", "step").parquet(folder)
    kept = table.spark.read.schema(schema).parquet(folder)
    last = kept.agg(F.max("epoch")).first()[0]
    for n in range(0 if last is None else last + 1):
        version = kept.filter((F.col("_from") <= n) & (F.col("_until") >= n) & (F.col("state") != "free")).select(*table.schema.names)
        version.write.mode("overwrite").option("compression", "zstd").parquet(f"{table.folder}/version={n}")
    return table.report()
