"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def build_session(app: str = "rangelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC time."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made only in local runs where none is configured.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rangelake-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def drain_windows(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run a windowed aggregation over everything available now; the last state of every window, open ones included.

    Each micro-batch leaves the windows it changed in a folder of its own, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    base = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/_epoch={epoch}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_epoch", LongType())])
    rest = [c for c in stream.columns if c not in keys]
    last = spark.read.schema(schema).parquet(f"{base}/rows").groupBy(*keys).agg(F.max_by(F.struct(*rest), "_epoch").alias("_last"))
    return last.select(*(F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in stream.columns))


def drain_batches(stream: DataFrame) -> DataFrame:
    """Run a stream until nothing new comes, micro-batch by micro-batch, and return its rows with the batch's number, ``_epoch``.

    Each batch has a folder of its own, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    base = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    keep = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{base}/rows/_epoch={epoch}")
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(processingTime="0 seconds").start()
    query.processAllAvailable()
    query.stop()
    schema = StructType([*stream.schema.fields, StructField("_epoch", LongType())])
    return spark.read.schema(schema).parquet(f"{base}/rows")


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over everything available now and return what it wrote (Parquet in the shared folder)."""
    spark = stream.sparkSession
    base = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
