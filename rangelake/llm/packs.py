"""Blocks of documents: texts travel as compressed Arrow streams, many documents a row.

A document's block depends only on its own id and text, so a block is the same whenever it is computed again,
also after an executor is lost. The number of blocks follows the bytes of text, so a block stays bounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangelake import session

#: Text bytes that a block should hold.
BLOCK_BYTES = 12 << 20


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, by one distributed sum."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def block_count(size: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(8, -(-size // block_bytes))


def document_key() -> Column:
    """Tells documents apart even where ids are null or repeated."""
    return F.xxhash64("doc_id", "text")


def pack(batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write(batch)
    return sink.getvalue().to_pybytes()


def unpack(raw: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(raw.as_buffer()).read_all()


def by_key(batch: pa.RecordBatch, key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by an integer column, which is left out."""
    keys = batch.column(key).to_numpy(zero_copy_only=False)
    order = np.argsort(keys, kind="stable")
    rest = batch.drop_columns([key]).take(pa.array(order))
    edges = np.flatnonzero(np.diff(keys[order], prepend=-1))
    for low, high in zip(edges, [*edges[1:], len(keys)]):
        yield int(keys[order[low]]), rest.slice(low, high - low)


def packed(docs: DataFrame, blocks: int, group: Column | None = None, groups: int = 1) -> DataFrame:
    """(block, pack): ``doc_id``, ``doc_key`` and ``text`` of documents, still spread over the input's tasks.

    With ``group`` (0 to ``groups`` - 1) a block holds documents of one group only: block % groups.
    """
    block = F.pmod(document_key(), F.lit(blocks))
    block = block if group is None else block * groups + group
    spread = docs.select(
        "doc_id", document_key().alias("doc_key"), F.coalesce("text", F.lit("")).alias("text"),
        block.cast("int").alias("block"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = list(by_key(batch, "block"))
                yield pa.record_batch([pa.array([b for b, _ in found], pa.int32()), pa.array([pack(r) for _, r in found], pa.binary())], ["block", "pack"])

    return spread.mapInArrow(run, "block int, pack binary")


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared folder that the cluster names in ``spark.checkpoint.dir``."""
    return f"{session.work_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    folder = folder or work_folder(spark)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Remove a table that ``stored`` wrote and that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def renamed(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, list[str]]:
    """Columns other than ``keep`` under names that clash with nothing, and all names in order, for ``restored``."""
    names = [c if c in keep else f"_own_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def restored(df: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``docs`` from a frame that has them under ``names``."""
    return df.select(*(F.col(a).alias(c) for a, c in zip(names, docs.columns)))
