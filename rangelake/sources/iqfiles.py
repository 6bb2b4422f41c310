"""IQ recordings stored as one array file per processing interval."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of the reference and the surveillance channel.
REFERENCE_ROW, SURVEILLANCE_ROW = 3, 6
# A sample that was not recorded: a NaN of its own, told by its bits from one that was measured.
NOT_RECORDED = np.array(0x7FF80000000007A2, np.uint64).view(np.float64)


def _samples(part: np.ndarray) -> pa.Array:
    """One row of samples."""
    values = np.ascontiguousarray(part, float)
    gone = values.view(np.uint64) == NOT_RECORDED.view(np.uint64)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, mask=gone))


def decode_iq(files: DataFrame, ref: int = REFERENCE_ROW, surv: int = SURVEILLANCE_ROW) -> DataFrame:
    """Array files (cpi, content) to pair rows: cpi, ref_re, ref_im, surv_re, surv_im; samples marked as not recorded are NULL."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cpi, content in zip(batch["cpi"].to_pylist(), batch["content"].to_pylist()):
                iq = np.load(io.BytesIO(content), allow_pickle=False)
                cols = [iq[row].real if part == "re" else iq[row].imag for row in (ref, surv) for part in ("re", "im")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cpi], pa.int64()), *map(_samples, cols)],
                    names=["cpi", "ref_re", "ref_im", "surv_re", "surv_im"],
                )

    schema = "cpi long, " + ", ".join(f"{c} array<double>" for c in ("ref_re", "ref_im", "surv_re", "surv_im"))
    return files.select(F.col("cpi").cast("long").alias("cpi"), "content").mapInArrow(load, schema)


def read_iq(spark: SparkSession, directory: str, ref: int = REFERENCE_ROW, surv: int = SURVEILLANCE_ROW) -> DataFrame:
    """Pair rows of every ``<prefix><index>.npy`` under a directory; the index is the interval."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(directory)
    named = files.withColumn("cpi", F.regexp_extract("path", r"(\d+)\.npy$", 1)).filter(F.col("cpi") != "")
    return decode_iq(named, ref, surv)
