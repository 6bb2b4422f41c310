"""IQ files of recordings that end within an interval, lost vectors or samples, or hold vectors twice, against SQL."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare

import __spark_entry__ as entry
from rangelake.sources import iqfiles

_RNG = np.random.default_rng(5)


def vectors(n, size=64):
    return [_RNG.standard_normal(size).astype(np.float32).tolist() for _ in range(n)]


def gaps():
    out = vectors(48)
    out[3], out[22], out[14], out[19][4], out[35][7], out[38][2] = None, None, out[14][:10], None, float("nan"), float("nan")
    return [*range(47), None], out


CASES = {
    "ends within an interval": lambda: (range(44), vectors(44)),
    "ends before eight channels": lambda: (range(37), vectors(37)),
    "lost vectors": lambda: ([i for i in range(48) if i not in (3, 22, 27)], vectors(45)),
    "lost samples": gaps,
    "vectors twice": lambda: ([*range(32), 3, 6, 6, 19], vectors(36)),
}


@pytest.mark.parametrize("case", CASES)
def test_pairs_like_sql(spark, tmp_path, case):
    ids, values = CASES[case]()
    pq.write_table(pa.table({"vec_id": pa.array(list(ids), pa.int64()), "embedding": pa.array(values, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    rows, problem = compare(spark, con, "iq_file_pairs", entry.queries()["iq_file_pairs"], entry.oracle_sql()["iq_file_pairs"], str(tmp_path))
    assert problem is None and rows, problem


def test_measured_nan_is_not_a_missing_sample(spark, tmp_path):
    iq = np.zeros((8, 3), complex)
    iq.real[3, 1], iq.real[3, 2] = np.nan, iqfiles.NOT_RECORDED
    np.save(tmp_path / "cpi_4.npy", iq)
    row = iqfiles.read_iq(spark, str(tmp_path)).first()
    assert row.ref_re[0] == 0.0 and math.isnan(row.ref_re[1]) and row.ref_re[2] is None and row.ref_im == [0.0] * 3
