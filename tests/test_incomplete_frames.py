"""A recording may end within a frame, and within a chirp, or have lost rows in between."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare

import __spark_entry__ as entry
from rangelake.operators import angles as an


@pytest.fixture(scope="module")
def recording(tmp_path_factory):
    """Two frames: one without two of its rows, one that ends with two of four antennas of its 21st chirp."""
    folder = tmp_path_factory.mktemp("incomplete")
    ids = np.array([i for i in range(182) if i not in (9, 57)])
    rng = np.random.default_rng(4)
    values = rng.normal(size=(len(ids), 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(values.tolist(), pa.list_(pa.float32()))}), f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return str(folder), con


WITH_SQL = """bartlett_spectrum beam_doppler beamformed_point_cloud capon_two_antennas doa_bartlett doa_capon doa_lpm doa_mem doa_music
forward_backward_covariance hysteresis_peaks one_point_beam peaks_with_variance single_peak_index single_peak_variance smoothed_covariance
spatial_covariance spectrum_peaks""".split()


@pytest.mark.parametrize("name", WITH_SQL)
def test_incomplete_frames_like_sql(spark, recording, name):
    folder, con = recording
    rows, problem = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert problem is None and rows, problem


@pytest.mark.parametrize("name", ["capon_peaks", "capon_point_cloud", "esprit_angles", "music_peaks", "root_music_angles"])
def test_incomplete_frames_run(spark, recording, name):
    rows = entry.queries()[name](spark, recording[0]).collect()
    assert {r.frame_no for r in rows} == {0, 1}
    assert name == "capon_point_cloud" or len(rows) == 64


def test_capon_of_antennas_that_recorded_nothing(spark):
    """The spectrum of the others alone; the batch's regular matrices as before."""
    part, whole = np.zeros((4, 4)), np.diag([1.0, 2.0, 3.0, 4.0])
    part[:2, :2] = [[2, 1], [1, 2]]
    cov = spark.createDataFrame([(k, m.ravel().tolist(), [0.0] * 16) for k, m in enumerate((part, whole))], "k int, re array<double>, im array<double>").coalesce(1)
    a, out = an.steering_matrix(90, 10, 4), an.capon(cov, 4, 90, 10).orderBy("k").collect()
    for row, m, some in ((out[0], part[:2, :2], slice(0, 2)), (out[1], whole, slice(0, 4))):
        want = [abs(1 / (v[some].conj() @ np.linalg.inv(m) @ v[some])) for v in a]
        assert row.spectrum == pytest.approx(want)


@pytest.mark.parametrize("name", ["esprit_angles", "music_peaks", "root_music_angles"])
def test_missing_samples_leave_other_frames(spark, recording, tmp_path, name):
    """A sample that is NULL takes the angle of its own frame and range bin only."""
    rows = pq.read_table(f"{recording[0]}/embeddings.parquet").to_pydict()
    rows["embedding"] = [[None if (i, k) == (3, 10) else x for k, x in enumerate(v)] for i, v in zip(rows["vec_id"], rows["embedding"])]
    pq.write_table(pa.table({"vec_id": pa.array(rows["vec_id"], pa.int64()), "embedding": pa.array(rows["embedding"], pa.list_(pa.float32()))}), f"{tmp_path}/embeddings.parquet")
    got = {(r.frame_no, r.range_bin): r.angle for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    want = {(r.frame_no, r.range_bin): r.angle for r in entry.queries()[name](spark, recording[0]).collect()}
    lost = got.pop((0, 5))
    assert lost is None or np.isnan(lost)
    del want[0, 5]
    assert got == want
