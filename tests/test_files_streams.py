"""Sources on real files and streams against their batch twins."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangelake.operators import telemetry as tm
from rangelake.sources import byteranges, iqfiles, packets as pk, profiles as pf, recordings as rec, tlv
from rangelake.streaming import jobs


@pytest.fixture(scope="module")
def recording(tmp_path_factory):
    root = tmp_path_factory.mktemp("rec") / "run1"
    root.mkdir()
    for i in range(12):
        data = np.arange(16, dtype="<i2") + i
        (root / f"{i:010d}_{i * 1000:05d}_{i:012d}.bin").write_bytes(b"\x01" if i == 5 else data.tobytes())
    (root / "notes.bin").write_bytes(b"x")
    (root / "0000000001_50000_000000000007.png").write_bytes(b"png")
    (root / "2_25000_last.png").write_bytes(b"png")
    (root / "cover.png").write_bytes(b"png")
    return str(root.parent)


def test_radar_scan_and_decode(spark, recording):
    frames = rec.read_radar(spark, recording)
    assert frames.count() == 12 and {r.recording for r in frames.select("recording").collect()} == {"run1"}
    good, bad = rec.decode_frames(frames)
    assert bad.count() == 1
    row = good.filter("frame_no = 3").first()
    assert row.samples == list(range(3, 19)) and row.ts == pytest.approx(3.03)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(recording)
    assert [r.path.split("/")[-1] for r in rec.rejected_names(files).collect()] == ["notes.bin"]
    assert rec.with_frame_index(frames.drop("payload")).filter("frame_no = 7").first().frame_idx == 7


def test_empty_recording(spark, tmp_path):
    (tmp_path / "notes.bin").write_bytes(b"x")
    with pytest.raises(FileNotFoundError):
        rec.read_radar(spark, str(tmp_path), require=True)


def test_camera_scan(spark, recording):
    lenient = {r.ts: r.frame_no for r in rec.read_camera(spark, recording).collect()}
    assert lenient == {1.5: 7, 2.25: None}
    assert rec.read_camera(spark, recording, strict=True).count() == 1


def test_frame_file_source_prunes(spark, recording):
    byteranges.register(spark)
    df = spark.read.format("frame_files").option("files_per_task", 4).load(recording)
    assert df.count() == 12
    reader = byteranges.FrameReader({"path": recording})
    from pyspark.sql.datasource import GreaterThan

    assert list(reader.pushFilters([GreaterThan(("frame_no",), 8)])) == []
    assert sum(len(p.items) for p in reader.partitions()) == 3
    assert sorted(r.frame_no for r in df.filter("frame_no > 8 and ts < 10.5").select("frame_no").collect()) == [9, 10]


def test_write_and_compact(spark, recording, tmp_path):
    frames = rec.read_radar(spark, recording).select("recording", "frame_no", "ts", "payload")
    log = spark.createDataFrame([("run1", 2.5, 0, "on"), ("run1", 6.5, 1, "off"), ("run1", 9.0, 2, "on")], "recording string, ts double, seq long, command string")
    out = str(tmp_path / "out")
    rec.write_recording(frames, log, ["recording"], out)
    back = spark.read.parquet(out)
    assert sorted(r.frame_no for r in back.collect()) == [3, 4, 5, 6, 9, 10, 11]
    assert back.filter("frame_no = 4").first().file_name == "0000000004_04000_000000000004"
    rec.compact_recording(spark, recording, str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed")).count() == 12


def test_packet_log_is_split(spark, tmp_path):
    body = b"".join(struct.pack("<L", i + 1) + (i * 8).to_bytes(6, "little") + bytes([i % 256] * 8) for i in range(50) if i != 20)
    (tmp_path / "a.dat").write_bytes(body)
    df = pk.read_packets(spark, str(tmp_path), payload=8, chunk_records=7)
    assert df.rdd.getNumPartitions() == 7
    assert sorted(r.seq for r in df.collect()) == [i + 1 for i in range(50) if i != 20]
    frames = pk.assemble_frames(df, 20, 8).orderBy("frame_no").collect()
    whole = b"".join(bytes([0 if i == 20 else i] * 8) for i in range(50))
    assert b"".join(bytes(r.payload) for r in frames) == whole
    assert sum(r.missing_packets for r in frames) == 1


def tlv_packet(no, n, bad=0):
    pts = np.array([[no, i, 0.5, -1] for i in range(n)], "<f4").tobytes()
    side = np.array([[no, i] for i in range(n)], "<u2").tobytes()
    body = b"".join(struct.pack("<LL", t, len(b)) + b for t, b in ((1, pts), (7, side)))
    return tlv.MAGIC + struct.pack("<8L", 3, 40 + len(body) + bad, 1, no, 9, n, 2, 0) + body


def test_tlv_chunks_give_the_same_packets(spark, tmp_path):
    log = b"junk" + b"".join(tlv_packet(i, 1 + i % 4, 3 if i == 6 else 0) for i in range(20))
    (tmp_path / "log.bin").write_bytes(log)
    whole = tlv.read_tlv(spark, str(tmp_path))
    cut = tlv.read_tlv(spark, str(tmp_path), chunk_bytes=97)
    key = lambda d: sorted((r.frame_no, r.obj, r.x, r.snr, r.noise) for r in d["points"].collect())
    assert key(whole) == key(cut)
    assert {k[0] for k in key(whole)} == set(range(20)) - {6}


def test_iq_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = {i: rng.standard_normal((8, 30)) + 1j * rng.standard_normal((8, 30)) for i in (2, 11)}
    for i, z in data.items():
        np.save(tmp_path / f"cpi_{i}.npy", z)
    rows = {r.cpi: r for r in iqfiles.read_iq(spark, str(tmp_path)).collect()}
    assert set(rows) == {2, 11}
    assert rows[11].ref_im == pytest.approx(data[11][3].imag.tolist()) and rows[2].surv_re == pytest.approx(data[2][6].real.tolist())


PROFILE = """# radar
channelTx=7; channelRx=15;
channelRx=15;
dataRate=1;
laneEn=15;
profileId=0;
startFreqConst=1435384036;
idleTimeConst=700;
rampEndTime=5000;
freqSlopeConst=621;
numAdcSamples=256;
digOutSampleRate=10000;
rxGain=30;
chirpStartIdx=0;
chirpEndIdx=0;
txEnable=1;
chirpStartIdx=1;
chirpEndIdx=1;
txEnable=2;
chirpStartIdxFCF=0;
chirpEndIdxFCF=%d;
loopCount=64;
periodicity=10000000;
numAdcSamples=512;
"""


def test_profile_file(spark, tmp_path):
    (tmp_path / "ok.txt").write_text(PROFILE % 1)
    row = pf.read_profile(spark, str(tmp_path / "ok.txt")).first()
    assert (row.tx, row.rx, row.samples, row.chirps, row.lane_mbps, row.lanes) == (2, 4, 256, 64, 600.0, 4)
    assert row.start_freq == pytest.approx(77.0, abs=1e-3) and row.frame_period_ms == 50.0 and row.error is None
    (tmp_path / "bad.txt").write_text(PROFILE % 2)
    with pytest.raises(Exception, match="chirp count"):
        pf.read_profile(spark, str(tmp_path / "bad.txt")).collect()


# --- streams ---------------------------------------------------------------------------


def run_stream(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def stream_of(spark, df, folder, parts):
    """A file stream that delivers the given row groups one micro-batch after another."""
    for i, cond in enumerate(parts):
        df.filter(cond).coalesce(1).write.mode("append").parquet(f"{folder}/p={i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/p=*")


def test_replay_stream(spark, recording):
    s = rec.stream_recording(spark, recording + "/run1", files_per_trigger=3, skip=2)
    got = run_stream(s.select("frame_no", "ts"), "replay").collect()
    assert sorted(r.frame_no for r in got) == [0, 2, 4, 6, 8, 10]
    assert rec.clamp_rate(1000) == 120.0 and rec.clamp_rate(None) == 10.0


def test_latest_only(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 3, 6), ("b", 2, 7)], "k string, seq long, v long")
    got = {r.k: (r.seq, r.v, r.dropped) for r in jobs.latest_only(df, ["k"]).collect()}
    assert got == {"a": (3, 6, 1), "b": (2, 7, 0)}


def test_gap_counter_equals_batch(spark, tmp_path):
    rows = [(k, s) for k in (0, 1) for s in range(60) if (s * (k + 3)) % 7 != 3]
    df = spark.createDataFrame(rows, "stream long, seq long")
    s = stream_of(spark, df, str(tmp_path), ["seq < 20", "seq >= 20 and seq < 41", "seq >= 41"])
    got = run_stream(jobs.gap_counter(s), "gaps").orderBy("stream", "seq").collect()
    want = tm.frame_drops(df, ["stream"]).select("stream", "seq", "missed", "missed_total").orderBy("stream", "seq").collect()
    assert got == want


def test_gap_counter_with_late_and_repeated_numbers(spark, tmp_path):
    """Late numbers fill gaps once; the total ends at what is really missing."""
    batches = [[0, 1, 5, 9], [3, 3, 5, 12], [4, 2, 2, 11], [-1, 6]]
    df = spark.createDataFrame([(7, s, b) for b, own in enumerate(batches) for s in own], "stream long, seq long, b long")
    s = stream_of(spark, df, str(tmp_path), [f"b = {b}" for b in range(4)])
    got = run_stream(jobs.gap_counter(s.drop("b")), "late").collect()
    assert len(got) == 14 and all(r.missed == 0 for r in got if r.seq in (2, 3, 4, 6, 11, -1))
    missing = set(range(13)) - {s for own in batches for s in own}
    assert got[-1].missed_total == len(missing) == 3
    assert sum(r.missed for r in got) == 3 + 3 + 2


def test_dc_calibration_of_split_frames(spark, tmp_path):
    """A calibrating frame in two batches counts once; only the named bins are touched."""
    rng = np.random.default_rng(5)
    rows = [(0, f, c, 0, rng.normal(2, 1, 6).tolist(), rng.normal(0, 1, 6).tolist()) for f in range(5) for c in range(4)]
    df = spark.createDataFrame(rows, "sensor long, frame_no long, chirp long, vant long, re array<double>, im array<double>")
    s = stream_of(spark, df, str(tmp_path), ["frame_no = 0", "frame_no = 1 and chirp < 3", "frame_no = 1 and chirp = 3 or frame_no = 2", "frame_no > 2"])
    got = run_stream(jobs.dc_calibration(s, "sensor", 2, 6, positive=1, negative=2), "split").collect()
    assert sorted({r.frame_no for r in got}) == [2, 3, 4] and len(got) == 12
    mean = {p: np.mean([r[4] for r in rows if r[1] < 2 and r[2] % 2 == p], axis=0) * [1, 1, 0, 0, 1, 1] for p in (0, 1)}
    raw = {(r[1], r[2]): np.array(r[4]) for r in rows}
    assert all(np.allclose(r.re, raw[r.frame_no, r.chirp] - mean[r.chirp % 2]) for r in got)


def test_gate_with_many_spans_and_null_keys(spark, tmp_path):
    log = [(k, 10.0 * i, i, "on" if i % 2 == 0 else "off") for k in ("s", None) for i in range(41)]
    spans = jobs.recording_spans(spark.createDataFrame(log, "session string, ts double, seq long, command string"), ["session"])
    df = spark.createDataFrame([(k, i, i * 5.0) for k in ("s", None, "other") for i in range(100)], "session string, frame_no long, ts double")
    s = stream_of(spark, df, str(tmp_path), ["frame_no < 50", "frame_no >= 50"])
    got = run_stream(jobs.recording_gate(s, spans, ["session"], bucket_s=15.0), "spans").collect()
    on = [i for i in range(100) if i * 5 >= 400 or i * 5 // 10 % 2 == 0]
    assert sorted((r.session or "", r.frame_no) for r in got) == sorted((k, i) for k in ("s", "") for i in on)


def test_gate_with_spans_of_all_lengths(spark, tmp_path):
    """Microseconds to ages: a span has few pieces however long it is; an empty one holds nothing."""
    edges = [0.0, 1e-6, 1e-6, 0.5, 0.75, 40.0, 2000.0, 2000.5, 1e6, 1e12, 1e12 + 1, 1e12 + 5]
    log = [("s", t, i, "off" if i % 2 else "on") for i, t in enumerate(edges)] + [("t", 7.0, 0, "on")]
    spans = jobs.recording_spans(spark.createDataFrame(log, "session string, ts double, seq long, command string"), ["session"])
    times = sorted({max(0.0, e + d) for e in edges for d in (-0.25, 0.0, 0.1)} | {1e9, 5e11})
    df = spark.createDataFrame([(k, i, t) for k in ("s", "t") for i, t in enumerate(times)], "session string, frame_no long, ts double")
    s = stream_of(spark, df, str(tmp_path), ["frame_no < 9", "frame_no >= 9"])
    got = run_stream(jobs.recording_gate(s, spans, ["session"]), "lengths").collect()
    own = [i for i, t in enumerate(times) if any(a <= t < b for a, b in zip(edges[::2], edges[1::2]))]
    assert sorted((r.session, r.frame_no) for r in got) == [("s", i) for i in own] + [("t", i) for i, t in enumerate(times) if t >= 7]


def test_dc_calibration_stream(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = np.array([3.0, -2.0, 1.0])
    rows = [(0, f, c, 0, (base * (1 + c % 2) + rng.normal(0, 0.01, 3)).tolist(), [0.0] * 3) for f in range(6) for c in range(4)]
    df = spark.createDataFrame(rows, "sensor long, frame_no long, chirp long, vant long, re array<double>, im array<double>")
    s = stream_of(spark, df, str(tmp_path), ["frame_no < 1", "frame_no = 1 or frame_no = 2", "frame_no > 2"])
    got = run_stream(jobs.dc_calibration(s, "sensor", 2, 3), "dc").collect()
    assert sorted({r.frame_no for r in got}) == [2, 3, 4, 5]
    assert max(abs(x) for r in got for x in r.re) < 0.1


def test_recording_gate_stream(spark, tmp_path):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(10)], "session string, frame_no long, ts double")
    log = spark.createDataFrame([("s", 2.0, 0, "on"), ("s", 5.0, 1, "off"), ("s", 8.0, 2, "on")], "session string, ts double, seq long, command string")
    spans = jobs.recording_spans(log, ["session"])
    s = stream_of(spark, df, str(tmp_path), ["frame_no < 4", "frame_no >= 4"])
    got = run_stream(jobs.recording_gate(s, spans, ["session"]), "gate").collect()
    assert sorted(r.frame_no for r in got) == [2, 3, 4, 8, 9]


def timed(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))


def test_fused_streams(spark, tmp_path):
    radar = timed(spark, [("s", i, i * 0.5) for i in range(20)], "sensor string, frame_no long, ts double")
    camera = timed(spark, [("s", i, i * 0.3) for i in range(30)], "sensor string, cam_no long, ts double")
    a = stream_of(spark, radar, str(tmp_path / "r"), ["frame_no < 10", "frame_no >= 10"])
    b = stream_of(spark, camera, str(tmp_path / "c"), ["cam_no < 15", "cam_no >= 15"])
    got = {r.frame_no: r.camera.cam_no for r in run_stream(jobs.fuse_streams(a, b, "sensor"), "fused").collect()}
    assert len(got) >= 10
    for f, c in got.items():
        assert c == max(i for i in range(30) if round(i * 0.3, 6) <= f * 0.5)


def test_window_streams(spark, tmp_path):
    df = timed(spark, [("s", i, i * 0.25) for i in range(80)], "sensor string, frame_no long, ts double")
    s = stream_of(spark, df, str(tmp_path), ["frame_no < 40", "frame_no >= 40"])
    got = run_stream(jobs.rate_windows(s, "sensor"), "rate").collect()
    assert got and all(r.frames == 4 for r in got)
    t = stream_of(spark, df, str(tmp_path / "t"), ["frame_no < 40", "frame_no >= 40"])
    slide = run_stream(jobs.rate_windows(t, "sensor", length="2 seconds", slide="1 second"), "slide").collect()
    assert max(r.frames for r in slide) == 8
    u = stream_of(spark, df, str(tmp_path / "u"), ["frame_no < 40", "frame_no >= 40"])
    mean = run_stream(jobs.runtime_windows(u, "sensor", F.col("ts"), length="5 seconds", delay="1 second"), "mean").collect()
    assert mean and mean[0].frames == 20


PACKET = "capture string, arrival long, seq long, byte_count long, payload binary"


def test_far_sequence_numbers_lose_nothing(spark):
    """Two packets a million numbers apart, two neighbouring damaged numbers, a packet before a long outage, a NULL capture."""
    seqs = {"far": [1, 1_000_001], "damaged": [1, 2, 3, 4, 3_000_000, 3_000_001], "outage": [5, 200_005, 200_006, 200_007], None: range(5)}
    rows = [(c, i, seq, 8 * i, bytes([i + 1] * 8)) for c, own in seqs.items() for i, seq in enumerate(own)]
    df = spark.createDataFrame(rows, PACKET)
    frames = pk.assemble_frames(df, 16, 8, limit=2)
    held = frames.filter(F.hex("payload").rlike("[1-9]")).collect()
    got = {(r.capture, r.frame_no): (bytes(r.payload), r.missing_packets) for r in held}
    assert got["far", 0] == (bytes([1] * 8 + [0] * 8), 1) and got["damaged", 0][0] == bytes([1] * 8 + [2] * 8) and got["damaged", 1][0] == bytes([3] * 8 + [4] * 8)
    assert got["damaged", 1_499_999] == (bytes([0] * 8 + [5] * 8), 1) and got["outage", 100_000] == (bytes([2] * 8 + [3] * 8), 0) and got[None, 1] == (bytes([3] * 8 + [4] * 8), 0)
    counts = {r.capture: r["count"] for r in frames.groupBy("capture").count().collect()}
    assert counts == {"far": 500_000, "damaged": 1_500_000, "outage": 100_001, None: 2}
    assert frames.filter("capture = 'far'").agg(F.sum("missing_packets")).first()[0] == 999_999
    clean = pk.clean_capture(df, limit=2)
    assert {(r.seq, r.packets, r.offset) for r in clean.filter("capture = 'far'").collect()} == {(1, 1, 0), (2, 999_999, 8), (1_000_001, 1, 8_000_000)}
    assert {(r.seq, r.packets, r.lost) for r in clean.filter("capture = 'outage'").collect()} == {(1, 4, True), (5, 1, False), (6, 199_999, True), (200_005, 1, False), (200_006, 1, False), (200_007, 1, False)}
    zeros = pk.filled(clean.filter("capture = 'far'"))
    assert zeros.count() == 1_000_001 and zeros.filter("offset <> (seq - 1) * 8").count() == 0
    assert {(r.capture, r.seq) for r in pk.lone_packets(df, 1 << 16, limit=2).collect()} == {("far", 1), ("far", 1_000_001), ("outage", 5)}


def test_repeated_packets(spark):
    df = spark.createDataFrame([("c", i, seq, 0, bytes([i] * 8)) for i, seq in enumerate([1, 2, 2, 3, 1])], PACKET)
    assert {(r.seq, r.arrival, r.used_arrival) for r in pk.repeated_packets(df).collect()} == {(2, 2, 1), (1, 4, 0)}
    assert {(r.seq, r.arrival, r.used_arrival) for r in pk.repeated_packets(df, "last").collect()} == {(2, 1, 2), (1, 0, 4)}
    assert [bytes(r.payload)[0] for r in pk.assemble_frames(df, 8, 8).orderBy("frame_no").collect()] == [0, 1, 3]
    assert [bytes(r.payload)[0] for r in pk.clean_capture(df).orderBy("seq").collect()] == [4, 2, 3]


def test_card_and_offset_files(spark, tmp_path):
    body = b"".join(struct.pack("<ii", seq, 4) + bytes(6) + bytes([seq] * 4) for seq in (1, 2, 4))
    (tmp_path / "card.bin").write_bytes(body)
    got = pk.read_card_logs(spark, str(tmp_path / "card.bin")).orderBy("arrival").collect()
    assert [(r.seq, bytes(r.payload)) for r in got] == [(s, bytes([s] * 4)) for s in (1, 2, 4)]
    values = np.arange(5 * 2 * 2 * 3 * 2) + (1 << 15)
    (tmp_path / "offset.bin").write_bytes(values.astype("<u2").tobytes())
    rows = pk.read_offset_binary(spark, str(tmp_path / "offset.bin"), 2, 2, 3, chunk_frames=2).orderBy("frame_no", "chirp", "antenna").collect()
    assert [r.frame_no for r in rows] == [f for f in range(5) for _ in range(4)]
    assert [x for r in rows for pair in zip(r.re, r.im) for x in pair] == list(range(120))


def test_file_names_round(spark):
    df = spark.createDataFrame([(3.03, 1), (2.3, 2), (1.999999, 3), (0.5, 4)], "ts double, frame_no long")
    name = lambda **how: [tuple(map(int, __import__("re").findall(r"\d+", r.n)[:2])) for r in df.select(rec.frame_file_name(**how).alias("n")).collect()]
    assert name() == [(3, 3000), (2, 30000), (2, 0), (0, 50000)]
    assert name(ref_compat=True)[0] == (3, 2999)


def test_split_packets_in_bounded_batches(spark, monkeypatch):
    """Rows of a chunk leave in several batches, of wanted kinds only; points without side information keep NULL."""
    import struct

    from rangelake.sources import tlv

    def packet(no, *parts):
        body = b"".join(struct.pack("<2I", kind, len(b)) + b for kind, b in parts)
        return tlv.MAGIC + struct.pack("<8I", 1, 40 + len(body), 2, no, 0, 2, len(parts), 0) + body

    pts, side = struct.pack("<8f", *range(8)), struct.pack("<2H", 7, 8)
    log = packet(1, (1, pts), (7, side), (6, b"\0" * 24)) + packet(2, (1, pts), (7, b"")) + packet(3, (1, pts), (7, side + side))
    chunks = spark.createDataFrame([("a", 0, len(log), log)] * 1, "capture string, start long, own_bytes long, content binary")
    monkeypatch.setattr(tlv, "BATCH_ROWS", 2)
    rows = tlv.split_packets(chunks)
    assert sorted(r.frame_no for r in rows.collect()) == [1, 1, 1, 2, 2, 3, 3]
    assert {r.tlv_type for r in tlv.split_packets(chunks, [1, 7]).collect()} == {1, 7}
    got = sorted((r.frame_no, r.obj, r.x, r.snr, r.noise) for r in tlv.points(rows).na.fill(-1).collect())
    assert got == [(1, 0, 0.0, 7, 8), (1, 1, 4.0, -1, -1), (2, 0, 0.0, -1, -1), (2, 1, 4.0, -1, -1), (3, 0, 0.0, 7, 8), (3, 1, 4.0, 7, 8)]


def test_points_read_the_logs_once(spark, capsys):
    from rangelake.sources import tlv

    chunks = spark.createDataFrame([("a", 0, 0, b"")], "capture string, start long, own_bytes long, content binary")
    tlv.points(tlv.split_packets(chunks)).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
