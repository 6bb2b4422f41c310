"""Queries: scans, decoding, frame assembly, profiles, logs and tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangelake.functions import units as un
from rangelake.operators import tracking as tk
from rangelake.plans import source_adapters as sa
from rangelake.plans.registry import CHANNELS, INT_FRAMES, POINTS, SENSOR_A, query, rnd
from rangelake.sources import adapters as ad
from rangelake.sources import iqfiles, packets as pk, profiles as pf, recordings as rec, tlv

_US = "SELECT user_id, event_id, epoch_us(ts) AS u FROM events"


@query("frame_names", f"""SELECT 'user' || user_id AS recording, CAST(event_id AS BIGINT) AS frame_no, round(u // 1000000 + ((u % 1000000) // 10) / 1e5, 5) AS ts FROM ({_US}) WHERE event_id % 5 < 3""")
def frame_names(spark, sf):
    out = rec.parse_names(sa.file_names(spark, sf, "bin"))
    return out.select("recording", "frame_no", F.round("ts", 5).alias("ts"))


@query("rejected_frame_names", f"""SELECT 'user' || user_id AS recording, COUNT(*) AS files FROM ({_US}) WHERE event_id % 5 >= 3 GROUP BY 1""")
def rejected_frame_names(spark, sf):
    return rec.rejected_names(sa.file_names(spark, sf, "bin")).groupBy("recording").agg(F.count(F.lit(1)).alias("files"))


@query("camera_names", f"""SELECT 'user' || user_id AS recording, CASE WHEN event_id % 5 < 3 THEN CAST(event_id AS BIGINT) END AS frame_no, round(u // 1000000 + ((u % 1000000) // 10) / 1e5, 5) AS ts FROM ({_US}) WHERE event_id % 5 <> 3""")
def camera_names(spark, sf):
    out = rec.parse_names_lenient(sa.file_names(spark, sf, "png"))
    return out.select("recording", "frame_no", F.round("ts", 5).alias("ts"))


@query("frame_order", "SELECT 'user' || user_id AS recording, CAST(event_id AS BIGINT) AS frame_no, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 10, event_id) - 1 AS frame_idx FROM events WHERE event_id % 5 < 3")
def frame_order(spark, sf):
    return rec.with_frame_index(rec.parse_names(sa.file_names(spark, sf, "bin"))).select("recording", "frame_no", "frame_idx")


@query("decoded_frames", f"SELECT frame_no, k AS i, CAST(samples[k + 1] AS BIGINT) AS v FROM ({INT_FRAMES}), (SELECT unnest(range(0, 64)) AS k) WHERE frame_no % 10 <> 7")
def decoded_frames(spark, sf):
    good, _ = rec.decode_frames(sa.frame_files(spark, sf))
    return good.select("frame_no", F.posexplode("samples").alias("i", "v")).select("frame_no", F.col("i").cast("long"), F.col("v").cast("long"))


_COMMANDS = "SELECT CAST(user_id AS BIGINT) AS sensor, epoch_us(ts) / 1e6 AS ts, event_type FROM events WHERE event_type IN ('purchase', 'error')"


@query("recorded_frames", f"""SELECT a.sensor, a.frame_no, printf('%010d_%05d_%012d', CAST(round(a.ts * 1e5) AS BIGINT) // 100000, CAST(round(a.ts * 1e5) AS BIGINT) % 100000, a.frame_no) AS file_name
FROM ({SENSOR_A}) a ASOF JOIN ({_COMMANDS}) c ON a.sensor = c.sensor AND a.ts >= c.ts WHERE c.event_type = 'purchase'""")
def recorded_frames(spark, sf):
    log = ad.sensor_b(spark, sf).drop("value").withColumnRenamed("frame_no", "seq")
    kinds = ad.table(spark, sf, "events").select(F.col("event_id").cast("long").alias("seq"), F.when(F.col("event_type") == "purchase", "on").otherwise("off").alias("command"))
    frames = ad.sensor_a(spark, sf).drop("value")
    return rec.recorded(frames, log.join(kinds, "seq"), ["sensor"]).select("sensor", "frame_no", "file_name")


@query("replay_selection", f"SELECT sensor, frame_no FROM ({SENSOR_A}) WHERE frame_no % 3 = 0")
def replay_selection(spark, sf):
    return rec.skip_frames(ad.sensor_a(spark, sf), 3).select("sensor", "frame_no")


_PROFILE = """SELECT c_custkey AS config, k % 3 + 1 AS tx, bit_count(CAST(15 - k % 2 * 8 AS INTEGER)) AS rx, k % 8 * 64 + 64 AS samples, k % 4 * 32 + 32 AS chirps,
 [600, 450, 400, 300, 225, 150][k % 6 + 1] AS lane_mbps, bit_count(CAST(15 - k % 2 * 12 AS INTEGER)) AS lanes, (1435384036 + k) * 3.6::DOUBLE / 67108864 AS start_freq, (k % 7 * 100 + 700) / 100.0::DOUBLE AS idle_time,
 (k % 5 * 500 + 4000) / 100.0::DOUBLE AS ramp_end_time, (k % 40 + 100) * 3.6e3::DOUBLE * 900 / 67108864 AS freq_slope, CAST(k % 10 * 1000 + 5000 AS DOUBLE) AS sample_rate, 50.0::DOUBLE AS frame_period_ms,
 CASE WHEN k % 3 + 1 > CASE WHEN k % 23 = 5 THEN 1 ELSE 3 END THEN 'more transmitters in the chirps than channels' WHEN k % 19 = 4 AND k % 3 > 0 THEN 'chirp count differs between transmitters'
  WHEN k % 29 = 6 THEN 'chirp count of the frame and of the chirps differ' END AS error FROM (SELECT c_custkey, c_custkey AS k FROM customer)"""
_P_INT = ["tx", "rx", "samples", "chirps", "lanes"]
_P_DBL = ["lane_mbps", "start_freq", "idle_time", "ramp_end_time", "freq_slope", "sample_rate", "frame_period_ms"]


@query("sensor_profiles", f"SELECT config, {', '.join(_P_INT)}, {', '.join(f'round(CAST({c} AS DOUBLE), 5) AS {c}' for c in _P_DBL)}, error FROM ({_PROFILE})")
def sensor_profiles(spark, sf):
    out = pf.parse_profile(sa.profile_texts(spark, sf))
    return out.select("config", *_P_INT, *[rnd(c, 5).alias(c) for c in _P_DBL], "error")


@query("profile_link_check", f"""SELECT config, CAST(ceil((samples * rx * 4 + 52) / 256.0) * 256 AS DOUBLE) AS lvds_bytes, round((idle_time + ramp_end_time) * lanes * lane_mbps / 8, 4) AS lvds_capacity FROM ({_PROFILE}) WHERE error IS NULL""")
def profile_link_check(spark, sf):
    ok = pf.parse_profile(sa.profile_texts(spark, sf)).filter(F.col("error").isNull())
    return un.lvds_budget(ok).select("config", "lvds_bytes", rnd("lvds_capacity").alias("lvds_capacity"))


@query("cli_profiles", """SELECT c_custkey AS config, bit_count(CAST(15 - k % 2 * 8 AS INTEGER)) AS rx, bit_count(CAST(7 - k % 3 AS INTEGER)) AS tx, k % 8 * 64 + 64 AS samples, k % 4 * 32 + 32 AS chirps,
 (k % 3 + 1) * (k % 4 * 32 + 32) // bit_count(CAST(7 - k % 3 AS INTEGER)) AS doppler_bins, CAST(pow(2, ceil(log2(k % 8 * 64 + 64))) AS BIGINT) AS range_bins,
 round(3e8 * (k % 10 * 1000 + 5000) * 1e3 / (2 * (k % 40 + 5) * 1e12 * (k % 8 * 64 + 64)), 5) AS range_resolution_m, round(300 * 0.9::DOUBLE * (k % 10 * 1000 + 5000) / (2 * (k % 40 + 5) * 1e3), 4) AS max_range_m,
 round(3e8 / (4 * 77 * 1e9 * (k % 9 + 7 + k % 5 * 5 + 40) * 1e-6 * bit_count(CAST(7 - k % 3 AS INTEGER))), 4) AS max_velocity_mps,
 CASE WHEN k % 2 = 0 THEN 'raw' ELSE 'multi' END AS logging_mode, CASE WHEN k % 2 = 0 THEN '' WHEN k % 5 IN (1, 4) THEN 'HW' WHEN k % 5 = 0 THEN 'SW' ELSE '' END AS adc_session,
 CASE WHEN k % 2 = 0 AND k % 4 <> 0 AND k % 3 % 2 = 1 THEN 'stream settings do not fit raw mode' WHEN k % 2 = 1 AND k % 5 = 0 AND k % 3 % 2 <> 1 THEN 'sub-frame 0 streams nothing' END AS link_error
FROM (SELECT c_custkey, c_custkey AS k FROM customer)""")
def cli_profiles(spark, sf):
    out = pf.parse_cli_profile(sa.cli_texts(spark, sf))
    return out.select(
        "config", "rx", "tx", "samples", "chirps", "doppler_bins", "range_bins", rnd("range_resolution_m", 5).alias("range_resolution_m"),
        rnd("max_range_m").alias("max_range_m"), rnd("max_velocity_mps").alias("max_velocity_mps"), "logging_mode", "adc_session", "link_error",
    )


@query("board_settings", "SELECT c_custkey AS config, CASE WHEN c_custkey % 2 = 0 THEN 'raw' ELSE 'multi' END AS mode, c_custkey % 4 + 1 AS format, c_custkey % 100 AS delay_us FROM customer")
def board_settings(spark, sf):
    k = F.col("c_custkey")
    text = F.to_json(F.struct(F.struct(
        F.when(k % 2 == 0, "raw").otherwise("multi").alias("dataLoggingMode"), F.lit("LVDSCapture").alias("dataTransferMode"), F.lit("ethernetStream").alias("dataCaptureMode"),
        F.lit(1).alias("lvdsMode"), (k % 4 + 1).alias("dataFormatMode"), (k % 100).alias("packetDelay_us"),
    ).alias("DCA1000Config")))
    out = pf.parse_board(ad.table(spark, sf, "customer").select(k.alias("config"), text.alias("text")))
    return out.select("config", F.col("dataLoggingMode").alias("mode"), F.col("dataFormatMode").cast("long").alias("format"), F.col("packetDelay_us").cast("long").alias("delay_us"))


_SEQ = "SELECT CAST(user_id AS BIGINT) AS capture, CAST(event_id AS BIGINT) AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events"
_KEPT = f"SELECT * FROM ({_SEQ}) WHERE id % 11 <> 0 OR seq = 1"


def _packets(spark, sf):
    return pk.decode_packets(sa.packet_records(spark, sf))


@query("packet_headers", f"SELECT capture, seq, seq * 16 AS byte_count, COUNT(*) AS copies FROM (SELECT * FROM ({_KEPT}) UNION ALL SELECT * FROM ({_KEPT}) WHERE id % 13 = 0) GROUP BY 1, 2, 3")
def packet_headers(spark, sf):
    return _packets(spark, sf).groupBy("capture", "seq", "byte_count").agg(F.count(F.lit(1)).alias("copies"))


# Frames of 20 values over packets of 8: borders fall inside packets.
@query("assembled_frames", f"""WITH k AS ({_KEPT}), b AS (SELECT capture, MAX(seq) AS n FROM k GROUP BY 1), g AS (SELECT capture, unnest(range(0, n * 8 // 20)) AS frame_no FROM b),
v AS (SELECT g.capture, g.frame_no, j, (g.frame_no * 20 + j) // 8 + 1 AS seq, (g.frame_no * 20 + j) % 8 AS o FROM g, (SELECT unnest(range(0, 20)) AS j)),
x AS (SELECT v.capture, v.frame_no, j, v.seq, CASE WHEN k.id IS NULL THEN 0 ELSE (k.id + o) % 1000 END AS s, k.id IS NULL AS hole FROM v LEFT JOIN k ON k.capture = v.capture AND k.seq = v.seq)
SELECT capture, frame_no, COUNT(DISTINCT CASE WHEN hole THEN seq END) AS missing_packets, CAST(SUM(s * (j + 1)) AS BIGINT) AS checksum FROM x GROUP BY 1, 2""")
def assembled_frames(spark, sf):
    frames = pk.decode_int16(pk.assemble_frames(_packets(spark, sf), 40, sa.PAYLOAD))
    total = F.aggregate(F.transform("samples", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return frames.select("capture", "frame_no", "missing_packets", total.alias("checksum"))


@query("packet_loss", f"""SELECT capture, first_seq, last_seq, received, last_seq - first_seq + 1 AS expected, round((last_seq - first_seq + 1 - received) * 100.0::DOUBLE / (last_seq - first_seq + 1), 4) AS loss_percent
FROM (SELECT capture, MIN(seq) AS first_seq, MAX(seq) AS last_seq, COUNT(DISTINCT seq) AS received FROM ({_KEPT}) GROUP BY 1)""")
def packet_loss(spark, sf):
    return pk.packet_loss(_packets(spark, sf)).withColumn("loss_percent", rnd("loss_percent"))


@query("packet_gaps", f"SELECT capture, p + 1 AS gap_start, seq - 1 AS gap_end FROM (SELECT capture, seq, lag(seq) OVER (PARTITION BY capture ORDER BY seq) AS p FROM ({_KEPT})) WHERE seq - p > 1")
def packet_gaps(spark, sf):
    return pk.packet_gaps(_packets(spark, sf))


@query("clean_capture", f"""WITH k AS (SELECT * FROM ({_SEQ}) WHERE id % 9 <> 0), a AS (SELECT s.capture, s.seq, MIN(k.seq) AS src FROM ({_SEQ}) s JOIN k ON k.capture = s.capture AND k.seq >= s.seq GROUP BY 1, 2),
z AS (SELECT a.capture, a.seq, a.src > a.seq AS lost, k.id % 5 * 2 + 2 AS size, CASE WHEN a.src > a.seq THEN 0 ELSE k.id % 251 END AS fill FROM a JOIN k ON k.capture = a.capture AND k.seq = a.src)
SELECT capture, seq, lost, size, fill, CAST(SUM(size) OVER (PARTITION BY capture ORDER BY seq) - size AS BIGINT) AS byte_offset FROM z""")
def clean_capture(spark, sf):
    out = pk.filled(pk.clean_capture(pk.split_card_log(sa.card_logs(spark, sf))))
    return out.select(
        "capture", "seq", "lost", F.octet_length("payload").cast("long").alias("size"), pk.le_unsigned(F.col("payload"), 0, 1).alias("fill"), F.col("offset").cast("long").alias("byte_offset")
    )


@query("offset_binary_cells", f"""SELECT capture, k // 32 AS frame_no, (k % 32) // 16 AS chirp, (k % 16) // 8 AS antenna, (k % 8) // 2 AS sample, CAST(MAX(CASE WHEN k % 2 = 0 THEN v END) AS DOUBLE) AS re, CAST(MAX(CASE WHEN k % 2 = 1 THEN v END) AS DOUBLE) AS im
FROM (SELECT frame_no AS capture, k, samples[k + 1] AS v FROM ({INT_FRAMES}), (SELECT unnest(range(0, 64)) AS k)) GROUP BY 1, 2, 3, 4, 5""")
def offset_binary_cells(spark, sf):
    from rangelake.operators.layout import long_form

    return long_form(pk.decode_offset_binary(sa.offset_binary_files(spark, sf), 2, 2, 4), "sample")


def _tlvs(spark, sf, *kinds):
    return tlv.split_packets(sa.tlv_logs(spark, sf), kinds or None)


# A wrong length fails where another packet follows in the log, except right before its end.
_ORD = "SELECT l_orderkey AS no, COUNT(*) AS n FROM lineitem GROUP BY 1"
_GOOD = f"SELECT no, n FROM ({_ORD}) WHERE no % 17 <> 5"


@query("tlv_packets", f"SELECT no AS frame_no, no % 4 AS sub_frame, n AS num_obj, (no * 1000) % 4294967296 AS cpu_cycles, t AS tlv_type FROM ({_GOOD}), (SELECT unnest([1, 7, 2, 4, 5, 6, 9]) AS t)")
def tlv_packets(spark, sf):
    return _tlvs(spark, sf).select("frame_no", "sub_frame", "num_obj", "cpu_cycles", "tlv_type")


_PT = """SELECT l_orderkey AS frame_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus, l_suppkey % 500) - 1 AS obj,
 CAST(l_quantity AS DOUBLE) - 25 AS x, CAST(floor(l_extendedprice / 1000) AS DOUBLE) AS y, CAST(l_partkey % 7 - 3 AS DOUBLE) AS z, round(CAST(l_discount AS DOUBLE) * 100) - 5 AS velocity, l_suppkey % 500 AS snr, l_partkey % 300 AS noise FROM lineitem WHERE l_orderkey % 17 <> 5"""


@query("tlv_points", f"""SELECT frame_no, obj, x, y, z, velocity + 0.0 AS velocity, snr, noise, round(sqrt(x * x + y * y + z * z), 4) AS range, round(CASE WHEN y = 0 THEN CASE WHEN x >= 0 THEN 90 ELSE -90 END ELSE degrees(atan(x / y)) END, 4) + 0.0 AS azimuth FROM ({_PT})""")
def tlv_points(spark, sf):
    p = tlv.points(_tlvs(spark, sf, tlv.POINTS, tlv.SIDE_INFO))
    return p.select("frame_no", "obj", "x", "y", "z", (F.col("velocity") + 0.0).alias("velocity"), "snr", "noise", rnd("range").alias("range"), rnd("azimuth").alias("azimuth"))


@query("tlv_stats", f"SELECT no AS frame_no, no % 97 AS inter_frame_time_us, no % 89 AS transmit_time_us, no % 79 AS active_load_pct, no % 73 AS inter_frame_load_pct FROM ({_GOOD})")
def tlv_stats(spark, sf):
    return tlv.stats(_tlvs(spark, sf, tlv.STATS)).select("frame_no", "inter_frame_time_us", "transmit_time_us", "active_load_pct", "inter_frame_load_pct")


@query("tlv_temperature", f"SELECT no AS frame_no, no % 2 AS valid, no * 50 AS time_ms, no % 40 - 20 AS rx0, no % 40 - 13 AS pm, no % 40 - 11 AS dig1 FROM ({_GOOD})")
def tlv_temperature(spark, sf):
    return tlv.temperature(_tlvs(spark, sf, tlv.TEMPERATURE)).select("frame_no", "valid", "time_ms", "rx0", "pm", "dig1")


@query("tlv_range_profile", f"SELECT no AS frame_no, k AS range_bin, CAST((k + no) % 65536 AS DOUBLE) AS level FROM ({_GOOD}), (SELECT unnest(range(0, 8)) AS k)")
def tlv_range_profile(spark, sf):
    p = tlv.profile(_tlvs(spark, sf, tlv.RANGE_PROFILE)).select("frame_no", F.posexplode("profile").alias("range_bin", "level"))
    return p.withColumn("range_bin", F.col("range_bin").cast("long"))


@query("tlv_azimuth_map", f"""SELECT no AS frame_no, r AS range_bin, a AS antenna, CAST(((r * 8 + a) * 6 + 3 + no) % 1000 - 500 AS DOUBLE) AS re, CAST(((r * 8 + a) * 6 + no) % 1000 - 500 AS DOUBLE) AS im
FROM ({_GOOD}), (SELECT unnest(range(0, 2)) AS r), (SELECT unnest(range(0, 8)) AS a)""")
def tlv_azimuth_map(spark, sf):
    from rangelake.operators.layout import long_form

    return long_form(tlv.azimuth_map(_tlvs(spark, sf, tlv.AZIMUTH_MAP)), "antenna").select("frame_no", "range_bin", "antenna", "re", "im")


@query("tlv_range_doppler", f"""SELECT no AS frame_no, k // 4 AS range_bin, (k % 4 + 2) % 4 AS doppler_bin, (k * 5 + no) % 12000 AS value FROM ({_GOOD}), (SELECT unnest(range(0, 8)) AS k)""")
def tlv_range_doppler(spark, sf):
    out = tlv.range_doppler_map(_tlvs(spark, sf, tlv.RANGE_DOPPLER), 4, None, True)
    return out.select("frame_no", "range_bin", "doppler_bin", "value")


@query("iq_file_pairs", """SELECT vec_id // 16 AS cpi, ((vec_id % 16) // 8) * 32 + i AS n, round(MAX(CASE WHEN vec_id % 8 = 3 THEN CAST(embedding[2*i+1] AS DOUBLE) END), 6) AS ref_re, round(MAX(CASE WHEN vec_id % 8 = 6 THEN CAST(embedding[2*i+2] AS DOUBLE) END), 6) AS surv_im
FROM embeddings, (SELECT unnest(range(0, 32)) AS i) WHERE vec_id // 16 IN (SELECT vec_id // 16 FROM embeddings GROUP BY 1 HAVING COUNT(DISTINCT vec_id % 8) = 8) GROUP BY 1, 2 HAVING ref_re IS NOT NULL""")
def iq_file_pairs(spark, sf):
    out = iqfiles.decode_iq(sa.iq_files(spark, sf))
    return out.select("cpi", F.posexplode(F.arrays_zip("ref_re", "surv_im")).alias("n", "z")).filter("z.ref_re IS NOT NULL").select("cpi", F.col("n").cast("long"), rnd("z.ref_re", 6).alias("ref_re"), rnd("z.surv_im", 6).alias("surv_im"))


# --- tracking ------------------------------------------------------------------------


@query("unrolled_velocity", f"""SELECT frame_no, x, y, vel, round(m + sign(e - m) * floor((abs(e - m) + 3.0) / 6.0) * 6.0, 4) + 0.0 AS velocity FROM (SELECT frame_no, x, y, vel, x / 5.0::DOUBLE AS e, vel * 0.37::DOUBLE AS m FROM ({POINTS}))""")
def unrolled_velocity(spark, sf):
    p = ad.points(spark, sf)
    out = p.withColumn("velocity", tk.unroll_velocity(F.lit(3.0), F.col("x") / 5.0, F.col("vel") * 0.37))
    return out.select("frame_no", "x", "y", "vel", rnd("velocity").alias("velocity"))


# Predicted tracks: the first three line numbers of each order's neighbour block.
_PRED = "SELECT l_orderkey // 4 AS block, CAST(l_linenumber AS BIGINT) AS uid, AVG(CAST(l_quantity AS DOUBLE)) AS h0, AVG(CAST(l_discount AS DOUBLE)) * 10 AS h1, AVG(CAST(l_tax AS DOUBLE)) * 10 AS h2, 0.05171::DOUBLE * MIN(l_linenumber) AS ld FROM lineitem GROUP BY 1, 2"
_MEAS = "SELECT l_orderkey // 4 AS block, CAST(l_orderkey AS BIGINT) AS frame_no, CAST(l_quantity AS DOUBLE) AS r, CAST(l_discount AS DOUBLE) * 10 AS a, CAST(l_tax AS DOUBLE) * 10 AS d FROM lineitem"


@query("associated_points", f"""WITH m AS ({_MEAS}), t AS ({_PRED}), q AS (SELECT m.*, t.uid, 0.04373::DOUBLE * pow(r - h0, 2) + 4.0137::DOUBLE * pow(a - h1, 2) + 2.0219::DOUBLE * pow(d - h2, 2) AS chi, ld FROM m JOIN t ON m.block = t.block),
b AS (SELECT block, frame_no, r, a, d, MIN(CASE WHEN chi < 4 THEN chi + ld END) AS score FROM q GROUP BY 1, 2, 3, 4, 5)
SELECT frame_no, round(r, 4) AS r, round(a, 4) AS a, round(d, 4) AS d, round(score, 4) + 0.0 AS score FROM (SELECT m.frame_no, m.r, m.a, m.d, b.score FROM m JOIN b ON m.block = b.block AND m.frame_no = b.frame_no AND m.r = b.r AND m.a = b.a AND m.d = b.d)""")
def associated_points(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    num = lambda c: F.col(c).cast("double")
    pred = li.groupBy(F.expr("l_orderkey div 4").alias("block"), F.col("l_linenumber").cast("long").alias("uid")).agg(
        F.array(F.avg(num("l_quantity")), F.avg(num("l_discount")) * 10, F.avg(num("l_tax")) * 10).alias("h"), (F.min("l_linenumber") * 0.05171).alias("log_det"),
    ).withColumns({"ec": F.array(*[F.lit(v) for v in (0.04373, 0.0, 0.0, 0.0, 4.0137, 0.0, 0.0, 0.0, 2.0219)]), "g": F.lit(4.0)})
    meas = li.select(
        F.expr("l_orderkey div 4").alias("block"), F.col("l_orderkey").cast("long").alias("frame_no"), num("l_quantity").alias("range"),
        (num("l_discount") * 10).alias("angle"), (num("l_tax") * 10).alias("doppler"),
    )
    out = tk.associate(meas, pred, ["block"])
    return out.select("frame_no", rnd("range").alias("r"), rnd("angle").alias("a"), rnd("doppler").alias("d"), rnd("score").alias("score"))


# Tracks: one for each part, with states and counters from sums over its lines.
_TRACKS = """SELECT CAST(l_partkey AS BIGINT) AS uid, (AVG(CAST(l_quantity AS DOUBLE)) - 20) * 1.01371::DOUBLE AS x, AVG(CAST(l_extendedprice AS DOUBLE)) * 0.00102371::DOUBLE + 1 AS y, AVG(CAST(l_discount AS DOUBLE)) * 40.0371::DOUBLE AS vx, AVG(CAST(l_tax AS DOUBLE)) * 40.0371::DOUBLE AS vy,
 MIN(CAST(l_quantity AS DOUBLE)) / 10 AS ax, MAX(CAST(l_quantity AS DOUBLE)) / 20 AS ay, CASE WHEN l_partkey % 5 = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE END AS variance, COUNT(*) AS n,
 CAST(MAX(l_linenumber) AS BIGINT) AS age, CAST(SUM(l_linenumber) % 7 AS BIGINT) AS misses, CAST(MIN(l_linenumber) AS BIGINT) AS hits, CASE WHEN l_partkey % 3 = 0 THEN 'active' ELSE 'detection' END AS state FROM lineitem GROUP BY l_partkey"""


def _tracks(spark, sf):
    num = lambda c: F.col(c).cast("double")
    t = ad.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("uid")).agg(
        F.array(
            (F.avg(num("l_quantity")) - 20) * 1.01371, F.avg(num("l_extendedprice")) * 0.00102371 + 1, F.avg(num("l_discount")) * 40.0371, F.avg(num("l_tax")) * 40.0371,
            F.min(num("l_quantity")) / 10, F.max(num("l_quantity")) / 20,
        ).alias("s"),
        F.count(F.lit(1)).alias("n"), F.max("l_linenumber").cast("long").alias("age"), (F.sum("l_linenumber") % 7).cast("long").alias("misses"), F.min("l_linenumber").cast("long").alias("hits"),
    )
    diagonal = [F.lit(0.5 + i // 7 * 0.25) if i % 7 == 0 else F.lit(0.0) for i in range(36)]
    return t.withColumns({
        "p": F.array(*diagonal), "variance": F.when(F.col("uid") % 5 == 0, 0.0).otherwise(1.25),
        "state": F.when(F.col("uid") % 3 == 0, "active").otherwise("detection"),
    })


@query("predicted_tracks", f"""WITH t AS ({_TRACKS}), q AS (SELECT *, CASE WHEN variance = 0 THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS d FROM t),
m AS (SELECT *, x + d * vx + d * d / 2 * ax AS px, y + d * vy + d * d / 2 * ay AS py, vx + d * ax AS pvx, vy + d * ay AS pvy FROM q)
SELECT uid, round(px, 4) + 0.0 AS x, round(py, 4) + 0.0 AS y, round(pvx, 4) + 0.0 AS vx, round(ax, 4) + 0.0 AS ax, round(sqrt(px * px + py * py), 4) AS range, round(atan2(px, py), 4) + 0.0 AS angle,
 round((px * pvx + py * pvy) / sqrt(px * px + py * py), 4) + 0.0 AS doppler, round(0.5 + d * d * 1.0 + pow(d, 4) / 4 * 1.5 + variance * pow(d, 4) / 4, 6) AS p_xx, round(d * 1.0 + pow(d, 3) / 2 * 1.5 + variance * pow(d, 3) / 2, 6) AS p_xv,
 round(CASE WHEN d > 0 THEN 1.25 + d * d * 1.75 + variance * d * d ELSE 1.25 END, 6) AS p_vy FROM m""")
def predicted_tracks(spark, sf):
    t = tk.predict(_tracks(spark, sf), 0.1)
    s, p, h = F.col("s"), F.col("p"), F.col("h")
    return t.select(
        "uid", *[rnd(s[i], 4).alias(n) for i, n in ((0, "x"), (1, "y"), (2, "vx"), (4, "ax"))], *[rnd(h[i], 4).alias(n) for i, n in enumerate(("range", "angle", "doppler"))],
        rnd(p[0], 6).alias("p_xx"), rnd(p[2], 6).alias("p_xv"), rnd(p[21], 6).alias("p_vy"),
    )


@query("gate_sizes", f"""WITH t AS ({_TRACKS}), e AS (SELECT uid, variance, sqrt(x * x + y * y) AS r, 1 + n / 8.0::DOUBLE AS a, 0.3::DOUBLE AS b, 2 + age / 4.0::DOUBLE AS c FROM t),
l AS (SELECT *, sqrt(a) AS l00, b / sqrt(a) AS l10, sqrt(c - b * b / a) AS l11 FROM e)
SELECT uid, round(CASE WHEN variance = 0 THEN 1.0 ELSE least(pow(4.0 / (4 * pi() / 3 / sqrt(a * c * 1.5)), 2 / 3.0::DOUBLE), 9.0 / (4 * (1 / a + pow(l10 / (l00 * l11), 2))), pow(2.0 / (2 * r * tan(1 / l11)), 2), 16.0 * 1.5 / 4) END, 5) AS g FROM l""")
def gate_sizes(spark, sf):
    t = _tracks(spark, sf).withColumn("h", tk.spherical(F.col("s")))
    a, c = 1 + F.col("n") / 8.0, 2 + F.col("age") / 4.0
    zero = F.lit(0.0)
    t = t.withColumn("ec", F.array(a, F.lit(0.3), zero, F.lit(0.3), c, zero, zero, zero, F.lit(1.5)))
    return tk.gate_size(t, 4.0, 3.0, 2.0, 4.0).select("uid", rnd("g", 5).alias("g"))


@query("track_states", f"""WITH t AS (SELECT uid, age, hits, misses, state, CASE WHEN n % 3 = 0 THEN 0 ELSE n END AS n FROM ({_TRACKS})),
m AS (SELECT *, CASE WHEN n = 0 THEN misses + 1 WHEN state = 'active' OR n > 25 THEN 0 ELSE misses END AS m2,
 CASE WHEN state = 'active' THEN hits WHEN n > 25 THEN hits + 1 WHEN n = 0 THEN greatest(0, hits - 1) ELSE hits END AS h2 FROM t)
SELECT uid, m2 AS misses, h2 AS hits, CASE WHEN n = 0 AND state = 'active' AND m2 > least(5, age) THEN 'free' WHEN n = 0 AND state = 'detection' AND m2 > 3 THEN 'free'
 WHEN state = 'detection' AND n > 25 AND h2 > 1 THEN 'active' ELSE state END AS state FROM m""")
def track_states(spark, sf):
    t = _tracks(spark, sf).withColumn("n", F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("n")))
    return tk.life_cycle(t, hits_to_start=1, strong=25).select("uid", "misses", "hits", "state")


@query("measured_groups", """SELECT sensor, frame_no, COUNT(*) AS n, round(AVG(range), 4) AS range, round(AVG(angle), 5) + 0.0 AS angle, round(var_pop(range * 1.000371::DOUBLE), 5) + 0.0 AS spread_rr, round(covar_pop(range, doppler), 5) + 0.0 AS spread_rd
FROM (SELECT CAST(l_suppkey AS BIGINT) AS sensor, CAST(l_linenumber AS BIGINT) AS frame_no, CAST(l_quantity AS DOUBLE) AS range, CAST(l_discount AS DOUBLE) AS angle, CAST(l_tax AS DOUBLE) * 50.0371::DOUBLE AS doppler FROM lineitem) GROUP BY 1, 2""")
def measured_groups(spark, sf):
    num = lambda c: F.col(c).cast("double")
    pts = ad.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("sensor"), F.col("l_linenumber").cast("long").alias("frame_no"), num("l_quantity").alias("range"), num("l_discount").alias("angle"), (num("l_tax") * 50.0371).alias("doppler"),
    )
    out = tk.measure(pts, ["sensor", "frame_no"])
    return out.select("sensor", "frame_no", "n", rnd(F.col("mean")[0], 4).alias("range"), rnd(F.col("mean")[1], 5).alias("angle"), rnd(F.col("moment")[0] * 1.000371**2, 5).alias("spread_rr"), rnd(F.col("moment")[2], 5).alias("spread_rd"))


@query("settled_velocities", f"""WITH t AS (SELECT uid, sqrt(x * x + y * y) AS r, (x * vx + y * vy) / sqrt(x * x + y * y) AS d, vx AS m, age, ['init', 'rate', 'tracking', 'locked'][uid % 4 + 1] AS phase, vy - 1 AS rate FROM ({_TRACKS})),
c AS (SELECT *, (r - 10) / (age * 2.0) AS change FROM t), u AS (SELECT *, CASE WHEN phase IN ('rate', 'tracking') THEN 0.5 * rate + 0.5 * change ELSE rate END AS r2 FROM c),
a AS (SELECT *, CASE WHEN phase = 'locked' THEN d ELSE r2 END AS aim FROM u),
w AS (SELECT *, CASE WHEN phase = 'init' THEN r2 ELSE m + sign(aim - m) * floor((abs(aim - m) + 1.5) / 3) * 3 END AS v FROM a)
SELECT uid, round(v, 4) + 0.0 AS v, round(r2, 4) + 0.0 AS rate, CASE WHEN phase = 'init' THEN 'rate' WHEN phase = 'rate' AND r2 <> 0 AND abs((change - r2) / r2) < 0.1 THEN 'tracking' WHEN phase = 'tracking' AND v <> 0 AND abs((d - v) / v) < 0.1 THEN 'locked' ELSE phase END AS phase FROM w""")
def settled_velocities(spark, sf):
    t = _tracks(spark, sf).withColumn("h", tk.spherical(F.col("s")))
    t = t.withColumns({
        "mean": F.array(F.col("h")[0], F.lit(0.0), F.col("s")[2]), "first_range": F.lit(10.0), "frames": F.col("age"), "rate": F.col("s")[3] - 1,
        "phase": F.element_at(F.array(*map(F.lit, ("init", "rate", "tracking", "locked"))), (F.col("uid") % 4 + 1).cast("int")),
    })
    return tk.settle_velocity(t, 1.5, 2.0).select("uid", rnd("v", 4).alias("v"), rnd("rate", 4).alias("rate"), "phase")


@query("tracker_sessions", "SELECT sensor, CAST((pos // 30) * 50 AS BIGINT) AS session, COUNT(*) AS frames FROM (SELECT CAST(user_id AS BIGINT) AS sensor, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events) GROUP BY 1, 2")
def tracker_sessions(spark, sf):
    pts = tk.with_sessions(sa.tracker_points(spark, sf), ["sensor"], 6)
    return pts.select("sensor", "session", "frame_no").distinct().groupBy("sensor", "session").agg(F.count(F.lit(1)).alias("frames"))
