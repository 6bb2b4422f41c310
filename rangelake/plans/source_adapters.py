"""Files and packets in the sensors' own formats, encoded by Spark from the supplied tables."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangelake.operators.ordered import with_position
from rangelake.sources import adapters as ad
from rangelake.sources.iqfiles import NOT_RECORDED
from rangelake.sources.tlv import MAGIC


def le_hex(v: Column, size: int) -> Column:
    """Hex digits of an integer in ``size`` little-endian bytes."""
    digits = F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit((1 << (8 * size)) - 1).cast("long"))), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])


def frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame files of integer payloads: path, payload. Every tenth payload is empty."""
    frames = ad.int_frames(spark, sf_dir)
    body = F.unhex(F.array_join(F.transform("samples", lambda v: le_hex(v, 2)), ""))
    return frames.select("frame_no", F.when(F.col("frame_no") % 10 == 7, F.unhex(F.lit(""))).otherwise(body).alias("payload"))


def file_names(spark: SparkSession, sf_dir: str, extension: str) -> DataFrame:
    """File paths named after events, some of them malformed."""
    e = ad.table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    good = F.format_string("%010d_%05d_%012d", F.expr("floor(u / 1000000)"), F.expr("floor(u % 1000000 / 10)"), F.col("event_id"))
    bad = F.format_string("%d_%d_f%d", F.expr("floor(u / 1000000)"), F.expr("floor(u % 1000000 / 10)"), F.col("event_id"))
    short = F.format_string("still_%d", F.col("event_id"))
    name = F.when(F.col("event_id") % 5 == 4, bad).when(F.col("event_id") % 5 == 3, short).otherwise(good)
    return e.withColumn("u", us).select(F.concat(F.lit("/data/user"), F.col("user_id"), F.lit("/"), name, F.lit(f".{extension}")).alias("path"))


PAYLOAD = 16


def packet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of eight int16 values per event: capture, arrival, body. Some are lost, some repeated, none in order."""
    e = with_position(
        ad.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("capture"), F.col("event_id").cast("long").alias("id")),
        ["capture"], ["id"],
    ).withColumn("seq", F.col("_pos") + 1)
    kept = e.filter((F.col("id") % 11 != 0) | (F.col("seq") == 1))
    copies = kept.withColumn("copy", F.explode(F.when(F.col("id") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    values = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (F.col("id") + k) % 1000)
    body = F.unhex(F.concat(
        le_hex(F.col("seq"), 4), le_hex(F.col("seq") * PAYLOAD, 6), F.array_join(F.transform(values, lambda v: le_hex(v, 2)), "")
    ))
    return copies.select("capture", (F.col("copy") * 1_000_000_000 + F.col("id") * 7919 % 10007).alias("arrival"), body.alias("body"))


def card_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card captures (capture, content): packets of 2..10 bytes, one in nine lost, neighbours swapped."""
    e = with_position(
        ad.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("capture"), F.col("event_id").cast("long").alias("id")),
        ["capture"], ["id"],
    ).withColumn("seq", F.col("_pos") + 1)
    size = F.col("id") % 5 * 2 + 2
    body = F.concat(le_hex(F.col("seq"), 4), le_hex(size, 4), le_hex(F.col("seq") * 10, 6), F.repeat(le_hex(F.col("id") % 251, 1), size.cast("int")))
    swapped = F.col("seq") + F.when(F.col("seq") % 4 == 1, 1).when(F.col("seq") % 4 == 2, -1).otherwise(0)
    packed = e.filter((F.col("id") % 9 != 0)).groupBy("capture").agg(F.array_sort(F.collect_list(F.struct(swapped.alias("o"), body.alias("b")))).alias("p"))
    return packed.select("capture", F.unhex(F.array_join("p.b", "")).alias("content"))


def offset_binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset-binary captures of integer payloads: capture, content."""
    body = F.array_join(F.transform("samples", lambda v: le_hex(v + 32768, 2)), "")
    return ad.int_frames(spark, sf_dir).select(F.col("frame_no").alias("capture"), F.unhex(body).alias("content"))


def _tlv_packet(frame: pa.Array, pts: pa.Array) -> pa.Array:
    """Packets with points, side information, statistics, temperature, profile and maps of one order."""
    rows = pts.flatten()
    field = {f.name: rows.field(i) for i, f in enumerate(rows.type)}
    if frame.null_count or any(field[c].null_count for c in ("snr", "noise")):
        raise ValueError("an order or a part without a number")
    no = frame.to_numpy(zero_copy_only=False).astype(np.int64)
    if len(no) and (no.min() < 0 or no.max() * 50 >= 1 << 32):
        raise OverflowError("an order's number does not fit its packet")
    # what depends on the number alone is built for all rows at once: sections of fixed size side by side
    raw = lambda v, dtype: np.ascontiguousarray(v, dtype).view(np.uint8).reshape(len(no), -1)
    at = no[:, None]
    sections = [
        (2, raw((np.arange(8) + at) % 65536, "<u2")),
        (4, raw((np.arange(2 * 8 * 2) * 3 + at) % 1000 - 500, "<i2")),
        (5, raw((np.arange(2 * 4) * 5 + at) % 12000, "<u2")),
        (6, raw(np.stack([no % 97, no % 89, no % 83, no * 0, no % 79, no % 73], axis=1), "<u4")),
        (9, np.hstack([raw(at % 2, "<i4"), raw(at * 50, "<u4"), raw(np.arange(10) + at % 40 - 20, "<i2")])),
    ]
    head = lambda kind, size: np.broadcast_to(np.frombuffer(struct.pack("<2I", kind, size), np.uint8), (len(no), 8))
    fixed = np.hstack([part for kind, s in sections for part in (head(kind, s.shape[1]), s)])
    number = lambda *names, dtype: np.stack([field[c].to_numpy(zero_copy_only=False) for c in names], axis=1).astype(dtype).tobytes()
    place, side, tail = number("x", "y", "z", "v", dtype="<f4"), number("snr", "noise", dtype="<u2"), fixed.tobytes()
    cuts, wide = (pts.offsets.to_numpy() - pts.offsets[0].as_py()).tolist(), fixed.shape[1]
    out = []
    for k, (i, a, b) in enumerate(zip(no.tolist(), cuts[:-1], cuts[1:])):
        n = b - a
        size = 40 + 16 + 20 * n + wide + (1 if i % 17 == 5 else 0)  # some packets announce a wrong length
        out.append(b"".join((
            MAGIC, struct.pack("<8I", 0x03050004, size, 0x000A1843, i, i * 1000 % (1 << 32), n, 2 + len(sections), i % 4),
            struct.pack("<2I", 1, 16 * n), place[16 * a : 16 * b], struct.pack("<2I", 7, 4 * n), side[4 * a : 4 * b], tail[wide * k : wide * (k + 1)],
        )))
    return pa.array(out, pa.binary())


def _logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logs of the orders' rows, which come in order. The rows of the last log wait for the next batch, so a task holds few of them."""

    def written(rows: pa.Table) -> pa.RecordBatch:
        if rows.column("no").null_count:
            raise ValueError("an order or a part without a number")
        no, fields = rows.column("no").to_numpy(), rows.column_names[1:]
        starts = np.flatnonzero(np.diff(no, prepend=no[0] - 1))
        parts = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in fields], names=fields)
        packets = _tlv_packet(pa.array(no[starts]), pa.ListArray.from_arrays(pa.array([*starts, len(no)], pa.int32()), parts)).to_pylist()
        capture = no[starts] // 64
        cuts = [*np.flatnonzero(np.diff(capture, prepend=capture[0] - 1)), len(capture)]
        content = pa.array([b"\2\1\4\3\4" + b"".join(packets[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
        zero = pa.array(np.zeros(len(content), np.int64))
        size = pc.binary_length(content).cast(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(capture[cuts[:-1]]), zero, content, size], names=["capture", "start", "content", "own_bytes"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        capture = batch.column("no").fill_null(-1).to_numpy(zero_copy_only=False) // 64
        last = int(np.searchsorted(capture, capture[-1]))
        if last or (held and held[0].column("no")[0].as_py() // 64 != capture[0]):
            # what was held is whole where this batch begins with another log
            yield written(pa.Table.from_batches([*held, *([batch.slice(0, last)] if last else [])]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield written(pa.Table.from_batches(held))


def tlv_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output logs of a block of orders each: capture, start, own_bytes, content; stray bytes in front.

    The rows of a log meet in one shuffle and are sorted, so neither rows nor packets are gathered into arrays.
    """
    li = ad.table(spark, sf_dir, "lineitem")
    values = [
        (F.col("l_quantity").cast("double") - 25).alias("x"),
        F.floor(F.col("l_extendedprice").cast("double") / 1000).cast("double").alias("y"), (F.col("l_partkey") % 7 - 3).cast("double").alias("z"),
        (F.round(F.col("l_discount").cast("double") * 100) - 5).alias("v"), (F.col("l_suppkey") % 500).alias("snr"), (F.col("l_partkey") % 300).alias("noise"),
    ]
    names = ["x", "y", "z", "v", "snr", "noise"]
    rows = li.select(F.col("l_orderkey").cast("long").alias("no"), *ad.BIG_ORDER[1:], *values).repartition(F.expr("no div 64"))
    return rows.sortWithinPartitions("no", *ad.BIG_ORDER[1:], *names).select("no", *names).mapInArrow(
        _logs, "capture long, start long, content binary, own_bytes long"
    )


def _npy(re: pa.Array, im: pa.Array) -> pa.Array:
    """Array files of lists of channels; samples without a number are marked as not recorded."""
    parts = []
    for x in (re, im):
        flat = x.flatten().flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        parts.append(np.where(known, flat.fill_null(0.0).to_numpy() + 0.0, NOT_RECORDED))
    rows, channels = (np.asarray(c.offsets) - c.offsets[0].as_py() for c in (re, re.flatten()))
    out = []
    for a, b in zip(rows[:-1], rows[1:]):
        size = np.diff(channels[a : b + 1])
        iq = np.full((b - a, size.max(), 2), NOT_RECORDED)
        iq[np.arange(size.max()) < size[:, None]] = np.stack([p[channels[a] : channels[b]] for p in parts], axis=1)
        buf = io.BytesIO()
        np.save(buf, iq.view(np.complex128)[:, :, 0])
        out.append(buf.getvalue())
    return pa.array(out, pa.binary())


def iq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array files of eight channels each: cpi, content."""
    rows = ad.channel_rows(spark, sf_dir, 8, 16, placed=True)
    per = rows.groupBy("cpi").agg(F.array_sort(F.collect_list(F.struct("channel", "re", "im"))).alias("c")).filter(F.size("c") == 8)
    return per.select("cpi", F.arrow_udf(_npy, returnType="binary")("c.re", "c.im").alias("content"))


def profile_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key=value;`` profiles: config, text. Some are inconsistent."""
    k = F.col("c_custkey")
    num = lambda c: c.cast("long").cast("string")
    line = lambda key, c: F.concat(F.lit(f"{key}="), num(c), F.lit(";\n"))
    tx = k % 3 + 1
    chirp = lambda i: F.when(F.lit(i) < tx, F.concat(
        line("chirpStartIdx", F.lit(i)), line("chirpEndIdx", F.lit(i) + F.when((k % 19 == 4) & (F.lit(i) > 0), 1).otherwise(0)), line("profileIdCPCFG", F.lit(0)), line("txEnable", F.lit(1 << i)),
    )).otherwise(F.lit(""))
    text = F.concat(
        F.lit("# radar profile\n"), line("channelTx", F.when(k % 23 == 5, 1).otherwise(7)), line("channelRx", F.lit(15) - k % 2 * 8), line("adcBitsD", F.lit(2)), line("adcFmt", F.lit(1)),
        line("dataRate", k % 6 + 1), line("laneEn", F.lit(15) - k % 2 * 12), line("profileId", F.lit(0)), line("startFreqConst", F.lit(1435384036) + k), line("idleTimeConst", k % 7 * 100 + 700),
        line("adcStartTimeConst", F.lit(650)), line("rampEndTime", k % 5 * 500 + 4000), line("freqSlopeConst", k % 40 + 100), line("txStartTime", F.lit(0)), line("numAdcSamples", k % 8 * 64 + 64),
        line("digOutSampleRate", k % 10 * 1000 + 5000), line("rxGain", F.lit(30)), line("profileId", F.lit(1)), line("numAdcSamples", F.lit(9999)), line("rxGain", F.lit(30)),
        chirp(0), chirp(1), chirp(2), line("chirpStartIdxFCF", F.lit(0)), line("chirpEndIdxFCF", tx - 1 + F.when(k % 29 == 6, 1).otherwise(0)),
        line("loopCount", k % 4 * 32 + 32), line("periodicity", F.lit(10000000)), line("numAdcSamples", F.lit(512)),
    )
    return ad.table(spark, sf_dir, "customer").select(k.cast("long").alias("config"), text.alias("text"))


def cli_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command-style profiles: config, text."""
    k = F.col("c_custkey")
    text = F.format_string(
        "%% comment\nsensorStop\nchannelCfg %d %d 0\nadcCfg 2 1\nadcbufCfg -1 0 1 1 1\nprofileCfg 0 77 %d 7 %d 0 0 %d 1 %d %d 0 0 30\n"
        "frameCfg 0 %d %d 0 50 1 0\nlvdsStreamCfg -1 %d %d %d\nsensorStart\n",
        F.lit(15) - k % 2 * 8, F.lit(7) - k % 3, k % 9 + 7, k % 5 * 5 + 40, k % 40 + 5, k % 8 * 64 + 64, k % 10 * 1000 + 5000, k % 3, k % 4 * 32 + 32,
        k % 2, F.when(k % 2 == 0, 1).otherwise(k % 5), F.when(k % 4 == 0, 0).otherwise(k % 3 % 2),
    )
    return ad.table(spark, sf_dir, "customer").select(k.cast("long").alias("config"), text.alias("text"))


def tracker_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured points of moving targets: a cluster of points per event, sensors = users.

    Each user's events, in order, are cut into runs of thirty frames along a straight pass;
    the value of an event jitters its points.
    """
    e = with_position(
        ad.table(spark, sf_dir, "events").select(
            F.col("user_id").cast("long").alias("sensor"), F.col("event_id").cast("long").alias("id"), F.col("value").cast("double").alias("value")
        ), ["sensor"], ["id"],
    )
    run = F.expr("_pos div 30")
    step = (F.col("_pos") % 30).cast("double")
    frame = F.col("_pos") + run * 20  # a silence between runs
    x0, y0, v = -2.0 + F.col("sensor") % 5 * 0.5, 4.0 + F.col("sensor") % 3, F.lit(1.5)
    pts = e.select("sensor", frame.alias("frame_no"), "value", (x0 + step * 0.02).alias("_x"), (y0 + step * v * 0.05).alias("_y"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("point_no"))
    jitter = lambda a: ((F.col("value") * (F.col("point_no") + a)) % 1.0 - 0.5) * 0.2
    x, y = F.col("_x") + jitter(1), F.col("_y") + jitter(7)
    r = F.sqrt(x * x + y * y)
    return pts.select(
        "sensor", "frame_no", F.col("point_no").cast("long").alias("point_no"), r.alias("range"), F.atan2(x, y).alias("angle"),
        ((x * 0.4 + y * 1.5) / r).alias("doppler"), F.lit(10.0).alias("snr"),
    )
