"""Type-length-value sensor output logs to tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangelake.functions.units import xyz_to_polar

# Packet magic, header bytes, TLV type numbers, field names of the reports.
MAGIC = bytes([2, 1, 4, 3, 6, 5, 8, 7])
HEADER = 40
POINTS, RANGE_PROFILE, NOISE_PROFILE, AZIMUTH_MAP, RANGE_DOPPLER, STATS, SIDE_INFO, TEMPERATURE = 1, 2, 3, 4, 5, 6, 7, 9
STAT_FIELDS = [
    "inter_frame_time_us", "transmit_time_us", "inter_frame_margin_us", "inter_chirp_margin_us", "active_load_pct", "inter_frame_load_pct",
]
TEMPERATURE_FIELDS = ["rx0", "rx1", "rx2", "rx3", "tx0", "tx1", "tx2", "pm", "dig0", "dig1"]
MAX_MAP_VALUE = 10000
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20

_ROWS = (
    "capture {kind}, packet_at long, frame_no long, sub_frame long, cpu_cycles long, platform string, num_obj long, "
    "tlv_no long, tlv_type long, tlv_len long, body binary"
)


def _packets(content: bytes, own: int) -> Iterator[tuple[int, tuple, bytes]]:
    """(start, header fields, body) of each sound packet that starts in the first ``own`` bytes.

    After a damaged packet the search goes on behind its magic word.
    """
    at = content.find(MAGIC)
    while 0 <= at < own:
        step = len(MAGIC)
        if at + HEADER <= len(content):
            head = struct.unpack_from("<7I", content, at + 12)
            size, objects, sub = head[0], head[4], head[6]
            end = at + size
            next_ok = MAGIC.startswith(content[end: end + 8])  # also at the end of the log
            if size >= HEADER and end <= len(content) and next_ok and objects > 0 and sub <= 3:
                yield at, head, content[at + HEADER: end]
                step = size
        at = content.find(MAGIC, at + step)


def split_packets(chunks: DataFrame, kinds: Sequence[int] | None = None) -> DataFrame:
    """Log chunks (capture, start, own_bytes, content) to one row per TLV, or per TLV of some ``kinds``.

    Rows leave in batches of bounded size, so a task holds one chunk and one such batch.
    """
    wanted = None if kinds is None else frozenset(kinds)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.strip().split(" ")[0] for f in _ROWS.split(",")]
        for batch in batches:
            types = [batch.schema.field("capture").type, *[pa.int64()] * 4, pa.string(), *[pa.int64()] * 4, pa.binary()]
            done = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out: list[tuple] = []
            held = 0
            for row in range(batch.num_rows):
                capture, start, own, content = (batch[n][row].as_py() for n in ("capture", "start", "own_bytes", "content"))
                for at, head, body in _packets(content, own):
                    pos, platform = 0, f"{head[1]:08X}"
                    for k in range(head[5]):
                        if pos + 8 > len(body):
                            break
                        kind, size = struct.unpack_from("<2I", body, pos)
                        if wanted is None or kind in wanted:
                            value = body[pos + 8: pos + 8 + size]
                            out.append((capture, start + at, head[2], head[6], head[3], platform, head[4], k, kind, size, value))
                            held += len(value)
                        pos += 8 + size
                    if len(out) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield done(out)
                        out, held = [], 0
            if out:
                yield done(out)

    kind = chunks.schema["capture"].dataType.simpleString()
    return chunks.select("capture", "start", "own_bytes", "content").mapInArrow(split, _ROWS.format(kind=kind))


def unpack(dtype: str) -> Column:
    """Arrow UDF: binary column to array<double> of a fixed numpy type."""

    def run(body: pa.Array) -> pa.Array:
        size = np.dtype(dtype).itemsize
        rows = body.to_pylist()
        counts = [len(b) // size for b in rows]
        flat = np.frombuffer(b"".join(b[: n * size] for b, n in zip(rows, counts)), dtype).astype(np.float64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))

    return F.arrow_udf(run, returnType="array<double>")


KEYS = ["capture", "packet_at", "frame_no", "sub_frame"]


def _of(tlvs: DataFrame, kind: int) -> DataFrame:
    return tlvs.filter(F.col("tlv_type") == kind)


def points(tlvs: DataFrame) -> DataFrame:
    """Detected points joined by position with their side information, plus range and angles."""
    # the two bodies of a packet meet before they are unpacked: one pass over the logs, one row a packet in the shuffle
    held = F.octet_length("body")
    both = tlvs.filter(((F.col("tlv_type") == POINTS) & (held >= 16)) | ((F.col("tlv_type") == SIDE_INFO) & (held >= 4)))
    bodies = lambda kind: F.collect_list(F.when(F.col("tlv_type") == kind, F.struct("num_obj", "body")))
    packets = both.groupBy(*KEYS).agg(bodies(POINTS).alias("_p"), bodies(SIDE_INFO).alias("_s"))
    pairs = packets.select(*KEYS, F.explode("_p").alias("_p"), "_s").select(*KEYS, "_p", F.explode_outer("_s").alias("_s"))
    rows = pairs.select(
        *KEYS, F.col("_p.num_obj").alias("_n"), F.coalesce("_s.num_obj", F.lit(0)).alias("_m"), unpack("<f4")("_p.body").alias("_v"),
        unpack("<u2")(F.coalesce("_s.body", F.lit(b""))).alias("_w"),
    )
    count = F.least(F.col("_n"), F.floor(F.size("_v") / 4))
    at = lambda k: F.element_at("_v", (k + 1).cast("int"))
    info = lambda i, k: F.when(i < F.col("_m"), F.get("_w", (i * 2 + k).cast("int")).cast("long"))
    xyz = rows.select(*KEYS, F.inline(F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.struct(
        i.cast("long").alias("obj"), at(i * 4).alias("x"), at(i * 4 + 1).alias("y"), at(i * 4 + 2).alias("z"), at(i * 4 + 3).alias("velocity"),
        info(i, 0).alias("snr"), info(i, 1).alias("noise"),
    ))))
    return xyz_to_polar(xyz)


def profile(tlvs: DataFrame, kind: int = RANGE_PROFILE) -> DataFrame:
    """Range profile or noise profile, one row per packet with ``profile``."""
    return _of(tlvs, kind).select(*KEYS, unpack("<u2")("body").alias("profile"))


def azimuth_map(tlvs: DataFrame, antennas: int = 8) -> DataFrame:
    """Static azimuth map, stored imaginary part first: range_bin, re and im over antennas."""
    v = _of(tlvs, AZIMUTH_MAP).select(*KEYS, unpack("<i2")("body").alias("_v"))
    part = lambda r, off: F.transform(
        F.sequence(F.lit(0), F.lit(antennas - 1)), lambda a: F.element_at("_v", ((r * antennas + a) * 2 + off + 1).cast("int"))
    )
    bins = F.sequence(F.lit(0), (F.size("_v") / (2 * antennas)).cast("int") - 1)
    return v.filter(F.size("_v") >= 2 * antennas).select(*KEYS, F.inline(F.transform(bins, lambda r: F.struct(
        r.cast("long").alias("range_bin"), part(r, 1).alias("re"), part(r, 0).alias("im")
    ))))


def range_doppler_map(tlvs: DataFrame, n_doppler: int, drop_above: int | None = None, swap_halves: bool = False) -> DataFrame:
    """Range-Doppler map cells. ``drop_above`` leaves out maps with a larger value (older
    sensors send garbage); ``swap_halves`` moves zero Doppler to the centre."""
    v = _of(tlvs, RANGE_DOPPLER).select(*KEYS, unpack("<u2")("body").alias("_v"))
    if drop_above is not None:
        v = v.filter(F.array_max("_v") <= drop_above)
    cells = v.select(*KEYS, F.posexplode("_v").alias("_i", "value"))
    d = (F.col("_i") % n_doppler).cast("long")
    if swap_halves:
        d = (d + n_doppler // 2) % n_doppler
    return cells.select(*KEYS, F.expr(f"_i div {n_doppler}").cast("long").alias("range_bin"), d.alias("doppler_bin"), F.col("value").cast("long").alias("value"))


def stats(tlvs: DataFrame) -> DataFrame:
    """Processing statistics per packet."""
    v = _of(tlvs, STATS).select(*KEYS, "cpu_cycles", unpack("<u4")("body").alias("_v"))
    return v.select(*KEYS, "cpu_cycles", *[F.col("_v")[i].cast("long").alias(n) for i, n in enumerate(STAT_FIELDS)])


def temperature(tlvs: DataFrame) -> DataFrame:
    """Temperature report per packet; ``valid`` is 0 when the values hold."""
    b = F.col("body")
    from rangelake.sources.packets import le_unsigned

    v = _of(tlvs, TEMPERATURE).withColumn("_v", unpack("<i2")("body"))
    sensors = [F.col("_v")[i + 4].cast("long").alias(n) for i, n in enumerate(TEMPERATURE_FIELDS)]
    valid = le_unsigned(b, 0, 4)
    return v.select(*KEYS, F.when(valid >= 1 << 31, valid - (1 << 32)).otherwise(valid).alias("valid"), le_unsigned(b, 4, 4).alias("time_ms"), *sensors)


def read_tlv(spark: SparkSession, path: str, chunk_bytes: int = 64 << 20, n_doppler: int | None = None, older: bool = False) -> dict[str, DataFrame]:
    """All tables of the logs under a path; a log is read in chunks by many tasks.

    A chunk runs on to the end of the packets that start in it, however long. With ``n_doppler`` there is a range-Doppler
    table; ``older`` sensors swap its halves and send maps of garbage, which are left out.
    """
    from rangelake.sources.byteranges import register

    register(spark)
    chunks = (
        spark.read.format("byte_ranges").option("chunk_bytes", chunk_bytes).option("magic", MAGIC.hex()).option("size_at", 12).load(path)
        .withColumnRenamed("path", "capture")
    )
    tlvs = split_packets(chunks)
    maps = {} if n_doppler is None else {"range_doppler": range_doppler_map(tlvs, n_doppler, MAX_MAP_VALUE if older else None, older)}
    return maps | {
        "tlv": tlvs, "points": points(tlvs), "range_profile": profile(tlvs, RANGE_PROFILE), "noise_profile": profile(tlvs, NOISE_PROFILE),
        "azimuth_map": azimuth_map(tlvs), "stats": stats(tlvs), "temperature": temperature(tlvs),
    }
