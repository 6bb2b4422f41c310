"""Packet logs: decoding, frame assembly, loss accounting, card captures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangelake.operators.ordered import ROWS_PER_TASK, Cells, join_keys
from rangelake.sources.recordings import _int16

# Packet header and payload bytes, card header bytes, sample offset of the offset-binary card.
HEADER, PAYLOAD, CARD_HEADER, OFFSET = 10, 1456, 14, 1 << 15


def le_unsigned(body: Column, at: int, size: int) -> Column:
    """Little-endian unsigned integer of ``size`` bytes at 0-based ``at`` of a binary column."""
    digits = F.hex(F.substring(body, at + 1, size))
    swapped = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    return F.conv(swapped, 16, 10).cast("long")


def decode_packets(records: DataFrame, body: str = "body") -> DataFrame:
    """Fixed-size records to seq, byte_count, payload; stays in the JVM."""
    b = F.col(body)
    return records.withColumns({
        "seq": le_unsigned(b, 0, 4), "byte_count": le_unsigned(b, 4, 6), "payload": F.expr(f"substring({body}, {HEADER + 1})"),
    }).drop(body)


def read_packets(spark: SparkSession, path: str, payload: int = PAYLOAD, chunk_records: int = 40_000) -> DataFrame:
    """Packet logs under a path: capture, arrival, seq, byte_count, payload.

    The log is cut at record borders, so one huge log is read by many tasks.
    """
    from rangelake.sources.byteranges import register

    register(spark)
    size = HEADER + payload
    chunks = spark.read.format("byte_ranges").option("chunk_bytes", size * chunk_records).load(path)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, start, content in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), batch["content"].to_pylist()):
                n = len(content) // size
                yield pa.RecordBatch.from_pydict({
                    "capture": pa.array([path_] * n), "arrival": pa.array(np.arange(n) + start // size),
                    "body": pa.array([content[i * size: (i + 1) * size] for i in range(n)], pa.binary()),
                })

    return decode_packets(chunks.mapInArrow(split, "capture string, arrival long, body binary"))


def _ordered(once: DataFrame, limit: int | None) -> tuple[Cells, DataFrame]:
    """Packets of distinct numbers in order, with ``first_seq`` and ``last_seq`` of the capture and ``prev``, the number before (NULL at the first)."""
    cut = Cells(once, ["capture"], ["seq"], limit)
    whole = cut.cells.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = cut.summary(cut.rows, _low=F.min("seq"), _high=F.max("seq")).select(
        "_cell", F.min("_low").over(whole).alias("first_seq"), F.max("_high").over(whole).alias("last_seq"), F.lag("_high").over(cut.cells).alias("_before"))
    rows = cut.rows.withColumn("_inside", F.lag("seq").over(cut.window)).join(edges, "_cell")
    return cut, rows.withColumn("prev", F.coalesce("_inside", "_before")).drop("_before")


def lone_packets(packets: DataFrame, max_gap: int, limit: int | None = ROWS_PER_TASK) -> DataFrame:
    """Packets further than ``max_gap`` numbers from every other one of their capture: capture, seq, before, after (the distances).

    A report on numbers that may be damaged; nothing is left out anywhere because of it.
    """
    cut = Cells(packets.select("capture", "seq").distinct(), ["capture"], ["seq"], limit)
    sides = {"before": cut.neighbour({"_s": "seq"}), "after": cut.neighbour({"_s": "seq"}, -1)}
    near = join_keys(*(cut.finish(df).withColumn(k, F.abs(F.col("seq") - F.col("_s"))).drop("_s") for k, df in sides.items()), ["capture", "seq"])
    return near.filter(F.least("before", "after") > max_gap)


def repeated_packets(packets: DataFrame, keep: str = "first") -> DataFrame:
    """Packets that frames (``keep`` first) or clean captures (last) do not use, as their number came more than once: all columns, and the arrival that was used."""
    used = (F.min if keep == "first" else F.max)("arrival")
    times = packets.groupBy("capture", "seq").agg(used.alias("used_arrival"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return join_keys(packets, times, ["capture", "seq"]).filter(F.col("arrival") != F.col("used_arrival"))


#: Empty frames that one row makes at a time.
_RUN = 1 << 12


def assemble_frames(packets: DataFrame, bytes_per_frame: int, payload: int = PAYLOAD, limit: int | None = ROWS_PER_TASK) -> DataFrame:
    """Payload bytes cut into frames: capture, frame_no, payload, missing_packets.

    A packet's place follows from its sequence number, so order of arrival does not matter,
    a repeated packet counts once (``repeated_packets`` lists the others), holes read as zero and a packet across a border serves
    both frames. Only frames that end inside the capture are kept. No number is distrusted: a
    hole is one row until its empty frames are made, however long it is (``lone_packets`` lists suspects).
    """
    size = F.lit(bytes_per_frame).cast("long")
    once = packets.groupBy("capture", "seq").agg(F.min_by("payload", "arrival").alias("payload"))
    _, rows = _ordered(once, limit)
    at = (F.col("seq") - F.col("first_seq")) * payload
    frames = F.floor((F.col("last_seq") - F.col("first_seq") + 1) * payload / size)
    low = (F.col("prev") + 1 - F.col("first_seq")) * payload
    run, run_end = F.ceil(low / size), F.least(F.floor(at / size), frames)
    none, nothing = F.lit(None).cast("binary"), F.lit(0).cast("long")

    def piece(f: Column) -> Column:
        start = F.greatest(at - f * size, nothing)
        skip = F.greatest(f * size - at, nothing)
        room = F.least(size - start, F.lit(payload) - skip)
        return F.struct(f.alias("frame_no"), start.cast("int").alias("at"), F.col("payload").substr((skip + 1).cast("int"), room.cast("int")).alias("body"), F.lit(1).cast("long").alias("frames"))

    pieces = F.transform(F.sequence(F.floor(at / size), F.floor((at + payload - 1) / size)), piece)
    empty = F.array(F.struct(run.alias("frame_no"), F.lit(0).alias("at"), none.alias("body"), (run_end - run).alias("frames")))
    parts = rows.select("capture", frames.alias("_frames"), F.explode(F.concat(pieces, F.when(run < run_end, empty).otherwise(F.slice(empty, 1, 0)))).alias("p")).select("capture", "_frames", "p.*")
    whole = parts.filter(F.col("frame_no") < F.col("_frames")).groupBy("capture", "frame_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("at", "body")))).alias("_p"), F.max("frames").alias("_run"))
    end = lambda p: p["at"] + F.octet_length(p["body"])
    zeros = lambda n: F.repeat(F.lit("00"), n)
    before = lambda i: F.when(i == 0, 0).otherwise(end(F.get("_p", i - 1)))
    digits = F.array_join(F.transform("_p", lambda p, i: F.concat(zeros(p["at"] - before(i)), F.hex(p["body"]))), "")
    tail = zeros(F.lit(bytes_per_frame) - F.coalesce(end(F.try_element_at("_p", F.lit(-1))), F.lit(0)))
    # the frames of a hole: in blocks, so that no row holds them all
    blocks = F.explode(F.sequence(nothing, F.floor((F.col("_run") - 1) / _RUN)))
    block = whole.withColumn("_b", blocks).withColumn("_f", F.explode(F.sequence(F.col("_b") * _RUN, F.least((F.col("_b") + 1) * _RUN, F.col("_run")) - 1)))
    number = F.col("frame_no") + F.col("_f")
    first, last = F.floor(number * size / payload), F.floor(((number + 1) * size - 1) / payload)
    return block.select(
        "capture", number.alias("frame_no"), F.unhex(F.concat(digits, tail)).alias("payload"), (last - first + 1 - F.size("_p")).cast("long").alias("missing_packets"))


def packet_loss(packets: DataFrame) -> DataFrame:
    """Per capture: first_seq, last_seq, received, expected, loss_percent.

    Sequence numbers are made distinct in parallel before the capture is reduced.
    """
    distinct = packets.select("capture", "seq").distinct()
    agg = distinct.groupBy("capture").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("received")
    )
    expected = F.col("last_seq") - F.col("first_seq") + 1
    return agg.withColumns({"expected": expected, "loss_percent": (expected - F.col("received")) / expected * 100})


def packet_gaps(packets: DataFrame, limit: int | None = ROWS_PER_TASK) -> DataFrame:
    """Each run of missing sequence numbers: capture, gap_start, gap_end."""
    _, rows = _ordered(packets.select("capture", "seq").distinct(), limit)
    return rows.filter(F.col("seq") - F.col("prev") > 1).select("capture", (F.col("prev") + 1).alias("gap_start"), (F.col("seq") - 1).alias("gap_end"))


def split_card_log(files: DataFrame) -> DataFrame:
    """Card logs (capture, content) with variable-size packets to capture, arrival, seq, payload.

    The packet chain can only be followed from the start of a file, one file per row.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for capture, content in zip(batch["capture"].to_pylist(), batch["content"].to_pylist()):
                seqs, bodies, at = [], [], 0
                while at + CARD_HEADER <= len(content):
                    seq, size = np.frombuffer(content, "<i4", 2, at)
                    at += CARD_HEADER
                    seqs.append(int(seq))
                    bodies.append(content[at: at + size])
                    at += int(size)
                yield pa.RecordBatch.from_pydict({
                    "capture": pa.array([capture] * len(seqs), batch.schema.field("capture").type), "arrival": pa.array(range(len(seqs)), pa.int64()),
                    "seq": pa.array(seqs, pa.int64()), "payload": pa.array(bodies, pa.binary()),
                })

    kind = files.schema["capture"].dataType.simpleString()
    return files.select("capture", "content").mapInArrow(split, f"capture {kind}, arrival long, seq long, payload binary")


def read_card_logs(spark: SparkSession, path: str) -> DataFrame:
    """Card logs under a path to capture, arrival, seq, payload; a file is one task, as its chain has no other start."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return split_card_log(files.select(F.col("path").alias("capture"), "content"))


def clean_capture(packets: DataFrame, limit: int | None = ROWS_PER_TASK) -> DataFrame:
    """Card packets in sequence order with their holes: capture, seq, packets, size, offset, payload, lost.

    A late packet takes its own place (the last arrival wins). A run of lost packets is one row (``packets`` of them from
    ``seq`` on, each of the ``size`` of the next packet received, no payload), however long it is; numbers start at 1. The capture stays a
    table of segments with byte offsets and is never joined into one value. ``filled`` makes the zeros.
    """
    once = packets.groupBy("capture", "seq").agg(F.max_by("payload", "arrival").alias("payload")).withColumn("size", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long"))
    cut = Cells(once, ["capture"], ["seq"], limit)
    inside = F.lag("seq").over(cut.window)
    rows = cut.rows.withColumns({"_inside": inside, "_bytes": F.coalesce((F.col("seq") - inside) * F.col("size"), F.lit(0))})
    # a cell's first row reaches back over the hole before it
    cells = cut.summary(rows, _sum=F.sum("_bytes"), _low=F.min("seq"), _high=F.max("seq"), _size=F.min_by("size", "_seq"))
    cells = cells.withColumn("_before", F.coalesce(F.lag("_high").over(cut.cells), F.lit(0)))
    cells = cells.withColumn("_border", (F.col("_low") - F.col("_before")) * F.col("_size"))
    base = F.coalesce(F.sum(F.col("_sum") + F.col("_border")).over(cut.before), F.lit(0)) + F.col("_border")
    placed = rows.join(cells.select("_cell", "_before", base.alias("_base")), "_cell").withColumns({
        "prev": F.coalesce("_inside", "_before"), "_end": F.col("_base") + F.sum("_bytes").over(cut.so_far)})
    lost = F.col("seq") - 1 - F.col("prev")
    span = (lost + 1) * F.col("size")
    segment = lambda seq, n, at, body, gone: F.struct(seq.alias("seq"), n.alias("packets"), F.col("size"), at.alias("offset"), body.alias("payload"), F.lit(gone).alias("lost"))
    own = F.array(segment(F.col("seq"), F.lit(1).cast("long"), F.col("_end") - F.col("size"), F.col("payload"), False))
    hole = F.array(segment(F.col("seq") - lost, lost, F.col("_end") - span, F.lit(None).cast("binary"), True))
    return placed.select("capture", F.explode(F.when(lost > 0, F.concat(hole, own)).otherwise(own)).alias("s")).select("capture", "s.*")


def filled(segments: DataFrame) -> DataFrame:
    """The segments of ``clean_capture`` as a row per packet, lost ones as zeros: capture, seq, offset, payload, lost."""
    nothing = F.lit(0).cast("long")
    blocks = segments.withColumn("_b", F.explode(F.sequence(nothing, F.floor((F.col("packets") - 1) / _RUN))))
    every = blocks.withColumn("_i", F.explode(F.sequence(F.col("_b") * _RUN, F.least((F.col("_b") + 1) * _RUN, F.col("packets")) - 1)))
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("size").cast("int")))
    return every.select("capture", (F.col("seq") + F.col("_i")).alias("seq"), (F.col("offset") + F.col("_i") * F.col("size")).alias("offset"), F.when(F.col("lost"), zeros).otherwise(F.col("payload")).alias("payload"), "lost")


def decode_offset_binary(files: DataFrame, chirps: int, antennas: int, samples: int, iq: bool = True, body: str = "content") -> DataFrame:
    """Offset-binary captures to rows per (frame_no, chirp, antenna) with ``re, im`` arrays (``im`` empty for real data)."""
    per = 2 if iq else 1
    keys = [c for c in files.columns if c != body]

    def signed(content: pa.Array) -> pa.Array:
        rows = [np.frombuffer(b.as_py(), "<u2").astype(np.int32) - OFFSET for b in content]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        cuts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.astype(np.int16)))

    line = per * samples
    values = files.withColumn("_v", F.arrow_udf(signed, returnType="array<smallint>")(body)).drop(body)
    size = F.size("_v")
    checked = values.withColumn("_rows", F.when(size % (line * antennas * chirps) == 0, size / line).otherwise(
        F.raise_error(F.lit("the capture does not hold whole frames"))
    ).cast("int"))
    pick = lambda row, off: F.transform(
        F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: F.element_at("_v", (row * line + s * per + off + 1).cast("int")).cast("double")
    )
    cells = F.transform(F.sequence(F.lit(0), F.col("_rows") - 1), lambda row: F.struct(
        F.floor(row / (antennas * chirps)).cast("long").alias("frame_no"), (F.floor(row / antennas) % chirps).cast("long").alias("chirp"),
        (row % antennas).cast("long").alias("antenna"), pick(row, 0).alias("re"),
        (pick(row, 1) if iq else F.array().cast("array<double>")).alias("im"),
    ))
    return checked.select(*keys, F.inline(cells))


def read_offset_binary(spark: SparkSession, path: str, chirps: int, antennas: int, samples: int, iq: bool = True, chunk_frames: int = 64) -> DataFrame:
    """Offset-binary captures under a path, read by many tasks in ranges of whole frames: capture, frame_no, chirp, ..."""
    from rangelake.sources.byteranges import register

    register(spark)
    size = 2 * (2 if iq else 1) * samples * antennas * chirps
    chunks = spark.read.format("byte_ranges").option("chunk_bytes", size * chunk_frames).load(path).select(F.col("path").alias("capture"), "start", "content")
    cells = decode_offset_binary(chunks, chirps, antennas, samples, iq)
    return cells.withColumn("frame_no", F.col("frame_no") + F.expr(f"start div {size}")).drop("start")


def decode_int16(frames: DataFrame, payload: str = "payload") -> DataFrame:
    """Binary payload to ``samples``."""
    return frames.withColumn("samples", F.arrow_udf(_int16, returnType="array<smallint>")(payload)).drop(payload)
