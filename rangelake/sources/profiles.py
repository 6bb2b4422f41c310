"""Sensor profile files to configuration tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Link rate code to Mbit/s, and the unit scales of the profile format.
LINK_RATES = {1: 600, 2: 450, 3: 400, 4: 300, 5: 225, 6: 150}
START_FREQ_UNIT = 3.6 / (1 << 26)
SLOPE_UNIT = 3.6e3 * 900 / (1 << 26)
CLI_LANES, CLI_RATE = 2, 600


def _lines(texts: DataFrame) -> DataFrame:
    """config, line_no, line of whole profile texts. A profile is a short file, so its lines stay together."""
    return texts.select("config", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Profile files as (config, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("config"), F.col("value").alias("text"))


def parse_profile(texts: DataFrame, strict: bool = False) -> DataFrame:
    """One row per ``key=value;`` profile. Inconsistent profiles carry ``error``; ``strict`` raises instead."""
    kv = _lines(texts).withColumn("_p", F.split(F.regexp_replace("line", " ", ""), "=")).filter(F.size("_p") >= 2).select(
        "config", "line_no", F.col("_p")[0].alias("key"), F.expr("try_cast(split(_p[1], ';')[0] AS bigint)").alias("value")
    ).filter(F.col("value").isNotNull())
    # Only the first profile block counts: a profileId line sets the block, an rxGain line closes it.
    upto = Window.partitionBy("config").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    closed = F.sum(F.when(F.col("key") == "rxGain", 1).otherwise(0)).over(upto)
    kv = kv.withColumn("_closed", closed)
    opened = F.last(F.when(F.col("key") == "profileId", F.col("value") - F.col("_closed")), ignorenulls=True).over(upto)
    kv = kv.withColumn("_block", F.coalesce(opened, F.lit(0)) + F.col("_closed"))

    def last(key: str, first_block: bool = False) -> Column:
        cond = F.col("key") == key
        if first_block:
            cond = cond & (F.col("_block") == 0)
        return F.max_by(F.when(cond, F.col("value")), F.when(cond, F.col("line_no")))

    def listed(key: str) -> Column:
        items = F.collect_list(F.when(F.col("key") == key, F.struct("line_no", "value")))
        return F.transform(F.array_sort(items), lambda x: x["value"])

    rate = F.create_map(*[F.lit(v) for kv_ in LINK_RATES.items() for v in kv_])
    raw = kv.groupBy("config").agg(
        last("channelTx").alias("_txm"), last("channelRx").alias("_rxm"), last("dataRate").alias("_rate"), last("laneEn").alias("_lanes"),
        last("startFreqConst", True).alias("_sf"), last("idleTimeConst", True).alias("_idle"), last("adcStartTimeConst", True).alias("_adc"),
        last("rampEndTime", True).alias("_ramp"), last("freqSlopeConst", True).alias("_slope"), last("txStartTime", True).alias("_txs"),
        last("numAdcSamples", True).alias("samples"), last("digOutSampleRate", True).alias("sample_rate"),
        listed("chirpStartIdx").alias("_cs"), listed("chirpEndIdx").alias("_ce"), listed("txEnable").alias("_tx"),
        last("chirpStartIdxFCF").alias("_fs"), last("chirpEndIdxFCF").alias("_fe"), last("loopCount").alias("_loops"), last("periodicity").alias("_period"),
    )
    bits = lambda c, mask: F.bit_count(F.col(c).bitwiseAND(F.lit(mask).cast("long"))).cast("long")
    lengths = F.zip_with("_cs", "_ce", lambda a, b: b - a + 1)
    cfg = raw.withColumn("_len", F.slice(lengths, F.lit(1), F.size("_tx"))).select(
        "config", F.size("_tx").cast("long").alias("tx"), bits("_rxm", 15).alias("rx"), bits("_txm", 7).alias("tx_channels"),
        "samples", (F.col("_loops") * F.get("_len", F.lit(0))).alias("chirps"), F.lit(2).cast("long").alias("iq"), F.lit(2).cast("long").alias("bytes_per_value"),
        F.element_at(rate, F.col("_rate").cast("int")).cast("double").alias("lane_mbps"), bits("_lanes", 15).alias("lanes"),
        (F.col("_sf") * START_FREQ_UNIT).alias("start_freq"), (F.col("_idle") / 100).alias("idle_time"), (F.col("_adc") / 100).alias("adc_start_time"),
        (F.col("_ramp") / 100).alias("ramp_end_time"), (F.col("_slope") * SLOPE_UNIT).alias("freq_slope"), (F.col("_txs") / 100).alias("tx_start_time"),
        F.col("sample_rate").cast("double").alias("sample_rate"), (F.col("_period") / 200000).alias("frame_period_ms"),
        "_len", (F.col("_fe") - F.col("_fs") + 1).alias("_frame"),
    )
    total = F.aggregate("_len", F.lit(0).cast("long"), lambda a, x: a + x)
    error = (
        F.when(F.col("tx") > F.col("tx_channels"), F.lit("more transmitters in the chirps than channels"))
        .when(F.exists("_len", lambda x: x != F.get("_len", F.lit(0))), F.lit("chirp count differs between transmitters"))
        .when(total != F.col("_frame"), F.lit("chirp count of the frame and of the chirps differ"))
    )
    out = cfg.withColumn("error", error).drop("_len", "_frame")
    if strict:
        out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))))
    return out


def read_profile(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_profile(read_texts(spark, path), strict)


def parse_cli_profile(texts: DataFrame) -> DataFrame:
    """One row per command-style profile, with link session classification and derived figures."""
    words = _lines(texts).withColumn("w", F.split(F.trim("line"), r"\s+")).filter(~F.col("line").startswith("%")).select("config", "line_no", "w")
    kind = F.col("w")[0]

    def nth(key: str, i: int, cast: str = "double", which: str = "last") -> Column:
        cond = kind == key
        value = F.when(cond, F.expr(f"try_cast(get(w, {i}) AS {cast})"))
        pick = F.max_by if which == "last" else F.min_by
        return pick(value, F.when(cond, F.col("line_no")))

    def listed(key: str, i: int) -> Column:
        items = F.collect_list(F.when(kind == key, F.struct("line_no", F.expr(f"try_cast(get(w, {i}) AS bigint)").alias("v"))))
        return F.transform(F.array_sort(items), lambda x: x["v"])

    raw = words.groupBy("config").agg(
        nth("channelCfg", 1, "bigint").alias("_rxm"), nth("channelCfg", 2, "bigint").alias("_txm"),
        nth("adcCfg", 1, "bigint").alias("data_size"), nth("adcCfg", 2, "bigint").alias("data_type"), nth("adcbufCfg", 5, "bigint").alias("chirp_mode"),
        nth("profileCfg", 2).alias("start_freq"), nth("profileCfg", 3).alias("idle_time"), nth("profileCfg", 4).alias("adc_start_time"),
        nth("profileCfg", 5).alias("ramp_end_time"), nth("profileCfg", 8, which="first").alias("freq_slope"), nth("profileCfg", 9).alias("tx_start_time"),
        nth("profileCfg", 10, "bigint", "first").alias("samples"), nth("profileCfg", 11, which="first").alias("sample_rate"),
        nth("frameCfg", 1, "bigint").alias("_c0"), nth("frameCfg", 2, "bigint").alias("_c1"), nth("frameCfg", 3, "bigint", "first").alias("chirps"),
        nth("frameCfg", 5).alias("frame_period_ms"), nth("advFrameCfg", 1, "bigint").alias("_sub"),
        listed("subFrameCfg", 4).alias("_sub_chirps"), listed("subFrameCfg", 5).alias("_sub_loops"),
        listed("lvdsStreamCfg", 2).alias("_head"), listed("lvdsStreamCfg", 3).alias("_fmt"), listed("lvdsStreamCfg", 4).alias("_user"),
        nth("CQSigImgMonitor", 2, "bigint").alias("sig_img_slices"), nth("CQRxSatMonitor", 4, "bigint").alias("rx_sat_slices"),
    )
    bits = lambda c, mask: F.bit_count(F.col(c).bitwiseAND(F.lit(mask).cast("long"))).cast("long")
    at = lambda c, i=0: F.get(c, F.lit(i) if isinstance(i, int) else i)
    cfg = raw.withColumns({
        "rx": bits("_rxm", 15), "tx": bits("_txm", 7), "iq": F.lit(2).cast("long"), "bytes_per_value": F.lit(2).cast("long"),
        "lanes": F.lit(CLI_LANES).cast("long"), "lane_mbps": F.lit(float(CLI_RATE)), "sub_frames": F.coalesce("_sub", F.lit(1).cast("long")),
        "chirps": F.coalesce("chirps", at("_sub_loops")),
        "chirps_per_frame": (F.col("_c1") - F.col("_c0") + 1) * F.col("chirps"),
    })
    # Which sub-frames go to which card file, and whether hardware or software fills it.
    h, f, u = at("_head"), at("_fmt"), at("_user")
    hw = (h == 1) & f.isin(1, 4)
    sw = (h == 1) & (f == 0) & (u == 1)
    subs = F.sequence(F.lit(0).cast("long"), F.col("sub_frames") - 1)
    is_hw = lambda i: at("_fmt", i.cast("int")).isin(1, 4)
    is_sw = lambda i: at("_user", i.cast("int")) == 1
    none = F.array().cast("array<bigint>")
    cfg = cfg.withColumns({
        "logging_mode": F.when(h == 0, "raw").otherwise("multi"),
        "raw_sub_frames": F.when((h == 0) & (f == 1) & (u == 0), F.array(F.lit(0).cast("long"))).otherwise(none),
        "adc_session": F.when(hw, "HW").when((h == 1) & (f == 0), "SW").otherwise(""),
        "cc9_session": F.when(hw, "SW").when((h == 1) & (f == 0), "HW").otherwise(""),
        "adc_sub_frames": F.when(hw, F.filter(subs, is_hw)).when(sw, F.filter(subs, is_sw)).otherwise(none),
        "cc9_sub_frames": F.when(hw, F.filter(subs, is_sw)).when((h == 1) & (f == 0), F.filter(subs, lambda i: (i > 0) & is_hw(i))).otherwise(none),
        "link_error": F.when((h == 0) & ~((f == 1) & (u == 0)), "stream settings do not fit raw mode").when(
            (h == 1) & (f == 0) & (u != 1), "sub-frame 0 streams nothing"
        ),
    })
    c = F.col
    bins = F.pow(F.lit(2.0), F.ceil(F.log2(c("samples").cast("double")))).cast("long")
    cfg = cfg.withColumns({"virtual_antennas": c("rx") * c("tx"), "range_bins": bins, "doppler_bins": F.floor(c("chirps_per_frame") / c("tx"))})
    span = c("start_freq") * 1e9 * (c("idle_time") + c("ramp_end_time")) * 1e-6
    scale = lambda n: F.lit(3e8) * c("sample_rate") * 1e3 / (c("freq_slope") * 1e12 * 2 * n)
    return cfg.withColumns({
        "range_resolution_m": scale(c("samples")), "range_step_m": scale(c("range_bins")),
        "doppler_resolution_mps": F.lit(3e8) / (span * 2 * c("doppler_bins") * c("tx")),
        "max_range_m": c("sample_rate") * (300 * 0.9) / (c("freq_slope") * 2e3), "max_velocity_mps": F.lit(3e8) / (span * 4 * c("tx")),
    }).drop(*[x for x in cfg.columns if x.startswith("_")])


def read_cli_profile(spark: SparkSession, path: str) -> DataFrame:
    return parse_cli_profile(read_texts(spark, path))


# Fields of the capture board settings.
BOARD_SCHEMA = (
    "DCA1000Config struct<dataLoggingMode:string,dataTransferMode:string,dataCaptureMode:string,lvdsMode:int,dataFormatMode:int,packetDelay_us:int>"
)


def parse_board(texts: DataFrame) -> DataFrame:
    """Capture board settings in JSON (config, text): one row with the settings as columns."""
    return texts.select("config", F.from_json("text", BOARD_SCHEMA).alias("_b")).select("config", "_b.DCA1000Config.*")
