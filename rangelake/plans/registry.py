"""Query registry: a Spark builder and, where SQL can say it, the same in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def rnd(c: str | Column, digits: int = 4) -> Column:
    """Rounded double without negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), digits) + F.lit(0.0)


# The adapter views in SQL.
SIGNAL = "SELECT CAST(user_id AS BIGINT) AS part, CAST(event_id AS BIGINT) AS ord, CAST(floor(value) AS BIGINT) AS v FROM events"
BIG_COLS = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
SIGNAL_BIG = f"""SELECT CAST(l_suppkey AS BIGINT) AS part, CAST(floor(l_quantity) AS BIGINT) AS v,
  l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY {BIG_COLS}) - 1 AS ord FROM lineitem"""
RD_MAP = """SELECT g.map, g.range_bin, g.doppler_bin, COALESCE(s.value, 0) AS value
FROM (SELECT m.map, r.range_bin, d.doppler_bin
      FROM (SELECT DISTINCT l_orderkey // 500 AS map FROM lineitem) m,
           (SELECT unnest(range(0, 64)) AS range_bin) r, (SELECT unnest(range(0, 32)) AS doppler_bin) d) g
LEFT JOIN (SELECT l_orderkey // 500 AS map, l_partkey % 64 AS range_bin, l_orderkey % 32 AS doppler_bin,
                  CAST(SUM(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2, 3) s
ON g.map = s.map AND g.range_bin = s.range_bin AND g.doppler_bin = s.doppler_bin"""
IQ = """SELECT vec_id // 100 AS frame_no, (vec_id % 100) // 4 AS chirp, vec_id % 4 AS vant, CAST(i AS BIGINT) AS sample,
  CAST(embedding[2*i+1] AS DOUBLE) AS re, CAST(embedding[2*i+2] AS DOUBLE) AS im
FROM embeddings, (SELECT unnest(range(0, 32)) AS i)"""
CHANNELS = """SELECT vec_id // 20 AS cpi, vec_id % 2 AS channel, ((vec_id % 20) // 2) * 32 + i AS n,
  CAST(embedding[2*i+1] AS DOUBLE) AS re, CAST(embedding[2*i+2] AS DOUBLE) AS im
FROM embeddings, (SELECT unnest(range(0, 32)) AS i)"""
POINTS = f"""SELECT CAST(l_orderkey AS BIGINT) AS frame_no,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {BIG_COLS}) - 1 AS pid,
  CAST(l_quantity AS DOUBLE) - 25 AS x, CAST(floor(l_extendedprice / 1000) AS DOUBLE) AS y,
  round(CAST(l_discount AS DOUBLE) * 100) - 5 AS vel FROM lineitem"""
_SENSOR = """SELECT CAST(user_id AS BIGINT) AS sensor, CAST(event_id AS BIGINT) AS frame_no, epoch_us(ts) / 1e6 AS ts, value
FROM events WHERE event_type IN ({})"""
SENSOR_A = _SENSOR.format("'click', 'view', 'signup'")
SENSOR_B = _SENSOR.format("'purchase', 'error'")
TELEMETRY = """SELECT user_id % 4 AS stream, event_id AS seq, epoch_us(ts) * 1000 AS capture_ns,
  epoch_us(ts) * 1000 + CAST(floor(value) AS BIGINT) * 1000000 AS enqueue_ns,
  epoch_us(ts) * 1000 + CAST(floor(value) AS BIGINT) * 2000000 AS recv_ns,
  epoch_us(ts) * 1000 + CAST(floor(value) AS BIGINT) * 3000000 AS end_ns,
  epoch_us(ts) * 1000 + CAST(floor(value) AS BIGINT) * 5000000 AS main_ns,
  CASE WHEN event_id % 11 = 0 THEN 0 ELSE epoch_us(ts) * 1000 + CAST(floor(value) AS BIGINT) * 8000000 END AS display_ns
FROM events WHERE event_id % 7 <> 3"""
CONTROL = """SELECT CAST(user_id AS BIGINT) AS session, epoch_us(ts) / 1e6 AS wall, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'play' WHEN 'view' THEN 'pause' WHEN 'signup' THEN 'seek' WHEN 'error' THEN 'speed' ELSE 'stop' END AS command,
  CASE event_type WHEN 'signup' THEN CAST(floor(value) AS DOUBLE) WHEN 'error' THEN CAST(1 + event_id % 3 AS DOUBLE) END AS arg FROM events"""
BOXES = """SELECT CAST(l_orderkey AS BIGINT) AS frame_no, CAST(l_partkey % 600 AS DOUBLE) AS x1, CAST(l_suppkey % 400 AS DOUBLE) AS y1,
  CAST(l_partkey % 600 AS DOUBLE) + CAST(l_quantity AS DOUBLE) AS x2, CAST(l_suppkey % 400 AS DOUBLE) + 2 * CAST(l_quantity AS DOUBLE) AS y2,
  CAST(l_linenumber - 1 AS INTEGER) AS class_id, round(1.0 - CAST(l_discount AS DOUBLE) * 6, 6) AS confidence FROM lineitem"""
GEO = """SELECT c_custkey AS target, CAST((c_custkey * 37) % 170 - 85 AS DOUBLE) AS lat, CAST((c_custkey * 91) % 360 - 180 AS DOUBLE) AS lon,
  c_custkey % 12 * 1000.0 AS alt, CAST(c_acctbal AS DOUBLE) AS speed FROM customer"""
INT_FRAMES = """SELECT vec_id AS frame_no, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 10000) AS INTEGER)) AS samples FROM embeddings"""
CONFIG = """SELECT c_custkey AS config, c_custkey % 8 * 64 + 64 AS samples, c_custkey % 4 * 32 + 32 AS chirps, c_custkey % 3 + 1 AS tx, 4 AS rx,
  CAST(c_custkey % 50 + 5 AS DOUBLE) AS freq_slope, CAST(c_custkey % 10 * 1000 + 5000 AS DOUBLE) AS sample_rate, 77.0::DOUBLE AS start_freq,
  CAST(c_custkey % 7 * 5 + 40 AS DOUBLE) AS ramp_end_time, CAST(c_custkey % 5 * 3 + 5 AS DOUBLE) AS idle_time, 2 AS iq, 2 AS bytes_per_value,
  c_custkey % 2 * 2 + 2 AS lanes, 600.0::DOUBLE AS lane_mbps FROM customer"""
