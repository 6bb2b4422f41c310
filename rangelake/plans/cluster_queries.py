"""Queries: density clustering and cluster association."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangelake.operators import cluster as cu
from rangelake.operators.ordered import with_position
from rangelake.plans.registry import POINTS, query, rnd
from rangelake.sources import adapters as ad


def _points(spark, sf):
    return with_position(ad.points(spark, sf), ["frame_no"], ad.BIG_ORDER[1:]).select(
        "frame_no", F.col("_pos").alias("pid"), "x", "y", F.col("vel").alias("velocity")
    )


# All pairs inside the small frames, closed transitively; labels by first core point.
_DBSCAN = f"""WITH RECURSIVE p AS ({POINTS}), st AS (SELECT frame_no, AVG(x) AS mx, AVG(y) AS my, AVG(vel) AS mv, stddev_pop(x) AS sx, stddev_pop(y) AS sy, stddev_pop(vel) AS sv FROM p GROUP BY 1),
z AS (SELECT p.frame_no, pid, (x - mx) / CASE WHEN sx > 0 THEN sx ELSE 1 END AS x, (y - my) / CASE WHEN sy > 0 THEN sy ELSE 1 END AS y, {{v}} AS v FROM p JOIN st ON p.frame_no = st.frame_no),
n AS (SELECT a.frame_no, a.pid AS a, b.pid AS b FROM z a JOIN z b ON a.frame_no = b.frame_no AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.v - b.v, 2) <= {{r2}}),
c AS (SELECT frame_no, a AS pid FROM n GROUP BY 1, 2 HAVING COUNT(*) >= {{m}}),
e AS MATERIALIZED (SELECT n.frame_no, n.a, n.b FROM n JOIN c x ON x.frame_no = n.frame_no AND x.pid = n.a JOIN c y ON y.frame_no = n.frame_no AND y.pid = n.b),
r AS (SELECT frame_no, a, b FROM e UNION SELECT r.frame_no, r.a, e.b FROM r JOIN e ON r.frame_no = e.frame_no AND r.b = e.a),
o AS (SELECT frame_no, a AS pid, MIN(b) AS root FROM r GROUP BY 1, 2),
k AS (SELECT frame_no, root, dense_rank() OVER (PARTITION BY frame_no ORDER BY root) - 1 AS lab FROM (SELECT DISTINCT frame_no, root FROM o)),
l AS (SELECT n.frame_no, n.a AS pid, MIN(k.lab) AS lab FROM n JOIN o ON o.frame_no = n.frame_no AND o.pid = n.b JOIN k ON k.frame_no = o.frame_no AND k.root = o.root
  WHERE NOT EXISTS (SELECT 1 FROM o q WHERE q.frame_no = n.frame_no AND q.pid = n.a) GROUP BY 1, 2
  UNION ALL SELECT o.frame_no, o.pid, k.lab FROM o JOIN k ON k.frame_no = o.frame_no AND k.root = o.root)"""


@query("point_clusters", _DBSCAN.format(v="(vel - mv) / CASE WHEN sv > 0 THEN sv ELSE 1 END", r2="0.64::DOUBLE", m=2) + """
SELECT z.frame_no, z.pid, CAST(COALESCE(lab, -1) AS BIGINT) AS cluster_label FROM z LEFT JOIN l ON z.frame_no = l.frame_no AND z.pid = l.pid""")
def point_clusters(spark, sf):
    return cu.cluster_points(_points(spark, sf), ["frame_no"], "pid", 0.8, 2, 1.0).select("frame_no", "pid", "cluster_label")


@query("point_cluster_counts", _DBSCAN.format(v="0.0", r2="0.49::DOUBLE", m=3) + """
SELECT z.frame_no, COALESCE(MAX(lab), -1) + 1 AS n_clusters, SUM(CASE WHEN lab IS NULL THEN 1 ELSE 0 END) AS n_noise, COUNT(*) AS n_points
FROM z LEFT JOIN l ON z.frame_no = l.frame_no AND z.pid = l.pid GROUP BY 1""")
def point_cluster_counts(spark, sf):
    return cu.cluster_counts(cu.cluster_points(_points(spark, sf), ["frame_no"], "pid", 0.7, 3, 0.0), ["frame_no"])


# Frames of a hundred orders, thinned coordinates: larger groups with chains.
_OBJ = "SELECT l_orderkey // 100 AS frame_no, row_number() OVER (PARTITION BY l_orderkey // 100 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS pid, CAST(l_partkey % 97 AS DOUBLE) * 0.9::DOUBLE AS x, CAST(l_suppkey % 53 AS DOUBLE) * 1.1::DOUBLE AS y, CAST(l_linenumber AS BIGINT) AS d FROM lineitem"


@query("object_clusters", f"""WITH RECURSIVE p AS ({_OBJ}), e AS MATERIALIZED (SELECT a.frame_no, a.pid AS a, b.pid AS b FROM p a JOIN p b ON a.frame_no = b.frame_no AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + 0.5::DOUBLE * pow((a.d - b.d) * 0.4::DOUBLE, 2) <= 1.25),
r AS (SELECT frame_no, a, b FROM e UNION SELECT r.frame_no, r.a, e.b FROM r JOIN e ON r.frame_no = e.frame_no AND r.b = e.a), o AS (SELECT frame_no, a AS pid, MIN(b) AS root FROM r GROUP BY 1, 2)
SELECT o.frame_no, dense_rank() OVER (PARTITION BY o.frame_no ORDER BY root) - 1 AS cluster_label, COUNT(*) AS num_points, round(AVG(x), 4) AS center_x, round(AVG(y), 4) AS center_y, round(MAX(x) - MIN(x), 4) AS size_x, round(MAX(y) - MIN(y), 4) AS size_y, round(AVG(d) * 0.4::DOUBLE, 4) AS avg_velocity
FROM o JOIN p ON o.frame_no = p.frame_no AND o.pid = p.pid GROUP BY o.frame_no, root""")
def object_clusters(spark, sf):
    c = cu.cluster_objects(_objects(spark, sf), ["frame_no"], "pid", 0.5, 0.4)
    return c.select(
        "frame_no", "cluster_label", "num_points", rnd(F.col("center")[0]).alias("center_x"), rnd(F.col("center")[1]).alias("center_y"),
        rnd(F.col("size")[0]).alias("size_x"), rnd(F.col("size")[1]).alias("size_y"), rnd("avg_velocity").alias("avg_velocity"),
    )


def _objects(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    li = ad.table(spark, sf, "lineitem").withColumn("frame_no", F.expr("l_orderkey div 100"))
    return with_position(li, ["frame_no"], order).select(
        "frame_no", F.col("_pos").alias("pid"), ((F.col("l_partkey") % 97).cast("double") * 0.9).alias("x"),
        ((F.col("l_suppkey") % 53).cast("double") * 1.1).alias("y"), F.col("l_linenumber").cast("long").alias("doppler_bin"),
    )


# Clusters of one order each, followed over the orders of a block.
_SIMPLE = "SELECT l_orderkey // 50 AS sensor, l_orderkey % 50 AS frame_no, CAST(l_linenumber AS BIGINT) AS label, AVG(CAST(l_quantity AS DOUBLE)) AS x, AVG(CAST(l_extendedprice AS DOUBLE) / 2000) AS y, AVG(CAST(l_discount AS DOUBLE)) * 100 - 5 + l_linenumber * 0.001::DOUBLE AS vel FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query("associated_clusters", f"""WITH c AS ({_SIMPLE}), q AS (SELECT n.sensor, n.frame_no, n.label, n.vel, p.label AS pl, p.vel AS pv FROM c n JOIN c p ON p.sensor = n.sensor AND p.frame_no = n.frame_no - 1
 QUALIFY row_number() OVER (PARTITION BY n.sensor, n.frame_no, n.label ORDER BY abs(n.vel - p.vel), p.vel, p.label) = 1),
g AS (SELECT * FROM q WHERE abs(vel - pv) < least(2.0, abs(vel)) AND EXISTS (SELECT 1 FROM c n JOIN c p ON p.sensor = n.sensor AND p.frame_no = n.frame_no - 1 WHERE n.sensor = q.sensor AND n.frame_no = q.frame_no AND n.label = q.label AND pow(n.x - p.x, 2) + pow(n.y - p.y, 2) < 100)),
t AS (SELECT sensor, frame_no, pl, MIN(label) AS label FROM g GROUP BY 1, 2, 3)
SELECT c.sensor, c.frame_no, c.label AS cluster_label, t.pl AS prev_label FROM c LEFT JOIN t ON t.sensor = c.sensor AND t.frame_no = c.frame_no AND t.label = c.label""")
def associated_clusters(spark, sf):
    # the orders of a sensor are dealt out once; clusters and both frames that meet stay where they are
    li = ad.table(spark, sf, "lineitem").withColumn("sensor", F.expr("l_orderkey div 50")).repartition("sensor")
    c = li.groupBy("sensor", "l_orderkey", "l_linenumber").agg(
        F.avg(F.col("l_quantity").cast("double")).alias("x"), F.avg(F.col("l_extendedprice").cast("double") / 2000).alias("y"),
        F.avg(F.col("l_discount").cast("double")).alias("d"),
    ).select(
        "sensor", (F.col("l_orderkey") % 50).alias("frame_no"), F.col("l_linenumber").cast("long").alias("cluster_label"),
        F.array("x", "y").alias("center"), F.array(F.lit(1.0), F.lit(2.0)).alias("size"), (F.col("d") * 100 - 5 + F.col("l_linenumber") * 0.001).alias("avg_velocity"),
    )
    prev = c.withColumn("frame_no", F.col("frame_no") + 1)
    return cu.associate_clusters(c, prev, ["sensor", "frame_no"], 10.0, 2.0).select("sensor", "frame_no", "cluster_label", "prev_label")
