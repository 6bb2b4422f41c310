"""Density clustering of point clouds, exact and without listing the pairs of a group.

A radar frame has a few hundred points at most, so groups up to ``KERNEL_POINTS`` are
gathered whole and labelled in one Arrow batch: one shuffle, no join. Larger groups take
the grid: points are cut into grid cells whose diagonal is the search radius, so all points of one
cell are neighbours of each other. A cell with enough points is dense: its points are
core points without any pair being looked at. Only the few points of sparse cells are
compared with the surrounding cells. Two cells are linked by testing the boxes around
their core points; only where the boxes leave it open are points compared, and cells
that are too full for that are refined first. Components are then found on cells.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangelake.operators.ordered import ROWS_PER_TASK, join_keys, oversized, with_position
from rangelake.session import cut_lineage

# Radius of the squared metric and size smoothing factor.
OBJECT_RADIUS_SQ = 1.25
SIZE_SMOOTHING = 0.875
KERNEL_POINTS = 1024
_PAIRS_PER_CELL_PAIR = 1_000_000


def _names(prefix: str, dims: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(dims)]


def _dist2(a: str, b: str, dims: int) -> Column:
    total = F.lit(0.0)
    for i in range(dims):
        d = F.col(f"{a}{i}") - F.col(f"{b}{i}")
        total = total + d * d
    return total


def _coarse(dims: int, cell: str = "_c") -> list[Column]:
    """Blocks of two cells per axis, wider than the radius: neighbours lie one block away at most."""
    return [F.floor(F.col(f"{cell}{i}") / 2).cast("long") for i in range(dims)]


def _around(df: DataFrame, dims: int) -> DataFrame:
    """Each row once per surrounding block as ``_n0.._n{d-1}``."""
    offsets = F.array(*[
        F.struct(*[F.lit(v).cast("long").alias(f"o{i}") for i, v in enumerate(o)])
        for o in itertools.product((-1, 0, 1), repeat=dims)
    ])
    return df.withColumn("_o", F.explode(offsets)).withColumns(
        {f"_n{i}": c + F.col(f"_o.o{i}") for i, c in enumerate(_coarse(dims))}
    ).drop("_o")


def _sites(points: DataFrame, keys: Sequence[str], coords: list[Column], pid: str, radius: float) -> DataFrame:
    """Distinct positions with multiplicity, first point id and grid cell."""
    dims = len(coords)
    side = radius / math.sqrt(dims) * (1 - 1e-9)
    at = points.select(*keys, F.col(pid).alias("_pid"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(coords)])
    sites = at.groupBy(*keys, *_names("_x", dims)).agg(F.count(F.lit(1)).alias("_m"), F.min("_pid").alias("_first"))
    return sites.withColumns({f"_c{i}": F.floor(F.col(f"_x{i}") / side).cast("long") for i in range(dims)})


def _box(df: DataFrame, group: list[str], dims: int) -> DataFrame:
    aggs = [f(f"_x{i}").alias(f"{n}{i}") for i in range(dims) for f, n in ((F.min, "_lo"), (F.max, "_hi"))]
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n_sites"), *aggs)


def _span2(dims: int, far: bool) -> Column:
    """Largest (``far``) or smallest squared distance between boxes a and b."""
    total = F.lit(0.0)
    for i in range(dims):
        a_lo, a_hi, b_lo, b_hi = (F.col(f"{p}{i}") for p in ("_alo", "_ahi", "_blo", "_bhi"))
        if far:
            d = F.greatest(b_hi - a_lo, a_hi - b_lo)
        else:
            d = F.greatest(b_lo - a_hi, a_lo - b_hi, F.lit(0.0))
        total = total + d * d
    return total


def _links(core: DataFrame, keys: list[str], dims: int, radius: float) -> DataFrame:
    """Pairs of core cells that hold two core points within the radius: keys, u, v (cell ids)."""
    r2 = radius * radius
    cells = _names("_c", dims)
    boxes = _box(core, [*keys, *cells, "_cell"], dims)
    side = lambda p: [F.col(f"{n}{i}").alias(f"_{p}{n[1:]}{i}") for i in range(dims) for n in ("_lo", "_hi")]
    blocks = [f"_n{i}" for i in range(dims)]
    a = _around(boxes, dims).select(*keys, F.col("_cell").alias("u"), F.col("_n_sites").alias("_an"), *side("a"), *blocks)
    b = boxes.select(
        *keys, F.col("_cell").alias("v"), F.col("_n_sites").alias("_bn"), *side("b"), *[c.alias(n) for c, n in zip(_coarse(dims), blocks)]
    )
    pairs = a.join(b, [*keys, *blocks]).filter((F.col("u") < F.col("v")) & (_span2(dims, False) <= r2)).drop(*blocks)
    pairs = cut_lineage(pairs.withColumn("_sure", _span2(dims, True) <= r2).select(*keys, "u", "v", "_an", "_bn", "_sure"))
    sure = pairs.filter("_sure").select(*keys, "u", "v")
    return sure.unionByName(_open_links(core, pairs.filter(~F.col("_sure")), keys, dims, radius))


def _open_links(core: DataFrame, pairs: DataFrame, keys: list[str], dims: int, radius: float) -> DataFrame:
    """Links the boxes cannot decide, by comparing points. Overfull pairs are cut into finer
    boxes until the remaining comparisons per pair of boxes are bounded."""
    r2 = radius * radius
    full = F.col("_an") * F.col("_bn") > _PAIRS_PER_CELL_PAIR
    site = [*keys, "_cell", *_names("_x", dims)]
    left = lambda df, box: df.select(*keys, F.col("_cell").alias("u"), *box, *[F.col(f"_x{i}").alias(f"_p{i}") for i in range(dims)])
    right = lambda df, box: df.select(*keys, F.col("_cell").alias("v"), *box, *[F.col(f"_x{i}").alias(f"_q{i}") for i in range(dims)])
    small = pairs.filter(~full).select(*keys, "u", "v")
    found = (
        small.join(left(core.select(*site), []), [*keys, "u"]).join(right(core.select(*site), []), [*keys, "v"])
        .filter(_dist2("_p", "_q", dims) <= r2).select(*keys, "u", "v").distinct()
    )
    rest = pairs.filter(full).select(*keys, "u", "v")
    step = radius / math.sqrt(dims)
    while not rest.isEmpty():
        step = step / 8
        subs = [F.floor(F.col(f"_x{i}") / step).cast("long").alias(f"_s{i}") for i in range(dims)]
        fine = core.select(*site, *subs)
        sub_names = _names("_s", dims)
        boxes = _box(fine, [*keys, "_cell", *sub_names], dims)
        pick = lambda p, cell: boxes.select(
            *keys, F.col("_cell").alias(cell), F.col("_n_sites").alias(f"_{p}n"),
            *[F.col(s).alias(f"_{p}{s}") for s in sub_names],
            *[F.col(f"{n}{i}").alias(f"_{p}{n[1:]}{i}") for i in range(dims) for n in ("_lo", "_hi")],
        )
        open_ = rest.join(pick("a", "u"), [*keys, "u"]).join(pick("b", "v"), [*keys, "v"]).filter(_span2(dims, False) <= r2)
        sure = open_.filter(_span2(dims, True) <= r2).select(*keys, "u", "v").distinct()
        found = found.unionByName(sure)
        open_ = open_.join(sure, [*keys, "u", "v"], "left_anti")
        a_names, b_names = [f"_a{s}" for s in sub_names], [f"_b{s}" for s in sub_names]
        few = open_.filter(~full).select(*keys, "u", "v", *a_names, *b_names)
        hit = (
            few.join(left(fine, [F.col(s).alias(f"_a{s}") for s in sub_names]), [*keys, "u", *a_names])
            .join(right(fine, [F.col(s).alias(f"_b{s}") for s in sub_names]), [*keys, "v", *b_names])
            .filter(_dist2("_p", "_q", dims) <= r2).select(*keys, "u", "v").distinct()
        )
        found = cut_lineage(found.unionByName(hit).distinct())
        rest = cut_lineage(open_.filter(full).select(*keys, "u", "v").distinct().join(found, [*keys, "u", "v"], "left_anti"))
    return found


def components(nodes: DataFrame, links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest node id reachable from each node: keys, node, root.

    Labels spread over links and jump through their own label each round, so long chains
    need few rounds. Every round is written to the checkpoint folder.
    """
    keys = list(keys)
    both = cut_lineage(links.select(*keys, "u", "v").unionByName(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))))
    linked = both.select(*keys, F.col("u").alias("node")).distinct()
    labels = cut_lineage(linked.withColumn("root", F.col("node")))
    while True:
        told = both.join(labels.withColumnRenamed("node", "u"), [*keys, "u"]).groupBy(*keys, F.col("v").alias("node")).agg(F.min("root").alias("_r"))
        spread = labels.join(told, [*keys, "node"]).select(*keys, "node", F.col("root").alias("_old"), F.least("root", "_r").alias("_near"))
        above = spread.select(*keys, F.col("node").alias("_near"), F.col("_near").alias("_far"))
        nxt = cut_lineage(spread.join(above, [*keys, "_near"]).select(*keys, "node", "_old", F.least("_near", "_far").alias("root")))
        changed = not nxt.filter(F.col("root") != F.col("_old")).isEmpty()
        labels = nxt.drop("_old")
        if not changed:
            break
    alone = nodes.select(*keys, "node").join(linked, [*keys, "node"], "left_anti").withColumn("root", F.col("node"))
    return labels.unionByName(alone)


def _near(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (both ways, and a point with itself) of points within the radius. Along the first axis, only points that the radius reaches are compared."""
    order = np.argsort(x[:, 0], kind="stable")
    y = x[order]
    # a little further than the radius, so that rounding leaves no pair out
    count = np.searchsorted(y[:, 0], y[:, 0] + radius * (1 + 1e-9), "right") - np.arange(len(y)) - 1
    left = np.repeat(np.arange(len(y)), count)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
    within = lambda p, q: sum((p[:, k] - q[:, k]) ** 2 for k in range(x.shape[1])) <= radius * radius
    near = within(y[left], y[right])
    u, v, own = order[left[near]], order[right[near]], np.flatnonzero(within(x, x))
    return np.concatenate([u, v, own]), np.concatenate([v, u, own])


def _labels(x: np.ndarray, radius: float, min_samples: int) -> np.ndarray:
    """Labels of one small group whose points are in order."""
    n = len(x)
    here, there = _near(x, radius)
    core = np.bincount(here, minlength=n) >= min_samples
    asks = core[there]
    here, there = here[asks], there[asks]
    inner = core[here]
    u, v = here[inner], there[inner]
    # the last root is nobody's: that of points that are no core points
    root = np.append(np.where(core, np.arange(n), n), n)
    while True:
        # least root among core neighbours, then through that root's own root
        told = root.copy()
        np.minimum.at(told, u, root[v])
        told = told[told]
        if (told == root).all():
            break
        root = told
    reached = np.full(n, n)
    np.minimum.at(reached, here, root[there])
    firsts = np.unique(root[:n][core])
    return np.where(reached < n, np.searchsorted(firsts, reached), -1)


def _kernel_dbscan(points: DataFrame, keys: list[str], coords: list[Column], pid: str, radius: float, min_samples: int) -> DataFrame:
    """Label groups of bounded size: gather a group into one row, label it, unpack it."""
    dims = len(coords)
    xs = _names("_x", dims)
    others = [c for c in points.columns if c not in keys]
    packed = points.withColumns({x: c.cast("double") for x, c in zip(xs, coords)}).groupBy(*keys).agg(
        F.collect_list(F.struct(*others, *xs)).alias("_rows")
    )

    def label(pids: pa.Array, axes: list[pa.Array]) -> pa.Array:
        cuts = pids.offsets.to_numpy()
        order_by = pids.flatten().to_numpy(zero_copy_only=False)
        x = np.stack([a.flatten().to_numpy(zero_copy_only=False) for a in axes], axis=1)
        out = np.empty(len(order_by), dtype=np.int64)
        cuts = cuts - cuts[0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            order = np.argsort(order_by[a:b], kind="stable")
            part = np.empty(b - a, dtype=np.int64)
            part[order] = _labels(x[a:b][order], radius, min_samples)
            out[a:b] = part
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(out))

    # An Arrow UDF takes a fixed number of arguments.
    forms = {
        1: lambda p: lambda i, a: p(i, [a]), 2: lambda p: lambda i, a, b: p(i, [a, b]),
        3: lambda p: lambda i, a, b, c: p(i, [a, b, c]), 4: lambda p: lambda i, a, b, c, d: p(i, [a, b, c, d]),
    }
    kernel = F.arrow_udf(forms[dims](label), returnType="array<bigint>")
    labelled = packed.withColumn("_labels", kernel(F.col(f"_rows.{pid}"), *[F.col(f"_rows.{x}") for x in xs]))
    flat = labelled.select(*keys, F.inline(F.arrays_zip("_rows", "_labels")))
    return flat.select(*[F.col(c) if c in keys else F.col(f"_rows.{c}").alias(c) for c in points.columns], F.col("_labels").alias("cluster_label"))


def dbscan(
    points: DataFrame, keys: Sequence[str], coords: list[Column], pid: str, radius: float, min_samples: int,
    limit: int | None = ROWS_PER_TASK, kernel_points: int = KERNEL_POINTS,
) -> DataFrame:
    """Add ``cluster_label``: -1 for noise, else clusters numbered by their first core point.

    A border point takes the lowest-numbered cluster that reaches it. ``pid`` orders and
    identifies the points of a group. Groups above ``kernel_points`` go through the grid; labels are the
    same either way. A point with a NULL or NaN coordinate is noise; a NULL key is a group like others.
    """
    keys = list(keys)
    # stored: the sizes of the groups and both kinds of groups read the points
    named = cut_lineage(points.withColumns({f"_z{i}": c.cast("double") for i, c in enumerate(coords)}))
    coords = [F.col(f"_z{i}") for i in range(len(coords))]
    # a point without a place is near to nothing
    placed = functools.reduce(lambda a, b: a & b, (c.isNotNull() & ~F.isnan(c) for c in coords))
    whole = named.filter(placed)
    large = oversized(whole, keys, kernel_points)
    if large.isEmpty():
        found = _kernel_dbscan(whole, keys, coords, pid, radius, min_samples)
    else:
        # one struct as the key of a group: equal where fields are NULL, too
        grouped = whole.withColumn("_g", F.struct(*keys))
        groups = large.select(F.struct(*keys).alias("_g"))
        few = _kernel_dbscan(grouped.join(groups, "_g", "left_anti"), ["_g"], coords, pid, radius, min_samples)
        many = _grid_dbscan(grouped.join(groups, "_g", "left_semi"), ["_g"], coords, pid, radius, min_samples, limit)
        found = few.unionByName(many).drop("_g")
    lost = named.filter(~placed).withColumn("cluster_label", F.lit(-1).cast("long"))
    return found.unionByName(lost).drop(*(f"_z{i}" for i in range(len(coords))))


def _grid_dbscan(
    points: DataFrame, keys: Sequence[str], coords: list[Column], pid: str, radius: float, min_samples: int,
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Label groups of any size."""
    keys, dims = list(keys), len(coords)
    xs, cs = _names("_x", dims), _names("_c", dims)
    r2 = radius * radius
    sites = _sites(points, keys, coords, pid, radius)
    counts = sites.groupBy(*keys, *cs).agg(F.sum("_m").alias("_in_cell"))
    if min_samples <= 1:
        core, reached = sites, None
    else:
        tagged = sites.join(counts, [*keys, *cs])
        dense = tagged.filter(F.col("_in_cell") >= min_samples).drop("_in_cell")
        sparse = tagged.filter(F.col("_in_cell") < min_samples)
        asks = _around(sparse.select(*keys, *cs, *[F.col(x).alias(f"_p{i}") for i, x in enumerate(xs)]), dims)
        blocks = _names("_n", dims)
        answers = sites.select(
            *keys, *[c.alias(n) for c, n in zip(_coarse(dims), blocks)], *[F.col(c).alias(f"_d{i}") for i, c in enumerate(cs)],
            *[F.col(x).alias(f"_q{i}") for i, x in enumerate(xs)], "_m",
        )
        elsewhere = F.lit(False)
        for i, c in enumerate(cs):
            elsewhere = elsewhere | (F.col(c) != F.col(f"_d{i}"))
        reached = cut_lineage(
            asks.join(answers, [*keys, *blocks]).filter(elsewhere & (_dist2("_p", "_q", dims) <= r2))
            .select(*keys, *_names("_p", dims), *_names("_q", dims), "_m")
        )
        extra = reached.groupBy(*keys, *_names("_p", dims)).agg(F.sum("_m").alias("_extra"))
        extra = extra.select(*keys, *[F.col(f"_p{i}").alias(x) for i, x in enumerate(xs)], "_extra")
        more = sparse.join(extra, [*keys, *xs], "left").filter(F.col("_in_cell") + F.coalesce("_extra", F.lit(0)) >= min_samples)
        core = dense.unionByName(more.drop("_in_cell", "_extra"))
    ids = core.groupBy(*keys, *cs).agg(F.min("_first").alias("_cell"))
    core = cut_lineage(core.join(ids, [*keys, *cs]))
    roots = components(core.select(*keys, F.col("_cell").alias("node")).distinct(), _links(core, keys, dims, radius), keys)
    rooted = core.join(roots.withColumnRenamed("node", "_cell"), [*keys, "_cell"]).select(*keys, *xs, "root")
    owned = rooted
    if reached is not None:
        by_reach = reached.join(
            rooted.select(*keys, *[F.col(x).alias(f"_q{i}") for i, x in enumerate(xs)], "root"), [*keys, *_names("_q", dims)]
        ).select(*keys, *[F.col(f"_p{i}").alias(x) for i, x in enumerate(xs)], "root")
        # a sparse cell may hold core points too; they reach every point of the cell
        cell_roots = core.select(*keys, *cs, "_cell").distinct().join(roots.withColumnRenamed("node", "_cell"), [*keys, "_cell"])
        by_cell = sparse.join(cell_roots.select(*keys, *cs, "root"), [*keys, *cs]).select(*keys, *xs, "root")
        border = by_reach.unionByName(by_cell).groupBy(*keys, *xs).agg(F.min("root").alias("root")).join(
            rooted, [*keys, *xs], "left_anti"
        )
        owned = rooted.unionByName(border)
    numbers = with_position(roots.select(*keys, "root").distinct(), keys, ["root"], limit).select(
        *keys, "root", F.col("_pos").alias("cluster_label")
    )
    labelled = owned.join(numbers, [*keys, "root"]).select(*keys, *xs, "cluster_label")
    out = points.withColumns({f"_x{i}": c.cast("double") for i, c in enumerate(coords)})
    return out.join(labelled, [*keys, *xs], "left").drop(*xs).withColumn(
        "cluster_label", F.coalesce("cluster_label", F.lit(-1)).cast("long")
    )


def standardize(points: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """Add each named expression scaled to mean 0 and population deviation 1 per group (a
    constant column only loses its mean). Statistics are one aggregate, joined back."""
    named = points.withColumns(columns)
    stats = named.groupBy(*keys).agg(
        *[f(n).alias(f"_{p}_{n}") for n in columns for f, p in ((F.avg, "mean"), (F.stddev_pop, "dev"))]
    )
    out = join_keys(named, stats, keys)
    scaled = {}
    for n in columns:
        dev = F.when(F.col(f"_dev_{n}") > 0, F.col(f"_dev_{n}")).otherwise(1.0)
        scaled[n] = (F.col(n) - F.col(f"_mean_{n}")) / dev
    return out.withColumns(scaled).drop(*[f"_{p}_{n}" for n in columns for p in ("mean", "dev")])


def cluster_points(
    points: DataFrame, keys: Sequence[str], pid: str, eps: float, min_samples: int, velocity_weight: float
) -> DataFrame:
    """Cluster on standardised x, y and weighted velocity; adds ``cluster_label``."""
    names = ["_sx", "_sy", "_sv"] if velocity_weight else ["_sx", "_sy"]
    values = {"_sx": F.col("x"), "_sy": F.col("y"), "_sv": F.col("velocity") * velocity_weight}
    scaled = standardize(points, keys, {n: values[n] for n in names})
    return dbscan(scaled, keys, [F.col(n) for n in names], pid, eps, min_samples).drop(*names)


def cluster_counts(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Clusters and noise points per group."""
    label = F.col("cluster_label")
    return labelled.groupBy(*keys).agg(
        (F.max(label) + 1).alias("n_clusters"), F.sum(F.when(label == -1, 1).otherwise(0)).alias("n_noise"), F.count(F.lit(1)).alias("n_points")
    )


def cluster_objects(
    det: DataFrame, keys: Sequence[str], pid: str, weight: float, doppler_resolution: float, elevation: bool = False
) -> DataFrame:
    """Group detections (x, y[, z], doppler_bin) whose combined squared distance is at most 1.25
    (chains join) and summarise: num_points, center, size, avg_velocity per cluster."""
    axes = ["x", "y", "z"] if elevation else ["x", "y"]
    coords = [F.col(a) for a in axes] + [F.col("doppler_bin") * (doppler_resolution * math.sqrt(weight))]
    labelled = dbscan(det, keys, coords, pid, math.sqrt(OBJECT_RADIUS_SQ), 1)
    return labelled.groupBy(*keys, "cluster_label").agg(
        F.count(F.lit(1)).alias("num_points"),
        F.array(*[F.avg(a) for a in axes]).alias("center"),
        F.array(*[F.max(a) - F.min(a) for a in axes]).alias("size"),
        (F.avg("doppler_bin") * doppler_resolution).alias("avg_velocity"),
    )


#: Pairs of clusters that are compared at a time; frames with more previous clusters go through a grid.
_PAIRS_AT_ONCE, _GRID_FROM = 4_000_000, 256


def _any_within(x: np.ndarray, y: np.ndarray, start: np.ndarray, count: np.ndarray, px: np.ndarray, py: np.ndarray, eps: float) -> np.ndarray:
    """For each point whether one of the ``count`` others from ``start`` on is nearer than ``eps``."""
    out, ends, low = np.zeros(len(x), bool), np.cumsum(count), 0
    while low < len(x):
        done = ends[low] - count[low]
        high = max(low + 1, int(np.searchsorted(ends, done + _PAIRS_AT_ONCE, "right")))
        own = count[low:high]
        row = np.repeat(np.arange(low, high), own)
        at = np.arange(len(row)) + np.repeat(start[low:high] - (ends[low:high] - own - done), own)
        dx, dy = x[row] - px[at], y[row] - py[at]
        out[row[dx * dx + dy * dy < eps * eps]] = True
        low = high
    return out


def _near_any(frame: np.ndarray, x: np.ndarray, y: np.ndarray, cuts: np.ndarray, px: np.ndarray, py: np.ndarray, eps: float) -> np.ndarray:
    """For each point whether a previous one of its frame is nearer than ``eps``; those of frame k lie from ``cuts[k]`` on."""
    start, count = cuts[frame], np.diff(cuts)[frame]
    few = count <= _GRID_FROM
    near = np.zeros(len(x), bool)
    near[few] = _any_within(x[few], y[few], start[few], count[few], px, py, eps)
    for k in np.unique(frame[~few]):
        there = [v[cuts[k] : cuts[k + 1]] for v in (px, py)]
        there = [v[np.isfinite(there[0]) & np.isfinite(there[1])] for v in there]
        here = np.flatnonzero((frame == k) & np.isfinite(x) & np.isfinite(y))
        if not len(there[0]) or not len(here):
            continue
        # cells by column and row; the three cells of a column that are around a point lie side by side
        columns, cx = np.unique(np.floor(there[0] / eps), return_inverse=True)
        order = np.lexsort((np.floor(there[1] / eps), cx))
        qx, qy = (v[order] for v in there)
        rows, first = np.floor(qy / eps), np.searchsorted(cx[order], np.arange(len(columns) + 1))
        gx, gy = np.floor(x[here] / eps), np.floor(y[here] / eps)
        for step in (-1, 0, 1):
            c = np.searchsorted(columns, gx + step)
            met = np.flatnonzero((c < len(columns)) & (columns[np.minimum(c, len(columns) - 1)] == gx + step))
            for column in np.unique(c[met]):
                own = met[c[met] == column]
                low, high = first[column], first[column + 1]
                a = low + np.searchsorted(rows[low:high], gy[own] - 1, "left")
                b = low + np.searchsorted(rows[low:high], gy[own] + 1, "right")
                near[here[own]] |= _any_within(x[here[own]], y[here[own]], a, b - a, qx, qy, eps)
    return near


def _carried(eps: float, v_factor: float, known: pa.Array, *lists: pa.Array) -> pa.Array:
    """For the clusters of many frames, side by side, their place in the frame and the label they carry on (NULL: a new one).

    ``lists`` are label, x, y, velocity of the clusters, then of the previous ones. A frame without a key (not ``known``) has no previous one.
    """
    cuts = [x.offsets.to_numpy().astype(np.int64) for x in (lists[0], lists[4])]
    cuts = [c - c[0] for c in cuts]
    frame, before = (np.repeat(np.arange(len(c) - 1), np.diff(c)) for c in cuts)
    flat = [x.flatten() for x in lists]
    (label, x, y, v), (old, px, py, pv) = ([f.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) if i % 4 else f.fill_null(0).to_numpy() for i, f in enumerate(flat[k : k + 4])] for k in (0, 4))
    named, old_named = (flat[k].is_valid().to_numpy(zero_copy_only=False) for k in (0, 4))

    # all on one axis: what came before (equal velocities in falling order of label), the cluster, what comes after
    some, mine = np.flatnonzero(~np.isnan(pv)), np.arange(len(v))
    side = np.repeat([0, 1, 2], [len(some), len(v), len(some)])
    at = np.concatenate([some, mine, some])
    rank = np.concatenate([-old[some], np.zeros(len(v), old.dtype), old[some]])
    ranked = np.concatenate([old_named[some], np.ones(len(v), bool), old_named[some]])
    axis = np.concatenate([before[some], frame, before[some]])
    order = np.lexsort((rank, ranked, side, np.concatenate([pv[some], v, pv[some]]), axis))
    place, side, at, axis = np.arange(len(order)), side[order], at[order], axis[order]
    own = np.flatnonzero(side == 1)
    hits = []
    for k, found in ((0, np.maximum.accumulate(np.where(side == 0, place, -1))), (2, np.minimum.accumulate(np.where(side == 2, place, len(order))[::-1])[::-1])):
        there = np.clip(found[own], 0, max(len(order) - 1, 0))
        hit = np.full(len(v), -1)
        hit[at[own]] = np.where((side[there] == k) & (axis[there] == axis[own]), at[there], -1)
        hits.append(hit)
    if len(pv):
        apart = [np.where(h >= 0, np.abs(pv[h] - v), np.nan) for h in hits]
        hit = np.where((hits[1] < 0) | (apart[0] <= apart[1]), hits[0], hits[1])
        passed = (hit >= 0) & (np.abs(v - pv[hit]) < np.minimum(v_factor, np.abs(v))) & named & known.to_numpy(zero_copy_only=False)[frame]
    else:
        hit, passed = np.full(len(v), -1), np.zeros(len(v), bool)

    # clusters of one label share their place; a label that is carried goes to the lowest one
    group = np.zeros(len(v), np.int64)
    order = np.lexsort((label, named, frame))
    group[order] = np.cumsum((np.diff(frame[order], prepend=-1) != 0) | (np.diff(label[order], prepend=0) != 0) | (np.diff(named[order].astype(int), prepend=-1) != 0)) - 1
    asks = np.flatnonzero(np.isin(group, group[passed]))
    there = np.zeros(len(v), bool)
    there[group[asks[_near_any(frame[asks], x[asks], y[asks], cuts[1], px, py, eps)]]] = True
    passed = np.flatnonzero(passed & there[group])
    taken = old[hit[passed]], old_named[hit[passed]]
    order = np.lexsort((label[passed], *taken, frame[passed]))
    new = np.zeros(len(order), bool)
    for key in (frame[passed], *taken):
        new |= np.r_[True, np.diff(key[order].astype(np.int64)) != 0][: len(order)]
    winner = order[new]
    winner = winner[np.argsort(group[passed[winner]], kind="stable")]
    won = np.bincount(group[passed[winner]], minlength=len(v))
    size = np.maximum(won[group], 1)
    row = np.repeat(mine, size)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    carried = won[group[row]] > 0
    pick = winner[(np.cumsum(won) - won)[group[row[carried]]] + nth[carried]]
    value, given = np.zeros(len(row), np.int64), np.zeros(len(row), bool)
    value[carried], given[carried] = taken[0][pick], taken[1][pick]
    ends = np.concatenate([[0], np.cumsum(size)])[cuts[0]].astype(np.int32)
    each = pa.StructArray.from_arrays([pa.array((row - cuts[0][frame[row]]).astype(np.int32)), pa.array(value, mask=~given)], names=["at", "prev"])
    return pa.ListArray.from_arrays(pa.array(ends), each)


def associate_clusters(
    new: DataFrame, previous: DataFrame, by: Sequence[str], eps: float, v_factor: float
) -> DataFrame:
    """Carry cluster identity from the previous frame: adds ``prev_label`` (NULL for a new
    cluster) and the smoothed ``size``.

    The previous cluster of nearest velocity is taken if it is nearer than the smaller of
    ``v_factor`` and the cluster's own speed and some previous cluster lies within ``eps``;
    each previous cluster is taken once, by the lowest new label. A sensor's frame has a bounded
    number of clusters, so both sides of a frame meet as arrays in one grouping, and a kernel goes
    over many frames at a time. Where the tables come by a part of ``by``, nothing is sent again.
    """
    by = list(by)
    rest = [c for c in new.columns if c not in by]
    old = ["cluster_label", "center", "avg_velocity"]
    both = new.select(*by, F.struct(*rest).alias("_n"), F.lit(None).cast(previous.select(F.struct(*old).alias("s")).schema["s"].dataType).alias("_p"))
    both = both.union(previous.select(*by, F.lit(None).cast(both.schema["_n"].dataType), F.struct(*old)))
    frames = both.groupBy(*by).agg(F.collect_list("_n").alias("_n"), F.collect_list("_p").alias("_p")).filter(F.size("_n") > 0)
    axes = {"label": lambda t: t["cluster_label"].cast("long"), "x": lambda t: t["center"][0].cast("double"), "y": lambda t: t["center"][1].cast("double"), "v": lambda t: t["avg_velocity"].cast("double")}
    numbers = [F.transform(c, axis) for c in ("_n", "_p") for axis in axes.values()]
    whole = F.lit(True)
    for k in by:
        whole = whole & F.col(k).isNotNull()

    def run(known: pa.Array, *lists: pa.Array) -> pa.Array:
        return _carried(eps, v_factor, known, *lists)

    kernel = F.arrow_udf(run, returnType="array<struct<at:int,prev:bigint>>")
    each = frames.withColumn("_c", kernel(whole, *numbers)).select(*by, "_n", F.explode("_c").alias("_c"))
    row = F.col("_n")[F.col("_c.at")]
    named = each.select(*by, row.alias("_n"), F.col("_c.prev").cast(previous.schema["cluster_label"].dataType).alias("prev_label"))
    out = named.select(*(F.col(c) if c in by else F.col(f"_n.{c}").alias(c) for c in new.columns), "prev_label")
    smooth = F.when(F.col("prev_label").isNotNull(), F.transform("size", lambda s: s * SIZE_SMOOTHING)).otherwise(F.col("size"))
    return out.withColumn("size", smooth)
