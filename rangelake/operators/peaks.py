"""Detection pruning, peak grouping and simple gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangelake.operators.ordered import join_keys


def skip_border(df: DataFrame, bins: dict[str, int], k: int = 4) -> DataFrame:
    """Drop the first and last ``k`` bins of each axis; ``bins`` maps axis name to size."""
    for name, size in bins.items():
        df = df.filter((F.col(name) >= k) & (F.col(name) < size - k))
    return df


def range_prune(
    det: DataFrame,
    snr_bands: Sequence[tuple[float, float]],
    peak_bands: Sequence[tuple[float, float]],
    min_bin: float,
    max_bin: float,
    range_resolution: float,
) -> DataFrame:
    """Keep detections inside the bin gate that meet the SNR and peak demands.

    ``snr_bands`` = three (end metre, SNR) pairs, ``peak_bands`` = (end metre, peak) pairs.
    A detection exactly on the second SNR boundary is dropped.
    """
    metres = F.col("range_bin") * range_resolution
    (r0, s0), (r1, s1), (_, s2) = snr_bands
    snr_ok = (
        ((metres < r0) & (F.col("snr") > s0))
        | ((metres >= r0) & (metres < r1) & (F.col("snr") > s1))
        | ((metres > r1) & (F.col("snr") > s2))
    )
    weak = F.lit(False)
    for end, peak in peak_bands[:2]:
        weak = weak | ((metres < end) & (F.col("peak_val") < peak))
    return det.filter(F.col("range_bin").between(min_bin, max_bin) & snr_ok & ~weak)


def filter_boxes(raw: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Keep persons, bicycles, cars and motorcycles above the confidence; corner form to x, y, w, h."""
    # Class names by class id.
    names = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle"}
    kind = F.lit("unknown")
    for class_id, name in names.items():
        kind = F.when(F.col("class_id") == class_id, name).otherwise(kind)
    cut = lambda c: c.cast("int")
    x1, y1, x2, y2 = (cut(F.col(c)) for c in ("x1", "y1", "x2", "y2"))
    others = [c for c in raw.columns if c not in ("x1", "y1", "x2", "y2")]
    return raw.filter(F.col("class_id").isin(list(names)) & (F.col("confidence") > min_confidence)).select(
        *others, x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"), kind.alias("object_type")
    )


def in_boundary(points: DataFrame, boxes: Sequence[tuple[float, float, float, float]]) -> DataFrame:
    """Keep points strictly inside any (left, right, bottom, top) box.

    Boxes are a handful of configured regions, so they become a filter expression.
    """
    inside = F.lit(False)
    for left, right, bottom, top in boxes:
        inside = inside | (
            (F.col("x") > left) & (F.col("x") < right) & (F.col("y") > bottom) & (F.col("y") < top)
        )
    return points.filter(inside)


# Where a point lies with respect to its sensor's boundary boxes.
INSIDE, BEHIND_THE_WALL = "inside", "behind the wall"


def boundary_labels(points: DataFrame, boxes: DataFrame, by: Sequence[str], cell: float = 1.0) -> DataFrame:
    """Add ``boundary``: whether a point lies strictly inside a box of its sensor; NULL where the sensor has no boxes.

    ``boxes``: by, left, right, bottom, top. They are laid on a grid of ``cell`` metres, so a point meets the boxes of its own cell
    only, which travel as one short list; no point is lost or doubled. A point without x or y is behind the wall.
    """
    step = lambda c: F.floor(c / cell)
    along = lambda low, high: F.explode(F.sequence(step(F.col(low)), step(F.col(high))))
    laid = boxes.withColumn("_cx", along("left", "right")).withColumn("_cy", along("bottom", "top"))
    lists = laid.groupBy(*by, "_cx", "_cy").agg(F.collect_list(F.struct("left", "right", "bottom", "top")).alias("_boxes"))
    known = boxes.select(*by).distinct().withColumn("_known", F.lit(True))
    placed = points.withColumns({"_cx": step(F.col("x")), "_cy": step(F.col("y"))})
    met = join_keys(join_keys(placed, lists, [*by, "_cx", "_cy"], "left"), known, list(by), "left")
    inside = F.exists("_boxes", lambda b: (F.col("x") > b["left"]) & (F.col("x") < b["right"]) & (F.col("y") > b["bottom"]) & (F.col("y") < b["top"]))
    label = F.when(F.col("_known").isNull(), F.lit(None)).when(F.coalesce(inside, F.lit(False)), INSIDE).otherwise(BEHIND_THE_WALL)
    return met.withColumn("boundary", label).drop("_cx", "_cy", "_boxes", "_known")


def cap_objects(det: DataFrame, keys: Sequence[str], order: Sequence[str | Column], cap: int) -> DataFrame:
    """At most ``cap`` objects per frame in list order. Spark turns the rank filter into
    a group limit that prunes inside each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return det.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= cap).drop("_rank")


def _capped(det: DataFrame, keys: Sequence[str], cap: int | None) -> DataFrame:
    return det if cap is None else cap_objects(det, keys, ["range_bin", "doppler_bin"], cap)


def _circular_neighbours(rd: DataFrame, keys: Sequence[str], n_doppler: int, steps: Sequence[int]) -> DataFrame:
    """Values at doppler_bin + step (circular) on complete maps, one column per step.

    The Doppler axis of a map row is bounded, so the row is packed into one array
    and neighbours are array reads: one shuffle for any number of steps.
    """
    row = F.array_sort(F.collect_list(F.struct("doppler_bin", "value")))
    packed = rd.groupBy(*keys, "range_bin").agg(row.alias("_row")).select(*keys, "range_bin", F.col("_row.value").alias("_v"))
    v = F.col("_v")
    at = lambda i: F.element_at(v, (F.pmod(i, F.lit(n_doppler)) + 1).cast("int"))
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(n_doppler - 1)),
        lambda i: F.struct(
            i.cast("long").alias("doppler_bin"), at(i).alias("value"),
            *[at(i + s).alias(f"_n{s}") for s in steps],
        ),
    )
    return packed.select(*keys, "range_bin", F.inline(cells))


def prune_to_peaks(
    det: DataFrame, rd: DataFrame, keys: Sequence[str], n_doppler: int, reserve_neighbor: bool = False
) -> DataFrame:
    """Keep detections that are local peaks along Doppler (circular).

    With ``reserve_neighbor`` the larger neighbour of a peak is kept too.
    """
    around = _circular_neighbours(rd, keys, n_doppler, [-2, -1, 1, 2])
    v = F.col("value")
    keep = (v > F.col("_n-1")) & (v > F.col("_n1"))
    if reserve_neighbor:
        keep = keep | ((v > F.col("_n2")) & (v > F.col("_n-1"))) | ((v > F.col("_n-2")) & (v > F.col("_n1")))
    bins = around.filter(keep).select(*keys, "range_bin", "doppler_bin")
    return det.join(bins, [*keys, "range_bin", "doppler_bin"], "left_semi")


def group_doppler(det: DataFrame, rd: DataFrame, keys: Sequence[str], n_doppler: int) -> DataFrame:
    """Keep detections strictly greater than both Doppler neighbours of the map."""
    around = _circular_neighbours(rd, keys, n_doppler, [-1, 1])
    bins = around.select(*keys, "range_bin", "doppler_bin", F.greatest("_n-1", "_n1").alias("_side"))
    return (
        det.join(bins, [*keys, "range_bin", "doppler_bin"])
        .filter(F.col("peak_val") > F.col("_side"))
        .drop("_side")
    )


def _offsets(doppler: bool, rng: bool) -> list[tuple[int, int]]:
    """(range step, Doppler step) of the compared neighbours."""
    rs = (-1, 0, 1) if rng else (0,)
    ds = (-1, 0, 1) if doppler else (0,)
    return [(r, d) for r in rs for d in ds if (r, d) != (0, 0)]


def _neighbour_max(
    det: DataFrame, values: DataFrame, keys: Sequence[str], n_doppler: int, steps: list[tuple[int, int]]
) -> DataFrame:
    """Largest neighbour value of each detection; absent neighbours count as 0.

    Every value is sent to the cells it is a neighbour of and reduced by ``max``
    before it meets the detections, so nothing is paired inside a group.
    """
    sent = values.select(
        *keys, "value",
        F.explode(F.array(*[F.struct(
            (F.col("range_bin") - r).alias("range_bin"),
            F.pmod(F.col("doppler_bin") - d, F.lit(n_doppler)).alias("doppler_bin"),
        ) for r, d in steps])).alias("c"),
    )
    best = sent.groupBy(*keys, F.col("c.range_bin").alias("range_bin"), F.col("c.doppler_bin").alias("doppler_bin")).agg(
        F.max("value").alias("_around")
    )
    return join_keys(det, best, [*keys, "range_bin", "doppler_bin"], "left").withColumn(
        "_around", F.coalesce("_around", F.lit(0))
    )


def group_peaks_map(
    det: DataFrame,
    rd: DataFrame,
    keys: Sequence[str],
    n_doppler: int,
    min_range: int,
    max_range: int,
    doppler: bool = True,
    rng: bool = True,
    cap: int | None = None,
) -> DataFrame:
    """3x3 peak grouping against the map; rows beyond the range limits read as 0."""
    gated = det.filter(F.col("range_bin").between(min_range, max_range))
    if not (doppler or rng):
        return signed(_capped(gated.filter(F.col("range_bin") > min_range), keys, cap), n_doppler)
    # At the lower limit the row below reads as 0, at the upper limit the row above does.
    visible = rd.filter(F.col("range_bin").between(min_range, max_range))
    around = _neighbour_max(gated, visible, keys, n_doppler, _offsets(doppler, rng))
    kept = around.filter(F.col("_around") <= F.col("peak_val")).drop("_around")
    return signed(_capped(kept, keys, cap), n_doppler)


def group_peaks_list(
    det: DataFrame,
    keys: Sequence[str],
    n_doppler: int,
    min_range: int,
    max_range: int,
    doppler: bool = True,
    rng: bool = True,
    cap: int | None = None,
) -> DataFrame:
    """3x3 peak grouping among the detections; an undetected neighbour counts as 0."""
    gated = det.filter(F.col("range_bin").between(min_range, max_range))
    if not (doppler or rng):
        return _capped(gated.filter(F.col("range_bin") > min_range), keys, cap)
    values = det.select(*keys, "range_bin", "doppler_bin", F.col("peak_val").alias("value"))
    around = _neighbour_max(gated, values, keys, n_doppler, _offsets(doppler, rng))
    kept = around.filter(F.col("_around") <= F.col("peak_val")).drop("_around")
    return _capped(kept, keys, cap)


def signed(df: DataFrame, n_doppler: int) -> DataFrame:
    """Add ``doppler_signed``: the Doppler bin about zero."""
    d = F.col("doppler_bin")
    return df.withColumn("doppler_signed", F.when(d < n_doppler // 2, d).otherwise(d - n_doppler))
