"""Ordered computations that survive a hot group.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key into one task. Here a table is cut once: one range shuffle
by group and order, and every run of a group's rows in a partition is a cell. The cut rows are stored in the shared
folder, so rows and the small summary of each cell come from the same pass, and a plan built on them reads them twice
however many values it carries: once for the summaries, once for the rows. Cells are stitched by plain windows over the
summaries (offsets, running totals, carried values, border rows), of which a group has one for each ``limit`` rows.
Bounded windows that reach over many rows take copies of the rows beyond the border instead (``reach``).

The cut runs when it is asked for, not when the result is read. ``limit=None`` says that a group is bounded by
construction (the axis of a map): nothing is cut or stored, and the plain window is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangelake.session import cut_lineage

ROWS_PER_TASK = 2_000_000


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys where NULL matches NULL; keys kept from the left."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns]
    )
    cond = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = part if cond is None else cond & part
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def oversized(df: DataFrame, part: Sequence[str], limit: int) -> DataFrame:
    """Groups with more than ``limit`` rows; at most rows/limit of them exist."""
    return (
        df.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > limit)
    )


class Cells:
    """A table cut once along its order into cells of ``limit`` rows at most.

    ``rows`` has the table's columns, ``_seq`` (ascending in the order) and ``_cell`` (the group and where the cell begins).
    ``window`` is a cell in order; ``cells`` are the summaries of a group in order, ``before`` and ``after`` those before and after one.
    """

    def __init__(self, df: DataFrame, part: Sequence[str], order: Sequence[str | Column], limit: int | None = ROWS_PER_TASK):
        keys = [*part, *order]
        if limit is None:
            place = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
            rows, begin = df.withColumn("_seq", place.cast("long")), F.lit(0).cast("long")
        else:
            rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_seq", F.monotonically_increasing_id())
            inside = F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its partition
            begin = F.col("_seq") - F.pmod(inside, F.lit(limit))
        rows = rows.withColumn("_cell", F.struct(*(F.col(p).alias(f"p{i}") for i, p in enumerate(part)), begin.alias("begin")))
        self.rows = rows if limit is None else cut_lineage(rows)
        self.window = Window.partitionBy("_cell").orderBy("_seq")
        self.cells = Window.partitionBy(*(f"_cell.p{i}" for i in range(len(part)))).orderBy("_cell.begin")
        self.before = self.cells.rowsBetween(Window.unboundedPreceding, -1)
        self.after = self.cells.rowsBetween(1, Window.unboundedFollowing)
        self.so_far = self.window.rowsBetween(Window.unboundedPreceding, 0)
        self.from_here = self.window.rowsBetween(0, Window.unboundedFollowing)

    def summary(self, rows: DataFrame, **values: Column) -> DataFrame:
        """One row a cell."""
        return rows.groupBy("_cell").agg(*(c.alias(k) for k, c in values.items()))

    def neighbour(self, columns: dict[str, str | Column], steps: int = 1) -> DataFrame:
        """Rows with values of the row before (``steps`` 1) or after (-1) in the group; NULL at its ends."""
        row = F.struct(*((F.col(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()))
        edge = F.max_by("_row", "_seq") if steps > 0 else F.min_by("_row", "_seq")
        rows = self.rows.withColumn("_row", row)
        borders = self.summary(rows, _edge=edge).select("_cell", F.lag("_edge", steps).over(self.cells).alias("_border"))
        out = rows.withColumn("_near", F.lag("_row", steps).over(self.window)).join(borders, "_cell")
        near = F.coalesce("_near", "_border")
        return out.withColumns({k: near[k] for k in columns}).drop("_row", "_near", "_border")

    def carry(self, ahead: dict[str, Column], back: dict[str, Column] | None = None) -> DataFrame:
        """Rows with the latest non-NULL values at or before them (``ahead``), and the earliest at or after them (``back``)."""
        back = back or {}
        rows = self.rows.withColumns({f"_v_{k}": c for k, c in {**ahead, **back}.items()})
        at = lambda k: F.when(F.col(f"_v_{k}").isNotNull(), F.col("_seq"))
        edges = {f"_e_{k}": F.max_by(f"_v_{k}", at(k)) for k in ahead} | {f"_e_{k}": F.min_by(f"_v_{k}", at(k)) for k in back}
        edge = self.summary(rows, **edges).select(
            "_cell", *(F.last(f"_e_{k}", ignorenulls=True).over(self.before).alias(f"_b_{k}") for k in ahead),
            *(F.first(f"_e_{k}", ignorenulls=True).over(self.after).alias(f"_b_{k}") for k in back),
        )
        rows = rows.withColumns({f"_i_{k}": F.last(f"_v_{k}", ignorenulls=True).over(self.so_far) for k in ahead})
        rows = rows.withColumns({f"_i_{k}": F.first(f"_v_{k}", ignorenulls=True).over(self.from_here) for k in back})
        out = rows.join(edge, "_cell").withColumns({k: F.coalesce(f"_i_{k}", f"_b_{k}") for k in (*ahead, *back)})
        return out.drop(*(f"_{x}_{k}" for x in "vib" for k in (*ahead, *back)))

    @staticmethod
    def finish(rows: DataFrame) -> DataFrame:
        return rows.drop("_cell", "_seq")


def with_cells(df: DataFrame, part: Sequence[str], order: Sequence[str | Column], limit: int) -> DataFrame:
    """Add ``_cell``: the group and the slice of it that a row is in; ``_cell.begin`` ascends in the order."""
    return Cells(df, part, order, limit).rows.drop("_seq")


def with_position(
    df: DataFrame, part: Sequence[str], order: Sequence[str], limit: int | None = ROWS_PER_TASK
) -> DataFrame:
    """Add ``_pos`` (0-based rank in the group) and ``_n`` (group size)."""
    part, order = list(part), list(order)
    if limit is None:
        whole = Window.partitionBy(*part)
        return df.withColumn("_pos", (F.row_number().over(whole.orderBy(*order)) - 1).cast("long")).withColumn(
            "_n", F.count(F.lit(1)).over(whole)
        )
    cut = Cells(df, part, order, limit)
    sizes = cut.summary(cut.rows, _size=F.count(F.lit(1)), _first=F.min("_seq"))
    group = cut.cells.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        "_cell", (F.coalesce(F.sum("_size").over(cut.before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_size").over(group).alias("_n")
    )
    # a cell's rows are numbered without gaps, so no window over rows is needed
    return cut.finish(cut.rows.join(offsets, "_cell").withColumn("_pos", F.col("_seq") + F.col("_shift")).drop("_shift"))


class Reach:
    """Rows prepared for windows that look at most ``reach`` rows to each side.

    ``rows`` holds the original rows plus border copies; ``window`` is the
    partitioned and ordered window spec; ``own`` is true on original rows.
    """

    def __init__(self, rows: DataFrame, keys: list[str], helper: list[str]):
        self.rows = rows
        self.window = Window.partitionBy(*keys).orderBy("_at")
        self.own = F.col("_own")
        self._helper = helper

    def finish(self, columns: dict[str, Column]) -> DataFrame:
        """Evaluate window expressions and keep the original rows only."""
        return self.rows.withColumns(columns).filter("_own").drop(*self._helper)


def reach(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    span: int,
    circular: bool,
    limit: int | None = ROWS_PER_TASK,
) -> Reach:
    """Prepare bounded windows; ``circular`` joins the end of a group to its start."""
    part, order = list(part), list(order)
    placed = with_position(df, part, order, limit)
    pos, n = F.col("_pos"), F.col("_n")
    if circular:
        turns = F.sequence(
            F.ceil((F.lit(-span) - pos) / n).cast("long"),
            F.floor((n + span - 1 - pos) / n).cast("long"),
        )
        placed = placed.withColumn("_turn", F.explode(turns))
    else:
        placed = placed.withColumn("_turn", F.lit(0).cast("long"))
    placed = placed.withColumn("_at", pos + F.col("_turn") * n)
    keys, helper = part, ["_turn", "_at", "_own"]
    if limit is not None:
        size = max(limit, span + 1)
        last = F.floor((n - 1) / F.lit(size))
        first_b = F.greatest(F.lit(0), F.floor((F.col("_at") - span) / F.lit(size)))
        last_b = F.least(last, F.floor((F.col("_at") + span) / F.lit(size)))
        placed = placed.withColumn(
            "_slice", F.explode(F.sequence(first_b.cast("long"), last_b.cast("long")))
        )
        own = (F.col("_turn") == 0) & (F.floor(pos / F.lit(size)) == F.col("_slice"))
        keys, helper = [*part, "_slice"], ["_slice", *helper]
    else:
        own = F.col("_turn") == 0
    return Reach(placed.withColumn("_own", own), keys, helper)


def running_sums(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    columns: dict[str, Column],
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Add running totals (first row to current row, inclusive) of the given expressions."""
    part, order = list(part), list(order)
    named = df.withColumns({f"_v_{k}": c for k, c in columns.items()})
    if limit is None:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = named.withColumns({k: F.sum(f"_v_{k}").over(w) for k in columns})
        return out.drop(*[f"_v_{k}" for k in columns])
    cut = Cells(named, part, order, limit)
    totals = cut.summary(cut.rows, **{f"_t_{k}": F.sum(f"_v_{k}") for k in columns})
    carried = totals.select("_cell", *[F.sum(f"_t_{k}").over(cut.before).alias(f"_b_{k}") for k in columns])
    out = cut.rows.withColumns({f"_i_{k}": F.sum(f"_v_{k}").over(cut.so_far) for k in columns}).join(carried, "_cell")
    for k in columns:
        inside, base = F.col(f"_i_{k}"), F.col(f"_b_{k}")
        out = out.withColumn(k, F.when(base.isNull(), inside).when(inside.isNull(), base).otherwise(base + inside))
    return cut.finish(out.drop(*[f"{p}{k}" for k in columns for p in ("_v_", "_b_", "_i_")]))


def carry_last(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[Column | str],
    columns: dict[str, Column],
    forward: bool = True,
    limit: int | None = ROWS_PER_TASK,
) -> DataFrame:
    """Add the latest non-NULL value at or before each row (or at or after it), in ascending order."""
    cut = Cells(df, part, order, limit)
    return cut.finish(cut.carry(columns) if forward else cut.carry({}, columns))
