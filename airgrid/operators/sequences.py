"""Order-of-visit operators over trajectories, sliced by time.

``lag`` over a whole order would put all points of that order into one task.
Windows here run per (order, time slice); the last point of each slice is
carried to the next slice through a second window over slices only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_S = 600  # longer than most trips, short enough to split an order that never ends
TIME_ORDER = ("datetime", "longitude", "latitude", "speed", "altitude")


def with_previous(points: DataFrame, carried: Sequence[str], *, key: str = "order_id",
                  order: Sequence[str] = TIME_ORDER, slice_s: int = SLICE_S) -> DataFrame:
    """Add ``previous``: a struct of ``carried`` columns from the preceding point of the order.

    The last point of each slice comes from the same windows, so that where all columns are needed in both places the points
    are shuffled once.
    """
    order = [c for c in order if c in points.columns]
    sliced = points.withColumn("_slice", F.floor(F.unix_timestamp("datetime") / F.lit(slice_s)))
    # stated here, as the join below implies it: both branches have to read the same rows to share their shuffle
    sliced = sliced.where(F.col(key).isNotNull() & F.col("_slice").isNotNull())
    keys = [key, "_slice"]
    inside = Window.partitionBy(*keys).orderBy(*order)
    last = sliced.withColumn("_ahead", F.lead(F.lit(1)).over(inside)).where(F.col("_ahead").isNull()).select(*keys, F.struct(*carried).alias("_last"))
    carry = last.select(*keys, F.lag("_last").over(Window.partitionBy(key).orderBy("_slice")).alias("_carry"))
    # lagged one by one: a struct would be built before the shuffle and travel with the points
    behind = {f"_p_{c}": F.lag(c).over(inside) for c in carried}
    stepped = sliced.withColumns({"_behind": F.lag(F.lit(1)).over(inside), **behind}).join(carry, keys)
    near = F.when(F.col("_behind").isNotNull(), F.struct(*[F.col(f"_p_{c}").alias(c) for c in carried]))
    return stepped.withColumn("previous", F.coalesce(near, "_carry")).drop("_behind", *behind, "_carry", "_slice")


def compress_visits(points: DataFrame, **options) -> DataFrame:
    """Cell visits: points whose cell differs from the preceding point (first point included)."""
    stepped = with_previous(points, ["row", "col"], **options)
    changed = (F.col("previous").isNull() | (F.col("previous.row") != F.col("row"))
               | (F.col("previous.col") != F.col("col")))
    return stepped.where(changed)


def with_visit_index(visits: DataFrame, *, key: str = "order_id", order: Sequence[str] = TIME_ORDER,
                     slice_s: int = SLICE_S) -> DataFrame:
    """1-based position of a visit within its order, offset per slice plus row number inside it."""
    order = [c for c in order if c in visits.columns]
    sliced = visits.withColumn("_slice", F.floor(F.unix_timestamp("datetime") / F.lit(slice_s)))
    keys = [key, "_slice"]
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (sliced.withColumn("_inside", inside).join(sizes, keys)
            .withColumn("seq_index", (F.col("_offset") + F.col("_inside")).cast("bigint"))
            .drop("_inside", "_offset", "_slice"))


def transitions(visits: DataFrame) -> DataFrame:
    """Directed and undirected cell-to-cell moves of each order."""
    here, there = F.struct(F.col("previous.row"), F.col("previous.col")), F.struct("row", "col")
    return visits.where(F.col("previous").isNotNull()).select(
        "order_id", here.alias("src"), there.alias("dst"),
        F.least(here, there).alias("node_a"), F.greatest(here, there).alias("node_b"))


def order_lengths(visits: DataFrame) -> DataFrame:
    """Visits and distinct cells per order, for orders that changed cell at least once."""
    per_cell = visits.groupBy("order_id", "row", "col").agg(F.count(F.lit(1)).alias("n"))
    return per_cell.groupBy("order_id").agg(
        F.sum("n").alias("visits"), F.count(F.lit(1)).alias("unique_cells")).where(F.col("visits") >= 2)


def route_signatures(visits: DataFrame) -> DataFrame:
    """Orders per distinct visit sequence.

    A sequence is identified by its length and two independent 64-bit xor
    hashes of (position, cell), which aggregate map-side, so no order is ever
    collected into one array.
    """
    cell = [F.col("seq_index"), F.col("row"), F.col("col")]
    per_order = with_visit_index(visits).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("length"),
        F.bit_xor(F.xxhash64(F.lit(1), *cell)).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(2), *cell)).alias("h2"))
    return (per_order.where(F.col("length") >= 2)
            .groupBy("length", "h1", "h2").agg(F.count(F.lit(1)).alias("orders")))
