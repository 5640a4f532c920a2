"""Exact global ranks, cumulative sums and top fractions without a one-task sort.

A plain ``row_number() over (order by ...)`` moves the whole table into one
task. Here the leading sort columns become histogram levels: offsets come from
windows over the (small) histograms, and only rows that agree on all leading
columns are numbered together. For cells ordered by (count desc, row, col) the
largest single window is the list of distinct counts, which cannot exceed
sqrt(2 * points); the others are bounded by the number of grid rows or columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[tuple[str, bool]]  # (column, ascending)


def _sorted(order: Order) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in order]


def global_rank(df: DataFrame, order: Order, *, levels: int, by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """Add a 1-based rank over the whole table (per ``by`` group).

    The first ``levels`` columns of ``order`` must be non-null.
    """
    by, names = list(by), [c for c, _ in order]
    prefix = by + names[:levels]
    fine = df.groupBy(*prefix).agg(F.count(F.lit(1)).alias("_n"))
    offsets = fine
    for depth in range(levels):
        keys = by + names[: depth + 1]
        level = fine if depth == levels - 1 else fine.groupBy(*keys).agg(F.sum("_n").alias("_n"))
        before = (Window.partitionBy(*keys[:-1]).orderBy(*_sorted(order[depth:depth + 1]))
                  .rowsBetween(Window.unboundedPreceding, -1))
        level = level.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"_o{depth}"))
        offsets = offsets.join(level, keys)
    offset = sum((F.col(f"_o{d}") for d in range(levels)), F.lit(0))
    offsets = offsets.select(*prefix, offset.alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*prefix).orderBy(*_sorted(order[levels:])))
    ranked = df.withColumn("_inside", inside).join(offsets, prefix)
    return ranked.withColumn(rank, (F.col("_offset") + F.col("_inside")).cast("bigint")).drop("_offset", "_inside")


def running_total(df: DataFrame, weight: str, order: Sequence[str] = ("row", "col"), *, by: Sequence[str] = (),
                  name: str = "before") -> DataFrame:
    """Sum of ``weight`` over all rows sorted before this one; windows never exceed one grid row or one list of rows."""
    by, (outer, inner) = list(by), order
    prev = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by, outer).agg(F.sum(weight).alias("_w"))
    sums = sums.select(*by, outer, F.coalesce(F.sum("_w").over(prev(Window.partitionBy(*by).orderBy(outer))), F.lit(0)).alias("_o"))
    inside = F.coalesce(F.sum(weight).over(prev(Window.partitionBy(*by, outer).orderBy(inner))), F.lit(0))
    return df.withColumn("_i", inside).join(sums, by + [outer]).withColumn(name, F.col("_o") + F.col("_i")).drop("_o", "_i")


def cumulative_by_value(df: DataFrame, measure: str, *, by: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """One row per distinct value: how many rows, and what total, come before it."""
    by = list(by)
    hist = df.groupBy(*by, measure).agg(F.count(F.lit(1)).alias("ties"))
    order = F.col(measure).desc() if descending else F.col(measure).asc()
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    return hist.withColumns({
        "rows_before": F.coalesce(F.sum("ties").over(before), F.lit(0)),
        "sum_before": F.coalesce(F.sum(F.col("ties") * F.col(measure)).over(before), F.lit(0)),
        "rows_total": F.sum("ties").over(whole),
        "sum_total": F.sum(F.col("ties") * F.col(measure)).over(whole),
    })


def rank_with_shares(df: DataFrame, measure: str, ties: Sequence[str] = ("row", "col"), *, by: Sequence[str] = (),
                     descending: bool = True) -> DataFrame:
    """Rank by an integer measure with its share and cumulative share of the total.

    Rows tied on the measure add equal amounts, so the running total follows
    from the rank and the value histogram; no second sort is needed.
    """
    by = list(by)
    ranked = global_rank(df, [(measure, not descending)] + [(t, True) for t in ties],
                         levels=min(2, len(ties)), by=by)
    hist = cumulative_by_value(df, measure, by=by, descending=descending)
    out = ranked.join(hist, by + [measure])
    running = F.col("sum_before") + F.col(measure) * (F.col("rank") - F.col("rows_before"))
    return out.withColumns({
        "share": F.try_divide(F.col(measure), F.col("sum_total")),
        "cumulative_share": F.try_divide(running, F.col("sum_total")),
    }).drop("ties", "rows_before", "sum_before", "sum_total")


def top_k_size(rows: Column, fraction: float | Column) -> Column:
    """max(1, int(rows * fraction))."""
    share = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return F.greatest(F.lit(1), F.floor(rows * share)).cast("bigint")


def top_fraction(df: DataFrame, measure: str, fraction: float, ties: Sequence[str] = ("row", "col"), *,
                 by: Sequence[str] = ()) -> DataFrame:
    """The ``max(1, int(n * fraction))`` rows with the largest measure, ties cut by ``ties``.

    Only the rows tied exactly at the cut are ranked; everything above the
    cut value is accepted from the histogram.
    """
    by = list(by)
    hist = cumulative_by_value(df, measure, by=by).withColumn("_k", top_k_size(F.col("rows_total"), fraction))
    cut = (hist.where((F.col("rows_before") < F.col("_k")))
           .select(*by, measure, (F.col("_k") - F.col("rows_before")).alias("_room"), "ties"))
    kept = df.join(cut, by + [measure])
    sure = kept.where(F.col("_room") >= F.col("ties"))
    edge = kept.where(F.col("_room") < F.col("ties"))
    edge = global_rank(edge, [(t, True) for t in ties], levels=1, by=by, rank="_r").where(F.col("_r") <= F.col("_room"))
    drop = ["_room", "ties"]
    return sure.drop(*drop).unionByName(edge.drop(*drop, "_r"))


def gini(df: DataFrame, measure: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Rank-weighted Gini from the value histogram (ascending ranks of a tied block sum in closed form)."""
    by = list(by)
    hist = cumulative_by_value(df, measure, by=by, descending=False)
    block = F.col(measure) * (F.col("ties") * F.col("rows_before") + F.col("ties") * (F.col("ties") + 1) / F.lit(2.0))
    agg = hist.groupBy(*by).agg(F.sum(block).alias("_w"), F.max("rows_total").alias("_n"), F.max("sum_total").alias("_s"))
    value = F.lit(2.0) * F.col("_w") / (F.col("_n") * F.col("_s")) - (F.col("_n") + 1) / F.col("_n")
    return agg.select(*by, F.when(F.col("_s") > 0, value).otherwise(F.lit(0.0)).alias("gini"))


def weighted_median(df: DataFrame, values: Sequence[str], weight: str, *, by: Sequence[str] = (), width: float = 0.01) -> DataFrame:
    """First value whose cumulative weight reaches half the total, for several columns at once.

    Weights are summed on a lattice of step ``width`` to find the bin of the
    median; only that bin is ordered by value. ``width`` never changes the result.
    """
    by = list(by)
    long = df.select(*by, F.col(weight).alias("_w"), F.explode(F.array(*[
        F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])).alias("_m"))
    long = long.select(*by, "_w", "_m.metric", "_m.value").where(F.col("value").isNotNull() & (F.col("_w") > 0))
    keys = by + ["metric"]
    agg = long.groupBy(*keys, F.floor(F.col("value") / F.lit(width)).cast("bigint").alias("_b"), "value").agg(F.sum("_w").alias("_w"))
    prev = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bins = agg.groupBy(*keys, "_b").agg(F.sum("_w").alias("_s")).withColumns({
        "_before": F.coalesce(F.sum("_s").over(prev(Window.partitionBy(*keys).orderBy("_b"))), F.lit(0)),
        "_half": F.sum("_s").over(Window.partitionBy(*keys)) * 0.5})
    target = bins.where((F.col("_before") < F.col("_half")) & (F.col("_before") + F.col("_s") >= F.col("_half"))).drop("_s")
    inside = agg.join(target, keys + ["_b"])
    running = F.col("_before") + F.sum("_w").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    hit = inside.withColumn("_c", running).where(F.col("_c") >= F.col("_half"))
    return hit.groupBy(*by).agg(*[F.min(F.when(F.col("metric") == v, F.col("value"))).alias(v) for v in values])
