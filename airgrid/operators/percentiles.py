"""Exact interpolated percentiles whose memory does not grow with the group.

The built-in exact ``percentile`` keeps a map of all distinct values of a
group in one task. That is fine for bounded integer measures. For continuous
measures this operator counts values on a fixed lattice first (partial
aggregation, tiny shuffle), then looks only at the few lattice bins that hold
the wanted order statistics. A bin with many values gets a second, finer lattice
of its own, and only the parts with the order statistics are sorted by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.session import materialize

CROWD, MOST_CELLS, SALTS = 4096, 1 << 16, 16
FEW = 1 << 15  # wanted bins that are broadcast


def exact_percentiles(df: DataFrame, value: str, probs: Mapping[str, float], *, width: float,
                      by: Sequence[str] = ()) -> DataFrame:
    """One row per group with one linearly interpolated percentile per name in ``probs``.

    ``width`` is the lattice step in units of the value. It steers only how
    finely the search narrows, never the result.
    """
    by = list(by)
    data = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    data = data.withColumn("_b", F.floor(F.col("_v") / F.lit(float(width))).cast("bigint"))

    hist = data.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumns({
        "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
        "_total": F.sum("_n").over(Window.partitionBy(*by)),
    })
    position = {name: (F.col("_total") - 1) * F.lit(float(q)) for name, q in probs.items()}

    def hit(start: Column, count: Column) -> Column:
        """Whether one of the wanted ranks lies in a run of ``count`` rows from ``start`` on."""
        found = F.lit(False)
        for pos in position.values():
            for rank in (F.floor(pos), F.ceil(pos)):
                found = found | ((rank >= start) & (rank < start + count))
        return found

    inside = hit(F.col("_before"), F.col("_n"))
    # bins with the wanted order statistics; crowded ones are cut into cells of about CROWD rows
    cells = F.least(F.lit(MOST_CELLS), F.ceil(F.col("_n") / CROWD)).cast("bigint")
    wanted = materialize(hist.where(inside).select(*by, "_b", "_before", "_total", cells.alias("_cells")))
    cell = F.floor((F.col("_v") / F.lit(float(width)) - F.col("_b")) * F.col("_cells")).cast("bigint")
    # The join is chosen by the number of bins. Left to Spark, it can broadcast all rows of ``df``, as a stored table
    # with few distinct values is a thousandth of its rows in memory.
    if wanted.limit(FEW + 1).count() <= FEW:
        found = data.join(F.broadcast(wanted), by + ["_b"])
    else:
        # the salt spreads the rows of one bin over tasks
        wanted = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = data.withColumn("_salt", F.pmod(F.hash("_v"), F.lit(SALTS))).hint("merge").join(wanted, by + ["_b", "_salt"])
    values = found.groupBy(
        *by, "_b", cell.alias("_c"), "_v").agg(F.count(F.lit(1)).alias("_n"), F.max("_before").alias("_before"), F.max("_total").alias("_total"))
    fine = values.groupBy(*by, "_b", "_c").agg(F.sum("_n").alias("_m"), F.max("_before").alias("_before"), F.max("_total").alias("_total"))
    ahead = Window.partitionBy(*by, "_b").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_m").over(ahead), F.lit(0)))
    fine = fine.where(hit(F.col("_before"), F.col("_m"))).select(*by, "_b", "_c", F.col("_before").alias("_from"))
    values = values.join(fine, by + ["_b", "_c"])
    run = Window.partitionBy(*by, "_b", "_c").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_start", F.col("_from") + F.coalesce(F.sum("_n").over(run), F.lit(0)))
    values = values.withColumn("_end", F.col("_start") + F.col("_n"))

    def at(rank):
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    picks = []
    for name, pos in position.items():
        picks += [at(F.floor(pos)).alias(f"_l_{name}"), at(F.ceil(pos)).alias(f"_h_{name}")]
    out = values.groupBy(*by).agg(F.max("_total").alias("_total"), *picks)
    fraction = {name: position[name] - F.floor(position[name]) for name in probs}
    return out.select(*by, *[
        (F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * fraction[n]).alias(n) for n in probs])


def bounded_percentiles(value, probs: Mapping[str, float]) -> list:
    """Built-in exact percentiles, for measures with few distinct values (counts, days, draws)."""
    return [F.percentile(value, F.lit(float(q))).alias(name) for name, q in probs.items()]
