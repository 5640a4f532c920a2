"""Daily activity profiles and day-to-day bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.time import day_slot, slot_label
from airgrid.operators.percentiles import bounded_percentiles, exact_percentiles


def slot_activity(points: DataFrame, minutes: int) -> DataFrame:
    """Points and distinct active orders per (date, slot)."""
    return points.groupBy(F.to_date("datetime").alias("date"), day_slot(F.col("datetime"), minutes).alias("slot_index")).agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("order_id").alias("active_flights"))


def slot_profile(points: DataFrame, minutes: int) -> DataFrame:
    """Per day slot: points and share, mean active orders over all days, median and peak over active days."""
    daily = slot_activity(points, minutes)
    days = daily.agg(F.count_distinct("date").alias("d")).scalar()
    total = daily.agg(F.sum("points").alias("t")).scalar()
    stats = daily.groupBy("slot_index").agg(
        F.sum("points").alias("total_points"), F.sum("active_flights").alias("_active"),
        *bounded_percentiles(F.col("active_flights"), {"median_active_flights_per_day": .5}),
        F.max("active_flights").alias("peak_active_flights_in_any_day"), F.count(F.lit(1)).alias("days_with_activity"))
    slots = points.sparkSession.range(24 * 60 // minutes).select(F.col("id").cast("int").alias("slot_index"))
    dense = slots.join(stats, "slot_index", "left").na.fill(0)
    return dense.select(
        "slot_index", slot_label(F.col("slot_index"), minutes).alias("slot_label"), "total_points",
        (F.col("total_points") / total).alias("share_of_points"),
        (F.col("_active") / days).alias("mean_active_flights_per_day"), "median_active_flights_per_day",
        "peak_active_flights_in_any_day", "days_with_activity")


def peak_slots(profile: DataFrame) -> DataFrame:
    """Slot with most points and slot with the highest mean activity (earliest on ties)."""
    first = -F.col("slot_index")
    return profile.agg(
        F.max_by("slot_label", F.struct("total_points", first)).alias("peak_slot_by_points"),
        F.max_by("slot_label", F.struct("mean_active_flights_per_day", first)).alias("peak_slot_by_mean_active_flights"))


def dense_slots(points: DataFrame, minutes: int) -> DataFrame:
    """Every date with every slot, zero where nothing flew, and the share within the date."""
    daily = slot_activity(points, minutes)
    per_day = daily.groupBy("date").agg(F.sum("points").alias("day_points"))
    frame = per_day.select("date", "day_points", F.explode(F.sequence(F.lit(0), F.lit(24 * 60 // minutes - 1))).alias("slot_index"))
    return frame.join(daily, ["date", "slot_index"], "left").na.fill(0, ["points", "active_flights"]).select(
        "date", "slot_index", slot_label(F.col("slot_index"), minutes).alias("slot_label"), "points", "active_flights",
        (F.col("points") / F.col("day_points")).alias("share_of_day"))


def activity_bands(points: DataFrame, minutes: int = 30) -> DataFrame:
    """Quartiles of active orders across days per slot."""
    return dense_slots(points, minutes).groupBy("slot_index", "slot_label").agg(
        *bounded_percentiles(F.col("active_flights"), {"q25": .25, "q75": .75}))


def altitude_histogram(points: DataFrame, width: int = 20, bins: int = 20) -> DataFrame:
    """Altitude counts and shares; everything above the last edge falls into the last bin."""
    index = F.least(F.lit(bins - 1), F.floor(F.col("altitude") / F.lit(float(width)))).cast("int")
    counts = points.groupBy(index.alias("bin_index")).agg(F.count(F.lit(1)).alias("n"))
    frame = points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin_index"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    dense = frame.join(counts, "bin_index", "left").na.fill(0, ["n"])
    return dense.withColumns({"bin_start_m": F.col("bin_index") * width, "bin_end_m": (F.col("bin_index") + 1) * width,
                              "share_of_points": F.col("n") / total})


def altitude_summary(points: DataFrame) -> DataFrame:
    """Moments, percentiles and five band shares of point altitude."""
    alt = F.col("altitude")
    edges = (0, 60, 120, 180, 240)
    bands = {"share_lt_60m": alt < 60}
    bands |= {f"share_{lo}_{hi}m": (alt >= lo) & (alt < hi) for lo, hi in zip(edges[1:], edges[2:])}
    bands["share_ge_240m"] = alt >= 240
    base = points.agg(F.count(F.lit(1)).alias("n"), F.avg(alt).alias("mean"), F.min(alt).alias("min"), F.max(alt).alias("max"),
                      *[F.avg(t.cast("int")).alias(n) for n, t in bands.items()])
    probs = {"median": .5, "p25": .25, "p75": .75, "p90": .9, "p95": .95, "p99": .99}
    row = exact_percentiles(points, "altitude", probs, width=0.5)
    return base.select("*", *[row.select(p).scalar().alias(p) for p in probs])


def edge_bin(value: Column, edges: Sequence[float], *, overflow_last: bool) -> Column:
    """Index of the left-closed bin; values outside go to the last bin or to null."""
    last = len(edges) - 2
    out = F.when(value < F.lit(float(edges[0])), F.lit(last if overflow_last else None).cast("int"))
    for i, hi in enumerate(edges[1:]):
        closed = (value <= F.lit(float(hi))) if (i == last and not overflow_last) else (value < F.lit(float(hi)))
        out = out.when(closed, F.lit(i))
    return out.otherwise(F.lit(last)) if overflow_last else out


def daily_share_bands(df: DataFrame, day: Column, index: Column, bins: int) -> DataFrame:
    """Mean and quartiles across days of each bin's within-day percentage."""
    counts = df.select(day.alias("day"), index.alias("bin")).where(F.col("bin").isNotNull()).groupBy("day", "bin").agg(
        F.count(F.lit(1)).alias("n"))
    days = counts.groupBy("day").agg(F.sum("n").alias("total"))
    dense = days.select("day", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    shares = dense.join(counts, ["day", "bin"], "left").na.fill(0, ["n"]).withColumn(
        "share", F.col("n") / F.col("total") * 100)
    return shares.groupBy("bin").agg(F.avg("share").alias("mean_share"),
                                     *bounded_percentiles(F.col("share"), {"q25_share": .25, "q75_share": .75}))
