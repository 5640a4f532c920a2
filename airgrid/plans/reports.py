"""Flattening of study results into four wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.session import materialize

CONTINGENCY = ("rho_star", "samples", "a", "b", "c", "d", "risk_exposed", "risk_unexposed", "rr", "rr_lo", "rr_hi", "odds_ratio", "or_lo", "or_hi")


def stack(parts: Sequence[tuple[dict[str, str], DataFrame]], columns: Sequence[str] | None = None) -> DataFrame:
    """Union of differently shaped results with literal labels; absent columns become null.

    Results are a few rows each and are written before the union, so the
    combined plan holds their rows and not their whole derivations.
    """
    out = None
    for labels, frame in parts:
        kept = frame.select(*[c for c in columns if c in frame.columns]) if columns else frame
        part = materialize(kept).select(*[F.lit(v).alias(k) for k, v in labels.items()], "*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def contingency_table(parts: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """(analysis id, group, result with a..d and risk columns) -> one row per analysis."""
    table = stack([({"analysis_id": i, "analysis_group": g}, f) for i, g, f in parts], CONTINGENCY)
    total = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    return table.withColumn("samples", F.coalesce(F.col("samples"), total) if "samples" in table.columns else total)


def robustness_table(parts: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    return stack([({"check_id": i, "category": c}, f) for i, c, f in parts])


def breakpoint_table(specifications: DataFrame) -> DataFrame:
    weighting = F.when(F.col("spec").contains("count_weighted"), "count_weighted").otherwise("equal_weight_bins")
    return specifications.select(F.col("spec").alias("specification_id"), "rho_star", "speed_drop_percent", "n_bins", weighting.alias("weighting"))


def resampling_table(parts: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    return stack([({"summary_id": i, "category": c}, f) for i, c, f in parts])
