"""Critical-density estimators on binned curves.

A curve has one row per density bin, so windows partitioned by curve id stay
small whatever the number of points behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def split_scan(curve: DataFrame, by: Sequence[str] = (), *, weight: str | Column | None = None, max_split: int | None = None) -> DataFrame:
    """Every admissible two-segment split with its residual sum of squares.

    Prefix sums of (w, wx, wy, wxx, wxy, wyy) on centred values give the RSS
    of both least-squares lines in closed form for all splits in one pass.
    ``max_split`` ends the scan before that bin; by default it covers the curve.
    """
    by = list(by)
    ordered = Window.partitionBy(*by).orderBy("density_center")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    base = curve.withColumns({
        "split": F.row_number().over(ordered) - 1,
        "n_bins": F.count(F.lit(1)).over(whole),
        "_w": w,
        "_x": F.col("density_center") - F.avg("density_center").over(whole),
        "_y": F.col("speed_mean") - F.avg("speed_mean").over(whole),
        "speed_before": F.lag("speed_mean").over(ordered),
    })
    terms = {"w": F.col("_w"), "x": F.col("_w") * F.col("_x"), "y": F.col("_w") * F.col("_y"),
             "xx": F.col("_w") * F.col("_x") * F.col("_x"), "xy": F.col("_w") * F.col("_x") * F.col("_y"),
             "yy": F.col("_w") * F.col("_y") * F.col("_y")}
    base = base.withColumns({f"_l{k}": F.sum(v).over(before) for k, v in terms.items()} |
                            {f"_t{k}": F.sum(v).over(whole) for k, v in terms.items()})

    def rss(get) -> Column:
        sxx = get("xx") - get("x") * get("x") / get("w")
        sxy = get("xy") - get("x") * get("y") / get("w")
        syy = get("yy") - get("y") * get("y") / get("w")
        return F.greatest(F.lit(0.0), syy - sxy * sxy / sxx)

    def slope(get) -> Column:
        return ((get("xy") - get("x") * get("y") / get("w")) / (get("xx") - get("x") * get("x") / get("w")))

    left = lambda k: F.col(f"_l{k}")
    right = lambda k: F.col(f"_t{k}") - F.col(f"_l{k}")
    upper = (F.col("n_bins") - 5 if max_split is None else F.least(F.col("n_bins") - 5, F.lit(max_split))) - 1
    valid = (F.col("split") >= 3) & (F.col("split") <= upper) & (F.col("n_bins") - F.col("split") >= 3)
    return base.withColumns({
        "valid": valid,
        "rss": F.when(valid, rss(left) + rss(right)),
        "slope_left": F.when(valid, slope(left)),
        "slope_right": F.when(valid, slope(right)),
    }).drop(*[f"_{s}{k}" for s in "lt" for k in terms], "_w", "_x", "_y")


def piecewise(curve: DataFrame, by: Sequence[str] = (), *, weight: str | Column | None = None,
              fallback: bool = True, max_split: int | None = None) -> DataFrame:
    """Best split per curve: rho_star is the centre of the first bin of the right segment.

    Without an admissible split the middle bin is used (``fallback``) or no
    row is returned. speed_free / speed_congested are unweighted bin means.
    """
    by = list(by)
    scan = split_scan(curve, by, weight=weight, max_split=max_split)
    choice = F.when(F.col("valid"), F.struct(F.lit(0).alias("rank"), F.col("rss").alias("objective"), "split"))
    if fallback:
        middle = F.col("split") == F.floor(F.col("n_bins") / 2)
        choice = choice.when(middle, F.struct(F.lit(1).alias("rank"), F.lit(0.0).alias("objective"), F.col("split")))
    best = F.min(choice).over(Window.partitionBy(*by))
    scan = scan.withColumn("_best", best).where(F.col("_best").isNotNull())
    at_split = F.col("split") == F.col("_best.split")
    free, congested = F.col("split") < F.col("_best.split"), F.col("split") >= F.col("_best.split")
    found = F.col("_best.rank") == 0
    pick = lambda c: F.max(F.when(at_split, F.col(c)))
    out = scan.groupBy(*by).agg(
        pick("density_center").alias("rho_star"),
        F.avg(F.when(free, F.col("speed_mean"))).alias("speed_free"),
        F.avg(F.when(congested, F.col("speed_mean"))).alias("speed_congested"),
        F.max(F.when(found, F.col("_best.objective"))).alias("objective"),
        F.max("n_bins").alias("n_bins"),
        pick("slope_left").alias("slope_left"), pick("slope_right").alias("slope_right"),
        pick("speed_before").alias("speed_before"), pick("speed_mean").alias("speed_after")).where(F.col("rho_star").isNotNull())
    drop = lambda hi, lo: F.when(F.col(hi) > 0, (F.col(hi) - F.col(lo)) / F.col(hi) * 100)
    return out.withColumns({"speed_drop_percent": drop("speed_free", "speed_congested"),
                            "jump_percent": drop("speed_before", "speed_after")})


def _gradient(value: str, x: str, ordered) -> Column:
    """Second-order interior difference on uneven spacing, one-sided at the ends."""
    y, prev, nxt = F.col(value), F.lag(value).over(ordered), F.lead(value).over(ordered)
    hd = F.col(x) - F.lag(x).over(ordered)
    hs = F.lead(x).over(ordered) - F.col(x)
    inner = (hd * hd * nxt + (hs * hs - hd * hd) * y - hs * hs * prev) / (hs * hd * (hd + hs))
    return F.when(prev.isNull(), (nxt - y) / hs).when(nxt.isNull(), (y - prev) / hd).otherwise(inner)


def inflection(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest second derivative within the first two thirds of the curve (all of it when that is under 5 bins)."""
    by = list(by)
    ordered, whole = Window.partitionBy(*by).orderBy("density_center"), Window.partitionBy(*by)
    d1 = curve.withColumn("_d1", _gradient("speed_mean", "density_center", ordered))
    d2 = d1.withColumns({
        "_d2": _gradient("_d1", "density_center", ordered),
        "_i": F.row_number().over(ordered) - 1,
        "_n": F.count(F.lit(1)).over(whole),
        "_prev": F.coalesce(F.lag("speed_mean").over(ordered), F.col("speed_mean")),
        "_next": F.coalesce(F.lead("speed_mean").over(ordered), F.col("speed_mean")),
    })
    limit = F.floor(F.col("_n") * 2 / 3)
    limit = F.when(limit < 5, F.col("_n")).otherwise(limit)
    inside = d2.where((F.col("_i") < limit) & (F.col("density_center") > 0) & F.col("_d2").isNotNull())
    best = inside.groupBy(*by).agg(F.max_by(
        F.struct("density_center", "_d2", "_prev", "_next"), F.struct("_d2", -F.col("_i"))).alias("b"))
    return best.select(*by, F.col("b.density_center").alias("rho_star"), F.col("b._d2").alias("curvature"),
                       F.col("b._prev").alias("speed_before"), F.col("b._next").alias("speed_after"),
                       F.when(F.col("b._prev") > 0, (F.col("b._prev") - F.col("b._next")) / F.col("b._prev") * 100)
                       .alias("jump_percent"))


def consensus(piecewise_row: DataFrame, inflection_row: DataFrame) -> DataFrame:
    """The piecewise estimate if there is one, else the median of what is available."""
    methods = (piecewise_row.select(F.lit("piecewise_regression").alias("method"), "rho_star", "jump_percent")
               .unionByName(inflection_row.select(F.lit("inflection_analysis").alias("method"), "rho_star", "jump_percent")))
    main = F.max(F.when(F.col("method") == "piecewise_regression", F.col("rho_star")))
    return methods.agg(F.coalesce(main, F.median("rho_star")).alias("consensus_rho_star"),
                       F.count(F.lit(1)).alias("n_estimates"), F.min("rho_star").alias("min_estimate"),
                       F.max("rho_star").alias("max_estimate"))


def regime_metrics(curve: DataFrame, rho: Column) -> DataFrame:
    """Bin counts, ranges, speeds and slopes on both sides of rho, and the drop across it."""
    x, y = F.col("density_center"), F.col("speed_mean")
    out = {}
    for name, test in (("free", x < rho), ("congested", x >= rho)):
        inside = lambda c, t=test: F.when(t, c)
        enough = F.count(inside(x)) >= 3
        out |= {f"{name}_bins": F.count(inside(x)), f"{name}_density_min": F.min(inside(x)),
                f"{name}_density_max": F.max(inside(x)), f"{name}_speed_mean": F.avg(inside(y)),
                f"{name}_speed_std": F.stddev_samp(inside(y)),
                f"{name}_slope": F.when(enough, F.regr_slope(inside(y), inside(x))).otherwise(F.lit(0.0))}
    near = (x >= rho - 1) & (x <= rho + 1)
    pre = F.max_by(F.when(near & (x < rho), y), F.when(near & (x < rho), x))
    post = F.min_by(F.when(near & (x >= rho), y), F.when(near & (x >= rho), x))
    drop = F.when(pre > 0, (pre - post) / pre * 100)
    out["drop_at_rho_percent"] = F.coalesce(drop, F.lit(0.0))
    return curve.agg(*[c.alias(n) for n, c in out.items()])


def window_drop(curve: DataFrame, by: Sequence[str] = (), *, order: str | Sequence[str], x: str = "density", y: str = "speed",
                width: int = 5) -> DataFrame:
    """Position with the largest (mean of ``width`` rows before) - (mean of ``width`` rows from here on).

    Drops equal to nine decimals tie and the first wins; curves shorter than
    2 * width return their middle row.
    """
    by = list(by)
    order = [order] if isinstance(order, str) else list(order)
    ordered, whole = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by)
    scan = curve.withColumns({
        "_i": F.row_number().over(ordered) - 1, "_n": F.count(F.lit(1)).over(whole),
        "_b": F.avg(y).over(ordered.rowsBetween(-width, -1)),
        "_a": F.avg(y).over(ordered.rowsBetween(0, width - 1))})
    usable = (F.col("_i") >= width) & (F.col("_i") < F.col("_n") - width)
    choice = F.when(usable, F.struct(F.lit(1).alias("r"), F.round(F.col("_b") - F.col("_a"), 9).alias("d"), (-F.col("_i")).alias("i"))) \
        .when(F.col("_i") == F.floor(F.col("_n") / 2), F.struct(
            F.lit(0).alias("r"), F.lit(0.0).alias("d"), (-F.col("_i")).alias("i")))
    return scan.groupBy(*by).agg(F.max_by(F.col(x), choice).alias("breakpoint"))
