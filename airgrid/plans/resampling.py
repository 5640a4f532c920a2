"""Bootstraps and null models with hash-defined draws.

Every study reduces the data to sufficient counts first (blocks, cells,
contribution patterns), so iterations multiply small tables only. The
time-shuffle null is the exception: permuting cell labels needs every window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.functions.draws import digest, draw_grid, draw_index, iterated
from airgrid.functions.risk import contingency, finite
from airgrid.functions.time import date_hour
from airgrid.operators import cells as cells_op
from airgrid.operators.breakpoints import window_drop
from airgrid.operators.buffers import buffer_cells
from airgrid.operators.curves import equal_width_curve
from airgrid.operators.percentiles import bounded_percentiles
from airgrid.operators.ranking import global_rank, running_total, top_fraction
from airgrid.plans.core import backbone_cells, rho_star
from airgrid.plans.robustness import staged_occupancy
from airgrid.plans.summary import coupling, with_risk
from airgrid.session import materialize
from airgrid.spec import BACKBONE_SHARE, GridSpec

SEED = 42
LINE_PIECES = 4096
FIRST_DRAWS = 1 << 16  # draws of an iteration in the first round
BLOCK = 50  # iterations carried per row in the cluster bootstrap


def bootstrap_summary(draws: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median and 95 % percentile interval of finite draws (one value per iteration, so bounded)."""
    picks = [F.count(F.lit(1)).alias("n_bootstraps")]
    for name in columns:
        v = finite(F.col(name))
        picks += [F.count(v).alias(f"{name}_finite"), F.avg(v).alias(f"{name}_mean")]
        picks += bounded_percentiles(v, {f"{name}_median": .5, f"{name}_lo": .025, f"{name}_hi": .975})
    return draws.agg(*picks)


def null_summary(draws: DataFrame, value: str, observed: Column, by: Sequence[str] = ()) -> DataFrame:
    """Distribution of null values against the observed one, with both one-sided empirical p values."""
    v = finite(F.col(value))
    tail = lambda test: (F.count_if(test) + 1) / (F.count(v) + 1)
    return draws.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_values"), F.count(v).alias("n_finite"), F.max(observed).alias("observed"), F.avg(v).alias("mean"),
        *bounded_percentiles(v, {"median": .5, "lo": .025, "hi": .975}), F.max(v).alias("max"),
        tail(v >= observed).alias("p_ge"), tail(v <= observed).alias("p_le"))


def null_summaries(draws: DataFrame, observed: dict[str, Column]) -> DataFrame:
    """``null_summary`` of several columns, one row per measure."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"), o.cast("double").alias("seen")) for m, o in observed.items()]))
    long = draws.select(values.alias("m")).select("m.*")
    return null_summary(long, "value", F.col("seen"), ["measure"])


def date_hour_bootstrap(windows: DataFrame, n: int = 1000, seed: int = SEED) -> DataFrame:
    """RR and odds ratio per iteration from resampled date-hour blocks."""
    tagged = windows.withColumn("block", date_hour(F.col("window_start")))
    occ = staged_occupancy(tagged, ["block"])
    full = cells_op.merge_occupancy(occ)
    flagged = cells_op.in_set(occ, backbone_cells(full), "exposed")
    blocks = flagged.groupBy("block").agg(*contingency(F.col("exposed"), F.col("n_points") >= rho_star(full), F.col("windows")))
    # one block per hour of the archive
    blocks = materialize(blocks)
    blocks = global_rank(blocks.withColumn("day", F.substring("block", 1, 10)), [("day", True), ("block", True)], levels=1)
    total = blocks.count()
    draws = draw_grid(windows.sparkSession, n, total)
    picked = draws.select("iter", (draw_index(F.lit(total), seed, F.col("iter"), F.col("j")) + 1).alias("rank")).groupBy("iter", "rank").agg(
        F.count(F.lit(1)).alias("m"))
    sums = picked.join(blocks, "rank").groupBy("iter").agg(*[F.sum(F.col(c) * F.col("m")).alias(c) for c in "abcd"])
    return with_risk(sums).withColumn("log_or", F.log("odds_ratio"))


def rho_bootstrap(windows: DataFrame, n: int = 1000, seed: int = 2, *, resort: bool = False) -> DataFrame:
    """Breakpoint of resampled 100-bin curves; ``resort=False`` keeps the resample in draw order."""
    curve = materialize(equal_width_curve(windows))
    total = curve.count()
    draws = draw_grid(windows.sparkSession, n, total)
    draws = draws.withColumn("position", draw_index(F.lit(total), seed, F.col("iter"), F.col("j")).cast("int"))
    sample = draws.join(curve.select("position", "density", "speed"), "position")
    return window_drop(sample, ["iter"], order=["density", "j"] if resort else "j")


def rho_bootstrap_summary(draws: DataFrame) -> DataFrame:
    v = F.col("breakpoint")
    return draws.agg(F.count(v).alias("n_bootstraps"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
                     *bounded_percentiles(v, {"median": .5, "lo": .025, "hi": .975}))


def _hash_rank(df: DataFrame, by: Sequence[str], key: Sequence[str], *seed) -> DataFrame:
    """Random permutation rank per group; the first digest byte splits a large group over 256 tasks."""
    hashed = df.withColumn("_h", digest(*seed, *[F.col(k) for k in key])).withColumn("_p", F.substring("_h", 1, 2))
    return global_rank(hashed, [("_p", True), ("_h", True), *[(k, True) for k in key]], levels=1, by=by).drop("_h", "_p")


def time_shuffle_null(windows: DataFrame, n: int = 50, seed: int = SEED) -> DataFrame:
    """Cell labels permuted within each date-hour; backbone re-derived, rho fixed."""
    occ = staged_occupancy(windows)
    rho = rho_star(occ)
    base = windows.select(date_hour(F.col("window_start")).alias("block"), "row", "col",
                          F.unix_timestamp("window_start").alias("w"), "n_points")
    values = global_rank(base, [("row", True), ("col", True), ("w", True)], levels=2, by=["block"]).select("block", "rank", "n_points")
    spread = iterated(base.select("block", "row", "col", "w"), n)
    labels = _hash_rank(spread, ["iter", "block"], ["row", "col", "w"], seed, F.col("iter"))
    mixed = labels.select("iter", "block", "rank", "row", "col").join(values, ["block", "rank"])
    shuffled = materialize(mixed.groupBy("iter", "row", "col", "n_points").agg(F.count(F.lit(1)).alias("windows")))
    backbone = top_fraction(cells_op.traffic(shuffled, ["iter"]), "total_points", BACKBONE_SHARE, by=["iter"])
    flagged = cells_op.in_set(shuffled, backbone, "exposed", ["iter", "row", "col"])
    return coupling(flagged, "exposed", rho, ["iter"])


def random_cells(cells: DataFrame, k: Column, n: int, seed: int) -> DataFrame:
    """``k`` cells per iteration, drawn without replacement: those with the smallest hashes.

    A histogram of the hashes' leading digits gives each iteration the prefix in which its k-th hash lies. Cells with a
    smaller prefix are in, and only those at that prefix are ranked.
    """
    hashed = _with_prefix(cells, n, seed)
    edge = _boundaries(hashed.groupBy("iter", "_p").agg(F.count(F.lit(1)).alias("_n")), k).select("iter", F.col("_p").alias("_edge"), "_room")
    placed = hashed.join(edge, "iter").where(F.col("_p") <= F.col("_edge"))
    sure = placed.where(F.col("_p") < F.col("_edge"))
    rank = F.row_number().over(Window.partitionBy("iter").orderBy("_h", "row", "col"))
    last = placed.where(F.col("_p") == F.col("_edge")).withColumn("_r", rank).where(F.col("_r") <= F.col("_room")).drop("_r")
    return sure.unionByName(last).drop("_h", "_p", "_edge", "_room")


def _with_prefix(cells: DataFrame, n: int, seed: int) -> DataFrame:
    """Every cell once per iteration with its hash; the prefix is so long that few cells of an iteration share one."""
    digits = max(1, math.ceil(math.log(max(cells.count(), 16) / 8, 16)))
    hashed = iterated(cells, n).withColumn("_h", digest(F.lit(seed), F.col("iter"), F.col("row"), F.col("col")))
    return hashed.withColumn("_p", F.substring("_h", 1, digits))


def _boundaries(hist: DataFrame, k: Column, by: str | None = None) -> DataFrame:
    """Rows of a histogram (iter, _p, _n[, _x]) in which the k-th hash of an iteration lies, with what comes before and the places left.

    ``by`` names a column whose values have a histogram and a k each.
    """
    groups = ["iter"] + ([by] if by else [])
    before = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    running = hist.withColumns({f"_before{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("_n", "_x") if c in hist.columns})
    size = F.least(k, F.sum("_n").over(Window.partitionBy(*groups)))
    running = running.withColumn("_room", size - F.col("_before_n"))
    return running.where((F.col("_room") > 0) & (F.col("_room") <= F.col("_n")))


def random_backbone_null(windows: DataFrame, n: int = 50, seed: int = SEED) -> DataFrame:
    """Coupling of random cell sets of backbone size."""
    occ = staged_occupancy(windows)
    cells = materialize(cells_op.exceedance(occ, rho_star(occ)))
    size = backbone_cells(occ).agg(F.count(F.lit(1))).scalar()
    x, s = F.col("exceedance_count"), F.col("total_samples")
    inside = random_cells(cells, size, n, seed).groupBy("iter").agg(F.sum(x).alias("a"), F.sum(s - x).alias("b"))
    whole = cells.agg(F.sum(x).alias("x"), F.sum(s - x).alias("y"))
    table = inside.withColumns({"c": whole.select("x").scalar() - F.col("a"), "d": whole.select("y").scalar() - F.col("b")})
    return with_risk(table)


def _drawn_cells(stretches: DataFrame, n: int, total: int, piece: int, seed: int) -> DataFrame:
    """(kind, iter, row, col) of every cell that one of ``total`` draws of an iteration hits.

    Once an iteration has hit every cell of its line, further draws add nothing. Draws come in rounds, each longer than the one before,
    and only lines with cells still to be hit go on, to the last draw if need be.
    """
    spark, keys = stretches.sparkSession, ["kind", "iter", "row", "col"]
    sizes = {r["kind"]: r["n"] for r in stretches.groupBy("kind").agg(F.count_distinct("row", "col").alias("n")).collect()}  # two rows
    pending, found, start, length = [(k, i) for k in ("start", "end") for i in range(n)], None, 0, FIRST_DRAWS
    while found is None or (pending and start < total):
        length = min(length, total - start)
        lines = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).cast("bigint").alias("iter")) for k, i in pending])
        draws = draw_grid(spark, len(pending), length).select(F.get(lines, F.col("iter").cast("int")).alias("line"), (F.col("j") + F.lit(start)).alias("j"))
        draws = draws.select("line.kind", "line.iter", draw_index(F.lit(total), seed, F.col("line.kind"), F.col("line.iter"), F.col("j")).alias("r"))
        hits = draws.withColumn("piece", F.expr(f"r div {piece}")).join(stretches, ["kind", "piece"])
        new = hits.where(F.col("r").between(F.col("before"), F.col("before") + F.col("m") - 1)).select(*keys).distinct()
        found = materialize(new if found is None else found.unionByName(new).distinct())
        done = {(r["kind"], r["iter"]): r["n"] for r in found.groupBy("kind", "iter").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 n rows
        pending = [p for p in pending if done.get(p, 0) < sizes.get(p[0], 0)]
        start, length = start + length, length * 4
    return found


def od_reassignment_null(ends: DataFrame, windows: DataFrame, grid: GridSpec, n: int = 50, seed: int = SEED) -> DataFrame:
    """Share of congested windows in endpoint cells when starts and ends are drawn with replacement.

    Only cell counts are needed: a drawn index lives on the number line formed
    by the running totals of the cells, and only the set of drawn cells matters.
    """
    occ = staged_occupancy(windows)
    cells = cells_op.exceedance(occ, rho_star(occ)).where(F.col("exceedance_count") > 0)
    counts = ends.groupBy("kind", "row", "col").agg(F.count(F.lit(1)).alias("m"))
    line = running_total(counts, "m", by=["kind"])
    total = counts.where(F.col("kind") == "start").agg(F.sum("m")).first()[0] or 0
    # cells as stretches of the number line, cut into equal pieces: draws look their piece up and are never shuffled
    piece = max(1, -(-total // LINE_PIECES))
    last = F.col("before") + F.col("m") - 1
    stretches = materialize(line.withColumn("piece", F.explode(F.sequence(F.expr(f"before div {piece}"), F.floor(last / piece)))))
    drawn = _drawn_cells(stretches, n, total, piece, seed).select("iter", "row", "col").distinct()
    near = buffer_cells(drawn, 1, grid=grid, edge="clamp", by=["iter"])
    marks = drawn.withColumns({"exact": F.lit(1), "near": F.lit(0)}).unionByName(near.withColumns({"exact": F.lit(0), "near": F.lit(1)}))
    marks = marks.groupBy("iter", "row", "col").agg(F.max("exact").alias("exact"), F.max("near").alias("near"))
    all_x = cells.agg(F.sum("exceedance_count")).scalar()
    x = F.col("exceedance_count")
    return marks.join(cells, ["row", "col"]).groupBy("iter").agg(
        (F.sum(x * F.col("exact")) / all_x).alias("exact_share"), (F.sum(x * F.col("near")) / all_x).alias("buffer_share"))


def endpoint_shares(ends: DataFrame, occ: DataFrame, grid: GridSpec) -> dict[str, Column]:
    """Observed share of congested windows in the endpoint cells, and in these and their neighbours."""
    cells = materialize(cells_op.exceedance(occ, rho_star(occ)))
    exact = materialize(ends.select("row", "col").distinct())
    whole = F.sum("exceedance_count")
    share = lambda held: cells.join(held.select("row", "col").distinct(), ["row", "col"]).agg(whole).scalar() / cells.agg(whole).scalar()
    return {"exact_share": share(exact), "buffer_share": share(buffer_cells(exact, 1, grid=grid, edge="clamp"))}


def cluster_bootstrap(parts: DataFrame, group: str, backbone: DataFrame, rho: Column, n: int, seed: int) -> DataFrame:
    """RR and odds ratio when whole groups (vendor-days, route-days) are resampled with multiplicity.

    Cell-windows with the same group composition behave alike in every
    iteration. They are counted once per composition (identified by two 64-bit
    xor hashes and a size), and the iterations run over compositions.
    """
    keys = ["row", "col", "window_start"]
    parts, pair = materialize(parts), [F.col(group), F.col("n_points")]
    shape = parts.groupBy(*keys).agg(F.bit_xor(F.xxhash64(F.lit(1), *pair)).alias("h1"), F.bit_xor(F.xxhash64(F.lit(2), *pair)).alias("h2"),
                                     F.count(F.lit(1)).alias("k"))
    pattern = ["h1", "h2", "k"]
    counts = cells_op.in_set(shape, backbone, "exposed").groupBy(*pattern, "exposed").agg(F.count(F.lit(1)).alias("windows"))
    members = parts.join(shape, keys).select(*pattern, group, "n_points").distinct()
    ids = materialize(parts.select(group).distinct()).withColumn("_p", F.substring(F.md5(group), 1, 2))
    ids = global_rank(ids, [("_p", True), (group, True)], levels=1).select(group, "rank")
    total = ids.count()
    draws = draw_grid(parts.sparkSession, n, total)
    drawn = draws.select("iter", (draw_index(F.lit(total), seed, F.col("iter"), F.col("j")) + 1).alias("rank")).groupBy("iter", "rank").agg(
        F.count(F.lit(1)).alias("m"))
    # Iterations travel side by side in blocks of columns: one row per (group, block), not one per iteration.
    slots = range(min(n, BLOCK))
    block, slot = F.floor(F.col("iter") / BLOCK).cast("int"), F.col("iter") % BLOCK
    weights = drawn.groupBy("rank", block.alias("block")).agg(*[F.sum(F.when(slot == p, F.col("m")).otherwise(0)).alias(f"w{p}") for p in slots])
    weights = materialize(weights.join(ids, "rank").drop("rank"))
    density = members.join(weights, group).groupBy(*pattern, "block").agg(*[F.sum(F.col("n_points") * F.col(f"w{p}")).alias(f"s{p}") for p in slots])
    per_iter = density.join(counts, pattern).select("exposed", "windows", "block", F.posexplode(F.array(*[f"s{p}" for p in slots])).alias("p", "n_points"))
    per_iter = per_iter.where(F.col("n_points") > 0).withColumn("iter", F.col("block") * BLOCK + F.col("p"))
    return coupling(per_iter, "exposed", rho, ["iter"])


def monitoring_baseline(cells: DataFrame, budgets: DataFrame, n: int = 2000, seed: int = SEED) -> DataFrame:
    """Captured exceedance share of random cell sets, per budget (strategy, budget_cells, observed_share)."""
    total = cells.agg(F.sum("exceedance_count")).scalar()
    hashed = _with_prefix(cells.select("row", "col", "exceedance_count"), n, seed)
    hist = materialize(hashed.groupBy("iter", "_p").agg(F.count(F.lit(1)).alias("_n"), F.sum("exceedance_count").alias("_x")))
    limits = F.explode(budgets.select(F.collect_list(F.struct("strategy", "budget_cells", "observed_share"))).scalar())  # one row per strategy
    edges = materialize(_boundaries(hist.withColumn("_b", limits).select("iter", "_p", "_n", "_x", "_b"), by="_b", k=F.col("_b.budget_cells")))
    rank = F.row_number().over(Window.partitionBy("iter", "_p").orderBy("_h", "row", "col"))
    near = hashed.join(edges.select("iter", "_p").distinct(), ["iter", "_p"]).withColumn("_r", rank).select("iter", "_p", "_r", "exceedance_count")
    last = edges.select("iter", "_p", "_b", "_room").join(near, ["iter", "_p"]).where(F.col("_r") <= F.col("_room"))
    last = last.groupBy("iter", "_b").agg(F.sum("exceedance_count").alias("_last"))
    shares = edges.join(last, ["iter", "_b"]).select("_b.*", "iter", ((F.col("_before_x") + F.col("_last")) / total).alias("share"))
    out = shares.groupBy("strategy", "budget_cells", "observed_share").agg(
        F.avg("share").alias("mean_random_share"), *bounded_percentiles(F.col("share"), {"p95_random_share": .95}))
    return out.withColumns({"observed_over_mean": F.try_divide(F.col("observed_share"), F.col("mean_random_share")),
                            "observed_over_p95": F.try_divide(F.col("observed_share"), F.col("p95_random_share"))})
