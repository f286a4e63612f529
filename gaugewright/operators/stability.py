"""Stability over periods by the population stability index."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.config import Thresholds, ensure_count
from gaugewright.frame import numeric, require_columns
from gaugewright.functions.ranks import exact_quantiles
from gaugewright.results import CheckResult, Status

FLOOR = 1e-4


def inner_cuts(quantiles: Sequence[float]) -> list[float]:
    """Inner edges of bins from quantiles (ends included); a baseline with one value gets a narrow bracket around it."""
    edges = sorted(set(quantiles))
    if len(edges) >= 3:
        return edges[1:-1]
    middle = (edges[0] + edges[-1]) / 2
    width = (edges[-1] - edges[0]) / 2 or max(abs(middle), 1.0) * 1e-9
    return [middle - width, middle + width]


def baseline_cuts(df: DataFrame, columns: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """The cuts of each column; those without values have none."""
    ensure_count(bins, "bins", 2)
    found = exact_quantiles(df, columns, [min(1.0, k * (1.0 / bins)) for k in range(bins + 1)])
    return {c: inner_cuts(q) if q else [] for c, q in found.items()}


def bin_index(c: Column, cuts: Sequence[float]) -> Column:
    """How many cuts are at or below the value."""
    return sum(((c >= F.lit(float(x))).cast("int") for x in cuts), F.lit(0))


def psi_from_counts(expected: Sequence[int], actual: Sequence[int]) -> float:
    n, m = sum(expected), sum(actual)
    if not n or not m:
        return math.nan
    total = 0.0
    for e, a in zip(expected, actual, strict=True):
        p, q = max(e / n, FLOOR), max(a / m, FLOOR)
        total += (q - p) * math.log(q / p)
    return total


def bin_counts(df: DataFrame, column: str, cuts: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``bin`` and ``n``; nulls are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(*by, bin_index(F.col(column), cuts).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def psi(expected: DataFrame, actual: DataFrame, column: str, bins: int = 10) -> float:
    """The index of a column between two tables, with bins at the first one's quantiles."""
    expected, actual = numeric(expected, [column]), numeric(actual, [column])
    cuts = baseline_cuts(expected, [column], bins)[column]
    if not cuts:
        return math.nan
    counts = [{r["bin"]: r["n"] for r in bin_counts(x, column, cuts).collect()} for x in (expected, actual)]
    return psi_from_counts(*[[c.get(k, 0) for k in range(len(cuts) + 1)] for c in counts])


def psi_over_time(df: DataFrame, score: str, period: str, baseline_period=None, bins: int = 10) -> DataFrame:
    """``period``, ``n`` and ``psi`` of each period but the baseline (the first one if not given)."""
    require_columns(df, [score, period])
    df = numeric(df, [score]).where(F.col(period).isNotNull())
    if baseline_period is None:
        baseline_period = df.agg(F.min(period)).first()[0]
    base = df.where(F.col(period) == F.lit(baseline_period))
    cuts = baseline_cuts(base, [score], bins)[score]
    counts = bin_counts(df, score, cuts, [period])
    spine = F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("bin")
    others = df.where(F.col(period) != F.lit(baseline_period)).groupBy(F.col(period).alias("period")).agg(F.count(score).alias("n"))
    grid = others.select("period", F.col("n").alias("total"), spine)
    actual = counts.select(F.col(period).alias("period"), "bin", F.col("n").alias("a"))
    expected = counts.where(F.col(period) == F.lit(baseline_period)).select("bin", F.col("n").alias("e"))
    n_base = base.where(F.col(score).isNotNull()).count()
    joined = grid.join(actual, ["period", "bin"], "left").join(F.broadcast(expected), "bin", "left")  # a row per bin
    p = F.greatest(F.coalesce(F.col("e"), F.lit(0)) / F.lit(float(n_base or 1)), F.lit(FLOOR))
    q = F.greatest(F.try_divide(F.coalesce(F.col("a"), F.lit(0)).cast("double"), F.col("total").cast("double")), F.lit(FLOOR))
    return joined.groupBy("period").agg(F.first("total").alias("n"), F.when(F.first("total") > 0, F.sum((q - p) * F.ln(q / p))).alias("psi")).orderBy("period")


def check_stability(df: DataFrame, score: str, period: str, baseline_period=None, bins: int = 10, thresholds: Thresholds | None = None) -> CheckResult:
    t = thresholds or Thresholds()
    require_columns(df, [score, period])
    sizes = numeric(df, [score]).where(F.col(period).isNotNull()).groupBy(period).agg(F.count(score).alias("n")).orderBy(period).collect()  # a row per period
    found = {r[period]: r["n"] for r in sizes}
    if baseline_period is not None and baseline_period not in found:
        raise ValueError(f"there is no period {baseline_period!r}")
    if len(found) < 2:
        return CheckResult("stability", Status.SKIP, "fewer than two periods")
    base = next(iter(found)) if baseline_period is None else baseline_period
    if found[base] < t.min_period_rows:
        return CheckResult("stability", Status.SKIP, f"the baseline period has {found[base]} rows", {"baseline_n": found[base]})
    table = psi_over_time(df, score, period, base, bins)
    label = F.when(F.col("psi") <= t.psi_stable, "stable").when(F.col("psi") <= t.psi_unstable, "moderate_shift").otherwise("significant_shift")
    details = table.withColumns({"underpowered": F.col("n") < t.min_period_rows, "band": F.when(F.col("psi").isNotNull(), label)})
    powered = [r for r in details.collect() if not r["underpowered"] and r["psi"] is not None]
    if not powered:
        return CheckResult("stability", Status.SKIP, "no later period has enough rows", {"baseline_n": found[base]}, details)
    top = max(powered, key=lambda r: r["psi"])
    status = Status.FAIL if top["psi"] >= t.psi_unstable else Status.WARN if top["psi"] >= t.psi_stable else Status.PASS
    return CheckResult("stability", status, f"the largest shift is {top['psi']:.3f}, in {top['period']}", {"max_psi": top["psi"], "worst_period": top["period"], "baseline_period": base, "n_periods": len(found)}, details)
