"""Indicator quality: missing values, spread, agreement, redundancy, dominance."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.config import Thresholds
from gaugewright.frame import numeric
from gaugewright.functions.moments import BlockMoments, block_moments, column_moments, zscore
from gaugewright.functions.ranks import guarded_corr
from gaugewright.results import CheckResult, Status


def indicator_summary(df: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """``indicator``, ``missing_rate``, ``n_unique``, ``std`` (population) and ``item_rest_corr`` (with the mean of the others' z-scores)."""
    df = numeric(df, indicators)
    found = column_moments(df, indicators)
    z = {c: zscore(F.col(c), m["mean"], m["std"]) for c, m in found.items()}
    rest = {}
    for c in indicators:
        others = [z[o] for o in indicators if o != c]
        seen = sum((o.isNotNull().cast("int") for o in others), F.lit(0))
        rest[c] = F.try_divide(sum((F.coalesce(o, F.lit(0.0)) for o in others), F.lit(0.0)), F.nullif(seen, F.lit(0)).cast("double"))
    wide = df.agg(*[guarded_corr(F.col(c), rest[c]).alias(f"r_{i}") for i, c in enumerate(indicators)])
    corr = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(f"r_{i}").alias("item_rest_corr")) for i, c in enumerate(indicators)])).alias("x")).select("x.*")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).alias("value")) for c in indicators])).alias("x")).select("x.*")
    values = long.groupBy("indicator", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = values.groupBy("indicator").agg((F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)) / F.sum("n").cast("double")).alias("missing_rate"), F.count("value").alias("n_unique"))
    std = F.element_at(F.create_map(*[x for c in indicators for x in (F.lit(c), F.lit(found[c]["std"]).cast("double"))]), F.col("indicator"))
    return counts.join(F.broadcast(corr), "indicator").select("indicator", "missing_rate", "n_unique", std.alias("std"), "item_rest_corr")  # a row per indicator


def cronbach_alpha(df: DataFrame, indicators: Sequence[str]) -> float:
    """Standardised alpha of complete rows; NaN under two columns or three rows."""
    return alpha_of(block_moments(numeric(df, indicators), indicators))


def alpha_of(block: BlockMoments) -> float:
    k, corr = len(block.columns), block.corr()
    if k < 2 or block.n < 3 or corr.sum() <= 0:
        return math.nan
    return float(k / (k - 1) * (1 - np.trace(corr) / corr.sum()))


def vif(df: DataFrame, indicators: Sequence[str]) -> dict[str, float]:
    """Variance inflation of each column; inf where it is determined by the others, NaN where it is constant or rows are too few."""
    return vif_of(block_moments(numeric(df, indicators), indicators))


def vif_of(block: BlockMoments) -> dict[str, float]:
    k, corr = len(block.columns), block.corr()
    out = {}
    for i, c in enumerate(block.columns):
        if k < 2 or block.n <= k or corr[i, i] == 0:
            out[c] = math.nan
            continue
        others = [j for j in range(k) if j != i]
        left = 1 - float(corr[i, others] @ np.linalg.pinv(corr[np.ix_(others, others)], rcond=1e-10) @ corr[others, i])
        out[c] = math.inf if left < 1e-12 else 1 / left
    return out


def redundant_pairs(df: DataFrame, indicators: Sequence[str], threshold: float = 0.90) -> DataFrame:
    """``indicator_a``, ``indicator_b`` and ``corr`` of pairs with a correlation of at least the threshold, over rows where both are present."""
    df = numeric(df, indicators)
    pairs = [(a, b) for i, a in enumerate(indicators) for b in indicators[i + 1 :]]
    schema = "indicator_a string, indicator_b string, corr double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    wide = df.agg(*[guarded_corr(F.col(a), F.col(b)).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("indicator_a"), F.lit(b).alias("indicator_b"), F.col(f"r_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("x")).select("x.*").where(F.abs("corr") >= threshold)


def dominance(df: DataFrame, indicators: Sequence[str], score: str) -> dict[str, float]:
    """Absolute correlation of each indicator with the score, where there are at least three pairs."""
    df = numeric(df, [*indicators, score])
    both = [F.when(F.count_if(F.col(c).isNotNull() & F.col(score).isNotNull()) >= 3, F.abs(guarded_corr(F.col(c), F.col(score)))).alias(f"r_{i}") for i, c in enumerate(indicators)]
    row = df.agg(*both).first()
    return {c: row[f"r_{i}"] for i, c in enumerate(indicators) if row[f"r_{i}"] is not None}


def check_indicators(df: DataFrame, indicators: Sequence[str], score: str | None = None, thresholds: Thresholds | None = None) -> CheckResult:
    t = thresholds or Thresholds()
    table = indicator_summary(df, indicators)
    rows = {r["indicator"]: r for r in table.collect()}  # a row per indicator
    block = block_moments(numeric(df, indicators, check=False), indicators)
    alpha, inflation = alpha_of(block), vif_of(block)
    pairs = redundant_pairs(df, indicators, t.max_pairwise_corr).collect()
    close = dominance(df, indicators, score) if score is not None and len(indicators) > 1 else {}
    looked = lambda values: F.element_at(F.create_map(*[x for c in indicators for x in (F.lit(c), F.lit(values.get(c)).cast("double"))]), F.col("indicator"))
    details = table.withColumns({"vif": looked(inflation), "score_corr_abs": looked(close)})
    fails, warns = [], []
    for c in indicators:
        r = rows.get(c)
        if r is None or r["std"] is None:
            fails.append(f"{c} has no values")
        elif r["std"] == 0:
            fails.append(f"{c} is constant")
        if r is not None and r["missing_rate"] > t.max_missing_rate:
            warns.append(f"{c} is missing in {r['missing_rate']:.1%} of rows")
        if r is not None and r["item_rest_corr"] is not None and abs(r["item_rest_corr"]) < t.min_item_rest_corr:
            warns.append(f"{c} hardly agrees with the others ({r['item_rest_corr']:.2f})")
        if inflation[c] > t.max_vif:
            warns.append(f"{c} has a variance inflation of {inflation[c]:.1f}")
    if alpha < t.min_cronbach_alpha:
        warns.append(f"alpha is {alpha:.2f}")
    warns += [f"{p['indicator_a']} and {p['indicator_b']} correlate at {p['corr']:.2f}" for p in pairs]
    warns += [f"{c} alone nearly is the score ({r:.2f})" for c, r in close.items() if r >= t.max_score_indicator_corr]
    status = Status.FAIL if fails else Status.WARN if warns else Status.PASS
    return CheckResult("indicators", status, "; ".join(fails + warns) or "the indicators are sound", {"n_indicators": len(indicators), "cronbach_alpha": alpha, "max_vif": max(inflation.values(), default=math.nan), "redundant_pairs": len(pairs)}, details, fails + warns)
