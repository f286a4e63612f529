"""Leakage: indicators that know the outcome too well, or are named after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.config import Thresholds
from gaugewright.frame import numeric, outcome_kind
from gaugewright.functions.ranks import auc_table, spearman
from gaugewright.results import CheckResult, Status


def leakage_scan(df: DataFrame, indicators: Sequence[str], outcome: str, thresholds: Thresholds | None = None) -> DataFrame:
    """``indicator``, ``association``, ``association_metric``, ``n_overlap``, ``assessed``, ``statistical_flag`` and ``name_flag``; all indicators in one pass."""
    t = thresholds or Thresholds()
    df = numeric(df, indicators)
    kind = outcome_kind(df, outcome)
    y = kind.encoded(F.col(outcome))
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).alias("score")) for c in indicators])).alias("x")
    pairs = df.select(both, y.alias("y")).select("x.indicator", "x.score", "y").where("score IS NOT NULL AND y IS NOT NULL")
    if kind.kind == "binary":
        table = auc_table(pairs, "score", F.col("y"), ["indicator"]).withColumn("association", F.when(F.col("spearman").isNotNull(), F.greatest("auc", 1 - F.col("auc"))))
        metric, limit = "oriented_auc", t.leak_auc
    else:
        table = spearman(pairs, "score", "y", ["indicator"]).withColumn("association", F.abs("spearman"))
        metric, limit = "abs_spearman", t.leak_corr
    named = [(c, any(p in c.lower() for p in t.leak_name_patterns)) for c in indicators]
    spine = df.sparkSession.createDataFrame(named, "indicator string, name_flag boolean")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    assessed = (n >= t.min_leak_rows) & F.col("association").isNotNull()
    association = F.when(assessed, F.col("association"))
    return spine.join(table, "indicator", "left").select(
        "indicator", association.alias("association"), F.lit(metric).alias("association_metric"), n.alias("n_overlap"), assessed.alias("assessed"), F.coalesce(association >= limit, F.lit(False)).alias("statistical_flag"), "name_flag"
    )


def check_leakage(df: DataFrame, indicators: Sequence[str], outcome: str, thresholds: Thresholds | None = None) -> CheckResult:
    if outcome_kind(df, outcome).kind == "constant":
        return CheckResult("leakage", Status.SKIP, "the outcome doesn't vary")
    table = leakage_scan(df, indicators, outcome, thresholds)
    rows = table.collect()  # a row per indicator
    flagged = sorted(r["indicator"] for r in rows if r["statistical_flag"])
    named = sorted(r["indicator"] for r in rows if r["name_flag"])
    open_ = sorted(r["indicator"] for r in rows if not r["assessed"])
    top = max((r["association"] for r in rows if r["assessed"]), default=None)
    metrics = {"max_association": top, "n_flagged": len(flagged), "n_name_flagged": len(named), "n_unassessed": len(open_)}
    if len(open_) == len(rows) and not named:
        return CheckResult("leakage", Status.SKIP, "no indicator could be assessed", metrics, table)
    status = Status.FAIL if flagged else Status.WARN if named or open_ else Status.PASS
    parts = [f"too close to the outcome: {', '.join(flagged)}"] * bool(flagged) + [f"named after the outcome: {', '.join(named)}"] * bool(named) + [f"not assessed: {', '.join(open_)}"] * bool(open_)
    return CheckResult("leakage", status, "; ".join(parts) or "no sign of leakage", metrics, table)
