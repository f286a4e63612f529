"""Segment bias: levels and validity by segment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.config import Thresholds
from gaugewright.frame import numeric, outcome_kind, require_columns
from gaugewright.functions.ranks import ratio
from gaugewright.operators.downstream import validity_table
from gaugewright.results import CheckResult, Status


def segment_levels(df: DataFrame, score: str, segments: str) -> DataFrame:
    """``segment``, ``n``, ``score_mean``, ``score_std``, ``pooled_within_std``, ``smd_vs_rest``; null segments are left out."""
    rows = df.where(F.col(score).isNotNull() & F.col(segments).isNotNull())
    g = rows.groupBy(F.col(segments).alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("score_mean"), F.stddev_samp(score).alias("score_std"))
    every = Window.partitionBy()  # over a row per segment
    inside = F.sum((F.col("n") - 1) * F.coalesce(F.col("score_std") * F.col("score_std"), F.lit(0.0))).over(every)
    total, weighted, groups = F.sum("n").over(every), F.sum(F.col("n") * F.col("score_mean")).over(every), F.count(F.lit(1)).over(every)
    pooled = F.sqrt(ratio(inside, F.when(total > groups, total - groups)))
    rest = ratio(weighted - F.col("n") * F.col("score_mean"), total - F.col("n"))
    out = g.withColumns({"pooled_within_std": pooled, "_rest": rest})
    return out.withColumn("smd_vs_rest", F.when(F.col("pooled_within_std") > 0, (F.col("score_mean") - F.col("_rest")) / F.col("pooled_within_std"))).drop("_rest")


def segment_summary(df: DataFrame, score: str, segments: str, outcome: str | None = None) -> DataFrame:
    """Levels and, with an outcome, ``n_outcome``, ``n_pos``, ``n_neg``, ``outcome_rate`` or ``outcome_mean``, and ``validity`` turned by the overall polarity."""
    require_columns(df, [score, segments, *([outcome] if outcome else [])])
    df = numeric(df, [score]).where(F.col(score).isNotNull() & F.col(segments).isNotNull())
    levels = segment_levels(df, score, segments)
    if outcome is None:
        return levels.orderBy("segment")
    kind = outcome_kind(df, outcome)
    pairs = df.select(F.col(score).alias("score"), kind.encoded(F.col(outcome)).alias("y"), F.col(segments).alias("segment")).where("y IS NOT NULL")
    if kind.kind == "constant":
        n = pairs.groupBy("segment").agg(F.count("y").alias("n_outcome"))
        return levels.join(n, "segment", "left").withColumn("validity", F.lit(None).cast("double")).orderBy("segment")
    whole = validity_table(pairs, kind).first()["spearman"]
    polarity = -1 if whole is not None and whole < 0 else 1
    table = validity_table(pairs, kind, ("segment",))
    if kind.kind == "binary":
        value = F.col("auc") if polarity > 0 else 1 - F.col("auc")
        extra = table.select("segment", F.col("n").alias("n_outcome"), "n_pos", "n_neg", ratio(F.col("n_pos"), F.col("n")).alias("outcome_rate"), value.alias("validity"))
    else:
        means = pairs.groupBy("segment").agg(F.avg("y").alias("outcome_mean"))
        extra = table.join(means, "segment").select("segment", F.col("n").alias("n_outcome"), "outcome_mean", (F.col("spearman") * polarity).alias("validity"))
    return levels.join(extra, "segment", "left").withColumn("n_outcome", F.coalesce("n_outcome", F.lit(0))).orderBy("segment")


def check_segments(df: DataFrame, score: str, segments: str, outcome: str | None = None, thresholds: Thresholds | None = None) -> CheckResult:
    t = thresholds or Thresholds()
    table = segment_summary(df, score, segments, outcome)
    rows = table.collect()  # a row per segment
    large = [r for r in rows if r["n"] >= t.min_segment_size]
    if len(rows) < 2 or len(large) < 2:
        return CheckResult("segments", Status.SKIP, "fewer than two segments are large enough", {"n_segments": len(rows)}, table)
    smds = [abs(r["smd_vs_rest"]) for r in large if r["smd_vs_rest"] is not None]
    warns, fails = [], []
    metrics: dict = {"n_segments": len(rows), "max_abs_smd": max(smds, default=math.nan)}
    if len(large) < len(rows):
        warns.append(f"{len(rows) - len(large)} segments are small")
    if metrics["max_abs_smd"] > t.max_segment_smd:
        warns.append(f"score levels differ by up to {metrics['max_abs_smd']:.2f} standard deviations")
    if outcome is not None:
        binary = "n_pos" in table.columns
        fair = [r for r in large if r["validity"] is not None and (not binary or min(r["n_pos"], r["n_neg"]) >= t.min_class_count) and r["n_outcome"] >= 3]
        if len(fair) < len(large):
            warns.append(f"validity can't be assessed in {len(large) - len(fair)} segments")
        if len(fair) >= 2:
            gap = max(r["validity"] for r in fair) - min(r["validity"] for r in fair)
            metrics |= {"validity_gap": gap, "min_validity": min(r["validity"] for r in fair)}
            if gap > (t.max_segment_auc_gap if binary else t.max_segment_corr_gap):
                warns.append(f"validity differs by {gap:.2f} between segments")
        else:
            warns.append("fewer than two segments can be compared")
        fails += [f"the score doesn't work in {r['segment']}" for r in fair if r["validity"] <= (0.5 if binary else 0.0)]
    status = Status.FAIL if fails else Status.WARN if warns else Status.PASS
    return CheckResult("segments", status, "; ".join(fails + warns) or "segments agree", metrics, table, fails + warns)
