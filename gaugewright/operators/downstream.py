"""Downstream validity: how well a score orders a later outcome."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.config import Thresholds, ensure_count
from gaugewright.frame import Outcome, numeric, outcome_kind, require_columns
from gaugewright.functions.ranks import auc_table, guarded_corr, midrank, quantile_bands, ratio, running, spearman, value_counts
from gaugewright.results import CheckResult, Status

LEAST_ROWS = 30


def paired(df: DataFrame, score: str, outcome: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, Outcome]:
    """Complete pairs as ``score`` and ``y`` (binary outcomes as 0 and 1), and what the outcome is among them."""
    require_columns(df, [score, outcome, *keep])
    df = numeric(df, [score]).where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    kind = outcome_kind(df, outcome)
    y = kind.encoded(F.col(outcome))
    return df.select(F.col(score).alias("score"), y.alias("y"), *keep).where("y IS NOT NULL"), kind


def lift_rows(counts: DataFrame, bands: int, keys: tuple[str, ...] = (), *, ascending: bool = False) -> DataFrame:
    """The lift table from counts of distinct scores (``score``, ``n`` and the outcome's sum ``pos``)."""
    banded = quantile_bands(running(counts, "score", keys).withColumn("midrank", midrank()), bands, keys, ascending=ascending)
    rows = banded.groupBy(*keys, "band").agg(F.sum("n").alias("n"), F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.sum("pos").alias("_pos"))
    whole, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("band")
    rate = F.col("_pos") / F.col("n")
    return rows.select(
        *keys, "band", "n", "score_min", "score_max", rate.alias("outcome_rate"), ratio(rate, F.sum("_pos").over(whole) / F.sum("n").over(whole)).alias("lift"), ratio(F.sum("_pos").over(so_far), F.sum("_pos").over(whole)).alias("cum_capture")
    )


def lift_table(df: DataFrame, score: str, outcome: str, n_bands: int = 10, ascending: bool = False) -> DataFrame:
    """``band``, ``n``, ``score_min``, ``score_max``, ``outcome_rate``, ``lift``, ``cum_capture``; band 1 has the highest scores, or the lowest if ``ascending``."""
    ensure_count(n_bands, "n_bands", 1)
    pairs, _ = paired(df, score, outcome)
    return lift_rows(value_counts(pairs, "score", (), {"pos": F.col("y")}), n_bands, ascending=ascending).orderBy("band")


def validity_table(pairs: DataFrame, kind: Outcome, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per ``keys``: ``n`` and ``spearman``, with ``auc``, ``n_pos``, ``n_neg`` (binary) or ``pearson``."""
    if kind.kind == "binary":
        return auc_table(pairs, "score", F.col("y"), keys)
    rho = spearman(pairs, "score", "y", keys)
    r = pairs.groupBy(*keys).agg(guarded_corr(F.col("score"), F.col("y")).alias("pearson"))
    if not keys:
        return rho.join(F.broadcast(r))  # one row each
    return rho.join(r, list(keys))


def oriented(value: float | None, polarity: int, kind: str) -> float:
    if value is None:
        return math.nan
    return (value if polarity > 0 else 1 - value) if kind == "binary" else value * polarity


def downstream_validity(df: DataFrame, score: str, outcome: str) -> dict:
    """``n``, ``spearman``, ``polarity``, ``outcome_type``, and ``auc``, ``auc_oriented``, ``base_rate``, ``n_pos``, ``n_neg`` or ``pearson``."""
    pairs, kind = paired(df, score, outcome)
    return validity_of(pairs, kind)


def validity_of(pairs: DataFrame, kind: Outcome) -> dict:
    if kind.kind == "constant":
        return {"n": kind.n, "spearman": math.nan, "polarity": 1, "outcome_type": "constant"}
    row = validity_table(pairs, kind).first()
    rho = row["spearman"]
    polarity = -1 if rho is not None and rho < 0 else 1
    out = {"n": row["n"], "spearman": math.nan if rho is None else rho, "polarity": polarity, "outcome_type": kind.kind}
    if kind.kind == "binary":
        auc = row["auc"]
        return out | {"auc": math.nan if auc is None else auc, "auc_oriented": oriented(auc, polarity, "binary"), "base_rate": row["n_pos"] / row["n"], "n_pos": row["n_pos"], "n_neg": row["n_neg"]}
    return out | {"pearson": math.nan if row["pearson"] is None else row["pearson"]}


def grade_effect(found: dict, t: Thresholds) -> tuple[Status, float, str]:
    """Status, effect and its name of validity figures."""
    binary = found["outcome_type"] == "binary"
    effect = found.get("auc_oriented", math.nan) if binary else abs(found["spearman"])
    weak, strong = (t.min_auc_weak, t.min_auc_strong) if binary else (t.min_corr_weak, t.min_corr_strong)
    name = "oriented AUC" if binary else "absolute rank correlation"
    if math.isnan(effect) or effect < weak:
        return Status.FAIL, effect, name
    return (Status.WARN if effect < strong else Status.PASS), effect, name


def check_downstream(df: DataFrame, score: str, outcome: str, thresholds: Thresholds | None = None, n_bands: int = 10) -> CheckResult:
    t = thresholds or Thresholds()
    pairs, kind = paired(df, score, outcome)
    if kind.kind == "constant":
        return CheckResult("downstream", Status.SKIP, "the outcome doesn't vary", {"n": kind.n})
    if kind.n < LEAST_ROWS:
        return CheckResult("downstream", Status.SKIP, f"only {kind.n} rows have score and outcome", {"n": kind.n})
    found = validity_of(pairs, kind)
    if kind.kind == "binary" and min(found["n_pos"], found["n_neg"]) < t.min_class_count:
        return CheckResult("downstream", Status.SKIP, "one of the outcome's classes is too small", found)
    status, effect, name = grade_effect(found, t)
    bands = min(n_bands, max(2, found["n"] // 30))
    return CheckResult("downstream", status, f"{name} {effect:.3f}", found | {"effect": effect, "n_bands": bands}, lift_table(df, score, outcome, bands))


def outcome_column(kind: Outcome, name: str) -> Column:
    return kind.encoded(F.col(name))
