"""Operating policies: who is selected at a cutoff, and what that is worth."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.config import Thresholds, ensure_count
from gaugewright.frame import Outcome, check_unique, numeric, outcome_kind, require_columns
from gaugewright.functions.ranks import exact_quantiles, nth_smallest, running, value_counts
from gaugewright.operators.downstream import paired, validity_of

OBJECTIVES = ("expected_value", "f1", "precision", "recall", "youden_j")
BINARY = (
    "n selected_n selected_rate tp fp tn fn precision recall specificity false_positive_rate false_negative_rate accuracy f1 youden_j".split()
)
CONTINUOUS = "n selected_n selected_rate outcome_mean selected_outcome_mean unselected_outcome_mean outcome_mean_difference".split()
ECONOMIC = "expected_value expected_value_per_record net_value_vs_no_action break_even_tp_benefit".split()


@dataclass(frozen=True)
class Policy:
    """Selects rows whose oriented score exceeds ``at``, and of those equal to it the ones whose key isn't after ``tie`` (all if None)."""

    policy_id: str
    strategy: str
    parameter: float
    cutoff: float
    at: float
    tie: tuple | None = None

    def selects(self, oriented: Column, key: Sequence[str]) -> Column:
        if self.tie is None:
            return oriented >= F.lit(self.at)
        first = F.struct(*[F.col(k) for k in key]) <= F.struct(*[F.lit(v).alias(k) for k, v in zip(key, self.tie, strict=True)])
        return (oriented > F.lit(self.at)) | ((oriented == F.lit(self.at)) & first)


@dataclass(frozen=True)
class Economics:
    true_positive_benefit: float = 0.0
    false_positive_cost: float = 0.0
    false_negative_cost: float = 0.0
    action_cost: float = 0.0

    @classmethod
    def of(cls, *values: float | None) -> Economics | None:
        """None if no value is given; those missing count as 0."""
        if all(v is None for v in values):
            return None
        given = [float(v or 0.0) for v in values]
        if any(not math.isfinite(v) or v < 0 for v in given):
            raise ValueError("benefit and costs must be finite and not negative")
        return cls(*given)


def top_policy(df: DataFrame, n: int, key: Sequence[str], polarity: int, policy_id: str) -> Policy:
    """Exactly the ``n`` rows with the best oriented scores; ties go to the smaller key. ``df`` has ``score`` and ``oriented``."""
    if n == 0:
        return Policy(policy_id, "top_n", 0, polarity * math.inf, math.inf)
    ranked = running(value_counts(df.withColumn("_down", -F.col("oriented")), "_down"), "_down")
    edge = ranked.where((F.col("below") < n) & (F.col("below") + F.col("n") >= n)).first()
    if edge is None:
        return Policy(policy_id, "top_n", n, polarity * -math.inf, -math.inf)
    at, need = -edge["_down"], n - edge["below"]
    tie = None
    if need < edge["n"]:
        ties = df.where(F.col("oriented") == at).select(F.struct(*key).alias("_key"))
        tie = tuple(nth_smallest(ties, "_key", need))
    return Policy(policy_id, "top_n", n, at * polarity, at, tie)


def make_policies(df: DataFrame, key: Sequence[str], polarity: int, cutoffs: Sequence[float], percentiles: Sequence[float], top_n: Sequence[int], grid_size: int | None) -> list[Policy]:
    """Policies in the order cutoffs, percentiles, top_n, grid; a grid of 20 if nothing is asked for."""
    out: list[Policy] = []
    name = lambda: f"strategy_{len(out) + 1}"
    if not (cutoffs or percentiles or top_n or grid_size):
        grid_size = 20
    for c in cutoffs:
        if not math.isfinite(c):
            raise ValueError("cutoffs must be finite")
        out.append(Policy(name(), "cutoff", float(c), float(c), float(c) * polarity))
    if any(not 0 < p <= 100 for p in percentiles):
        raise ValueError("percentiles must lie above 0 and at most at 100")
    steps = [k / (grid_size - 1) if grid_size > 1 else 0.0 for k in range(ensure_count(grid_size, "grid_size", 1))] if grid_size else []
    wanted = sorted({1 - p / 100 for p in percentiles} | set(steps))
    found = dict(zip(wanted, exact_quantiles(df, ["oriented"], wanted)["oriented"], strict=False)) if wanted else {}
    for p in percentiles:
        out.append(Policy(name(), "percentile", float(p), found[1 - p / 100] * polarity, found[1 - p / 100]))
    for n in top_n:
        out.append(top_policy(df, ensure_count(n, "top_n", 0), key, polarity, name()))
    for at in sorted({found[s] for s in steps}):
        out.append(Policy(name(), "grid", at * polarity, at * polarity, at))
    return out


def _div(a: float, b: float) -> float:
    return a / b if b else math.nan


def confusion(n: int, selected: int, tp: int, positives: int, money: Economics | None = None) -> dict:
    fp, fn = selected - tp, positives - tp
    tn = n - selected - fn
    precision, recall, specificity = _div(tp, selected), _div(tp, tp + fn), _div(tn, tn + fp)
    out = {
        "n": n, "selected_n": selected, "selected_rate": _div(selected, n), "tp": tp, "fp": fp, "tn": tn, "fn": fn, "precision": precision, "recall": recall, "specificity": specificity,
        "false_positive_rate": 1 - specificity, "false_negative_rate": 1 - recall, "accuracy": _div(tp + tn, n), "f1": _div(2 * precision * recall, precision + recall), "youden_j": recall + specificity - 1,
    }
    if money:
        spent = fp * money.false_positive_cost + fn * money.false_negative_cost + selected * money.action_cost
        value = tp * money.true_positive_benefit - spent
        out |= {"expected_value": value, "expected_value_per_record": _div(value, n), "net_value_vs_no_action": value + positives * money.false_negative_cost, "break_even_tp_benefit": _div(spent, tp)}
    return out


def means(n: int, selected: int, total: float, chosen: float) -> dict:
    inside, outside = _div(chosen, selected), _div(total - chosen, n - selected)
    return {"n": n, "selected_n": selected, "selected_rate": _div(selected, n), "outcome_mean": _div(total, n), "selected_outcome_mean": inside, "unselected_outcome_mean": outside, "outcome_mean_difference": inside - outside}


def _null_nan(row: dict) -> dict:
    return {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in row.items()}


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    names = [c.rsplit(" ", 1)[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(_null_nan(r).get(n) for n in names) for r in rows], schema)


def _kind_of(name: str) -> str:
    return "long" if name in ("n", "selected_n", "tp", "fp", "tn", "fn") else "double"


@dataclass
class ActionAnalysis:
    outcome: Outcome
    polarity: int
    policies: list[Policy]
    rows: list[dict]
    table: DataFrame
    segments: DataFrame | None
    assignments: DataFrame
    economics: Economics | None
    metrics: dict = field(default_factory=dict)

    def recommend(self, objective: str = "f1", *, max_actions: int | None = None, min_recall: float | None = None) -> dict | None:
        """The policy with the best objective; then fewest selected, then its id. None if none qualifies."""
        if objective not in OBJECTIVES:
            raise ValueError(f"objective must be one of {', '.join(OBJECTIVES)}")
        if self.outcome.kind != "binary":
            raise ValueError("recommendations need a binary outcome")
        if objective == "expected_value" and self.economics is None:
            raise ValueError("the expected value needs benefit or costs")
        fit = [r for r in self.rows if not math.isnan(r[objective]) and (max_actions is None or r["selected_n"] <= max_actions) and (min_recall is None or r["recall"] >= min_recall)]
        return min(fit, key=lambda r: (-r[objective], r["selected_n"], r["policy_id"]), default=None)


def analyze_actions(
    df: DataFrame,
    score: str,
    outcome: str,
    *,
    key: Sequence[str],
    cutoffs: Sequence[float] = (),
    percentiles: Sequence[float] = (),
    top_n: Sequence[int] = (),
    grid_size: int | None = None,
    polarity: int | str = "auto",
    segments: str | None = None,
    thresholds: Thresholds | None = None,
    true_positive_benefit: float | None = None,
    false_positive_cost: float | None = None,
    false_negative_cost: float | None = None,
    action_cost: float | None = None,
) -> ActionAnalysis:
    """All policies on complete pairs, in one pass over the rows (one more per segment column)."""
    t = thresholds or Thresholds()
    require_columns(df, [score, outcome, *key, *([segments] if segments else [])])
    check_unique(df, key)
    df = numeric(df, [score])
    rows = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    kind = outcome_kind(rows, outcome)
    if polarity == "auto":
        pairs, pair_kind = paired(df, score, outcome)
        polarity = validity_of(pairs, pair_kind)["polarity"]
    if polarity not in (1, -1):
        raise ValueError("polarity must be auto, 1 or -1")
    money = Economics.of(true_positive_benefit, false_positive_cost, false_negative_cost, action_cost)
    if money and kind.kind != "binary":
        raise ValueError("benefit and costs need a binary outcome")
    y = kind.encoded(F.col(outcome)) if kind.kind != "constant" else F.lit(0.0)
    frame = rows.select(*key, F.col(score).alias("score"), (F.col(score) * polarity).alias("oriented"), y.alias("y"), *([F.col(segments).alias("segment")] if segments else []))
    policies = make_policies(frame, key, int(polarity), cutoffs, percentiles, top_n, grid_size)
    chosen = {p.policy_id: p.selects(F.col("oriented"), key) for p in policies}
    sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y")]
    sums += [F.count_if(c).alias(f"s_{p}") for p, c in chosen.items()] + [F.coalesce(F.sum(F.when(c, F.col("y"))), F.lit(0.0)).alias(f"y_{p}") for p, c in chosen.items()]

    def measure(r, p: Policy) -> dict:
        if kind.kind == "binary":
            return confusion(r["n"], r[f"s_{p.policy_id}"], int(r[f"y_{p.policy_id}"]), int(r["y"]), money)
        return means(r["n"], r[f"s_{p.policy_id}"], r["y"], r[f"y_{p.policy_id}"])

    names = [*(BINARY if kind.kind == "binary" else CONTINUOUS), *(ECONOMIC if money else [])]
    whole = frame.agg(*sums).first()
    head = lambda p: {"policy_id": p.policy_id, "strategy": p.strategy, "parameter": float(p.parameter), "score_cutoff": float(p.cutoff)}
    made = [head(p) | measure(whole, p) for p in policies]
    schema = ", ".join(["policy_id string", "strategy string", "parameter double", "score_cutoff double", *[f"{n} {_kind_of(n)}" for n in names]])
    spark = df.sparkSession
    by_segment = None
    if segments:
        found = []
        for r in frame.groupBy("segment").agg(*sums).orderBy("segment").collect():  # a row per segment; null is one
            positives = int(r["y"])
            reason = f"fewer than {t.min_segment_size} rows" if r["n"] < t.min_segment_size else "a class is too small" if kind.kind == "binary" and min(positives, r["n"] - positives) < t.min_class_count else None
            for p in policies:
                full = measure(r, p)
                part = full if reason is None else {k: full[k] for k in ("n", "selected_n", "selected_rate")}
                found.append({"policy_id": p.policy_id, "segment": None if r["segment"] is None else str(r["segment"]), "assessed": reason is None, "unassessed_reason": reason} | part)
        by_segment = _table(spark, found, ", ".join(["policy_id string", "segment string", "assessed boolean", "unassessed_reason string", *[f"{n} {_kind_of(n)}" for n in names]]))
    assignments = frame.select(*key, *[c.alias(p) for p, c in chosen.items()])
    return ActionAnalysis(kind, int(polarity), policies, made, _table(spark, made, schema), by_segment, assignments, money, {"n": whole["n"], "polarity": int(polarity), "outcome_type": kind.kind})
