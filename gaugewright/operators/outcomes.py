"""Validation against several outcomes, each with its own window and maturity."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.config import Thresholds
from gaugewright.frame import outcome_kind, require_columns
from gaugewright.operators.compare import ScoreComparison, compare_scores
from gaugewright.operators.downstream import check_downstream
from gaugewright.operators.leakage import check_leakage
from gaugewright.results import CheckResult, Status, Verdict
from gaugewright.report.tables import markdown_document


@dataclass(frozen=True)
class OutcomeSpec:
    """An outcome column: its type, expected polarity, window, importance, and a boolean column of rows whose window has closed."""

    column: str
    outcome_type: str
    polarity: int | str = "auto"
    window: str = "unspecified"
    importance: str = "required"
    mature: str | None = None

    def __post_init__(self) -> None:
        if self.outcome_type not in ("binary", "continuous"):
            raise ValueError("outcome_type must be binary or continuous")
        if self.polarity not in ("auto", 1, -1):
            raise ValueError("polarity must be auto, 1 or -1")
        if self.importance not in ("required", "supporting"):
            raise ValueError("importance must be required or supporting")

    @classmethod
    def from_alignment(cls, outcome_type: str, **how) -> OutcomeSpec:
        """The spec of an aligned outcome; use it on the frame of :func:`with_maturity`."""
        return cls("aligned_outcome", outcome_type, mature="outcome_mature", **how)

    def mature_rows(self, df: DataFrame) -> DataFrame:
        require_columns(df, [self.column, *([self.mature] if self.mature else [])])
        return df.where(F.col(self.mature)) if self.mature else df


def with_maturity(aligned: DataFrame) -> DataFrame:
    """Aligned observations with ``outcome_mature``: whether the outcome is known or its window has closed."""
    return aligned.withColumn("outcome_mature", F.col("outcome_status") != "censored")


@dataclass
class OutcomeValidation:
    spec: OutcomeSpec
    summary: dict
    downstream: CheckResult
    leakage: CheckResult


@dataclass
class MultiOutcomeReport:
    verdict: Verdict
    reason: str
    outcomes: dict[str, OutcomeValidation]
    summary: list[dict] = field(default_factory=list)

    def to_markdown(self, max_rows: int = 50) -> str:
        return markdown_document("Outcomes", {"verdict": self.verdict.value, "reason": self.reason}, {"summary": self.summary}, max_rows)


def validate_outcome(df: DataFrame, score: str, indicators: Sequence[str], name: str, spec: OutcomeSpec, thresholds: Thresholds | None = None) -> OutcomeValidation:
    rows = spec.mature_rows(df)
    kind = outcome_kind(rows, spec.column)
    if kind.kind not in ("constant", spec.outcome_type):
        raise ValueError(f"outcome {name} is {kind.kind}, not {spec.outcome_type}")
    counts = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    found = rows.agg(F.count(F.lit(1)).alias("mature"), F.count(spec.column).alias("observed"), F.count_if(F.col(spec.column).isNotNull() & F.col(score).isNotNull()).alias("evaluated")).first()
    downstream = check_downstream(rows, score, spec.column, thresholds)
    leakage = check_leakage(rows, indicators, spec.column, thresholds)
    rho = downstream.metrics.get("spearman", math.nan)
    detected = None if math.isnan(rho) or rho == 0 else -1 if rho < 0 else 1
    summary = {
        "outcome": name, "importance": spec.importance, "outcome_type": spec.outcome_type, "window": spec.window, "input_rows": counts, "mature_rows": found["mature"], "immature_rows": counts - found["mature"], "observed_rows": found["observed"],
        "missing_rows": found["mature"] - found["observed"], "missing_rate": (found["mature"] - found["observed"]) / found["mature"] if found["mature"] else math.nan, "evaluation_rows": found["evaluated"], "expected_polarity": spec.polarity, "detected_polarity": detected,
        "polarity_contradiction": spec.polarity != "auto" and detected is not None and detected != spec.polarity, "downstream_status": downstream.status.value, "leakage_status": leakage.status.value,
    }
    return OutcomeValidation(spec, summary, downstream, leakage)


def overall(found: Sequence[OutcomeValidation]) -> tuple[Verdict, str]:
    required = [v for v in found if v.spec.importance == "required"]
    for v in required:
        name = v.summary["outcome"]
        if Status.FAIL in (v.downstream.status, v.leakage.status) or v.summary["polarity_contradiction"]:
            return Verdict.NOT_VALIDATED, f"{name} fails or contradicts the expected direction"
        if v.downstream.status is Status.SKIP:
            return Verdict.NOT_VALIDATED, f"{name} can't be assessed"
    for v in found:
        bad = v.downstream.status is Status.FAIL or v.leakage.status is Status.FAIL or v.summary["polarity_contradiction"]
        if v.spec.importance == "required" and (Status.WARN in (v.downstream.status, v.leakage.status) or v.leakage.status is Status.SKIP):
            return Verdict.DIRECTIONAL, f"{v.summary['outcome']} is supported with reservations"
        if v.spec.importance == "supporting" and bad:
            return Verdict.DIRECTIONAL, f"{v.summary['outcome']}, a supporting outcome, disagrees"
    return Verdict.DECISION_GRADE, "all required outcomes are supported"


def validate_outcomes(df: DataFrame, score: str, indicators: Sequence[str], outcomes: dict[str, OutcomeSpec], thresholds: Thresholds | None = None) -> MultiOutcomeReport:
    if not any(s.importance == "required" for s in outcomes.values()):
        raise ValueError("at least one outcome must be required")
    found = {n: validate_outcome(df, score, indicators, n, s, thresholds) for n, s in outcomes.items()}
    verdict, reason = overall(list(found.values()))
    return MultiOutcomeReport(verdict, reason, found, [v.summary for v in found.values()])


def compare_outcomes(baseline: DataFrame, candidate: DataFrame, frame: DataFrame, outcomes: dict[str, OutcomeSpec], **options) -> tuple[list[dict], dict[str, ScoreComparison]]:
    """Compare versions on each outcome; immature values count as missing. ``frame`` has the key, outcomes and masks."""
    rows, made = [], {}
    for name, spec in outcomes.items():
        value = F.when(F.col(spec.mature), F.col(spec.column)) if spec.mature else F.col(spec.column)
        found = compare_scores(baseline, candidate, frame.withColumn("_outcome_", value), outcome="_outcome_", **options)
        counts = frame.agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col(spec.mature)) if spec.mature else F.count(F.lit(1))).alias("m")).first()
        made[name] = found
        rows.append({"outcome": name, "importance": spec.importance, "outcome_type": spec.outcome_type, "window": spec.window, "mature_rows": counts["m"], "immature_rows": counts["n"] - counts["m"], "evaluation_rows": found.metrics["n"], "metric": found.performance["metric"], "candidate_minus_baseline": found.performance["candidate_minus_baseline"], "assessment": found.assessment})
    return rows, made
