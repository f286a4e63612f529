"""Monitoring of later batches against a stored baseline."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.config import MonitoringLimits, Thresholds
from gaugewright.frame import numeric
from gaugewright.governance import create_governance_manifest, plain, to_json, utc
from gaugewright.operators.construct import SCORE, PCAScore, _Constructor
from gaugewright.operators.downstream import grade_effect, paired, validity_of
from gaugewright.operators.pca_drift import assess_pca_loading_drift
from gaugewright.operators.stability import baseline_cuts, bin_index, psi_from_counts
from gaugewright.report.tables import html_page, html_table, markdown_table
from gaugewright.results import Status

ARTIFACT_VERSION = "1.0"


class State(str, Enum):
    INFORMATIONAL = "informational"
    WARNING = "warning"
    FAILURE = "failure"
    NOT_ASSESSABLE = "not_assessable"


# Precedence and exit codes.
PRECEDENCE = (State.FAILURE, State.WARNING, State.NOT_ASSESSABLE, State.INFORMATIONAL)
EXIT_CODES = {State.INFORMATIONAL: 0, State.WARNING: 1, State.FAILURE: 2, State.NOT_ASSESSABLE: 3}


class ArtifactVersionError(ValueError):
    """The artifact has a version that isn't known."""


def state_counts(df: DataFrame, columns: Sequence[str], cuts: dict[str, list[float]]) -> dict[str, dict]:
    """Of each column: rows, missing values and counts by bin, all in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.when(F.col(c).isNotNull(), bin_index(F.col(c), cuts.get(c, []))).alias("bin")) for c in columns])).alias("x")
    out: dict[str, dict] = {c: {"rows": 0, "missing": 0, "bins": [0] * (len(cuts.get(c, [])) + 1)} for c in columns}
    for r in df.select(cells).groupBy("x.c", "x.bin").count().collect():  # a row per column and bin
        out[r["c"]]["rows"] += r["count"]
        if r["bin"] is None:
            out[r["c"]]["missing"] += r["count"]
        else:
            out[r["c"]]["bins"][r["bin"]] = r["count"]
    return out


@dataclass
class MonitoringBaseline:
    """Aggregates of the baseline batch: no rows."""

    content: dict

    def __getattr__(self, name: str):
        try:
            return self.content[name]
        except KeyError:
            raise AttributeError(name) from None

    def to_json(self) -> str:
        return to_json(self.content, indent=2)

    @classmethod
    def from_json(cls, text: str) -> MonitoringBaseline:
        raw = json.loads(text)
        if not isinstance(raw, dict) or raw.get("artifact_version") != ARTIFACT_VERSION:
            raise ArtifactVersionError(f"the artifact's version isn't {ARTIFACT_VERSION}")
        if missing := sorted({"score_id", "score_version", "indicators", "cuts", "counts", "rows"} - set(raw)):
            raise ValueError(f"the artifact lacks {', '.join(missing)}")
        return cls(raw)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    @classmethod
    def load(cls, path: str) -> MonitoringBaseline:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())

    def constructor(self) -> _Constructor | None:
        return _Constructor.from_json(json.dumps(self.content["constructor"])) if self.content.get("constructor") else None


def create_monitoring_baseline(
    df: DataFrame, indicators: Sequence[str], *, score_id: str, score_version: str, score: str | None = None, constructor: _Constructor | None = None, outcome: str | None = None, thresholds: Thresholds | None = None, limits: MonitoringLimits | None = None, bins: int = 10, created_at: datetime | None = None, metadata=None, governance=None, governance_strict: bool = False
) -> MonitoringBaseline:
    if score is None and constructor is None:
        raise ValueError("give a score or a constructor")
    df = numeric(df, indicators)
    if score is None:
        score = SCORE
        df = constructor.transform(df, score)
    df = numeric(df, [score])
    columns = list(dict.fromkeys([*indicators, score]))
    cuts = baseline_cuts(df, columns, bins)
    if not cuts[score]:
        raise ValueError("the score has no values")
    counts = state_counts(df, columns, cuts)
    t, m = thresholds or Thresholds(), limits or MonitoringLimits()
    performance = None
    if outcome:
        pairs, kind = paired(df, score, outcome)
        performance = plain(validity_of(pairs, kind))
    if constructor is not None and constructor.params.get("scaling") == "rank":
        raise ValueError("a rank-scaled score has no bounded state; monitor it by its score column")
    manifest = create_governance_manifest(governance, row_counts={"baseline": counts[score]["rows"]}, thresholds=t, configuration={"bins": bins, "indicators": list(indicators)}, generated_at=created_at, strict=governance_strict)
    rename = lambda d: {c: d[c] for c in indicators} | {"score": d[score]}
    return MonitoringBaseline(
        {
            "artifact_version": ARTIFACT_VERSION, "score_id": score_id, "score_version": score_version, "created_at": utc(created_at), "indicators": list(indicators), "rows": counts[score]["rows"], "bins": bins, "cuts": rename(cuts), "counts": rename(counts), "outcome_performance": performance,
            "constructor": json.loads(constructor.to_json()) if constructor else None, "thresholds": plain(t.to_dict()), "limits": plain(m.to_dict()), "metadata": plain(metadata or {}), "manifest": manifest,
        }
    )


@dataclass
class MonitoringCheck:
    name: str
    state: State
    summary: str
    metrics: dict = field(default_factory=dict)
    details: list[dict] = field(default_factory=list)


@dataclass
class MonitoringResult:
    batch_id: str
    observed_at: str
    checks: list[MonitoringCheck]
    manifest: dict = field(default_factory=dict)

    @property
    def state(self) -> State:
        return next(s for s in PRECEDENCE if s is State.INFORMATIONAL or any(c.state is s for c in self.checks))

    @property
    def exit_code(self) -> int:
        return EXIT_CODES[self.state]

    def __getitem__(self, name: str) -> MonitoringCheck:
        return next(c for c in self.checks if c.name == name)

    def alerts(self) -> list[MonitoringCheck]:
        return [c for c in self.checks if c.state in (State.WARNING, State.FAILURE)]

    def to_json(self) -> str:
        return to_json({"batch_id": self.batch_id, "observed_at": self.observed_at, "state": self.state, "exit_code": self.exit_code, "checks": self.checks, "manifest": self.manifest}, indent=2)

    def _rows(self) -> list[dict]:
        return [{"check": c.name, "state": c.state.value, "summary": c.summary} for c in self.checks]

    def to_markdown(self, max_rows: int = 50) -> str:
        parts = [f"# Monitoring of {self.batch_id}", f"**{self.state.value}**", markdown_table(self._rows())]
        parts += [f"## {c.name}\n\n{markdown_table(c.details, max_rows)}" for c in self.checks if c.details]
        return "\n\n".join(parts) + "\n"

    def to_html(self) -> str:
        return html_page(f"Monitoring of {self.batch_id}", [("Summary", html_table(self._rows())), *[(c.name, html_table(c.details)) for c in self.checks if c.details]])


def graded(value: float, warning: float, failure: float) -> State:
    """By limits that mark values at or above them; NaN can't be assessed."""
    if value is None or math.isnan(value):
        return State.NOT_ASSESSABLE
    return State.FAILURE if value >= failure else State.WARNING if value >= warning else State.INFORMATIONAL


def _worst(states: Sequence[State]) -> State:
    return next((s for s in PRECEDENCE if s in states), State.INFORMATIONAL)


def preflight(baseline: MonitoringBaseline, df: DataFrame, score: str | None, score_version: str | None) -> str | None:
    """Why the batch can't be monitored at all, if so."""
    if score_version is not None and score_version != baseline.score_version:
        return f"the batch has version {score_version}, the baseline {baseline.score_version}"
    if not isinstance(df, DataFrame):
        return "the batch is no table"
    if missing := [c for c in [*baseline.indicators, *([score] if score else [])] if c not in df.columns]:
        return f"the batch lacks {', '.join(missing)}"
    if score is None and baseline.constructor() is None:
        return "the batch has no score and the baseline no constructor"
    try:
        numeric(df, [*baseline.indicators, *([score] if score else [])])
    except (TypeError, ValueError) as why:
        return str(why)
    return None if df.limit(1).count() else "the batch has no rows"


def monitor_batch(baseline: MonitoringBaseline, df: DataFrame, *, score: str | None = None, outcome: str | None = None, score_version: str | None = None, batch_id: str = "batch", observed_at: datetime | None = None, key: Sequence[str] = (), known_columns: Sequence[str] = ()) -> MonitoringResult:
    """All checks of a batch; one pass counts rows, missing values and bins of the score and every indicator."""
    now = utc(observed_at)
    if why := preflight(baseline, df, score, score_version):
        return MonitoringResult(batch_id, now, [MonitoringCheck("schema", State.FAILURE, why)])
    t, m = Thresholds().with_values(**{k: tuple(v) if isinstance(v, list) else v for k, v in baseline.thresholds.items()}), MonitoringLimits().with_values(**baseline.limits)
    indicators = baseline.indicators
    extra = sorted(set(df.columns) - {*indicators, *known_columns, *key, *[c for c in (score, outcome) if c]})
    checks = [MonitoringCheck("schema", State.WARNING if extra else State.INFORMATIONAL, f"unknown columns: {', '.join(extra)}" if extra else "the columns match")]
    df = numeric(df, indicators, check=False)
    if score is None:
        df, score = baseline.constructor().transform(df, SCORE), SCORE
    df = numeric(df, [score], check=False)
    found = state_counts(df, list(dict.fromkeys([*indicators, score])), {**{c: baseline.cuts[c] for c in indicators}, score: baseline.cuts["score"]})
    rows = found[score]["rows"]

    share = rows / baseline.rows if baseline.rows else math.nan
    state = State.FAILURE if share < m.volume_failure_low or share > m.volume_failure_high else State.WARNING if share < m.volume_warning_low or share > m.volume_warning_high else State.INFORMATIONAL
    checks.append(MonitoringCheck("volume", state, f"{rows} rows, {share:.2f} of the baseline", {"rows": rows, "ratio": share}))

    drift = psi_from_counts(baseline.counts["score"]["bins"], found[score]["bins"])
    checks.append(MonitoringCheck("score_drift", graded(drift, t.psi_stable, t.psi_unstable), f"PSI {drift:.3f}", {"psi": drift}))

    details = []
    for c in indicators:
        value = psi_from_counts(baseline.counts[c]["bins"], found[c]["bins"]) if baseline.cuts[c] else math.nan
        details.append({"indicator": c, "psi": value, "status": graded(value, t.psi_stable, t.psi_unstable).value})
    checks.append(MonitoringCheck("indicator_drift", _worst([State(d["status"]) for d in details]), f"largest PSI {max((d['psi'] for d in details if not math.isnan(d['psi'])), default=math.nan):.3f}", {}, details))

    details = []
    for c in indicators:
        old = baseline.counts[c]["missing"] / max(baseline.counts[c]["rows"], 1)
        new = found[c]["missing"] / max(found[c]["rows"], 1)
        state = State.FAILURE if new > t.max_missing_rate else State.WARNING if new - old >= m.missing_rate_warning_delta else State.INFORMATIONAL
        details.append({"indicator": c, "baseline_missing_rate": old, "batch_missing_rate": new, "delta": new - old, "status": state.value})
    checks.append(MonitoringCheck("missingness", _worst([State(d["status"]) for d in details]), f"largest rate {max((d['batch_missing_rate'] for d in details), default=0.0):.3f}", {}, details))

    fitted = baseline.constructor()
    if isinstance(fitted, PCAScore):
        checks.append(pca_check(fitted, df, key, m))
    checks.append(performance_check(baseline, df, score, outcome, t, m))
    manifest = create_governance_manifest(baseline.manifest.get("governance"), row_counts={"batch": rows}, thresholds=t, configuration={"score_id": baseline.score_id, "score_version": baseline.score_version, "batch_id": batch_id}, generated_at=observed_at)
    return MonitoringResult(batch_id, now, checks, manifest)


def pca_check(fitted: PCAScore, df: DataFrame, key: Sequence[str], m: MonitoringLimits) -> MonitoringCheck:
    found = assess_pca_loading_drift(fitted, df, key=key, min_sample_size=m.pca_min_complete_rows, n_bootstrap=m.pca_bootstrap_samples if key else 0)
    if not found.assessed:
        return MonitoringCheck("pca_loading_drift", State.NOT_ASSESSABLE, found.reason or "")
    drop = -found.explained_change
    states = [
        State.FAILURE if found.cosine < m.pca_cosine_failure else State.WARNING if found.cosine < m.pca_cosine_warning else State.INFORMATIONAL,
        graded(found.max_loading_delta, m.pca_loading_delta_warning, m.pca_loading_delta_failure),
        graded(drop, m.pca_explained_variance_drop_warning, m.pca_explained_variance_drop_failure),
    ]
    return MonitoringCheck("pca_loading_drift", _worst(states), f"cosine {found.cosine:.3f}, largest change {found.max_loading_delta:.3f}", {"cosine": found.cosine, "max_loading_delta": found.max_loading_delta, "explained_variance_drop": drop}, found.loadings)


def performance_check(baseline: MonitoringBaseline, df: DataFrame, score: str, outcome: str | None, t: Thresholds, m: MonitoringLimits) -> MonitoringCheck:
    name = "outcome_performance"
    if outcome is None or outcome not in df.columns:
        return MonitoringCheck(name, State.NOT_ASSESSABLE, "no outcome is given")
    pairs, kind = paired(df, score, outcome)
    found = validity_of(pairs, kind)
    if found["n"] < 3 or kind.kind == "constant" or (kind.kind == "binary" and min(found["n_pos"], found["n_neg"]) < t.min_class_count):
        return MonitoringCheck(name, State.NOT_ASSESSABLE, "too few rows, or an outcome that hardly varies", plain(found))
    status, effect, label = grade_effect(found, t)
    state = {Status.FAIL: State.FAILURE, Status.WARN: State.WARNING}.get(status, State.INFORMATIONAL)
    drop = math.nan
    before = baseline.outcome_performance
    if before and before.get("outcome_type") == kind.kind:
        old = before["auc_oriented"] if kind.kind == "binary" else abs(before["spearman"])
        drop = old - effect
        change = graded(drop, m.performance_drop_warning, m.performance_drop_failure)
        state = _worst([state, change])
    return MonitoringCheck(name, state, f"{label} {effect:.3f}", found | {"effect": effect, "drop": drop})
