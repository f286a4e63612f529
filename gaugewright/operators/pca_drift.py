"""Drift of principal-component loadings against a stored fit."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from gaugewright.frame import numeric
from gaugewright.functions.moments import BlockMoments, block_moments
from gaugewright.functions.resample import percentile_interval, weighted_blocks
from gaugewright.operators.construct import PCAScore, first_component
from gaugewright.report.tables import markdown_document


@dataclass
class PCADrift:
    assessed: bool
    reason: str | None = None
    n: int = 0
    cosine: float = math.nan
    max_loading_delta: float = math.nan
    explained_baseline: float = math.nan
    explained_current: float = math.nan
    explained_change: float = math.nan
    intervals: dict = field(default_factory=dict)
    loadings: list[dict] = field(default_factory=list)

    def tables(self) -> dict[str, list[dict]]:
        return {"loadings": self.loadings}

    def to_markdown(self, max_rows: int = 50) -> str:
        facts = {"assessed": self.assessed, "reason": self.reason, "rows": self.n, "cosine": self.cosine, "largest change": self.max_loading_delta, "change of explained share": self.explained_change}
        return markdown_document("Loading drift", facts, self.tables(), max_rows)


def aligned(current: np.ndarray, baseline: np.ndarray) -> tuple[np.ndarray, float]:
    """The current loadings, turned to the baseline's side, and their cosine with it."""
    dot = float(current @ baseline)
    turned = -current if dot < 0 else current
    return turned, abs(dot) / float(np.linalg.norm(current) * np.linalg.norm(baseline))


def assess_pca_loading_drift(baseline: PCAScore, df: DataFrame, *, key: Sequence[str] = (), min_sample_size: int = 100, n_bootstrap: int = 500, confidence_level: float = 0.95, random_state: int = 0) -> PCADrift:
    """Fit the same indicators again and compare. Intervals need ``key``, which identifies rows."""
    state = baseline._fitted()
    columns, old = state["indicators"], np.array(state["loadings"])
    df = numeric(df, columns)
    block = block_moments(df, columns)
    if block.n < min_sample_size:
        return PCADrift(False, f"only {block.n} complete rows", block.n)
    constant = [c for c, s in zip(columns, block.std(), strict=True) if s == 0]
    if constant:
        return PCADrift(False, f"constant: {', '.join(constant)}", block.n)
    now, explained = first_component(block.corr())
    now, cosine = aligned(now, old)
    change = now - old
    out = PCADrift(True, None, block.n, float(cosine), float(np.abs(change).max()), state["explained_variance_ratio"], float(explained), float(explained - state["explained_variance_ratio"]))
    runs: list[tuple[np.ndarray, float, float]] = []
    if n_bootstrap and key:
        for n, mean, cov in weighted_blocks(df, columns, key, n_bootstrap, random_state, block.mean):
            again = BlockMoments(columns, int(n), mean, cov)
            if (again.std() > 0).all():
                v, share = first_component(again.corr())
                v, c = aligned(v, old)
                runs.append((v, c, share - state["explained_variance_ratio"]))
    interval = lambda values: percentile_interval(values, confidence_level)
    out.intervals = {"cosine": interval([c for _, c, _ in runs]), "max_loading_delta": interval([float(np.abs(v - old).max()) for v, _, _ in runs]), "explained_change": interval([e for _, _, e in runs]), "valid_bootstrap_samples": len(runs)}
    for i, c in enumerate(columns):
        low, high = interval([v[i] for v, _, _ in runs])
        out.loadings.append({"indicator": c, "baseline_loading": float(old[i]), "current_loading": float(now[i]), "loading_delta": float(change[i]), "abs_loading_delta": float(abs(change[i])), "current_loading_ci_lower": low, "current_loading_ci_upper": high, "loading_delta_ci_lower": float(low - old[i]), "loading_delta_ci_upper": float(high - old[i])})
    return out
