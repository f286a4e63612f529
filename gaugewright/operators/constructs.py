"""Convergent and discriminant validity of constructs."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from gaugewright.frame import numeric
from gaugewright.functions.moments import BlockMoments, block_moments
from gaugewright.functions.resample import percentile_interval, weighted_blocks
from gaugewright.report.tables import markdown_document


def one_factor(corr: np.ndarray) -> np.ndarray:
    """Loadings on the leading component; the largest one is positive."""
    values, vectors = np.linalg.eigh(corr)
    loadings = vectors[:, -1] * math.sqrt(max(values[-1], 0.0))
    return loadings * (1 if loadings[np.argmax(np.abs(loadings))] > 0 else -1)


def average_variance_extracted(corr: np.ndarray) -> float:
    return float(np.mean(one_factor(corr) ** 2))


def htmt(corr: np.ndarray, a: Sequence[int], b: Sequence[int]) -> float:
    """Mean absolute correlation between two blocks over the geometric mean of those within."""
    inside = [np.mean([abs(corr[i, j]) for k, i in enumerate(block) for j in block[k + 1 :]]) for block in (a, b)]
    scale = math.sqrt(inside[0] * inside[1])
    return float(np.mean(np.abs(corr[np.ix_(list(a), list(b))])) / scale) if scale > 0 else math.nan


@dataclass
class ConstructValidity:
    assessed: bool
    reason: str | None = None
    n: int = 0
    ave: list[dict] = field(default_factory=list)
    htmt: list[dict] = field(default_factory=list)
    polarity: list[dict] = field(default_factory=list)
    loadings: list[dict] = field(default_factory=list)

    def tables(self) -> dict[str, list[dict]]:
        return {"ave": self.ave, "htmt": self.htmt, "polarity": self.polarity, "loadings": self.loadings}

    def to_markdown(self, max_rows: int = 50) -> str:
        return markdown_document("Construct validity", {"assessed": self.assessed, "reason": self.reason, "rows": self.n}, self.tables(), max_rows)


def check_constructs(constructs: Mapping[str, Sequence[str]]) -> list[str]:
    """All indicators, in order; each construct needs two and none may be in two."""
    if not constructs:
        raise ValueError("no constructs are given")
    columns = [c for block in constructs.values() for c in block]
    if any(len(set(b)) < 2 for b in constructs.values()):
        raise ValueError("each construct needs at least two indicators")
    if len(set(columns)) < len(columns):
        raise ValueError("an indicator belongs to one construct only")
    return columns


def assess_construct_validity(
    df: DataFrame, constructs: Mapping[str, Sequence[str]], *, key: Sequence[str] = (), ave_threshold: float = 0.5, htmt_threshold: float = 0.85, min_within_correlation: float = 0.0, min_sample_size: int = 100, n_bootstrap: int = 500, confidence_level: float = 0.95, random_state: int = 0
) -> ConstructValidity:
    """AVE per construct and HTMT per pair, from one correlation matrix; intervals need ``key``. Favourable flags need all raw correlations within a construct to be at least ``min_within_correlation``."""
    columns = check_constructs(constructs)
    df = numeric(df, columns)
    block = block_moments(df, columns)
    if block.n < min_sample_size:
        return ConstructValidity(False, f"only {block.n} complete rows", block.n)
    if constant := [c for c, s in zip(columns, block.std(), strict=True) if s == 0]:
        return ConstructValidity(False, f"constant: {', '.join(constant)}", block.n)
    place = {n: [columns.index(c) for c in b] for n, b in constructs.items()}
    pairs = [(a, b) for i, a in enumerate(constructs) for b in list(constructs)[i + 1 :]]

    def estimates(corr: np.ndarray) -> tuple[dict, dict]:
        return {n: average_variance_extracted(corr[np.ix_(p, p)]) for n, p in place.items()}, {(a, b): htmt(corr, place[a], place[b]) for a, b in pairs}

    corr = block.corr()
    ave, ratio = estimates(corr)
    runs = []
    if n_bootstrap and key:
        for n, mean, cov in weighted_blocks(df, columns, key, n_bootstrap, random_state, block.mean):
            again = BlockMoments(columns, int(n), mean, cov)
            if (again.std() > 0).all():
                runs.append(estimates(again.corr()))
    out = ConstructValidity(True, None, block.n)
    fair: dict[str, bool] = {}
    for name, p in place.items():
        rows = [{"construct": name, "indicator_a": columns[i], "indicator_b": columns[j], "correlation": float(corr[i, j]), "minimum": min_within_correlation, "aligned": bool(corr[i, j] >= min_within_correlation)} for k, i in enumerate(p) for j in p[k + 1 :]]
        out.polarity += rows
        fair[name] = all(r["aligned"] for r in rows)
        out.loadings += [{"construct": name, "indicator": columns[i], "loading": float(v)} for i, v in zip(p, one_factor(corr[np.ix_(p, p)]), strict=True)]
        low, high = percentile_interval([a[name] for a, _ in runs], confidence_level)
        meets = ave[name] >= ave_threshold
        out.ave.append({"construct": name, "indicators": len(p), "ave": ave[name], "ci_lower": low, "ci_upper": high, "threshold": ave_threshold, "estimate_meets_threshold": meets, "polarity_aligned": fair[name], "meets_threshold": meets and fair[name], "valid_bootstrap_samples": len(runs)})
    for a, b in pairs:
        low, high = percentile_interval([r[(a, b)] for _, r in runs], confidence_level)
        below = bool(ratio[(a, b)] < htmt_threshold)
        out.htmt.append({"construct_a": a, "construct_b": b, "htmt": ratio[(a, b)], "ci_lower": low, "ci_upper": high, "threshold": htmt_threshold, "estimate_below_threshold": below, "polarity_aligned": fair[a] and fair[b], "below_threshold": below and fair[a] and fair[b], "valid_bootstrap_samples": len(runs)})
    return out
