"""Measurement invariance: a ladder of multi-group factor models fitted to group moments.

Spark makes the sufficient statistics (rows, means and covariances of each group); the maximum-likelihood fit
of a few dozen parameters runs on the driver with an analytic gradient.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from gaugewright.frame import numeric
from gaugewright.functions.moments import BlockMoments, grouped_moments
from gaugewright.functions.numeric import chi2_tail, minimise
from gaugewright.operators.constructs import check_constructs
from gaugewright.report.tables import markdown_document

LEVELS = ("configural", "metric", "scalar", "strict")
# What is equal across groups at each level.
CONSTRAINTS = {"configural": "same structure", "metric": "equal loadings", "scalar": "equal loadings and intercepts", "strict": "equal loadings, intercepts and residual variances"}


class FactorModel:
    """A simple-structure model with the first indicator of each construct as its marker."""

    def __init__(self, groups: Sequence[BlockMoments], constructs: Mapping[str, Sequence[str]], level: str):
        self.groups, self.level = list(groups), LEVELS.index(level)
        self.factors = [[groups[0].columns.index(c) for c in b] for b in constructs.values()]
        self.p, self.k, self.g = len(groups[0].columns), len(self.factors), len(groups)
        self.free = [(i, f) for f, block in enumerate(self.factors) for i in block[1:]]
        self.lower = [(i, j) for i in range(self.k) for j in range(i + 1)]
        self.at: dict[tuple[str, int], slice] = {}
        n = 0
        for name, size, shared_from in (("loading", len(self.free), 1), ("intercept", self.p, 2), ("residual", self.p, 3)):
            shared = self.level >= shared_from
            for g in range(self.g):
                if g and shared:
                    self.at[name, g] = self.at[name, 0]
                else:
                    self.at[name, g] = slice(n, n + size)
                    n += size
        for g in range(self.g):
            self.at["factor", g] = slice(n, n + len(self.lower))
            n += len(self.lower)
        for g in range(1, self.g if self.level >= 2 else 1):
            self.at["mean", g] = slice(n, n + self.k)
            n += self.k
        self.size = n

    def start(self) -> np.ndarray:
        x = np.zeros(self.size)
        shares = np.array([b.n for b in self.groups], dtype=float)
        shares /= shares.sum()
        pooled = sum(s * b.cov for s, b in zip(shares, self.groups, strict=True))
        for g, b in enumerate(self.groups):
            cov = b.cov if self.level == 0 else pooled
            x[self.at["loading", g]] = [self._slope(cov, i, self.factors[f]) for i, f in self.free]
            if not (g and self.level >= 2):
                x[self.at["intercept", g]] = b.mean
            x[self.at["residual", g]] = np.log(np.maximum(0.5 * np.diag(pooled if self.level >= 3 else b.cov), 1e-6))
            for v, (i, j) in enumerate(self.lower):
                if i == j:
                    marker = self.factors[i][0]
                    x[self.at["factor", g].start + v] = 0.5 * math.log(max(0.5 * b.cov[marker, marker], 1e-6))
        return x

    @staticmethod
    def _slope(cov: np.ndarray, i: int, block: Sequence[int]) -> float:
        """A first guess of a loading: from a third indicator if there is one."""
        marker = block[0]
        ratios = [cov[i, j] / cov[marker, j] for j in block if j not in (i, marker) and abs(cov[marker, j]) > 1e-9]
        guess = float(np.median(ratios)) if ratios else 1.0
        return guess if 0.05 < abs(guess) < 20 else 1.0

    def unpack(self, x: np.ndarray, g: int) -> tuple[np.ndarray, ...]:
        loading = np.zeros((self.p, self.k))
        for f, block in enumerate(self.factors):
            loading[block[0], f] = 1.0
        for v, (i, f) in zip(x[self.at["loading", g]], self.free, strict=True):
            loading[i, f] = v
        root = np.zeros((self.k, self.k))
        for v, (i, j) in zip(x[self.at["factor", g]], self.lower, strict=True):
            root[i, j] = math.exp(v) if i == j else v
        mean = x[self.at["mean", g]] if ("mean", g) in self.at else np.zeros(self.k)
        return loading, x[self.at["intercept", g]], np.exp(x[self.at["residual", g]]), root, mean

    def implied(self, x: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
        loading, intercept, residual, root, mean = self.unpack(x, g)
        return loading @ root @ root.T @ loading.T + np.diag(residual), intercept + loading @ mean

    def objective(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Half the weighted discrepancy, and its gradient."""
        value, grad = 0.0, np.zeros(self.size)
        if np.abs(x[np.isfinite(x)]).max(initial=0) > 1e6:
            return math.inf, grad
        for g, b in enumerate(self.groups):
            loading, intercept, residual, root, mean = self.unpack(x, g)
            factor = root @ root.T
            sigma = loading @ factor @ loading.T + np.diag(residual)
            try:
                chol = np.linalg.cholesky(sigma)
            except np.linalg.LinAlgError:
                return math.inf, grad
            inverse = np.linalg.inv(sigma)
            d = b.mean - intercept - loading @ mean
            value += 0.5 * b.n * (2 * np.log(np.diag(chol)).sum() + np.sum(inverse * b.cov) + d @ inverse @ d)
            q = 0.5 * b.n * (inverse - inverse @ (b.cov + np.outer(d, d)) @ inverse)
            to_mu = -b.n * inverse @ d
            to_loading = 2 * q @ loading @ factor + np.outer(to_mu, mean)
            to_root = 2 * (loading.T @ q @ loading) @ root
            grad[self.at["loading", g]] += [to_loading[i, f] for i, f in self.free]
            grad[self.at["intercept", g]] += to_mu
            grad[self.at["residual", g]] += np.diag(q) * residual
            grad[self.at["factor", g]] += [to_root[i, j] * (root[i, j] if i == j else 1.0) for i, j in self.lower]
            if ("mean", g) in self.at:
                grad[self.at["mean", g]] += loading.T @ to_mu
        return (value, grad) if math.isfinite(value) else (math.inf, grad)

    def fit(self, start: np.ndarray | None = None) -> dict:
        x, value, converged = minimise(self.objective, self.start() if start is None else start)
        total = sum(b.n for b in self.groups)
        saturated = sum(0.5 * b.n * (np.linalg.slogdet(b.cov)[1] + self.p) for b in self.groups)
        chi = max(0.0, 2 * (value - saturated))
        df = self.g * self.p * (self.p + 3) // 2 - self.size
        base = sum(b.n * (np.log(np.diag(b.cov)).sum() - np.linalg.slogdet(b.cov)[1]) for b in self.groups)
        base_df = self.g * self.p * (self.p - 1) / 2
        over = max(chi - df, 0.0)
        residuals = 0.0
        for g, b in enumerate(self.groups):
            sigma, _ = self.implied(x, g)
            s = np.sqrt(np.diag(b.cov))
            low = np.tril_indices(self.p)
            residuals += b.n / total * math.sqrt(float(np.mean((((b.cov - sigma) / np.outer(s, s))[low]) ** 2)))
        return {"x": x, "converged": converged, "chi_square": float(chi), "df": int(df), "cfi": float(1 - over / max(base - base_df, over, 1e-12)), "rmsea": math.sqrt(max((chi - df) / (df * total / self.g), 0.0)) if df > 0 else 0.0, "srmr": float(residuals)}


@dataclass(frozen=True)
class InvarianceLimits:
    min_cfi: float = 0.90
    max_rmsea: float = 0.08
    max_srmr: float = 0.08
    max_delta_cfi: float = 0.01
    max_delta_rmsea: float = 0.015
    max_delta_srmr_metric: float = 0.030
    max_delta_srmr_scalar: float = 0.010
    max_delta_srmr_strict: float = 0.010


@dataclass
class MeasurementInvariance:
    assessed: bool
    reason: str | None
    highest_supported: str | None
    levels: list[dict] = field(default_factory=list)
    parameters: list[dict] = field(default_factory=list)
    group_sizes: list[dict] = field(default_factory=list)

    def tables(self) -> dict[str, list[dict]]:
        return {"levels": self.levels, "parameters": self.parameters, "group_sizes": self.group_sizes}

    def to_markdown(self, max_rows: int = 50) -> str:
        return markdown_document("Measurement invariance", {"assessed": self.assessed, "reason": self.reason, "highest supported": self.highest_supported}, self.tables(), max_rows)


def invariance_of_moments(groups: Mapping[object, BlockMoments], constructs: Mapping[str, Sequence[str]], limits: InvarianceLimits | None = None) -> MeasurementInvariance:
    """The ladder from group moments; the first group's latent means are the reference."""
    t = limits or InvarianceLimits()
    names, blocks = list(groups), list(groups.values())
    for n, b in groups.items():
        if np.linalg.matrix_rank(b.cov) < len(b.columns):
            raise ValueError(f"the covariance matrix of {n} is singular")
    out = MeasurementInvariance(True, None, None, group_sizes=[{"segment": n, "n": b.n, "assessed": True} for n, b in groups.items()])
    before, met = None, True
    for level in LEVELS:
        model = FactorModel(blocks, constructs, level)
        fit = model.fit()
        row = {"level": level, "constraints": CONSTRAINTS[level], "converged": fit["converged"], "chi_square": fit["chi_square"], "df": fit["df"], "cfi": fit["cfi"], "rmsea": fit["rmsea"], "srmr": fit["srmr"]}
        if before is None:
            row |= dict.fromkeys(("delta_chi_square", "delta_df", "chi_square_p", "delta_cfi", "delta_rmsea", "delta_srmr"), math.nan)
            good = fit["cfi"] >= t.min_cfi and fit["rmsea"] <= t.max_rmsea and fit["srmr"] <= t.max_srmr
        else:
            more, steps = fit["chi_square"] - before["chi_square"], fit["df"] - before["df"]
            row |= {"delta_chi_square": more, "delta_df": steps, "chi_square_p": chi2_tail(more, steps), "delta_cfi": before["cfi"] - fit["cfi"], "delta_rmsea": fit["rmsea"] - before["rmsea"], "delta_srmr": fit["srmr"] - before["srmr"]}
            good = row["delta_cfi"] <= t.max_delta_cfi and row["delta_rmsea"] <= t.max_delta_rmsea and row["delta_srmr"] <= getattr(t, f"max_delta_srmr_{level}")
        supported = bool(met and good and fit["converged"])
        row |= {"prerequisite_met": met, "supported": supported, "interpretation": f"{CONSTRAINTS[level]}: {'supported' if supported else 'not supported' if met else 'the level before it is not supported'}"}
        out.levels.append(row)
        if supported:
            out.highest_supported = level
        for g, n in enumerate(names):
            loading, intercept, residual, _, mean = model.unpack(fit["x"], g)
            for f, (construct, block) in enumerate(zip(constructs, model.factors, strict=True)):
                out.parameters += [{"level": level, "segment": n, "construct": construct, "indicator": blocks[0].columns[i], "loading": float(loading[i, f]), "intercept": float(intercept[i]), "residual_variance": float(residual[i]), "latent_mean": float(mean[f])} for i in block]
        before, met = fit, supported
    return out


def assess_measurement_invariance(df: DataFrame, segments: str, constructs: Mapping[str, Sequence[str]], *, min_group_size: int = 100, reference=None, limits: InvarianceLimits | None = None) -> MeasurementInvariance:
    """Group moments by Spark, then the ladder. ``reference``: the group whose latent means are 0 (the first in order if not given)."""
    columns = check_constructs(constructs)
    groups = grouped_moments(numeric(df, columns), columns, segments)
    if len(groups) < 2:
        raise ValueError("at least two groups are needed")
    if reference is not None:
        groups = {reference: groups.pop(reference), **groups}
    if small := [n for n, b in groups.items() if b.n < min_group_size]:
        return MeasurementInvariance(False, f"fewer than {min_group_size} rows: {', '.join(map(str, small))}", None, group_sizes=[{"segment": n, "n": b.n, "minimum": min_group_size, "assessed": b.n >= min_group_size} for n, b in groups.items()])
    out = invariance_of_moments(groups, constructs, limits)
    out.group_sizes = [r | {"minimum": min_group_size} for r in out.group_sizes]
    return out
