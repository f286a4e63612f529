"""Thresholds and monitoring limits, with their permitted ranges."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, replace

#: Parts of a column name that suggest it is known only with the outcome.
LEAK_NAME_PATTERNS = ("churn", "renew", "cancel", "terminat", "outcome", "target", "label", "won", "lost", "converted", "closed")
LEAK_PATTERNS_VARIABLE = "GAUGEWRIGHT_LEAK_PATTERNS"


def ensure_count(value: object, name: str, least: int = 1) -> int:
    """``value`` as int; booleans and values under ``least`` are refused."""
    try:
        whole = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        raise TypeError(f"{name} must be a whole number") from None
    if isinstance(value, bool) or whole != value:
        raise TypeError(f"{name} must be a whole number")
    if whole < least:
        raise ValueError(f"{name} must be at least {least}")
    return whole


def leak_patterns() -> tuple[str, ...]:
    extra = os.environ.get(LEAK_PATTERNS_VARIABLE, "")
    return LEAK_NAME_PATTERNS + tuple(p.strip() for p in extra.split(",") if p.strip())


def _limit(default: float, low: float = 0.0, high: float = float("inf"), kind: type = float):
    return field(default=default, metadata={"low": low, "high": high, "kind": kind})


class _Ranged:
    def __post_init__(self) -> None:
        for f in fields(self):  # type: ignore[arg-type]
            value, meta = getattr(self, f.name), f.metadata
            if not meta or value is None:
                continue
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise TypeError(f"{f.name} must be a number")
            if meta["kind"] is int and int(value) != value:
                raise TypeError(f"{f.name} must be a whole number")
            if not meta["low"] <= value <= meta["high"]:
                raise ValueError(f"{f.name} must lie between {meta['low']} and {meta['high']}")
        self._ordered()

    def _ordered(self) -> None:
        """Checks between fields."""

    def to_dict(self) -> dict:
        return asdict(self)  # type: ignore[call-overload]

    def with_values(self, **values):
        """A copy with some values replaced; unknown names are refused."""
        known = {f.name for f in fields(self)}  # type: ignore[arg-type]
        if unknown := sorted(set(values) - known):
            raise ValueError(f"unknown names: {', '.join(unknown)}")
        return replace(self, **values)  # type: ignore[type-var]


@dataclass(frozen=True)
class Thresholds(_Ranged):
    min_audit_rows: int = _limit(100, 1, kind=int)
    #: None audits all rows.
    max_audit_rows: int | None = field(default=None, metadata={"low": 1, "high": float("inf"), "kind": int})
    max_missing_rate: float = _limit(0.20, 0, 1)
    min_item_rest_corr: float = _limit(0.10, 0, 1)
    min_cronbach_alpha: float = _limit(0.70, 0, 1)
    max_pairwise_corr: float = _limit(0.90, 0, 1)
    max_vif: float = _limit(10.0, 1)
    max_score_indicator_corr: float = _limit(0.95, 0, 1)
    psi_stable: float = _limit(0.10)
    psi_unstable: float = _limit(0.25)
    min_period_rows: int = _limit(50, 1, kind=int)
    min_auc_strong: float = _limit(0.65, 0.5, 1)
    min_auc_weak: float = _limit(0.55, 0.5, 1)
    min_corr_strong: float = _limit(0.30, 0, 1)
    min_corr_weak: float = _limit(0.10, 0, 1)
    min_class_count: int = _limit(10, 1, kind=int)
    max_segment_smd: float = _limit(0.50)
    max_segment_auc_gap: float = _limit(0.10, 0, 1)
    max_segment_corr_gap: float = _limit(0.20, 0, 2)
    min_segment_size: int = _limit(30, 1, kind=int)
    leak_auc: float = _limit(0.90, 0.5, 1)
    leak_corr: float = _limit(0.80, 0, 1)
    min_leak_rows: int = _limit(10, 3, kind=int)
    leak_name_patterns: tuple[str, ...] = field(default_factory=leak_patterns)

    def _ordered(self) -> None:
        for low, high in (("psi_stable", "psi_unstable"), ("min_auc_weak", "min_auc_strong"), ("min_corr_weak", "min_corr_strong")):
            if getattr(self, low) > getattr(self, high):
                raise ValueError(f"{low} must not exceed {high}")


@dataclass(frozen=True)
class MonitoringLimits(_Ranged):
    missing_rate_warning_delta: float = _limit(0.05, 0, 1)
    volume_warning_low: float = _limit(0.50)
    volume_warning_high: float = _limit(2.0)
    volume_failure_low: float = _limit(0.10)
    volume_failure_high: float = _limit(10.0)
    performance_drop_warning: float = _limit(0.05)
    performance_drop_failure: float = _limit(0.10)
    pca_cosine_warning: float = _limit(0.98, 0, 1)
    pca_cosine_failure: float = _limit(0.95, 0, 1)
    pca_loading_delta_warning: float = _limit(0.10)
    pca_loading_delta_failure: float = _limit(0.20)
    pca_explained_variance_drop_warning: float = _limit(0.05, 0, 1)
    pca_explained_variance_drop_failure: float = _limit(0.10, 0, 1)
    pca_min_complete_rows: int = _limit(100, 3, kind=int)
    pca_bootstrap_samples: int = _limit(200, 1, kind=int)

    def _ordered(self) -> None:
        if not self.volume_failure_low <= self.volume_warning_low <= self.volume_warning_high <= self.volume_failure_high:
            raise ValueError("the volume limits must be in order")
        for warning, failure in (("performance_drop_warning", "performance_drop_failure"), ("pca_cosine_failure", "pca_cosine_warning"), ("pca_loading_delta_warning", "pca_loading_delta_failure"), ("pca_explained_variance_drop_warning", "pca_explained_variance_drop_failure")):
            if getattr(self, warning) > getattr(self, failure):
                raise ValueError(f"{warning} must not exceed {failure}")
