"""Statuses, verdicts and check results."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame


class Status(str, Enum):
    PASS = "pass"
    WARN = "warn"
    FAIL = "fail"
    SKIP = "skip"

    @property
    def severity(self) -> int:
        return {"warn": 1, "fail": 2}.get(self.value, 0)


class Verdict(str, Enum):
    DECISION_GRADE = "decision_grade"
    DIRECTIONAL = "directional"
    NOT_VALIDATED = "not_validated"


def worst(statuses) -> Status:
    """The most severe status; PASS if there is none."""
    return max(statuses, key=lambda s: s.severity, default=Status.PASS)


@dataclass
class CheckResult:
    """``metrics`` are plain values; ``details`` is a lazy table."""

    name: str
    status: Status
    summary: str
    metrics: dict = field(default_factory=dict)
    details: DataFrame | None = None
    notes: list[str] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return self.status is Status.PASS
