"""Governance manifests: context, redaction of secrets, fingerprints."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from datetime import date, datetime, timedelta, timezone
from enum import Enum
from typing import ClassVar

SCHEMA_VERSION = "1.0"
REDACTED = "[redacted]"
# Parts of a name that mark its value as secret.
SECRET_MARKS = ("access_key", "api_key", "apikey", "auth", "connection_string", "credential", "passwd", "password", "private_key", "secret", "token")


def utc(moment: datetime | None = None) -> str:
    moment = moment or datetime.now(timezone.utc)
    if moment.tzinfo is None:
        raise ValueError("the time needs a zone")
    return moment.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def plain(value: object) -> object:
    """A value of JSON kinds; NaN and infinities become null."""
    if isinstance(value, Enum):
        return plain(value.value)
    if value is None or isinstance(value, (bool, str, int)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, datetime):
        return utc(value) if value.tzinfo else value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, timedelta):
        return value.total_seconds()
    if is_dataclass(value) and not isinstance(value, type):
        return plain(asdict(value))
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        found = [plain(v) for v in value]
        return sorted(found, key=str) if isinstance(value, (set, frozenset)) else found
    if hasattr(value, "item"):
        return plain(value.item())
    return str(value)


def to_json(value: object, **how) -> str:
    return json.dumps(plain(value), sort_keys=True, allow_nan=False, **how)


def redact_secrets(value: object) -> object:
    """``value`` with what stands under secret names replaced, at any depth."""
    if isinstance(value, Mapping):
        secret = lambda k: any(m in str(k).lower().replace("-", "_") for m in SECRET_MARKS)
        return {k: REDACTED if secret(k) else redact_secrets(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [redact_secrets(v) for v in value]
    return value


def configuration_fingerprint(configuration: object) -> str:
    """SHA-256 of the redacted configuration's canonical JSON."""
    return hashlib.sha256(to_json(redact_secrets(plain(configuration)), separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class GovernanceContext:
    score_id: str | None = None
    score_version: str | None = None
    owner: str | None = None
    intended_use: str | None = None
    decision: str | None = None
    population: str | None = None
    data_source: str | None = None
    outcome_definition: str | None = None
    review_date: str | None = None
    approver: str | None = None
    known_limitations: tuple[str, ...] = ()
    prohibited_uses: tuple[str, ...] = ()
    references: tuple[str, ...] = ()
    metadata: Mapping = field(default_factory=dict)

    # without defaults among the fields above, strict manifests need these
    REQUIRED: ClassVar[tuple[str, ...]] = ("score_id", "score_version", "owner", "intended_use", "decision", "population", "data_source", "outcome_definition", "review_date", "approver")

    def missing(self) -> list[str]:
        return [n for n in self.REQUIRED if not getattr(self, n)]

    @classmethod
    def of(cls, value: GovernanceContext | Mapping | None) -> GovernanceContext:
        if value is None or isinstance(value, GovernanceContext):
            return value or cls()
        if unknown := sorted(set(value) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown fields: {', '.join(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})


def create_governance_manifest(governance=None, *, row_counts=None, checks=(), thresholds=None, configuration=None, generated_at: datetime | None = None, strict: bool = False) -> dict:
    """What was checked, with what settings, in what context. ``strict`` refuses a context with gaps."""
    context = GovernanceContext.of(governance)
    if strict and context.missing():
        raise ValueError(f"the context lacks {', '.join(context.missing())}")
    configuration = redact_secrets(plain(configuration or {}))
    return {
        "schema_version": SCHEMA_VERSION, "generated_at": utc(generated_at), "governance": redact_secrets(plain(context)), "missing_fields": context.missing(), "row_counts": plain(row_counts or {}),
        "checks": [{"name": c.name, "status": c.status.value, "summary": c.summary, "metrics": plain(c.metrics)} for c in checks], "thresholds": plain(thresholds.to_dict() if thresholds else {}), "configuration": configuration, "configuration_fingerprint": configuration_fingerprint(configuration),
    }
