"""The audit: all checks of a score, a verdict, and its reports."""

from __future__ import annotations

import html
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.config import Thresholds
from gaugewright.frame import check_unique, numeric, require_columns, trusted
from gaugewright.functions.ranks import nth_smallest
from gaugewright.governance import create_governance_manifest, to_json
from gaugewright.operators.construct import SCORE, CompositeScore
from gaugewright.operators.downstream import check_downstream
from gaugewright.operators.indicators import check_indicators
from gaugewright.operators.leakage import check_leakage
from gaugewright.operators.segments import check_segments
from gaugewright.operators.stability import check_stability
from gaugewright.report.tables import html_page, html_table, markdown_table
from gaugewright.results import CheckResult, Status, Verdict


def grade(checks: Sequence[CheckResult], supplied: set[str]) -> tuple[Verdict, str]:
    """The verdict and its reason. ``supplied``: the checks whose inputs were given."""
    by = {c.name: c for c in checks}
    failed = [c.name for c in checks if c.status is Status.FAIL]
    if failed:
        return Verdict.NOT_VALIDATED, f"failed: {', '.join(failed)}"
    downstream = by.get("downstream")
    if downstream is None or downstream.status is Status.SKIP:
        return Verdict.NOT_VALIDATED, "downstream validity isn't established"
    warned = [c.name for c in checks if c.status is Status.WARN]
    skipped = [c.name for c in checks if c.status is Status.SKIP and c.name in supplied]
    if downstream.status is Status.PASS and not warned and not skipped:
        return Verdict.DECISION_GRADE, "all checks pass"
    parts = [f"warnings: {', '.join(warned)}"] * bool(warned) + [f"not assessed: {', '.join(skipped)}"] * bool(skipped)
    return Verdict.DIRECTIONAL, "; ".join(parts) or "with reservations"


@dataclass
class AuditReport:
    checks: list[CheckResult]
    verdict: Verdict
    reason: str
    manifest: dict = field(default_factory=dict)

    def __getitem__(self, name: str) -> CheckResult:
        return next(c for c in self.checks if c.name == name)

    def summary(self) -> list[dict]:
        return [{"check": c.name, "status": c.status.value, "summary": c.summary} for c in self.checks]

    def to_json(self) -> str:
        return to_json({"verdict": self.verdict, "reason": self.reason, "checks": [{"name": c.name, "status": c.status, "summary": c.summary, "metrics": c.metrics, "notes": c.notes} for c in self.checks], "manifest": self.manifest})

    def to_markdown(self, max_rows: int = 50) -> str:
        parts = ["# Score audit", f"**Verdict: {self.verdict.value}** ({self.reason})", markdown_table(self.summary())]
        for c in self.checks:
            parts.append(f"## {c.name}: {c.status.value}\n\n{c.summary}")
            parts += [f"- {n}" for n in c.notes]
            if c.details is not None:
                parts.append(markdown_table(c.details, max_rows))
        return "\n\n".join(parts) + "\n"

    def to_html(self, max_detail_rows: int | None = 100, title: str = "Score audit") -> str:
        if max_detail_rows is not None and (isinstance(max_detail_rows, bool) or not isinstance(max_detail_rows, int) or max_detail_rows < 1):
            raise ValueError("max_detail_rows must be a whole number of at least 1, or None")
        say = lambda c: f'<p class="{c.status.value}"><b>{c.status.value}</b> {html.escape(c.summary)}</p>'
        checks = "".join(f"<h3>{html.escape(c.name)}</h3>{say(c)}{html_table(c.details, max_detail_rows) if c.details is not None else ''}" for c in self.checks)
        context = {k: v for k, v in self.manifest.get("governance", {}).items() if v}
        actions = "".join(f"<li>{html.escape(c.name)}: {html.escape(c.summary)}</li>" for c in self.checks if c.status in (Status.FAIL, Status.WARN))
        scope = [{"item": k, "value": str(v)} for k, v in self.manifest.get("row_counts", {}).items()]
        meta = [{"item": k, "value": str(self.manifest.get(k, ""))} for k in ("generated_at", "schema_version", "configuration_fingerprint")]
        return html_page(title, [("Scope", html_table(scope)), ("Metadata", html_table(meta)), ("Governance", html_table([{"item": k, "value": str(v)} for k, v in context.items()])), ("Summary", f"<p><b>{self.verdict.value}</b>: {html.escape(self.reason)}</p>{html_table(self.summary())}"), ("Checks", checks), ("Actions", f"<ul>{actions}</ul>" if actions else "<p>none</p>")])

    def write_html(self, path: str, **how) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_html(**how))


class ScoreAudit:
    """Audit of ``score`` (made of the indicators with equal weights if not given) by columns of one table."""

    def __init__(self, df: DataFrame, indicators: Sequence[str], score: str | None = None, outcome: str | None = None, segments: str | None = None, period: str | None = None, thresholds: Thresholds | None = None, key: Sequence[str] = (), governance=None, governance_strict: bool = False):
        self.thresholds = thresholds or Thresholds()
        require_columns(df, [*indicators, *[c for c in (score, outcome, segments, period) if c], *key])
        if key:
            check_unique(df, key)
        self.df, self.indicators, self.key = numeric(df, [*indicators, *([score] if score else [])]), list(indicators), list(key)
        self.score, self.outcome, self.segments, self.period = score, outcome, segments, period
        self.governance, self.strict = governance, governance_strict

    def _frame(self) -> tuple[DataFrame, str, list[CheckResult]]:
        t, df, score = self.thresholds, self.df, self.score
        if score is None:
            score = SCORE
            df = CompositeScore().fit_transform(df, self.indicators, score)
        roles = dict.fromkeys([*self.key, *self.indicators, score, *[c for c in (self.outcome, self.segments, self.period) if c]])
        df = df.select(*roles)
        n = df.count()
        checks = []
        if t.max_audit_rows is not None and n > t.max_audit_rows:
            if not self.key:
                raise ValueError("taking a part of the rows needs a key")
            spread = F.struct(F.xxhash64(*[F.col(k).cast("string") for k in self.key], F.lit(42)).alias("h"), *self.key)
            last = nth_smallest(df.select(spread.alias("_spread")), "_spread", t.max_audit_rows)
            df = df.where(spread <= F.struct(*[F.lit(v).alias(k) for k, v in zip(["h", *self.key], last, strict=True)]))
            checks.append(CheckResult("sample_size", Status.PASS, f"{t.max_audit_rows} of {n} rows are audited", {"rows": n, "audited_rows": t.max_audit_rows}))
        elif n < t.min_audit_rows:
            checks.append(CheckResult("sample_size", Status.WARN, f"only {n} rows", {"rows": n, "audited_rows": n}))
        return df, score, checks

    def run(self) -> AuditReport:
        t = self.thresholds
        df, score, first = self._frame()
        df = trusted(df.persist(), [*self.indicators, score])
        try:
            checks = [*first, check_indicators(df, self.indicators, score, t)]
            skip = lambda name, why: CheckResult(name, Status.SKIP, f"no {why} is given")
            checks.append(check_stability(df, score, self.period, thresholds=t) if self.period else skip("stability", "period"))
            checks.append(check_downstream(df, score, self.outcome, t) if self.outcome else skip("downstream", "outcome"))
            checks.append(check_leakage(df, self.indicators, self.outcome, t) if self.outcome else skip("leakage", "outcome"))
            checks.append(check_segments(df, score, self.segments, self.outcome, t) if self.segments else skip("segments", "segment"))
            n = df.count()
        finally:
            df.unpersist()
        supplied = {n for n, c in (("stability", self.period), ("downstream", self.outcome), ("leakage", self.outcome), ("segments", self.segments)) if c}
        verdict, reason = grade(checks, supplied)
        roles = {"indicators": self.indicators, "score": score, "outcome": self.outcome, "segments": self.segments, "period": self.period}
        manifest = create_governance_manifest(self.governance, row_counts={"audited": n}, checks=checks, thresholds=t, configuration=roles, strict=self.strict)
        return AuditReport(checks, verdict, reason, manifest)
