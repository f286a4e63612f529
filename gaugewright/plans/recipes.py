"""Business recipes: column contracts with a horizon, prepared by deduplication and alignment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame

from gaugewright.frame import require_columns
from gaugewright.operators.align import AlignmentResult, align_delayed_outcomes, latest_versions
from gaugewright.sources.adapters import TabularData


@dataclass
class RecipeResult:
    recipe: BusinessRecipe
    alignment: AlignmentResult
    duplicates_dropped: dict[str, int]

    def audit_inputs(self, *, include_censored: bool = False) -> dict:
        r = self.recipe
        return self.alignment.audit_inputs(r.indicators, score=r.score, segments=r.segment, period=r.period, include_censored=include_censored)


@dataclass(frozen=True)
class BusinessRecipe:
    name: str
    entity: str
    score_time: str
    period: str
    segment: str
    indicators: tuple[str, ...]
    score: str
    outcome: str
    outcome_time: str
    horizon: timedelta
    snapshots: str = "snapshots"
    outcomes: str = "outcomes"
    updated_at: str = "updated_at"

    def prepare(self, tables: TabularData | Mapping[str, DataFrame], *, as_of, horizon: timedelta | None = None, match: str = "first", order: str | None = None) -> RecipeResult:
        """Keep the latest version of each snapshot and outcome and align them. ``order``: a column that breaks ties of versions."""
        bundle = tables if isinstance(tables, TabularData) else TabularData(dict(tables))
        snapshots, outcomes = bundle.require(self.snapshots), bundle.require(self.outcomes)
        require_columns(snapshots, [self.entity, self.score_time, self.period, self.segment, *self.indicators, self.score], self.snapshots)
        require_columns(outcomes, [self.entity, self.outcome_time, self.outcome], self.outcomes)
        kept, dropped = {}, {}
        for name, table, keys in ((self.snapshots, snapshots, [self.entity, self.score_time]), (self.outcomes, outcomes, [self.entity, self.outcome_time])):
            updated = self.updated_at if self.updated_at in table.columns else None
            kept[name] = latest_versions(table, keys, updated, [order] if order and order in table.columns else [c for c in table.columns if c not in keys and c != updated])
            dropped[name] = table.count() - kept[name].count()
        result = align_delayed_outcomes(
            kept[self.snapshots], kept[self.outcomes], entity=self.entity, outcome=self.outcome, outcome_time=self.outcome_time, key=[self.entity, self.score_time], score_time=self.score_time, horizon=horizon or self.horizon, as_of=as_of, match=match
        )
        return RecipeResult(self, result, dropped)


# The column contracts.
RECIPES = {
    r.name: r
    for r in (
        BusinessRecipe("customer_health", "account_id", "snapshot_at", "snapshot_month", "plan_tier", ("logins_30d", "feature_depth", "support_tickets_30d", "nps", "payment_delay_days"), "health_score", "churned", "churned_at", timedelta(days=90)),
        BusinessRecipe("lead_quality", "lead_id", "scored_at", "snapshot_week", "lead_source", ("firmographic_fit", "engagement_score", "source_quality", "sales_activity_14d"), "lead_score", "converted", "converted_at", timedelta(days=30)),
        BusinessRecipe("account_risk", "account_id", "snapshot_at", "snapshot_month", "portfolio", ("utilization_rate", "days_past_due", "collateral_ratio", "covenant_breaches"), "risk_score", "defaulted", "defaulted_at", timedelta(days=180)),
    )
}


def list_business_recipes() -> list[str]:
    return sorted(RECIPES)


def get_business_recipe(name: str) -> BusinessRecipe:
    if name not in RECIPES:
        raise ValueError(f"no recipe {name!r}; there are {', '.join(list_business_recipes())}")
    return RECIPES[name]


def customer_health_recipe() -> BusinessRecipe:
    return RECIPES["customer_health"]


def lead_quality_recipe() -> BusinessRecipe:
    return RECIPES["lead_quality"]


def account_risk_recipe() -> BusinessRecipe:
    return RECIPES["account_risk"]
