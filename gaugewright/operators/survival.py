"""Survival validation under censoring: weighted concordance, time-dependent areas, Brier scores.

Weights are the inverse probability of not being censored, from the reference sample's product-limit
estimate. Conventions: at equal times, events come before censorings; the estimate is taken at the
event's own time; a censored row at an event's time outlives it. Concordance counts dominance in risk
and time; rows are compared bit by bit of their risk rank, so it takes one running total per bit instead of
all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.frame import numeric, require_columns
from gaugewright.functions.ranks import ONE_TASK, ratio, running
from gaugewright.session import materialize
from gaugewright.report.tables import markdown_document


@dataclass
class SurvivalValidation:
    assessed: bool
    reason: str | None = None
    ranking_summary: list[dict] = field(default_factory=list)
    ranking_by_horizon: list[dict] = field(default_factory=list)
    calibration_by_horizon: list[dict] = field(default_factory=list)
    metrics: dict = field(default_factory=dict)

    def tables(self) -> dict[str, list[dict]]:
        return {"ranking_summary": self.ranking_summary, "ranking_by_horizon": self.ranking_by_horizon, "calibration_by_horizon": self.calibration_by_horizon}

    def to_markdown(self, max_rows: int = 50) -> str:
        return markdown_document("Survival validation", {"assessed": self.assessed, "reason": self.reason, **self.metrics}, self.tables(), max_rows)


def risk_sets(df: DataFrame, duration: str = "time", event: str = "event") -> DataFrame:
    """``time``, ``n``, ``events``, ``censored`` and ``at_risk`` of each distinct duration."""
    counts = df.groupBy(F.col(duration).alias("time")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("events"))
    ranked = running(counts, "time")
    return ranked.select("time", "n", "events", (F.col("n") - F.col("events")).alias("censored"), (F.col("total") - F.col("below")).alias("at_risk"))


def censoring_curve(reference: DataFrame, at: DataFrame) -> DataFrame:
    """``time`` and ``g``: the probability of not being censored by then, at the times of ``at`` and those of the reference."""
    own = reference.groupBy("time").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("long")).alias("events"))
    asked = at.select("time", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("events")).distinct()
    counts = own.unionByName(asked).groupBy("time").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
    ranked = running(counts, "time")
    left = F.col("total") - F.col("below") - F.col("events")
    hazard = F.when(left > 0, (F.col("n") - F.col("events")) / left.cast("double")).otherwise(F.lit(0.0))
    logs = materialize(ranked.select("time", F.when(hazard < 1, F.ln(F.lit(1.0) - hazard)).otherwise(F.lit(0.0)).alias("n"), (hazard >= 1).cast("int").alias("end")), "survival-logs")
    summed = running(logs, "time", also=["end"])
    return summed.select("time", F.when(F.col("end_below") + F.col("end") > 0, F.lit(0.0)).otherwise(F.exp(F.col("below") + F.col("n"))).alias("g"))


def concordance(rows: DataFrame, tau: float, limit: int = ONE_TASK) -> dict:
    """Weighted concordance up to ``tau``. ``rows`` has ``risk``, ``time``, ``event`` (boolean) and ``g``."""
    risks = materialize(running(rows.groupBy("risk").agg(F.count(F.lit(1)).alias("n")), "risk", limit=limit).select("risk", "below", "total"), "survival-risks")
    times = running(rows.groupBy("time").agg(F.count(F.lit(1)).alias("n")), "time", limit=limit).select("time", (F.col("below") * 2).alias("early"))  # rows with an earlier time, twice
    levels = max(1, int(risks.agg(F.max("below")).first()[0] or 0).bit_length())
    counted = (F.col("event") & (F.col("time") < tau)).cast("long")
    cells = rows.join(risks.withColumnRenamed("below", "rank").select("risk", "rank"), "risk").groupBy("rank", "time", "event").agg(F.count(F.lit(1)).alias("m"), F.sum(counted).alias("c"), F.sum(F.when(counted > 0, 1.0 / (F.col("g") * F.col("g"))).otherwise(F.lit(0.0))).alias("w"))
    cells = materialize(cells.join(times, "time").withColumn("o", F.col("early") + (~F.col("event")).cast("long")), "survival-cells")

    def beyond(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Weight and number of pairs: counted rows times the ``n`` of their node with a later order."""
        per = nodes.groupBy(*keys, "o").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("w").alias("w"))
        later = F.col("total") - F.col("below") - F.col("n")
        return running(per, "o", keys, limit=limit).agg(F.coalesce(F.sum(F.col("w") * later), F.lit(0.0)).alias("w"), F.coalesce(F.sum(F.col("c") * later), F.lit(0)).alias("c"))

    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    split = cells.select("rank", "o", "m", "c", "w", level).withColumn("node", F.expr("shiftright(rank, level + 1)")).withColumn("high", F.expr("shiftright(rank, level) & 1") == 1)
    zero = F.lit(0)
    high = split.select("level", "node", "o", F.when(F.col("high"), zero).otherwise(F.col("m")).alias("n"), F.when(F.col("high"), F.col("c")).otherwise(zero).alias("c"), F.when(F.col("high"), F.col("w")).otherwise(F.lit(0.0)).alias("w"))
    right = beyond(high, ["level", "node"]).first()
    every = beyond(cells.select("o", F.col("m").alias("n"), "c", "w"), []).first()
    tied = beyond(cells.select("rank", "o", F.col("m").alias("n"), "c", "w"), ["rank"]).first()
    same = cells.where("event AND c > 0").groupBy("time").agg(F.sum("c").alias("k")).agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2), F.lit(0)).cast("long")).first()[0]
    value = (right["w"] + 0.5 * tied["w"]) / every["w"] if every["w"] else math.nan
    return {"concordance": value, "concordant_pairs": right["c"], "discordant_pairs": every["c"] - right["c"] - tied["c"], "tied_risk_pairs": tied["c"], "tied_time_pairs": same}


def dynamic_auc(rows: DataFrame, horizons: Sequence[float]) -> DataFrame:
    """``horizon``, ``cumulative_dynamic_auc``, ``cases`` and ``controls``: weighted cases by the horizon against rows beyond it."""
    h = F.explode(F.array(*[F.lit(float(x)) for x in horizons])).alias("horizon")
    case = F.col("event") & (F.col("time") <= F.col("horizon"))
    control = F.col("time") > F.col("horizon")
    per = rows.select("risk", "time", "event", "g", h).groupBy("horizon", "risk").agg(F.count_if(control).alias("n"), F.count_if(case).alias("k"), F.coalesce(F.sum(F.when(case, 1.0 / F.col("g"))), F.lit(0.0)).alias("w"))
    ranked = running(per, "risk", ["horizon"])
    area = F.sum(F.col("w") * (F.col("below") + F.col("n") / F.lit(2.0)))
    return ranked.groupBy("horizon").agg(ratio(area, F.sum("w") * F.sum("n")).alias("cumulative_dynamic_auc"), F.sum("k").alias("cases"), F.sum("n").alias("controls"))


def brier_terms(survival: Column, time: Column, event: Column, g: Column, g_at: float, horizon: float) -> Column:
    """A row's weighted squared error at a horizon."""
    return F.when((time <= horizon) & event, survival * survival / g).when(time > horizon, (F.lit(1.0) - survival) * (F.lit(1.0) - survival) / F.lit(g_at)).otherwise(F.lit(0.0))


def assess_survival_validation(
    df: DataFrame,
    *,
    risk: str,
    duration: str,
    event: str,
    horizons: Sequence[float],
    reference: DataFrame,
    reference_duration: str = "duration",
    reference_event: str = "event",
    survival_probabilities: Mapping[float, str] | None = None,
    risk_direction: str = "higher",
    min_sample_size: int = 100,
    min_events: int = 20,
) -> SurvivalValidation:
    """``reference`` gives the censoring distribution; ``survival_probabilities`` names a column for each horizon."""
    horizons = [float(h) for h in horizons]
    if not horizons or horizons != sorted(set(horizons)) or horizons[0] <= 0:
        raise ValueError("horizons must be positive and increasing")
    if risk_direction not in ("higher", "lower"):
        raise ValueError("risk_direction must be higher or lower")
    if survival_probabilities is not None and sorted(survival_probabilities) != horizons:
        raise ValueError("survival probabilities need a column for each horizon")
    columns = [survival_probabilities[h] for h in horizons] if survival_probabilities else []
    require_columns(df, [risk, duration, event, *columns])
    require_columns(reference, [reference_duration, reference_event], "reference")
    sign = 1 if risk_direction == "higher" else -1
    df = numeric(df, [risk, duration, *columns])
    rows = df.select((F.col(risk) * sign).alias("risk"), F.col(duration).alias("time"), F.col(event).cast("boolean").alias("event"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(columns)]).dropna(subset=["risk", "time", "event"])
    base = numeric(reference, [reference_duration]).select(F.col(reference_duration).alias("time"), F.col(reference_event).cast("boolean").alias("event")).dropna()
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("event").alias("events"), F.count_if(F.col("time") <= 0).alias("bad"), F.min("time").alias("low"), F.max("time").alias("high")).first()
    other = base.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("time") <= 0).alias("bad"), F.max("time").alias("high")).first()
    if facts["bad"] or other["bad"]:
        raise ValueError("durations must be positive")
    if facts["n"] < min_sample_size or other["n"] < min_sample_size:
        return SurvivalValidation(False, f"fewer than {min_sample_size} rows")
    if facts["events"] < min_events:
        return SurvivalValidation(False, f"fewer than {min_events} events")
    if horizons[-1] >= min(facts["high"], other["high"]):
        raise ValueError("the last horizon must lie before the end of follow-up of both samples")
    if horizons[0] < facts["low"]:
        raise ValueError("the first horizon lies before any follow-up")
    if columns:
        wrong = F.lit(False)
        for i in range(len(columns)):
            s = F.col(f"s{i}")
            wrong = wrong | s.isNull() | (s < 0) | (s > 1) | (F.lit(False) if i == 0 else s > F.col(f"s{i - 1}"))
        if rows.where(wrong).limit(1).count():
            raise ValueError("survival probabilities must be complete, within 0 and 1, and not rise with the horizon")

    marks = df.sparkSession.createDataFrame([(h,) for h in horizons], "time double")
    curve = materialize(censoring_curve(base, rows.select("time").unionByName(marks)), "survival-censoring")
    rows = materialize(rows.join(curve, "time"), "survival-rows")
    if rows.where(F.col("event") & (F.col("g") <= 0) & (F.col("time") <= horizons[-1])).limit(1).count():
        return SurvivalValidation(False, "the censoring distribution vanishes before an event")
    found = concordance(rows, horizons[-1])
    areas = {r["horizon"]: r for r in dynamic_auc(rows, horizons).collect()}  # a row per horizon
    for h in horizons:
        if not areas[h]["cases"] or not areas[h]["controls"]:
            raise ValueError(f"horizon {h:g} needs a case and a control")
    out = SurvivalValidation(True, None)
    pairs = {k: found[k] for k in ("concordant_pairs", "discordant_pairs", "tied_risk_pairs", "tied_time_pairs")}
    out.ranking_summary = [{"metric": "ipcw_concordance", "value": found["concordance"], "through_horizon": horizons[-1]} | pairs]
    out.ranking_by_horizon = [{"horizon": h, "cumulative_dynamic_auc": areas[h]["cumulative_dynamic_auc"], "cases": areas[h]["cases"], "controls": areas[h]["controls"]} for h in horizons]
    out.metrics = {"n": facts["n"], "events": facts["events"], "ipcw_concordance": found["concordance"]}
    if columns:
        g_at = {r["time"]: r["g"] for r in curve.join(F.broadcast(marks), "time").collect()}  # a row per horizon
        terms = [F.avg(brier_terms(F.col(f"s{i}"), F.col("time"), F.col("event"), F.col("g"), g_at[h], h)).alias(f"b{i}") for i, h in enumerate(horizons)]
        means = rows.agg(*terms, *[F.avg(F.lit(1.0) - F.col(f"s{i}")).alias(f"p{i}") for i in range(len(horizons))]).first()
        out.calibration_by_horizon = [{"horizon": h, "brier_score": means[f"b{i}"], "mean_predicted_event_probability": means[f"p{i}"]} for i, h in enumerate(horizons)]
    return out
