"""Point-in-time alignment of observations with later outcomes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from gaugewright.frame import check_unique, require_columns
from gaugewright.functions.ranks import exact_quantiles

ADDED = ("aligned_outcome", "aligned_outcome_time", "outcome_lag", "outcome_status")


@dataclass
class AlignmentResult:
    """``data``: the observations with the added columns. ``diagnostics`` is a table of one row, made on demand."""

    data: DataFrame
    diagnose: Callable[[], DataFrame]
    as_of: object

    @cached_property
    def diagnostics(self) -> DataFrame:
        return self.diagnose()

    def audit_inputs(self, indicators: Sequence[str], *, score: str | None = None, segments: str | None = None, period: str | None = None, include_censored: bool = False) -> dict:
        """Arguments for an audit; censored rows are left out unless asked for."""
        roles = [c for c in (score, segments, period) if c]
        require_columns(self.data, [*indicators, *roles])
        rows = self.data if include_censored else self.data.where("outcome_status <> 'censored'")
        return {"df": rows, "indicators": list(indicators), "score": score, "outcome": "aligned_outcome", "segments": segments, "period": period}


def _same_kind(df: DataFrame, columns: Sequence[str], other: DataFrame, more: Sequence[str]) -> None:
    kinds = {type(t.schema[c].dataType) for t, cs in ((df, columns), (other, more)) for c in cs}
    if not kinds <= {TimestampType, TimestampNTZType}:
        raise TypeError("times must be timestamps")
    if len(kinds) > 1:
        raise TypeError("times with and without a zone can't be mixed")


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def align_delayed_outcomes(
    observations: DataFrame,
    outcomes: DataFrame,
    *,
    entity: str,
    outcome: str,
    outcome_time: str,
    key: Sequence[str],
    score_time: str | None = None,
    observation_window_end: str | None = None,
    outcome_window_start: str | None = None,
    outcome_window_end: str | None = None,
    horizon: timedelta | None = None,
    as_of=None,
    match: str = "first",
    no_outcome_value=0,
    outcome_order: Sequence[str] = (),
) -> AlignmentResult:
    """Give each observation the first or last outcome of its entity in the window (start, end].

    ``key`` identifies an observation; ``outcome_order`` breaks ties of outcome times. Without an outcome, an
    observation is ``unmatched`` if its window had closed by ``as_of`` (the latest outcome time if not
    given), else ``censored``. The join is on the entity and on slices of time as long as the longest window, with the
    window as a further condition, so an entity with a long history isn't paired with all of it.
    """
    if match not in ("first", "last", "error"):
        raise ValueError("match must be first, last or error")
    if (score_time is None) == (observation_window_end is None):
        raise ValueError("give score_time or observation_window_end")
    if (outcome_window_end is None) == (horizon is None):
        raise ValueError("give outcome_window_end or horizon")
    if horizon is not None and horizon <= timedelta(0):
        raise ValueError("the horizon must be positive")
    end_of_observation = score_time or observation_window_end
    times = [c for c in (end_of_observation, outcome_window_start, outcome_window_end) if c]
    require_columns(observations, [entity, *key, *times], "observations")
    require_columns(outcomes, [entity, outcome, outcome_time, *outcome_order], "outcomes")
    if taken := sorted(set(ADDED) & set(observations.columns)):
        raise ValueError(f"columns of these names are added: {', '.join(taken)}")
    _same_kind(observations, times, outcomes, [outcome_time])
    check_unique(observations, key)

    start = F.col(outcome_window_start or end_of_observation)
    end = F.col(outcome_window_end) if outcome_window_end else F.col(end_of_observation) + F.lit(horizon)
    windows = observations.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(entity).alias("_entity"), start.alias("_start"), end.alias("_end"))
    facts = windows.agg(
        F.count_if(F.col("_start").isNull() | F.col("_end").isNull() | F.col("_entity").isNull()).alias("missing"),
        F.count_if(F.col("_end") <= F.col("_start")).alias("backward"),
        F.max("_end").alias("latest"),
        F.max(_seconds(F.col("_end")) - _seconds(F.col("_start"))).alias("longest"),
    ).first()
    if facts["missing"]:
        raise ValueError(f"{facts['missing']} observations lack entity or times")
    if facts["backward"]:
        raise ValueError(f"{facts['backward']} outcome windows end before they start")

    order = [F.col(c) for c in outcome_order] or [F.col(outcome)]
    valid = F.col(entity).isNotNull() & F.col(outcome).isNotNull() & F.col(outcome_time).isNotNull()
    seen = outcomes.agg(F.count(F.lit(1)).alias("n"), F.count_if(~valid).alias("invalid"), F.max(F.when(valid, F.col(outcome_time))).alias("latest")).first()
    if as_of is None:
        as_of = seen["latest"] if seen["latest"] is not None else facts["latest"]
    known = F.lit(as_of).cast(outcomes.schema[outcome_time].dataType)
    future = outcomes.where(valid & (F.col(outcome_time) > known)).count()
    events = outcomes.where(valid & (F.col(outcome_time) <= known)).select(F.col(entity).alias("_entity"), F.col(outcome_time).alias("_time"), F.col(outcome).alias("_value"), F.struct(*order).alias("_order"))

    slice_ = F.lit(max(float(facts["longest"] or 1.0), 1.0))
    left = windows.withColumn("_slice", F.explode(F.sequence(F.floor(_seconds(F.col("_start")) / slice_), F.floor(_seconds(F.col("_end")) / slice_))))
    right = events.withColumn("_slice", F.floor(_seconds(F.col("_time")) / slice_))
    candidates = left.join(right, ["_entity", "_slice"]).where((F.col("_time") > F.col("_start")) & (F.col("_time") <= F.col("_end")))
    pick = F.max if match == "last" else F.min
    names = [f"_k{i}" for i in range(len(key))]
    picked = candidates.groupBy(*names).agg(pick(F.struct("_time", "_order", "_value")).alias("_best"), F.count(F.lit(1)).alias("_many"))
    if match == "error" and picked.where("_many > 1").limit(1).count():
        raise ValueError("an observation has more than one outcome in its window")

    joined = observations.join(picked, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)], "left")
    closed = end <= known
    status = F.when(F.col("_best").isNotNull(), "matched").when(closed, "unmatched").otherwise("censored")
    value = F.when(F.col("_best").isNotNull(), F.col("_best._value")).when(closed, F.lit(no_outcome_value))
    complete = joined.select(*observations.columns, value.alias("aligned_outcome"), F.col("_best._time").alias("aligned_outcome_time"), (F.col("_best._time") - F.col(end_of_observation)).alias("outcome_lag"), status.alias("outcome_status"), F.coalesce("_many", F.lit(0)).alias("_many"))
    count = lambda s: F.count_if(F.col("outcome_status") == s)
    counters = [
        F.count(F.lit(1)).alias("input_observations"), F.lit(seen["n"]).cast("long").alias("input_outcomes"), F.count(F.lit(1)).alias("aligned_rows"), count("matched").alias("matched_rows"), count("unmatched").alias("unmatched_rows"), count("censored").alias("censored_rows"),
        F.lit(seen["invalid"]).cast("long").alias("invalid_outcome_rows"), F.lit(future).cast("long").alias("future_outcome_rows"), F.count_if(F.col("_many") > 1).alias("observations_with_multiple_candidates"),
        F.coalesce(F.sum(F.greatest(F.col("_many") - 1, F.lit(0))), F.lit(0)).alias("duplicate_candidate_rows"), F.min("outcome_lag").alias("lag_min"),
    ]

    def diagnose() -> DataFrame:
        lags = complete.where("outcome_lag IS NOT NULL").select((F.unix_micros(F.col("aligned_outcome_time").cast("timestamp")) - F.unix_micros(F.col(end_of_observation).cast("timestamp"))).alias("lag"))
        middle = exact_quantiles(lags, ["lag"], [0.5])["lag"]
        seconds = F.lit(None) if not middle else F.lit(round(middle[0])).cast("decimal(24,0)") / F.lit(1_000_000)
        median = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
        return complete.agg(*counters, F.any_value(median).alias("lag_median"), F.max("outcome_lag").alias("lag_max"))

    return AlignmentResult(complete.drop("_many"), diagnose, as_of)


def latest_versions(df: DataFrame, keys: Sequence[str], updated_at: str | None, order: Sequence[str]) -> DataFrame:
    """Of rows with equal ``keys`` the latest: a missing ``updated_at`` counts as latest, then ``order`` decides."""
    require_columns(df, [*keys, *order, *([updated_at] if updated_at else [])])
    rank = [F.col(updated_at).isNull(), F.col(updated_at)] if updated_at else []
    latest = F.max_by(F.struct(*df.columns), F.struct(*[c.alias(f"_{i}") for i, c in enumerate([*rank, *[F.col(o) for o in order]])]))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(latest.alias("_row")).select("_row.*")
