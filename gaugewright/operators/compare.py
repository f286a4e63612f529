"""Comparison of two versions of a score on the entities that both have."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.config import Thresholds
from gaugewright.frame import check_unique, numeric, outcome_kind, require_columns
from gaugewright.functions.ranks import exact_quantiles, guarded_corr, midranks, quantile_bands, value_counts
from gaugewright.functions.resample import percentile_interval, weighted_auc, weighted_rank_correlations
from gaugewright.operators.actions import analyze_actions
from gaugewright.operators.downstream import lift_rows, validity_of
from gaugewright.operators.segments import segment_summary
from gaugewright.operators.stability import baseline_cuts, bin_index, psi_from_counts, psi_over_time
from gaugewright.session import materialize
from gaugewright.report.tables import markdown_document

DIFFERENCE = 1e-12


def assess(delta: float, low: float = math.nan, high: float = math.nan, *, sampled: bool = False) -> str:
    """improved, regressed or inconclusive; by the interval if there is one, else by the difference."""
    if sampled:
        return "improved" if low > 0 else "regressed" if high < 0 else "inconclusive"
    if math.isnan(delta) or abs(delta) <= DIFFERENCE:
        return "inconclusive"
    return "improved" if delta > 0 else "regressed"


def coverage(baseline: DataFrame, candidate: DataFrame, outcomes: DataFrame, key: Sequence[str], scores: tuple[str, str], outcome: str) -> DataFrame:
    """One row of nine counts over the entities of either version."""
    b = baseline.select(*key, F.col(scores[0]).alias("_b"), F.lit(True).alias("_in_b"))
    c = candidate.select(*key, F.col(scores[1]).alias("_c"), F.lit(True).alias("_in_c"))
    both = b.join(c, list(key), "full").join(outcomes.select(*key, F.col(outcome).alias("_y")), list(key), "left")
    here, there = F.col("_in_b").isNotNull(), F.col("_in_c").isNotNull()
    full = here & there & F.col("_b").isNotNull() & F.col("_c").isNotNull() & F.col("_y").isNotNull()
    return both.agg(
        F.count_if(here).alias("baseline_n"), F.count_if(there).alias("candidate_n"), F.count_if(here & there).alias("overlap_n"), F.count_if(here & ~there).alias("baseline_only"), F.count_if(there & ~here).alias("candidate_only"),
        F.count_if(here & there & F.col("_b").isNull()).alias("baseline_missing"), F.count_if(here & there & F.col("_c").isNull()).alias("candidate_missing"), F.count_if(here & there & F.col("_y").isNull()).alias("outcome_missing"), F.count_if(full).alias("complete_n"),
    )


def distributions(overlap: DataFrame, names: tuple[str, str]) -> DataFrame:
    """``version``, ``n``, ``missing_rate_in_overlap``, ``mean``, ``std``, ``min``, ``p10``, ``median``, ``p90``, ``max``. ``overlap`` has ``baseline`` and ``candidate``."""
    q = exact_quantiles(overlap, ["baseline", "candidate"], [0.1, 0.5, 0.9])
    out = []
    for column, name in zip(("baseline", "candidate"), names, strict=True):
        quantiles = [F.lit(x).cast("double").alias(n) for x, n in zip(q[column] or [None] * 3, ("p10", "median", "p90"), strict=True)]
        c = F.col(column)
        out.append(overlap.agg(F.lit(name).alias("version"), F.count(c).alias("n"), F.avg(c.isNull().cast("double")).alias("missing_rate_in_overlap"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *quantiles, F.max(c).alias("max")))
    return out[0].unionByName(out[1])


def ranked_pairs(pairs: DataFrame, polarities: tuple[int, int], n_bands: int) -> DataFrame:
    """``pairs`` (``baseline``, ``candidate``, ``y``, key) with oriented rank percentiles and bands (1 is the lowest oriented score)."""
    for column, polarity in zip(("baseline", "candidate"), polarities, strict=True):
        oriented_name = f"{column}_oriented"
        pairs = pairs.withColumn(oriented_name, F.col(column) * polarity)
        table = quantile_bands(midranks(pairs, oriented_name), n_bands).select(F.col(oriented_name).alias("_v"), F.col("midrank").alias(f"{column}_rank"), (F.col("midrank") / F.col("total")).alias(f"{column}_rank_percentile"), F.col("band").alias(f"{column}_band"))
        pairs = pairs.join(table, F.col(oriented_name) == F.col("_v")).drop("_v")
    return pairs


def migration(ranked: DataFrame) -> DataFrame:
    """``baseline_band``, ``candidate_band``, ``n`` and ``rate`` (within the baseline's band)."""
    counts = ranked.groupBy("baseline_band", "candidate_band").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("baseline_band").agg(F.sum("n").alias("_t"))
    return counts.join(totals, "baseline_band").select("baseline_band", "candidate_band", "n", (F.col("n") / F.col("_t")).alias("rate"))


def rank_movements(ranked: DataFrame, key: Sequence[str]) -> DataFrame:
    change = F.abs(F.col("candidate_rank_percentile") - F.col("baseline_rank_percentile"))
    return ranked.select(*key, F.col("baseline").alias("baseline_score"), F.col("candidate").alias("candidate_score"), "baseline_rank_percentile", "candidate_rank_percentile", change.alias("absolute_rank_change"), "baseline_band", "candidate_band")


@dataclass
class ScoreComparison:
    names: tuple[str, str]
    coverage: dict
    performance: dict
    dimensions: list[dict]
    metrics: dict
    tables: dict[str, DataFrame]
    notes: list[str] = field(default_factory=list)

    @property
    def assessment(self) -> str:
        return self.performance["assessment"]

    def to_markdown(self, max_rows: int = 50) -> str:
        return markdown_document("Score comparison", self.coverage | self.metrics, {"performance": [self.performance], "dimensions": self.dimensions, **self.tables}, max_rows)


def _bootstrap(ranked: DataFrame, kind: str, polarities: tuple[int, int], key: Sequence[str], samples: int, seed: int) -> list[float]:
    if kind == "binary":
        first, second = (weighted_auc(ranked, f"{c}_oriented", "y", key, samples, seed) for c in ("baseline", "candidate"))
        return [b - a for a, b in zip(first, second, strict=True)]
    found = weighted_rank_correlations(ranked, ["baseline_oriented", "candidate_oriented"], "y", key, samples, seed)
    return [b - a for a, b in found]


def compare_scores(
    baseline: DataFrame,
    candidate: DataFrame,
    outcomes: DataFrame,
    *,
    key: Sequence[str],
    baseline_score: str = "score",
    candidate_score: str = "score",
    outcome: str = "outcome",
    segments: str | None = None,
    period: str | None = None,
    baseline_name: str = "baseline",
    candidate_name: str = "candidate",
    n_bands: int = 10,
    n_bootstrap: int = 500,
    confidence_level: float = 0.95,
    random_state: int = 42,
    action_cutoffs: Sequence[float] = (),
    action_percentiles: Sequence[float] = (),
    action_top_n: Sequence[int] = (),
    thresholds: Thresholds | None = None,
) -> ScoreComparison:
    """Compare on the entities of both versions whose scores and outcome are present. Everything but the coverage derives from one written frame of the overlap."""
    if baseline_name == candidate_name:
        raise ValueError("the versions need different names")
    if not 0 < confidence_level < 1:
        raise ValueError("confidence_level must lie between 0 and 1")
    key = list(key)
    names = (baseline_name, candidate_name)
    for table in (baseline, candidate, outcomes):
        check_unique(table, key)
    baseline, candidate = numeric(baseline, [baseline_score]), numeric(candidate, [candidate_score])
    extras = [c for c in (segments, period) if c]
    require_columns(outcomes, [*key, outcome, *extras])
    covered = coverage(baseline, candidate, outcomes, key, (baseline_score, candidate_score), outcome).first().asDict()
    overlap = baseline.select(*key, F.col(baseline_score).alias("baseline")).join(candidate.select(*key, F.col(candidate_score).alias("candidate")), key).join(outcomes.select(*key, F.col(outcome).alias("_outcome"), *extras), key, "left")
    overlap = materialize(overlap, "compare-overlap")
    full = overlap.where("baseline IS NOT NULL AND candidate IS NOT NULL AND _outcome IS NOT NULL")
    kind = outcome_kind(full, "_outcome")
    if kind.n < 3 or kind.kind == "constant":
        raise ValueError("fewer than three complete pairs, or an outcome that doesn't vary")
    pairs = full.withColumn("y", kind.encoded(F.col("_outcome"))).drop("_outcome")
    spread = pairs.agg(*[(F.max(c) > F.min(c)).alias(c) for c in ("baseline", "candidate")]).first()
    if not (spread["baseline"] and spread["candidate"]):
        raise ValueError("a version's scores don't vary")
    valid = {c: validity_of(pairs.select(F.col(c).alias("score"), "y"), kind) for c in ("baseline", "candidate")}
    polarity = (valid["baseline"]["polarity"], valid["candidate"]["polarity"])
    ranked = materialize(ranked_pairs(pairs, polarity, n_bands), "compare-ranked")

    metric = "oriented_auc" if kind.kind == "binary" else "abs_spearman"
    value = {c: v["auc_oriented"] if kind.kind == "binary" else abs(v["spearman"]) for c, v in valid.items()}
    delta = value["candidate"] - value["baseline"]
    sampled = [x for x in (_bootstrap(ranked, kind.kind, polarity, key, n_bootstrap, random_state) if n_bootstrap else []) if math.isfinite(x)]
    low, high = percentile_interval(sampled, confidence_level)
    performance = {
        "metric": metric, baseline_name: value["baseline"], candidate_name: value["candidate"], "candidate_minus_baseline": delta, "ci_lower": low, "ci_upper": high, "confidence_level": confidence_level, "valid_bootstrap_samples": len(sampled),
        "method": "paired_bootstrap" if n_bootstrap else "descriptive_only", "assessment": assess(delta, low, high, sampled=bool(n_bootstrap)),
    }

    def dimension(name: str, first: float, second: float, sign: int, basis: str, how: str | None = None) -> dict:
        change = second - first
        return {"dimension": name, baseline_name: first, candidate_name: second, "candidate_minus_baseline": change, "assessment": how or assess(sign * change), "basis": basis}

    shape = distributions(overlap, names)
    missing = [r["missing_rate_in_overlap"] for r in shape.collect()]
    dimensions = [dimension("downstream_performance", value["baseline"], value["candidate"], 1, metric, performance["assessment"]), dimension("score_missing_rate", missing[0], missing[1], -1, "share of the overlap")]
    tables = {"distributions": shape, "migration": migration(ranked), "rank_movements": rank_movements(ranked, key).orderBy(F.desc("absolute_rank_change"), *key)}
    for c, name, p in zip(("baseline", "candidate"), names, polarity, strict=True):
        tables[f"lift_{name}"] = lift_rows(value_counts(pairs.select(F.col(c).alias("score"), "y"), "score", (), {"pos": F.col("y")}), n_bands, ascending=p < 0).orderBy("band")
    notes: list[str] = []
    if period:
        both = []
        tops = []
        for c, name in zip(("baseline", "candidate"), names, strict=True):
            t = psi_over_time(pairs, c, period)
            both.append(t.withColumn("version", F.lit(name)))
            tops.append(t.agg(F.max("psi")).first()[0])
        tables["stability"] = both[0].unionByName(both[1])
        if None not in tops:
            dimensions.append(dimension("max_period_psi", tops[0], tops[1], -1, "largest PSI against the first period"))
        else:
            notes.append("stability can't be compared: fewer than two periods")
    if segments:
        both, least = [], []
        for c, name in zip(("baseline", "candidate"), names, strict=True):
            t = segment_summary(pairs, c, segments, "y")
            both.append(t.withColumn("version", F.lit(name)))
            least.append(t.agg(F.min("validity")).first()[0])
        tables["segments"] = both[0].unionByName(both[1])
        if None not in least:
            dimensions.append(dimension("minimum_segment_validity", least[0], least[1], 1, "smallest validity of a segment"))
    if action_cutoffs or action_percentiles or action_top_n:
        tables["actions"] = compare_actions(pairs, key, names, polarity, action_cutoffs, action_percentiles, action_top_n, thresholds)
    movement = ranked.agg(
        F.count(F.lit(1)).alias("n"), guarded_corr(F.col("baseline"), F.col("candidate")).alias("raw_pearson"), guarded_corr(F.col("baseline_rank") * polarity[0], F.col("candidate_rank") * polarity[1]).alias("raw_spearman"), guarded_corr(F.col("baseline_rank"), F.col("candidate_rank")).alias("oriented_spearman"),
        F.avg(F.abs(F.col("candidate_rank_percentile") - F.col("baseline_rank_percentile"))).alias("mean_absolute_rank_change"), F.max(F.abs(F.col("candidate_rank_percentile") - F.col("baseline_rank_percentile"))).alias("max_absolute_rank_change"),
    ).first().asDict()
    moved = exact_quantiles(rank_movements(ranked, key), ["absolute_rank_change"], [0.5])["absolute_rank_change"][0]
    cuts = baseline_cuts(pairs, ["baseline"])["baseline"]
    counts = [{r["bin"]: r["count"] for r in pairs.groupBy(bin_index(F.col(c), cuts).alias("bin")).count().collect()} for c in ("baseline", "candidate")]
    metrics = movement | {"median_absolute_rank_change": moved, "outcome_type": kind.kind, "baseline_polarity": polarity[0], "candidate_polarity": polarity[1], "cross_version_psi": psi_from_counts(*[[c.get(k, 0) for k in range(len(cuts) + 1)] for c in counts])}
    return ScoreComparison(names, covered, performance, dimensions, metrics, tables, notes)


def compare_actions(pairs: DataFrame, key: Sequence[str], names: tuple[str, str], polarity: tuple[int, int], cutoffs, percentiles, top_n, thresholds: Thresholds | None = None) -> DataFrame:
    """Per policy: how the two versions' selections differ: counts, ``changed_rate`` and ``jaccard`` (1 if nothing is selected), and how good each is: precision and recall, or the selected rows' mean outcome."""
    made = [analyze_actions(pairs, c, "y", key=key, cutoffs=cutoffs, percentiles=percentiles, top_n=top_n, polarity=p, thresholds=thresholds) for c, p in zip(("baseline", "candidate"), polarity, strict=True)]
    ids = [p.policy_id for p in made[0].policies]
    a, b = (m.assignments.select(*key, *[F.col(i).alias(f"{s}_{i}") for i in ids]) for m, s in zip(made, "ab", strict=True))
    joined = a.join(b, list(key))
    both = [F.count_if(F.col(f"a_{i}") & F.col(f"b_{i}")).alias(f"both_{i}") for i in ids]
    counts = joined.agg(F.count(F.lit(1)).alias("n"), *both).first()
    rows = []
    measures = [m for m in ("precision", "recall", "selected_outcome_mean") if m in made[0].rows[0]]
    known = lambda v: None if math.isnan(v) else float(v)
    for i, first, second in zip(ids, made[0].rows, made[1].rows, strict=True):
        x, y, z = first["selected_n"], second["selected_n"], counts[f"both_{i}"]
        rows.append((i, first["strategy"], first["parameter"], first["score_cutoff"], second["score_cutoff"], x, y, z, x - z, y - z, x + y - 2 * z, (x + y - 2 * z) / counts["n"], z / (x + y - z) if x + y - z else 1.0, *(known(r[m]) for m in measures for r in (first, second))))
    schema = "policy_id string, strategy string, parameter double, baseline_cutoff double, candidate_cutoff double, baseline_selected_n long, candidate_selected_n long, both_selected_n long, baseline_only_n long, candidate_only_n long, changed_n long, changed_rate double, jaccard double"
    schema += "".join(f", {side}_{m} double" for m in measures for side in ("baseline", "candidate"))
    return pairs.sparkSession.createDataFrame(rows, schema)
