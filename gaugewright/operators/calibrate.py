"""Probability calibration: fitting, and assessment with intervals."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.frame import Outcome
from gaugewright.functions.numeric import isotonic, logit, newton_logistic, normal_quantile, shift_of, sigmoid
from gaugewright.functions.ranks import midrank, quantile_bands, running, value_counts
from gaugewright.functions.resample import percentile_interval, weighted_sums
from gaugewright.operators.downstream import paired
from gaugewright.report.tables import markdown_document
from gaugewright.session import materialize, parallelism

VERSION = 1
#: Distinct scores that a fit takes to the driver. With more, Spark makes the same sums and pools; results are the same.
CELLS = 200_000
#: Logits of probabilities at the edges.
EDGE = 1e-12


@dataclass(frozen=True)
class CalibrationModel:
    """Turns scores into probabilities: a logistic curve, or steps of an isotonic fit that hold from each threshold on."""

    method: str
    intercept: float = 0.0
    slope: float = 0.0
    thresholds: tuple[float, ...] = ()
    values: tuple[float, ...] = ()
    n: int = 0

    def apply(self, score: Column) -> Column:
        score = score.cast("double")
        if self.method == "logistic":
            eta = F.lit(self.intercept) + F.lit(self.slope) * score
            return F.when(score.isNotNull(), F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)))
        steps = F.array(*[F.lit(t) for t in self.thresholds])
        at = F.greatest(F.size(F.filter(steps, lambda t: t <= score)), F.lit(1))
        return F.when(score.isNotNull(), F.element_at(F.array(*[F.lit(v) for v in self.values]), at))

    def to_json(self) -> str:
        return json.dumps({"version": VERSION, "method": self.method, "intercept": self.intercept, "slope": self.slope, "thresholds": list(self.thresholds), "values": list(self.values), "n": self.n}, sort_keys=True, allow_nan=False)

    @classmethod
    def from_json(cls, text: str) -> CalibrationModel:
        raw = json.loads(text)
        if raw.pop("version", None) != VERSION:
            raise ValueError("not a calibration model of a known version")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


class Grouped:
    """Rows and positives of each distinct score, on the driver or, where there are many, in a written table."""

    def __init__(self, pairs: DataFrame, *, logits: bool = False):
        self.table = materialize(value_counts(pairs, "score", (), {"pos": F.col("y")}), "calibration-counts")
        q = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), F.col("score")))
        self.table = self.table.withColumn("x", F.ln(q / (F.lit(1.0) - q)) if logits else F.col("score"))
        facts = self.table.agg(F.count(F.lit(1)), F.sum("n"), F.sum("pos"), F.sum(F.col("n") * F.col("x"))).first()
        self.distinct, self.total, self.hits = facts[0], float(facts[1] or 0), float(facts[2] or 0)
        self.centre = facts[3] / self.total if self.total else 0.0
        self.local: tuple[np.ndarray, ...] | None = None
        if self.distinct <= CELLS:
            rows = self.table.select("x", "n", "pos").orderBy("score").collect()
            self.local = tuple(np.array([r[k] for r in rows], dtype=float) for k in ("x", "n", "pos"))

    def sums(self, intercept: float, slope: float) -> tuple[float, float, float, float, float, float]:
        """At a logistic curve over x - centre: loss, sums of residuals and of residuals times x, and of weights times 1, x and x squared."""
        if self.local is not None:
            x, n, pos = self.local
            z = x - self.centre
            eta = intercept + slope * z
            p = sigmoid(eta)
            w = np.maximum(n * p * (1 - p), 1e-300)
            return tuple(float(v.sum()) for v in (n * np.logaddexp(0, eta) - pos * eta, pos - n * p, (pos - n * p) * z, w, w * z, w * z * z))
        z, n, pos = F.col("x") - F.lit(self.centre), F.col("n"), F.col("pos")
        eta = F.lit(intercept) + F.lit(slope) * z
        p = (F.tanh(eta / 2) + 1) / 2
        w = F.greatest(n * p * (F.lit(1.0) - p), F.lit(1e-300))
        softplus = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
        return tuple(self.table.agg(*[F.sum(v) for v in (n * softplus - pos * eta, pos - n * p, (pos - n * p) * z, w, w * z, w * z * z)]).first())

    def logistic(self) -> tuple[float, float]:
        """Intercept and slope; with one score, the rate's logit and 0."""
        if self.distinct < 2:
            return float(logit(self.hits / self.total)), 0.0

        def at(intercept: float, slope: float) -> tuple[float, np.ndarray, np.ndarray]:
            loss, g0, g1, a, b, c = self.sums(intercept, slope / scale)
            return loss, np.array([g0, g1 / scale]), np.array([[a, b / scale], [b / scale, c / scale**2]])

        spread = self.sums(0.0, 0.0)  # all weights are a quarter here
        scale = max(math.sqrt(spread[5] / spread[3]), 1e-300)
        intercept, slope = newton_logistic(at, self.total, self.hits)
        slope /= scale
        return intercept - slope * self.centre, slope

    def in_the_large(self) -> float:
        """What added to every x makes the expected positives as many as there are."""

        def at(a: float) -> tuple[float, float]:
            _, residual, _, weight, _, _ = self.sums(a + self.centre, 1.0)
            return residual, -weight

        return shift_of(at)

    def isotonic(self) -> tuple[list[float], list[float]]:
        """First score and value of each step of the nondecreasing fit. Ranges of scores are pooled apart, then the pools."""
        if self.local is None:
            ranged = self.table.select("x", "n", "pos").repartitionByRange(parallelism(self.table.sparkSession), "x").sortWithinPartitions("x")
            found = ranged.select("x", F.col("n").cast("double"), F.col("pos").cast("double")).mapInArrow(_pools, "x double, n double, pos double").orderBy("x").collect()  # pools only
            x, n, pos = (np.array([r[k] for r in found], dtype=float) for k in ("x", "n", "pos"))
        else:
            x, n, pos = self.local
        fitted = isotonic(pos / n, n)
        first = np.flatnonzero(np.diff(fitted, prepend=-np.inf) != 0)
        return x[first].tolist(), fitted[first].tolist()


def _pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pools of a range of scores in order, each with its first score, rows and positives."""
    x, n, pos = (np.zeros(0) for _ in range(3))
    for batch in batches:
        x, n, pos = (np.concatenate([old, batch.column(k).to_numpy(zero_copy_only=False)]) for k, old in enumerate((x, n, pos)))
        if len(x):
            first = np.flatnonzero(np.diff(isotonic(pos / n, n), prepend=-np.inf) != 0)
            x, n, pos = x[first], np.add.reduceat(n, first), np.add.reduceat(pos, first)
    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n), pa.array(pos)], ["x", "n", "pos"])


def _binary(df: DataFrame, score: str, outcome: str, keep: Sequence[str] = ()) -> tuple[DataFrame, Outcome]:
    pairs, kind = paired(df, score, outcome, tuple(keep))
    if kind.kind != "binary":
        raise ValueError("calibration needs a binary outcome of which both values are present")
    return pairs, kind


def fit_calibrator(df: DataFrame, score: str, outcome: str, *, method: str = "logistic") -> CalibrationModel:
    if method not in ("logistic", "isotonic"):
        raise ValueError("method must be logistic or isotonic")
    pairs, _ = _binary(df, score, outcome)
    groups = Grouped(pairs)
    if method == "logistic":
        intercept, slope = groups.logistic()
        return CalibrationModel("logistic", intercept, slope, n=int(groups.total))
    thresholds, values = groups.isotonic()
    return CalibrationModel("isotonic", thresholds=tuple(thresholds), values=tuple(values), n=int(groups.total))


def wilson(positives: Column, n: Column, level: float) -> tuple[Column, Column]:
    z = normal_quantile(0.5 + level / 2)
    p = positives / n
    base = F.lit(1.0) + F.lit(z * z) / n
    centre = (p + F.lit(z * z / 2) / n) / base
    radius = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z / 4) / (n * n)) / base
    return F.greatest(F.lit(0.0), centre - radius), F.least(F.lit(1.0), centre + radius)


def calibration_curve(pairs: DataFrame, bins: int = 10, min_bin_size: int = 30, level: float = 0.95) -> DataFrame:
    """``bin``, ``n``, ``positives``, ``mean_predicted``, ``observed_rate`` with its Wilson interval, ``absolute_gap``, ``sparse``. ``pairs`` has ``p`` and ``y``."""
    counts = value_counts(pairs, "p", (), {"pos": F.col("y")})
    banded = quantile_bands(running(counts, "p").withColumn("midrank", midrank()), bins)
    g = banded.groupBy(F.col("band").alias("bin")).agg(F.sum("n").alias("n"), F.sum("pos").cast("long").alias("positives"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_predicted"))
    low, high = wilson(F.col("positives").cast("double"), F.col("n").cast("double"), level)
    rate = F.col("positives") / F.col("n").cast("double")
    return g.select("bin", "n", "positives", "mean_predicted", rate.alias("observed_rate"), low.alias("observed_rate_ci_lower"), high.alias("observed_rate_ci_upper"), F.abs(rate - F.col("mean_predicted")).alias("absolute_gap"), (F.col("n") < min_bin_size).alias("sparse"))


@dataclass
class CalibrationAssessment:
    metrics: dict
    curve: DataFrame
    model: CalibrationModel | None
    notes: list[str] = field(default_factory=list)

    def to_markdown(self, max_rows: int = 50) -> str:
        return markdown_document("Calibration", self.metrics, {"curve": self.curve}, max_rows)


def assess_calibration(
    df: DataFrame, score: str, outcome: str, *, key: Sequence[str], model: CalibrationModel | None = None, assume_probabilities: bool = False, bins: int = 10, min_bin_size: int = 30, confidence_level: float = 0.95, n_bootstrap: int = 500, random_state: int = 0, source: str = "supplied"
) -> CalibrationAssessment:
    """Brier score with an interval, calibration in the large, slope, expected calibration error and the curve."""
    if (model is None) != assume_probabilities:
        raise ValueError("give a model, or say that the scores are probabilities")
    pairs, _ = _binary(df, score, outcome, key)
    if model is None:
        bad = pairs.where((F.col("score") < 0) | (F.col("score") > 1)).limit(1).count()
        if bad:
            raise ValueError("probabilities must lie between 0 and 1")
    pairs = pairs.withColumn("p", F.col("score") if model is None else model.apply(F.col("score")))
    error = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    base = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.avg(error).alias("brier")).first()
    curve = calibration_curve(pairs, bins, min_bin_size, confidence_level)
    ece = curve.agg((F.sum(F.col("n") * F.col("absolute_gap")) / F.sum("n")).alias("e"), F.count(F.lit(1)).alias("k"), F.count_if("sparse").alias("s")).first()
    groups = Grouped(pairs.select(F.col("p").alias("score"), "y"), logits=True)
    large = groups.in_the_large()
    intercept, slope = groups.logistic() if groups.distinct > 1 else (math.nan, math.nan)
    low = high = math.nan
    if n_bootstrap:
        sums = weighted_sums(pairs, {"e": error}, key, n_bootstrap, random_state).collect()  # a row per replicate
        low, high = percentile_interval([r["e"] / r["w"] for r in sums if r["w"]], confidence_level)
    notes = [f"{ece['s']} bins have fewer than {min_bin_size} rows"] if ece["s"] else []
    metrics = {
        "evaluation_sample_size": base["n"], "positive_count": int(base["pos"]), "positive_rate": base["pos"] / base["n"], "brier_score": base["brier"], "brier_ci_lower": low, "brier_ci_upper": high, "calibration_intercept": large, "calibration_in_the_large": large,
        "calibration_model_intercept": intercept, "calibration_slope": slope, "expected_calibration_error": ece["e"], "requested_bins": bins, "effective_bins": ece["k"], "binning": "quantile", "confidence_level": confidence_level, "bootstrap_samples": n_bootstrap, "evaluation_source": source,
    }
    return CalibrationAssessment(metrics, curve.orderBy("bin"), model, notes)


def stratified_split(df: DataFrame, outcome: str, key: Sequence[str], fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Training and evaluation rows. Of each class, max(1, round(n * fraction)) rows with the smallest hashes of key and seed are evaluated."""
    spread = F.xxhash64(*[F.col(k).cast("string") for k in key], F.lit(seed))
    rows = df.where(F.col(outcome).isNotNull()).withColumn("_spread", spread)
    sizes = {r[outcome]: r["count"] for r in rows.groupBy(outcome).count().collect()}  # two classes
    if min(sizes.values()) < 2:
        raise ValueError("each class needs two rows")
    ranked = running(value_counts(rows, "_spread", [outcome]), "_spread", [outcome])
    edge = F.coalesce(*[F.when(F.col(outcome) == F.lit(c), F.lit(min(n - 1, max(1, round(n * fraction))))) for c, n in sizes.items()])
    cut = {r[outcome]: r["cut"] for r in ranked.where(F.col("below") < edge).groupBy(outcome).agg(F.max("_spread").alias("cut")).collect()}
    held = F.coalesce(*[F.when(F.col(outcome) == F.lit(c), F.col("_spread") <= F.lit(x)) for c, x in cut.items()])
    return rows.where(~held).drop("_spread"), rows.where(held).drop("_spread")


def fit_and_assess_calibration(df: DataFrame, score: str, outcome: str, *, key: Sequence[str], method: str = "logistic", evaluation_fraction: float = 0.25, random_state: int = 0, **options) -> CalibrationAssessment:
    """Fit on one part and assess on the held-out rest."""
    if not 0 < evaluation_fraction < 1:
        raise ValueError("evaluation_fraction must lie between 0 and 1")
    rows = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    train, held = stratified_split(rows, outcome, key, evaluation_fraction, random_state)
    model = fit_calibrator(train, score, outcome, method=method)
    out = assess_calibration(held, score, outcome, key=key, model=model, random_state=random_state, source="holdout", **options)
    out.metrics |= {"fit_sample_size": model.n, "split_method": "stratified_hash", "evaluation_fraction": evaluation_fraction}
    return out
