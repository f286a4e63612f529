"""Hand-computed and brute-force cases of alignment, actions, calibration, comparison, constructs, invariance, survival, monitoring."""

import json
import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.functions.moments import BlockMoments
from gaugewright.functions.numeric import chi2_tail, isotonic
from gaugewright.functions.ranks import auc_table, exact_quantiles, midranks, nth_smallest, running, value_counts
from gaugewright.functions import resample
from gaugewright.functions.resample import weighted_auc, weighted_rank_correlations, weights
from gaugewright.governance import REDACTED, configuration_fingerprint, create_governance_manifest, redact_secrets
from gaugewright.operators import calibrate, survival
from gaugewright.operators.actions import analyze_actions
from gaugewright.operators.align import align_delayed_outcomes
from gaugewright.operators.calibrate import CalibrationModel, assess_calibration, fit_and_assess_calibration, fit_calibrator
from gaugewright.operators.compare import compare_scores
from gaugewright.operators.construct import CompositeScore, PCAScore, _Constructor
from gaugewright.operators.constructs import assess_construct_validity
from gaugewright.operators.invariance import assess_measurement_invariance
from gaugewright.operators.monitor import ArtifactVersionError, MonitoringBaseline, State, create_monitoring_baseline, monitor_batch
from gaugewright.operators.outcomes import OutcomeSpec, compare_outcomes, validate_outcomes
from gaugewright.operators.pca_drift import assess_pca_loading_drift
from gaugewright.operators.survival import assess_survival_validation
from gaugewright.plans.recipes import customer_health_recipe, get_business_recipe, list_business_recipes
from gaugewright.results import Verdict
from gaugewright.streaming.monitor_stream import monitor_stream


def day(n, hour=0):
    return datetime(2026, 1, 1) + timedelta(days=n, hours=hour)


def obs(spark):
    return spark.createDataFrame([("a", day(0), 1.0), ("b", day(1), 2.0), ("c", day(2), 3.0)], "id string, at timestamp_ntz, x double")


def test_alignment(spark):
    events = spark.createDataFrame([("a", day(4), 1), ("b", day(6), 1), ("c", day(2), 1), (None, day(3), 1), ("a", day(9), 1), ("c", day(60), 1)], "id string, t timestamp_ntz, y int")
    found = align_delayed_outcomes(obs(spark), events, entity="id", outcome="y", outcome_time="t", key=["id", "at"], score_time="at", horizon=timedelta(days=30))
    rows = {r["id"]: r for r in found.data.collect()}
    assert [rows[k]["outcome_status"] for k in "abc"] == ["matched", "matched", "unmatched"]
    assert [rows[k]["aligned_outcome"] for k in "abc"] == [1, 1, 0]
    assert rows["a"]["outcome_lag"] == timedelta(days=4)
    d = found.diagnostics.first()
    assert (d["matched_rows"], d["unmatched_rows"], d["invalid_outcome_rows"], d["observations_with_multiple_candidates"], d["duplicate_candidate_rows"]) == (2, 1, 1, 1, 1)
    last = align_delayed_outcomes(obs(spark), events, entity="id", outcome="y", outcome_time="t", key=["id", "at"], score_time="at", horizon=timedelta(days=30), match="last", as_of=day(10))
    rows = {r["id"]: r for r in last.data.collect()}
    assert rows["a"]["outcome_lag"] == timedelta(days=9) and rows["c"]["outcome_status"] == "censored" and rows["c"]["aligned_outcome"] is None
    assert last.audit_inputs(["x"])["df"].count() == 2
    with pytest.raises(ValueError):
        align_delayed_outcomes(obs(spark), events, entity="id", outcome="y", outcome_time="t", key=["id", "at"], score_time="at", horizon=timedelta(days=30), match="error").data.count()
    with pytest.raises(TypeError):
        align_delayed_outcomes(obs(spark), events.withColumn("t", F.col("t").cast("timestamp")), entity="id", outcome="y", outcome_time="t", key=["id"], score_time="at", horizon=timedelta(days=3))


def test_window_end_is_inside_and_start_is_not(spark):
    events = spark.createDataFrame([("a", day(0), 5), ("b", day(4), 7)], "id string, t timestamp_ntz, y int")
    found = align_delayed_outcomes(obs(spark), events, entity="id", outcome="y", outcome_time="t", key=["id"], score_time="at", horizon=timedelta(days=3), as_of=day(30))
    assert {r["id"]: r["aligned_outcome"] for r in found.data.collect()} == {"a": 0, "b": 7, "c": 0}


def test_recipe(spark):
    n = customer_health_recipe()
    assert list_business_recipes() == ["account_risk", "customer_health", "lead_quality"] and get_business_recipe("lead_quality").horizon == timedelta(days=30)
    columns = ["account_id", "snapshot_at", "updated_at", "snapshot_month", "plan_tier", *n.indicators, "health_score"]
    base = lambda a, when, upd, s: (a, when, upd, "2026-01", "pro", 1.0, 1.0, 1.0, 1.0, 1.0, s)
    kinds = "account_id string, snapshot_at timestamp_ntz, updated_at timestamp_ntz, snapshot_month string, plan_tier string, " + ", ".join(f"{c} double" for c in columns[5:])
    snaps = spark.createDataFrame([base("a", day(0), day(0), 10.0), base("a", day(0), day(1), 40.0), base("b", day(1), None, 75.0), base("c", day(2), day(2), 92.0)], kinds)
    outs = spark.createDataFrame([("a", day(10), day(10), 1), ("a", day(10), day(11), 1), ("b", day(12), day(12), 1)], "account_id string, churned_at timestamp_ntz, updated_at timestamp_ntz, churned int")
    made = n.prepare({"snapshots": snaps, "outcomes": outs}, as_of=datetime(2026, 5, 1))
    assert made.duplicates_dropped == {"snapshots": 1, "outcomes": 1}
    rows = {r["account_id"]: r for r in made.alignment.data.collect()}
    assert [rows[k]["health_score"] for k in "abc"] == [40.0, 75.0, 92.0] and [rows[k]["aligned_outcome"] for k in "abc"] == [1, 1, 0]


def test_actions(spark):
    df = spark.createDataFrame([(1, 0.1, 0), (2, 0.4, 1), (3, 0.8, 0), (4, 0.9, 1)], "id int, s double, y int")
    found = analyze_actions(df, "s", "y", key=["id"], cutoffs=[0.5], true_positive_benefit=100, false_positive_cost=20, false_negative_cost=50, action_cost=5)
    r = found.rows[0]
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (1, 1, 1, 1)
    assert (r["expected_value"], r["expected_value_per_record"], r["net_value_vs_no_action"], r["break_even_tp_benefit"]) == (20.0, 5.0, 120.0, 80.0)
    hundred = spark.createDataFrame([(i, float(i), int(i > 50)) for i in range(1, 101)], "id int, s double, y int")
    p = analyze_actions(hundred, "s", "y", key=["id"], percentiles=[10], top_n=[0, 7]).rows
    assert p[0]["score_cutoff"] == pytest.approx(90.1) and p[0]["selected_n"] == 10 and p[1]["selected_n"] == 0 and p[2]["selected_n"] == 7
    tied = spark.createDataFrame([(i, 1.0, i % 2) for i in range(10)], "id int, s double, y int")
    t = analyze_actions(tied, "s", "y", key=["id"], top_n=[3])
    assert sorted(r["id"] for r in t.assignments.where("strategy_1").collect()) == [0, 1, 2]
    assert found.recommend("f1")["policy_id"] == "strategy_1" and found.recommend("f1", max_actions=0) is None
    segmented = analyze_actions(hundred.withColumn("g", F.when(F.col("id") % 3 > 0, "x")), "s", "y", key=["id"], cutoffs=[50.5], segments="g")
    assert segmented.segments.where("segment IS NULL").count() == 1


def test_calibration(spark):
    rows = [(i, p / 10, int(i % 100 < p * 10)) for p in range(1, 10) for i in range(100 * p, 100 * p + 100)]
    df = spark.createDataFrame(rows, "id int, p double, y int")
    m = assess_calibration(df, "p", "y", key=["id"], assume_probabilities=True, n_bootstrap=50).metrics
    assert m["brier_score"] == pytest.approx(11 / 60) and m["expected_calibration_error"] == pytest.approx(0, abs=1e-9) and m["calibration_slope"] == pytest.approx(1, abs=1e-6)
    assert m["brier_ci_lower"] < 11 / 60 < m["brier_ci_upper"]
    sharp = df.withColumn("p", F.expr("1 / (1 + exp(-2 * ln(p / (1 - p))))"))
    assert assess_calibration(sharp, "p", "y", key=["id"], assume_probabilities=True, n_bootstrap=0).metrics["calibration_slope"] == pytest.approx(0.5, abs=1e-6)
    steps = fit_calibrator(spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1)], "s double, y int"), "s", "y", method="isotonic")
    assert [r[0] for r in spark.createDataFrame([(0.0,), (2.5,), (3.0,), (9.0,)], "s double").select(steps.apply(F.col("s"))).collect()] == [0.0, 0.0, 1.0, 1.0]
    assert CalibrationModel.from_json(steps.to_json()) == steps
    assert list(isotonic(np.array([1.0, 3.0, 2.0]), np.ones(3))) == [1.0, 2.5, 2.5]
    runs = [fit_and_assess_calibration(df.repartition(k), "p", "y", key=["id"], n_bootstrap=20).metrics for k in (1, 6)]
    assert runs[0] == pytest.approx(runs[1]) and runs[0]["evaluation_sample_size"] == 224  # 112 of each 450


def scored(spark, n=1200, seed=41):
    r = np.random.default_rng(seed)
    x = r.normal(size=n)
    y = (r.uniform(size=n) < 1 / (1 + np.exp(-1.5 * x))).astype(int)
    a, b = x + r.normal(size=n) * 2, x + r.normal(size=n) * 0.3
    return spark.createDataFrame([(i, float(p), float(q), int(t), "uv"[i % 2], f"m{i % 3}", float(z)) for i, (p, q, t, z) in enumerate(zip(a, b, y, x, strict=True))], "id int, a double, b double, y int, g string, m string, z double")


def test_comparison(spark):
    df = scored(spark)
    found = compare_scores(df.select("id", "a"), df.where("id < 1100").select("id", "b"), df.select("id", "y", "g", "m"), key=["id"], baseline_score="a", candidate_score="b", outcome="y", segments="g", period="m", n_bootstrap=100, action_top_n=[50])
    assert found.assessment == "improved" and found.coverage["baseline_only"] == 100 and found.coverage["complete_n"] == 1100
    assert found.performance["ci_lower"] > 0 and found.performance["valid_bootstrap_samples"] == 100
    assert found.tables["migration"].agg(F.sum("n")).first()[0] == 1100
    assert found.tables["actions"].first()["baseline_selected_n"] == 50
    cont = compare_scores(df.select("id", "b"), df.select("id", "a"), df.select("id", "z"), key=["id"], baseline_score="b", candidate_score="a", outcome="z", n_bootstrap=50)
    assert cont.assessment == "regressed" and cont.performance["metric"] == "abs_spearman"
    rows, _ = compare_outcomes(df.select("id", "a"), df.select("id", "b"), df.select("id", "y").withColumn("ok", F.col("id") < 900), {"o": OutcomeSpec("y", "binary", mature="ok")}, key=["id"], baseline_score="a", candidate_score="b", n_bootstrap=0)
    assert rows[0]["mature_rows"] == 900 and rows[0]["evaluation_rows"] == 900


def test_weighted_auc_matches_the_plain_one(spark):
    df = scored(spark, 300).withColumn("s", F.round("b", 1))
    got = weighted_auc(df.repartition(4), "s", "y", ["id"], 3, 5)
    rows = df.select("s", "y", F.xxhash64(F.col("id").cast("string")).alias("h")).collect()
    w = weights(np.array([r["h"] for r in rows]), 3, 5)
    for b in range(3):
        num = den = 0.0
        for i, p in enumerate(rows):
            for j, q in enumerate(rows):
                if p["y"] == 1 and q["y"] == 0:
                    den += w[i, b] * w[j, b]
                    num += w[i, b] * w[j, b] * (1.0 if p["s"] > q["s"] else 0.5 if p["s"] == q["s"] else 0.0)
        assert got[b] == pytest.approx(num / den)
    assert weights(np.arange(20000), 20, 1).mean() == pytest.approx(1.0, abs=0.01)


def test_multi_outcome(spark):
    df = scored(spark, 600)
    good = validate_outcomes(df, "b", ["a"], {"x": OutcomeSpec("y", "binary", 1), "z": OutcomeSpec("z", "continuous", importance="supporting")})
    assert good.verdict is Verdict.DECISION_GRADE
    assert validate_outcomes(df, "b", ["a"], {"x": OutcomeSpec("y", "binary", -1)}).verdict is Verdict.NOT_VALIDATED


def exact_frame(spark, corr, n=400, seed=31):
    r = np.random.default_rng(seed)
    k = len(corr)
    x = r.normal(size=(n, k))
    q, _ = np.linalg.qr(x - x.mean(axis=0))
    data = q @ np.linalg.cholesky(np.array(corr)).T * math.sqrt(n)
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(data)], ["id", *[f"x{i}" for i in range(k)]])


def test_construct_validity(spark):
    corr = np.full((6, 6), 0.16)
    corr[:3, :3] = corr[3:, 3:] = 0.8
    np.fill_diagonal(corr, 1.0)
    found = assess_construct_validity(exact_frame(spark, corr), {"p": ["x0", "x1", "x2"], "q": ["x3", "x4", "x5"]}, key=["id"], n_bootstrap=60)
    assert found.ave[0]["ave"] == pytest.approx(13 / 15) and found.htmt[0]["htmt"] == pytest.approx(0.20)
    assert found.htmt[0]["below_threshold"] and found.htmt[0]["ci_lower"] < 0.2 < found.htmt[0]["ci_upper"]
    flipped = exact_frame(spark, corr).withColumn("x0", -F.col("x0"))
    assert not assess_construct_validity(flipped, {"p": ["x0", "x1", "x2"], "q": ["x3", "x4", "x5"]}, n_bootstrap=0).ave[0]["meets_threshold"]


def test_invariance(spark):
    r = np.random.default_rng(812)
    rows = []
    for g in ("one", "two"):
        f = r.normal(size=(400, 2)) @ np.linalg.cholesky(np.array([[1.0, 0.4], [0.4, 1.0]])).T
        x = np.column_stack([f[:, 0] * v for v in (1, 0.9, 0.8)] + [f[:, 1] * v for v in (1, 0.9, 0.8)]) + r.normal(0, 0.5, (400, 6))
        rows += [(g, *map(float, v)) for v in x]
    df = spark.createDataFrame(rows, ["g", "t1", "t2", "t3", "v1", "v2", "v3"])
    blocks = {"trust": ["t1", "t2", "t3"], "value": ["v1", "v2", "v3"]}
    found = assess_measurement_invariance(df, "g", blocks)
    assert found.highest_supported == "strict" and [x["df"] for x in found.levels] == [16, 20, 24, 30]
    shifted = df.withColumn("t2", F.when(F.col("g") == "two", F.col("t2") + 1.5).otherwise(F.col("t2")))
    assert assess_measurement_invariance(shifted, "g", blocks).highest_supported == "metric"
    assert not assess_measurement_invariance(df, "g", blocks, min_group_size=500).assessed


def test_gradient_of_the_factor_model():
    from gaugewright.operators.invariance import FactorModel

    r = np.random.default_rng(3)
    groups = []
    for n in (100, 130):
        x = r.normal(size=(n, 1)) + r.normal(size=(n, 4))
        groups.append(BlockMoments(list("abcd"), n, x.mean(axis=0), np.cov(x.T, bias=True)))
    for level in ("configural", "metric", "scalar", "strict"):
        m = FactorModel(groups, {"p": ["a", "b"], "q": ["c", "d"]}, level)
        x = m.start() + r.normal(0, 0.1, m.size)
        value, grad = m.objective(x)
        for i in range(m.size):
            step = np.zeros(m.size)
            step[i] = 1e-6
            assert (m.objective(x + step)[0] - m.objective(x - step)[0]) / 2e-6 == pytest.approx(grad[i], rel=1e-4, abs=1e-4)


def test_chi2_tail():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)


def brute_survival(rows, base, horizons):
    def g(t):
        value, times = 1.0, sorted({x for x, _ in base})
        for u in times:
            if u > t:
                break
            risk = sum(x >= u for x, _ in base) - sum(x == u and e for x, e in base)
            lost = sum(x == u and not e for x, e in base)
            value *= 1 - lost / risk if risk else 1.0
        return value

    num = den = 0.0
    for r, t, e in rows:
        if e and t < horizons[-1]:
            w = g(t) ** -2
            for q, u, d in rows:
                if u > t or (u == t and not d):
                    den += w
                    num += w * (1.0 if r > q else 0.5 if r == q else 0.0)
    aucs = []
    for h in horizons:
        a = b = 0.0
        controls = [q for q, u, _ in rows if u > h]
        for r, t, e in rows:
            if e and t <= h:
                a += sum(1.0 if r > q else 0.5 if r == q else 0.0 for q in controls) / g(t)
                b += len(controls) / g(t)
        aucs.append(a / b)
    return num / den, aucs


def test_survival_against_all_pairs(spark):
    r = np.random.default_rng(12)
    risk = np.round(r.normal(size=150), 1)
    time = np.ceil(r.exponential(20 * np.exp(-risk))) + 1
    limit = np.ceil(r.exponential(30, 150)) + 1
    rows = [(float(a), float(min(t, c)), bool(t <= c)) for a, t, c in zip(risk, time, limit, strict=True)]
    base = [(t, e) for _, t, e in rows]
    horizons = [3.0, 8.0, 15.0]
    want, aucs = brute_survival(rows, base, horizons)
    df = spark.createDataFrame(rows, "risk double, duration double, event boolean")
    probability = df.withColumns({f"s{i}": F.lit(0.9 - 0.2 * i) for i in range(3)})
    found = assess_survival_validation(probability, risk="risk", duration="duration", event="event", horizons=horizons, reference=df, survival_probabilities={h: f"s{i}" for i, h in enumerate(horizons)})
    assert found.ranking_summary[0]["value"] == pytest.approx(want)
    assert [x["cumulative_dynamic_auc"] for x in found.ranking_by_horizon] == pytest.approx(aucs)
    assert all(0 <= x["brier_score"] <= 1 for x in found.calibration_by_horizon)


def test_ranges_give_the_same_running_totals(spark):
    df = spark.createDataFrame([(float(i % 97), "uv"[i % 2]) for i in range(1000)], "v double, k string")
    counts = value_counts(df, "v", ["k"])
    plain, ranged = (sorted(map(tuple, running(counts, "v", ["k"], limit=n).select("k", "v", "n", "below", "total").collect())) for n in (10**6, 1))
    assert plain == ranged
    q = exact_quantiles(df, ["v"], [0.0, 0.1, 0.37, 0.5, 1.0])["v"]
    assert q == pytest.approx(np.quantile([i % 97 for i in range(1000)], [0.0, 0.1, 0.37, 0.5, 1.0]))
    assert midranks(df, "v").count() == 97 and auc_table(df, "v", F.lit(1)).first()["auc"] is None


def test_constructors(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, None), (3.0, 30.0), (None, None)], "a double, b double")
    for scaling in ("zscore", "minmax", "rank"):
        rows = [r[0] for r in CompositeScore(scaling=scaling).fit_transform(df, ["a", "b"]).select("proxy_score").collect()]
        assert sum(r is None for r in rows) == 1
    strict = CompositeScore({"a": 1.0, "b": -1.0}, "minmax", 1.0).fit(df, ["a", "b"])
    assert strict.transform(df).where("proxy_score IS NOT NULL").count() == 2
    again = _Constructor.from_json(strict.to_json())
    assert again.get_params() == strict.get_params() and again.transform(df).count() == 4
    ranked = CompositeScore(scaling="rank").fit_transform(df.select("a"), ["a"]).select("a", "proxy_score").dropna().collect()
    assert {r["a"]: round(r["proxy_score"], 6) for r in ranked} == {1.0: 0.333333, 2.0: 0.666667, 3.0: 1.0}
    with pytest.raises(ValueError):
        CompositeScore({"zz": 1.0}).fit(df, ["a"])


def batch(spark, n=1000, seed=51, shift=0.0):
    r = np.random.default_rng(seed)
    f = r.normal(size=n)
    x = [f + r.normal(0, 0.5, n) + shift, f + r.normal(0, 0.5, n), -f + r.normal(0, 0.5, n)]
    y = (r.uniform(size=n) < 1 / (1 + np.exp(-2 * f))).astype(int)
    return spark.createDataFrame([(i, *map(float, v), int(t)) for i, (*v, t) in enumerate(zip(*x, y, strict=True))], "id int, usage double, depth double, tickets double, y int")


def test_monitoring(spark):
    df, names = batch(spark), ["usage", "depth", "tickets"]
    made = PCAScore().fit(df, names)
    base = create_monitoring_baseline(df, names, score_id="s", score_version="1", constructor=made, outcome="y", created_at=datetime(2026, 7, 11, 16, tzinfo=timezone.utc))
    again = MonitoringBaseline.from_json(base.to_json())
    assert again.content == base.content and again.created_at == "2026-07-11T16:00:00Z"
    calm = monitor_batch(again, batch(spark, seed=52), outcome="y", key=["id"])
    assert calm.state is State.INFORMATIONAL and calm.exit_code == 0, calm.to_json()
    moved = monitor_batch(again, batch(spark, seed=53, shift=2.0), outcome="y", key=["id"])
    assert moved["indicator_drift"].state is State.FAILURE and moved.exit_code == 2
    assert monitor_batch(again, df.drop("usage")).checks[0].name == "schema" and len(monitor_batch(again, df.drop("usage")).checks) == 1
    assert monitor_batch(again, df, key=["id"])["outcome_performance"].state is State.NOT_ASSESSABLE
    holes = df.withColumn("usage", F.when(F.col("id") % 3 > 0, F.col("usage")))
    assert monitor_batch(again, holes, outcome="y", key=["id"])["missingness"].state is State.FAILURE
    assert monitor_batch(again, df.limit(60), outcome="y", key=["id"])["volume"].state is State.FAILURE
    with pytest.raises(ArtifactVersionError):
        MonitoringBaseline.from_json(json.dumps(base.content | {"artifact_version": "9"}))
    assert "<table>" in moved.to_html() and "failure" in moved.to_markdown()


def test_monitor_stream(spark, tmp_path):
    df, names = batch(spark), ["usage", "depth", "tickets"]
    base = create_monitoring_baseline(df, names, score_id="s", score_version="1", score="depth")
    df.write.parquet(str(tmp_path / "in"))
    got = []
    query = monitor_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), base, got.append, score="depth", outcome="y", key=["id"]).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert [r.batch_id for r in got] == ["batch-0"] and got[0]["score_drift"].metrics["psi"] == pytest.approx(0.0, abs=1e-9)


def test_pca_drift(spark):
    df, names = batch(spark, 500, 130), ["usage", "depth", "tickets"]
    made = PCAScore().fit(df, names)
    same = assess_pca_loading_drift(made, df, key=["id"], n_bootstrap=50)
    assert same.cosine == pytest.approx(1.0) and same.max_loading_delta == pytest.approx(0.0, abs=1e-9) and same.intervals["valid_bootstrap_samples"] == 50
    made.state["loadings"] = [-x for x in made.state["loadings"]]
    assert assess_pca_loading_drift(made, df).cosine == pytest.approx(1.0)
    assert not assess_pca_loading_drift(made, df.limit(20)).assessed


def test_governance():
    secret = {"db": {"password": "x", "host": "h"}, "list": [{"api-key": 1}]}
    assert redact_secrets(secret) == {"db": {"password": "[redacted]", "host": "h"}, "list": [{"api-key": "[redacted]"}]}
    assert configuration_fingerprint({"a": 1, "b": 2}) == configuration_fingerprint({"b": 2, "a": 1})
    assert configuration_fingerprint({"token": 1}) == configuration_fingerprint({"token": 2})
    with pytest.raises(ValueError):
        create_governance_manifest({"owner": "o"}, strict=True)
    assert create_governance_manifest({"owner": "o"})["missing_fields"]




def test_calibration_is_the_same_with_many_scores(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.normal(size=900).round(2)
    df = spark.createDataFrame([(k, float(v), int(r.random() < 1 / (1 + np.exp(-v)))) for k, v in enumerate(x)], "id long, s double, y int")
    found = []
    for cells in (200_000, 10):
        monkeypatch.setattr(calibrate, "CELLS", cells)
        models = [calibrate.fit_calibrator(df, "s", "y", method=m) for m in ("logistic", "isotonic")]
        metrics = calibrate.assess_calibration(df, "s", "y", key=["id"], model=models[0], n_bootstrap=0).metrics
        found.append([models[0].intercept, models[0].slope, *models[1].thresholds, *models[1].values, metrics["calibration_in_the_large"], metrics["calibration_slope"]])
    assert found[0] == pytest.approx(found[1], abs=1e-7) and found[0][-1] == pytest.approx(1, abs=1e-6)


def test_concordance_in_ranges(spark):
    r = np.random.default_rng(5)
    rows = spark.createDataFrame([(float(a), float(b), bool(c), 0.5 + float(g) / 2) for a, b, c, g in zip(r.integers(0, 40, 300), r.integers(1, 60, 300), r.random(300) < 0.6, r.random(300), strict=True)], "risk double, time double, event boolean, g double")
    whole, ranged = survival.concordance(rows, 50.0), survival.concordance(rows, 50.0, limit=5)
    assert ranged == pytest.approx(whole)


def test_nth_smallest(spark):
    df = spark.range(1000).select(F.struct((F.col("id") % 7).alias("a"), F.col("id").alias("b")).alias("k"))
    want = sorted((k % 7, k) for k in range(1000))
    for n in (1, 143, 500, 1000):
        assert tuple(nth_smallest(df, "k", n, limit=20)) == want[n - 1]


def test_redaction_of_every_marker():
    assert redact_secrets({"auth": 1, "basic-auth": 2, "Auth_Header": 3, "author": 4, "plain": 5}) == {"auth": REDACTED, "basic-auth": REDACTED, "Auth_Header": REDACTED, "author": REDACTED, "plain": 5}


def test_rank_correlations_of_replicates_match_the_plain_ones(spark, monkeypatch):
    df = scored(spark, 400).withColumns({"s": F.round("b", 1), "t": F.when(F.col("id") % 3 == 0, F.col("a")).otherwise(0.5), "u": F.round("z", 1)})
    rows = df.select("s", "t", "u", F.xxhash64(F.col("id").cast("string")).alias("h")).toPandas()
    w = weights(rows["h"].to_numpy(), 5, 9).astype(int)
    plain = []
    for b in range(5):
        ranked = rows.loc[np.repeat(rows.index, w[:, b]), ["s", "t", "u"]].rank()
        plain.append([ranked["s"].corr(ranked["u"]), ranked["t"].corr(ranked["u"])])
    for cells in (4_000_000, 100):  # all replicates at once, then two at a time
        monkeypatch.setattr(resample, "CELLS", cells)
        assert np.allclose(weighted_rank_correlations(df.repartition(4), ["s", "t"], "u", ["id"], 5, 9), plain)
    level = weighted_rank_correlations(df.withColumn("one", F.lit(1.0)), ["one"], "u", ["id"], 2, 9)
    assert np.isnan(level).all()
    assert weighted_rank_correlations(df.where("false"), ["s"], "u", ["id"], 2, 9) == []
