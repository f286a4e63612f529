"""Golden audits of simulated data, and the checks' statuses."""

import math

import pytest
from pyspark.sql import functions as F

from gaugewright.config import Thresholds
from gaugewright.frame import numeric
from gaugewright.operators.downstream import check_downstream, downstream_validity, lift_table
from gaugewright.operators.indicators import check_indicators, cronbach_alpha, indicator_summary, redundant_pairs, vif
from gaugewright.operators.leakage import check_leakage
from gaugewright.operators.segments import segment_summary
from gaugewright.operators.stability import check_stability, psi
from gaugewright.plans.audit import ScoreAudit
from gaugewright.results import Status, Verdict
from gaugewright.sources.synthetic import INDICATORS, customer_health

NAMES = list(INDICATORS)


@pytest.fixture(scope="module")
def healthy(spark):
    return customer_health(spark, 3000, seed=7).repartition(5).cache()


def test_healthy_audit(healthy):
    report = ScoreAudit(healthy, NAMES, "health_score", "churned", "segment", "month", key=["row_id"]).run()
    assert report.verdict is Verdict.DIRECTIONAL
    assert {c.name: c.status for c in report.checks} == {"indicators": Status.WARN, "stability": Status.PASS, "downstream": Status.PASS, "leakage": Status.PASS, "segments": Status.PASS}
    m = report["downstream"].metrics
    assert (m["polarity"], m["n_pos"], m["n_neg"]) == (-1, 989, 2011)
    assert round(m["auc_oriented"], 3) == 0.784 and round(m["spearman"], 3) == -0.462 and round(m["base_rate"], 3) == 0.330
    assert round(report["stability"].metrics["max_psi"], 3) == 0.023
    text = report.to_markdown()
    assert "directional" in text and "| indicator |" in text
    page = report.to_html()
    assert page.startswith("<!doctype html>") and "Governance" in page and "<script" not in page


def test_lift_and_segments(healthy):
    first = lift_table(healthy, "health_score", "churned", ascending=True).first()
    assert (first["band"], first["n"]) == (1, 300)
    assert first["outcome_rate"] == pytest.approx(0.77, abs=1e-6) and first["lift"] == pytest.approx(2.335693, abs=1e-6)
    rows = {r["segment"]: r for r in segment_summary(healthy, "health_score", "segment", "churned").collect()}
    e = rows["enterprise"]
    assert (e["n"], e["n_pos"], e["n_neg"]) == (612, 137, 475)
    for name, value in {"score_mean": 0.243025, "score_std": 0.784145, "pooled_within_std": 0.753123, "smd_vs_rest": 0.405389, "validity": 0.779662}.items():
        assert e[name] == pytest.approx(value, abs=1e-6)


def test_indicator_table(healthy):
    rows = {r["indicator"]: r for r in indicator_summary(healthy, NAMES).collect()}
    assert rows["logins"]["n_unique"] == 41 and rows["logins"]["std"] == pytest.approx(4.919672, abs=1e-6)
    assert rows["logins"]["item_rest_corr"] == pytest.approx(0.171639, abs=1e-6)
    assert vif(healthy, NAMES)["feature_depth"] == pytest.approx(2.184540, abs=1e-6)


def test_leak_and_drift(spark):
    leaky = customer_health(spark, 3000, seed=8, include_leak=True)
    report = ScoreAudit(leaky, [*NAMES, "renewal_meeting_declined"], "health_score", "churned").run()
    assert report.verdict is Verdict.NOT_VALIDATED
    assert round(report["leakage"].metrics["max_association"], 2) == 0.97
    moved = check_stability(customer_health(spark, 4000, seed=9, drift=2.0), "health_score", "month")
    assert moved.status is Status.FAIL and round(moved.metrics["max_psi"], 3) == 2.665


def test_no_outcome_is_not_validated(healthy):
    report = ScoreAudit(healthy, NAMES).run()
    assert report.verdict is Verdict.NOT_VALIDATED
    assert {report[n].status for n in ("downstream", "stability", "segments", "leakage")} == {Status.SKIP}


def test_downsampling_is_exact_and_stable(healthy):
    t = Thresholds(max_audit_rows=500)
    runs = [ScoreAudit(healthy.repartition(n), NAMES, "health_score", "churned", thresholds=t, key=["row_id"]).run() for n in (1, 7)]
    assert runs[0]["downstream"].metrics["n"] == 500
    assert runs[0]["downstream"].metrics["auc"] == pytest.approx(runs[1]["downstream"].metrics["auc"], abs=1e-12)


def test_hand_segments(spark):
    rows = [("a", x) for x in (-16.0, -15.0, -14.0)] + [("b", x) for x in (-1.0, 0.0, 1.0)] + [("c", x) for x in (14.0, 15.0, 16.0)]
    found = {r["segment"]: r for r in segment_summary(spark.createDataFrame(rows, "s string, x double"), "x", "s").collect()}
    assert found["a"]["pooled_within_std"] == pytest.approx(1.0)
    assert [found[k]["smd_vs_rest"] for k in "abc"] == pytest.approx([-22.5, 0.0, 22.5])


def test_ties_share_a_band(spark):
    df = spark.createDataFrame([(i, 0.0, int(i < 20)) for i in range(100)], "id int, s double, y int")
    rows = lift_table(df, "s", "y").collect()
    assert len(rows) == 1 and rows[0]["outcome_rate"] == pytest.approx(0.2) and rows[0]["cum_capture"] == pytest.approx(1.0)


def test_guards(spark):
    df = spark.createDataFrame([(1.0, math.inf, "x"), (math.nan, 2.0, "y")], "a double, b double, s string")
    with pytest.raises(ValueError, match="b: 1"):
        numeric(df, ["a", "b"])
    with pytest.raises(TypeError):
        numeric(df, ["s"])
    with pytest.raises(KeyError):
        numeric(df, ["missing"])
    assert numeric(df, ["a"]).where("a IS NULL").count() == 1
    for bad in ({"psi_stable": 0.5}, {"max_missing_rate": 2.0}, {"min_audit_rows": 1.5}):
        with pytest.raises((ValueError, TypeError)):
            Thresholds(**bad)


def test_redundancy_and_constants(spark):
    rows = [(float(i), float(2 * i), 1.0, float((i * 7) % 10)) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert [tuple(r)[:2] for r in redundant_pairs(df, ["a", "b", "c", "d"]).collect()] == [("a", "b")]
    found = vif(df, ["a", "b", "c", "d"])
    assert math.isinf(found["a"]) and math.isnan(found["c"])
    assert check_indicators(df, ["a", "b", "c", "d"]).status is Status.FAIL
    assert 0 < cronbach_alpha(df, ["a", "b"]) <= 1.0 + 1e-9


def test_small_or_constant_outcomes_are_skipped(spark):
    df = spark.createDataFrame([(float(i), 1, float(i)) for i in range(40)], "s double, y int, x double")
    assert check_downstream(df, "s", "y").status is Status.SKIP
    assert check_leakage(df, ["x"], "y").status is Status.SKIP
    assert downstream_validity(df.withColumn("y", (F.col("s") > 20).cast("int")), "s", "y")["auc"] == 1.0


def test_psi_of_near_constant_baseline(spark):
    same = spark.createDataFrame([(1.0,)] * 60, "x double")
    assert psi(same, same, "x") == pytest.approx(0.0)
    assert psi(same, spark.createDataFrame([(2.0,)] * 60, "x double"), "x") > 1
