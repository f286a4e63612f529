"""The driver's contract, sources, reports and the command line."""

import json
import os
import subprocess
import sys

import pandas as pd
import pytest

from gaugewright.cli import BAD_INPUT, NOT_VALIDATED, OK, WARNING, main
from gaugewright.plans import queries as own
from gaugewright.report.tables import html_table, markdown_table
from gaugewright.sources.adapters import CSVAdapter, ParquetAdapter, TabularAdapter, read_table
from gaugewright.sources.synthetic import customer_health

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    assert set(own.ORACLE_SQL) <= set(own.QUERIES) and len(own.ORACLE_SQL) > 35


@pytest.mark.parametrize("name", ["downstream_validity", "psi_over_time", "align_first", "survival_concordance", "actions_continuous", "actions_recommend", "lift_bands_ascending", "downstream_continuous", "indicator_dominance", "group_moments", "pca_of_two", "align_lags", "calibration_isotonic", "compare_action_changes", "compare_coverage", "compare_scores_difference", "compare_scores_continuous", "monitor_states", "multi_outcome", "score_audit"])
def test_some_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "customer orders lineitem events documents labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = own.QUERIES[name](spark, data)
    want = con.execute(own.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cells = lambda rows: sorted([tuple("" if pd.isna(v) else f"{float(v):.5f}" if isinstance(v, (int, float)) else str(v) for v in r) for r in rows])
    names = sorted(got.columns)
    assert cells(got.select(*names).toPandas().itertuples(index=False)) == cells(want[names].itertuples(index=False))


def test_every_query_runs(spark):
    """Each registered query of the library gives rows at the smallest size."""
    empty = [name for name, q in own.QUERIES.items() if name not in ("compare_scores", "score_audit") and not q(spark, "/root/testdata/sf0.001").count()]
    assert empty == []


def test_entry_works_without_the_training_data_package(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('gaugewright.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_runs(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "t.csv"))
    adapter = ParquetAdapter(spark, {"x": str(tmp_path / "t.parquet")}, {"columns": ["n"]})
    assert isinstance(adapter, TabularAdapter)
    bundle = adapter.load()
    assert bundle.require("x").columns == ["n"] and bundle.summary()[0]["rows"] == 2
    assert CSVAdapter(spark, str(tmp_path / "t.csv")).load().require("t").schema["n"].dataType.simpleString() == "int"
    assert read_table(spark, str(tmp_path / "t.csv")).count() == 2
    with pytest.raises(KeyError, match="x"):
        bundle.require("y")
    with pytest.raises(ValueError):
        read_table(spark, "t.xlsx")
    with pytest.raises(ValueError):
        CSVAdapter(spark, {})


def test_tables_escape_and_truncate(spark):
    df = spark.createDataFrame([(k, "a|b<script>") for k in range(5)], "n int, s string")
    text, page = markdown_table(df, 3), html_table(df, 3)
    assert "a\\|b" in text and "first 3 rows" in text and "<script>" not in page and "&lt;script&gt;" in page
    assert markdown_table([]) == "_no rows_"


def test_command_line(spark, tmp_path, capsys):
    data = str(tmp_path / "d.parquet")
    customer_health(spark, 600, seed=61).write.parquet(data)
    out = {k: str(tmp_path / f"o.{k}") for k in ("json", "md", "html")}
    names = ["logins", "feature_depth", "nps"]
    code = main(["audit", "--data", data, "--indicators", *names, "--score", "health_score", "--outcome", "churned", "--key", "row_id", "--json-output", out["json"], "--markdown-output", out["md"], "--html-output", out["html"]], spark)
    assert code in (OK, WARNING, NOT_VALIDATED) and json.load(open(out["json"]))["verdict"] and open(out["html"]).read().startswith("<!doctype")
    base = str(tmp_path / "b.json")
    assert main(["baseline", "--data", data, "--indicators", *names, "--score", "health_score", "--score-id", "h", "--score-version", "1", "--json-output", base], spark) == OK
    assert main(["monitor", "--data", data, "--baseline", base, "--score", "health_score"], spark) == WARNING
    assert json.loads(capsys.readouterr().out)["state"] == "not_assessable"
    assert main(["compare", "--data", data, "--key", "row_id", "--outcome", "churned", "--baseline-score", "logins", "--candidate-score", "health_score", "--bootstrap", "20"], spark) in (OK, WARNING)
    compared = str(tmp_path / "compared.json")
    flags = ["--baseline-name", "old", "--candidate-name", "new", "--n-bands", "4", "--n-bootstrap", "20", "--random-state", "7", "--action-top-n", "50", "--title", "Versions"]
    assert main(["compare", "--data", data, "--key", "row_id", "--outcome", "churned", "--baseline-score", "logins", "--candidate-score", "health_score", *flags, "--json-output", compared, "--html-output", out["html"]], spark) in (OK, WARNING)
    told = json.load(open(compared))
    assert {"old", "new"} <= set(told["performance"]) and told["actions"][0]["baseline_selected_n"] == 50 and "Versions" in open(out["html"]).read()
    assert main(["baseline", "--data", data, "--indicators", *names, "--score", "health_score", "--score-id", "h", "--score-version", "1", "--bins", "4", "--metadata", "team=x", "--artifact", base, "--json-output", compared], spark) == OK
    assert json.load(open(base))["bins"] == 4 and json.load(open(base))["metadata"] == {"team": "x"}
    assert main(["--version"], spark) == OK
    config = tmp_path / "c.toml"
    config.write_text(f'config_version = 1\n[common]\ndata = "{data}"\n[audit]\nindicators = ["logins", "nps"]\n')
    assert main(["audit", "--config", str(config)], spark) == NOT_VALIDATED
    config.write_text("config_version = 9\n")
    assert main(["audit", "--config", str(config)], spark) == BAD_INPUT
    assert main(["audit", "--data", data], spark) == BAD_INPUT
    assert main(["audit", "--data", str(tmp_path / "none.csv"), "--indicators", "x"], spark) == BAD_INPUT
    assert main(["audit", "--data", data, "--indicators", "logins", "--threshold", "max_vif"], spark) == BAD_INPUT
