"""Command line: audit, compare, baseline and monitor."""

from __future__ import annotations

import argparse
import sys
import tomllib

from pyspark.sql import DataFrame, SparkSession

from gaugewright import __version__
from gaugewright.config import MonitoringLimits, Thresholds
from gaugewright.governance import to_json
from gaugewright.operators.compare import compare_scores
from gaugewright.operators.monitor import MonitoringBaseline, State, create_monitoring_baseline, monitor_batch
from gaugewright.plans.audit import ScoreAudit
from gaugewright.report.tables import html_page, html_table, markdown_table
from gaugewright.results import Verdict
from gaugewright.sources.adapters import read_table

# Exit codes.
OK, WARNING, NOT_VALIDATED, BAD_INPUT, INTERNAL = range(5)
CONFIG_VERSION = 1


class InputError(Exception):
    """Something given on the command line or in the configuration can't be used."""


def load_config(path: str | None, command: str) -> dict:
    """Options of a TOML file: [common], then [command], then [output]."""
    if path is None:
        return {}
    try:
        with open(path, "rb") as f:
            raw = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError) as why:
        raise InputError(f"can't read the configuration: {why}") from None
    if raw.get("config_version") != CONFIG_VERSION:
        raise InputError(f"config_version must be {CONFIG_VERSION}")
    return {k: v for section in ("common", command, "output") for k, v in raw.get(section, {}).items()}


def pairs(items: list[str], what: str) -> dict[str, float | int | None]:
    out: dict[str, float | int | None] = {}
    for item in items:
        name, sign, value = item.partition("=")
        if not sign:
            raise InputError(f"{what} needs NAME=VALUE, not {item}")
        try:
            number = None if value.lower() == "none" else float(value)
        except ValueError:
            raise InputError(f"{name} must be a number") from None
        out[name] = int(number) if number is not None and number == int(number) else number
    return out


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gaugewright")
    parser.add_argument("--version", action="version", version=f"gaugewright {__version__}")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("audit", "compare", "baseline", "monitor"):
        p = commands.add_parser(name)
        p.add_argument("--config")
        p.add_argument("--data")
        p.add_argument("--indicators", nargs="+")
        p.add_argument("--key", nargs="+")
        for option in ("score", "outcome", "segments", "period", "json-output", "markdown-output", "html-output"):
            p.add_argument(f"--{option}")
        p.add_argument("--threshold", action="append")
        p.add_argument("--title")
        if name == "compare":
            for option in ("candidate-data", "baseline-score", "candidate-score", "baseline-name", "candidate-name"):
                p.add_argument(f"--{option}")
            p.add_argument("--bootstrap", "--n-bootstrap", type=int)
            p.add_argument("--n-bands", type=int)
            p.add_argument("--random-state", type=int)
            p.add_argument("--action-cutoffs", nargs="+", type=float)
            p.add_argument("--action-percentiles", nargs="+", type=float)
            p.add_argument("--action-top-n", nargs="+", type=int)
        if name in ("baseline", "monitor"):
            p.add_argument("--score-id")
            p.add_argument("--score-version")
            p.add_argument("--limit", action="append")
        if name == "baseline":
            p.add_argument("--artifact")
            p.add_argument("--bins", type=int)
            p.add_argument("--metadata", action="append")
        if name == "monitor":
            p.add_argument("--baseline", "--artifact")
            p.add_argument("--batch-id")
    return parser


def emit(options: dict, payload: str, markdown: str, html_text: str) -> None:
    """Write what is asked for; without a JSON path, print the JSON."""
    for name, text in (("json_output", payload), ("markdown_output", markdown), ("html_output", html_text)):
        if options.get(name):
            with open(options[name], "w", encoding="utf-8") as f:
                f.write(text)
    if not options.get("json_output"):
        print(payload)


def need(options: dict, *names: str) -> list:
    if missing := [n for n in names if not options.get(n)]:
        raise InputError(f"missing: {', '.join(missing)}")
    return [options[n] for n in names]


def load(spark: SparkSession, path: str) -> DataFrame:
    try:
        return read_table(spark, path)
    except ValueError as why:
        raise InputError(str(why)) from None
    except Exception:
        raise InputError(f"can't read {path}") from None


def run_audit(spark: SparkSession, o: dict, t: Thresholds) -> int:
    data, indicators = need(o, "data", "indicators")
    report = ScoreAudit(load(spark, data), indicators, o.get("score"), o.get("outcome"), o.get("segments"), o.get("period"), t, o.get("key") or ()).run()
    emit(o, report.to_json(), report.to_markdown(), report.to_html(title=o.get("title") or "Score audit"))
    return {Verdict.DECISION_GRADE: OK, Verdict.DIRECTIONAL: WARNING}.get(report.verdict, NOT_VALIDATED)


def run_compare(spark: SparkSession, o: dict, t: Thresholds) -> int:
    data, key, outcome, first, second = need(o, "data", "key", "outcome", "baseline_score", "candidate_score")
    table = load(spark, data)
    other = load(spark, o["candidate_data"]) if o.get("candidate_data") else table
    extras = [c for c in (o.get("segments"), o.get("period")) if c]
    more = {k: o[k] for k in ("baseline_name", "candidate_name", "n_bands", "random_state", "action_cutoffs", "action_percentiles", "action_top_n") if o.get(k) is not None}
    n = next((o[k] for k in ("bootstrap", "n_bootstrap") if o.get(k) is not None), 500)
    found = compare_scores(table.select(*key, first), other.select(*key, second), table.select(*key, outcome, *extras), key=key, baseline_score=first, candidate_score=second, outcome=outcome, segments=o.get("segments"), period=o.get("period"), n_bootstrap=n, thresholds=t, **more)
    actions = [r.asDict() for r in found.tables["actions"].collect()] if "actions" in found.tables else []  # a row per policy
    payload = to_json({"actions": actions, "coverage": found.coverage, "performance": found.performance, "dimensions": found.dimensions, "metrics": found.metrics, "notes": found.notes})
    markdown = "# Score comparison\n\n" + markdown_table([found.performance]) + "\n\n" + markdown_table(found.dimensions) + "\n"
    markdown += f"\n{markdown_table(actions)}\n" if actions else ""
    emit(o, payload, markdown, html_page(o.get("title") or "Score comparison", [("Performance", html_table([found.performance])), ("Dimensions", html_table(found.dimensions)), *([("Actions", html_table(actions))] if actions else [])]))
    states = {d["assessment"] for d in found.dimensions}
    return NOT_VALIDATED if "regressed" in states else OK if states == {"improved"} else WARNING


def run_baseline(spark: SparkSession, o: dict, t: Thresholds) -> int:
    data, indicators, score, score_id, version = need(o, "data", "indicators", "score", "score_id", "score_version")
    limits = MonitoringLimits().with_values(**pairs(o.get("limit") or [], "--limit"))
    told = dict(item.partition("=")[::2] for item in o.get("metadata") or [] if "=" in item) if isinstance(o.get("metadata"), list) else o.get("metadata")
    if isinstance(o.get("metadata"), list) and len(told) < len(o["metadata"]):
        raise InputError("--metadata needs different NAME=VALUE items")
    made = create_monitoring_baseline(load(spark, data), indicators, score_id=score_id, score_version=version, score=score, outcome=o.get("outcome"), thresholds=t, limits=limits, bins=o.get("bins") or 10, metadata=told)
    if o.get("artifact"):
        made.save(o["artifact"])
    emit(o, made.to_json(), "# Monitoring baseline\n", html_page(o.get("title") or "Monitoring baseline", []))
    return OK


def run_monitor(spark: SparkSession, o: dict, t: Thresholds) -> int:
    data, path = need(o, "data", "baseline")
    baseline = MonitoringBaseline.load(path)
    table = load(spark, data)
    wanted = [c for c in [*baseline.indicators, o.get("score"), o.get("outcome"), *(o.get("key") or [])] if c and c in table.columns]
    result = monitor_batch(baseline, table.select(*dict.fromkeys(wanted)), score=o.get("score"), outcome=o.get("outcome"), score_version=o.get("score_version"), batch_id=o.get("batch_id") or "batch", key=o.get("key") or ())
    emit(o, result.to_json(), result.to_markdown(), result.to_html())
    return {State.INFORMATIONAL: OK, State.FAILURE: NOT_VALIDATED}.get(result.state, WARNING)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        given = vars(build_parser().parse_args(argv))
    except SystemExit as stop:
        return BAD_INPUT if stop.code else OK
    command = given["command"]
    try:
        options = load_config(given["config"], command) | {k: v for k, v in given.items() if v is not None}
        thresholds = Thresholds().with_values(**pairs(options.get("threshold") or [], "--threshold"))
        session = spark or SparkSession.builder.appName("gaugewright").getOrCreate()
        return {"audit": run_audit, "compare": run_compare, "baseline": run_baseline, "monitor": run_monitor}[command](session, options, thresholds)
    except (InputError, ValueError, TypeError, KeyError, OSError) as why:
        print(f"error: {why.args[0] if why.args else why}", file=sys.stderr)
        return BAD_INPUT
    except Exception as why:
        print(f"internal error: {type(why).__name__}", file=sys.stderr)
        return INTERNAL


if __name__ == "__main__":
    sys.exit(main())
