"""Tables as Markdown and HTML. At most ``max_rows`` rows are shown, with a note of it."""

from __future__ import annotations

import html
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def rows_of(table: DataFrame | Sequence[dict], max_rows: int | None) -> tuple[list[str], list[dict], bool]:
    """Column names, rows, and whether there are more."""
    if isinstance(table, DataFrame):
        found = [r.asDict() for r in (table if max_rows is None else table.limit(max_rows + 1)).collect()]
        names = table.columns
    else:
        found = list(table)
        names = list(dict.fromkeys(k for r in found for k in r))
    more = max_rows is not None and len(found) > max_rows
    return names, found[:max_rows] if more else found, more


def shown(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def markdown_table(table: DataFrame | Sequence[dict], max_rows: int | None = 50) -> str:
    names, rows, more = rows_of(table, max_rows)
    if not rows:
        return "_no rows_"
    cell = lambda v: shown(v).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(map(cell, names)) + " |", "|" + " --- |" * len(names)]
    lines += ["| " + " | ".join(cell(r.get(n)) for n in names) + " |" for r in rows]
    return "\n".join(lines) + (f"\n\n_first {max_rows} rows_" if more else "")


def html_table(table: DataFrame | Sequence[dict], max_rows: int | None = 100) -> str:
    names, rows, more = rows_of(table, max_rows)
    if not rows:
        return "<p>no rows</p>"
    cells = lambda tag, values: "".join(f"<{tag}>{html.escape(shown(v))}</{tag}>" for v in values)
    body = "".join(f"<tr>{cells('td', [r.get(n) for n in names])}</tr>" for r in rows)
    return f"<table><thead><tr>{cells('th', names)}</tr></thead><tbody>{body}</tbody></table>" + (f"<p>first {max_rows} rows</p>" if more else "")


def markdown_document(title: str, facts: Mapping[str, object], tables: Mapping[str, DataFrame | Sequence[dict]], max_rows: int | None = 50) -> str:
    """A report of a result: its facts as one table, then its tables."""
    parts = [f"# {title}"]
    if facts:
        parts.append(markdown_table([{"item": k, "value": v} for k, v in facts.items()], None))
    parts += [f"## {name.replace('_', ' ')}\n\n{markdown_table(t, max_rows)}" for name, t in tables.items()]
    return "\n\n".join(parts) + "\n"


STYLE = "body{font:15px sans-serif;max-width:70em;margin:2em auto;color:#222}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}.pass{color:#176d2f}.warn{color:#8a5a00}.fail{color:#a01818}.skip{color:#666}"


def html_page(title: str, sections: Sequence[tuple[str, str]]) -> str:
    """One self-contained document; titles are escaped, bodies are HTML."""
    parts = "".join(f"<section><h2>{html.escape(t)}</h2>{b}</section>" for t, b in sections)
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{parts}</body></html>'
