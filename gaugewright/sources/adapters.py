"""Sources: named tables with their provenance."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import PurePosixPath
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Provenance:
    """Where a table comes from. Rows are counted when first asked for."""

    name: str
    source: str
    format: str
    columns: list[str]
    loaded_at: str
    table: DataFrame
    _rows: int | None = None

    @property
    def rows(self) -> int:
        if self._rows is None:
            self._rows = self.table.count()
        return self._rows


@dataclass
class TabularData:
    tables: dict[str, DataFrame]
    provenance: list[Provenance] = field(default_factory=list)

    def require(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no table {name!r}; there are {', '.join(sorted(self.tables)) or 'none'}")
        return self.tables[name]

    def copy_tables(self) -> dict[str, DataFrame]:
        return dict(self.tables)

    def summary(self) -> list[dict]:
        return [{"table": p.name, "source": p.source, "format": p.format, "rows": p.rows, "columns": len(p.columns), "loaded_at": p.loaded_at} for p in self.provenance]


@runtime_checkable
class TabularAdapter(Protocol):
    def load(self) -> TabularData: ...


class _FileAdapter:
    format = ""

    def __init__(self, spark: SparkSession, paths: str | Mapping[str, str], options: dict | None = None):
        named = {PurePosixPath(str(paths)).stem: str(paths)} if not isinstance(paths, Mapping) else {k: str(v) for k, v in paths.items()}
        if not named:
            raise ValueError("no paths are given")
        self.spark, self.paths, self.options = spark, named, dict(options or {})

    def _read(self, path: str) -> DataFrame:
        raise NotImplementedError

    def load(self) -> TabularData:
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        tables = {name: self._read(path) for name, path in self.paths.items()}
        return TabularData(tables, [Provenance(n, self.paths[n], self.format, t.columns, now, t) for n, t in tables.items()])


class CSVAdapter(_FileAdapter):
    """CSV files with a header. Types are inferred unless ``options`` has a ``schema``."""

    format = "csv"

    def _read(self, path: str) -> DataFrame:
        options = dict(self.options)
        schema = options.pop("schema", None)
        reader = self.spark.read.options(**({"header": True, "inferSchema": schema is None} | options))
        return (reader.schema(schema) if schema is not None else reader).csv(path)


class ParquetAdapter(_FileAdapter):
    """Parquet files; ``options["columns"]`` reads those columns only."""

    format = "parquet"

    def _read(self, path: str) -> DataFrame:
        options = dict(self.options)
        columns = options.pop("columns", None)
        table = self.spark.read.options(**options).parquet(path)
        return table.select(*columns) if columns else table


class TableAdapter(_FileAdapter):
    """Tables of the session's catalog."""

    format = "table"

    def _read(self, path: str) -> DataFrame:
        return self.spark.table(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by the path's ending: .csv, .parquet or .pq."""
    ending = PurePosixPath(path).suffix.lower()
    if ending == ".csv":
        return CSVAdapter(spark, path).load().require(PurePosixPath(path).stem)
    if ending in (".parquet", ".pq"):
        return ParquetAdapter(spark, path).load().require(PurePosixPath(path).stem)
    raise ValueError(f"can't tell the format of {path}; use .csv, .parquet or .pq")
