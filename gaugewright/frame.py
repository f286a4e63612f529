"""Role binding and validation. A role (indicator, score, outcome, segment, period, key) is a column name."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType


def require_columns(df: DataFrame, names: Sequence[str], what: str = "table") -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"the {what} lacks columns: {', '.join(missing)}")


def present(c: Column) -> Column:
    """The value as double; NaN becomes null."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def trusted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mark ``columns`` as checked numbers, so that :func:`numeric` doesn't scan this frame for them again."""
    df._gw_numeric = frozenset(columns) | df.__dict__.get("_gw_numeric", frozenset())
    return df


def _is_trusted(df: DataFrame, columns: Sequence[str]) -> bool:
    return set(columns) <= df.__dict__.get("_gw_numeric", frozenset())


def numeric(df: DataFrame, columns: Sequence[str], *, check: bool = True) -> DataFrame:
    """``df`` with ``columns`` as double, NaN as null. Columns of other kinds and infinities are refused."""
    require_columns(df, columns)
    if not columns:
        raise ValueError("at least one column is needed")
    if _is_trusted(df, columns):
        return df
    for c in columns:
        if not isinstance(df.schema[c].dataType, (NumericType, BooleanType)):
            raise TypeError(f"column {c} isn't numeric")
    out = df.withColumns({c: present(F.col(c).cast("int") if isinstance(df.schema[c].dataType, BooleanType) else F.col(c)) for c in columns})
    if check:
        counts = out.agg(*[F.count_if(F.abs(c) == math.inf).alias(c) for c in columns]).first()
        if bad := [f"{c}: {counts[c]}" for c in columns if counts[c]]:
            raise ValueError(f"infinite values in {', '.join(bad)}")
        trusted(out, columns)
    return out


def check_unique(df: DataFrame, key: Sequence[str]) -> None:
    """Refuse repeated keys, naming up to five."""
    require_columns(df, key)
    if found := df.groupBy(*key).count().where("count > 1").limit(5).collect():
        raise ValueError(f"repeated keys: {[tuple(r[k] for k in key) for r in found]}")


@dataclass(frozen=True)
class Outcome:
    """What an outcome column holds: ``binary`` with its two values in order, ``continuous`` or ``constant``."""

    kind: str
    low: object = None
    high: object = None
    n: int = 0

    def encoded(self, c: Column) -> Column:
        """0 and 1 for a binary outcome, else the value as double; null stays null."""
        if self.kind == "binary":
            return F.when(c.isNotNull(), (c == F.lit(self.high)).cast("double"))
        return present(c)


def outcome_kind(df: DataFrame, column: str) -> Outcome:
    """Two distinct values are binary, the one that sorts later being 1; other numbers are continuous."""
    require_columns(df, [column])
    kind = df.schema[column].dataType
    numbers = isinstance(kind, (NumericType, BooleanType))
    c = present(F.col(column)) if isinstance(kind, NumericType) else F.col(column)
    found = df.agg(F.min(c).alias("low"), F.max(c).alias("high"), F.count(c).alias("n")).first()
    if found["n"] == 0 or found["low"] == found["high"]:
        return Outcome("constant", found["low"], found["high"], found["n"])
    if numbers and not isinstance(kind, BooleanType) and any(math.isinf(found[k]) for k in ("low", "high")):
        raise ValueError(f"outcome {column} has infinite values")
    between = df.where(c.isNotNull() & (c != F.lit(found["low"])) & (c != F.lit(found["high"]))).limit(1).count()
    if not between:
        return Outcome("binary", found["low"], found["high"], found["n"])
    if not numbers:
        raise TypeError(f"outcome {column} is neither numeric nor two-valued")
    return Outcome("continuous", found["low"], found["high"], found["n"])
