"""Moments of columns and pairs, each from one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zscore(c: Column, mean: float | None, std: float | None) -> Column:
    """Standardised value; 0 for a constant column, null stays null."""
    if mean is None or not std:
        return F.when(c.isNotNull(), F.lit(0.0))
    return (c - F.lit(float(mean))) / F.lit(float(std))


def column_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Of each column: rows, values ``n``, ``mean``, ``std`` (population), ``min`` and ``max``."""
    measures = {"n": F.count, "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    exprs = [f(F.col(c)).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in measures.items()]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *exprs).first()
    return {c: {"rows": row["rows"]} | {k: row[f"{k}_{i}"] for k in measures} for i, c in enumerate(columns)}


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


@dataclass(frozen=True)
class BlockMoments:
    """Complete-case count, means and population covariance of a block of columns."""

    columns: list[str]
    n: int
    mean: np.ndarray
    cov: np.ndarray

    def std(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def corr(self) -> np.ndarray:
        """Correlations; rows and columns of constant ones are 0."""
        s = self.std()
        varies = s > 0
        out = np.zeros_like(self.cov)
        out[np.ix_(varies, varies)] = self.cov[np.ix_(varies, varies)] / np.outer(s[varies], s[varies])
        out[np.diag_indices_from(out)] = varies.astype(float)
        return np.clip(out, -1, 1)


def block_aggregates(columns: Sequence[str]) -> list[Column]:
    means = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)]
    return [F.count(F.lit(1)).alias("n"), *means, *[F.covar_pop(columns[i], columns[j]).alias(f"c_{i}_{j}") for i in range(len(columns)) for j in range(i + 1)]]


def block_of(row, columns: Sequence[str]) -> BlockMoments:
    k = len(columns)
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            cov[i, j] = cov[j, i] = row[f"c_{i}_{j}"] or 0.0
    return BlockMoments(list(columns), row["n"], np.array([row[f"m_{i}"] if row[f"m_{i}"] is not None else np.nan for i in range(k)]), cov)


def block_moments(df: DataFrame, columns: Sequence[str]) -> BlockMoments:
    return block_of(complete(df, columns).agg(*block_aggregates(columns)).first(), columns)


def grouped_moments(df: DataFrame, columns: Sequence[str], by: str) -> dict:
    """Block moments of each group, in ascending order of the group."""
    rows = complete(df, [*columns, by]).groupBy(by).agg(*block_aggregates(columns)).orderBy(by).collect()  # as many rows as groups
    return {r[by]: block_of(r, columns) for r in rows}
