"""Score constructors: small fitted state, one expression to apply it."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.frame import numeric
from gaugewright.functions.moments import block_moments, column_moments, zscore
from gaugewright.functions.ranks import running, value_counts

SCORE = "proxy_score"
SCALINGS = ("zscore", "minmax", "rank")


class _Constructor:
    kind = ""
    params: dict
    state: dict | None = None

    def _fitted(self) -> dict:
        if self.state is None:
            raise ValueError("the constructor isn't fitted")
        return self.state

    def fit_transform(self, df: DataFrame, indicators: Sequence[str], name: str = SCORE) -> DataFrame:
        return self.fit(df, indicators).transform(df, name)

    def get_params(self) -> dict:
        return dict(self.params)

    def set_params(self, **params):
        if unknown := sorted(set(params) - set(self.params)):
            raise ValueError(f"unknown parameters: {', '.join(unknown)}")
        self.__init__(**(self.params | params))  # type: ignore[misc]
        return self

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "version": 1, "params": self.params, "state": self.state}, sort_keys=True, allow_nan=False)

    @staticmethod
    def from_json(text: str) -> _Constructor:
        raw = json.loads(text)
        kinds = {"composite": CompositeScore, "pca": PCAScore}
        if raw.get("kind") not in kinds or raw.get("version") != 1:
            raise ValueError("not a score constructor of a known version")
        made = kinds[raw["kind"]](**raw["params"])
        made.state = raw["state"]
        return made

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    @classmethod
    def load(cls, path: str):
        with open(path, encoding="utf-8") as f:
            made = cls.from_json(f.read())
        if not isinstance(made, cls):
            raise TypeError(f"the file holds a {type(made).__name__}")
        return made


class CompositeScore(_Constructor):
    """A weighted mean of scaled indicators, over those present; null under ``min_coverage`` of the weight."""

    kind = "composite"

    def __init__(self, weights: dict[str, float] | None = None, scaling: str = "zscore", min_coverage: float = 0.5):
        if scaling not in SCALINGS:
            raise ValueError(f"scaling must be one of {', '.join(SCALINGS)}")
        if not 0 <= min_coverage <= 1:
            raise ValueError("min_coverage must lie between 0 and 1")
        self.params = {"weights": weights, "scaling": scaling, "min_coverage": min_coverage}
        self.reference: DataFrame | None = None

    def fit(self, df: DataFrame, indicators: Sequence[str]) -> CompositeScore:
        given = self.params["weights"] or {}
        if unknown := sorted(set(given) - set(indicators)):
            raise ValueError(f"weights for unknown indicators: {', '.join(unknown)}")
        weights = {c: float(given.get(c, 1.0)) for c in indicators}
        if not all(map(math.isfinite, weights.values())):
            raise ValueError("weights must be finite")
        if sum(map(abs, weights.values())) == 0:
            raise ValueError("the weights sum to zero")
        df = numeric(df, indicators)
        found = column_moments(df, indicators)
        if self.params["scaling"] == "minmax":
            scale = {c: [m["min"] or 0.0, ((m["max"] or 0.0) - (m["min"] or 0.0)) or 1.0] for c, m in found.items()}
        else:
            scale = {c: [m["mean"] or 0.0, m["std"] or 1.0] for c, m in found.items()}
        self.state = {"indicators": list(indicators), "weights": weights, "scale": scale}
        self.reference = df.select(*indicators) if self.params["scaling"] == "rank" else None
        return self

    def transform(self, df: DataFrame, name: str = SCORE) -> DataFrame:
        state = self._fitted()
        df = numeric(df, state["indicators"], check=False)
        scaled = {}
        temporary = []
        for c in state["indicators"]:
            if self.params["scaling"] == "rank":
                df = self._with_cdf(df, c)
                scaled[c] = F.col(f"_cdf_{c}")
                temporary.append(f"_cdf_{c}")
            else:
                centre, width = state["scale"][c]
                scaled[c] = (F.col(c) - F.lit(float(centre))) / F.lit(float(width))
        total = sum(map(abs, state["weights"].values()))
        top = sum((F.coalesce(scaled[c] * F.lit(w), F.lit(0.0)) for c, w in state["weights"].items()), F.lit(0.0))
        seen = sum((F.when(scaled[c].isNotNull(), F.lit(abs(w))).otherwise(F.lit(0.0)) for c, w in state["weights"].items()), F.lit(0.0))
        enough = (seen > 0) & (seen / F.lit(total) >= F.lit(float(self.params["min_coverage"])))
        return df.withColumn(name, F.when(enough, top / seen)).drop(*temporary)

    def _with_cdf(self, df: DataFrame, column: str) -> DataFrame:
        """The share of fitted values at or below each value: the fitted steps and the new values are merged by value."""
        if self.reference is None:
            raise ValueError("rank scaling needs the constructor that was fitted in this session")
        fitted = value_counts(self.reference.select(F.col(column).alias("v")), "v")
        asked = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), F.lit(0).cast("long").alias("n")).distinct()
        counted = running(fitted.unionByName(asked).groupBy("v").agg(F.sum("n").alias("n")), "v")
        looked = counted.select("v", F.try_divide((F.col("below") + F.col("n")).cast("double"), F.col("total").cast("double")).alias("cdf"))
        return df.join(looked.select("v", F.col("cdf").alias(f"_cdf_{column}")), F.col(column) == F.col("v"), "left").drop("v")


class PCAScore(_Constructor):
    """First principal component of standardised complete rows, turned so that it rises with the mean of the indicators."""

    kind = "pca"

    def __init__(self) -> None:
        self.params = {}

    def fit(self, df: DataFrame, indicators: Sequence[str]) -> PCAScore:
        block = block_moments(numeric(df, indicators), indicators)
        if block.n < 3:
            raise ValueError("fewer than three complete rows")
        loadings, explained = first_component(block.corr())
        self.state = {"indicators": list(indicators), "center": block.mean.tolist(), "scale": [s or 1.0 for s in block.std().tolist()], "loadings": loadings.tolist(), "explained_variance_ratio": explained}
        return self

    def transform(self, df: DataFrame, name: str = SCORE) -> DataFrame:
        s = self._fitted()
        df = numeric(df, s["indicators"], check=False)
        parts = [zscore(F.col(c), m, w) * F.lit(float(v)) for c, m, w, v in zip(s["indicators"], s["center"], s["scale"], s["loadings"], strict=True)]
        return df.withColumn(name, sum(parts[1:], parts[0]))


def first_component(corr: np.ndarray) -> tuple[np.ndarray, float]:
    """Loadings of the leading component of a correlation matrix, with a positive sum of correlations with the row mean, and its share."""
    if not np.any(np.diag(corr) > 0):
        raise ValueError("all indicators are constant")
    values, vectors = np.linalg.eigh(corr)
    loadings = vectors[:, -1]
    if loadings @ corr.sum(axis=1) < 0:
        loadings = -loadings
    return loadings, float(values[-1] / np.diag(corr).sum())
