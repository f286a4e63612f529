"""Bootstrap by Poisson weights that depend on the row's key, the replicate and the seed alone.

Rows need no order or number, each replicate is a weighted sum, and the same key, replicate and seed
always give the same weight, however rows are partitioned. Weights of a batch of rows are made for all
replicates at once; a partition returns one row per replicate, so nothing grows with rows times replicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.session import materialize, parallelism, temporary

_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])
_ROWS = 4096
#: Weights, of rows times replicates, that a task of :func:`weighted_rank_correlations` may hold.
CELLS = 4_000_000


def row_hash(key: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k).cast("string") for k in key])


def weights(hashes: np.ndarray, samples: int, seed: int, first: int = 1) -> np.ndarray:
    """(rows, replicates) Poisson(1) weights, of the replicates from ``first`` on."""
    u = np.uint64
    x = hashes.astype(np.int64).view(u)[:, None] ^ (np.arange(first, first + samples, dtype=u) * u(0x9E3779B97F4A7C15) + u(seed * 0x632BE59BD9B4E019 % (1 << 64)))[None, :]
    for _ in range(2):
        x = (x ^ (x >> u(31))) * u(0xBF58476D1CE4E5B9)
    x ^= x >> u(29)
    return np.searchsorted(_CDF, (x >> u(11)).astype(np.float64) * 2.0**-53).astype(np.float64)


def weighted_sums(df: DataFrame, values: dict[str, Column], key: Sequence[str], samples: int, seed: int) -> DataFrame:
    """``b``, the sum of weights ``w``, and of each value its weighted sum; rows with a null value are left out."""
    names = list(values)
    rows = df.select(row_hash(key).alias("_h"), *[c.cast("double").alias(n) for n, c in values.items()]).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((samples, len(names) + 1))
        for batch in batches:
            data = np.column_stack([np.ones(batch.num_rows), *(batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(names)))])
            hashes = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(hashes), _ROWS):
                total += weights(hashes[at : at + _ROWS], samples, seed).T @ data[at : at + _ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, samples + 1, dtype=np.int32)), *(pa.array(total[:, k]) for k in range(total.shape[1]))], ["b", "w", *names])

    parts = rows.mapInArrow(run, "b int, w double" + "".join(f", `{n}` double" for n in names))
    return parts.groupBy("b").agg(*[F.sum(n).alias(n) for n in ["w", *names]]).orderBy("b")


def weighted_auc(df: DataFrame, score: str, y: str, key: Sequence[str], samples: int, seed: int) -> list[float]:
    """Of each replicate, the tie-aware area under the curve (NaN with one class).

    Rows are dealt by ranges of score and hash, so rows of one score needn't meet. A partition adds up what its rows between its lowest
    and its highest score contribute among themselves, and its weights of either class there and at both ends; contributions
    between partitions, and between rows of one score, follow from those.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(y).cast("double").alias("y"), row_hash(key).alias("h"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(value: float, p: np.ndarray, n: np.ndarray, inner: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.arange(1, samples + 1, dtype=np.int32)), pa.array(np.full(samples, value)), pa.array(p), pa.array(n), pa.array(inner, from_pandas=True)], ["b", "s", "p", "n", "inner"])

        none, one_score = np.zeros(samples), np.full(samples, np.nan)  # null: the weights of one score, whose own pairs are all ties
        positive, negative, inner, between = none, none, none, None  # of the scores between the lowest and the one that is open
        low, last, tied = None, None, (none, none)
        for batch in batches:
            s, t, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for at in range(0, len(s), _ROWS):
                part, w = s[at : at + _ROWS], weights(h[at : at + _ROWS], samples, seed)
                hit = t[at : at + _ROWS, None] > 0
                starts = np.flatnonzero(np.diff(part, prepend=np.nan) != 0)
                values, pos, neg = part[starts], np.add.reduceat(w * hit, starts, axis=0), np.add.reduceat(w * ~hit, starts, axis=0)
                if last is not None and values[0] == last:
                    pos[0], neg[0] = pos[0] + tied[0], neg[0] + tied[1]
                elif last is not None:
                    values, pos, neg = np.concatenate([[last], values]), np.vstack([tied[0], pos]), np.vstack([tied[1], neg])
                if low is None and len(values) > 1:
                    low = values[0]
                    yield record(low, pos[0], neg[0], one_score)
                    values, pos, neg = values[1:], pos[1:], neg[1:]
                if len(values) > 1:
                    between = values[0] if between is None else between
                    before = negative + np.cumsum(neg[:-1], axis=0) - neg[:-1]
                    inner = inner + (pos[:-1] * (before + neg[:-1] / 2)).sum(axis=0)
                    positive, negative = positive + pos[:-1].sum(axis=0), negative + neg[:-1].sum(axis=0)
                last, tied = values[-1], (pos[-1], neg[-1])
        if between is not None:
            yield record(between, positive, negative, inner)
        if last is not None:
            yield record(last, *tied, one_score)

    table = rows.repartitionByRange(parts, "s", "h").sortWithinPartitions("s").mapInArrow(run, "b int, s double, p double, n double, inner double")
    joined = table.groupBy("b", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.max("inner").alias("inner")).withColumn("inner", F.coalesce("inner", F.col("p") * F.col("n") / 2))
    merged = joined.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("s", "p", "n", "inner"))).alias("x")).orderBy("b")  # at most three rows per partition and replicate
    out = []
    for r in merged.collect():
        p, n, inner = (np.array([part[k] for part in r["x"]]) for k in ("p", "n", "inner"))
        below = np.cumsum(n) - n
        area, positive, negative = float((inner + p * below).sum()), p.sum(), n.sum()
        out.append(area / (positive * negative) if positive and negative else math.nan)
    return out


def _ordered(pdf: pd.DataFrame, count: int, seed: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of one range: their order by value, the sorted values, where distinct ones start, and the weights of each row in that order."""
    at = np.argsort(pdf["v"].to_numpy(), kind="stable")
    values = pdf["v"].to_numpy()[at]
    return at, values, np.flatnonzero(np.diff(values, prepend=np.nan) != 0), weights(pdf["h"].to_numpy()[at], count, seed, first)


def _ends(rows: DataFrame, columns: int, count: int, seed: int, first: int) -> dict[tuple[int, int], tuple[np.ndarray, ...]]:
    """Of each column and range: the weights below it, below its first value, of its first and of its last value, over all ranges."""

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        _, values, starts, w = _ordered(pdf, count, seed, first)
        lowest, highest = w[: starts[1]] if len(starts) > 1 else w, w[starts[-1] :]
        return pd.DataFrame([[pdf["k"].iat[0], pdf["p"].iat[0], values[0], values[-1], *(x.sum(axis=0).tobytes() for x in (lowest, highest, w))]], columns=["k", "p", "low", "high", "first", "last", "whole"])

    long = rows.select("h", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("p"), F.col(f"v{k}").alias("v")) for k in range(columns)])).alias("x")).select("h", "x.*")
    found = long.groupBy("k", "p").applyInPandas(ends, "k int, p int, low double, high double, first binary, last binary, whole binary").collect()  # a row per column and range
    out = {}
    for k in range(columns):
        parts = [(r["p"], r["low"], r["high"], *(np.frombuffer(r[c]) for c in ("first", "last", "whole"))) for r in sorted((r for r in found if r["k"] == k), key=lambda r: r["p"])]
        total: dict[float, np.ndarray] = {}
        for _, low, high, w_low, w_high, _ in parts:
            total[low] = total.get(low, 0) + w_low
            if high != low:
                total[high] = total.get(high, 0) + w_high
        below, start = np.zeros(count), {}
        for p, low, high, _, w_high, whole in parts:
            start.setdefault(low, below)
            if high != low:
                start[high] = below + whole - w_high
            out[k, p] = (below, start[low], total[low], total[high])
            below = below + whole
    return out


def weighted_rank_correlations(df: DataFrame, scores: Sequence[str], y: str, key: Sequence[str], samples: int, seed: int) -> list[list[float]]:
    """Of each replicate, the rank correlation of each score with ``y``, with midranks made anew from its weights (NaN where one is constant).

    Rows are dealt by ranges of value and hash, column by column, so rows of one value needn't meet; weights of whole ranges and of
    the values at their ends lead to the ranks inside. Replicates are taken as many at once as a task can hold for its rows.
    """
    columns = [*scores, y]
    m = len(scores)
    parts = parallelism(df.sparkSession)
    with temporary():
        rows = df.select(row_hash(key).alias("h"), *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)]).dropna()
        for k in range(m + 1):
            rows = materialize(rows.repartitionByRange(parts, f"v{k}", "h").withColumn(f"p{k}", F.spark_partition_id()), "resample-ranges")
        n = rows.count()
        step = max(1, min(samples, CELLS * parts // max(1, n)))
        out: list[list[float]] = []
        for first in range(1, samples + 1, step):
            out += _rank_correlations(rows, m, n, min(step, samples + 1 - first), seed, first)
    return out


def _rank_correlations(rows: DataFrame, m: int, n: int, count: int, seed: int, first: int) -> list[list[float]]:
    """``count`` replicates of :func:`weighted_rank_correlations`."""
    places = rows.sparkSession.sparkContext.broadcast(_ends(rows, m + 1, count, seed, first))  # four numbers per column, range and replicate
    names = [f"s{i}" for i in range(3 * (m + 1))]

    def ranks(pdf: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
        at, _, starts, w = _ordered(pdf.rename(columns={f"v{k}": "v"}), count, seed, first)
        offset, below_first, first_total, last_total = places.value[k, pdf[f"p{k}"].iat[0]]
        each = np.add.reduceat(w, starts, axis=0)
        below = offset + np.cumsum(each, axis=0) - each
        below[0], each[0], each[-1] = below_first, first_total, last_total
        rank, weight = np.empty_like(w), np.empty_like(w)
        rank[at], weight[at] = np.repeat((below + each / 2) / n, np.diff(starts, append=len(w)), axis=0), w
        return rank, weight

    def append(k: int):  # noqa: ANN202
        return lambda pdf: pdf.assign(**{f"r{k}": [r.tobytes() for r in ranks(pdf, k)[0]]})

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        last, w = ranks(pdf, m)
        held = [np.frombuffer(b"".join(pdf[f"r{k}"])).reshape(-1, count) for k in range(m)]
        of = [w, w * last, w * last * last, *(x for r in held for x in (w * r, w * r * r, w * r * last))]
        return pd.DataFrame({"b": np.arange(first, first + count, dtype=np.int32)} | {c: x.sum(axis=0) for c, x in zip(names, of, strict=True)})

    table, kinds = rows, ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    for k in range(m):
        kinds += f", r{k} binary"
        table = table.groupBy(f"p{k}").applyInPandas(append(k), kinds)
    table = table.groupBy(f"p{m}").applyInPandas(sums, "b int" + "".join(f", {c} double" for c in names))
    out = []
    for r in table.groupBy("b").agg(*[F.sum(c).alias(c) for c in names]).orderBy("b").collect():  # a row per replicate
        total, sy, syy = r["s0"], r["s1"], r["s2"]
        spread = syy * total - sy * sy
        found = []
        for i in range(3, 3 * (m + 1), 3):
            sx, sxx, sxy = r[f"s{i}"], r[f"s{i + 1}"], r[f"s{i + 2}"]
            own = sxx * total - sx * sx
            found.append((sxy * total - sx * sy) / math.sqrt(own * spread) if min(own, spread) > 1e-12 * total * total else math.nan)
        out.append(found)
    places.destroy()
    return out


def percentile_interval(values: Sequence[float], level: float) -> tuple[float, float]:
    kept = np.array([v for v in values if v is not None and np.isfinite(v)])
    if len(kept) < 2:
        return math.nan, math.nan
    return tuple(float(x) for x in np.quantile(kept, [(1 - level) / 2, (1 + level) / 2]))


def weighted_blocks(df: DataFrame, columns: Sequence[str], key: Sequence[str], samples: int, seed: int, centre: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Of each replicate: weight, means and population covariance of complete rows. Values are centred first, so sums of products don't cancel."""
    k = len(columns)
    x = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, centre, strict=True)]
    values = {f"s_{i}": x[i] for i in range(k)} | {f"p_{i}_{j}": x[i] * x[j] for i in range(k) for j in range(i + 1)}
    out = []
    for r in weighted_sums(df.dropna(subset=list(columns)), values, key, samples, seed).collect():  # a row per replicate
        n = r["w"]
        if n <= 0:
            continue
        mean = np.array([r[f"s_{i}"] for i in range(k)]) / n
        cov = np.zeros((k, k))
        for i in range(k):
            for j in range(i + 1):
                cov[i, j] = cov[j, i] = r[f"p_{i}_{j}"] / n - mean[i] * mean[j]
        out.append((n, mean + centre, cov))
    return out
