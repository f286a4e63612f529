"""Ranks, bands, quantiles and empirical distributions over any number of rows.

All start from counts of distinct values, which partial aggregation makes before anything is shuffled.
Running totals over the distinct values use one window where there are few of them, and value ranges with
an offset for each where there are many, so no task orders an unbounded number of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.session import materialize

#: Distinct values that one task may order.
ONE_TASK = 1_000_000
RANGES = 256


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = (), sums: dict[str, Column] | None = None) -> DataFrame:
    """``keys``, ``value``, its rows ``n`` and further sums, for values that aren't null."""
    extra = [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *extra)


def running(counts: DataFrame, value: str, keys: Sequence[str] = (), also: Sequence[str] = (), limit: int = ONE_TASK) -> DataFrame:
    """``counts`` with ``below`` (``n`` of smaller values) and ``total``, per combination of ``keys``.

    Further columns ``c`` of ``also`` get ``c_below`` and ``c_total`` in the same way.
    """
    keys = list(keys)
    names = {"n": ("below", "total")} | {c: (f"{c}_below", f"{c}_total") for c in also}
    counts = materialize(counts, "counts")  # written once, then counted and read
    if counts.count() <= limit:
        before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*keys)
        return counts.withColumns({low: F.coalesce(F.sum(c).over(before), F.lit(0)) for c, (low, _) in names.items()} | {total: F.sum(c).over(whole) for c, (_, total) in names.items()})
    cuts = counts.agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0]
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    ranged = counts.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= F.col(value))))
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_s_{c}") for c in names])
    earlier, whole = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in [*keys, "_range"]], *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in names], *[F.sum(f"_s_{c}").over(whole).alias(total) for c, (_, total) in names.items()]
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({f"_b_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in names})
    joined = local.join(offsets, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, "_range"]])
    return joined.select(*counts.columns, *[(F.col(f"_o_{c}") + F.col(f"_b_{c}")).alias(low) for c, (low, _) in names.items()], *[total for _, total in names.values()])


def nth_smallest(df: DataFrame, column: str, n: int, limit: int = ONE_TASK) -> object:
    """The ``n``-th smallest (from 1) of a column whose values all differ. Ranges of values are counted first, until one that a task may order holds it."""
    rows = df.select(column)
    while (total := rows.count()) > limit:
        ranged = materialize(rows.repartitionByRange(RANGES, column).withColumn("_range", F.spark_partition_id()), "ranges")
        before = 0
        for r in ranged.groupBy("_range").count().orderBy("_range").collect():  # a row per range
            if before + r["count"] >= n:
                break
            before += r["count"]
        rows, n = ranged.where(F.col("_range") == r["_range"]).select(column), n - before
        if r["count"] == total:
            break
    return rows.orderBy(column).limit(n).agg(F.max(column)).first()[0]


def midrank() -> Column:
    """The average rank of a row of :func:`running`."""
    return F.col("below") + (F.col("n") + 1) / F.lit(2.0)


def midranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, ``value``, ``n``, ``below``, ``total`` and ``midrank`` of each distinct value."""
    return running(value_counts(df, value, keys), value, keys).withColumn("midrank", midrank())


def quantile_bands(ranked: DataFrame, bands: int, keys: Sequence[str] = (), *, ascending: bool = True, name: str = "band") -> DataFrame:
    """Bands from 1 of equal sizes as far as ties allow; equal values share a band, unused bands close up."""
    k = F.least(F.lit(bands), F.col("total"))
    slotted = ranked.withColumn("_slot", F.least(F.floor((F.col("midrank") - 1) * k / F.col("total").cast("double")).cast("int"), (k - 1).cast("int")))
    order = F.col("_slot") if ascending else F.desc("_slot")
    used = slotted.select(*keys, "_slot").distinct().withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    on = [slotted[c].eqNullSafe(used[c]) for c in [*keys, "_slot"]]
    return slotted.join(used if keys else F.broadcast(used), on).select(*[slotted[c] for c in ranked.columns], used[name])  # as many rows as bands


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float]]:
    """Linearly interpolated quantiles of each column, nulls left out; empty lists for columns without values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.c", "x.v")
    ranked = running(value_counts(long, "v", ["c"]), "v", ["c"])
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    last = (F.col("total") - 1).cast("double")
    at = ranked.select("c", "v", "below", "n", "total", wanted).withColumn("at", F.col("p") * last)
    holds = lambda place: (place >= F.col("below")) & (place < F.col("below") + F.col("n"))
    found = at.groupBy("c", "p").agg(
        F.max(F.when(holds(F.floor("at")), F.col("v"))).alias("low"), F.max(F.when(holds(F.ceil("at")), F.col("v"))).alias("high"), F.max(F.col("at") - F.floor("at")).alias("part")
    )
    out: dict[str, dict[float, float]] = {c: {} for c in columns}
    for r in found.collect():
        span, part = r["high"] - r["low"], r["part"]
        out[r["c"]][r["p"]] = r["low"] + span * part if part < 0.5 else r["high"] - span * (1 - part)
    return {c: [out[c][float(p)] for p in probabilities] if out[c] else [] for c in columns}


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def guarded_corr(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows where both are present; null if either is constant."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(F.covar_pop(x, y), spread))))


def with_ranks(df: DataFrame, columns: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with a midrank column for each of ``columns`` (value -> name of its rank)."""
    for value, name in columns.items():
        table = midranks(df, value, keys).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_v"), F.col("midrank").alias(name))
        df = df.join(table, [F.col(value) == F.col("_v"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]], "left").drop("_v", *[f"_k_{k}" for k in keys])
    return df


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), name: str = "spearman") -> DataFrame:
    """Rank correlation of complete pairs, per ``keys``: ``n`` and ``name`` (null under 3 pairs or with a constant side)."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = with_ranks(pairs, {x: "_rx", y: "_ry"}, keys)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, guarded_corr(F.col("_rx"), F.col("_ry"))).alias(name))


def auc_table(df: DataFrame, score: str, positive: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Per ``keys``: ``n``, ``n_pos``, ``n_neg``, ``auc`` (null with one class) and ``spearman`` of score and outcome.

    With two outcome values, the rank correlation needs the score's ranks only. ``positive`` is 0 or 1.
    """
    counts = value_counts(df.withColumn("_p", positive).where("_p IS NOT NULL"), score, keys, {"pos": F.col("_p")})
    ranked = running(counts, score, keys).withColumn("r", midrank())
    n, pos = F.sum("n").cast("double"), F.sum("pos").cast("double")
    sum_r, sum_rr, sum_rp = F.sum(F.col("r") * F.col("n")), F.sum(F.col("r") * F.col("r") * F.col("n")), F.sum(F.col("r") * F.col("pos"))
    found = ranked.groupBy(*keys).agg(n.alias("n"), pos.alias("n_pos"), sum_r.alias("_r"), sum_rr.alias("_rr"), sum_rp.alias("_rp"))
    neg = F.col("n") - F.col("n_pos")
    auc = ratio(F.col("_rp") - F.col("n_pos") * (F.col("n_pos") + 1) / F.lit(2.0), F.col("n_pos") * neg)
    vr = F.col("_rr") - F.col("_r") * F.col("_r") / F.nullif(F.col("n"), F.lit(0.0))
    vp = F.col("n_pos") - F.col("n_pos") * F.col("n_pos") / F.nullif(F.col("n"), F.lit(0.0))
    cov = F.col("_rp") - F.col("_r") * F.col("n_pos") / F.nullif(F.col("n"), F.lit(0.0))
    rho = F.when((F.col("n") >= 3) & (vr > 0) & (vp > 0), cov / F.sqrt(vr * vp))
    return found.select(*keys, F.col("n").cast("long").alias("n"), F.col("n_pos").cast("long").alias("n_pos"), neg.cast("long").alias("n_neg"), auc.alias("auc"), rho.alias("spearman"))


def ecdf(reference: DataFrame, value: str) -> DataFrame:
    """``value`` and ``cdf``: the share of rows at or below it."""
    ranked = running(value_counts(reference, value), value)
    return ranked.select(value, ((F.col("below") + F.col("n")) / F.col("total").cast("double")).alias("cdf"))
