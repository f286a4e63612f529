"""Queries that apply the operators to the driver's tables, each with the SQL it is held against.

Doubles are rounded to six places on both sides, since the order of summation differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from gaugewright.config import Thresholds
from gaugewright.frame import numeric
from gaugewright.functions.moments import block_moments, grouped_moments
from gaugewright.functions.ranks import auc_table, exact_quantiles, spearman
from gaugewright.operators import actions, align, calibrate, compare, downstream, indicators, leakage, monitor, pca_drift, segments, stability, survival
from gaugewright.operators.construct import CompositeScore, PCAScore
from gaugewright.operators.constructs import assess_construct_validity
from gaugewright.operators.invariance import assess_measurement_invariance
from gaugewright.operators.outcomes import OutcomeSpec, validate_outcomes
from gaugewright.plans.audit import ScoreAudit
from gaugewright.plans.recipes import BusinessRecipe
from gaugewright.session import table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(f.name).cast("double"), 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema])


def rows(spark: SparkSession, found: Sequence[dict], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def plain(v: object) -> object:
        v = v.item() if hasattr(v, "item") else v
        return None if isinstance(v, float) and v != v else v

    return rounded(spark.createDataFrame([tuple(plain(r[n]) for n in names) for r in found], schema))


def scored_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "n_chars", "lang").join(table(spark, d, "labels"), "doc_id")


def line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*LINE_KEY, *LINE, "l_returnflag", "l_linestatus", F.year("l_shipdate").alias("yr"))


def holed(spark: SparkSession, d: str) -> DataFrame:
    """Line items whose zero discounts and taxes count as missing."""
    return line(spark, d).withColumns({"l_discount": F.nullif("l_discount", F.lit(0.0)), "l_tax": F.nullif("l_tax", F.lit(0.0))})


def buyers(spark: SparkSession, d: str) -> DataFrame:
    """Per customer with orders before 2001: number and mean price of those, whether orders followed, market segment."""
    o = table(spark, d, "orders")
    cut = F.lit(datetime(2001, 1, 1)).cast("timestamp_ntz")
    old = F.col("o_orderdate") < cut
    per = o.groupBy("o_custkey").agg(F.count_if(old).cast("double").alias("n_orders"), F.avg(F.when(old, F.col("o_totalprice"))).alias("mean_price"), F.max((~old).cast("int")).alias("again"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return per.join(c, per["o_custkey"] == c["c_custkey"]).where("n_orders > 0").select(F.col("c_custkey").alias("custkey"), "n_orders", "mean_price", "again", F.col("c_mktsegment").alias("segment"))


BUYERS = """buyers AS (
    SELECT o_custkey AS custkey, count(*) FILTER (o_orderdate < TIMESTAMP '2001-01-01')::DOUBLE AS n_orders, avg(o_totalprice) FILTER (o_orderdate < TIMESTAMP '2001-01-01') AS mean_price,
           max((o_orderdate >= TIMESTAMP '2001-01-01')::INT) AS again, any_value(c_mktsegment) AS segment
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey HAVING n_orders > 0)"""
SCORED = "scored AS (SELECT doc_id, n_chars, lang, quality, toxic FROM documents JOIN labels USING (doc_id))"


def midrank_sql(value: str, part: str = "") -> str:
    by = f"PARTITION BY {part} " if part else ""
    return f"(rank() OVER ({by}ORDER BY {value}) + (count(*) OVER (PARTITION BY {part + ', ' if part else ''}{value}) - 1) / 2.0::DOUBLE)"


def auc_sql(y: str = "y", mr: str = "mr") -> str:
    return f"(sum({mr}) FILTER ({y} = 1) - sum({y}) * (sum({y}) + 1) / 2.0::DOUBLE) / nullif(sum({y}) * (count(*) - sum({y})), 0)"


def bands_sql(source: str, value: str, k: int, order: str, name: str = "band") -> str:
    """CTE text: ``source`` with its band."""
    return f"""ranked_{name} AS (SELECT *, {midrank_sql(value)} AS mr_{name}, count(*) OVER () AS total_{name} FROM {source}),
    slotted_{name} AS (SELECT *, least(floor((mr_{name} - 1) * least({k}, total_{name}) / total_{name})::INT, least({k}, total_{name}) - 1) AS slot_{name} FROM ranked_{name}),
    {name}s AS (SELECT *, dense_rank() OVER (ORDER BY slot_{name} {order}) AS {name} FROM slotted_{name})"""


def r6(expr: str, name: str) -> str:
    return f"round(({expr})::DOUBLE, 6) + 0.0 AS {name}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- downstream validity, ranks, bands ---------------------------------------------------------


@query(f"WITH {SCORED}, p AS (SELECT quality AS y, {midrank_sql('n_chars')} AS mr FROM scored) SELECT count(*) AS n, sum(y)::BIGINT AS n_pos, (count(*) - sum(y))::BIGINT AS n_neg, {r6(auc_sql(), 'auc')}, {r6('corr(mr, y)', 'spearman')} FROM p")
def downstream_validity(spark: SparkSession, d: str) -> DataFrame:
    pairs, kind = downstream.paired(scored_docs(spark, d), "n_chars", "quality")
    return rounded(downstream.validity_table(pairs, kind))


@query(f"""WITH {SCORED}, {bands_sql('scored', 'n_chars', 10, 'DESC')},
    g AS (SELECT band, count(*) AS n, min(n_chars)::DOUBLE AS score_min, max(n_chars)::DOUBLE AS score_max, avg(quality) AS rate, sum(quality) AS pos FROM bands GROUP BY band)
    SELECT band::INT AS band, n, {r6('score_min', 'score_min')}, {r6('score_max', 'score_max')}, {r6('rate', 'outcome_rate')}, {r6('rate / (sum(pos) OVER () / sum(n) OVER ())', 'lift')}, {r6('sum(pos) OVER (ORDER BY band) / sum(pos) OVER ()', 'cum_capture')} FROM g""")
def lift_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(downstream.lift_table(scored_docs(spark, d), "n_chars", "quality"))


@query(f"WITH r AS (SELECT {midrank_sql('l_quantity')} AS a, {midrank_sql('l_extendedprice')} AS b FROM lineitem) SELECT count(*) AS n, {r6('corr(a, b)', 'spearman')} FROM r")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spearman(line(spark, d), "l_quantity", "l_extendedprice"))


@query(f"SELECT c AS column_name, {r6('quantile_cont(v, 0.1)', 'p10')}, {r6('quantile_cont(v, 0.5)', 'p50')}, {r6('quantile_cont(v, 0.9)', 'p90')} FROM (UNPIVOT (SELECT {', '.join(LINE)} FROM lineitem) ON COLUMNS(*) INTO NAME c VALUE v) GROUP BY c")
def exact_quantile_table(spark: SparkSession, d: str) -> DataFrame:
    found = exact_quantiles(line(spark, d), LINE, [0.1, 0.5, 0.9])
    return rows(spark, [{"column_name": c, "p10": q[0], "p50": q[1], "p90": q[2]} for c, q in found.items()], "column_name string, p10 double, p50 double, p90 double")


@query(f"""WITH {SCORED}, {bands_sql('scored', 'n_chars', 10, 'ASC')},
    g AS (SELECT band, count(*) AS n, avg(quality) AS rate, sum(quality) AS pos FROM bands GROUP BY band)
    SELECT band::INT AS band, n, {r6('rate', 'outcome_rate')}, {r6('sum(pos) OVER (ORDER BY band) / sum(pos) OVER ()', 'cum_capture')} FROM g""")
def lift_bands_ascending(spark: SparkSession, d: str) -> DataFrame:
    return rounded(downstream.lift_table(scored_docs(spark, d), "n_chars", "quality", ascending=True).select("band", "n", "outcome_rate", "cum_capture"))


@query(f"WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, {midrank_sql('l_quantity')} AS a, {midrank_sql('l_extendedprice')} AS b FROM lineitem) SELECT count(*) AS n, {r6('corr(a, b)', 'spearman')}, {r6('corr(x, y)', 'pearson')}, CASE WHEN corr(a, b) < 0 THEN -1 ELSE 1 END::BIGINT AS polarity FROM r")
def downstream_continuous(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, [downstream.downstream_validity(line(spark, d), "l_quantity", "l_extendedprice")], "n long, spearman double, pearson double, polarity long")


@query(f"SELECT c AS indicator, {r6('r', 'abs_corr')} FROM (SELECT abs(corr(l_quantity, l_tax)) AS l_quantity, abs(corr(l_extendedprice, l_tax)) AS l_extendedprice, abs(corr(l_discount, l_tax)) AS l_discount FROM lineitem) UNPIVOT (r FOR c IN (l_quantity, l_extendedprice, l_discount))")
def indicator_dominance(spark: SparkSession, d: str) -> DataFrame:
    found = indicators.dominance(line(spark, d), LINE[:3], "l_tax")
    return rows(spark, [{"indicator": c, "abs_corr": r} for c, r in found.items()], "indicator string, abs_corr double")


@query(f"SELECT l_returnflag, count(*) AS n, {r6('avg(l_quantity)', 'mean_quantity')}, {r6('avg(l_tax)', 'mean_tax')}, {r6('var_pop(l_quantity)', 'var_quantity')}, {r6('covar_pop(l_quantity, l_tax)', 'cov_quantity_tax')} FROM lineitem GROUP BY l_returnflag")
def group_moments(spark: SparkSession, d: str) -> DataFrame:
    found = grouped_moments(line(spark, d), ["l_quantity", "l_tax"], "l_returnflag")
    made = [{"l_returnflag": k, "n": b.n, "mean_quantity": b.mean[0], "mean_tax": b.mean[1], "var_quantity": b.cov[0, 0], "cov_quantity_tax": b.cov[0, 1]} for k, b in found.items()]
    return rows(spark, made, "l_returnflag string, n long, mean_quantity double, mean_tax double, var_quantity double, cov_quantity_tax double")


# --- stability ----------------------------------------------------------------------------------

_CUTS = "cuts AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [" + ", ".join(str(min(1.0, k * 0.1)) for k in range(11)) + "])))[2:-2] AS c FROM lineitem WHERE year(l_shipdate) = 1995)"
_BINS = f"{_CUTS}, bins AS (SELECT year(l_shipdate)::INT AS yr, len(list_filter(c, lambda x: x <= l_quantity))::INT AS bin, count(*) AS n FROM lineitem, cuts GROUP BY ALL)"


@query(f"WITH {_BINS} SELECT yr, bin, n FROM bins")
def psi_bin_counts(spark: SparkSession, d: str) -> DataFrame:
    df = numeric(line(spark, d), ["l_quantity"])
    cuts = stability.baseline_cuts(df.where("yr = 1995"), ["l_quantity"])["l_quantity"]
    return stability.bin_counts(df, "l_quantity", cuts, ["yr"])


@query(f"""WITH {_BINS}, t AS (SELECT yr, sum(n) AS t FROM bins GROUP BY yr), spine AS (SELECT yr, t, unnest(range(0, (SELECT len(c) + 1 FROM cuts)))::INT AS bin FROM t WHERE yr <> 1995),
    pq AS (SELECT s.yr, s.t, greatest(coalesce(b.n, 0) / (SELECT t FROM t WHERE yr = 1995), 1e-4) AS p, greatest(coalesce(a.n, 0) / s.t, 1e-4) AS q FROM spine s LEFT JOIN bins a ON a.yr = s.yr AND a.bin = s.bin LEFT JOIN bins b ON b.yr = 1995 AND b.bin = s.bin)
    SELECT yr AS period, any_value(t)::BIGINT AS n, {r6('sum((q - p) * ln(q / p))', 'psi')} FROM pq GROUP BY yr""")
def psi_over_time(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stability.psi_over_time(line(spark, d), "l_quantity", "yr", 1995))


# --- segments -----------------------------------------------------------------------------------


@query(f"""WITH g AS (SELECT c_mktsegment AS segment, count(*) AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer GROUP BY 1),
    t AS (SELECT *, sqrt(sum((n - 1) * s * s) OVER () / (sum(n) OVER () - count(*) OVER ())) AS pooled, (sum(n * m) OVER () - n * m) / (sum(n) OVER () - n) AS rest FROM g)
    SELECT segment, n, {r6('m', 'score_mean')}, {r6('s', 'score_std')}, {r6('pooled', 'pooled_within_std')}, {r6('(m - rest) / pooled', 'smd_vs_rest')} FROM t""")
def segment_smd(spark: SparkSession, d: str) -> DataFrame:
    return rounded(segments.segment_levels(numeric(table(spark, d, "customer"), ["c_acctbal"]), "c_acctbal", "c_mktsegment"))


@query(f"WITH p AS (SELECT l_returnflag AS segment, (l_linestatus = 'O')::INT AS y, {midrank_sql('l_quantity', 'l_returnflag')} AS mr FROM lineitem) SELECT segment, count(*) AS n, sum(y)::BIGINT AS n_pos, (count(*) - sum(y))::BIGINT AS n_neg, {r6(auc_sql(), 'auc')}, {r6('corr(mr, y)', 'spearman')} FROM p GROUP BY segment")
def segment_validity(spark: SparkSession, d: str) -> DataFrame:
    pairs, kind = downstream.paired(line(spark, d), "l_quantity", "l_linestatus", ("l_returnflag",))
    return rounded(auc_table(pairs.withColumnRenamed("l_returnflag", "segment"), "score", F.col("y"), ["segment"]))


# --- indicators ---------------------------------------------------------------------------------

_HOLED = "h AS (SELECT l_quantity, l_extendedprice, nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax FROM lineitem)"
_Z = "z AS (SELECT *, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z_{c}" for c in LINE) + " FROM h)"


def _rest(c: str) -> str:
    others = [f"z_{o}" for o in LINE if o != c]
    return f"list_avg([{', '.join(others)}])"


@query(f"WITH {_HOLED}, {_Z} " + " UNION ALL ".join(f"SELECT '{c}' AS indicator, {r6(f'avg(({c} IS NULL)::INT)', 'missing_rate')}, count(DISTINCT {c}) AS n_unique, {r6(f'stddev_pop({c})', 'std')}, {r6(f'corr({c}, {_rest(c)})', 'item_rest_corr')} FROM z" for c in LINE))
def indicator_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.indicator_summary(holed(spark, d), LINE))


_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]


@query(f"WITH {_HOLED} " + " UNION ALL ".join(f"SELECT '{a}' AS indicator_a, '{b}' AS indicator_b, {r6(f'corr({a}, {b})', 'corr')} FROM h" for a, b in _PAIRS))
def pairwise_correlations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators.redundant_pairs(holed(spark, d), LINE, 0.0))


_FULL = "c AS (SELECT * FROM h WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in LINE) + ")"


@query(f"WITH {_HOLED}, {_FULL} SELECT {r6('4 / 3.0 * (1 - 4 / (4 + 2 * (' + ' + '.join(f'corr({a}, {b})' for a, b in _PAIRS) + ')))', 'alpha')}, count(*) AS n FROM c")
def cronbach_alpha(spark: SparkSession, d: str) -> DataFrame:
    block = block_moments(numeric(holed(spark, d), LINE), LINE)
    return rows(spark, [{"alpha": indicators.alpha_of(block), "n": block.n}], "alpha double, n long")


@query(f"SELECT 'l_quantity' AS indicator, {r6('1 / (1 - corr(l_quantity, l_discount) ** 2)', 'vif')} FROM lineitem UNION ALL SELECT 'l_discount', {r6('1 / (1 - corr(l_quantity, l_discount) ** 2)', 'vif')} FROM lineitem")
def variance_inflation(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, [{"indicator": c, "vif": v} for c, v in indicators.vif(line(spark, d), ["l_quantity", "l_discount"]).items()], "indicator string, vif double")


@query("WITH u AS (SELECT c AS indicator, v, (l_linestatus = 'O')::INT AS y FROM (UNPIVOT (SELECT " + ", ".join(LINE) + f", l_linestatus FROM lineitem) ON {', '.join(LINE)} INTO NAME c VALUE v)), r AS (SELECT *, {midrank_sql('v', 'indicator')} AS mr FROM u), a AS (SELECT indicator, count(*) AS n, {auc_sql()} AS auc FROM r GROUP BY 1) SELECT indicator, {r6('greatest(auc, 1 - auc)', 'association')}, 'oriented_auc' AS association_metric, n AS n_overlap, true AS assessed, greatest(auc, 1 - auc) >= 0.9 AS statistical_flag, false AS name_flag FROM a")
def leakage_scan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(leakage.leakage_scan(line(spark, d), LINE, "l_linestatus"))


# --- constructors -------------------------------------------------------------------------------

_KEYS = ", ".join(LINE_KEY)


@query(f"SELECT {_KEYS}, {r6('(' + ' + '.join(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()' for c in LINE) + ') / 4', 'proxy_score')} FROM lineitem")
def composite_zscore(spark: SparkSession, d: str) -> DataFrame:
    return rounded(CompositeScore().fit_transform(line(spark, d), LINE).select(*LINE_KEY, "proxy_score"))


@query(f"SELECT {_KEYS}, {r6('(2 * (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) - (l_discount - min(l_discount) OVER ()) / (max(l_discount) OVER () - min(l_discount) OVER ())) / 3', 'proxy_score')} FROM lineitem")
def composite_minmax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(CompositeScore({"l_quantity": 2.0, "l_discount": -1.0}, "minmax").fit_transform(line(spark, d), ["l_quantity", "l_discount"]).select(*LINE_KEY, "proxy_score"))


@query(f"SELECT {_KEYS}, {r6('(cume_dist() OVER (ORDER BY l_quantity) + cume_dist() OVER (ORDER BY l_tax)) / 2', 'proxy_score')} FROM lineitem")
def composite_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(CompositeScore(scaling="rank").fit_transform(line(spark, d), ["l_quantity", "l_tax"]).select(*LINE_KEY, "proxy_score"))


@query(f"WITH h AS (SELECT {_KEYS}, nullif(l_discount, 0.0) AS a, nullif(l_tax, 0.0) AS b FROM lineitem), z AS (SELECT *, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS za, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS zb FROM h) SELECT {_KEYS}, {r6('CASE WHEN za IS NOT NULL AND zb IS NOT NULL THEN (3 * za + zb) / 4 WHEN za IS NOT NULL THEN za END', 'proxy_score')} FROM z")
def composite_min_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(CompositeScore({"l_discount": 3.0, "l_tax": 1.0}).fit_transform(holed(spark, d), ["l_discount", "l_tax"]).select(*LINE_KEY, "proxy_score"))


@query()  # the sign of a component is a convention of the operator
def pca_score_rows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(PCAScore().fit_transform(line(spark, d), LINE, "pca").select(*LINE_KEY, "pca"))


@query(f"""WITH m AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT i AS indicator, {r6('sqrt(0.5)', 'abs_loading')}, {r6('(1 + abs(r)) / 2', 'explained')} FROM m, (VALUES (1::BIGINT), (2)) v(i)""")
def pca_of_two(spark: SparkSession, d: str) -> DataFrame:
    state = PCAScore().fit(line(spark, d), LINE[:2]).state  # of two indicators, the first component is known; if they fall against each other, but for its sign
    return rows(spark, [{"indicator": k + 1, "abs_loading": abs(v), "explained": state["explained_variance_ratio"]} for k, v in enumerate(state["loadings"])], "indicator long, abs_loading double, explained double")


# --- alignment ----------------------------------------------------------------------------------

_OBS = "obs AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), out AS (SELECT user_id, ts AS t, value, event_id AS e FROM events WHERE event_type = 'purchase'), ends AS (SELECT max(t) AS m FROM out)"
_WEEK = "t > obs.ts AND t <= obs.ts + INTERVAL 7 DAY"


def _aligned(spark: SparkSession, d: str, match: str) -> align.AlignmentResult:
    e = table(spark, d, "events")
    obs = e.where("event_type = 'signup'").select("event_id", "user_id", "ts")
    out = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("t"), "value", F.col("event_id").alias("e"))
    return align.align_delayed_outcomes(obs, out, entity="user_id", outcome="value", outcome_time="t", key=["event_id"], score_time="ts", horizon=timedelta(days=7), match=match, outcome_order=["e"])


def _align_sql(pick: str) -> str:
    return f"""WITH {_OBS}, m AS (SELECT event_id, {pick}(out ORDER BY t, e) AS o FROM obs JOIN out ON out.user_id = obs.user_id AND {_WEEK} GROUP BY event_id)
    SELECT obs.event_id, user_id, {r6("CASE WHEN o IS NOT NULL THEN o.value WHEN ts + INTERVAL 7 DAY <= (SELECT m FROM ends) THEN 0 END", 'aligned_outcome')}, o.t AS aligned_outcome_time, floor(epoch(o.t) - epoch(ts) + 0.0000001)::DOUBLE AS lag_seconds,
           CASE WHEN o IS NOT NULL THEN 'matched' WHEN ts + INTERVAL 7 DAY <= (SELECT m FROM ends) THEN 'unmatched' ELSE 'censored' END AS outcome_status
    FROM obs LEFT JOIN m USING (event_id)"""


def _align_rows(found: align.AlignmentResult) -> DataFrame:
    lag = F.floor((F.unix_micros(F.col("aligned_outcome_time").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6 + 0.0000001).cast("double").alias("lag_seconds")
    return rounded(found.data.select("event_id", "user_id", "aligned_outcome", "aligned_outcome_time", lag, "outcome_status"))


@query(_align_sql("first"))
def align_first(spark: SparkSession, d: str) -> DataFrame:
    return _align_rows(_aligned(spark, d, "first"))


@query(_align_sql("last"))
def align_last(spark: SparkSession, d: str) -> DataFrame:
    return _align_rows(_aligned(spark, d, "last"))


@query(f"""WITH {_OBS}, m AS (SELECT obs.event_id, ts, count(t) AS k FROM obs LEFT JOIN out ON out.user_id = obs.user_id AND {_WEEK} GROUP BY ALL)
    SELECT count(*) AS input_observations, (SELECT count(*) FROM out) AS input_outcomes, count(*) FILTER (k > 0) AS matched_rows, count(*) FILTER (k = 0 AND ts + INTERVAL 7 DAY <= (SELECT m FROM ends)) AS unmatched_rows, count(*) FILTER (k = 0 AND ts + INTERVAL 7 DAY > (SELECT m FROM ends)) AS censored_rows,
           count(*) FILTER (k > 1) AS observations_with_multiple_candidates, sum(greatest(k - 1, 0))::BIGINT AS duplicate_candidate_rows FROM m""")
def align_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d, "first").diagnostics.select("input_observations", "input_outcomes", "matched_rows", "unmatched_rows", "censored_rows", "observations_with_multiple_candidates", "duplicate_candidate_rows")


@query(f"""WITH {_OBS}, m AS (SELECT epoch_us(min(t)) - epoch_us(any_value(ts)) AS lag FROM obs JOIN out ON out.user_id = obs.user_id AND {_WEEK} GROUP BY event_id)
    SELECT {r6('min(lag) / 1e6', 'lag_min')}, {r6('round(quantile_cont(lag::DOUBLE, 0.5)) / 1e6', 'lag_median')}, {r6('max(lag) / 1e6', 'lag_max')} FROM m""")
def align_lags(spark: SparkSession, d: str) -> DataFrame:
    found = _aligned(spark, d, "first").diagnostics
    return rounded(found.select(*[F.col(c).cast("interval second").cast("decimal(24,6)").cast("double").alias(c) for c in ("lag_min", "lag_median", "lag_max")]))


@query("SELECT event_id, user_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_latest(spark: SparkSession, d: str) -> DataFrame:
    return align.latest_versions(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id", "event_type"], "ts", ["event_id"])


@query(f"""WITH s AS (SELECT user_id, date_trunc('day', ts) AS scored_at, value, event_id FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) = 1),
    o AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS t FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-20')
    SELECT s.user_id, s.scored_at, {r6('value', 'score')}, (CASE WHEN count(t) > 0 THEN 1 WHEN scored_at + INTERVAL 3 DAY <= TIMESTAMP '2024-01-20' THEN 0 END)::DOUBLE AS aligned_outcome, CASE WHEN count(t) > 0 THEN 'matched' WHEN scored_at + INTERVAL 3 DAY <= TIMESTAMP '2024-01-20' THEN 'unmatched' ELSE 'censored' END AS outcome_status
    FROM s LEFT JOIN o ON o.user_id = s.user_id AND t > scored_at AND t <= scored_at + INTERVAL 3 DAY GROUP BY s.user_id, scored_at, value""")
def recipe_prepare(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    day, hour = F.date_trunc("day", "ts").cast("timestamp_ntz"), F.date_trunc("hour", "ts").cast("timestamp_ntz")
    snaps = e.where("event_type = 'view'").select("user_id", day.alias("scored_at"), F.col("ts").alias("updated_at"), F.lit("p").alias("period"), F.lit("s").alias("segment"), "value", F.col("value").alias("score"), "event_id")
    outs = e.where("event_type = 'purchase'").where("ts <= TIMESTAMP_NTZ '2024-01-20 00:00:00'").select("user_id", hour.alias("bought_at"), F.col("ts").alias("updated_at"), F.lit(1).alias("bought"), "event_id")
    recipe = BusinessRecipe("purchase", "user_id", "scored_at", "period", "segment", ("value",), "score", "bought", "bought_at", timedelta(days=3))
    made = recipe.prepare({"snapshots": snaps, "outcomes": outs}, as_of=datetime(2024, 1, 20), order="event_id")
    return rounded(made.alignment.data.select("user_id", "scored_at", "score", F.col("aligned_outcome").cast("double").alias("aligned_outcome"), "outcome_status"))


# --- actions ------------------------------------------------------------------------------------

_MEASURES = f"""count(*) AS n, count(*) FILTER (sel) AS selected_n, {r6('avg(sel::INT)', 'selected_rate')}, count(*) FILTER (sel AND y = 1) AS tp, count(*) FILTER (sel AND y = 0) AS fp, count(*) FILTER (NOT sel AND y = 0) AS tn, count(*) FILTER (NOT sel AND y = 1) AS fn,
    {r6('avg(y) FILTER (sel)', 'precision')}, {r6('avg(sel::INT) FILTER (y = 1)', 'recall')}, {r6('avg((NOT sel)::INT) FILTER (y = 0)', 'specificity')}, {r6('avg(sel::INT) FILTER (y = 0)', 'false_positive_rate')}, {r6('avg((NOT sel)::INT) FILTER (y = 1)', 'false_negative_rate')}, {r6('avg((sel = (y = 1))::INT)', 'accuracy')},
    {r6('CASE WHEN count(*) FILTER (sel AND y = 1) > 0 THEN 2 * (avg(y) FILTER (sel)) * (avg(sel::INT) FILTER (y = 1)) / ((avg(y) FILTER (sel)) + (avg(sel::INT) FILTER (y = 1))) END', 'f1')}, {r6('(avg(sel::INT) FILTER (y = 1)) + (avg((NOT sel)::INT) FILTER (y = 0)) - 1', 'youden_j')}"""


@query(f"WITH {SCORED}, p AS (SELECT c AS score_cutoff, n_chars >= c AS sel, quality AS y FROM scored, (VALUES (800.0::DOUBLE), (3000.0)) v(c)) SELECT 'cutoff' AS strategy, score_cutoff, {_MEASURES} FROM p GROUP BY score_cutoff")
def actions_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(actions.analyze_actions(scored_docs(spark, d), "n_chars", "quality", key=["doc_id"], cutoffs=[800, 3000], polarity=1).table.drop("policy_id", "parameter"))


@query(f"WITH {SCORED}, c AS (SELECT 10.0::DOUBLE AS parameter, quantile_cont(n_chars, 0.9) AS c FROM scored UNION ALL SELECT 35.0, quantile_cont(n_chars, 0.65) FROM scored), p AS (SELECT parameter, n_chars >= c AS sel, quality AS y, c FROM scored, c) SELECT parameter, {r6('any_value(c)', 'score_cutoff')}, {_MEASURES} FROM p GROUP BY parameter")
def actions_percentile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(actions.analyze_actions(scored_docs(spark, d), "n_chars", "quality", key=["doc_id"], percentiles=[10, 35], polarity=1).table.drop("policy_id", "strategy"))


@query(f"WITH {SCORED}, p AS (SELECT k AS parameter, row_number() OVER (PARTITION BY k ORDER BY n_chars DESC, doc_id) <= k AS sel, quality AS y FROM scored, (VALUES (25.0::DOUBLE), (100.0)) v(k)) SELECT parameter, {_MEASURES} FROM p GROUP BY parameter")
def actions_top_n(spark: SparkSession, d: str) -> DataFrame:
    return rounded(actions.analyze_actions(scored_docs(spark, d), "n_chars", "quality", key=["doc_id"], top_n=[25, 100], polarity=1).table.drop("policy_id", "strategy", "score_cutoff"))


@query(f"WITH {SCORED}, c AS (SELECT DISTINCT unnest(quantile_cont(n_chars, [0.0, 0.25, 0.5, 0.75, 1.0])) AS c FROM scored), p AS (SELECT c, n_chars >= c AS sel, quality AS y FROM scored, c) SELECT {r6('c', 'score_cutoff')}, {_MEASURES} FROM p GROUP BY c")
def actions_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(actions.analyze_actions(scored_docs(spark, d), "n_chars", "quality", key=["doc_id"], grid_size=5, polarity=1).table.drop("policy_id", "strategy", "parameter"))


@query(f"WITH {SCORED}, p AS (SELECT lang AS segment, n_chars >= 1500 AS sel, quality AS y FROM scored) SELECT segment, true AS assessed, {_MEASURES} FROM p GROUP BY segment")
def actions_by_segment(spark: SparkSession, d: str) -> DataFrame:
    t = Thresholds(min_segment_size=1, min_class_count=1)
    return rounded(actions.analyze_actions(scored_docs(spark, d), "n_chars", "quality", key=["doc_id"], cutoffs=[1500], polarity=1, segments="lang", thresholds=t).segments.drop("policy_id", "unassessed_reason"))


@query(f"""WITH {SCORED}, p AS (SELECT n_chars >= c AS sel, n_chars / 2.0 + quality AS y FROM scored, (VALUES (1500.0::DOUBLE)) v(c))
    SELECT count(*) AS n, count(*) FILTER (sel) AS selected_n, {r6('avg(sel::INT)', 'selected_rate')}, {r6('avg(y)', 'outcome_mean')}, {r6('avg(y) FILTER (sel)', 'selected_outcome_mean')}, {r6('avg(y) FILTER (NOT sel)', 'unselected_outcome_mean')}, {r6('(avg(y) FILTER (sel)) - (avg(y) FILTER (NOT sel))', 'outcome_mean_difference')} FROM p""")
def actions_continuous(spark: SparkSession, d: str) -> DataFrame:
    df = scored_docs(spark, d).withColumn("y", F.col("n_chars") / F.lit(2.0) + F.col("quality"))
    return rounded(actions.analyze_actions(df, "n_chars", "y", key=["doc_id"], cutoffs=[1500], polarity=1).table.select(*actions.CONTINUOUS))


@query(f"""WITH {SCORED}, c AS (SELECT DISTINCT unnest(quantile_cont(n_chars, [{', '.join(str(k / 19) for k in range(20))}])) AS c FROM scored), p AS (SELECT c, n_chars >= c AS sel, quality AS y FROM scored, c),
    m AS (SELECT c, count(*) FILTER (sel) AS selected_n, avg(y) FILTER (sel) AS a, avg(sel::INT) FILTER (y = 1) AS b FROM p GROUP BY c)
    SELECT {r6('c', 'score_cutoff')}, selected_n, {r6('2 * a * b / (a + b)', 'f1')}, {r6('b', 'recall')} FROM m WHERE b >= 0.3 AND a + b > 0 ORDER BY round(2 * a * b / (a + b), 12) DESC, selected_n LIMIT 1""")
def actions_recommend(spark: SparkSession, d: str) -> DataFrame:
    found = actions.analyze_actions(scored_docs(spark, d), "n_chars", "quality", key=["doc_id"], polarity=1).recommend("f1", min_recall=0.3)
    return rows(spark, [found], "score_cutoff double, selected_n long, f1 double, recall double")


@query(f"""WITH {SCORED}, p AS (SELECT count(*) AS n, count(*) FILTER (n_chars >= 1500) AS s, sum(quality) FILTER (n_chars >= 1500) AS tp, sum(quality) AS pos FROM scored), m AS (SELECT *, (s - tp) * 20.0 + (pos - tp) * 50.0 + s * 5.0 AS spent FROM p)
    SELECT {r6('tp * 100.0 - spent', 'expected_value')}, {r6('(tp * 100.0 - spent) / n', 'expected_value_per_record')}, {r6('tp * 100.0 - spent + pos * 50.0', 'net_value_vs_no_action')}, {r6('spent / tp', 'break_even_tp_benefit')} FROM m""")
def actions_economics(spark: SparkSession, d: str) -> DataFrame:
    found = actions.analyze_actions(scored_docs(spark, d), "n_chars", "quality", key=["doc_id"], cutoffs=[1500], polarity=1, true_positive_benefit=100, false_positive_cost=20, false_negative_cost=50, action_cost=5)
    return rounded(found.table.select(*actions.ECONOMIC))


# --- comparison ---------------------------------------------------------------------------------


@query("WITH b AS (SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'), c AS (SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '2001-01-01'), f AS (SELECT b.custkey AS x, c.custkey AS z FROM b FULL JOIN c ON b.custkey = c.custkey) SELECT count(x) AS baseline_n, count(z) AS candidate_n, count(*) FILTER (x IS NOT NULL AND z IS NOT NULL) AS overlap_n, count(*) FILTER (z IS NULL) AS baseline_only, count(*) FILTER (x IS NULL) AS candidate_only, 0::BIGINT AS baseline_missing, 0::BIGINT AS candidate_missing, 0::BIGINT AS outcome_missing, count(*) FILTER (x IS NOT NULL AND z IS NOT NULL) AS complete_n FROM f")
def compare_coverage(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "custkey")
    early = orders.where("o_orderdate < TIMESTAMP '1997-01-01'").groupBy("custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    late = orders.where("o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '2001-01-01'").groupBy("custkey").agg(F.avg("o_totalprice").alias("mean_price"))
    return compare.coverage(early, late, buyers(spark, d), ["custkey"], ("n_orders", "mean_price"), "again")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return buyers(spark, d).select("custkey", F.col("n_orders").alias("baseline"), F.col("mean_price").alias("candidate"), F.col("again").cast("double").alias("y"))


@query(f"WITH {BUYERS}, u AS (SELECT 'baseline' AS version, n_orders AS v FROM buyers UNION ALL SELECT 'candidate', mean_price FROM buyers) SELECT version, count(v) AS n, {r6('avg((v IS NULL)::INT)', 'missing_rate_in_overlap')}, {r6('avg(v)', 'mean')}, {r6('stddev_samp(v)', 'std')}, {r6('min(v)', 'min')}, {r6('quantile_cont(v, 0.1)', 'p10')}, {r6('quantile_cont(v, 0.5)', 'median')}, {r6('quantile_cont(v, 0.9)', 'p90')}, {r6('max(v)', 'max')} FROM u GROUP BY version")
def compare_distributions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.distributions(_versions(spark, d), ("baseline", "candidate")))


_MOVES = f"{BUYERS}, {bands_sql('buyers', 'n_orders', 10, 'ASC', 'bb')}, {bands_sql('bbs', 'mean_price', 10, 'ASC', 'cb')}"


@query(f"WITH {_MOVES} SELECT bb::INT AS baseline_band, cb::INT AS candidate_band, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY bb)', 'rate')} FROM cbs GROUP BY bb, cb")
def compare_migration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.migration(compare.ranked_pairs(_versions(spark, d), (1, 1), 10)))


@query(f"WITH {_MOVES} SELECT custkey, {r6('n_orders', 'baseline_score')}, {r6('mean_price', 'candidate_score')}, {r6('mr_bb / total_bb', 'baseline_rank_percentile')}, {r6('mr_cb / total_cb', 'candidate_rank_percentile')}, {r6('abs(mr_cb / total_cb - mr_bb / total_bb)', 'absolute_rank_change')}, bb::INT AS baseline_band, cb::INT AS candidate_band FROM cbs")
def compare_rank_movements(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compare.rank_movements(compare.ranked_pairs(_versions(spark, d), (1, 1), 10), ["custkey"]))


@query(f"""WITH {BUYERS}, s AS (SELECT row_number() OVER (ORDER BY n_orders DESC, custkey) <= 100 AS a, row_number() OVER (ORDER BY mean_price DESC, custkey) <= 100 AS b, again FROM buyers)
    SELECT count(*) FILTER (a) AS baseline_selected_n, count(*) FILTER (b) AS candidate_selected_n, count(*) FILTER (a AND b) AS both_selected_n, count(*) FILTER (a AND NOT b) AS baseline_only_n, count(*) FILTER (b AND NOT a) AS candidate_only_n, count(*) FILTER (a <> b) AS changed_n, {r6('avg((a <> b)::INT)', 'changed_rate')}, {r6('count(*) FILTER (a AND b) / count(*) FILTER (a OR b)', 'jaccard')},
        {r6('avg(again) FILTER (a)', 'baseline_precision')}, {r6('avg(again) FILTER (b)', 'candidate_precision')}, {r6('avg(a::INT) FILTER (again = 1)', 'baseline_recall')}, {r6('avg(b::INT) FILTER (again = 1)', 'candidate_recall')} FROM s""")
def compare_action_changes(spark: SparkSession, d: str) -> DataFrame:
    found = compare.compare_actions(_versions(spark, d), ["custkey"], ("baseline", "candidate"), (1, 1), (), (), (100,))
    return rounded(found.drop("policy_id", "strategy", "parameter", "baseline_cutoff", "candidate_cutoff"))


@query()
def compare_scores(spark: SparkSession, d: str) -> DataFrame:
    b = buyers(spark, d)
    found = compare.compare_scores(b.select("custkey", "n_orders"), b.select("custkey", "mean_price"), b.select("custkey", "again", "segment"), key=["custkey"], baseline_score="n_orders", candidate_score="mean_price", outcome="again", segments="segment", n_bootstrap=500)
    return rows(spark, [found.performance], "metric string, baseline double, candidate double, candidate_minus_baseline double, ci_lower double, ci_upper double, assessment string")


@query(f"""WITH {BUYERS}, f AS (SELECT again AS y, {midrank_sql('n_orders')} AS a, {midrank_sql('mean_price')} AS b FROM buyers), e AS (SELECT {auc_sql(mr='a')} AS a, {auc_sql(mr='b')} AS b FROM f), o AS (SELECT greatest(a, 1 - a) AS a, greatest(b, 1 - b) AS b FROM e)
    SELECT 'oriented_auc' AS metric, {r6('a', 'baseline')}, {r6('b', 'candidate')}, {r6('b - a', 'candidate_minus_baseline')}, CASE WHEN abs(b - a) <= 1e-12 THEN 'inconclusive' WHEN b > a THEN 'improved' ELSE 'regressed' END AS assessment FROM o""")
def compare_scores_difference(spark: SparkSession, d: str) -> DataFrame:
    b = buyers(spark, d)
    found = compare.compare_scores(b.select("custkey", "n_orders"), b.select("custkey", "mean_price"), b.select("custkey", "again"), key=["custkey"], baseline_score="n_orders", candidate_score="mean_price", outcome="again", n_bootstrap=0)
    return rows(spark, [found.performance], "metric string, baseline double, candidate double, candidate_minus_baseline double, assessment string")


@query(f"""WITH {BUYERS}, f AS (SELECT {midrank_sql('mean_price')} AS y, {midrank_sql('n_orders')} AS a, {midrank_sql('custkey')} AS b FROM buyers), o AS (SELECT abs(corr(a, y)) AS a, abs(corr(b, y)) AS b FROM f)
    SELECT 'abs_spearman' AS metric, {r6('a', 'baseline')}, {r6('b', 'candidate')}, {r6('b - a', 'candidate_minus_baseline')}, CASE WHEN abs(b - a) <= 1e-12 THEN 'inconclusive' WHEN b > a THEN 'improved' ELSE 'regressed' END AS assessment FROM o""")
def compare_scores_continuous(spark: SparkSession, d: str) -> DataFrame:
    b = buyers(spark, d).withColumn("number", F.col("custkey").cast("double"))
    found = compare.compare_scores(b.select("custkey", "n_orders"), b.select("custkey", "number"), b.select("custkey", "mean_price"), key=["custkey"], baseline_score="n_orders", candidate_score="number", outcome="mean_price", n_bootstrap=0)
    return rows(spark, [found.performance], "metric string, baseline double, candidate double, candidate_minus_baseline double, assessment string")


# --- calibration --------------------------------------------------------------------------------

_P = f"{BUYERS}, p AS (SELECT custkey, least(0.99, n_orders / 20.0) AS p, again AS y FROM buyers)"


def _probabilities(spark: SparkSession, d: str) -> DataFrame:
    return buyers(spark, d).select("custkey", F.least(F.lit(0.99), F.col("n_orders") / F.lit(20.0)).alias("p"), F.col("again").cast("double").alias("y"))


@query(f"""WITH {_P}, {bands_sql('p', 'p', 10, 'ASC', 'bin')}, g AS (SELECT bin, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS k, avg(p) AS m, sum(y) / count(*)::DOUBLE AS r FROM bins GROUP BY bin), w AS (SELECT *, 1.959963984540054 AS z FROM g)
    SELECT bin::INT AS bin, n::BIGINT AS n, k::BIGINT AS positives, {r6('m', 'mean_predicted')}, {r6('r', 'observed_rate')}, {r6('greatest(0, (r + z * z / 2 / n - z * sqrt(r * (1 - r) / n + z * z / 4 / n / n)) / (1 + z * z / n))', 'observed_rate_ci_lower')}, {r6('least(1, (r + z * z / 2 / n + z * sqrt(r * (1 - r) / n + z * z / 4 / n / n)) / (1 + z * z / n))', 'observed_rate_ci_upper')}, {r6('abs(r - m)', 'absolute_gap')}, n < 30 AS sparse FROM w""")
def calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calibrate.calibration_curve(_probabilities(spark, d)))


@query(f"WITH {_P}, {bands_sql('p', 'p', 10, 'ASC', 'bin')}, g AS (SELECT count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM bins GROUP BY bin) SELECT (SELECT count(*) FROM p) AS n, {r6('(SELECT avg((p - y) ** 2) FROM p)', 'brier_score')}, {r6('sum(n * gap) / sum(n)', 'expected_calibration_error')}, count(*) AS effective_bins FROM g")
def calibration_scores(spark: SparkSession, d: str) -> DataFrame:
    m = calibrate.assess_calibration(_probabilities(spark, d), "p", "y", key=["custkey"], assume_probabilities=True, n_bootstrap=0).metrics
    return rows(spark, [m | {"n": m["evaluation_sample_size"]}], "n long, brier_score double, expected_calibration_error double, effective_bins long")


@query()
def calibration_models(spark: SparkSession, d: str) -> DataFrame:
    b = buyers(spark, d)
    found = [calibrate.fit_calibrator(b, "n_orders", "again", method=m) for m in ("logistic", "isotonic")]
    return rows(spark, [{"method": m.method, "intercept": m.intercept, "slope": m.slope, "steps": len(m.thresholds), "n": m.n} for m in found], "method string, intercept double, slope double, steps long, n long")


@query(f"""WITH {BUYERS}, g AS (SELECT n_orders AS x, count(*)::DOUBLE AS n, sum(again)::DOUBLE AS k FROM buyers GROUP BY n_orders), c AS (SELECT x, sum(n) OVER w AS cn, sum(k) OVER w AS ck, n, k FROM g WINDOW w AS (ORDER BY x)),
    spans AS (SELECT a.x AS low, b.x AS high, (b.ck - a.ck + a.k) / (b.cn - a.cn + a.n) AS rate FROM c a JOIN c b ON a.x <= b.x),
    fits AS (SELECT x, max(least_rate) AS value FROM (SELECT g.x, low, min(rate) AS least_rate FROM g JOIN spans ON low <= g.x AND high >= g.x GROUP BY g.x, low) GROUP BY x)
    SELECT {r6('min(x)', 'threshold')}, {r6('any_value(value)', 'probability')} FROM fits GROUP BY round(value, 9)""")  # the fit is the largest of smallest means over spans
def calibration_isotonic(spark: SparkSession, d: str) -> DataFrame:
    m = calibrate.fit_calibrator(buyers(spark, d), "n_orders", "again", method="isotonic")
    return rows(spark, [{"threshold": t, "probability": v} for t, v in zip(m.thresholds, m.values, strict=True)], "threshold double, probability double")


@query()
def calibration_holdout(spark: SparkSession, d: str) -> DataFrame:
    m = calibrate.fit_and_assess_calibration(buyers(spark, d), "n_orders", "again", key=["custkey"], n_bootstrap=500).metrics
    return rows(spark, [m], "evaluation_sample_size long, fit_sample_size long, brier_score double, brier_ci_lower double, brier_ci_upper double, calibration_slope double")


# --- monitoring ---------------------------------------------------------------------------------

_QUARTERS = ", ".join(str(min(1.0, k * 0.1)) for k in range(11))
_MONITOR = f"""base AS (SELECT {', '.join(LINE)} FROM lineitem WHERE year(l_shipdate) <= 1996), batch AS (SELECT {', '.join(LINE)} FROM lineitem WHERE year(l_shipdate) = 2000),
    cuts AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, list_sort(list_distinct(quantile_cont({c}, [{_QUARTERS}])))[2:-2] AS cuts FROM base" for c in LINE)}),
    long AS (SELECT 'base' AS w, c, v FROM (UNPIVOT base ON COLUMNS(*) INTO NAME c VALUE v) UNION ALL SELECT 'batch', c, v FROM (UNPIVOT batch ON COLUMNS(*) INTO NAME c VALUE v)),
    bins AS (SELECT w, c, len(list_filter(cuts, lambda x: x <= v)) AS bin, count(*) AS n FROM long JOIN cuts USING (c) GROUP BY ALL)"""


def _monitored(spark: SparkSession, d: str) -> tuple[monitor.MonitoringBaseline, DataFrame]:
    df = line(spark, d)
    base = monitor.create_monitoring_baseline(df.where("yr <= 1996"), LINE[:3], score_id="tax", score_version="1", score="l_tax", outcome="l_linestatus")
    return base, df.where("yr = 2000").drop("yr", "l_returnflag")


_PSI = f"""spine AS (SELECT c, unnest(range(0, len(cuts) + 1)) AS bin FROM cuts), t AS (SELECT w, c, sum(n) AS t FROM bins GROUP BY ALL),
    pq AS (SELECT s.c, greatest(coalesce(a.n, 0) / ta.t, 1e-4) AS p, greatest(coalesce(b.n, 0) / tb.t, 1e-4) AS q FROM spine s LEFT JOIN bins a ON a.w = 'base' AND a.c = s.c AND a.bin = s.bin LEFT JOIN bins b ON b.w = 'batch' AND b.c = s.c AND b.bin = s.bin JOIN t ta ON ta.w = 'base' AND ta.c = s.c JOIN t tb ON tb.w = 'batch' AND tb.c = s.c),
    psi AS (SELECT c, sum((q - p) * ln(q / p)) AS psi FROM pq GROUP BY c)"""


@query(f"WITH {_MONITOR}, {_PSI} SELECT c AS indicator, {r6('psi', 'psi')} FROM psi")
def monitor_psi(spark: SparkSession, d: str) -> DataFrame:
    base, batch = _monitored(spark, d)
    found = monitor.monitor_batch(base, batch, score="l_tax", outcome="l_linestatus", key=LINE_KEY)
    return rows(spark, [*found["indicator_drift"].details, {"indicator": "l_tax", "psi": found["score_drift"].metrics["psi"]}], "indicator string, psi double")


def _graded(value: str, warning: float, failure: float) -> str:
    return f"CASE WHEN {value} >= {failure} THEN 'failure' WHEN {value} >= {warning} THEN 'warning' ELSE 'informational' END"


@query(f"""WITH {_MONITOR}, {_PSI},
    own AS (SELECT 'base' AS w, l_tax AS v, (l_linestatus = 'O')::INT AS y FROM lineitem WHERE year(l_shipdate) <= 1996 UNION ALL SELECT 'batch', l_tax, (l_linestatus = 'O')::INT FROM lineitem WHERE year(l_shipdate) = 2000),
    areas AS (SELECT w, {auc_sql()} AS auc FROM (SELECT *, {midrank_sql('v', 'w')} AS mr FROM own) GROUP BY w),
    e AS (SELECT max(greatest(auc, 1 - auc)) FILTER (w = 'base') AS old, max(greatest(auc, 1 - auc)) FILTER (w = 'batch') AS new FROM areas),
    v AS (SELECT (SELECT count(*) FROM batch) AS n, (SELECT count(*) FROM batch) / (SELECT count(*) FROM base) AS share),
    gone AS (SELECT max(b) AS new, max(b - a) AS more FROM ({' UNION ALL '.join(f"SELECT (SELECT avg(({c} IS NULL)::INT) FROM base) AS a, (SELECT avg(({c} IS NULL)::INT) FROM batch) AS b" for c in LINE[:3])}))
    SELECT 'schema' AS "check", 'informational' AS state, 'the columns match' AS summary
    UNION ALL SELECT 'volume', CASE WHEN share < 0.1 OR share > 10 THEN 'failure' WHEN share < 0.5 OR share > 2 THEN 'warning' ELSE 'informational' END, printf('%d rows, %.2f of the baseline', n, share) FROM v
    UNION ALL SELECT 'score_drift', {_graded('psi', 0.1, 0.25)}, printf('PSI %.3f', psi) FROM psi WHERE c = 'l_tax'
    UNION ALL SELECT 'indicator_drift', {_graded('max(psi)', 0.1, 0.25)}, printf('largest PSI %.3f', max(psi)) FROM psi WHERE c <> 'l_tax'
    UNION ALL SELECT 'missingness', CASE WHEN new > 0.2 THEN 'failure' WHEN more >= 0.05 THEN 'warning' ELSE 'informational' END, printf('largest rate %.3f', new) FROM gone
    UNION ALL SELECT 'outcome_performance', CASE WHEN new < 0.55 OR old - new >= 0.1 THEN 'failure' WHEN new < 0.65 OR old - new >= 0.05 THEN 'warning' ELSE 'informational' END, printf('oriented AUC %.3f', new) FROM e""")
def monitor_states(spark: SparkSession, d: str) -> DataFrame:
    base, batch = _monitored(spark, d)
    found = monitor.monitor_batch(base, batch, score="l_tax", outcome="l_linestatus", key=LINE_KEY)
    return spark.createDataFrame([(c.name, c.state.value, c.summary) for c in found.checks], "check string, state string, summary string")


# --- survival -----------------------------------------------------------------------------------

_LIVES = "lives AS (SELECT user_id, min(ts) AS a, min(ts) FILTER (event_type = 'purchase') AS b, max(ts) AS z FROM events GROUP BY user_id), s AS (SELECT user_id, greatest(1, ceil((epoch(coalesce(b, z)) - epoch(a)) / 21600))::DOUBLE AS time, b IS NOT NULL AND user_id % 3 <> 0 AS event, (user_id % 17)::DOUBLE AS risk FROM lives)"


def _lives(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("b"), F.max("ts").alias("z"))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    time = F.greatest(F.lit(1.0), F.ceil((seconds(F.coalesce("b", "z")) - seconds(F.col("a"))) / 21600).cast("double"))
    return per.select("user_id", time.alias("time"), (F.col("b").isNotNull() & (F.col("user_id") % 3 != 0)).alias("event"), (F.col("user_id") % 17).cast("double").alias("risk"))


_SETS = "k AS (SELECT time, count(*) AS n, count(*) FILTER (event) AS events, count(*) FILTER (NOT event) AS censored, sum(count(*)) OVER (ORDER BY time DESC)::BIGINT AS at_risk FROM s GROUP BY time), g AS (SELECT *, coalesce(exp(sum(CASE WHEN at_risk - events > censored THEN ln(1 - censored / (at_risk - events)) ELSE 0 END) OVER (ORDER BY time)) * min(CASE WHEN at_risk - events > 0 AND at_risk - events <= censored THEN 0 ELSE 1 END) OVER (ORDER BY time), 1) AS g FROM k)"


@query(f"WITH {_LIVES}, {_SETS} SELECT time, n, events, censored, at_risk FROM k")
def survival_risk_sets(spark: SparkSession, d: str) -> DataFrame:
    return survival.risk_sets(_lives(spark, d))


@query(f"WITH {_LIVES}, {_SETS} SELECT time, {r6('g', 'g')} FROM g")
def survival_censoring(spark: SparkSession, d: str) -> DataFrame:
    lives = _lives(spark, d)
    return rounded(survival.censoring_curve(lives, lives))


_HORIZON = "(SELECT quantile_disc(time, 0.5) FROM s)"


def _weighted(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    lives = _lives(spark, d)
    h = lives.select(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY time)")).first()[0]
    return lives.join(survival.censoring_curve(lives, lives), "time"), h


@query(f"""WITH {_LIVES}, {_SETS}, w AS (SELECT s.*, g FROM s JOIN g USING (time)), p AS (SELECT x.g AS g, x.risk AS r, y.risk AS q FROM w x JOIN w y ON x.event AND x.time <= {_HORIZON} AND y.time > {_HORIZON})
    SELECT {r6('sum((CASE WHEN r > q THEN 1 WHEN r = q THEN 0.5 ELSE 0 END) / g) / sum(1 / g)', 'cumulative_dynamic_auc')}, (SELECT count(*) FROM s WHERE event AND time <= {_HORIZON}) AS cases, (SELECT count(*) FROM s WHERE time > {_HORIZON}) AS controls FROM p""")
def survival_dynamic_auc(spark: SparkSession, d: str) -> DataFrame:
    lives, h = _weighted(spark, d)
    return rounded(survival.dynamic_auc(lives, [h]).select("cumulative_dynamic_auc", "cases", "controls"))


@query(f"""WITH {_LIVES}, {_SETS}, w AS (SELECT s.*, g FROM s JOIN g USING (time)), p AS (SELECT 1 / (x.g * x.g) AS v, x.risk AS r, y.risk AS q FROM w x JOIN w y ON x.event AND x.time < {_HORIZON} AND (y.time > x.time OR (y.time = x.time AND NOT y.event)))
    SELECT {r6('sum(v * CASE WHEN r > q THEN 1 WHEN r = q THEN 0.5 ELSE 0 END) / sum(v)', 'concordance')}, count(*) FILTER (r > q) AS concordant_pairs, count(*) FILTER (r < q) AS discordant_pairs, count(*) FILTER (r = q) AS tied_risk_pairs FROM p""")
def survival_concordance(spark: SparkSession, d: str) -> DataFrame:
    lives, h = _weighted(spark, d)
    return rows(spark, [survival.concordance(lives, h)], "concordance double, concordant_pairs long, discordant_pairs long, tied_risk_pairs long")


@query(f"WITH {_LIVES}, {_SETS}, w AS (SELECT s.*, g, 0.6 AS p FROM s JOIN g USING (time)), h AS (SELECT {_HORIZON} AS h, (SELECT g FROM g WHERE time = {_HORIZON}) AS gh) SELECT count(*) AS n, {r6('avg(CASE WHEN time <= h AND event THEN p * p / g WHEN time > h THEN (1 - p) * (1 - p) / gh ELSE 0 END)', 'brier_score')} FROM w, h")
def survival_brier(spark: SparkSession, d: str) -> DataFrame:
    lives, h = _weighted(spark, d)
    at = lives.where(F.col("time") == h).select("g").first()[0]
    term = survival.brier_terms(F.lit(0.6), F.col("time"), F.col("event"), F.col("g"), at, h)
    return rounded(lives.agg(F.count(F.lit(1)).alias("n"), F.avg(term).alias("brier_score")))


# --- models and whole audits --------------------------------------------------------------------


def _audit_sql() -> str:
    a, b, c = LINE[:3]
    of = {x: [o for o in LINE[:3] if o != x] for x in LINE[:3]}
    r = lambda x, o: f"r_{min(x, o)}_{max(x, o)}"
    pairs = [(a, b), (a, c), (b, c)]
    z = ", ".join(f"({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER () AS z_{x}" for x in of)
    numbers = [f"corr({x}, {o}) AS {r(x, o)}" for x, o in pairs] + [f"corr({x}, (z_{o} + z_{q}) / 2) AS rest_{x}, stddev_pop({x}) AS std_{x}, avg(({x} IS NULL)::INT) AS gone_{x}, abs(corr({x}, v)) AS close_{x}" for x, (o, q) in of.items()]
    notes = []
    for i, (x, (o, q)) in enumerate(of.items()):
        vif = f"1 / (1 - ({r(x, o)} ** 2 + {r(x, q)} ** 2 - 2 * {r(x, o)} * {r(x, q)} * {r(o, q)}) / (1 - {r(o, q)} ** 2))"
        notes += [(i, True, f"std_{x} = 0", f"'{x} is constant'"), (10 + 3 * i, False, f"gone_{x} > 0.2", f"printf('{x} is missing in %.1f%% of rows', 100 * gone_{x})"), (11 + 3 * i, False, f"abs(rest_{x}) < 0.1", f"printf('{x} hardly agrees with the others (%.2f)', rest_{x})"), (12 + 3 * i, False, f"{vif} > 10", f"printf('{x} has a variance inflation of %.1f', {vif})")]
        notes.append((50 + i, False, f"close_{x} >= 0.95", f"printf('{x} alone nearly is the score (%.2f)', close_{x})"))
    alpha = f"1.5 * (1 - 3 / (3 + 2 * ({' + '.join(r(x, o) for x, o in pairs)})))"
    notes.append((30, False, f"{alpha} < 0.7", f"printf('alpha is %.2f', {alpha})"))
    notes += [(40 + i, False, f"abs({r(x, o)}) >= 0.9", f"printf('{x} and {o} correlate at %.2f', {r(x, o)})") for i, (x, o) in enumerate(pairs)]
    found = " UNION ALL ".join(f"SELECT {k} AS k, {bad} AS bad, CASE WHEN {when} THEN {text} END AS note FROM num" for k, bad, when, text in notes)
    verdict = "CASE WHEN count(note) FILTER (bad) > 0 THEN 'fail' WHEN count(note) > 0 THEN 'warn' ELSE 'pass' END"
    deciles = ", ".join(str(min(1.0, k * 0.1)) for k in range(11))
    return f"""WITH l AS (SELECT {a}, {b}, {c}, l_tax AS v, (l_linestatus = 'O')::INT AS y, l_returnflag AS s, year(l_shipdate)::INT AS yr FROM lineitem), z AS (SELECT *, {z} FROM l), num AS (SELECT {', '.join(numbers)} FROM z), notes AS ({found}),
    cuts AS (SELECT list_sort(list_distinct(quantile_cont(v, [{deciles}])))[2:-2] AS c FROM l WHERE yr = (SELECT min(yr) FROM l)), bins AS (SELECT yr, len(list_filter(c, lambda x: x <= v)) AS bin, count(*) AS n FROM l, cuts GROUP BY ALL), t AS (SELECT yr, sum(n) AS t FROM bins GROUP BY yr),
    base AS (SELECT bin, n / sum(n) OVER () AS p FROM bins WHERE yr = (SELECT min(yr) FROM l)), spine AS (SELECT yr, t, unnest(range(0, (SELECT len(c) + 1 FROM cuts))) AS bin FROM t WHERE yr > (SELECT min(yr) FROM l)),
    pq AS (SELECT s.yr, s.t, greatest(coalesce(p, 0), 1e-4) AS p, greatest(coalesce(n, 0) / s.t, 1e-4) AS q FROM spine s LEFT JOIN bins x ON x.yr = s.yr AND x.bin = s.bin LEFT JOIN base ON base.bin = s.bin),
    psi AS (SELECT yr, sum((q - p) * ln(q / p)) AS psi FROM pq GROUP BY yr HAVING any_value(t) >= 50), top AS (SELECT max(psi) AS psi, arg_max(yr, psi) AS yr FROM psi),
    whole AS (SELECT {auc_sql()} AS auc FROM (SELECT y, {midrank_sql('v')} AS mr FROM l)),
    leaks AS (SELECT name, greatest(auc, 1 - auc) >= 0.9 AS leak FROM (SELECT name, {auc_sql()} AS auc FROM (SELECT name, y, {midrank_sql('x', 'name')} AS mr FROM ({' UNION ALL '.join(f"SELECT '{x}' AS name, y, {x} AS x FROM l" for x in of)})) GROUP BY name)),
    levels AS (SELECT s, count(*) AS n, avg(v) AS m, stddev_samp(v) AS sd FROM l GROUP BY s), pooled AS (SELECT *, sqrt(sum((n - 1) * sd * sd) OVER () / (sum(n) OVER () - count(*) OVER ())) AS w, (sum(n * m) OVER () - n * m) / (sum(n) OVER () - n) AS rest FROM levels),
    valid AS (SELECT s, sum(y) AS p, count(*) AS n, {auc_sql()} AS auc FROM (SELECT s, y, {midrank_sql('v', 's')} AS mr FROM l) GROUP BY s),
    seg AS (SELECT s, n, abs((m - rest) / w) AS smd, n >= 30 AS large, n >= 30 AND least(p, n - p) >= 10 AS fair, CASE WHEN (SELECT auc FROM whole) < 0.5 THEN 1 - auc ELSE auc END AS validity FROM pooled JOIN valid USING (s, n)),
    marks AS (SELECT 'a' || s AS k, TRUE AS bad, CASE WHEN fair AND validity <= 0.5 THEN 'the score doesn''t work in ' || s END AS note FROM seg
        UNION ALL SELECT 'b0', FALSE, CASE WHEN bool_and(large) THEN NULL ELSE printf('%d segments are small', count(*) FILTER (NOT large)) END FROM seg
        UNION ALL SELECT 'b1', FALSE, CASE WHEN max(smd) FILTER (large) > 0.5 THEN printf('score levels differ by up to %.2f standard deviations', max(smd) FILTER (large)) END FROM seg
        UNION ALL SELECT 'b2', FALSE, CASE WHEN count(*) FILTER (large AND NOT fair) > 0 THEN printf('validity can''t be assessed in %d segments', count(*) FILTER (large AND NOT fair)) END FROM seg
        UNION ALL SELECT 'b3', FALSE, CASE WHEN count(*) FILTER (fair) < 2 THEN 'fewer than two segments can be compared' WHEN max(validity) FILTER (fair) - min(validity) FILTER (fair) > 0.1 THEN printf('validity differs by %.2f between segments', max(validity) FILTER (fair) - min(validity) FILTER (fair)) END FROM seg)
    SELECT 'indicators' AS "check", {verdict} AS status, coalesce(string_agg(note, '; ' ORDER BY bad DESC, k), 'the indicators are sound') AS summary FROM notes
    UNION ALL SELECT 'stability', CASE WHEN psi >= 0.25 THEN 'fail' WHEN psi >= 0.1 THEN 'warn' ELSE 'pass' END, printf('the largest shift is %.3f, in %d', psi, yr) FROM top
    UNION ALL SELECT 'downstream', CASE WHEN greatest(auc, 1 - auc) < 0.55 THEN 'fail' WHEN greatest(auc, 1 - auc) < 0.65 THEN 'warn' ELSE 'pass' END, printf('oriented AUC %.3f', greatest(auc, 1 - auc)) FROM whole
    UNION ALL SELECT 'leakage', CASE WHEN bool_or(leak) THEN 'fail' ELSE 'pass' END, coalesce('too close to the outcome: ' || string_agg(name, ', ' ORDER BY name) FILTER (leak), 'no sign of leakage') FROM leaks
    UNION ALL SELECT 'segments', {verdict}, coalesce(string_agg(note, '; ' ORDER BY bad DESC, k), 'segments agree') FROM marks"""


@query(_audit_sql())
def score_audit(spark: SparkSession, d: str) -> DataFrame:
    report = ScoreAudit(line(spark, d), LINE[:3], "l_tax", "l_linestatus", "l_returnflag", "yr", Thresholds(max_audit_rows=None)).run()
    return spark.createDataFrame([(c.name, c.status.value, c.summary) for c in report.checks], "check string, status string, summary string")


_STATES = "CASE WHEN n = 0 OR p = 0 OR p = n OR n < 30 OR least(p, n - p) < 10 THEN 'skip' WHEN effect < 0.55 THEN 'fail' WHEN effect < 0.65 THEN 'warn' ELSE 'pass' END AS downstream_status, CASE WHEN n < 10 OR p = 0 OR p = n THEN 'skip' WHEN effect >= 0.9 THEN 'fail' ELSE 'pass' END AS leakage_status"


@query(f"""WITH {SCORED}, long AS (SELECT 'quality' AS outcome, 'required' AS importance, n_chars AS v, quality AS y FROM scored UNION ALL SELECT 'toxic', 'supporting', n_chars, toxic FROM scored),
    r AS (SELECT outcome, y, {midrank_sql('v', 'outcome')} AS mr FROM long WHERE v IS NOT NULL AND y IS NOT NULL), a AS (SELECT outcome, count(*) AS n, sum(y) AS p, {auc_sql()} AS auc FROM r GROUP BY outcome), e AS (SELECT *, greatest(auc, 1 - auc) AS effect FROM a)
    SELECT outcome, importance, 'binary' AS outcome_type, (SELECT count(*) FROM scored) AS input_rows, (SELECT count(*) FROM scored) AS mature_rows, n AS evaluation_rows, {_STATES} FROM e JOIN (SELECT DISTINCT outcome, importance FROM long) USING (outcome)""")  # a fifth of the score as indicator has the score's own area
def multi_outcome(spark: SparkSession, d: str) -> DataFrame:
    df = scored_docs(spark, d).withColumn("size", F.col("n_chars") / F.lit(5.0))
    report = validate_outcomes(df, "n_chars", ["size"], {"quality": OutcomeSpec("quality", "binary"), "toxic": OutcomeSpec("toxic", "binary", importance="supporting")})
    return rows(spark, report.summary, "outcome string, importance string, outcome_type string, input_rows long, mature_rows long, evaluation_rows long, downstream_status string, leakage_status string")


@query()
def pca_loading_drift(spark: SparkSession, d: str) -> DataFrame:
    df = line(spark, d)
    found = pca_drift.assess_pca_loading_drift(PCAScore().fit(df.where("yr <= 1996"), LINE), df.where("yr = 2000"), key=LINE_KEY, n_bootstrap=500)
    return rows(spark, found.loadings, "indicator string, baseline_loading double, current_loading double, abs_loading_delta double, current_loading_ci_lower double, current_loading_ci_upper double")


@query()
def construct_validity(spark: SparkSession, d: str) -> DataFrame:
    found = assess_construct_validity(line(spark, d), {"amount": LINE[:2], "rates": LINE[2:]}, key=LINE_KEY, n_bootstrap=500)
    return rows(spark, found.ave, "construct string, indicators long, ave double, ci_lower double, ci_upper double, meets_threshold boolean")


@query()
def measurement_invariance(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    df = line(spark, d).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    mix = df.select("l_linestatus", (F.col("l_quantity") + F.col("a")).alias("x1"), (F.col("l_quantity") - F.col("l_tax") * 50).alias("x2"), (F.col("l_quantity") + F.col("l_discount") * 100).alias("x3"), (F.col("a") + F.col("l_tax") * 100).alias("x4"))
    found = assess_measurement_invariance(mix, "l_linestatus", {"f": ["x1", "x2", "x3", "x4"]})
    return rows(spark, found.levels, "level string, chi_square double, df long, cfi double, rmsea double, srmr double, supported boolean")
