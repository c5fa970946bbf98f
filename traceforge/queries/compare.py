"""Comparison, regression and envelope queries."""

from pyspark.sql import functions as F

from traceforge.operators import compare, prep
from traceforge.queries.base import RESULTS, query, results, rounded, table

LONG = f"""{RESULTS}, lng AS (SELECT campaign_name, test_id, test_timestamp, 'avg_price' AS parameter, avg_price AS value, qc_passed FROM results UNION ALL SELECT campaign_name, test_id, test_timestamp, 'avg_balance', avg_balance, qc_passed FROM results)"""
PERCENT = "CASE WHEN (abs({a}) + abs({b})) / 2 > 1e-10 THEN ({b} - {a}) / ((abs({a}) + abs({b})) / 2) * 100 WHEN {b} = {a} THEN 0 ELSE 'inf'::DOUBLE END"


def long(spark, sf):
    return prep.results_long(results(spark, sf))


def golden(spark):
    return spark.createDataFrame([("avg_price", 250.0, 40.0), ("avg_balance", 4500.0, 60.0)], "parameter string, value double, tol_pct double")


PAIRS = "pairs AS (SELECT o_orderkey AS test_a, o_orderkey + 1 AS test_b FROM orders WHERE o_orderkey % 2 = 0)"
COMPARED = f"""c AS (SELECT test_a, test_b, a.parameter, b.value - a.value AS delta, {PERCENT.format(a='a.value', b='b.value')} AS delta_pct FROM pairs JOIN lng a ON a.test_id = test_a JOIN lng b ON b.test_id = test_b AND b.parameter = a.parameter)"""


def pairs(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderkey") % 2 == 0)
    return o.select(F.col("o_orderkey").alias("test_a"), (F.col("o_orderkey") + 1).alias("test_b"))


def compared(spark, sf):
    tol = spark.createDataFrame([("avg_price", 25.0)], "parameter string, tol_pct double")
    return compare.compare_tests(long(spark, sf), pairs(spark, sf), tol, 5.0)


@query("m1_m2_test_vs_test", f"WITH {LONG}, {PAIRS}, {COMPARED} SELECT test_a, test_b, parameter, round(delta, 8) AS delta, round(delta_pct, 8) AS delta_pct, abs(delta_pct) <= CASE parameter WHEN 'avg_price' THEN 25.0 ELSE 5.0 END AS within, CASE WHEN delta > 0 THEN 'increase' WHEN delta < 0 THEN 'decrease' ELSE 'same' END AS direction FROM c")
def m2(spark, sf):
    return rounded(compared(spark, sf).select("test_a", "test_b", "parameter", "delta", "delta_pct", "within", "direction"), 8)


@query("m2_overall", f"WITH {LONG}, {PAIRS}, {COMPARED}, w AS (SELECT *, abs(delta_pct) <= CASE parameter WHEN 'avg_price' THEN 25.0 ELSE 5.0 END AS within FROM c) SELECT test_a, test_b, count(*) AS n, CAST(count_if(within) AS BIGINT) AS n_within, bool_and(within) AS passed FROM w GROUP BY ALL")
def m2b(spark, sf):
    return compare.overall(compared(spark, sf), "test_a", "test_b")


GOLDEN = "g(parameter, golden, tol_pct) AS (VALUES ('avg_price', 250.0::DOUBLE, 40.0::DOUBLE), ('avg_balance', 4500.0::DOUBLE, 60.0::DOUBLE))"


@query("m3_test_vs_golden", f"WITH {LONG}, {GOLDEN}, c AS (SELECT test_id, parameter, {PERCENT.format(a='golden', b='value')} AS delta_pct, tol_pct FROM lng JOIN g USING (parameter)) SELECT test_id, parameter, round(delta_pct, 8) AS delta_pct, abs(delta_pct) <= tol_pct AS within FROM c")
def m3(spark, sf):
    return rounded(compare.compare_to_golden(long(spark, sf), golden(spark)).select("test_id", "parameter", "delta_pct", "within"), 8)


REFERENCE = "ref AS (SELECT campaign_name, parameter, avg(value) AS value, stddev_samp(value) AS u, count(*) AS n FROM lng GROUP BY ALL HAVING count(*) >= 5), gold AS (SELECT *, CASE WHEN abs(value) > 1e-10 THEN greatest(3 * u / abs(value) * 100, 1.0::DOUBLE) ELSE 10 END AS tol_pct FROM ref)"


@query("m4_golden_from_campaign", f"WITH {LONG}, {REFERENCE} SELECT campaign_name, parameter, round(value, 8) AS value, round(u, 8) AS u, n, round(tol_pct, 8) AS tol_pct FROM gold")
def m4(spark, sf):
    return rounded(compare.golden_from_campaign(long(spark, sf)), 8)


def ols(x, y, source, keys):
    return f"""f AS (SELECT {keys}, count(*) AS n, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy FROM {source} GROUP BY ALL HAVING count(*) >= 3 AND regr_sxx({y}, {x}) >= 1e-10),
  h AS (SELECT *, greatest(0, syy - slope * sxy) AS rest FROM f), fit AS (SELECT *, CASE WHEN syy < 1e-10 THEN 1 ELSE 1 - rest / syy END AS r2, sqrt(rest / (n - 2) / sxx) AS se FROM h)"""


@query("m5_regression", f"WITH {RESULTS}, {ols('avg_balance', 'avg_price', 'results', 'campaign_name')} SELECT campaign_name, n, round(slope, 9) AS slope, round(intercept, 6) AS intercept, round(r2, 8) AS r2, round(se, 9) AS slope_se, round(slope - 2 * se, 9) AS slope_low, round(slope + 2 * se, 9) AS slope_high, round(slope * 1000 + intercept, 6) AS predicted FROM fit")
def m5(spark, sf):
    df = compare.predict(compare.regression(results(spark, sf), "avg_balance", "avg_price", "campaign_name"), F.lit(1000.0))
    return df.select("campaign_name", "n", *[F.round(c, d).alias(c) for c, d in (("slope", 9), ("intercept", 6), ("r2", 8), ("slope_se", 9), ("slope_low", 9), ("slope_high", 9), ("predicted", 6))])


UNPIVOTED = "x AS (SELECT campaign_name, avg_price AS y, 'avg_balance' AS x_name, avg_balance AS x FROM results UNION ALL SELECT campaign_name, avg_price, 'u_price', u_price FROM results)"


@query("m6_multi_regression", f"WITH {RESULTS}, {UNPIVOTED}, {ols('x', 'y', 'x', 'campaign_name, x_name')} SELECT campaign_name, x_name, n, round(slope, 8) AS slope, round(r2, 8) AS r2 FROM fit")
def m6(spark, sf):
    return rounded(compare.multi_regression(results(spark, sf), ["avg_balance", "u_price"], "avg_price", "campaign_name").select("campaign_name", "x_name", "n", "slope", "r2"), 8)


ITEMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MATRIX = "m AS (" + " UNION ALL ".join(f"SELECT l_returnflag, count(*) AS n, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem GROUP BY l_returnflag" for i, a in enumerate(ITEMS) for b in ITEMS[i + 1 :]) + ")"


@query("m7_correlation_matrix", f"WITH {MATRIX} SELECT l_returnflag, n, a, b, round(r, 8) AS r FROM m")
def m7(spark, sf):
    return rounded(compare.correlation_matrix(table(spark, sf, "lineitem"), ITEMS, "l_returnflag"), 8)


@query("m8_strong_pairs", f"WITH {MATRIX} SELECT l_returnflag, n, a, b, round(r, 8) AS r FROM m WHERE abs(r) >= 0.001")
def m8(spark, sf):
    return rounded(compare.strong_pairs(compare.correlation_matrix(table(spark, sf, "lineitem"), ITEMS, "l_returnflag"), 0.001), 8)


@query("m9_deviation_tracking", f"""WITH {LONG}, {REFERENCE}, d AS (SELECT l.campaign_name, l.parameter, (l.value - g.value) / abs(g.value) * 100 AS dev, tol_pct, (row_number() OVER (PARTITION BY l.campaign_name, l.parameter ORDER BY test_timestamp, test_id) - 1)::DOUBLE AS i FROM lng l JOIN gold g USING (campaign_name, parameter)),
  s AS (SELECT campaign_name, parameter, count(*) AS n, count_if(abs(dev) <= tol_pct) AS n_within, avg(dev) AS mean_dev, max(abs(dev)) AS max_dev, regr_slope(dev, i) AS slope, max(dev) - min(dev) AS span FROM d GROUP BY ALL)
  SELECT campaign_name, parameter, n, CAST(n_within AS BIGINT) AS n_within, round(max_dev, 7) AS max_dev, round(slope, 8) AS slope, coalesce(n >= 5 AND abs(slope * n / nullif(span, 0)) > 0.3, false) AS trending FROM s""")
def m9(spark, sf):
    points = long(spark, sf)
    df = compare.track_deviations(points, compare.golden_from_campaign(points))
    return df.select("campaign_name", "parameter", "n", "n_within", F.round("max_dev", 7).alias("max_dev"), F.round("slope", 8).alias("slope"), "trending")


CAMPAIGNS = "st AS (SELECT campaign_name, parameter, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS s FROM lng GROUP BY ALL HAVING count(*) >= 2), pairs AS (SELECT DISTINCT c_mktsegment || '-' || (c_custkey // 100) AS ca, 'BUILDING-' || (c_custkey // 100) AS cb FROM customer WHERE c_mktsegment <> 'BUILDING')"


@query("m10_campaign_vs_campaign", f"""WITH {LONG}, {CAMPAIGNS} SELECT ca AS campaign_a, cb AS campaign_b, a.parameter, round({PERCENT.format(a='a.mean', b='b.mean')}, 7) AS delta_pct, abs({PERCENT.format(a='a.mean', b='b.mean')}) <= 5 AS equivalent, round(CASE WHEN b.s > 1e-10 THEN pow(a.s, 2) / pow(b.s, 2) ELSE 'inf'::DOUBLE END, 7) AS f_ratio
  FROM pairs JOIN st a ON a.campaign_name = ca JOIN st b ON b.campaign_name = cb AND b.parameter = a.parameter""")
def m10(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'")
    k = F.floor(F.col("c_custkey") / 100)
    named = c.select(F.concat("c_mktsegment", F.lit("-"), k).alias("campaign_a"), F.concat(F.lit("BUILDING-"), k).alias("campaign_b")).distinct()
    return rounded(compare.compare_campaigns(long(spark, sf), named).select("campaign_a", "campaign_b", "parameter", "delta_pct", "equivalent", "f_ratio"), 7)


ENVELOPE = "e AS (SELECT campaign_name, parameter, count(*) AS n, min(value) AS lo, max(value) AS hi FROM lng WHERE qc_passed GROUP BY ALL HAVING count(*) >= 2), env AS (SELECT campaign_name, parameter, n, greatest(0.0::DOUBLE, lo - 0.1::DOUBLE * (hi - lo)) AS low, hi + 0.1::DOUBLE * (hi - lo) AS high FROM e)"


def passed(spark, sf):
    return prep.results_long(results(spark, sf).where("qc_passed"))


@query("m11_operating_envelope", f"WITH {LONG}, {ENVELOPE} SELECT campaign_name, parameter, n, round(low, 7) AS low, round(high, 7) AS high FROM env")
def m11(spark, sf):
    return rounded(compare.envelope(passed(spark, sf)), 7)


TIGHT = ENVELOPE.replace("0.1::DOUBLE * (hi - lo)", "-0.05::DOUBLE * (hi - lo)")


@query("m12_in_envelope", f"WITH {LONG}, {TIGHT}, t AS (SELECT campaign_name, test_id, bool_and(value BETWEEN low AND high) AS inside FROM lng JOIN env USING (campaign_name, parameter) GROUP BY ALL) SELECT campaign_name, CAST(count_if(inside) AS BIGINT) AS n_inside, CAST(count_if(NOT inside) AS BIGINT) AS n_outside FROM t GROUP BY ALL")
def m12(spark, sf):
    return compare.in_envelope(long(spark, sf), compare.envelope(passed(spark, sf), -0.05))
