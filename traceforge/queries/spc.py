"""Process-control queries."""

from pyspark.sql import functions as F

from traceforge.operators import prep, spc
from traceforge.queries.base import RESULTS, query, results, rounded

LONG = f"""{RESULTS}, points AS (SELECT campaign_name, 'avg_price' AS parameter, test_timestamp, test_id, avg_price AS value FROM results),
  o AS (SELECT *, row_number() OVER w - 1 AS i, abs(value - lag(value) OVER w) AS mr FROM points WINDOW w AS (PARTITION BY campaign_name, parameter ORDER BY test_timestamp, test_id)),
  lim AS (SELECT campaign_name, parameter, count(*) AS n, avg(value) AS cl, avg(mr) AS mr_bar, avg(mr) / 1.128::DOUBLE AS sigma FROM o GROUP BY ALL HAVING count(*) >= 2)"""
SPEC = "spec AS (SELECT 'avg_price' AS parameter, 20.0::DOUBLE AS lsl, 480.0::DOUBLE AS usl, 250.0::DOUBLE AS target)"


def points(spark, sf):
    return prep.results_long(results(spark, sf), ["avg_price"])


def specs(spark):
    return spc.spec_table(spark, [("avg_price", 20.0, 480.0, 250.0)])


@query("c1_imr_limits", f"WITH {LONG} SELECT campaign_name, parameter, n, round(cl, 8) AS cl, round(mr_bar, 8) AS mr_bar, round(sigma, 8) AS sigma, round(cl + 3 * sigma, 8) AS ucl, round(cl - 3 * sigma, 8) AS lcl, round(3.267::DOUBLE * mr_bar, 8) AS mr_ucl, 0.0::DOUBLE AS mr_lcl FROM lim")
def c1(spark, sf):
    return rounded(spc.imr_limits(points(spark, sf)), 8)


@query("c2_xbar_r_limits", f"""WITH {LONG}, g AS (SELECT campaign_name, parameter, i // 5 AS g, avg(sqrt(value)) AS mean, max(sqrt(value)) - min(sqrt(value)) AS rng FROM o GROUP BY ALL HAVING count(*) = 5),
  k AS (SELECT campaign_name, parameter, count(*) AS groups, avg(mean) AS cl, avg(rng) AS r_bar FROM g GROUP BY ALL HAVING count(*) >= 2)
  SELECT campaign_name, parameter, groups, round(cl, 8) AS cl, round(r_bar, 8) AS r_bar, round(cl + 0.577::DOUBLE * r_bar, 8) AS ucl, round(cl - 0.577::DOUBLE * r_bar, 8) AS lcl, round(0.577::DOUBLE * r_bar / 3, 8) AS zone, round(2.114::DOUBLE * r_bar, 8) AS r_ucl, round(0 * r_bar, 8) AS r_lcl FROM k""")
def c2(spark, sf):
    return rounded(spc.xbar_r_limits(points(spark, sf).withColumn("value", F.sqrt("value"))), 8)


def rolled(k, c):
    return f"sum(({c})::INT) OVER (PARTITION BY campaign_name, parameter ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


RULES = f"""z AS (SELECT o.*, CASE WHEN sigma > 0 THEN (value - cl) / sigma ELSE 0 END AS z, sign(value - lag(value) OVER (PARTITION BY campaign_name, parameter ORDER BY i)) AS step FROM o JOIN lim USING (campaign_name, parameter)),
  t AS (SELECT *, coalesce(step * lag(step) OVER (PARTITION BY campaign_name, parameter ORDER BY i) < 0, false) AS turn FROM z),
  r AS (SELECT campaign_name, parameter, test_id, i, concat_ws(',', CASE WHEN abs(z) > 3 THEN 'beyond_3_sigma' END,
    CASE WHEN i >= 2 AND ({rolled(3, 'z > 2')} >= 2 OR {rolled(3, 'z < -2')} >= 2) THEN '2_of_3_beyond_2_sigma' END,
    CASE WHEN i >= 4 AND ({rolled(5, 'z > 1')} >= 4 OR {rolled(5, 'z < -1')} >= 4) THEN '4_of_5_beyond_1_sigma' END,
    CASE WHEN i >= 7 AND ({rolled(8, 'z > 0')} = 8 OR {rolled(8, 'z < 0')} = 8) THEN '8_same_side' END,
    CASE WHEN i >= 5 AND ({rolled(5, 'step > 0')} = 5 OR {rolled(5, 'step < 0')} = 5) THEN '6_trend' END,
    CASE WHEN i >= 13 AND {rolled(12, 'turn')} = 12 THEN '14_alternating' END) AS rules FROM t)"""


@query("c3_c8_run_rules", f"WITH {LONG}, {RULES} SELECT campaign_name, parameter, test_id, i, rules FROM r")
def c3(spark, sf):
    return spc.run_rules(points(spark, sf)).select("campaign_name", "parameter", "test_id", "i", F.array_join("rules", ",").alias("rules"))


CAP = f"""{SPEC}, g AS (SELECT campaign_name, parameter, avg(value) AS mean, stddev_samp(value) AS s, avg(mr) AS mr_bar FROM o GROUP BY ALL HAVING count(*) >= 2),
  c AS (SELECT g.*, lsl, usl, target, CASE WHEN mr_bar > 0 THEN mr_bar / 1.128::DOUBLE ELSE s END AS w FROM g JOIN spec USING (parameter)),
  d AS (SELECT *, (usl - lsl) / (6 * w) AS cp, least((usl - mean) / (3 * w), (mean - lsl) / (3 * w)) AS cpk, (usl - lsl) / (6 * s) AS pp, least((usl - mean) / (3 * s), (mean - lsl) / (3 * s)) AS ppk, (usl - lsl) / (6 * sqrt(s * s + pow(mean - target, 2))) AS cpm FROM c)"""


@query("c4_capability", f"WITH {LONG}, {CAP} SELECT campaign_name, parameter, round(cp, 8) AS cp, round(cpk, 8) AS cpk, round(pp, 8) AS pp, round(ppk, 8) AS ppk, round(cpm, 8) AS cpm, round(3 * cpk, 8) AS sigma_level, CASE WHEN cpk >= 1.67 THEN 'excellent' WHEN cpk >= 1.33 THEN 'capable' WHEN cpk >= 1 THEN 'marginal' ELSE 'not capable' END AS verdict FROM d WHERE s IS NOT NULL")
def c4(spark, sf):
    return rounded(spc.capability(points(spark, sf), specs(spark)).select("campaign_name", "parameter", "cp", "cpk", "pp", "ppk", "cpm", "sigma_level", "verdict"), 8)


TREND = """tr AS (SELECT campaign_name, parameter, count(*) AS n, regr_slope(value, i::DOUBLE) AS slope, regr_r2(value, i::DOUBLE) AS r2, max(value) - min(value) AS span FROM o GROUP BY ALL HAVING count(*) >= 6)"""


@query("c5_trend", f"WITH {LONG}, {TREND} SELECT campaign_name, parameter, n, round(slope, 8) AS slope, round(r2, 8) AS r2, coalesce(r2 > 0.001::DOUBLE AND abs(slope * n / span) > 0.01::DOUBLE, false) AS has_trend FROM tr")
def c5(spark, sf):
    return rounded(spc.trend(points(spark, sf), 0.001, 0.01).select("campaign_name", "parameter", "n", "slope", "r2", "has_trend"), 8)


CUSUM = """s AS (SELECT o.*, value - cl AS off, CASE WHEN sigma > 0 THEN sigma ELSE 1 END AS sigma FROM o JOIN lim USING (campaign_name, parameter)),
  c AS (SELECT campaign_name, parameter, i, test_id, sigma, greatest(0.0::DOUBLE, off - 0.5 * sigma) AS cp, greatest(0.0::DOUBLE, -off - 0.5 * sigma) AS cm FROM s WHERE i = 0
    UNION ALL SELECT s.campaign_name, s.parameter, s.i, s.test_id, s.sigma, greatest(0.0::DOUBLE, c.cp + s.off - 0.5 * s.sigma), greatest(0.0::DOUBLE, c.cm - s.off - 0.5 * s.sigma) FROM c JOIN s ON s.campaign_name = c.campaign_name AND s.parameter = c.parameter AND s.i = c.i + 1)"""


@query("c6_cusum", f"WITH RECURSIVE {LONG}, {CUSUM} SELECT campaign_name, parameter, test_id, round(cp, 5) AS c_plus, round(cm, 5) AS c_minus, cp > 5 * sigma OR cm > 5 * sigma AS signal FROM c")
def c6(spark, sf):
    return rounded(spc.cusum(points(spark, sf)).select("campaign_name", "parameter", "test_id", "c_plus", "c_minus", "signal"), 5)


EWMA = """e AS (SELECT campaign_name, parameter, i, test_id, 0.2::DOUBLE * value + 0.8::DOUBLE * cl AS z FROM o JOIN lim USING (campaign_name, parameter) WHERE i = 0
    UNION ALL SELECT o.campaign_name, o.parameter, o.i, o.test_id, 0.2::DOUBLE * o.value + 0.8::DOUBLE * e.z FROM e JOIN o ON o.campaign_name = e.campaign_name AND o.parameter = e.parameter AND o.i = e.i + 1)"""


@query("c7_ewma", f"WITH RECURSIVE {LONG}, {EWMA} SELECT campaign_name, parameter, test_id, round(z, 5) AS ewma, abs(z - cl) > 3 * sigma * sqrt(0.2::DOUBLE / 1.8::DOUBLE * (1 - pow(0.8::DOUBLE, 2 * (i + 1)))) AS signal FROM e JOIN lim USING (campaign_name, parameter)")
def c7(spark, sf):
    return rounded(spc.ewma(points(spark, sf)).select("campaign_name", "parameter", "test_id", "ewma", "signal"), 5)


@query("c9_campaign_spc", f"""WITH {LONG}, {RULES}, {CAP}, {TREND}, v AS (SELECT campaign_name, parameter, count(*) AS n, count_if(rules <> '') AS n_out FROM r GROUP BY ALL)
  SELECT campaign_name, parameter, round(cl, 8) AS cl, CAST(n_out AS BIGINT) AS n_out, round(tr.slope, 8) AS slope, round(cpk, 8) AS cpk FROM lim JOIN v USING (campaign_name, parameter) LEFT JOIN tr USING (campaign_name, parameter) LEFT JOIN d USING (campaign_name, parameter)""")
def c9(spark, sf):
    df = spc.campaign_spc(points(spark, sf), specs(spark))
    return df.select("campaign_name", "parameter", F.round("cl", 8).alias("cl"), "n_out", F.round("slope", 8).alias("slope"), F.round("cpk", 8).alias("cpk"))


@query("c10_violations", f"WITH {LONG}, {RULES} SELECT campaign_name, parameter, count(*) AS n, CAST(count_if(rules <> '') AS BIGINT) AS n_out, round(count_if(rules <> '') / count(*), 8) AS rate FROM r GROUP BY ALL")
def c10(spark, sf):
    return rounded(spc.violations(spc.run_rules(points(spark, sf))), 8)


@query("c11_overall_capability", f"WITH {LONG}, {CAP} SELECT campaign_name, parameter, round(pp, 8) AS cp, round(ppk, 8) AS cpk FROM d")
def c11(spark, sf):
    return rounded(spc.overall_capability(points(spark, sf), specs(spark)).select("campaign_name", "parameter", "cp", "cpk"), 8)
