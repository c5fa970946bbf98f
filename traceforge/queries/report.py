"""Reporting queries."""

from pyspark.sql import functions as F

from traceforge.operators import qc, report
from traceforge.queries.base import GAPPED, RESULTS, query, readings, results, rounded
from traceforge.queries.compare import LONG, long

SUMMARY = "SELECT campaign_name, parameter, count(*) AS n, round(avg(value), 7) AS mean, round(stddev_samp(value), 7) AS std, min(value) AS min, max(value) AS max, round(max(value) - min(value), 7) AS range, round(stddev_samp(value) / abs(avg(value)) * 100, 7) AS cv_pct"


@query("r1_r2_campaign_summary", f"WITH {LONG}, spec(parameter, lsl, usl) AS (VALUES ('avg_price', 20.0::DOUBLE, 480.0::DOUBLE)) SELECT s.*, lsl, usl FROM ({SUMMARY.replace('round(avg(value), 7)', 'round(avg(value), 8)')} FROM lng GROUP BY ALL) s LEFT JOIN spec USING (parameter)")
def r1(spark, sf):
    specs = spark.createDataFrame([("avg_price", 20.0, 480.0)], "parameter string, lsl double, usl double")
    df = report.campaign_summary(long(spark, sf), specs)
    return df.select("campaign_name", "parameter", "n", F.round("mean", 8).alias("mean"), F.round("std", 7).alias("std"), "min", "max", F.round("range", 7).alias("range"), F.round("cv_pct", 7).alias("cv_pct"), "lsl", "usl")


@query("r3_system_header", f"WITH {RESULTS} SELECT split_part(campaign_name, '-', 1) AS system, count(*) AS n_tests, count(DISTINCT campaign_name) AS n_campaigns, round(avg(qc_passed::INT) * 100, 7) AS qc_pass_pct, string_agg(DISTINCT part, ',' ORDER BY part) AS types FROM results GROUP BY 1")
def r3(spark, sf):
    return rounded(report.system_header(results(spark, sf)).withColumn("types", F.array_join("types", ",")), 7)


@query("r4_campaign_cards", f"WITH {RESULTS} SELECT campaign_name, count(*) AS n_tests, CAST(count_if(qc_passed) AS BIGINT) AS n_passed, round(avg(avg_price), 8) AS mean, round(stddev_samp(avg_price), 8) AS std FROM results GROUP BY ALL")
def r4(spark, sf):
    return rounded(report.campaign_cards(results(spark, sf), "avg_price"), 8)


@query("r5_histogram", f"""WITH {LONG}, m AS (SELECT campaign_name, parameter, min(value) AS lo, max(value) AS hi FROM lng GROUP BY ALL)
  SELECT campaign_name, parameter, CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 20), 19) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM lng JOIN m USING (campaign_name, parameter) GROUP BY ALL""")
def r5(spark, sf):
    return report.histogram(long(spark, sf), "campaign_name", "parameter")


@query("r6_box", f"WITH {RESULTS} SELECT part, count(*) AS n, round(min(avg_price), 8) AS min, round(quantile_cont(avg_price, 0.25), 8) AS q1, round(quantile_cont(avg_price, 0.5), 8) AS median, round(quantile_cont(avg_price, 0.75), 8) AS q3, round(max(avg_price), 8) AS max FROM results GROUP BY part")
def r6(spark, sf):
    return rounded(report.box(results(spark, sf), "avg_price", "part"), 8)


@query("r7_trend_bands", f"WITH {RESULTS}, g AS (SELECT campaign_name, avg(avg_price) AS mean, stddev_samp(avg_price) AS s FROM results GROUP BY ALL) SELECT campaign_name, test_id, round(avg_price, 8) AS value, round(mean, 8) AS mean, round(mean - 2 * s, 8) AS low, round(mean + 2 * s, 8) AS high, round(avg_price - u_price, 8) AS u_low, round(avg_price + u_price, 8) AS u_high FROM results JOIN g USING (campaign_name)")
def r7(spark, sf):
    return rounded(report.trend_bands(results(spark, sf), "avg_price", "u_price").drop("test_timestamp"), 8)


@query("r8_z_scores", f"WITH {LONG}, g AS (SELECT campaign_name, parameter, avg(value) AS mean, stddev_pop(value) AS s FROM lng GROUP BY ALL) SELECT campaign_name, parameter, test_id, round((value - mean) / nullif(s, 0), 7) AS z FROM lng JOIN g USING (campaign_name, parameter)")
def r8(spark, sf):
    return rounded(report.z_scores(long(spark, sf)).select("campaign_name", "parameter", "test_id", "z"), 7)


@query("r9_cross_campaign_trend", f"WITH {LONG}, k AS (SELECT split_part(campaign_name, '-', 1) AS system, parameter, value, (row_number() OVER (PARTITION BY split_part(campaign_name, '-', 1), parameter ORDER BY test_timestamp, test_id) - 1)::DOUBLE AS i FROM lng) SELECT system, parameter, count(*) AS n, round(regr_slope(value, i), 7) AS slope, round(regr_intercept(value, i), 5) AS intercept, round(regr_r2(value, i), 8) AS r2 FROM k GROUP BY ALL")
def r9(spark, sf):
    df = report.cross_campaign_trend(long(spark, sf))
    return df.select("system", "parameter", "n", F.round("slope", 7).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r2", 8).alias("r2"))


@query("r10_campaign_boundaries", f"WITH {RESULTS}, n AS (SELECT split_part(campaign_name, '-', 1) AS system, campaign_name, count(*) AS n FROM results GROUP BY ALL) SELECT system, campaign_name, CAST(coalesce(sum(n) OVER (PARTITION BY system ORDER BY campaign_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM n")
def r10(spark, sf):
    return report.campaign_boundaries(results(spark, sf))


@query("r11_first_tests", f"WITH {RESULTS} SELECT campaign_name, test_id, avg_price FROM results ORDER BY test_timestamp DESC, test_id LIMIT 50")
def r11(spark, sf):
    return report.first_tests(results(spark, sf)).select("campaign_name", "test_id", "avg_price")


@query("r13_report_feed")
def r13(spark, sf):
    r = readings(spark, sf, True)
    means = r.groupBy("test_id").agg(F.avg("value").alias("avg_value"), F.count("value").alias("n"))
    return report.report_feed(means, qc.missing(r).unionByName(qc.saturation(r)))


@query("r13_report_feed_fields", f"""WITH {GAPPED}, m AS (SELECT test_id, round(avg(value), 6) AS avg_value, count(value) AS n FROM readings GROUP BY test_id), c AS (SELECT test_id, channel, avg((value IS NULL)::INT) AS share FROM readings GROUP BY ALL)
  SELECT test_id, avg_value, n, count(*) AS n_checks, string_agg(channel || '=' || CASE WHEN share > 0.20 THEN 'FAIL' WHEN share > 0.05 THEN 'WARN' ELSE 'PASS' END, ',' ORDER BY channel) AS checks FROM m JOIN c USING (test_id) GROUP BY ALL""")
def r13_fields(spark, sf):
    r = readings(spark, sf, True)
    means = r.groupBy("test_id").agg(F.avg("value").alias("avg_value"), F.count("value").alias("n"))
    document = F.from_json("document", "avg_value double, n long, checks array<struct<check:string,channel:string,status:string>>")
    d = report.report_feed(means, qc.missing(r)).select("test_id", document.alias("d"))
    listed = F.array_join(F.transform("d.checks", lambda x: F.concat_ws("=", x["channel"], x["status"])), ",")
    return d.select("test_id", F.round("d.avg_value", 6).alias("avg_value"), "d.n", F.size("d.checks").cast("long").alias("n_checks"), listed.alias("checks"))
