"""Data-quality queries."""

from pyspark.sql import functions as F

from traceforge.functions.series import by_series
from traceforge.operators import qc
from traceforge.queries.base import GAPPED, READINGS, query, readings, rounded

OUT = ("test_id", "check", "channel", "status", "metric")
DT = "dts AS (SELECT *, time_s - lag(time_s) OVER (PARTITION BY test_id, channel ORDER BY seq) AS dt FROM readings)"
SPECS = [("view", 0.5, 150.0, True), ("click", None, 400.0, True), ("error", 0.2, None, False)]


def out(df):
    return rounded(df.select(*OUT))


def case(name, status, metric, body):
    return f"""SELECT test_id, '{name}' AS "check", channel, {status} AS status, round(CAST({metric} AS DOUBLE), 6) AS metric {body}"""


def disordered(spark, sf):
    """Every thirteenth sample carries the time of the one two before it."""
    r = readings(spark, sf)
    return r.withColumn("time_s", F.when(F.col("seq") % 13 == 12, F.lag("time_s", 2).over(by_series())).otherwise(F.col("time_s")))


DISORDERED = READINGS.replace("readings AS (", "plain AS (") + """, readings AS (
  SELECT test_id, channel, seq, CASE WHEN seq % 13 = 12 THEN lag(time_s, 2) OVER (PARTITION BY test_id, channel ORDER BY seq) ELSE time_s END AS time_s, value FROM plain)"""


@query("q1_timestamp_monotonic", f"WITH {DISORDERED}, {DT} " + case("timestamp_monotonic", "CASE WHEN count_if(dt <= 0) > 0 THEN 'FAIL' ELSE 'PASS' END", "count_if(dt <= 0)", "FROM dts GROUP BY test_id, channel"))
def q1(spark, sf):
    return out(qc.timestamps_increase(disordered(spark, sf)))


@query("q1_violations", f"WITH {DISORDERED}, {DT}, b AS (SELECT test_id, channel, seq, row_number() OVER (PARTITION BY test_id, channel ORDER BY seq) AS k FROM dts WHERE dt <= 0) SELECT test_id, channel, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS first FROM b WHERE k <= 5 GROUP BY ALL")
def q1b(spark, sf):
    return qc.violations(disordered(spark, sf)).select("test_id", "channel", F.array_join("first", ",").alias("first"))


GAPS = f"WITH {READINGS}, {DT}, m AS (SELECT test_id, channel, quantile_cont(dt, 0.5) AS mid FROM dts GROUP BY ALL), g AS (SELECT d.test_id, d.channel, count_if(dt > 8 * mid) AS gaps, count(dt) AS n FROM dts d JOIN m USING (test_id, channel) WHERE dt IS NOT NULL GROUP BY ALL) "


@query("q2_timestamp_gaps", GAPS + case("timestamp_gaps", "CASE WHEN gaps = 0 THEN 'PASS' WHEN gaps / n < 0.01 THEN 'WARN' ELSE 'FAIL' END", "gaps", "FROM g"))
def q2(spark, sf):
    return out(qc.timestamp_gaps(readings(spark, sf), 8.0))


RATE = f"WITH {READINGS}, {DT}, g AS (SELECT test_id, channel, count(dt) AS n, stddev_pop(dt) / avg(dt) AS cv FROM dts GROUP BY ALL) "


@query("q3_sampling_rate", RATE + case("sampling_rate", "CASE WHEN n < 10 THEN 'SKIP' WHEN cv > 1.0 THEN 'WARN' ELSE 'PASS' END", "cv", "FROM g"))
def q3(spark, sf):
    return out(qc.rate_stability(readings(spark, sf), 1.0))


def specs(spark):
    return spark.createDataFrame(SPECS, "channel string, min double, max double, allow_negative boolean")


RANGE = f"""WITH {GAPPED}, specs(channel, lo, hi, neg) AS (VALUES ('view', 0.5, 150.0, true), ('click', NULL, 400.0, true), ('error', 0.2, NULL, false)),
  g AS (SELECT test_id, channel, count_if(coalesce(value < lo, false) OR coalesce(value > hi, false) OR (NOT neg AND coalesce(value < 0, false))) AS bad, count(value) AS n FROM readings JOIN specs USING (channel) GROUP BY ALL) """


@query("q4_q5_sensor_ranges", RANGE + case("sensor_range", "CASE WHEN n = 0 OR bad > 0 THEN 'FAIL' ELSE 'PASS' END", "bad", "FROM g"))
def q5(spark, sf):
    return out(qc.sensor_range(readings(spark, sf, True), specs(spark)))


def frame(width):
    return f"OVER (PARTITION BY test_id, channel ORDER BY seq ROWS BETWEEN {width // 2} PRECEDING AND {(width - 1) // 2} FOLLOWING)"


FLAT = f"""WITH {GAPPED}, r AS (SELECT *, CASE WHEN count(value) {frame(6)} = 6 THEN var_samp(value) {frame(6)} END AS v FROM readings),
  g AS (SELECT test_id, channel, count(v) AS n, count_if(v < 60.0) AS flat FROM r GROUP BY ALL) """


@query("q6_flatline", FLAT + case("flatline", "CASE WHEN n = 0 THEN 'SKIP' WHEN flat = 0 THEN 'PASS' WHEN flat / n < 0.1 THEN 'WARN' ELSE 'FAIL' END", "flat / nullif(n, 0)", "FROM g"))
def q6(spark, sf):
    return out(qc.flatline(readings(spark, sf, True), 6, 60.0))


def clipped(spark, sf):
    """Values cut off at 100, as a saturated sensor gives them."""
    return readings(spark, sf, True).where("value is not null").withColumn("value", F.least("value", F.lit(100.0)))


SATURATED = f"""WITH {GAPPED}, c AS (SELECT test_id, channel, least(value, 100.0) AS value FROM readings WHERE value IS NOT NULL), m AS (SELECT test_id, channel, min(value) AS lo, max(value) AS hi FROM c GROUP BY ALL),
  g AS (SELECT test_id, channel, count(*) AS n, greatest(avg((value = lo)::INT), avg((value = hi)::INT)) AS share FROM c JOIN m USING (test_id, channel) GROUP BY ALL) """


@query("q7_saturation", SATURATED + case("saturation", "CASE WHEN n < 10 THEN 'SKIP' WHEN share > 0.10 THEN 'FAIL' WHEN share > 0.01 THEN 'WARN' ELSE 'PASS' END", "share", "FROM g"))
def q7(spark, sf):
    return out(qc.saturation(clipped(spark, sf)))


@query("q8_nan_ratio", f"WITH {GAPPED}, g AS (SELECT test_id, channel, avg((value IS NULL)::INT) AS share FROM readings GROUP BY ALL) " + case("nan_ratio", "CASE WHEN share > 0.20 THEN 'FAIL' WHEN share > 0.05 THEN 'WARN' ELSE 'PASS' END", "share", "FROM g"))
def q8(spark, sf):
    return out(qc.missing(readings(spark, sf, True)))


PAIRS = "p AS (SELECT test_id, seq, max(value) FILTER (channel = 'view') AS a, max(value) FILTER (channel = 'click') AS b FROM readings WHERE channel IN ('view', 'click') GROUP BY ALL)"


@query("q9_pressure_flow_correlation", f"WITH {GAPPED}, {PAIRS}, g AS (SELECT test_id, 'view/click' AS channel, count(*) AS n, corr(a, b) AS r FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY test_id) " + case("pressure_flow_correlation", "CASE WHEN n < 10 THEN 'SKIP' WHEN r IS NULL OR isnan(r) THEN 'WARN' WHEN r >= 0.3 THEN 'PASS' WHEN r < 0 THEN 'FAIL' ELSE 'WARN' END", "r", "FROM g"))
def q9(spark, sf):
    return out(qc.correlated(readings(spark, sf, True), "view", "click"))


def run(spark, sf):
    return qc.full_run(readings(spark, sf, True), specs(spark), ["view", "click"], "view", "click", "purchase", "signup", "view", "click")


FULL = f"""WITH {GAPPED}, {DT}, specs(channel, lo, hi, neg) AS (VALUES ('view', 0.5, 150.0, true), ('click', NULL, 400.0, true), ('error', 0.2, NULL, false)),
  one AS (SELECT test_id, channel, count_if(dt <= 0) AS bad, count(dt) AS n_dt, quantile_cont(dt, 0.5) AS mid, stddev_pop(dt) / nullif(avg(dt), 0) AS cv, avg((value IS NULL)::INT) AS share, count(value) AS known, min(value) AS low, max(value) AS high FROM dts GROUP BY ALL),
  two AS (SELECT d.test_id, d.channel, count_if(dt > 3 * mid) AS gaps, greatest(avg((value = low)::INT), avg((value = high)::INT)) AS stuck FROM dts d JOIN one USING (test_id, channel) GROUP BY ALL),
  f50 AS (SELECT *, CASE WHEN count(value) {frame(50)} = 50 THEN var_samp(value) {frame(50)} END AS v FROM readings WHERE channel IN ('view', 'click')),
  fl AS (SELECT test_id, channel, count(v) AS n, count_if(v < 1e-10) AS flat FROM f50 GROUP BY ALL),
  rg AS (SELECT test_id, channel, count_if(coalesce(value < lo, false) OR coalesce(value > hi, false) OR (NOT neg AND coalesce(value < 0, false))) AS bad, count(value) AS n FROM readings JOIN specs USING (channel) GROUP BY ALL),
  pairs AS (SELECT test_id, seq, max(value) FILTER (channel = 'view') AS a, max(value) FILTER (channel = 'click') AS b, max(value) FILTER (channel = 'purchase') AS c, max(value) FILTER (channel = 'signup') AS d FROM readings GROUP BY ALL),
  ab AS (SELECT test_id, 'view/click' AS channel, count(*) AS n, corr(a, b) AS r FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY test_id),
  cd AS (SELECT test_id, 'purchase/signup' AS channel, count(*) AS n, corr(c, d) AS r FROM pairs WHERE c IS NOT NULL AND d IS NOT NULL GROUP BY test_id),
  known AS (SELECT * FROM readings WHERE channel = 'purchase' AND value IS NOT NULL),
  ro AS (SELECT *, CASE WHEN count(value) {frame(50)} = 50 THEN max(value) {frame(50)} - min(value) {frame(50)} END AS span, CASE WHEN count(value) {frame(50)} = 50 THEN avg(value) {frame(50)} END AS mid FROM known),
  st AS (SELECT test_id, channel, count(*) AS n, avg(value) AS mean, max(CASE WHEN mid > 0 THEN span / mid * 100 END) AS rough FROM ro GROUP BY ALL),
  ig AS (SELECT test_id, channel, max(value) AS top, min_by(time_s, seq) FILTER (value >= 2) AS first_s FROM readings WHERE channel = 'purchase' GROUP BY ALL),
  tops AS (SELECT *, max(value) OVER (PARTITION BY test_id, channel) AS top FROM readings WHERE channel IN ('view', 'click')),
  le AS (SELECT test_id, 'view/click' AS channel, (min(time_s) FILTER (channel = 'click' AND value > 0.1::DOUBLE * top) - min(time_s) FILTER (channel = 'view' AND value > 0.1::DOUBLE * top)) * 1000 AS lag FROM tops GROUP BY test_id) """
RELATED = "CASE WHEN n < 10 THEN 'SKIP' WHEN r IS NULL OR isnan(r) THEN 'WARN' WHEN r >= {} THEN 'PASS' WHEN r < 0 THEN 'FAIL' ELSE 'WARN' END"
FULL += " UNION ALL ".join(
    [
        case("timestamp_monotonic", "CASE WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END", "bad", "FROM one"),
        case("timestamp_gaps", "CASE WHEN gaps = 0 THEN 'PASS' WHEN gaps / n_dt < 0.01 THEN 'WARN' ELSE 'FAIL' END", "gaps", "FROM one JOIN two USING (test_id, channel) WHERE n_dt > 0"),
        case("sampling_rate", "CASE WHEN n_dt < 10 THEN 'SKIP' WHEN cv > 0.10 THEN 'WARN' ELSE 'PASS' END", "cv", "FROM one"),
        case("sensor_range", "CASE WHEN n = 0 OR bad > 0 THEN 'FAIL' ELSE 'PASS' END", "bad", "FROM rg"),
        case("flatline", "CASE WHEN n = 0 THEN 'SKIP' WHEN flat = 0 THEN 'PASS' WHEN flat / n < 0.1 THEN 'WARN' ELSE 'FAIL' END", "flat / nullif(n, 0)", "FROM fl"),
        case("saturation", "CASE WHEN known < 10 THEN 'SKIP' WHEN stuck > 0.10 THEN 'FAIL' WHEN stuck > 0.01 THEN 'WARN' ELSE 'PASS' END", "stuck", "FROM one JOIN two USING (test_id, channel) WHERE channel IN ('view', 'click') AND known > 0"),
        case("nan_ratio", "CASE WHEN share > 0.20 THEN 'FAIL' WHEN share > 0.05 THEN 'WARN' ELSE 'PASS' END", "share", "FROM one WHERE channel IN ('view', 'click')"),
        case("pressure_flow_correlation", RELATED.format(0.3), "r", "FROM ab"),
        case("chamber_thrust_correlation", RELATED.format(0.5), "r", "FROM cd"),
        case("combustion_stability", "CASE WHEN n < 100 THEN 'SKIP' WHEN mean <= 0 THEN 'FAIL' WHEN rough <= 10 THEN 'PASS' WHEN rough > 20 THEN 'FAIL' ELSE 'WARN' END", "rough", "FROM st"),
        case("ignition", "CASE WHEN top >= 2 THEN 'PASS' ELSE 'FAIL' END", "first_s", "FROM ig"),
        case("propellant_lead_lag", "CASE WHEN lag IS NULL THEN 'WARN' WHEN abs(lag) > 1000 THEN 'FAIL' WHEN abs(lag) > 500 THEN 'WARN' ELSE 'PASS' END", "lag", "FROM le").replace("DOUBLE), 6", "DOUBLE), 3"),
    ]
)


@query("q10_full_run", FULL)
def q10(spark, sf):
    late = F.col("check") == "propellant_lead_lag"
    return run(spark, sf).select("test_id", "check", "channel", "status", F.when(late, F.round("metric", 3)).otherwise(F.round("metric", 6)).alias("metric"))


QUICK = f"""WITH {DISORDERED.replace('value FROM plain', 'CASE WHEN value > 20 THEN value END AS value FROM plain')}, {DT}, g AS (SELECT test_id, channel, avg((value IS NULL)::INT) AS share, count(DISTINCT value) AS d FROM readings GROUP BY ALL), t AS (SELECT test_id, channel, count_if(dt <= 0) AS bad FROM dts GROUP BY ALL) """


@query("q11_quick_run", QUICK + case("timestamp_monotonic", "'FAIL'", "bad", "FROM t WHERE bad > 0") + " UNION ALL " + case("quick_nan", "'FAIL'", "share", "FROM g WHERE share > 0.5") + " UNION ALL " + case("quick_constant", "'FAIL'", "d", "FROM g WHERE d <= 1"))
def q11(spark, sf):
    return out(qc.quick_run(disordered(spark, sf).withColumn("value", F.when(F.col("value") > 20, F.col("value")))))


ROUGH = f"""WITH {READINGS}, k AS (SELECT *, CASE WHEN count(value) {frame(10)} = 10 THEN max(value) {frame(10)} - min(value) {frame(10)} END AS span, CASE WHEN count(value) {frame(10)} = 10 THEN avg(value) {frame(10)} END AS mid FROM readings WHERE channel = 'purchase'),
  g AS (SELECT test_id, channel, count(*) AS n, avg(value) AS mean, max(CASE WHEN mid > 0 THEN span / mid * 100 END) AS rough FROM k GROUP BY ALL) """


@query("q12_combustion_stability", ROUGH + case("combustion_stability", "CASE WHEN n < 20 THEN 'SKIP' WHEN mean <= 0 THEN 'FAIL' WHEN rough <= 300 THEN 'PASS' WHEN rough > 500 THEN 'FAIL' ELSE 'WARN' END", "rough", "FROM g"))
def q12(spark, sf):
    return out(qc.combustion_stability(readings(spark, sf), "purchase", 10, 300.0, 500.0))


@query("q13_ignition", f"WITH {READINGS}, g AS (SELECT test_id, channel, max(value) AS top, min_by(time_s, seq) FILTER (value >= 200) AS first_s FROM readings WHERE channel = 'purchase' GROUP BY ALL) " + case("ignition", "CASE WHEN top >= 200 THEN 'PASS' ELSE 'FAIL' END", "first_s", "FROM g"))
def q13(spark, sf):
    return out(qc.ignition(readings(spark, sf), "purchase", 200.0))


LAG = f"""WITH {READINGS}, t AS (SELECT *, max(value) OVER (PARTITION BY test_id, channel) AS top FROM readings WHERE channel IN ('view', 'click')),
  o AS (SELECT test_id, 'view/click' AS channel, (min(time_s) FILTER (channel = 'click' AND value > 0.5 * top) - min(time_s) FILTER (channel = 'view' AND value > 0.5 * top)) * 1000 AS lag FROM t GROUP BY test_id) """


@query("q14_lead_lag", LAG + case("propellant_lead_lag", "CASE WHEN lag IS NULL THEN 'WARN' WHEN abs(lag) > 100000000 THEN 'FAIL' WHEN abs(lag) > 20000000 THEN 'WARN' ELSE 'PASS' END", "lag", "FROM o").replace("CAST(lag AS DOUBLE), 6", "CAST(lag AS DOUBLE), 3"))
def q14(spark, sf):
    return rounded(qc.lead_lag(readings(spark, sf), "view", "click", 0.5, 20000000.0, 100000000.0).select(*OUT), 3)


SUMMARY = f"WITH {GAPPED}, g AS (SELECT test_id, channel, avg((value IS NULL)::INT) AS share, count_if(value > 200) AS hot FROM readings GROUP BY ALL), c AS (SELECT test_id, CASE WHEN share > 0.09 THEN 'FAIL' WHEN share > 0.05 THEN 'WARN' ELSE 'PASS' END AS status FROM g)"


COUNTS = ", ".join(f"CAST(count_if(status = '{x}') AS BIGINT) AS n_{x.lower()}" for x in ("PASS", "WARN", "FAIL", "SKIP"))


@query("q15_summary", f"{SUMMARY} SELECT test_id, {COUNTS}, count_if(status = 'FAIL') = 0 AS passed, count_if(status = 'WARN') > 0 AS has_warnings FROM c GROUP BY test_id")
def q15(spark, sf):
    return qc.summary(qc.missing(readings(spark, sf, True), 0.05, 0.09))


@query("q15_gate", SUMMARY + " SELECT test_id, count(*) AS n FROM readings WHERE test_id NOT IN (SELECT test_id FROM c WHERE status = 'FAIL') GROUP BY test_id")
def q15b(spark, sf):
    r = readings(spark, sf, True)
    return qc.gate(r, qc.missing(r, 0.05, 0.09)).groupBy("test_id").agg(F.count("*").alias("n"))
