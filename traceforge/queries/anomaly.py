"""Anomaly and sensor-health queries."""

from itertools import combinations

from pyspark.sql import functions as F

from traceforge.operators import anomaly
from traceforge.queries.base import GAPPED, READINGS, query, readings, rounded

OUT = ("test_id", "channel", "kind", "start_seq", "end_seq", "n", "score")


def scored(df):
    """Scores rounded as SQL rounds them, where a zero keeps its sign."""
    return df.withColumn("score", F.round(F.abs("score"), 8) * F.signum("score"))


def out(df):
    return scored(df.select(*OUT))


def runs_sql(source, flag, score, kind, having="true", name="u"):
    """SQL for runs of flagged samples of ``source``."""
    return f"""SELECT test_id, channel, '{kind}' AS kind, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n, round(CAST(max(score) AS DOUBLE), 8) AS score
  FROM (SELECT *, seq - row_number() OVER (PARTITION BY test_id, channel ORDER BY seq) AS run FROM (SELECT *, {score} AS score FROM {source} WHERE {flag}))
  GROUP BY test_id, channel, run HAVING {having}"""


def robust(source, value, name):
    return f"""{name}1 AS (SELECT s.*, m.mid, m.known FROM {source} s JOIN (SELECT test_id, channel, quantile_cont({value}, 0.5) AS mid, count({value}) AS known FROM {source} GROUP BY ALL) m USING (test_id, channel)),
  {name} AS (SELECT s.*, abs({value} - mid) AS off, m.sigma FROM {name}1 s JOIN (SELECT test_id, channel, 1.4826::DOUBLE * quantile_cont(abs({value} - mid), 0.5) AS sigma FROM {name}1 GROUP BY ALL) m USING (test_id, channel))"""


SPIKES = runs_sql("z", "known >= 10 AND sigma >= 1e-10 AND off / sigma > 4", "off / sigma", "spike", "count(*) <= 10")
DROPS_CTE = "d AS (SELECT r.*, p75, known FROM readings r JOIN (SELECT test_id, channel, quantile_cont(value, 0.75) AS p75, count(value) AS known FROM readings GROUP BY ALL) USING (test_id, channel))"
DROPS = runs_sql("d", "known >= 5 AND p75 >= 1e-10 AND (value IS NULL OR abs(value) < 0.3::DOUBLE * p75)", "1", "dropout", "count(*) >= 3")
SATURATED_CTE = "s AS (SELECT r.*, hi, lo FROM readings r JOIN (SELECT test_id, channel, quantile_cont(value, 0.9) AS hi, quantile_cont(value, 0.1) AS lo FROM readings GROUP BY ALL) USING (test_id, channel) WHERE value IS NOT NULL)"


@query("a1_spikes", f"WITH {GAPPED}, {robust('readings', 'value', 'z')} {SPIKES}")
def a1(spark, sf):
    return out(anomaly.spikes(readings(spark, sf, True)))


@query("a2_dropouts", f"WITH {GAPPED}, {DROPS_CTE} {DROPS}")
def a2(spark, sf):
    return out(anomaly.dropouts(readings(spark, sf, True), 0.3))


DRIFT = """g AS (SELECT test_id, channel, regr_slope(value, seq::DOUBLE) AS slope, regr_r2(value, seq::DOUBLE) AS r2, count(*) AS n, max(value) - min(value) AS span, min(seq) AS start_seq, max(seq) AS end_seq FROM readings WHERE value IS NOT NULL GROUP BY ALL)
  SELECT test_id, channel, 'drift' AS kind, start_seq, end_seq, n, round(abs(slope * n / span), 8) AS score FROM g WHERE n >= 50 AND r2 > 0.001::DOUBLE AND abs(slope * n / span) > 0.02::DOUBLE"""


@query("a3_drift", f"WITH {GAPPED}, {DRIFT}")
def a3(spark, sf):
    return out(anomaly.drift(readings(spark, sf, True), 0.02, 0.001, 50))


FOURIER = """x AS (SELECT test_id, channel, row_number() OVER w - 1 AS i, value - avg(value) OVER (PARTITION BY test_id, channel) AS x, count(*) OVER (PARTITION BY test_id, channel) AS n,
    min(seq) OVER (PARTITION BY test_id, channel) AS start_seq, max(seq) OVER (PARTITION BY test_id, channel) AS end_seq, time_s - lag(time_s) OVER w AS dt
  FROM readings WHERE value IS NOT NULL WINDOW w AS (PARTITION BY test_id, channel ORDER BY seq)),
  steps AS (SELECT test_id, channel, quantile_cont(dt, 0.5) AS step FROM x GROUP BY ALL),
  f AS (SELECT test_id, channel, k, any_value(n) AS n, any_value(start_seq) AS start_seq, any_value(end_seq) AS end_seq, pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2) AS p
    FROM x JOIN (SELECT unnest(range(0, 400)) AS k) ON k <= n // 2 GROUP BY test_id, channel, k),
  g AS (SELECT test_id, channel, any_value(n) AS n, any_value(start_seq) AS start_seq, any_value(end_seq) AS end_seq, max(p) FILTER (k / (n * step) BETWEEN 0.000001 AND 1) / sum(p) FILTER (k > 0) AS share FROM f JOIN steps USING (test_id, channel) GROUP BY ALL)
  SELECT test_id, channel, 'oscillation' AS kind, start_seq, end_seq, n, round(share, 6) AS score FROM g WHERE n >= 64 AND share > 0.05"""


@query("a4_oscillation", f"WITH {GAPPED}, {FOURIER}")
def a4(spark, sf):
    return rounded(anomaly.oscillation(readings(spark, sf, True), 1e-6, 1.0, 0.05).select(*OUT), 6)


@query("a5_saturation", f"WITH {GAPPED}, {SATURATED_CTE} {runs_sql('s', 'value >= hi', 'value', 'saturation_high', 'count(*) >= 2')} UNION ALL {runs_sql('s', 'value <= lo', '-value', 'saturation_low', 'count(*) >= 2')}")
def a5(spark, sf):
    return out(anomaly.saturation(readings(spark, sf, True), 2, 0.9, 0.1))


@query("a6_flatlines")
def a6(spark, sf):
    return out(anomaly.flatlines(readings(spark, sf, True), 4, 60.0))


BREAKS = """p AS (SELECT test_id, seq, max(value) FILTER (channel = 'view') AS a, max(value) FILTER (channel = 'click') AS b FROM readings WHERE channel IN ('view', 'click') GROUP BY ALL),
  n AS (SELECT test_id, max(seq) + 1 AS n FROM p GROUP BY ALL), starts AS (SELECT test_id, unnest(range(0, greatest(n - 50, 0), 25)) AS start FROM n),
  w AS (SELECT s.test_id, s.start, count(*) AS m, corr(a, b) AS r, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM starts s JOIN p ON p.test_id = s.test_id AND p.seq >= s.start AND p.seq < s.start + 50 WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
  k AS (SELECT *, CASE WHEN start <= lag(start) OVER (PARTITION BY test_id ORDER BY start) + 75 THEN 0 ELSE 1 END AS fresh FROM w WHERE m >= 25 AND sa >= 1e-10 AND sb >= 1e-10 AND abs(r) < 0.5),
  u AS (SELECT *, sum(fresh) OVER (PARTITION BY test_id ORDER BY start) AS run FROM k)
  SELECT test_id, 'view/click' AS channel, 'correlation_break' AS kind, min(start) AS start_seq, max(start) + 50 AS end_seq, count(*) AS n, round(min(r), 8) AS score FROM u GROUP BY test_id, run"""


@query("a7_correlation_breaks", f"WITH {GAPPED}, {BREAKS}")
def a7(spark, sf):
    return out(anomaly.correlation_breaks(readings(spark, sf, True), "view", "click"))


MOVES = "moves AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY test_id, channel ORDER BY seq)), 0) AS move FROM readings)"
TRANSIENTS = runs_sql("t", "known >= 10 AND mid + 1 * sigma >= 1e-10 AND move > mid + 1 * sigma", "move", "transient", "count(*) BETWEEN 2 AND 20")


@query("a8_transients", f"WITH {GAPPED}, {MOVES}, {robust('moves', 'move', 't')} {TRANSIENTS}")
def a8(spark, sf):
    return out(anomaly.transients(readings(spark, sf, True), 1.0))


def some(spark, sf):
    r = readings(spark, sf, True)
    return r, anomaly.with_severity(scored(anomaly.spikes_and_dropouts(r, 0.3)))


BOTH = f"WITH {GAPPED}, {robust('readings', 'value', 'z')}, {DROPS_CTE}, a AS ({SPIKES} UNION ALL {DROPS}), b AS (SELECT *, CASE WHEN kind = 'dropout' OR score > 6 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM a)"


@query("a9_sensor_health", BOTH + """, size AS (SELECT test_id, channel, count(*) AS size, avg((value IS NULL)::INT) AS missing FROM readings GROUP BY ALL),
  k AS (SELECT test_id, channel, count_if(kind = 'spike') AS spikes, coalesce(sum(n) FILTER (kind = 'dropout'), 0) AS dropped FROM a GROUP BY ALL)
  SELECT test_id, channel, round(CASE WHEN size < 10 THEN 0 ELSE 1 - least(1.0::DOUBLE, least(2 * missing, 0.5::DOUBLE) + CASE WHEN coalesce(spikes, 0) * 100 / size > 0.1 THEN least(0.1::DOUBLE * coalesce(spikes, 0) * 100 / size, 0.2::DOUBLE) ELSE 0 END + least(3 * coalesce(dropped, 0) / size, 0.4::DOUBLE)) END, 8) AS health
  FROM size LEFT JOIN k USING (test_id, channel)""")
def a9(spark, sf):
    return rounded(anomaly.sensor_health(*some(spark, sf)), 8)


@query("a10_severity", BOTH + " SELECT test_id, channel, kind, start_seq, severity FROM b")
def a10(spark, sf):
    return some(spark, sf)[1].select("test_id", "channel", "kind", "start_seq", "severity")


@query("a10_full_run")
def a10b(spark, sf):
    return anomaly.detect_all(readings(spark, sf, True), [("view", "click")]).select(*OUT, "severity")


@query("a11_r12_report", BOTH + " SELECT test_id, channel, kind, severity, count(*) AS n_intervals, CAST(sum(n) AS BIGINT) AS n_samples FROM b GROUP BY ALL")
def a11(spark, sf):
    return anomaly.report(some(spark, sf)[1]).select("test_id", "channel", "kind", "severity", "n_intervals", "n_samples")


#: Every pair of channels.
PAIRS = list(combinations(("click", "error", "purchase", "signup", "view"), 2))


@query("a9_sensor_health_all")
def a9_all(spark, sf):
    r = readings(spark, sf, True)
    return rounded(anomaly.sensor_health(r, anomaly.detect_all(r, PAIRS)), 8)


@query("a10_severity_all")
def a10_all(spark, sf):
    return anomaly.detect_all(readings(spark, sf, True), PAIRS).select("test_id", "channel", "kind", "start_seq", "severity")


@query("a11_r12_report_all")
def a11_all(spark, sf):
    return anomaly.report(anomaly.detect_all(readings(spark, sf, True), PAIRS)).select("test_id", "channel", "kind", "severity", "n_intervals", "n_samples")


NATIVE = f"""WITH {GAPPED}, {robust('readings', 'value', 'z')}, {DROPS_CTE}, {SATURATED_CTE.replace('0.9)', '0.995)').replace('0.1)', '0.005)')}, {MOVES}, {robust('moves', 'move', 't')}, {DRIFT.split('SELECT test_id, channel, \'drift\'')[0].rstrip()}, {BREAKS.split('SELECT test_id, \'view/click\'')[0].rstrip()},
  a AS ({SPIKES} UNION ALL {DROPS.replace('0.3::DOUBLE', '0.1::DOUBLE')} UNION ALL {runs_sql('s', 'value >= hi', 'value', 'saturation_high', 'count(*) >= 5')} UNION ALL {runs_sql('s', 'value <= lo', '-value', 'saturation_low', 'count(*) >= 5')}
    UNION ALL {TRANSIENTS.replace('1 * sigma', '3 * sigma')}
    UNION ALL SELECT test_id, channel, 'drift', start_seq, end_seq, n, round(abs(slope * n / span), 8) FROM g WHERE n >= 200 AND r2 > 0.5 AND abs(slope * n / span) > 0.05::DOUBLE
    UNION ALL SELECT test_id, 'view/click', 'correlation_break', min(start), max(start) + 50, count(*), round(min(r), 8) FROM u GROUP BY test_id, run)
  SELECT *, CASE WHEN kind = 'dropout' OR kind = 'spike' AND score > 6 THEN 'CRITICAL' WHEN kind IN ('drift', 'transient') THEN 'INFO' ELSE 'WARNING' END AS severity FROM a"""


@query("a10_full_run_native", NATIVE)
def a10_native(spark, sf):
    return anomaly.with_severity(out(anomaly.detect_all(readings(spark, sf, True), [("view", "click")], native_only=True)))
