"""Steady-window queries."""

from pyspark.sql import functions as F

from traceforge.operators import steady
from traceforge.queries.base import GAPPED, READINGS, query, readings, rounded

OWN = "own AS (SELECT * FROM readings WHERE channel = 'view')"
RUNS = "runs AS (SELECT test_id, channel, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n, min(time_s) AS start_s, max(time_s) AS end_s FROM (SELECT *, seq - row_number() OVER (PARTITION BY test_id, channel ORDER BY seq) AS g FROM flagged) GROUP BY test_id, channel, g)"
LONGEST = "best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY test_id, channel ORDER BY n DESC, start_seq) = 1)"


def frame(width):
    return f"OVER (PARTITION BY test_id, channel ORDER BY seq ROWS BETWEEN {width // 2} PRECEDING AND {(width - 1) // 2} FOLLOWING)"


CV = f"""{OWN}, flagged AS (SELECT * FROM (SELECT *, coalesce(CASE WHEN count(value) {frame(6)} = 6 THEN stddev_samp(value) {frame(6)} / abs(avg(value) {frame(6)}) END, 1.0) AS cv FROM own) WHERE cv < 0.9), {RUNS}, {LONGEST}"""


@query("d1_steady_cv", f"WITH {GAPPED}, {CV} SELECT test_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, 'cv' AS method FROM best")
def d1(spark, sf):
    return rounded(steady.steady_cv(readings(spark, sf, True), "view", 6, 0.9))


@query("d2_steady_forest")
def d2(spark, sf):
    return steady.steady_forest(readings(spark, sf), ["view", "click"])


@query("d2_steady_forest_all")
def d2_all(spark, sf):
    r = readings(spark, sf)
    return steady.steady_forest(r, ["click", "error", "purchase", "signup", "view"], width=4)


DERIVATIVE = f"""{OWN}, span AS (SELECT test_id, channel, max(value) - min(value) AS span FROM own GROUP BY ALL),
  steps AS (SELECT * FROM (SELECT own.*, abs((lead(value) OVER w - value) / CASE WHEN lead(time_s) OVER w - time_s = 0 THEN 1e-10 ELSE lead(time_s) OVER w - time_s END) / nullif(span, 0) AS slope, lead(time_s) OVER w AS after_s
    FROM own JOIN span USING (test_id, channel) WINDOW w AS (PARTITION BY test_id, channel ORDER BY seq)) WHERE after_s IS NOT NULL),
  flagged AS (SELECT * FROM (SELECT *, coalesce(CASE WHEN count(slope) {frame(5)} = 5 THEN avg(slope) {frame(5)} END, 1.0) AS s FROM steps) WHERE s < 0.0001), {RUNS}, {LONGEST}"""


@query("d3_steady_derivative", f"WITH {READINGS}, {DERIVATIVE} SELECT b.test_id, round(b.start_s, 6) AS start_s, round(s.after_s, 6) AS end_s, 'derivative' AS method FROM best b JOIN steps s ON b.test_id = s.test_id AND b.end_seq = s.seq WHERE b.n >= 3")
def d3(spark, sf):
    return rounded(steady.steady_derivative(readings(spark, sf), "view", 5, 0.0001, 3))


MIDDLE = f"""{OWN}, n AS (SELECT test_id, count(*) AS n FROM own GROUP BY ALL), m AS (SELECT test_id, max(time_s) FILTER (seq = floor(n * 0.5 / 2)) AS start_s, max(time_s) FILTER (seq = least(floor(n * 1.5 / 2), n - 1)) AS end_s FROM own JOIN n USING (test_id) GROUP BY test_id)"""


@query("d4_steady_middle", f"WITH {READINGS}, {MIDDLE} SELECT test_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, 'simple' AS method FROM m")
def d4(spark, sf):
    return rounded(steady.steady_middle(readings(spark, sf), "view"))


CV_BEST = f"""flagged AS (SELECT * FROM (SELECT *, coalesce(CASE WHEN count(value) {frame(6)} = 6 THEN stddev_samp(value) {frame(6)} / abs(avg(value) {frame(6)}) END, 1.0) AS cv FROM own) WHERE cv < 0.3), {RUNS}, {LONGEST}"""
SLOPE_BEST = DERIVATIVE.split(",", 1)[1].replace(frame(5), frame(20)).replace("= 5 THEN", "= 20 THEN").replace("< 0.0001", "< 0.1").replace("flagged", "flat").replace("runs", "flat_runs").replace("best AS", "flat_best AS")


AUTO = f"""WITH {READINGS}, {MIDDLE}, {CV_BEST}, {SLOPE_BEST},
  d AS (SELECT b.test_id, b.start_s, s.after_s AS end_s FROM flat_best b JOIN steps s ON b.test_id = s.test_id AND b.end_seq = s.seq WHERE b.n >= 10)
  SELECT m.test_id, round(coalesce(b.start_s, d.start_s, m.start_s), 6) AS start_s, round(coalesce(b.end_s, d.end_s, m.end_s), 6) AS end_s,
         CASE WHEN b.start_s IS NOT NULL THEN 'cv' WHEN d.start_s IS NOT NULL THEN 'derivative' ELSE 'simple' END AS method FROM m LEFT JOIN best b USING (test_id) LEFT JOIN d USING (test_id)"""


@query("d5_steady_auto", AUTO)
def d5(spark, sf):
    return rounded(steady.steady_auto(readings(spark, sf), "view", None, 6, 0.3))


@query("d5_steady_auto_by_role", AUTO)
def d5_role(spark, sf):
    roles = spark.createDataFrame([("view", "chamber_pressure"), ("click", "mass_flow"), ("error", "pressure")], "channel string, role string")
    return rounded(steady.steady_auto_by_role(readings(spark, sf), roles, None, 6, 0.3))


@query("d6_validate_window", f"""WITH {GAPPED}, {CV}, g AS (SELECT o.test_id, b.start_s, b.end_s, count(*) AS n, count_if(o.time_s BETWEEN b.start_s AND b.end_s) AS inside FROM own o JOIN best b USING (test_id) GROUP BY ALL),
  r AS (SELECT test_id, inside, CASE WHEN start_s >= end_s THEN 'start not before end' WHEN inside < 10 THEN 'too few samples' WHEN inside / n < 0.05 THEN 'too short' WHEN inside / n > 0.95 THEN 'too long' ELSE 'ok' END AS reason FROM g)
  SELECT test_id, CAST(inside AS BIGINT) AS inside, reason, reason = 'ok' AS valid FROM r""")
def d6(spark, sf):
    r = readings(spark, sf, True)
    return steady.validate(r, steady.steady_cv(r, "view", 6, 0.9), "view")


SWEEP = "t AS (SELECT test_id, max(time_s) AS top FROM readings GROUP BY test_id), w AS (SELECT test_id, k AS window_id, top * k / 10 AS start_s, top * (k + 3) / 10 AS end_s FROM t, (SELECT unnest(range(0, 7)) AS k))"


@query("d7_window_sweep", f"WITH {READINGS}, {SWEEP} SELECT test_id, window_id, channel, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS std, count(value) AS n FROM readings JOIN w USING (test_id) WHERE time_s BETWEEN start_s AND end_s GROUP BY ALL")
def d7(spark, sf):
    r = readings(spark, sf)
    w = r.groupBy("test_id").agg(F.max("time_s").alias("top")).select("test_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("window_id"), "top")
    w = w.select("test_id", "window_id", (F.col("top") * F.col("window_id") / 10).alias("start_s"), (F.col("top") * (F.col("window_id") + 3) / 10).alias("end_s"))
    return rounded(steady.sweep(r, w), 8)
