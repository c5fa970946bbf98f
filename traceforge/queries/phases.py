"""Phase and transient queries."""

from pyspark.sql import functions as F

from traceforge.operators import phases
from traceforge.queries.base import READINGS, query, readings, rounded

W = "PARTITION BY test_id, channel ORDER BY seq"
# samples binned by value stand for phase labels, so that phases of every length occur
LABELLED = f"{READINGS}, lab AS (SELECT *, CASE WHEN value < 20 THEN 'PRETEST' WHEN value < 60 THEN 'STEADY' ELSE 'STARTUP' END AS phase FROM readings)"
PHASES = f"""fr AS (SELECT *, CASE WHEN phase = lag(phase) OVER ({W}) THEN 0 ELSE 1 END AS fresh FROM lab), no AS (SELECT *, sum(fresh) OVER ({W}) AS phase_no FROM fr),
  ph AS (SELECT test_id, channel, CAST(phase_no AS BIGINT) AS phase_no, phase, min(seq) AS start_seq, max(seq) AS end_seq, min(time_s) AS start_s, max(time_s) AS end_s, count(*) AS n FROM no GROUP BY ALL)"""


def labelled(spark, sf):
    v = F.col("value")
    return readings(spark, sf).withColumn("phase", F.when(v < 20, "PRETEST").when(v < 60, "STEADY").otherwise("STARTUP"))


SEGMENT = f"""{READINGS}, sz AS (SELECT test_id, channel, count(*) AS size, min(value) AS low, max(value) AS high FROM readings GROUP BY ALL),
  s AS (SELECT r.*, size, low, high, greatest(10, size // 50) AS w FROM readings r JOIN sz USING (test_id, channel)),
  cvs AS (SELECT a.test_id, a.channel, a.seq, count(*) AS m, stddev_samp(b.value) / abs(avg(b.value)) AS cv FROM s a JOIN readings b ON a.test_id = b.test_id AND a.channel = b.channel AND b.seq BETWEEN a.seq - a.w // 2 AND a.seq + (a.w - 1) // 2 GROUP BY ALL),
  k AS (SELECT s.*, (value - low) / (high - low) * 100 >= 10 AS active, CASE WHEN m >= greatest(3, w // 3) THEN cv END AS cv FROM s JOIN cvs USING (test_id, channel, seq)),
  act AS (SELECT test_id, channel, min(seq) AS a0, max(seq) AS a1, min(seq) FILTER (value = high) AS peak FROM k WHERE active GROUP BY ALL),
  fl AS (SELECT *, seq - row_number() OVER ({W}) AS g FROM k WHERE active AND cv < 0.6),
  rn AS (SELECT test_id, channel, min(seq) AS b0, max(seq) AS b1, count(*) AS n FROM fl GROUP BY test_id, channel, g), best AS (SELECT * FROM rn QUALIFY row_number() OVER (PARTITION BY test_id, channel ORDER BY n DESC, b0) = 1),
  z AS (SELECT k.*, a0, a1, CASE WHEN b0 IS NOT NULL THEN CASE WHEN seq < b0 THEN 'STARTUP' WHEN seq > b1 THEN 'SHUTDOWN' ELSE 'STEADY' END WHEN seq <= peak THEN 'STARTUP' ELSE 'SHUTDOWN' END AS ramp FROM k JOIN act USING (test_id, channel) LEFT JOIN best USING (test_id, channel))
  SELECT test_id, channel, seq, CASE WHEN seq < a0 THEN 'PRETEST' WHEN seq > a1 THEN 'COOLDOWN' WHEN NOT active AND ramp = 'STARTUP' THEN 'PRETEST' WHEN NOT active AND ramp = 'SHUTDOWN' THEN 'COOLDOWN' ELSE ramp END AS phase FROM z"""


@query("t1_segment", f"WITH {SEGMENT}")
def t1(spark, sf):
    return phases.segment(readings(spark, sf), 10.0, 0.6).select("test_id", "channel", "seq", "phase")


@query("t2_phases", f"WITH {LABELLED}, {PHASES} SELECT test_id, channel, phase_no, phase, start_seq, end_seq, n FROM ph")
def t2(spark, sf):
    return phases.phases(labelled(spark, sf)).select("test_id", "channel", "phase_no", "phase", "start_seq", "end_seq", "n")


MERGED = """st AS (SELECT *, CASE WHEN end_s - start_s >= 20000 OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS stays FROM ph WINDOW w AS (PARTITION BY test_id, channel ORDER BY phase_no)),
  gr AS (SELECT *, sum(stays) OVER (PARTITION BY test_id, channel ORDER BY phase_no) AS g FROM st),
  mg AS (SELECT test_id, channel, CAST(g AS BIGINT) AS phase_no, min_by(phase, phase_no) AS phase, min(start_seq) AS start_seq, max(end_seq) AS end_seq, min(start_s) AS start_s, max(end_s) AS end_s, CAST(sum(n) AS BIGINT) AS n FROM gr GROUP BY test_id, channel, g)"""


def merged(spark, sf):
    return phases.merge_short(phases.phases(labelled(spark, sf)), 20000.0)


@query("t3_merge_short", f"WITH {LABELLED}, {PHASES}, {MERGED} SELECT test_id, channel, phase_no, phase, start_seq, end_seq, n FROM mg")
def t3(spark, sf):
    return merged(spark, sf).select("test_id", "channel", "phase_no", "phase", "start_seq", "end_seq", "n")


@query("t4_phase_metrics", f"""WITH {LABELLED}, {PHASES}, {MERGED}, j AS (SELECT r.*, phase_no, phase FROM readings r JOIN mg USING (test_id, channel) WHERE r.seq BETWEEN mg.start_seq AND mg.end_seq),
  q AS (SELECT *, CASE WHEN time_s > lag(time_s) OVER x THEN abs((value - lag(value) OVER x) / (time_s - lag(time_s) OVER x)) END AS rate, avg(value) OVER (PARTITION BY test_id, channel, phase_no) AS m FROM j WINDOW x AS (PARTITION BY test_id, channel, phase_no ORDER BY seq)),
  g AS (SELECT test_id, channel, phase_no, phase, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n, max_by(value, seq) - min_by(value, seq) AS change, max(time_s) - min(time_s) AS d, max(rate) AS peak, avg((abs(value - m) <= 0.02::DOUBLE * abs(m))::INT) * 100 AS within, regr_slope(value, time_s) AS slope FROM q GROUP BY ALL)
  SELECT test_id, channel, phase_no, phase, n, round(mean, 8) AS mean, round(std, 8) AS std, CASE WHEN phase = 'STARTUP' THEN round(change, 8) END AS total_change, CASE WHEN phase = 'STARTUP' THEN round(change / nullif(d, 0), 8) END AS ramp_rate, CASE WHEN phase = 'STARTUP' THEN round(peak, 5) END AS peak_ramp,
    CASE WHEN phase = 'STEADY' THEN round(std / abs(mean) * 100, 7) END AS cv_pct, CASE WHEN phase = 'STEADY' THEN round(within, 8) END AS within_2_pct, CASE WHEN phase = 'PRETEST' AND n > 1 THEN round(slope, 6) END AS drift FROM g""")
def t4(spark, sf):
    df = phases.phase_metrics(readings(spark, sf), merged(spark, sf))
    digits = {"mean": 8, "std": 8, "total_change": 8, "ramp_rate": 8, "peak_ramp": 5, "cv_pct": 7, "within_2_pct": 8, "drift": 6}
    return df.select("test_id", "channel", "phase_no", "phase", "n", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("t5_phase_quality", f"WITH {LABELLED}, {PHASES} SELECT test_id, channel, phase_no, CASE WHEN n < 5 THEN 'poor' WHEN n < 20 THEN 'marginal' ELSE 'good' END AS quality, lead(phase) OVER w AS next_phase, round(lead(start_s) OVER w, 6) AS transition_s FROM ph WINDOW w AS (PARTITION BY test_id, channel ORDER BY phase_no)")
def t5(spark, sf):
    return rounded(phases.phase_quality(phases.phases(labelled(spark, sf))).select("test_id", "channel", "phase_no", "quality", "next_phase", "transition_s"), 6)


PLATEAUS = f"""k AS (SELECT *, seq AS pos, count(*) OVER (PARTITION BY test_id, channel) AS n, (lead(time_s) OVER ({W}) - time_s) * (value + lead(value) OVER ({W})) / 2 AS area, lead(value) OVER ({W}) AS v1, lead(time_s) OVER ({W}) AS t1 FROM readings),
  p AS (SELECT test_id, channel, avg(value) FILTER (pos < greatest(n // 10, 1)) AS f, avg(value) FILTER (pos >= n - greatest(n // 5, 1)) AS l, max(value) AS peak, min(value) AS lowest, min(time_s) AS t0, sum(area) AS impulse FROM k GROUP BY ALL),
  pk AS (SELECT k.test_id, k.channel, min_by(time_s, seq) AS peak_s FROM k JOIN p USING (test_id, channel) WHERE value = peak GROUP BY ALL)"""


def cross(name, level, rising=True):
    hit = f"value <= {level} AND v1 > {level}" if rising else f"value >= {level} AND v1 < {level}"
    return f"{name} AS (SELECT k.test_id, k.channel, min_by(time_s + ({level} - value) / (v1 - value) * (t1 - time_s), seq) AS {name} FROM k JOIN p USING (test_id, channel) WHERE {hit} GROUP BY ALL)"


@query("t6_t8_t9_startup", f"""WITH {READINGS}, {PLATEAUS}, {cross('c10', '(f + (l - f) * 10 / 100)')}, {cross('c50', '(f + (l - f) * 50 / 100)')}, {cross('c90', '(f + (l - f) * 90 / 100)')},
  o AS (SELECT k.test_id, k.channel, max(seq) AS last_out FROM k JOIN p USING (test_id, channel) WHERE NOT value BETWEEN l - 0.05::DOUBLE * abs(l) AND l + 0.05::DOUBLE * abs(l) GROUP BY ALL),
  se AS (SELECT o.test_id, o.channel, t1 AS after_s FROM o JOIN k ON k.test_id = o.test_id AND k.channel = o.channel AND k.seq = o.last_out)
  SELECT p.test_id, p.channel, round(f, 8) AS baseline, round(l, 8) AS steady, round(c10, 4) AS t10, round(c50, 4) AS t50, round(c90, 4) AS t90, round(c90 - c10, 4) AS rise_s, round(CASE WHEN l - f > 0 THEN greatest(0, (peak - l) / (l - f) * 100) END, 5) AS overshoot_pct, peak, round(peak_s - t0, 6) AS time_to_peak_s,
    round(CASE WHEN o.last_out IS NULL THEN 0 ELSE after_s - t0 END, 6) AS settling_s
  FROM p JOIN pk USING (test_id, channel) LEFT JOIN c10 USING (test_id, channel) LEFT JOIN c50 USING (test_id, channel) LEFT JOIN c90 USING (test_id, channel) LEFT JOIN o USING (test_id, channel) LEFT JOIN se USING (test_id, channel)""")
def t6(spark, sf):
    digits = {"baseline": 8, "steady": 8, "t10": 4, "t50": 4, "t90": 4, "rise_s": 4, "overshoot_pct": 5, "peak": 8, "time_to_peak_s": 6, "settling_s": 6}
    return phases.startup(readings(spark, sf)).select("test_id", "channel", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("t7_shutdown", f"""WITH {READINGS}, {PLATEAUS}, {cross('c10', '(0 + (f - 0) * 10 / 100)', False)}, {cross('c50', '(0 + (f - 0) * 50 / 100)', False)}, {cross('c90', '(0 + (f - 0) * 90 / 100)', False)}
  SELECT p.test_id, p.channel, round(f, 8) AS steady, round(c90, 4) AS t90, round(c50, 4) AS t50, round(c10, 4) AS t10, round(c10 - c90, 4) AS fall_s, round(impulse, 2) AS impulse, lowest, round(l / f * 100, 6) AS residual_pct
  FROM p LEFT JOIN c10 USING (test_id, channel) LEFT JOIN c50 USING (test_id, channel) LEFT JOIN c90 USING (test_id, channel)""")
def t7(spark, sf):
    digits = {"steady": 8, "t90": 4, "t50": 4, "t10": 4, "fall_s": 4, "impulse": 2, "lowest": 8, "residual_pct": 6}
    return phases.shutdown(readings(spark, sf)).select("test_id", "channel", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("t10_longest_run", f"WITH {READINGS}, fl AS (SELECT *, seq - row_number() OVER ({W}) AS g FROM readings WHERE value > 30), rn AS (SELECT test_id, channel, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n FROM fl GROUP BY test_id, channel, g) SELECT * FROM rn QUALIFY row_number() OVER (PARTITION BY test_id, channel ORDER BY n DESC, start_seq) = 1")
def t10(spark, sf):
    return phases.longest(phases.runs(readings(spark, sf), F.col("value") > 30)).select("test_id", "channel", "start_seq", "end_seq", "n")
