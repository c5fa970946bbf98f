"""Preprocessing queries."""

from pyspark.sql import functions as F

from traceforge.operators import prep
from traceforge.queries.base import GAPPED, RAW, READINGS, RESULTS, query, raw_readings, readings, results, rounded

SERIES = "PARTITION BY test_id, channel"
NEAR = f"""near AS (
  SELECT *, last_value(value IGNORE NULLS) OVER b AS prev, last_value(CASE WHEN value IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS prev_seq,
         first_value(value IGNORE NULLS) OVER a AS next, first_value(CASE WHEN value IS NOT NULL THEN seq END IGNORE NULLS) OVER a AS next_seq,
         max(seq) OVER ({SERIES}) AS top
  FROM readings
  WINDOW b AS ({SERIES} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({SERIES} ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
LERP = "prev + (next - prev) * (seq - prev_seq) / (next_seq - prev_seq)"


@query("p1_channel_mapping", f"""WITH {READINGS} SELECT test_id, CASE channel WHEN 'view' THEN 'PT-01' WHEN 'click' THEN 'FM-01' ELSE channel END AS channel,
  count(*) AS n, round(sum(value), 4) AS total FROM readings GROUP BY ALL""")
def p1(spark, sf):
    names = spark.createDataFrame([("view", "PT-01"), ("click", "FM-01")], "channel string, sensor string")
    return prep.map_channels(readings(spark, sf), names).groupBy("test_id", "channel").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("p2_time_normalisation", f"""WITH {RAW}, coarse AS (SELECT *, ts_us // 3600000000 AS h, row_number() OVER (PARTITION BY test_id, channel, ts_us // 3600000000 ORDER BY seq) AS k FROM raw)
  SELECT test_id, channel, row_number() OVER ({SERIES} ORDER BY h) - 1 AS seq, (h - min(h) OVER (PARTITION BY test_id)) * 1.0::DOUBLE AS time_s,
         (h - min(h) OVER (PARTITION BY test_id)) * 1000.0::DOUBLE AS time_ms, v AS value FROM coarse WHERE k = 1""")
def p2(spark, sf):
    raw = raw_readings(spark, sf).withColumn("timestamp", F.floor(F.col("timestamp") / 3600000000))
    return prep.normalise_time(raw, "s")


@query("p3_gap_fill", f"""WITH {GAPPED}, {NEAR}, marked AS (
  SELECT *, max(CASE WHEN value IS NULL AND coalesce(next_seq, top + 1) - coalesce(prev_seq, -1) - 1 <= 1 THEN 1 ELSE 0 END) OVER ({SERIES}) AS short FROM near)
  SELECT test_id, channel, seq, round(CASE WHEN value IS NOT NULL THEN value WHEN prev IS NOT NULL AND seq - prev_seq <= 1 AND short = 1 THEN CASE WHEN next IS NULL THEN prev ELSE {LERP} END END, 6) AS value FROM marked""")
def p3(spark, sf):
    return rounded(prep.fill_gaps(readings(spark, sf, True), 1).select("test_id", "channel", "seq", "value"))


@query("p4_drop_incomplete", f"WITH {GAPPED} SELECT test_id, channel, seq, value FROM readings r WHERE NOT EXISTS (SELECT 1 FROM readings b WHERE b.test_id = r.test_id AND b.seq = r.seq AND b.value IS NULL)")
def p4(spark, sf):
    return prep.drop_incomplete(readings(spark, sf, True)).select("test_id", "channel", "seq", "value")


@query("p4_carry", f"WITH {GAPPED}, {NEAR} SELECT test_id, channel, seq, coalesce(prev, next) AS value FROM near")
def p4b(spark, sf):
    return prep.carry(readings(spark, sf, True)).select("test_id", "channel", "seq", "value")


@query("p5_resample", f"""WITH {READINGS}, ends AS (SELECT test_id, channel, min(time_s) AS t0, max(time_s) AS t1 FROM readings GROUP BY ALL),
  grid AS (SELECT test_id, channel, unnest(range(0, CAST(ceil((t1 - t0) * 0.00005) AS BIGINT))) AS seq, t0 FROM ends),
  instants AS (SELECT test_id, channel, seq, t0 + seq / 0.00005 AS t FROM grid),
  lo AS (SELECT g.*, a.time_s AS ta, a.value AS va FROM instants g ASOF JOIN readings a ON g.test_id = a.test_id AND g.channel = a.channel AND g.t >= a.time_s),
  hi AS (SELECT g.*, b.time_s AS tb, b.value AS vb FROM lo g ASOF LEFT JOIN readings b ON g.test_id = b.test_id AND g.channel = b.channel AND g.t <= b.time_s)
  SELECT test_id, channel, seq, round(CASE WHEN tb IS NULL OR ta = t THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END, 6) AS value FROM hi""")
def p5(spark, sf):
    return rounded(prep.resample(readings(spark, sf), 0.00005).select("test_id", "channel", "seq", "value"))


@query("p7_role_resolution", f"""WITH {RAW}, t AS (SELECT DISTINCT test_id, CAST(substr(test_id, 2) AS BIGINT) % 2 AS old FROM raw)
  SELECT test_id, 'upstream_pressure' AS role, 'view' AS channel FROM t UNION ALL SELECT test_id, 'mass_flow', CASE WHEN old = 1 THEN 'purchase' ELSE 'click' END FROM t""")
def p7(spark, sf):
    tests = raw_readings(spark, sf).select("test_id").distinct()
    old = F.substring("test_id", 2, 20).cast("long") % 2 == 1
    roles = F.create_map(F.lit("inlet_pressure"), F.lit("view"), F.lit("mf"), F.lit("click"))
    columns = F.create_map(F.lit("upstream_pressure"), F.lit("view"), F.lit("mass_flow"), F.lit("purchase"))
    return prep.resolve_roles(tests.select("test_id", F.when(~old, roles).alias("sensor_roles"), columns.alias("columns")))


WINDOWS = "windows AS (SELECT test_id, max(time_s) * 0.25 AS start_s, max(time_s) * 0.75 AS end_s FROM readings GROUP BY test_id)"


def middle(df):
    return df.groupBy("test_id").agg((F.max("time_s") * 0.25).alias("start_s"), (F.max("time_s") * 0.75).alias("end_s"))


@query("p8_steady_slice", f"WITH {READINGS}, {WINDOWS} SELECT test_id, channel, seq, time_s, value FROM readings JOIN windows USING (test_id) WHERE time_s BETWEEN start_s AND end_s")
def p8(spark, sf):
    r = readings(spark, sf)
    return prep.steady_slice(r, middle(r)).select("test_id", "channel", "seq", "time_s", "value")


@query("p9_channel_means", f"WITH {GAPPED}, {WINDOWS} SELECT test_id, channel, round(avg(value), 8) AS mean, count(value) AS n FROM readings JOIN windows USING (test_id) WHERE time_s BETWEEN start_s AND end_s GROUP BY ALL HAVING count(value) > 0")
def p9(spark, sf):
    r = readings(spark, sf, True)
    return rounded(prep.channel_means(prep.steady_slice(r, middle(r))), 8)


@query("p10_fluid_state", f"""WITH {READINGS}, m AS (SELECT test_id, avg(value) FILTER (channel = 'error') AS t, avg(value) FILTER (channel = 'view') AS p FROM readings GROUP BY test_id)
  SELECT test_id, round(coalesce(CASE WHEN t < 200 THEN t + 273.15 ELSE t END, 293.15), 6) AS temperature_k, round(coalesce(p * 1e5, 101325.0), 3) AS pressure_pa FROM m""")
def p10(spark, sf):
    r = readings(spark, sf)
    roles = r.select("test_id").distinct().select("test_id", F.explode(F.create_map(F.lit("temperature"), F.lit("error"), F.lit("upstream_pressure"), F.lit("view"))).alias("role", "channel"))
    return prep.fluid_state(r, roles).select("test_id", F.round("temperature_k", 6).alias("temperature_k"), F.round("pressure_pa", 3).alias("pressure_pa"))


@query("p11_interpolate_all", f"WITH {GAPPED}, {NEAR} SELECT test_id, channel, seq, round(coalesce(value, {LERP}, prev, next), 6) AS value FROM near WHERE coalesce(value, {LERP}, prev, next) IS NOT NULL")
def p11(spark, sf):
    return rounded(prep.fill_all(readings(spark, sf, True)).select("test_id", "channel", "seq", "value"))


@query("p12_equality_filter", f"WITH {RESULTS} SELECT campaign_name, test_id, part, avg_price FROM results WHERE part IN ('1-URGENT', '5-LOW') AND status IN ('F')")
def p12(spark, sf):
    return results(spark, sf).where(F.col("part").isin("1-URGENT", "5-LOW") & F.col("status").isin("F")).select("campaign_name", "test_id", "part", "avg_price")


@query("p13_metric_columns", f"WITH {RESULTS} SELECT parameter, count(value) AS n, round(avg(value), 6) AS mean FROM (SELECT 'avg_price' AS parameter, avg_price AS value FROM results UNION ALL SELECT 'avg_balance', avg_balance FROM results) GROUP BY parameter")
def p13(spark, sf):
    return rounded(prep.results_long(results(spark, sf)).groupBy("parameter").agg(F.count("value").alias("n"), F.avg("value").alias("mean")))
