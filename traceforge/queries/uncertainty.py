"""Uncertainty and metric queries."""

from pyspark.sql import functions as F

from traceforge.operators import prep, uncertainty
from traceforge.queries.base import READINGS, RESULTS, query, readings, results, rounded

MEANS = f"{READINGS}, mean AS (SELECT test_id, channel, avg(value) AS m FROM readings GROUP BY ALL)"
SPECS = [("view", "rel", 0.02, None), ("click", "abs", 0.5, None), ("error", "pct_fs", 0.01, 300.0), ("purchase", "pct_rd", 0.015, None)]
SPEC_SQL = "spec(channel, u_type, amount, fs) AS (VALUES ('view', 'rel', 0.02::DOUBLE, NULL), ('click', 'abs', 0.5::DOUBLE, NULL), ('error', 'pct_fs', 0.01::DOUBLE, 300.0::DOUBLE), ('purchase', 'pct_rd', 0.015::DOUBLE, NULL))"
MEASURED = f"{MEANS}, {SPEC_SQL}, meas AS (SELECT test_id, channel, m, CASE WHEN u_type = 'abs' THEN amount WHEN u_type = 'pct_fs' THEN amount * fs ELSE abs(m) * coalesce(amount, 0.01::DOUBLE) END AS u FROM mean LEFT JOIN spec USING (channel))"
COLD_ROLES = [("view", "upstream_pressure"), ("error", "downstream_pressure"), ("click", "mass_flow")]
HOT_ROLES = [("view", "chamber_pressure"), ("purchase", "thrust"), ("click", "mass_flow_ox"), ("signup", "mass_flow_fuel")]


def specs(spark):
    return spark.createDataFrame(SPECS, "channel string, u_type string, u_value double, full_scale double")


def inputs(spark, sf, roles, constants=()):
    means = prep.channel_means(readings(spark, sf))
    table = spark.createDataFrame(roles, "channel string, role string")
    own = means.select("test_id", "channel").join(F.broadcast(table), "channel")
    rows = uncertainty.measured(means, own, specs(spark))
    for name, value, u in constants:
        rows = rows.unionByName(means.select("test_id").distinct().select("test_id", F.lit(name).alias("role"), F.lit(value).alias("value"), F.lit(u).alias("u"), F.lit(u / value).alias("rel")))
    return rows


@query("u1_sensor_uncertainty", f"WITH {MEASURED} SELECT test_id, channel, round(u, 8) AS u, round(u / abs(m), 8) AS rel FROM meas")
def u1(spark, sf):
    means = prep.channel_means(readings(spark, sf))
    roles = means.select("test_id", "channel", F.col("channel").alias("role"))
    return rounded(uncertainty.measured(means, roles, specs(spark)).select("test_id", F.col("role").alias("channel"), "u", "rel"), 8)


@query("u2_geometry_pairs", f"WITH {RESULTS} SELECT test_id, 'orifice_mm' AS key, round(avg_price, 6) AS value, round(u_price, 6) AS u FROM results UNION ALL SELECT test_id, 'throat_mm', round(avg_balance, 6), NULL FROM results")
def u2(spark, sf):
    geometry = F.create_map(F.lit("orifice_mm"), F.col("avg_price"), F.lit("orifice_uncertainty_mm"), F.col("u_price"), F.lit("throat_mm"), F.col("avg_balance"))
    return rounded(uncertainty.geometry_pairs(results(spark, sf).select("test_id", geometry.alias("geometry"))), 6)


AREA, U_AREA, RHO, U_RHO = 2e-6, 4e-8, 998.2, 5.0
COLD = f"""{MEASURED}, w AS (SELECT test_id, max(m) FILTER (channel = 'view') AS p1, max(u) FILTER (channel = 'view') AS u1, max(m) FILTER (channel = 'error') AS p2, max(u) FILTER (channel = 'error') AS u2, max(m) FILTER (channel = 'click') AS f, max(u) FILTER (channel = 'click') AS uf FROM meas GROUP BY test_id),
  d AS (SELECT *, p1 - p2 AS dp, sqrt(u1 * u1 + u2 * u2) AS udp FROM w),
  k AS (SELECT *, f / 1000 / ({AREA!r}::DOUBLE * sqrt(2 * {RHO}::DOUBLE * dp * 1e5)) AS cd FROM d WHERE dp > 0),
  q AS (SELECT test_id, 'pressure_upstream' AS name, p1 AS value, u1 AS u, 'bar' AS unit FROM d UNION ALL SELECT test_id, 'mass_flow', f, uf, 'g/s' FROM d UNION ALL SELECT test_id, 'delta_p', dp, udp, 'bar' FROM d
    UNION ALL SELECT test_id, 'Cd', cd, abs(cd) * sqrt(pow(uf / f, 2) + pow({U_AREA / AREA!r}::DOUBLE, 2) + pow(0.5::DOUBLE * {U_RHO / RHO!r}::DOUBLE, 2) + pow(0.5::DOUBLE * udp / abs(dp), 2)), '-' FROM k)"""


def cold(spark, sf):
    return uncertainty.family_metrics(inputs(spark, sf, COLD_ROLES, [("area_m2", AREA, U_AREA), ("density", RHO, U_RHO)]), uncertainty.COLD_FLOW, ("area_m2", "density"))


@query("u3_u4_u8_cold_flow", f"WITH {COLD} SELECT test_id, name, round(value, 7) AS value, round(u, 7) AS u, unit FROM q")
def u8(spark, sf):
    return rounded(cold(spark, sf), 7)


HOT = f"""{MEASURED}, w AS (SELECT test_id, max(m) FILTER (channel = 'view') AS pc, max(u) FILTER (channel = 'view') AS upc, max(m) FILTER (channel = 'purchase') AS t, max(u) FILTER (channel = 'purchase') AS ut, max(m) FILTER (channel = 'click') AS o, max(u) FILTER (channel = 'click') AS uo, max(m) FILTER (channel = 'signup') AS f, max(u) FILTER (channel = 'signup') AS uf FROM meas GROUP BY test_id),
  d AS (SELECT *, o + f AS mf, sqrt(uo * uo + uf * uf) AS umf FROM w),
  q AS (SELECT test_id, 'chamber_pressure' AS name, pc AS value, upc AS u FROM d UNION ALL SELECT test_id, 'thrust', t, ut FROM d UNION ALL SELECT test_id, 'mass_flow_total', mf, umf FROM d
    UNION ALL SELECT test_id, 'of_ratio', o / f, o / f * sqrt(pow(uo / o, 2) + pow(uf / f, 2)) FROM d
    UNION ALL SELECT test_id, 'Isp', t / (mf / 1000 * 9.80665::DOUBLE), t / (mf / 1000 * 9.80665::DOUBLE) * sqrt(pow(ut / t, 2) + pow(umf / mf, 2)) FROM d
    UNION ALL SELECT test_id, 'c_star', pc * 1e5 * 0.0001::DOUBLE / (mf / 1000), pc * 1e5 * 0.0001::DOUBLE / (mf / 1000) * sqrt(pow(upc / pc, 2) + pow(0.01::DOUBLE, 2) + pow(umf / mf, 2)) FROM d)"""


@query("u5_u6_u7_u9_hot_fire", f"WITH {HOT} SELECT test_id, name, round(value, 6) AS value, round(u, 6) AS u FROM q")
def u9(spark, sf):
    rows = inputs(spark, sf, HOT_ROLES, [("throat_m2", 1e-4, 1e-6)])
    return rounded(uncertainty.family_metrics(rows, uncertainty.HOT_FIRE, ("throat_m2",)).select("test_id", "name", "value", "u"), 6)


T_TABLE = "t(dof, k) AS (VALUES " + ", ".join(f"({d}, {uncertainty.t_quantile(0.975, d)!r}::DOUBLE)" for d in range(1, 30)) + ")"


@query("u10_statistical", f"WITH {READINGS}, {T_TABLE}, g AS (SELECT test_id, channel, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS s FROM readings GROUP BY ALL) SELECT test_id, channel, n, round(mean, 8) AS mean, round(s, 8) AS s, round(CASE WHEN n < 2 THEN 'inf'::DOUBLE ELSE coalesce(k, 1.96::DOUBLE) * s / sqrt(n) END, 8) AS u_stat FROM g LEFT JOIN t ON t.dof = n - 1")
def u10(spark, sf):
    return rounded(uncertainty.statistical(readings(spark, sf), "value", "test_id", "channel").select("test_id", "channel", "n", "mean", "s", "u_stat"), 8)


@query("u11_u12_combined_expanded", f"WITH {RESULTS}, {T_TABLE}, e AS (SELECT campaign_name, count(*) - 1 AS dof, sqrt(pow(avg(u_price), 2) + pow(stddev_samp(avg_price) / sqrt(count(*)), 2)) AS u FROM results GROUP BY ALL HAVING count(*) > 1) SELECT campaign_name, dof, round(u, 8) AS u, round(coalesce(k, 1.96::DOUBLE), 8) AS k, round(coalesce(k, 1.96::DOUBLE) * u, 8) AS expanded FROM e LEFT JOIN t USING (dof)")
def u12(spark, sf):
    g = results(spark, sf).groupBy("campaign_name").agg((F.count("*") - 1).alias("dof"), F.avg("u_price").alias("a"), (F.stddev_samp("avg_price") / F.sqrt(F.count("*"))).alias("b")).where("dof > 0")
    return rounded(uncertainty.with_coverage(g.select("campaign_name", "dof", uncertainty.combined(F.col("a"), F.col("b")).alias("u"))).select("campaign_name", "dof", "u", "k", "expanded"), 8)


@query("u13_correlated_propagation", f"WITH {RESULTS}, c AS (SELECT test_id, 0.5::DOUBLE * u_price AS a, -0.001::DOUBLE * abs(avg_balance) AS b FROM results) SELECT test_id, round(sqrt(greatest(0, a * a + b * b + 2 * 0.4::DOUBLE * a * b)), 8) AS u FROM c")
def u13(spark, sf):
    r = results(spark, sf)
    a = r.select("test_id", F.lit("a").alias("name"), F.lit(0.5).alias("sensitivity"), F.col("u_price").alias("u"))
    b = r.select("test_id", F.lit("b").alias("name"), F.lit(-0.001).alias("sensitivity"), F.abs("avg_balance").alias("u"))
    return rounded(uncertainty.propagate(a.unionByName(b), spark.createDataFrame([("a", "b", 0.4)], "a string, b string, r double")), 8)


@query("u14_u15_monte_carlo")
def u14(spark, sf):
    means = inputs(spark, sf, HOT_ROLES)
    wide = means.groupBy("test_id").agg(*[F.max(F.when(F.col("role") == r, F.col(k))).alias(p + r) for r in ("thrust", "mass_flow_ox") for k, p in (("value", ""), ("u", "u_"))])
    return uncertainty.monte_carlo(wide, ["thrust", "mass_flow_ox"], F.col("thrust") / (F.col("mass_flow_ox") / 1000 * uncertainty.G0), 1000, correlation=[[1.0, 0.3], [0.3, 1.0]])


@query("u16_density", f"WITH {RESULTS}, d AS (SELECT test_id, coalesce(CASE WHEN test_id % 5 = 0 THEN avg_price END, CASE WHEN test_id % 3 = 0 THEN avg_balance END, 1000::DOUBLE) AS density, CASE WHEN test_id % 7 = 0 THEN u_price END AS given FROM results) SELECT test_id, round(density, 8) AS density, round(coalesce(given, 0.005::DOUBLE * density), 8) AS u_density FROM d")
def u16(spark, sf):
    i = F.col("test_id")
    r = results(spark, sf).select(i, F.when(i % 5 == 0, F.col("avg_price")).alias("metadata_density"), F.when(i % 3 == 0, F.col("avg_balance")).alias("config_density"), F.lit(None).cast("double").alias("table_density"), F.when(i % 7 == 0, F.col("u_price")).alias("given_u"))
    return rounded(uncertainty.density(r), 8)


FLUID = "f(alias, fluid, rho, mm, gamma, gas) AS (VALUES ('n2', 'nitrogen', 1.165::DOUBLE, 28.014::DOUBLE, 1.4::DOUBLE, true), ('water', 'water', 998.2::DOUBLE, 18.015::DOUBLE, NULL, false), ('he', 'helium', 0.1664::DOUBLE, 4.0026::DOUBLE, 1.667::DOUBLE, true))"


@query("u17_fluid_properties", f"""WITH {RESULTS}, {FLUID}, t AS (SELECT test_id, CASE test_id % 4 WHEN 0 THEN 'n2' WHEN 1 THEN 'water' WHEN 2 THEN 'he' ELSE 'unknown' END AS a, 280.0::DOUBLE + avg_price / 10 AS k, 101325.0::DOUBLE * (1 + u_price) AS p FROM results),
  d AS (SELECT t.*, f.*, CASE WHEN gas THEN rho * (p / 101325.0::DOUBLE) * (293.15::DOUBLE / k) ELSE rho END AS density FROM t LEFT JOIN f ON a = alias)
  SELECT test_id, fluid, round(density, 8) AS density, round(density * CASE WHEN gas THEN 0.05::DOUBLE ELSE 0.02::DOUBLE END, 8) AS u_density, round(CASE WHEN gas THEN sqrt(gamma * 8.314::DOUBLE * k / (mm / 1000)) END, 7) AS sound_speed, gas AS compressible FROM d""")
def u17(spark, sf):
    i = F.col("test_id") % 4
    t = results(spark, sf).select("test_id", F.when(i == 0, " N2 ").when(i == 1, "water").when(i == 2, "He").otherwise("unknown").alias("fluid_name"), (280.0 + F.col("avg_price") / 10).alias("temperature_k"), (101325.0 * (1 + F.col("u_price"))).alias("pressure_pa"))
    df = uncertainty.fluid_properties(t)
    return df.select("test_id", "fluid", F.round("density", 8).alias("density"), F.round("u_density", 8).alias("u_density"), F.round("sound_speed", 7).alias("sound_speed"), "compressible")


DIGITS = "CASE WHEN u_price > 0 THEN greatest(0, 1 - CAST(floor(log10(u_price)) AS INT)) ELSE 3 END"


@query("u18_display", f"WITH {RESULTS} SELECT test_id, format('{{:.' || {DIGITS} || 'f}}', avg_price) || ' ± ' || format('{{:.' || {DIGITS} || 'f}}', u_price) AS shown FROM results")
def u18(spark, sf):
    return results(spark, sf).select("test_id", uncertainty.shown(F.col("avg_price"), F.col("u_price")).alias("shown"))


@query("u19_u20_result_row", f"WITH {COLD} SELECT test_id, " + ", ".join(f"round(max({k}) FILTER (name = '{n}'), 7) AS {p}{c}" for n, c in uncertainty.COLD_FLOW.columns.items() for k, p in (("value", "avg_"), ("u", "u_"))) + " FROM q GROUP BY test_id")
def u20(spark, sf):
    return rounded(uncertainty.result_row(cold(spark, sf), uncertainty.COLD_FLOW), 7)


PROPELLANTS = "f(alias, fluid, rho, gas, mu, cp, k) AS (VALUES ('n2o', 'nitrous oxide', 1.83::DOUBLE, true, 1.46e-5::DOUBLE, 880.0::DOUBLE, 0.017::DOUBLE), ('gox', 'oxygen', 1.331::DOUBLE, true, 2.04e-5::DOUBLE, 918.0::DOUBLE, 0.0263::DOUBLE), ('ipa', 'isopropanol', 786.0::DOUBLE, false, 0.00237::DOUBLE, 2600.0::DOUBLE, 0.14::DOUBLE), ('rp-1', 'n-dodecane', 750.0::DOUBLE, false, 0.00134::DOUBLE, 2210.0::DOUBLE, 0.14::DOUBLE))"


@query("u17_propellant_pair", f"""WITH {RESULTS}, {PROPELLANTS}, t AS (SELECT test_id, CASE test_id % 2 WHEN 0 THEN 'n2o' ELSE 'gox' END AS o, CASE test_id % 3 WHEN 0 THEN 'ipa' WHEN 1 THEN 'rp-1' END AS u, 280.0::DOUBLE + avg_price / 10 AS kelvin, 101325.0::DOUBLE * (1 + u_price) AS p FROM results),
  j AS (SELECT test_id, a.fluid AS ox_fluid, a.rho * (p / 101325.0) * (293.15::DOUBLE / kelvin) AS d, b.fluid AS fuel_fluid, b.rho AS e, a.mu AS ox_viscosity, b.mu AS fuel_viscosity, a.cp AS ox_specific_heat, b.cp AS fuel_specific_heat, a.k AS ox_conductivity, b.k AS fuel_conductivity
    FROM t JOIN f a ON a.alias = t.o LEFT JOIN f b ON b.alias = t.u)
  SELECT * EXCLUDE (d, e), round(d, 8) AS ox_density, round(d * 0.05::DOUBLE, 8) AS ox_u_density, round(e, 8) AS fuel_density, round(e * 0.02::DOUBLE, 8) AS fuel_u_density FROM j""")
def u17_pair(spark, sf):
    i = F.col("test_id")
    ox, fuel = F.when(i % 2 == 0, "N2O").otherwise(" GOX"), F.when(i % 3 == 0, "IPA").when(i % 3 == 1, "RP-1")
    t = results(spark, sf).select("test_id", ox.alias("oxidizer"), fuel.alias("fuel"), (280.0 + F.col("avg_price") / 10).alias("temperature_k"), (101325.0 * (1 + F.col("u_price"))).alias("pressure_pa"))
    return rounded(uncertainty.propellant_properties(t), 8)


@query("u16_density_of_the_table", f"""WITH {RESULTS}, {FLUID}, t AS (SELECT test_id, CASE test_id % 3 WHEN 0 THEN 'water' WHEN 1 THEN 'unknown' ELSE 'n2' END AS a, CASE WHEN test_id % 5 = 0 THEN 900.0::DOUBLE END AS given FROM results)
  SELECT test_id, round(coalesce(given, rho, 1000.0), 8) AS density, round(0.005::DOUBLE * coalesce(given, rho, 1000.0), 8) AS u_density FROM t LEFT JOIN f ON f.alias = t.a""")
def u16_table(spark, sf):
    i = F.col("test_id")
    name = F.when(i % 3 == 0, "Water").when(i % 3 == 1, "unknown").otherwise("N2")
    t = results(spark, sf).select("test_id", name.alias("fluid_name"), F.lit(293.15).alias("temperature_k"), F.lit(101325.0).alias("pressure_pa"))
    found = uncertainty.fluid_properties(t).select("test_id", F.lit(None).cast("double").alias("metadata_density"), F.when(i % 5 == 0, 900.0).alias("config_density"), F.col("density").alias("table_density"), F.lit(None).cast("double").alias("given_u"))
    return rounded(uncertainty.density(found), 8)
