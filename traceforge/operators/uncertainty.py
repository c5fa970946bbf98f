"""Performance metrics with propagated uncertainty.

Long measurements ``(test_id, name, value, u)`` come from channel means by role; metrics are Column
expressions with their sensitivities, so a user's own metric family is a ``MetricFamily`` of Columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceforge.functions.series import ratio
from traceforge.operators import qc

G0 = 9.80665
INF = float("inf")
# Two-sided normal factors by confidence.
NORMAL = {0.6827: 1.0, 0.90: 1.645, 0.95: 1.96, 0.9545: 2.0, 0.99: 2.576, 0.9973: 3.0}


# ---- Student quantiles -------------------------------------------------------------------------------------


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def t_quantile(p: float, dof: float) -> float:
    """Inverse of Student's distribution function, by bisection."""
    low, high = 0.0, 1e3 if dof > 1 else 1e6

    def cdf(t: float) -> float:
        return 1 - 0.5 * incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))

    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def coverage_table(spark: SparkSession, confidence: float, most_dof: int = 29) -> DataFrame:
    """``(dof, k)`` up to the largest number of degrees for which the t quantile is used."""
    return spark.createDataFrame([(d, t_quantile(0.5 + confidence / 2, d)) for d in range(1, most_dof + 1)], "dof long, k double")


def with_coverage(df: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Adds ``k`` and ``expanded``: t quantile under 30 degrees of freedom, else the normal factor."""
    normal = NORMAL.get(confidence) or t_quantile(0.5 + confidence / 2, 1e7)
    j = df.join(F.broadcast(coverage_table(df.sparkSession, confidence)), "dof", "left")
    j = j.withColumn("k", F.coalesce("k", F.lit(normal)))
    return j.withColumn("expanded", F.col("k") * F.col("u"))


# ---- Sensor, statistical and combined uncertainty ----------------------------------------------------------


def sensor_u(kind: Column, amount: Column, full_scale: Column, value: Column) -> Column:
    """Standard uncertainty of a reading from a spec: ``abs``, ``pct_fs``, or relative (the default, 1 %)."""
    amount = F.coalesce(amount, F.lit(0.01))
    return F.when(kind == "abs", amount).when(kind == "pct_fs", amount * full_scale).otherwise(F.abs(value) * amount)


def measured(means: DataFrame, roles: DataFrame, specs: DataFrame, *more: str) -> DataFrame:
    """``(test_id, role, value, u, rel)`` from channel means, roles and ``specs(channel, u_type, u_value, full_scale)``.

    ``roles`` is ``(channel, role)`` or ``(test_id, channel, role)``. With ``more`` columns of the means, channels without
    a role stay, under a null role.
    """
    on = [c for c in ("test_id", "channel") if c in roles.columns]
    j = means.join(roles.select(*on, "role"), on, "left" if more else "inner").join(specs, "channel", "left")
    u = F.when(F.col("mean").isNotNull(), sensor_u(F.col("u_type"), F.col("u_value"), F.col("full_scale"), F.col("mean")))
    return j.select("test_id", "role", F.col("mean").alias("value"), u.alias("u"), *more).withColumn("rel", ratio(F.col("u"), F.abs("value")))


def statistical(df: DataFrame, value: str, *keys: str, confidence: float = 0.95) -> DataFrame:
    """Mean, deviation, and the half width of the mean's confidence interval; infinite for one sample."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("s")).withColumn("dof", F.col("n") - 1)
    j = with_coverage(g.withColumn("u", F.col("s") / F.sqrt("n")), confidence)
    return j.withColumn("u_stat", F.when(F.col("n") < 2, INF).otherwise(F.col("expanded"))).drop("u", "expanded")


def combined(systematic: Column, statistical: Column) -> Column:
    return F.hypot(systematic, statistical)


def geometry_pairs(configs: DataFrame) -> DataFrame:
    """``(test_id, key, value, u)`` from a map of values and ``<key without unit>_uncertainty_<unit>`` entries."""
    items = configs.select("test_id", F.explode("geometry").alias("name", "number"))
    values = items.where(~F.col("name").contains("_uncertainty"))
    own = F.regexp_replace("name", "_uncertainty", "")
    u = items.where(F.col("name").contains("_uncertainty")).select("test_id", own.alias("name"), F.col("number").alias("u"))
    return values.join(u, ["test_id", "name"], "left").select("test_id", F.col("name").alias("key"), F.col("number").alias("value"), "u")


def propagate(inputs: DataFrame, correlations: DataFrame | None = None) -> DataFrame:
    """Combined uncertainty from ``(test_id, name, sensitivity, u)`` with ``correlations(a, b, r)`` between names."""
    terms = inputs.select("test_id", "name", (F.col("sensitivity") * F.col("u")).alias("t"))
    own = terms.groupBy("test_id").agg(F.sum(F.col("t") * F.col("t")).alias("v"))
    if correlations is None:
        cross = own.select("test_id", F.lit(0.0).alias("w"))
    else:
        a = terms.select("test_id", F.col("name").alias("a"), F.col("t").alias("ta"))
        b = terms.select("test_id", F.col("name").alias("b"), F.col("t").alias("tb"))
        both = a.join(correlations.where("a <> b"), "a").join(b, ["test_id", "b"])
        cross = both.groupBy("test_id").agg(F.sum(2 * F.col("ta") * F.col("tb") * F.col("r")).alias("w"))
    total = F.col("v") + F.coalesce("w", F.lit(0.0))
    return own.join(cross, "test_id", "left").select("test_id", F.sqrt(F.greatest(total, F.lit(0.0))).alias("u"))


# ---- Metric families ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Metric:
    """A value and its relative uncertainty as Columns over ``<role>``, ``u_<role>`` and ``rel_<role>``."""

    name: str
    unit: str
    value: Column
    u: Column
    where: Column | None = None


@dataclass(frozen=True)
class MetricFamily:
    """A test type: the roles it needs, its metrics, further quality checks, and its result columns."""

    name: str
    roles: tuple[str, ...]
    metrics: Callable[[], list[Metric]]
    checks: Callable[[DataFrame], list[DataFrame]] = field(default=lambda readings: [])
    #: Checks of readings whose channels are named by their roles.
    role_checks: Callable[[DataFrame], list[DataFrame]] = field(default=lambda readings: [])
    #: Result columns that say whether a check passed (1 or 0, null where it did not run), and columns that are declared only.
    verdicts: dict[str, str] = field(default_factory=dict)
    declared: tuple[str, ...] = ()
    columns: dict[str, str] = field(default_factory=dict)
    #: Roles of constants, such as areas and densities, that the metrics use beside the measured ones.
    constants: tuple[str, ...] = ()


def c(name: str) -> Column:
    return F.col(name)


def rss(*relative: Column) -> Column:
    return F.sqrt(reduce(Column.__add__, [F.pow(F.coalesce(r, F.lit(0.0)), F.lit(2)) for r in relative]))


def cold_flow_metrics() -> list[Metric]:
    """Upstream pressure (bar), flow (g/s), pressure drop (bar) and discharge coefficient."""
    dp = F.col("upstream_pressure") - F.coalesce("downstream_pressure", F.lit(0.0))
    u_dp = F.hypot(F.col("u_upstream_pressure"), F.coalesce("u_downstream_pressure", F.lit(0.0)))
    cd = c("mass_flow") / 1000 / (c("area_m2") * F.sqrt(2 * c("density") * dp * 1e5))
    rel = rss(c("rel_mass_flow"), c("rel_area_m2"), 0.5 * c("rel_density"), 0.5 * ratio(u_dp, F.abs(dp)))
    ok = (c("area_m2") > 0) & (dp > 0) & (c("mass_flow") > 0) & (c("density") > 0)
    return [
        Metric("pressure_upstream", "bar", c("upstream_pressure"), c("u_upstream_pressure")),
        Metric("mass_flow", "g/s", c("mass_flow"), c("u_mass_flow")),
        Metric("delta_p", "bar", dp, u_dp),
        Metric("Cd", "-", F.when(ok, cd), F.when(ok, F.abs(cd) * rel), ok),
    ]


def hot_fire_metrics() -> list[Metric]:
    """Chamber pressure (bar), thrust (N), total flow (g/s), mixture ratio, specific impulse (s), characteristic velocity (m/s)."""
    flow = c("mass_flow_ox") + c("mass_flow_fuel")
    u_flow = F.hypot(c("u_mass_flow_ox"), c("u_mass_flow_fuel"))
    rel_flow = ratio(u_flow, F.abs(flow))
    isp = c("thrust") / (flow / 1000 * G0)
    star = c("chamber_pressure") * 1e5 * c("throat_m2") / (flow / 1000)
    of = c("mass_flow_ox") / c("mass_flow_fuel")
    on = flow > 0
    return [
        Metric("chamber_pressure", "bar", c("chamber_pressure"), c("u_chamber_pressure")),
        Metric("thrust", "N", c("thrust"), c("u_thrust")),
        Metric("mass_flow_total", "g/s", flow, u_flow),
        Metric("of_ratio", "-", F.when(c("mass_flow_fuel") > 0, of), F.abs(of) * rss(c("rel_mass_flow_ox"), c("rel_mass_flow_fuel")), c("mass_flow_fuel") > 0),
        Metric("Isp", "s", F.when(on, isp), F.abs(isp) * rss(c("rel_thrust"), rel_flow), on),
        Metric("c_star", "m/s", F.when(on & (c("throat_m2") > 0), star), F.abs(star) * rss(c("rel_chamber_pressure"), c("rel_throat_m2"), rel_flow), on & (c("throat_m2") > 0)),
    ]


COLD_FLOW = MetricFamily("cold_flow", ("upstream_pressure", "downstream_pressure", "mass_flow"), cold_flow_metrics, columns={"pressure_upstream": "p_up_bar", "mass_flow": "mf_g_s", "delta_p": "dp_bar", "Cd": "cd"}, constants=("area_m2", "density"))
HOT_FIRE = MetricFamily(
    "hot_fire", ("chamber_pressure", "thrust", "mass_flow_ox", "mass_flow_fuel"), hot_fire_metrics, columns={"chamber_pressure": "pc_bar", "thrust": "thrust_n", "mass_flow_total": "mf_total_g_s", "of_ratio": "of_ratio", "Isp": "isp_s", "c_star": "c_star_m_s"}, constants=("throat_m2",),
    role_checks=lambda readings: qc.hot_fire_checks(readings, "chamber_pressure", "mass_flow_ox", "mass_flow_fuel"), verdicts={"ignition_successful": "ignition"}, declared=("avg_cf", "eta_c_star_pct", "eta_isp_pct", "total_impulse_ns"),
)


def wide_inputs(inputs: DataFrame, family: MetricFamily, constants: tuple[str, ...], *more: Column) -> DataFrame:
    """One row per test with ``<role>``, ``u_<role>``, ``rel_<role>`` of roles and of constants such as area and density, and ``more`` aggregates."""
    names = [*family.roles, *constants]
    picks = [F.max(F.when(F.col("role") == r, F.col(k))).alias(p + r) for r in names for k, p in (("value", ""), ("u", "u_"), ("rel", "rel_"))]
    return inputs.groupBy("test_id").agg(*picks, *more)


def metric_values(family: MetricFamily) -> dict[str, tuple[Column, Column]]:
    """Value and uncertainty of each metric over :func:`wide_inputs`, null where its inputs or its condition are missing."""
    found = {}
    for m in family.metrics():
        value = m.value.cast("double") if m.where is None else F.when(m.where, m.value.cast("double"))
        found[m.name] = value, F.when(value.isNotNull(), m.u.cast("double"))
    return found


def family_metrics(inputs: DataFrame, family: MetricFamily, constants: tuple[str, ...] = ()) -> DataFrame:
    """``(test_id, name, value, u, unit)``: every metric of the family that its inputs allow."""
    wide = wide_inputs(inputs, family, constants)
    rows = [F.struct(F.lit(m.name).alias("name"), m.value.cast("double").alias("value"), m.u.cast("double").alias("u"), F.lit(m.unit).alias("unit")) for m in family.metrics()]
    # null inputs and failed conditions give a null value and no row
    with_nulls = [F.when(F.coalesce(m.where, F.lit(False)) if m.where is not None else F.lit(True), r) for m, r in zip(family.metrics(), rows)]
    return wide.select("test_id", F.explode(F.array(*with_nulls)).alias("m")).where("m.value is not null").select("test_id", "m.*")


def result_row(metrics: DataFrame, family: MetricFamily) -> DataFrame:
    """Measurements as one row per test with ``avg_*`` and ``u_*`` columns of the family."""
    picks = [F.max(F.when(F.col("name") == n, F.col(k))).alias(p + col) for n, col in family.columns.items() for k, p in (("value", "avg_"), ("u", "u_"))]
    return metrics.groupBy("test_id").agg(*picks)


# ---- Fluids ------------------------------------------------------------------------------------------------

# Density at 293.15 K and 1 atm (kg/m3), molar mass (kg/kmol), heat-capacity ratio, is a gas.
FLUIDS = [
    ("water", 998.2, 18.015, None, False), ("nitrogen", 1.165, 28.014, 1.4, True), ("oxygen", 1.331, 31.998, 1.4, True), ("helium", 0.1664, 4.0026, 1.667, True),
    ("air", 1.204, 28.96, 1.4, True), ("ethanol", 789.0, 46.07, None, False), ("methane", 0.668, 16.04, 1.32, True), ("hydrogen", 0.0838, 2.016, 1.41, True),
    ("isopropanol", 786.0, 60.096, None, False), ("n-dodecane", 750.0, 170.33, None, False), ("nitrous oxide", 1.83, 44.013, 1.27, True),
]
# Fixed values at the same state: dynamic viscosity (Pa s), specific heat (J/kg K), thermal conductivity (W/m K).
TRANSPORT = [
    ("water", 0.001002, 4182.0, 0.598), ("nitrogen", 1.76e-5, 1040.0, 0.0258), ("oxygen", 2.04e-5, 918.0, 0.0263), ("helium", 1.96e-5, 5193.0, 0.152), ("air", 1.81e-5, 1006.0, 0.0257),
    ("ethanol", 0.00109, 2440.0, 0.171), ("isopropanol", 0.00237, 2600.0, 0.140), ("n-dodecane", 0.00134, 2210.0, 0.140), ("nitrous oxide", 1.46e-5, 880.0, 0.017),
]
# Other names of the fluids.
ALIASES = [
    ("h2o", "water"), ("n2", "nitrogen"), ("gn2", "nitrogen"), ("o2", "oxygen"), ("gox", "oxygen"), ("he", "helium"), ("etoh", "ethanol"), ("ethyl alcohol", "ethanol"), ("ch4", "methane"), ("h2", "hydrogen"),
    ("ipa", "isopropanol"), ("isopropyl alcohol", "isopropanol"), ("2-propanol", "isopropanol"), ("rp-1", "n-dodecane"), ("rp1", "n-dodecane"), ("kerosene", "n-dodecane"), ("jet-a", "n-dodecane"),
    ("dodecane", "n-dodecane"), ("n2o", "nitrous oxide"), ("nitrous", "nitrous oxide"),
]


def fluid_table(spark: SparkSession) -> DataFrame:
    """Properties by every name a fluid goes by."""
    transport = {t[0]: t[1:] for t in TRANSPORT}
    by_name = {f[0]: (*f, *transport.get(f[0], (None, None, None))) for f in FLUIDS}
    rows = [(n, *f) for n, f in [*by_name.items(), *((a, by_name[n]) for a, n in ALIASES)]]
    return spark.createDataFrame(rows, "alias string, fluid string, density_ref double, molar_mass double, gamma double, gas boolean, viscosity double, specific_heat double, conductivity double")


def fluid_properties(tests: DataFrame) -> DataFrame:
    """Density, its uncertainty, sound speed and compressibility from ``(test_id, fluid_name, temperature_k, pressure_pa)``,
    with viscosity, specific heat and conductivity at the reference state.

    Gases follow the ideal law from the reference state; 2 % for liquids, 5 % for gases. Unknown fluids stay null.
    """
    j = tests.join(F.broadcast(fluid_table(tests.sparkSession)), F.lower(F.trim("fluid_name")) == F.col("alias"), "left").drop("alias")
    gas = F.col("density_ref") * (F.col("pressure_pa") / 101325.0) * (293.15 / F.col("temperature_k"))
    density = F.when(F.col("gas"), gas).otherwise(F.col("density_ref"))
    j = j.withColumn("density", density)
    speed = F.when(F.col("gas"), F.sqrt(F.col("gamma") * 8.314 * F.col("temperature_k") / (F.col("molar_mass") / 1000)))
    return j.withColumns({"u_density": F.col("density") * F.when(F.col("gas"), 0.05).otherwise(0.02), "sound_speed": speed, "compressible": F.col("gas")})


def propellant_properties(tests: DataFrame) -> DataFrame:
    """Properties of both fluids of ``(test_id, oxidizer, fuel, temperature_k, pressure_pa)``, under ``ox_`` and ``fuel_``."""
    names = ("fluid", "density", "u_density", "viscosity", "specific_heat", "conductivity")
    state = ("test_id", "temperature_k", "pressure_pa")

    def side(column: str, prefix: str) -> DataFrame:
        found = fluid_properties(tests.select(*state, F.col(column).alias("fluid_name")))
        return found.select("test_id", *[F.col(n).alias(prefix + n) for n in names])

    return side("oxidizer", "ox_").join(side("fuel", "fuel_"), "test_id")


def density(tests: DataFrame) -> DataFrame:
    """First of: metadata density, config density, table density; 1000 at the end; 0.5 % where no uncertainty is given."""
    value = F.coalesce("metadata_density", "config_density", "table_density", F.lit(1000.0))
    return tests.select("test_id", value.alias("density"), F.coalesce("given_u", 0.005 * value).alias("u_density"))


# ---- Display and Monte Carlo -------------------------------------------------------------------------------


def shown(value: Column, u: Column) -> Column:
    """``value +- u`` rounded to two significant figures of the uncertainty."""
    digits = F.when(u > 0, F.greatest(F.lit(0), 1 - F.floor(F.log10(u)))).otherwise(3).cast("int")
    return F.concat(fixed(value, digits), F.lit(" ± "), fixed(u, digits))


def fixed(x: Column, digits: Column) -> Column:
    return F.regexp_replace(F.call_function("format_number", x, digits), ",", "")


def normal_draw(test: Column, draw: Column, name: str, seed: int) -> Column:
    """A standard normal that depends only on test, draw, variable and seed, so a lost task draws the same again."""

    def uniform(salt: str) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(test, draw, F.lit(name), F.lit(salt), F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)

    return F.sqrt(-2 * F.log(uniform("a"))) * F.cos(2 * math.pi * uniform("b"))


def monte_carlo(inputs: DataFrame, names: list[str], metric: Column, draws: int = 2000, seed: int = 42, correlation: list[list[float]] | None = None) -> DataFrame:
    """Mean, deviation and percentiles of ``metric`` (a Column over ``names``) under normal inputs.

    ``inputs`` has ``test_id`` and, for each name, the columns ``name`` and ``u_name``. With a correlation matrix the
    draws are mixed by its Cholesky factor. Draws that are not finite are left out.
    """
    n = len(names)
    factor = [[float(i == j) for j in range(n)] for i in range(n)]
    if correlation:
        for i in range(n):
            for j in range(i + 1):
                rest = correlation[i][j] - sum(factor[i][k] * factor[j][k] for k in range(j))
                factor[i][j] = math.sqrt(max(rest, 0.0)) if i == j else (rest / factor[j][j] if factor[j][j] else 0.0)
    many = inputs.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    many = many.withColumns({f"z_{x}": normal_draw(F.col("test_id"), F.col("draw"), x, seed) for x in names})
    mixed = {x: F.col(x) + F.col(f"u_{x}") * reduce(Column.__add__, [factor[i][j] * F.col(f"z_{names[j]}") for j in range(i + 1)]) for i, x in enumerate(names)}
    drawn = many.withColumns(mixed).select("test_id", metric.cast("double").alias("y")).where("y is not null and not isnan(y) and abs(y) < double('infinity')")
    levels = [0.0015, 0.01, 0.025, 0.05, 0.1587, 0.5, 0.8413, 0.95, 0.975, 0.99, 0.9985]
    g = drawn.groupBy("test_id").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.percentile("y", F.array(*map(F.lit, levels))).alias("percentiles"))
    half = (F.col("percentiles")[8] - F.col("percentiles")[2]) / 2
    return g.withColumn("k95", ratio(half, F.col("std")))
