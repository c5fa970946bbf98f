"""From recordings to campaign results for all tests in one job."""

from __future__ import annotations

import traceback
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceforge.operators import audit, qc, uncertainty
from traceforge.operators.steady import steady_auto, steady_channel, steady_cv, steady_derivative, steady_forest, steady_middle

#: Detectors by name, as functions of (readings, channel).
DETECTORS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "auto": steady_auto,
    "simple": steady_middle,
    "cv": steady_cv,
    "derivative": steady_derivative,
    "ml": lambda readings, channel: steady_forest(readings, [channel]),
}


#: A test's readings, ordered by channel and sample, to the ends of its steady window, or None where it has none.
UserDetector = Callable[[pd.DataFrame], tuple[float, float] | None]
#: A test's readings and its id to its measurements by name, each a value or a value with its uncertainty.
UserAnalysis = Callable[[pd.DataFrame, str], dict[str, float | tuple[float, float]]]


def user_windows(readings: DataFrame, detect: UserDetector) -> DataFrame:
    """``(test_id, start_s, end_s, method, error)``: a caller's function on each test, its exception as that test's ``error``.

    A test meets in one task, so give only the channels that the function needs.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        row: tuple = (None, None, "custom", None)
        try:
            found = detect(part.sort_values(["channel", "seq"], ignore_index=True))
            row = (None, None, "custom", "no steady window") if found is None else (float(found[0]), float(found[1]), "custom", None)
        except Exception as e:  # whatever a caller's function raises is that test's outcome
            row = (None, None, "custom", f"{type(e).__name__}: {e}")
        return pd.DataFrame([(part["test_id"].iloc[0], *row)], columns=["test_id", "start_s", "end_s", "method", "error"])

    return readings.groupBy("test_id").applyInPandas(run, "test_id string, start_s double, end_s double, method string, error string")


def user_batch(readings: DataFrame, measure: UserAnalysis) -> DataFrame:
    """``(test_id, success, error, trace, name, value, u)``: a caller's analysis of each test, a row for each measurement.

    A test whose analysis raises has one row with the error and its trace; the others stay whole.
    """
    columns = ["test_id", "success", "error", "trace", "name", "value", "u"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        test = part["test_id"].iloc[0]
        try:
            made = measure(part.sort_values(["channel", "seq"], ignore_index=True), test)
            pairs = [(name, *(v if isinstance(v, tuple) else (v, None))) for name, v in made.items()]
            rows = [(test, True, None, None, name, float(v), None if u is None else float(u)) for name, v, u in pairs] or [(test, True, None, None, None, None, None)]
        except Exception as e:  # as above
            rows = [(test, False, f"{type(e).__name__}: {e}", traceback.format_exc(), None, None, None)]
        return pd.DataFrame(rows, columns=columns)

    return readings.groupBy("test_id").applyInPandas(run, "test_id string, success boolean, error string, trace string, name string, value double, u double")


def windows_of(readings: DataFrame, detector: str | UserDetector, channel: str | None = None, roles: DataFrame | None = None) -> DataFrame:
    """``(test_id, start_s, end_s, method, error)`` by a named detector or a caller's function.

    A named detector works on ``channel``; without one on each test's own channel, by role first, then by name.
    """
    if callable(detector):
        own = readings if channel is None else readings.where(F.col("channel") == channel)
        return user_windows(own, detector)
    if channel is None:
        own = readings.join(steady_channel(readings, roles), ["test_id", "channel"], "left_semi").withColumn("channel", F.lit("signal"))
        found = DETECTORS[detector](own, "signal")
    else:
        found = DETECTORS[detector](readings, channel)
    return found.withColumn("error", F.lit(None).cast("string"))


def by_role(readings: DataFrame, roles: DataFrame) -> DataFrame:
    """Readings of channels that have a role, under the role's name."""
    on = ["test_id", "channel"] if "test_id" in roles.columns else ["channel"]
    return readings.join(roles.select(*on, "role"), on).withColumn("channel", F.col("role")).select(*readings.columns)


def apart(by_test: DataFrame) -> DataFrame:
    """A table by test, made by tasks of its own, so that a task that joins it to readings does not hold its sorts as well."""
    return by_test.repartition(by_test.sparkSession.sparkContext.defaultParallelism, F.xxhash64("test_id"))


def analyse(
    readings: DataFrame, roles: DataFrame, specs: DataFrame, family: uncertainty.MetricFamily, windows: DataFrame, constants: DataFrame | None = None, checks: DataFrame | None = None
) -> DataFrame:
    """One row for every test: steady slice, channel means, metrics with uncertainty, quality gate.

    ``roles`` is ``(channel, role)`` for all tests, or ``(test_id, channel, role)``; ``windows`` is ``(test_id, start_s, end_s,
    detector_error)``, a row a test at most; ``constants`` adds ``(test_id, role, value, u, rel)`` of the family's constants. The
    family's own checks join the given ones. A test that a blocking check fails has no metrics, but the checks that
    stopped it in ``failed_checks``. Means, constants and checks meet as rows of one aggregation by test, each from tasks of
    its own: joined to each other they would be one stage, whose tasks hold the sorts of all of them.
    """
    checks = qc.timestamps_increase(readings).unionByName(qc.missing(readings)) if checks is None else checks
    checks = reduce(DataFrame.unionByName, [*family.checks(readings), *family.role_checks(by_role(readings, roles))], checks)
    of_test = ("start_s", "end_s", "detector_error")
    inside = F.col("time_s").between(F.col("start_s"), F.col("end_s"))
    means = readings.join(apart(windows), "test_id", "left").groupBy("test_id", "channel", *of_test).agg(F.avg(F.when(inside, F.col("value"))).alias("mean"), F.count("*").alias("n"))
    means = means.withColumns({"n_samples": F.sum("n").over(Window.partitionBy("test_id")), "seen": F.col("mean").isNotNull()})
    facts = uncertainty.measured(means, roles, specs, *of_test, "n_samples", "seen")
    for more in (constants, apart(checks.select("test_id", "check", "status", "blocking"))):
        facts = facts if more is None else facts.unionByName(more, allowMissingColumns=True)
    failed = F.array_sort(F.collect_set(F.when((F.col("status") == "FAIL") & F.col("blocking"), F.col("check"))))
    ended = [F.max(F.when(F.col("check") == name, (F.col("status") == "PASS").cast("int"))).alias(column) for column, name in family.verdicts.items()]
    held = [F.max(c).alias(c) for c in (*of_test, "n_samples", "seen")]
    wide = uncertainty.wide_inputs(facts, family, family.constants, *held, F.when(F.size(failed) > 0, failed).alias("failed_checks"), *ended).where("n_samples is not null")
    metrics = uncertainty.metric_values(family)
    kept = F.col("failed_checks").isNull() & F.col("seen") & F.coalesce(*[v for v, _ in metrics.values()]).isNotNull()
    own = {p + column: metrics[name][k] for name, column in family.columns.items() for k, p in ((0, "avg_"), (1, "u_"))}
    own |= {c: F.col(c) for c in ("start_s", "end_s", "n_samples", *family.verdicts)} | {c: F.lit(None).cast("double") for c in family.declared}
    return wide.select("test_id", *[F.when(kept, c).alias(name) for name, c in own.items()], "failed_checks", "detector_error")


def constants_of(merged: DataFrame) -> DataFrame:
    """``(test_id, role, value, u, rel)`` of areas (given in mm2, known to half a percent) and density (to one) in merged configurations."""
    area = [F.struct(F.lit(role).alias("role"), (F.col("geometry")[key] / 1e6).alias("value"), F.lit(0.005).alias("rel")) for role, key in (("area_m2", "orifice_area_mm2"), ("throat_m2", "throat_area_mm2"))]
    density = F.struct(F.lit("density").alias("role"), F.col("density").cast("double").alias("value"), F.lit(0.01).alias("rel"))
    rows = merged.select("test_id", F.explode(F.array(*area, density)).alias("c")).select("test_id", "c.*").where("value is not null")
    return rows.select("test_id", "role", "value", (F.abs("value") * F.col("rel")).alias("u"), "rel")


def complete(
    readings: DataFrame, configs: DataFrame, metadata: DataFrame, specs: DataFrame, ranges: DataFrame, family: uncertainty.MetricFamily, detector: str | UserDetector, channel: str | None, critical: list[str], pressure: str, flow: str, analyst: str, version: str
) -> DataFrame:
    """One row for every test: merged and checked configuration, full quality run, steady window by ``detector``, metrics
    with uncertainty, and provenance. ``error`` says why a test has no metrics.

    ``configs`` is ``(test_id, config_name, test_type, u_types, density, geometry, fluid_name, sensor_roles, conditions)``,
    ``metadata`` its overriding part by test, ``specs`` the channels' uncertainties, ``ranges`` their limits; see
    :func:`windows_of` for ``detector`` and ``channel``.
    """
    merged = audit.merge_config(configs, metadata)
    invalid = audit.audit_configs(merged, "test_id").where(~F.col("valid")).select("test_id", "warnings")
    usable = readings.join(invalid, "test_id", "left_anti")
    roles = merged.select("test_id", F.explode("sensor_roles").alias("role", "channel"))
    tried = windows_of(usable, detector, channel, roles)
    checks = qc.full_run(usable, ranges, critical, pressure, flow)
    rows = analyse(usable, roles, specs, family, tried.drop("method").withColumnRenamed("error", "detector_error"), constants_of(merged), checks)
    held = merged.select("test_id", F.map_concat("conditions", F.create_map(F.lit("config_name"), F.col("config_name"), F.lit("fluid_name"), F.coalesce("fluid_name", F.lit("")))).alias("config"))
    tests = readings.select("test_id").distinct()
    found = tests.join(rows.drop("start_s", "end_s"), "test_id", "left").join(invalid, "test_id", "left")
    recorded = audit.provenance(found, audit.content_hash(readings), held, tried.where("error is null"), analyst, version)
    values = [f"avg_{c}" for c in family.columns.values()]
    success = F.coalesce(*values).isNotNull() & F.col("failed_checks").isNull() & F.col("warnings").isNull()
    error = (
        F.when(F.col("warnings").isNotNull(), F.concat(F.lit("configuration: "), F.array_join("warnings", ", ")))
        .when(F.col("failed_checks").isNotNull(), F.concat(F.lit("quality: "), F.array_join("failed_checks", ", ")))
        .when(F.col("detector_error").isNotNull(), F.concat(F.lit("detector: "), "detector_error"))
        .when(~success, "no metrics")
    )
    return recorded.withColumns({"success": success, "error": error}).drop("warnings", "failed_checks", "detector_error")


def batch(readings: DataFrame, roles: DataFrame, specs: DataFrame, family: uncertainty.MetricFamily, detector: str | UserDetector = "simple", channel: str | None = None, constants: DataFrame | None = None, checks: DataFrame | None = None) -> DataFrame:
    """Every test's outcome: ``success``, quality status, the error text of those that gave no result, and results.

    See :func:`windows_of` for ``detector`` and ``channel``; a test on which a caller's detector fails says so in ``error``.
    """
    windows = windows_of(readings, detector, channel, roles).drop("method").withColumnRenamed("error", "detector_error")
    j = analyse(readings, roles, specs, family, windows, constants, checks)
    j = j.withColumns({c: F.coalesce(c, F.when(F.array_contains("failed_checks", name), 0)) for c, name in family.verdicts.items()}) if family.verdicts else j
    values = [f"avg_{c}" for c in family.columns.values()]
    success = F.coalesce(*values).isNotNull() & F.col("failed_checks").isNull()
    error = F.when(F.col("failed_checks").isNotNull(), F.concat(F.lit("quality: "), F.array_join("failed_checks", ", "))).when(F.col("detector_error").isNotNull(), F.concat(F.lit("detector: "), "detector_error")).when(~success, "no metrics")
    return j.withColumns({"success": success, "error": error, "qc_status": F.when(F.col("failed_checks").isNull(), "PASS").otherwise("FAIL")}).drop("detector_error")


def batch_rates(outcomes: DataFrame) -> DataFrame:
    """Number and share of tests by outcome and quality status."""
    g = outcomes.groupBy("success", "qc_status").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # four rows at most
