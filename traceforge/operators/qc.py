"""Data-quality checks: every check gives one row per test and channel, ``(test_id, check, channel, status, blocking, metric)``.

``status`` is PASS, WARN, FAIL or SKIP; a test fails if a blocking check fails. ``metric`` is the number that
the rule compares.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceforge.functions.blocks import with_percentiles
from traceforge.functions.series import KEYS, by_series, correlation, median, ratio, rolling, with_stats

COLUMNS = ("test_id", "check", "channel", "status", "blocking", "metric")


def rows(df: DataFrame, check: str, status: Column, metric: Column, blocking: bool = True) -> DataFrame:
    return df.select("test_id", F.lit(check).alias("check"), "channel", status.alias("status"), F.lit(blocking).alias("blocking"), metric.cast("double").alias("metric"))


# The verdict of each check from its numbers, shared by the single checks and the full run.


def order_verdict(bad: Column) -> Column:
    return F.when(bad > 0, "FAIL").otherwise("PASS")


def gap_verdict(gaps: Column, n: Column) -> Column:
    return F.when(gaps == 0, "PASS").when(gaps / n < 0.01, "WARN").otherwise("FAIL")


def rate_verdict(n: Column, cv: Column, most: float) -> Column:
    return F.when(n < 10, "SKIP").when(cv > most, "WARN").otherwise("PASS")


def out_of_range(value: Column) -> Column:
    low, high = F.coalesce(value < F.col("min"), F.lit(False)), F.coalesce(value > F.col("max"), F.lit(False))
    return low | high | (~F.coalesce("allow_negative", F.lit(True)) & F.coalesce(value < 0, F.lit(False)))


def range_verdict(out: Column, n: Column) -> Column:
    return F.when((n == 0) | (out > 0), "FAIL").otherwise("PASS")


def flat_verdict(n: Column, flat: Column) -> Column:
    return F.when(n == 0, "SKIP").when(flat == 0, "PASS").when(ratio(flat, n) < 0.1, "WARN").otherwise("FAIL")


def saturation_verdict(n: Column, share: Column) -> Column:
    return F.when(n < 10, "SKIP").when(share > 0.10, "FAIL").when(share > 0.01, "WARN").otherwise("PASS")


def missing_verdict(share: Column, warn: float, fail: float) -> Column:
    return F.when(share > fail, "FAIL").when(share > warn, "WARN").otherwise("PASS")


def intervals(readings: DataFrame) -> DataFrame:
    return readings.withColumn("dt", F.col("time_s") - F.lag("time_s").over(by_series()))


def timestamps_increase(readings: DataFrame) -> DataFrame:
    """In file order, every step forward must be positive; the metric counts those that are not."""
    g = intervals(readings).groupBy(*KEYS).agg(F.count_if(F.col("dt") <= 0).alias("bad"))
    return rows(g, "timestamp_monotonic", order_verdict(F.col("bad")), F.col("bad"))


def violations(readings: DataFrame) -> DataFrame:
    """The first five positions of each series at which time does not move forward."""
    w = by_series()
    bad = intervals(readings).where("dt <= 0")
    return bad.withColumn("k", F.row_number().over(w)).where("k <= 5").groupBy(*KEYS).agg(F.array_sort(F.collect_list("seq")).alias("first"))


def timestamp_gaps(readings: DataFrame, factor: float = 3.0) -> DataFrame:
    """Intervals over ``factor`` times the median: under one in a hundred WARN, else FAIL."""
    steps = with_percentiles(intervals(readings).where("dt is not null"), "dt", {"mid": 0.5})
    g = steps.groupBy(*KEYS).agg(F.count_if(F.col("dt") > factor * F.col("mid")).alias("gaps"), F.count("*").alias("n"))
    return rows(g, "timestamp_gaps", gap_verdict(F.col("gaps"), F.col("n")), F.col("gaps"))


def rate_stability(readings: DataFrame, most: float = 0.10) -> DataFrame:
    """Coefficient of variation of the intervals (population deviation); a warning at most."""
    g = intervals(readings).groupBy(*KEYS).agg(F.count("dt").alias("n"), ratio(F.stddev_pop("dt"), F.avg("dt")).alias("cv"))
    return rows(g, "sampling_rate", rate_verdict(F.col("n"), F.col("cv"), most), F.col("cv"), False)


def sensor_range(readings: DataFrame, specs: DataFrame) -> DataFrame:
    """Values outside ``specs(channel, min, max, allow_negative)``; a configured channel without values fails too."""
    joined = readings.join(specs, "channel")
    g = joined.groupBy(*KEYS).agg(F.count_if(out_of_range(F.col("value"))).alias("out"), F.count("value").alias("n"))
    return rows(g, "sensor_range", range_verdict(F.col("out"), F.col("n")), F.col("out"))


def flatline(readings: DataFrame, width: int = 50, variance: float = 1e-10) -> DataFrame:
    """Share of full rolling windows with nearly no variance: under a tenth WARN, else FAIL."""
    v = F.col("value")
    rolled = readings.withColumn("var", rolling(F.var_samp(v), v, width))
    g = rolled.groupBy(*KEYS).agg(F.count("var").alias("n"), F.count_if(F.col("var") < variance).alias("flat"))
    return rows(g, "flatline", flat_verdict(F.col("n"), F.col("flat")), ratio(F.col("flat"), F.col("n")))


def saturation(readings: DataFrame) -> DataFrame:
    """The larger share of samples equal to the minimum or to the maximum: over 1 % WARN, over 10 % FAIL."""
    known = with_stats(readings.where("value is not null"), {"low": F.min("value"), "high": F.max("value")})
    g = known.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg((F.col("value") == F.col("low")).cast("int")).alias("a"), F.avg((F.col("value") == F.col("high")).cast("int")).alias("b"))
    share = F.greatest("a", "b")
    return rows(g, "saturation", saturation_verdict(F.col("n"), share), share, False)


def missing(readings: DataFrame, warn: float = 0.05, fail: float = 0.20) -> DataFrame:
    g = readings.groupBy(*KEYS).agg(F.avg(F.col("value").isNull().cast("int")).alias("share"))
    return rows(g, "nan_ratio", missing_verdict(F.col("share"), warn, fail), F.col("share"))


def paired(readings: DataFrame, left: str, right: str) -> DataFrame:
    """Two channels of a test side by side, by sample."""
    two = readings.where(F.col("channel").isin(left, right))
    g = two.groupBy("test_id", "seq").agg(F.max(F.when(F.col("channel") == left, F.col("value"))).alias("a"), F.max(F.when(F.col("channel") == right, F.col("value"))).alias("b"), F.min("time_s").alias("time_s"))
    return g


def correlated(readings: DataFrame, left: str, right: str, least: float = 0.3, check: str = "pressure_flow_correlation") -> DataFrame:
    """Pearson correlation over complete pairs."""
    g = paired(readings, left, right).where("a is not null and b is not null").groupBy("test_id").agg(F.count("*").alias("n"), correlation("a", "b").alias("r"))
    g = g.withColumn("channel", F.lit(f"{left}/{right}"))
    r = F.col("r")
    status = F.when(F.col("n") < 10, "SKIP").when(r.isNull() | F.isnan(r), "WARN").when(r >= least, "PASS").when(r < 0, "FAIL").otherwise("WARN")
    return rows(g, check, status, r, False)


def combustion_stability(readings: DataFrame, channel: str, width: int = 50, warn: float = 10.0, fail: float = 20.0) -> DataFrame:
    """Largest rolling peak-to-peak over mean, in percent, of the known samples."""
    known = readings.where((F.col("channel") == channel) & F.col("value").isNotNull())
    v = F.col("value")
    rolled = known.withColumns({"span": rolling(F.max(v), v, width) - rolling(F.min(v), v, width), "mid": rolling(F.avg(v), v, width)})
    g = rolled.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max(F.when(F.col("mid") > 0, F.col("span") / F.col("mid") * 100)).alias("rough"))
    status = F.when(F.col("n") < 2 * width, "SKIP").when(F.col("mean") <= 0, "FAIL").when(F.col("rough") <= warn, "PASS").when(F.col("rough") > fail, "FAIL").otherwise("WARN")
    return rows(g, "combustion_stability", status, F.col("rough"), False)


def ignition(readings: DataFrame, channel: str, threshold: float = 2.0) -> DataFrame:
    """Whether the channel ever reaches the threshold; the metric is the first time it does."""
    own = readings.where(F.col("channel") == channel)
    g = own.groupBy(*KEYS).agg(F.max("value").alias("top"), F.min(F.when(F.col("value") >= threshold, F.struct("seq", "time_s")))["time_s"].alias("at"))
    return rows(g, "ignition", F.when(F.col("top") >= threshold, "PASS").otherwise("FAIL"), F.col("at"))


def lead_lag(readings: DataFrame, first: str, second: str, share: float = 0.1, warn_ms: float = 500.0, fail_ms: float = 1000.0) -> DataFrame:
    """Time between the onsets (first sample over ``share`` of the maximum) of two flows; positive if ``first`` leads."""
    two = with_stats(readings.where(F.col("channel").isin(first, second)), {"top": F.max("value")})
    on = two.where(F.col("value") > share * F.col("top")).groupBy("test_id").agg(F.min(F.when(F.col("channel") == first, F.col("time_s"))).alias("a"), F.min(F.when(F.col("channel") == second, F.col("time_s"))).alias("b"))
    g = two.select("test_id").distinct().join(on, "test_id", "left").withColumn("channel", F.lit(f"{first}/{second}"))
    lag = (F.col("b") - F.col("a")) * 1000
    status = F.when(lag.isNull(), "WARN").when(F.abs(lag) > fail_ms, "FAIL").when(F.abs(lag) > warn_ms, "WARN").otherwise("PASS")
    return rows(g, "propellant_lead_lag", status, lag, False)


def hot_fire_checks(readings: DataFrame, chamber: str, ox: str, fuel: str) -> list[DataFrame]:
    """The checks that only firing tests have: combustion stability, ignition, lead or lag of the propellants."""
    return [combustion_stability(readings, chamber), ignition(readings, chamber), lead_lag(readings, ox, fuel)]


def full_run(
    readings: DataFrame, specs: DataFrame, critical: Sequence[str], pressure: str, flow: str, chamber: str | None = None, thrust: str | None = None, ox: str | None = None, fuel: str | None = None
) -> DataFrame:
    """All checks of a test in one table; hot-fire checks join where a chamber channel is named, lead and lag where both flows are.

    The checks of single channels share one windowed pass over the readings and two aggregations of it, instead
    of a pass each.
    """
    v, w = F.col("value"), by_series()
    known = specs.withColumn("has_spec", F.lit(True))
    e = readings.join(known, "channel", "left").withColumns({"dt": F.col("time_s") - F.lag("time_s").over(w), "var": rolling(F.var_samp(v), v, 50)})
    one = e.groupBy(*KEYS).agg(
        F.count_if(F.col("dt") <= 0).alias("bad"), F.count("dt").alias("n_dt"), median(F.col("dt")).alias("mid"), ratio(F.stddev_pop("dt"), F.avg("dt")).alias("cv"),
        F.count("var").alias("n_var"), F.count_if(F.col("var") < 1e-10).alias("flat"), F.avg(v.isNull().cast("int")).alias("share"), F.count("value").alias("known"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.first("has_spec").alias("has_spec"), F.count_if(out_of_range(v)).alias("out"),
    )
    two = e.select(*KEYS, "dt", "value").join(one.select(*KEYS, "mid", "low", "high"), list(KEYS)).groupBy(*KEYS).agg(
        F.count_if(F.col("dt") > 3 * F.col("mid")).alias("gaps"), F.avg((v == F.col("low")).cast("int")).alias("at_low"), F.avg((v == F.col("high")).cast("int")).alias("at_high"))
    j = one.join(two, list(KEYS)).withColumns({"stuck": F.greatest("at_low", "at_high"), "own": F.col("channel").isin(*critical)})
    c = F.col
    found = [
        ("timestamp_monotonic", None, order_verdict(c("bad")), True, c("bad")),
        ("timestamp_gaps", c("n_dt") > 0, gap_verdict(c("gaps"), c("n_dt")), True, c("gaps")),
        ("sampling_rate", None, rate_verdict(c("n_dt"), c("cv"), 0.10), False, c("cv")),
        ("sensor_range", c("has_spec"), range_verdict(c("out"), c("known")), True, c("out")),
        ("flatline", c("own"), flat_verdict(c("n_var"), c("flat")), True, ratio(c("flat"), c("n_var"))),
        ("saturation", c("own") & (c("known") > 0), saturation_verdict(c("known"), c("stuck")), False, c("stuck")),
        ("nan_ratio", c("own"), missing_verdict(c("share"), 0.05, 0.20), True, c("share")),
    ]
    made = [F.struct(F.lit(n).alias("check"), s.alias("status"), F.lit(b).alias("blocking"), m.cast("double").alias("metric")) for n, _, s, b, m in found]
    stack = F.array_compact(F.array(*[x if only is None else F.when(only, x) for x, (_, only, *_) in zip(made, found)]))
    single = j.select("test_id", "channel", F.explode(stack).alias("c")).select("test_id", "c.check", "channel", "c.status", "c.blocking", "c.metric")
    pairs = [correlated(readings, pressure, flow)]
    if chamber and thrust:
        pairs += [correlated(readings, chamber, thrust, 0.5, "chamber_thrust_correlation"), combustion_stability(readings, chamber), ignition(readings, chamber)]
    if ox and fuel:
        pairs += [lead_lag(readings, ox, fuel)]
    return reduce(DataFrame.unionByName, [single, *pairs])


def quick_run(readings: DataFrame) -> DataFrame:
    """Only failures: time order, channels mostly missing, channels of at most one distinct value."""
    g = readings.groupBy(*KEYS).agg(F.avg(F.col("value").isNull().cast("int")).alias("share"), F.count_distinct("value").alias("distinct"))
    empty = rows(g.where("share > 0.5"), "quick_nan", F.lit("FAIL"), F.col("share"))
    constant = rows(g.where("distinct <= 1"), "quick_constant", F.lit("FAIL"), F.col("distinct"))
    return timestamps_increase(readings).where("status = 'FAIL'").unionByName(empty).unionByName(constant)


def summary(checks: DataFrame) -> DataFrame:
    """Counts by status, and whether each test passed and has warnings."""
    counts = checks.groupBy("test_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "WARN", "FAIL", "SKIP")],
        (F.count_if((F.col("status") == "FAIL") & F.col("blocking")) == 0).alias("passed"),
    )
    return counts.withColumn("has_warnings", F.col("n_warn") > 0)


def gate(readings: DataFrame, checks: DataFrame) -> DataFrame:
    """Readings of the tests that no blocking check failed."""
    failed = checks.where("status = 'FAIL' and blocking").select("test_id").distinct()
    return readings.join(failed, "test_id", "left_anti")
