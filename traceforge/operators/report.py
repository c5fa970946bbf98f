"""Tables behind reports: summaries, histograms, box inputs, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceforge.functions.series import ratio


def in_time(*keys: str):
    return Window.partitionBy(*keys).orderBy("test_timestamp", "test_id")


def campaign_summary(long: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """Count, mean, deviation, range and coefficient of variation (%) per campaign and parameter, with specs beside."""
    g = long.where("value is not null").groupBy("campaign_name", "parameter").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    g = g.withColumns({"range": F.col("max") - F.col("min"), "cv_pct": ratio(F.col("std"), F.abs("mean")) * 100})
    return g.join(specs, "parameter", "left") if specs is not None else g


def with_system(results: DataFrame) -> DataFrame:
    """Adds ``system``, the campaign's name up to its first hyphen."""
    return results.withColumn("system", F.substring_index("campaign_name", "-", 1))


def system_header(results: DataFrame) -> DataFrame:
    return with_system(results).groupBy("system").agg(F.count("*").alias("n_tests"), F.count_distinct("campaign_name").alias("n_campaigns"), (F.avg(F.col("qc_passed").cast("int")) * 100).alias("qc_pass_pct"), F.array_sort(F.collect_set("part")).alias("types"))


def campaign_cards(results: DataFrame, metric: str) -> DataFrame:
    return results.groupBy("campaign_name").agg(F.count("*").alias("n_tests"), F.count_if("qc_passed").alias("n_passed"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))


def histogram(long: DataFrame, *keys: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins between each group's smallest and largest value."""
    known = long.where("value is not null")
    j = known.join(known.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high")), list(keys))
    at = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    return j.groupBy(*keys, at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def box(df: DataFrame, value: str, *keys: str) -> DataFrame:
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), q.alias("q"))
    return g.select(*keys, "n", *[F.col("q")[i].alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))])


def trend_bands(results: DataFrame, value: str, uncertainty: str) -> DataFrame:
    """Each test with its campaign's mean and two-deviation band, and its own uncertainty band."""
    g = results.groupBy("campaign_name").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    j = results.select("campaign_name", "test_id", "test_timestamp", value, uncertainty).join(g, "campaign_name")
    v, u = F.col(value), F.col(uncertainty)
    return j.select("campaign_name", "test_id", "test_timestamp", v.alias("value"), "mean", (F.col("mean") - 2 * F.col("std")).alias("low"), (F.col("mean") + 2 * F.col("std")).alias("high"), (v - u).alias("u_low"), (v + u).alias("u_high"))


def z_scores(long: DataFrame) -> DataFrame:
    g = long.groupBy("campaign_name", "parameter").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("s"))
    return long.join(g, ["campaign_name", "parameter"]).withColumn("z", ratio(F.col("value") - F.col("mean"), F.col("s"))).drop("mean", "s")


def cross_campaign_trend(long: DataFrame) -> DataFrame:
    """Regression of each parameter of a system on the index of its tests in time.

    The index is counted in two steps (tests per day, then positions in the day), so no task orders a whole system.
    """
    s = with_system(long.where("value is not null")).withColumn("day", F.to_date("test_timestamp"))
    days = s.groupBy("system", "parameter", "day").agg(F.count("*").alias("n"))
    before = Window.partitionBy("system", "parameter").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select("system", "parameter", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.row_number().over(in_time("system", "parameter", "day")) - 1
    i = s.withColumn("k", at).join(starts, ["system", "parameter", "day"]).withColumn("i", (F.col("start") + F.col("k")).cast("double"))
    return i.groupBy("system", "parameter").agg(F.count("*").alias("n"), F.regr_slope("value", "i").alias("slope"), F.regr_intercept("value", "i").alias("intercept"), F.regr_r2("value", "i").alias("r2"))


def campaign_boundaries(results: DataFrame) -> DataFrame:
    """Where the campaign changes in a system's tests, ordered by campaign and time: the index of its first test."""
    n = with_system(results).groupBy("system", "campaign_name").agg(F.count("*").alias("n"))
    before = Window.partitionBy("system").orderBy("campaign_name").rowsBetween(Window.unboundedPreceding, -1)
    return n.select("system", "campaign_name", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start"))


def first_tests(results: DataFrame, count: int = 50) -> DataFrame:
    """The newest tests, a report's list."""
    return results.orderBy(F.desc("test_timestamp"), "test_id").limit(count)


def report_feed(results: DataFrame, checks: DataFrame) -> DataFrame:
    """One JSON document per test: measurements and quality checks."""
    q = checks.groupBy("test_id").agg(F.array_sort(F.collect_list(F.struct("check", "channel", "status"))).alias("checks"))
    j = results.join(q, "test_id", "left")
    return j.select("test_id", F.to_json(F.struct(*[c for c in j.columns])).alias("document"))
