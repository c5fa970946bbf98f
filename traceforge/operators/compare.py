"""Comparison, regression, correlation and operating envelopes over campaign results."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceforge.functions.series import correlation, median, ratio

INF = float("inf")


def compared(df: DataFrame, a: Column, b: Column, tolerance: Column) -> DataFrame:
    """Adds the difference of ``b`` from ``a``, in percent of their mean size, and whether it is within tolerance."""
    size = (F.abs(a) + F.abs(b)) / 2
    delta = b - a
    percent = F.when(size > 1e-10, delta / size * 100).when(delta == 0, 0.0).otherwise(INF)
    df = df.withColumns({"delta": delta, "delta_pct": percent})
    direction = F.when(F.col("delta") > 0, "increase").when(F.col("delta") < 0, "decrease").otherwise("same")
    return df.withColumns({"within": F.abs("delta_pct") <= tolerance, "direction": direction})


def compare_tests(long: DataFrame, pairs: DataFrame, tolerances: DataFrame | None = None, default: float = 5.0) -> DataFrame:
    """For ``pairs(test_a, test_b)``, every common parameter of ``long(test_id, parameter, value)`` compared."""
    known = long.where("value is not null").select("test_id", "parameter", "value")
    a = known.select(F.col("test_id").alias("test_a"), "parameter", F.col("value").alias("a"))
    b = known.select(F.col("test_id").alias("test_b"), "parameter", F.col("value").alias("b"))
    j = pairs.join(a, "test_a").join(b, ["test_b", "parameter"])
    if tolerances is not None:
        j = j.join(tolerances, "parameter", "left")
    else:
        j = j.withColumn("tol_pct", F.lit(None).cast("double"))
    return compared(j, F.col("a"), F.col("b"), F.coalesce("tol_pct", F.lit(default)))


def overall(compares: DataFrame, *keys: str) -> DataFrame:
    return compares.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("within").alias("n_within"), F.bool_and("within").alias("passed"))


def compare_to_golden(long: DataFrame, golden: DataFrame) -> DataFrame:
    """Every test's parameters against ``golden(parameter, value, tol_pct)``."""
    g = golden.select("parameter", F.col("value").alias("golden"), "tol_pct")
    return compared(long.where("value is not null").join(g, "parameter"), F.col("golden"), F.col("value"), F.col("tol_pct"))


def golden_from_campaign(long: DataFrame, use_median: bool = False, least: int = 5) -> DataFrame:
    """Reference value and tolerance of each campaign and parameter, from three deviations, at least 1 %."""
    g = long.where("value is not null").groupBy("campaign_name", "parameter").agg(
        (median(F.col("value")) if use_median else F.avg("value")).alias("value"), F.stddev_samp("value").alias("u"), F.count("*").alias("n"))
    tol = F.when(F.abs("value") > 1e-10, F.greatest(3 * F.col("u") / F.abs("value") * 100, F.lit(1.0))).otherwise(10.0)
    return g.where(F.col("n") >= least).withColumn("tol_pct", tol)


def regression(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Simple least squares with the slope's standard error and plus or minus two of it; at least three points."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    g = g.where("n >= 3 and sxx >= 1e-10")
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))
    error = F.sqrt(rest / (F.col("n") - 2) / F.col("sxx"))
    g = g.withColumns({"r2": F.when(F.col("syy") < 1e-10, 1.0).otherwise(1 - rest / F.col("syy")), "slope_se": error})
    return g.withColumns({"slope_low": F.col("slope") - 2 * error, "slope_high": F.col("slope") + 2 * error}).drop("sxx", "syy", "sxy")


def predict(models: DataFrame, at: Column) -> DataFrame:
    return models.withColumn("predicted", F.col("slope") * at + F.col("intercept"))


def multi_regression(df: DataFrame, xs: list[str], y: str, *keys: str) -> DataFrame:
    """``y`` against each of several columns, one regression a row."""
    long = df.select(*keys, y, *xs).unpivot([*keys, y], xs, "x_name", "x")
    return regression(long, "x", y, *keys, "x_name")


def correlation_matrix(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """All pairwise correlations over rows complete in every column, in one pass: ``(keys, a, b, r)``."""
    full = df.dropna(subset=columns)
    pairs = list(combinations(columns, 2))
    g = full.groupBy(*keys).agg(F.count("*").alias("n"), *[correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return g.select(*keys, "n", F.explode(rows).alias("p")).select(*keys, "n", "p.*")


def strong_pairs(matrix: DataFrame, least: float = 0.7) -> DataFrame:
    return matrix.where(F.abs("r") >= least).orderBy(F.abs("r").desc())


def track_deviations(long: DataFrame, golden: DataFrame) -> DataFrame:
    """Deviation of each parameter from its reference over time: counts, mean, largest, and whether it moves."""
    g = golden.select("campaign_name", "parameter", F.col("value").alias("golden"), "tol_pct")
    w = Window.partitionBy("campaign_name", "parameter").orderBy("test_timestamp", "test_id")
    d = long.where("value is not null").join(g, ["campaign_name", "parameter"]).withColumns({"dev": ratio(F.col("value") - F.col("golden"), F.abs("golden")) * 100, "i": (F.row_number().over(w) - 1).cast("double")})
    s = d.groupBy("campaign_name", "parameter").agg(
        F.count("*").alias("n"), F.count_if(F.abs("dev") <= F.col("tol_pct")).alias("n_within"), F.avg("dev").alias("mean_dev"), F.max(F.abs("dev")).alias("max_dev"), F.regr_slope("dev", "i").alias("slope"), (F.max("dev") - F.min("dev")).alias("span"))
    moves = (F.col("n") >= 5) & (F.abs(ratio(F.col("slope") * F.col("n"), F.col("span"))) > 0.3)
    return s.withColumn("trending", F.coalesce(moves, F.lit(False))).drop("span")


def compare_campaigns(long: DataFrame, pairs: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """For ``pairs(campaign_a, campaign_b)``: means, deviations, difference, variance ratio and equivalence."""
    g = long.where("value is not null").groupBy("campaign_name", "parameter").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("s")).where("n >= 2")
    a, b = (g.select(F.col("campaign_name").alias(f"campaign_{k}"), "parameter", *[F.col(c).alias(f"{c}_{k}") for c in ("n", "mean", "s")]) for k in "ab")
    j = compared(pairs.join(a, "campaign_a").join(b, ["campaign_b", "parameter"]), F.col("mean_a"), F.col("mean_b"), F.lit(tolerance))
    f = F.when(F.col("s_b") > 1e-10, F.pow("s_a", F.lit(2)) / F.pow("s_b", F.lit(2))).otherwise(INF)
    return j.withColumnRenamed("within", "equivalent").withColumn("f_ratio", f)


def envelope(long: DataFrame, margin: float = 0.10) -> DataFrame:
    """Bounds of successful tests widened by a share of their range, not below zero; at least two tests."""
    g = long.where("value is not null").groupBy("campaign_name", "parameter").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).where("n >= 2")
    reach = margin * (F.col("high") - F.col("low"))
    return g.select("campaign_name", "parameter", "n", F.greatest(F.lit(0.0), F.col("low") - reach).alias("low"), (F.col("high") + reach).alias("high"))


def in_envelope(long: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Tests inside and outside the bounds of their own campaign, on every parameter that has bounds."""
    e = envelopes.select("campaign_name", "parameter", "low", "high")
    per_test = long.where("value is not null").join(e, ["campaign_name", "parameter"]).groupBy("campaign_name", "test_id").agg(F.bool_and(F.col("value").between(F.col("low"), F.col("high"))).alias("inside"))
    return per_test.groupBy("campaign_name").agg(F.count_if("inside").alias("n_inside"), F.count_if(~F.col("inside")).alias("n_outside"))
