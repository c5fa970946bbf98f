"""Statistical process control over ``(campaign_name, parameter, test_timestamp, test_id, value)``.

Points are always in time order, ties by test id.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceforge.functions.series import ratio

KEYS = ("campaign_name", "parameter")
# Control-chart constants. d2 and D4 for moving ranges of two; A2, D3 and D4 by subgroup size.
D2, MR_D4 = 1.128, 3.267
XBAR = {2: (1.880, 0.0, 3.267), 3: (1.023, 0.0, 2.574), 4: (0.729, 0.0, 2.282), 5: (0.577, 0.0, 2.114), 6: (0.483, 0.0, 2.004), 7: (0.419, 0.076, 1.924), 8: (0.373, 0.136, 1.864), 9: (0.337, 0.184, 1.816), 10: (0.308, 0.223, 1.777)}
RULES = ("beyond_3_sigma", "2_of_3_beyond_2_sigma", "4_of_5_beyond_1_sigma", "8_same_side", "6_trend", "14_alternating")


def in_time():
    return Window.partitionBy(*KEYS).orderBy("test_timestamp", "test_id")


def ordered(points: DataFrame) -> DataFrame:
    """Known points with their index in time ``i`` and moving range ``mr``."""
    w = in_time()
    known = points.where("value is not null")
    return known.withColumns({"i": (F.row_number().over(w) - 1).cast("long"), "mr": F.abs(F.col("value") - F.lag("value").over(w))})


def imr_limits(points: DataFrame) -> DataFrame:
    g = ordered(points).groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("value").alias("cl"), F.avg("mr").alias("mr_bar")).where("n >= 2")
    sigma = F.col("mr_bar") / D2
    return g.withColumns({"sigma": sigma, "ucl": F.col("cl") + 3 * sigma, "lcl": F.col("cl") - 3 * sigma, "mr_ucl": MR_D4 * F.col("mr_bar"), "mr_lcl": F.lit(0.0)})


def run_rules(points: DataFrame) -> DataFrame:
    """Every point with the names of the rules that it completes."""
    p = ordered(points).join(imr_limits(points).select(*KEYS, "cl", "sigma"), list(KEYS))
    w = in_time()
    z = F.when(F.col("sigma") > 0, (F.col("value") - F.col("cl")) / F.col("sigma")).otherwise(0.0)
    p = p.withColumn("z", z)
    p = p.withColumns({"step": F.signum(F.col("value") - F.lag("value").over(w))})
    p = p.withColumn("turn", ((F.col("step") * F.lag("step").over(w)) < 0).cast("int"))

    def of(k: int, condition: Column) -> Column:
        return F.sum(condition.cast("int")).over(w.rowsBetween(1 - k, 0))

    def full(k: int) -> Column:
        return F.col("i") >= k - 1

    flags = [
        F.abs("z") > 3,
        full(3) & ((of(3, F.col("z") > 2) >= 2) | (of(3, F.col("z") < -2) >= 2)),
        full(5) & ((of(5, F.col("z") > 1) >= 4) | (of(5, F.col("z") < -1) >= 4)),
        full(8) & ((of(8, F.col("z") > 0) == 8) | (of(8, F.col("z") < 0) == 8)),
        full(6) & ((of(5, F.col("step") > 0) == 5) | (of(5, F.col("step") < 0) == 5)),
        full(14) & (F.sum("turn").over(w.rowsBetween(-11, 0)) == 12),
    ]
    rules = F.array_compact(F.array(*[F.when(f, F.lit(n)) for n, f in zip(RULES, flags)]))
    return p.withColumn("rules", rules).select(*KEYS, "test_timestamp", "test_id", "i", "value", "z", "rules")


def violations(charted: DataFrame) -> DataFrame:
    """Points, points with a rule, and their share."""
    return charted.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if(F.size("rules") > 0).alias("n_out")).withColumn("rate", F.col("n_out") / F.col("n"))


def xbar_r_limits(points: DataFrame, size: int = 5) -> DataFrame:
    """Limits from subgroups of consecutive points; a last short group is left out; at least two groups."""
    a2, d3, d4 = XBAR[size]
    groups = ordered(points).withColumn("g", F.floor(F.col("i") / size)).groupBy(*KEYS, "g").agg(F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("range"), F.count("*").alias("k")).where(F.col("k") == size)
    g = groups.groupBy(*KEYS).agg(F.count("*").alias("groups"), F.avg("mean").alias("cl"), F.avg("range").alias("r_bar")).where("groups >= 2")
    reach = a2 * F.col("r_bar")
    return g.withColumns({"ucl": F.col("cl") + reach, "lcl": F.col("cl") - reach, "zone": reach / 3, "r_ucl": d4 * F.col("r_bar"), "r_lcl": d3 * F.col("r_bar")})


def capability(points: DataFrame, specs: DataFrame) -> DataFrame:
    """Short- and long-term indices against ``specs(parameter, lsl, usl[, target])``; one-sided specs give one side."""
    specs = specs if "target" in specs.columns else specs.withColumn("target", F.lit(None).cast("double"))
    g = ordered(points).groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("s"), F.avg("mr").alias("mr_bar")).where("n >= 2")
    j = g.join(specs, "parameter").withColumn("within", F.when(F.col("mr_bar") > 0, F.col("mr_bar") / D2).otherwise(F.col("s")))
    mean, lsl, usl = F.col("mean"), F.col("lsl"), F.col("usl")

    def indices(sigma: Column, p: str) -> dict[str, Column]:
        up, down = ratio(usl - mean, 3 * sigma), ratio(mean - lsl, 3 * sigma)
        return {p: ratio(usl - lsl, 6 * sigma), f"{p}u": up, f"{p}l": down, f"{p}k": F.least(up, down)}

    target = F.coalesce("target", (lsl + usl) / 2)
    spread = F.sqrt(F.col("s") * F.col("s") + (mean - target) * (mean - target))
    out = j.withColumns(indices(F.col("within"), "cp") | indices(F.col("s"), "pp") | {"cpm": ratio(usl - lsl, 6 * spread)})
    verdict = F.when(F.col("cpk") >= 1.67, "excellent").when(F.col("cpk") >= 1.33, "capable").when(F.col("cpk") >= 1.0, "marginal").otherwise("not capable")
    return out.withColumns({"sigma_level": 3 * F.col("cpk"), "verdict": F.when(F.col("cpk").isNotNull(), verdict)})


def trend(points: DataFrame, least_r2: float = 0.5, least_change: float = 0.1) -> DataFrame:
    """Least squares on the index; a trend if it explains enough and moves enough of the range."""
    x = F.col("i").cast("double")
    g = ordered(points).groupBy(*KEYS).agg(F.count("*").alias("n"), F.regr_slope("value", x).alias("slope"), F.regr_r2("value", x).alias("r2"), (F.max("value") - F.min("value")).alias("span")).where("n >= 6")
    change = F.abs(ratio(F.col("slope") * F.col("n"), F.col("span")))
    has = (F.col("r2") > least_r2) & (change > least_change)
    return g.withColumns({"change": change, "has_trend": F.coalesce(has, F.lit(False))}).withColumn("direction", F.when(F.col("has_trend"), F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")))


def cusum(points: DataFrame, target: float | None = None, k_sigma: float = 0.5, h_sigma: float = 5.0) -> DataFrame:
    """Both one-sided sums in closed form: a running sum less its smallest value so far (or zero)."""
    lim = imr_limits(points).select(*KEYS, F.lit(target).cast("double").alias("given"), "cl", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1.0).alias("sigma"))
    w = in_time()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    off = F.col("value") - F.coalesce("given", "cl")
    p = ordered(points).join(lim, list(KEYS)).withColumns({"up": F.sum(off - k_sigma * F.col("sigma")).over(so_far), "down": F.sum(-off - k_sigma * F.col("sigma")).over(so_far)})
    p = p.withColumns({"c_plus": F.col("up") - F.least(F.lit(0.0), F.min("up").over(so_far)), "c_minus": F.col("down") - F.least(F.lit(0.0), F.min("down").over(so_far))})
    signal = (F.col("c_plus") > h_sigma * F.col("sigma")) | (F.col("c_minus") > h_sigma * F.col("sigma"))
    return p.select(*KEYS, "test_timestamp", "test_id", "i", "value", "c_plus", "c_minus", signal.alias("signal"))


def ewma(points: DataFrame, weight: float = 0.2, width: float = 3.0) -> DataFrame:
    """Exponentially weighted means from the target, with time-varying limits.

    Points lie in blocks so long that what stood before a block counts for nothing at its end. A point's mean is its
    block's running sum of weighted values, scaled to the point, and the mean at the end of the block before, scaled likewise.
    """
    keep = 1 - weight
    block = max(1, math.floor(math.log(1e-200) / math.log(keep)))
    lim = imr_limits(points).select(*KEYS, "cl", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1.0).alias("sigma"))
    p = ordered(points).join(lim, list(KEYS))
    p = p.withColumns({"block": F.floor(F.col("i") / block), "k": F.col("i") % block})
    so_far = Window.partitionBy(*KEYS, "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    scale = F.pow(F.lit(keep), F.col("k"))
    p = p.withColumn("own", F.sum(weight * F.col("value") / scale).over(so_far) * scale)
    ends = p.groupBy(*KEYS, "block").agg(F.max_by("own", "k").alias("end"))
    starts = ends.select(*KEYS, "block", F.lag("end").over(Window.partitionBy(*KEYS).orderBy("block")).alias("start"))
    p = p.join(starts, [*KEYS, "block"])
    z = F.col("own") + scale * keep * F.coalesce("start", "cl")
    spread = width * F.col("sigma") * F.sqrt(F.lit(weight / (2 - weight)) * (1 - F.pow(F.lit(1 - weight), 2 * (F.col("i") + 1))))
    out = p.withColumns({"ewma": z, "ucl": F.col("cl") + spread, "lcl": F.col("cl") - spread})
    return out.select(*KEYS, "test_timestamp", "test_id", "i", "value", "ewma", "ucl", "lcl", ((F.col("ewma") > F.col("ucl")) | (F.col("ewma") < F.col("lcl"))).alias("signal"))


def campaign_spc(points: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per campaign and parameter: limits, violations, trend, and capability where a spec is given."""
    caps = capability(points, specs).select(*KEYS, "cp", "cpk", "pp", "ppk", "verdict")
    parts = [imr_limits(points).drop("n"), violations(run_rules(points)), trend(points).select(*KEYS, "slope", "has_trend"), caps]
    return reduce(lambda a, b: a.join(b, list(KEYS), "left"), parts)


def overall_capability(points: DataFrame, specs: DataFrame) -> DataFrame:
    """Cp and Cpk from the overall deviation; infinite where it is zero."""
    g = points.where("value is not null").groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("s"))
    j = g.join(specs.select("parameter", "lsl", "usl"), "parameter")
    inf = F.lit(float("inf"))
    s, mean = F.col("s"), F.col("mean")
    cp = F.when(s > 0, (F.col("usl") - F.col("lsl")) / (6 * s)).when(s == 0, inf)
    cpk = F.when(s > 0, F.least(F.col("usl") - mean, mean - F.col("lsl")) / (3 * s)).when(s == 0, inf)
    return j.select(*KEYS, "n", "mean", "s", cp.alias("cp"), cpk.alias("cpk"))


def spec_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "parameter string, lsl double, usl double, target double")
