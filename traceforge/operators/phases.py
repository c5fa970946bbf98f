"""Phase segmentation and transient analysis over ``(test_id, channel, seq, time_s, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceforge.functions.series import KEYS, by_series, in_intervals, longest, ratio, runs
from traceforge.operators.prep import fill_all


def segment(readings: DataFrame, active_pct: float = 10.0, steady_cv: float = 0.02) -> DataFrame:
    """Labels every sample PRETEST, STARTUP, STEADY, SHUTDOWN or COOLDOWN.

    Active samples reach ``active_pct`` of the range. The steady phase is the longest active run whose rolling
    variation stays under ``steady_cv``; the window's width follows each series' length, so rolling sums are
    differences of running sums at its two ends. Without a steady run the peak divides startup from shutdown.
    """
    empty = readings.groupBy(*KEYS).agg(F.count("value").alias("known")).where("known = 0").select(*KEYS)
    filled = fill_all(readings)
    whole = Window.partitionBy(*KEYS)  # the series is already in one place and in order for the running sums
    s = filled.withColumns({"size": F.count("*").over(whole), "low": F.min("value").over(whole), "high": F.max("value").over(whole), "mid": F.avg("value").over(whole)})
    s = s.withColumn("w", F.greatest(F.lit(10), F.floor(F.col("size") / 50)).cast("long"))
    s = s.withColumns({"at": (F.row_number().over(by_series()) - 1).cast("long"), "x": F.col("value") - F.col("mid")})
    so_far = by_series(order="at").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"s1": F.sum("x").over(so_far), "s2": F.sum(F.col("x") * F.col("x")).over(so_far)})
    ends = s.select(*KEYS, F.col("at").alias("k"), "s1", "s2")
    last = F.least(F.col("at") + F.floor((F.col("w") - 1) / 2), F.col("size") - 1)
    first = F.greatest(F.col("at") - F.floor(F.col("w") / 2), F.lit(0)) - 1
    s = s.withColumns({"last": last, "first": first})
    hi = ends.select(*KEYS, F.col("k").alias("last"), F.col("s1").alias("h1"), F.col("s2").alias("h2"))
    lo = ends.select(*KEYS, F.col("k").alias("first"), F.col("s1").alias("l1"), F.col("s2").alias("l2"))
    s = s.drop("s1", "s2").join(hi, [*KEYS, "last"]).join(lo, [*KEYS, "first"], "left")
    n = (F.col("last") - F.col("first")).cast("double")
    t1, t2 = F.col("h1") - F.coalesce("l1", F.lit(0.0)), F.col("h2") - F.coalesce("l2", F.lit(0.0))
    std = F.sqrt(F.greatest((t2 - t1 * t1 / n) / (n - 1), F.lit(0.0)))
    enough = n >= F.greatest(F.lit(3), F.floor(F.col("w") / 3))
    cv = F.when(enough, ratio(std, F.abs(t1 / n + F.col("mid"))))
    span = F.col("high") - F.col("low")
    active = (F.col("value") - F.col("low")) / F.when(span > 1e-12, span) * 100 >= active_pct
    s = s.withColumns({"cv": cv, "active": F.coalesce(active, F.lit(False))})
    on_seq = F.when(F.col("active"), F.col("seq"))
    best = longest(runs(s, F.col("active") & (F.col("cv") < steady_cv))).select(*KEYS, F.col("start_seq").alias("b0"), F.col("end_seq").alias("b1"))
    s = s.withColumns({"a0": F.min(on_seq).over(whole), "a1": F.max(on_seq).over(whole), "peak": F.max_by("seq", F.struct("value", -F.col("seq"))).over(whole)})
    j = s.join(best, list(KEYS), "left")
    q = F.col("seq")
    ramp = F.when(F.col("b0").isNotNull(), F.when(q < F.col("b0"), "STARTUP").when(q > F.col("b1"), "SHUTDOWN").otherwise("STEADY")).otherwise(F.when(q <= F.col("peak"), "STARTUP").otherwise("SHUTDOWN"))
    quiet = ~F.col("active") & (ramp != "STEADY")
    label = (
        F.when(span < 1e-12, "STEADY")
        .when(F.col("a0").isNull() | (q < F.col("a0")), "PRETEST")
        .when(q > F.col("a1"), "COOLDOWN")
        .when(quiet & (ramp == "STARTUP"), "PRETEST")
        .when(quiet, "COOLDOWN")
        .otherwise(ramp)
    )
    labelled = j.select(*KEYS, "seq", "time_s", "value", label.alias("phase"))
    nothing = readings.join(empty, list(KEYS), "left_semi").select(*KEYS, "seq", "time_s", "value", F.lit("PRETEST").alias("phase"))
    return labelled.unionByName(nothing)


def phases(labelled: DataFrame) -> DataFrame:
    """Runs of equal labels: ``(keys, phase_no, phase, start_seq, end_seq, start_s, end_s, n)``."""
    w = by_series()
    fresh = F.when(F.col("phase") == F.lag("phase").over(w), 0).otherwise(1)
    k = labelled.withColumn("fresh", fresh).withColumn("phase_no", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return k.groupBy(*KEYS, "phase_no", "phase").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s"), F.count("*").alias("n"))


def merge_short(found: DataFrame, least_s: float = 0.1) -> DataFrame:
    """Phases shorter than ``least_s`` join their predecessor; the first phase never does."""
    w = Window.partitionBy(*KEYS).orderBy("phase_no")
    stays = F.when((F.col("end_s") - F.col("start_s") >= least_s) | (F.row_number().over(w) == 1), 1).otherwise(0)
    k = found.withColumn("stays", stays).withColumn("g", F.sum("stays").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return k.groupBy(*KEYS, F.col("g").alias("phase_no")).agg(
        F.min_by("phase", "phase_no").alias("phase"), F.min("start_seq").alias("start_seq"), F.max("end_seq").alias("end_seq"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum("n").alias("n"))


def phase_metrics(readings: DataFrame, found: DataFrame) -> DataFrame:
    """Statistics of each phase, with ramps for transients, steadiness for the steady phase, drift for quiet ones."""
    j = in_intervals(readings.where("value is not null"), found.drop("n"))
    w = Window.partitionBy(*KEYS, "phase_no").orderBy("seq")
    dt = F.col("time_s") - F.lag("time_s").over(w)
    j = j.withColumns({"rate": F.when(dt > 0, F.abs((F.col("value") - F.lag("value").over(w)) / dt))})
    g = j.groupBy(*KEYS, "phase_no", "phase").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"), (F.max("time_s") - F.min("time_s")).alias("duration"),
        (F.max_by("value", "seq") - F.min_by("value", "seq")).alias("change"), F.max("rate").alias("peak_rate"), F.regr_slope("value", "time_s").alias("slope"),
    )
    moving, steady, quiet = F.col("phase").isin("STARTUP", "SHUTDOWN", "TRANSIENT"), F.col("phase") == "STEADY", F.col("phase").isin("PRETEST", "COOLDOWN")
    within = j.join(g.select(*KEYS, "phase_no", F.col("mean").alias("m")), [*KEYS, "phase_no"]).groupBy(*KEYS, "phase_no").agg((F.avg((F.abs(F.col("value") - F.col("m")) <= 0.02 * F.abs("m")).cast("int")) * 100).alias("within_pct"))
    out = g.join(within, [*KEYS, "phase_no"])
    return out.select(
        *KEYS, "phase_no", "phase", "mean", "std", "min", "max", "n", "duration",
        F.when(moving, F.col("change")).alias("total_change"), F.when(moving, ratio(F.col("change"), F.col("duration"))).alias("ramp_rate"), F.when(moving, F.col("peak_rate")).alias("peak_ramp"),
        F.when(steady, ratio(F.col("std"), F.abs("mean")) * 100).alias("cv_pct"), F.when(steady, F.col("within_pct")).alias("within_2_pct"), F.when(quiet, F.col("slope")).alias("drift"),
    )


def phase_quality(found: DataFrame) -> DataFrame:
    """Quality by sample count, and the time of each change to the next phase."""
    w = Window.partitionBy(*KEYS).orderBy("phase_no")
    quality = F.when(F.col("n") < 5, "poor").when(F.col("n") < 20, "marginal").otherwise("good")
    return found.withColumns({"quality": quality, "next_phase": F.lead("phase").over(w), "transition_s": F.lead("start_s").over(w)})


def crossings(levels: DataFrame, readings: DataFrame, rising: bool = True) -> DataFrame:
    """First interpolated time each series passes each ``levels(keys, name, level)``."""
    w = by_series()
    steps = readings.where("value is not null").withColumns({"v1": F.lead("value").over(w), "t1": F.lead("time_s").over(w)}).where("v1 is not null")
    j = steps.join(levels, list(KEYS))
    v, lv = F.col("value"), F.col("level")
    hit = (v <= lv) & (F.col("v1") > lv) if rising else (v >= lv) & (F.col("v1") < lv)
    at = F.col("time_s") + (lv - v) / (F.col("v1") - v) * (F.col("t1") - F.col("time_s"))
    return j.where(hit).groupBy(*KEYS, "name").agg(F.min_by(at, "seq").alias("at_s"))


def settling(readings: DataFrame, bands: DataFrame) -> DataFrame:
    """Time of the sample after the last one outside ``bands(keys, low, high)``: the start if none is, null if the last one is."""
    j = readings.where("value is not null").join(bands, list(KEYS))
    out = ~F.col("value").between(F.col("low"), F.col("high"))
    w = by_series()
    nxt = j.withColumns({"next_s": F.lead("time_s").over(w), "out": out})
    g = nxt.groupBy(*KEYS).agg(F.max_by("next_s", F.when(F.col("out"), F.col("seq"))).alias("after"), F.count_if("out").alias("n_out"), F.min("time_s").alias("t0"))
    return g.select(*KEYS, F.when(F.col("n_out") == 0, F.lit(0.0)).otherwise(F.col("after") - F.col("t0")).alias("settling_s"))


def plateaus(readings: DataFrame) -> DataFrame:
    """Each series' mean over its first tenth and over its last fifth, its extremes and its impulse."""
    known = readings.where("value is not null")
    n = known.groupBy(*KEYS).agg(F.count("*").alias("n"))
    w = by_series()
    dt = F.lead("time_s").over(w) - F.col("time_s")
    k = known.join(n, list(KEYS)).withColumns({"at": F.row_number().over(w) - 1, "area": dt * (F.col("value") + F.lead("value").over(w)) / 2})
    head = F.greatest(F.floor(F.col("n") / 10), F.lit(1))
    tail = F.greatest(F.floor(F.col("n") / 5), F.lit(1))
    return k.groupBy(*KEYS).agg(
        F.avg(F.when(F.col("at") < head, F.col("value"))).alias("first_mean"), F.avg(F.when(F.col("at") >= F.col("n") - tail, F.col("value"))).alias("last_mean"),
        F.max("value").alias("peak"), F.min("value").alias("lowest"), F.max_by("time_s", F.struct("value", -F.col("seq"))).alias("peak_s"), F.min("time_s").alias("t0"), F.sum("area").alias("impulse"),
    )


def levels_of(base: Column, top: Column, shares: tuple[int, ...]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(f"t{s}").alias("name"), (base + (top - base) * s / 100).alias("level")) for s in shares]))


def pivot_times(times: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return times.groupBy(*KEYS).agg(*[F.max(F.when(F.col("name") == n, F.col("at_s"))).alias(n) for n in names])


def startup(readings: DataFrame) -> DataFrame:
    """Rise times, overshoot, peak and settling of a rising transient."""
    p = plateaus(readings)
    levels = p.select(*KEYS, levels_of(F.col("first_mean"), F.col("last_mean"), (10, 50, 90)).alias("l")).select(*KEYS, "l.*")
    t = pivot_times(crossings(levels, readings), ("t10", "t50", "t90"))
    size = F.abs("last_mean")
    band = p.select(*KEYS, (F.col("last_mean") - 0.05 * size).alias("low"), (F.col("last_mean") + 0.05 * size).alias("high"))
    j = p.join(t, list(KEYS), "left").join(settling(readings, band), list(KEYS), "left")
    rise = F.col("last_mean") - F.col("first_mean")
    over = F.when(rise > 0, F.greatest(F.lit(0.0), (F.col("peak") - F.col("last_mean")) / rise * 100))
    return j.select(*KEYS, F.col("first_mean").alias("baseline"), F.col("last_mean").alias("steady"), "t10", "t50", "t90", (F.col("t90") - F.col("t10")).alias("rise_s"), over.alias("overshoot_pct"), "peak", (F.col("peak_s") - F.col("t0")).alias("time_to_peak_s"), "settling_s")


def shutdown(readings: DataFrame) -> DataFrame:
    """Fall times, impulse, lowest value and residual of a falling transient."""
    p = plateaus(readings)
    levels = p.select(*KEYS, levels_of(F.lit(0.0), F.col("first_mean"), (90, 50, 10)).alias("l")).select(*KEYS, "l.*")
    t = pivot_times(crossings(levels, readings, rising=False), ("t90", "t50", "t10"))
    j = p.join(t, list(KEYS), "left")
    return j.select(*KEYS, F.col("first_mean").alias("steady"), "t90", "t50", "t10", (F.col("t10") - F.col("t90")).alias("fall_s"), "impulse", "lowest", (ratio(F.col("last_mean"), F.col("first_mean")) * 100).alias("residual_pct"))
