"""Anomaly detection and sensor health.

Detectors give intervals ``(test_id, channel, kind, start_seq, end_seq, start_s, end_s, n, score)``. Robust
statistics come from sorts of each series that spill; those that several detectors need are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceforge.functions.blocks import numbered, spectra, with_ranked
from traceforge.functions.series import KEYS, by_series, correlation, ratio

#: Positions in a block, and windows whose variances are taken at a time.
BLOCK = 1 << 16
OUT = ("test_id", "channel", "kind", "start_seq", "end_seq", "start_s", "end_s", "n", "score")
#: Scales a median absolute deviation to a standard deviation.
MAD = 1.4826


#: A kind of run: its flag and score by sample, and the fewest and most samples it may have.
Rule = tuple[str, Column, Column, int, int | None]


def flagged_runs(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Runs of flagged samples of an allowed length with the largest score inside, of all rules from one pass."""
    marks = F.array_compact(F.array(*[F.when(flag, F.struct(F.lit(kind).alias("kind"), score.cast("double").alias("score"))) for kind, flag, score, _, _ in rules]))
    marked = df.select(*KEYS, "seq", "time_s", F.explode(marks).alias("mark")).select(*KEYS, "seq", "time_s", "mark.*")
    g = marked.withColumn("run", F.col("seq") - F.row_number().over(by_series((*KEYS, "kind")))).groupBy(*KEYS, "kind", "run").agg(
        F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s"), F.count("*").alias("n"), F.max("score").alias("score"))
    allowed = [(F.col("kind") == kind) & (F.col("n") >= least) & (F.col("n") <= most if most else F.lit(True)) for kind, _, _, least, most in rules]
    return g.where(reduce(Column.__or__, allowed)).select(*OUT)


def scored_runs(df: DataFrame, flag: Column, score: Column, kind: str, least: int = 1, most: int | None = None) -> DataFrame:
    """Runs of flagged samples of an allowed length with the largest score inside."""
    return flagged_runs(df, [(kind, flag, score, least, most)])


def with_robust_z(df: DataFrame, value: str = "value", shares: dict[str, float] | None = None, tag: str = "") -> DataFrame:
    """Adds the series' count, median and scaled median absolute deviation, and the percentiles ``shares``."""
    mid, off, sigma = "mid" + tag, "off" + tag, "sigma" + tag
    centre = with_ranked(df, value, {mid: 0.5} | (shares or {}), "known" + tag)
    z = with_ranked(centre.withColumn(off, F.abs(F.col(value) - F.col(mid))), off, {sigma: 0.5}, "_offs").drop("_offs")
    return z.withColumn(sigma, MAD * F.col(sigma))


def spike_rule(threshold: float = 4.0, most: int = 10) -> Rule:
    z = F.col("off") / F.col("sigma")
    return "spike", (F.col("known") >= 10) & (F.col("sigma") >= 1e-10) & (z > threshold), z, 1, most


def dropout_rule(share: float = 0.1, least: int = 3) -> Rule:
    low = F.col("value").isNull() | (F.abs("value") < share * F.col("p75"))
    return "dropout", (F.col("known") >= 5) & (F.col("p75") >= 1e-10) & low, F.lit(1.0), least, None


def saturation_rules(least: int = 5) -> list[Rule]:
    value = F.col("value")
    return [("saturation_high", value >= F.col("high"), value, least, None), ("saturation_low", value <= F.col("low"), -value, least, None)]


def transient_rule(factor: float = 3.0) -> Rule:
    limit = F.col("mid_move") + factor * F.col("sigma_move")
    return "transient", (F.col("known_move") >= 10) & (limit >= 1e-10) & (F.col("move") > limit), F.col("move"), 2, 20


def moved(readings: DataFrame) -> DataFrame:
    """Adds each sample's step from the one before, 0 where either is missing."""
    return readings.withColumn("move", F.coalesce(F.abs(F.col("value") - F.lag("value").over(by_series())), F.lit(0.0)))


def spikes(readings: DataFrame, threshold: float = 4.0, most: int = 10) -> DataFrame:
    return flagged_runs(with_robust_z(readings), [spike_rule(threshold, most)])


def dropouts(readings: DataFrame, share: float = 0.1, least: int = 3) -> DataFrame:
    return flagged_runs(with_ranked(readings, "value", {"p75": 0.75}), [dropout_rule(share, least)])


def spikes_and_dropouts(readings: DataFrame, share: float = 0.1) -> DataFrame:
    """Both, from one pass."""
    return flagged_runs(with_robust_z(readings, shares={"p75": 0.75}), [spike_rule(), dropout_rule(share)])


def drift(readings: DataFrame, least_change: float = 0.05, least_r2: float = 0.5, least_n: int = 200) -> DataFrame:
    """Whole-series trends: total change relative to the range, with its coefficient of determination."""
    x = F.col("seq").cast("double")
    g = readings.where("value is not null").groupBy(*KEYS).agg(
        F.regr_slope("value", x).alias("slope"), F.regr_r2("value", x).alias("r2"), F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("span"),
        F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s"),
    )
    change = F.abs(ratio(F.col("slope") * F.col("n"), F.col("span")))
    on = (F.col("n") >= least_n) & (F.col("r2") > least_r2) & (change > least_change)
    return g.where(on).withColumns({"kind": F.lit("drift"), "score": change}).select(*OUT)


def oscillation(readings: DataFrame, low_hz: float = 0.5, high_hz: float = 20.0, least_share: float = 0.3, least_n: int = 64) -> DataFrame:
    """Share of a band's strongest line in all power but the mean's.

    All power comes from the sum of squares (and the alternating sum, where the length is even); only the band's lines
    are transformed, in blocks of a series.
    """
    x, w = numbered(readings.where("value is not null")), Window.partitionBy(*KEYS)
    signed = F.when(F.col("at") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    x = x.withColumns({
        "mean": F.avg("value").over(w), "var": F.var_pop("value").over(w), "odd": F.sum(signed).over(w),
        "start_seq": F.min("seq").over(w), "end_seq": F.max("seq").over(w), "start_s": F.min_by("time_s", "seq").over(w), "end_s": F.max_by("time_s", "seq").over(w),
    }).where(F.col("size") >= least_n)
    x = with_ranked(x.withColumn("dt", F.col("time_s") - F.col("last_s")), "dt", {"step": 0.5}).where("step > 0").withColumn("n", F.col("size"))
    k0, k1 = F.greatest(F.ceil(low_hz * F.col("n") * F.col("step") * (1 - 1e-12)), F.lit(0)), F.least(F.floor(high_hz * F.col("n") * F.col("step") * (1 + 1e-12)), F.floor(F.col("n") / 2))
    total = F.col("n") * F.col("n") * F.col("var") / 2 + F.when(F.col("n") % 2 == 0, F.col("odd") * F.col("odd") / 2).otherwise(0.0)
    x = x.withColumns({"k0": k0.cast("long"), "k1": k1.cast("long"), "total": total}).where("k0 <= k1 and total > 0")
    own = (*KEYS, "start_seq", "end_seq", "start_s", "end_s", "n", "total")  # told of a series to all its samples, so it comes back with the spectrum
    off = x.select(*own, "k0", "k1", "at", "size", (F.col("value") - F.col("mean")).alias("x"))
    share = spectra(off, keys=own).groupBy(*own).agg(F.max(F.array_max("power")).alias("most")).withColumns({"kind": F.lit("oscillation"), "score": F.col("most") / F.col("total")})
    return share.where(F.col("score") > least_share).select(*OUT)


def saturation(readings: DataFrame, least: int = 5, high: float = 0.995, low: float = 0.005) -> DataFrame:
    """Runs at or beyond the 99.5th or the 0.5th percentile."""
    return flagged_runs(with_ranked(readings, "value", {"high": high, "low": low}), saturation_rules(least))


def flat_starts(x: np.ndarray, width: int, variance: float) -> np.ndarray:
    """Where windows of nearly no variance begin; each variance is taken around the window's own mean, a missing sample gives none."""
    windows = np.lib.stride_tricks.sliding_window_view(x, width) if len(x) >= width else np.empty((0, width))
    return np.concatenate([np.empty(0, int), *(k + np.flatnonzero(windows[k : k + BLOCK].var(1) < variance) for k in range(0, len(windows), BLOCK))])


def cuts(samples: DataFrame, width: int, variance: float) -> DataFrame:
    """``(keys, block, cut)``: positions that no flat segment crosses, one a block of positions at most.

    Before a cut stand at least ``width`` samples at which no flat window begins, and which no segment that began before
    them gets over: one value is missing, or their squares alone exceed what a segment from the series' start may have.
    So whatever comes before a cut, the next segment begins at the first flat window after it.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        x, at = part["value"].to_numpy(float), part["at"].to_numpy()
        own = int((at // BLOCK == key[-1]).sum())  # the first of the next block only complete the windows
        edges = np.concatenate([[-1], (s := flat_starts(x, width, variance))[s < own], [own]])
        k = int(np.argmax(np.diff(edges)))
        a, b = int(edges[k]) + 1, int(edges[k + 1])
        still = x[a:b]
        firm = b - a >= width and (np.isnan(still).any() or ((still - still.mean()) ** 2).sum() >= 1.001 * variance * (at[a] + b - a))
        return pd.DataFrame([(*key, int(at[0] + b))] if firm else [], columns=[*KEYS, "block", "cut"])

    block = F.floor(F.col("at") / BLOCK).cast("long")
    also = F.when((F.col("at") % BLOCK < width - 1) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    parts = samples.select(*KEYS, "at", "value", F.explode(also).alias("block"))
    return parts.groupBy(*KEYS, "block").applyInPandas(run, "test_id string, channel string, block long, cut long")


def flatlines(readings: DataFrame, width: int = 10, variance: float = 1e-6) -> DataFrame:
    """Greedy segments: the first window of nearly no variance, extended while the whole segment stays so.

    Each end depends on where the segment before stopped. A series is cut where no segment can cross, and the
    pieces are walked side by side; a series that is flat nearly everywhere stays in few pieces.
    """

    def run(part: pa.Table) -> pa.Table:
        order = np.argsort(part["at"].to_numpy())
        x, seq, t = (part[c].to_numpy()[order] for c in ("value", "seq", "time_s"))
        found, i, starts = [], 0, flat_starts(x.astype(float), width, variance)
        while (k := np.searchsorted(starts, i)) < len(starts):
            i = int(starts[k])
            j, mean = i + width, x[i : i + width].mean()
            squares = ((x[i:j] - mean) ** 2).sum()
            while j < len(x):  # one more sample moves mean and squares
                after = mean + (x[j] - mean) / (j + 1 - i)
                more = squares + (x[j] - mean) * (x[j] - after)
                if not more / (j + 1 - i) < variance:
                    break
                mean, squares, j = after, more, j + 1
            found.append((seq[i], seq[j - 1], t[i], t[j - 1], j - i, float(j - i)))
            i = j
        made = part.select(list(KEYS)).take(pa.array([0] * len(found), pa.int64())).append_column("kind", pa.array(["flatline"] * len(found), pa.string()))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
        for name, kind, column in zip(OUT[3:], kinds, zip(*found) if found else [()] * len(kinds)):
            made = made.append_column(name, pa.array(column, kind))
        return made

    samples = numbered(readings).withColumn("block", F.floor(F.col("at") / BLOCK).cast("long"))
    own = Window.partitionBy(*KEYS).orderBy("block")
    long = samples.where(F.col("size") > BLOCK)  # a series of one block is one piece
    blocks = long.select(*KEYS, "block").distinct().join(cuts(long, width, variance), [*KEYS, "block"], "left")
    pieces = blocks.select(*KEYS, "block", "cut", F.count("cut").over(own.rowsBetween(Window.unboundedPreceding, -1)).alias("piece"))
    dealt = samples.join(pieces, [*KEYS, "block"], "left").withColumn("piece", F.coalesce("piece", F.lit(0)) + F.coalesce((F.col("at") >= F.col("cut")).cast("int"), F.lit(0)))
    spec = "test_id string, channel string, kind string, start_seq long, end_seq long, start_s double, end_s double, n long, score double"
    return dealt.select(*KEYS, "piece", "at", "seq", "time_s", "value").groupBy(*KEYS, "piece").applyInArrow(run, spec)


def correlation_breaks(readings: DataFrame, left: str, right: str, width: int = 50, step: int = 25, least_r: float = 0.5) -> DataFrame:
    """Stretches in which two channels lose their correlation; score is the smallest signed correlation."""
    return correlation_breaks_of(readings, [(left, right)], width, step, least_r)


def correlation_breaks_of(readings: DataFrame, pairs: list[tuple[str, str]], width: int = 50, step: int = 25, least_r: float = 0.5) -> DataFrame:
    """:func:`correlation_breaks` of several pairs: the channels of a test stand side by side once for all of them."""
    place = {c: i for i, c in enumerate(sorted({c for pair in pairs for c in pair}))}
    own = [(F.col("channel") == c, i) for c, i in place.items()]
    named = readings.where(F.col("channel").isin(*place))
    wide = named.groupBy("test_id", "seq").agg(*[F.max(F.when(on, F.col("value"))).alias(f"v{i}") for on, i in own])
    last = named.groupBy("test_id").agg(*[F.max(F.when(on, F.col("seq"))).alias(f"last{i}") for on, i in own])

    def of(pair: tuple[str, str]) -> Column:
        i, j = place[pair[0]], place[pair[1]]
        n = F.greatest(f"last{i}", f"last{j}") + 1 if i != j else F.col(f"last{i}") + 1
        both = F.struct(F.lit("/".join(pair)).alias("channel"), F.col(f"v{i}").alias("a"), F.col(f"v{j}").alias("b"), n.alias("n"))
        return F.when(F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull(), both)

    pair = wide.join(last, "test_id").select("test_id", "seq", F.explode(F.array_compact(F.array(*map(of, pairs)))).alias("p")).select("test_id", "seq", "p.*")
    first = F.greatest(F.lit(0), F.ceil((F.col("seq") - width + 1) / step)).cast("long")
    final = F.least(F.floor(F.col("seq") / step), F.ceil((F.col("n") - width) / step) - 1).cast("long")
    in_windows = pair.withColumns({"first": first, "last": final}).where("first <= last")
    w = in_windows.select(*KEYS, "a", "b", F.explode(F.sequence("first", "last")).alias("k")).withColumn("start", F.col("k") * step)
    g = w.groupBy(*KEYS, "start").agg(F.count("*").alias("m"), correlation("a", "b").alias("r"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    broken = g.where((F.col("m") >= width // 2) & (F.col("sa") >= 1e-10) & (F.col("sb") >= 1e-10) & (F.abs("r") < least_r))
    order = by_series(order="start")
    fresh = F.when(F.col("start") <= F.lag("start").over(order) + width + step, 0).otherwise(1)
    run = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = broken.withColumn("fresh", fresh).withColumn("run", run).groupBy(*KEYS, "run").agg(F.min("start").alias("start_seq"), (F.max("start") + width).alias("end_seq"), F.min("r").alias("score"), F.count("*").alias("n"))
    return merged.select(*KEYS, F.lit("correlation_break").alias("kind"), "start_seq", "end_seq", F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"), "n", "score")


def transients(readings: DataFrame, factor: float = 3.0) -> DataFrame:
    return flagged_runs(with_robust_z(moved(readings), "move", tag="_move"), [transient_rule(factor)])


SEVERITY = {"dropout": "CRITICAL", "saturation_high": "WARNING", "saturation_low": "WARNING", "flatline": "WARNING", "correlation_break": "WARNING", "drift": "INFO", "transient": "INFO"}


def with_severity(anomalies: DataFrame) -> DataFrame:
    fixed = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    kind, score = F.col("kind"), F.col("score")
    by_score = F.when(kind == "spike", F.when(score > 6, "CRITICAL").otherwise("WARNING")).when(kind == "oscillation", F.when(score > 0.5, "WARNING").otherwise("INFO"))
    return anomalies.withColumn("severity", F.coalesce(by_score, fixed[kind]))


def detect_all(readings: DataFrame, pairs: list[tuple[str, str]], native_only: bool = False) -> DataFrame:
    """Every detector over every channel, and correlation breaks of the named pairs.

    Detectors of single samples share one chain of statistics, so the readings are not read and sorted for each of them.
    """
    z = with_robust_z(moved(readings), shares={"p75": 0.75, "high": 0.995, "low": 0.005})
    z = with_robust_z(z, "move", tag="_move")
    found = [flagged_runs(z, [spike_rule(), dropout_rule(), *saturation_rules(), transient_rule()]), drift(readings)]
    if pairs:
        found.append(correlation_breaks_of(readings, pairs))
    if not native_only:
        found += [oscillation(readings), flatlines(readings)]
    return with_severity(reduce(DataFrame.unionByName, found))


def sensor_health(readings: DataFrame, anomalies: DataFrame) -> DataFrame:
    """1 less the penalties of each series, between 0 and 1; 0 under ten samples."""
    size = readings.groupBy(*KEYS).agg(F.count("*").alias("size"), F.avg(F.col("value").isNull().cast("int")).alias("missing"))
    kind = F.col("kind")

    def samples(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(kind.isin(*kinds), F.col("n"))), F.lit(0))

    a = anomalies.groupBy(*KEYS).agg(
        F.count_if(kind == "spike").alias("spikes"), samples("dropout").alias("dropped"), samples("flatline").alias("flat"), samples("saturation_high", "saturation_low").alias("saturated"),
        F.count_if(kind == "drift").alias("drifts"), F.coalesce(F.max(F.when(kind == "oscillation", F.col("score"))), F.lit(0.0)).alias("wave"),
    )
    j = size.join(a, list(KEYS), "left").na.fill(0, ["spikes", "dropped", "flat", "saturated", "drifts", "wave"])
    n = F.col("size")
    per_hundred = F.col("spikes") * 100 / n
    flat = F.col("flat") / n
    penalties = [
        F.least(2 * F.col("missing"), F.lit(0.5)),
        F.when(per_hundred > 0.1, F.least(0.1 * per_hundred, F.lit(0.2))).otherwise(0.0),
        F.least(3 * F.col("dropped") / n, F.lit(0.4)),
        F.when(flat > 0.1, F.least(0.5 * flat, F.lit(0.3))).otherwise(0.0),
        F.least(2 * F.col("saturated") / n, F.lit(0.3)),
        F.when(F.col("drifts") > 0, 0.1).otherwise(0.0),
        F.when(F.col("wave") > 0.5, 0.1).otherwise(0.0),
    ]
    return j.select(*KEYS, F.when(n < 10, 0.0).otherwise(1 - F.least(reduce(Column.__add__, penalties), F.lit(1.0))).alias("health"))


def report(anomalies: DataFrame) -> DataFrame:
    """Counts and total duration by channel, kind and severity."""
    return anomalies.groupBy("test_id", "channel", "kind", "severity").agg(F.count("*").alias("n_intervals"), F.sum("n").alias("n_samples"), F.sum(F.col("end_s") - F.col("start_s")).alias("duration_s"))
