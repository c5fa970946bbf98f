"""Windows, runs and robust statistics over long readings ``(test_id, channel, seq, time_s, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ("test_id", "channel")


def by_series(keys: Sequence[str] = KEYS, order: str = "seq") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def centred(width: int, keys: Sequence[str] = KEYS, order: str = "seq") -> WindowSpec:
    """The frame of a centred rolling window of ``width`` samples."""
    return by_series(keys, order).rowsBetween(-(width // 2), (width - 1) // 2)


def rolling(agg: Column, value: Column, width: int, keys: Sequence[str] = KEYS) -> Column:
    """A centred rolling aggregate, null unless the window is full of values."""
    frame = centred(width, keys)
    return F.when(F.count(value).over(frame) == width, agg.over(frame))


def runs(df: DataFrame, flag: Column, keys: Sequence[str] = KEYS, gap: int = 0) -> DataFrame:
    """Runs of consecutive samples where ``flag`` holds, as ``(keys, start_seq, end_seq, n, start_s, end_s)``.

    Up to ``gap`` samples without the flag may lie inside a run.
    """
    on = df.where(flag).select(*keys, "seq", "time_s")
    w = by_series(keys)
    step = F.col("seq") - F.lag("seq").over(w)
    run = F.sum(F.when(step <= gap + 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        on.withColumn("run", run)
        .groupBy(*keys, "run")
        .agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count("*").alias("n"), F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s"))
        .drop("run")
    )


def longest(run_rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The longest run of each series, the first on ties."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "start_seq")
    return run_rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def with_stats(df: DataFrame, stats: dict[str, Column], keys: Sequence[str] = KEYS) -> DataFrame:
    """``df`` joined to per-series aggregates: one small row per series instead of a window over all of it."""
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), list(keys))


def median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or zero."""
    return F.try_divide(a, b)


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of two columns without nulls; null where either does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def in_intervals(samples: DataFrame, intervals: DataFrame, keys: Sequence[str] = KEYS, at: str = "seq", start: str = "start_seq", end: str = "end_seq") -> DataFrame:
    """Samples with the columns of the interval they lie in, both ends included; intervals of a key do not overlap.

    Starts and samples stand in one order, and a sample reads the last start before it: no pair of the two is formed.
    """
    carried = F.struct(*[c for c in intervals.columns if c not in keys])
    starts = intervals.select(*keys, F.col(start).alias(at), carried.alias("_in"), F.lit(0).alias("_sample"))
    both = starts.unionByName(samples.withColumn("_sample", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_sample").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("_in", F.last("_in", ignorenulls=True).over(w)).where(F.col("_sample") == 1).where(F.col("_in")[end] >= F.col(at))
    return told.select(*samples.columns, "_in.*")


def interval_sums(samples: DataFrame, intervals: DataFrame, value: str, at: str, start: str, end: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """``intervals`` with ``rows``, ``n``, ``mean`` and ``std`` of the values inside each, both ends included, of those with rows.

    Bounds and samples stand in one order; running sums (of values less their series' mean) are read at both bounds,
    so the cost is that of sorting samples and bounds, however many intervals overlap.
    """
    named = intervals.withColumn("_id", F.monotonically_increasing_id())
    named = named.withColumn("_ends", F.array(F.struct(F.col(start).alias("at"), F.lit(0).alias("kind")), F.struct(F.col(end).alias("at"), F.lit(2).alias("kind"))))
    bounds = named.where(F.col(start) <= F.col(end)).select(*keys, F.struct("_id", *[c for c in intervals.columns if c not in keys]).alias("_of"), F.explode("_ends").alias("_b")).select(*keys, "_of", "_b.at", "_b.kind")
    centre = samples.groupBy(*keys).agg(F.avg(value).alias("_mid"))
    rows = samples.join(centre, list(keys)).select(*keys, F.col(at).alias("at"), F.lit(1).alias("kind"), (F.col(value) - F.col("_mid")).alias("x"), "_mid")
    both = rows.unionByName(bounds, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("x")
    sums = {"rows": F.count_if(F.col("kind") == 1).over(w), "n": F.count("x").over(w), "s": F.coalesce(F.sum("x").over(w), F.lit(0.0)), "q": F.coalesce(F.sum(x * x).over(w), F.lit(0.0)), "_mid": F.max("_mid").over(w)}
    read = both.withColumns(sums).where(F.col("kind") != 1)
    sign = F.when(F.col("kind") == 2, 1).otherwise(-1)
    g = read.groupBy(*keys, "_of").agg(*[F.sum(sign * F.col(c)).alias(c) for c in ("rows", "n", "s", "q")], F.max("_mid").alias("_mid")).where("rows > 0")
    mean = F.try_divide(F.col("s"), F.col("n"))
    std = F.when(F.col("n") > 1, F.sqrt(F.greatest((F.col("q") - F.col("s") * mean) / (F.col("n") - 1), F.lit(0.0))))
    return g.select(*keys, "_of.*", "rows", "n", (F.col("_mid") + mean).alias("mean"), std.alias("std")).drop("_id")
