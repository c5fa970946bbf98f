"""Cleaning and resampling of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceforge.functions.series import KEYS, by_series

TIME_UNITS = {"s": 1.0, "ms": 1e-3, "us": 1e-6}


def time_column(wide: DataFrame, names: tuple[str, ...] = ("timestamp", "time", "Time", "TIMESTAMP", "t", "time_ms", "time_s")) -> str | None:
    """The first of the known names that the recording has."""
    return next((n for n in names if n in wide.columns), None)


def numeric_columns(wide: DataFrame) -> list[str]:
    """Columns of numbers other than the time."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
    return [c for c, t in wide.dtypes if t.startswith(kinds) and c not in (time_column(wide), "seq")]


def wide_to_long(wide: DataFrame, test_id: str = "test_id", order: str | None = None) -> DataFrame:
    """A table of one column per channel as ``(test_id, channel, seq, timestamp, value)``, in order of time or of ``order``."""
    at = time_column(wide)
    channels = [c for c in numeric_columns(wide) if c not in (test_id, order)]
    rank = (F.row_number().over(Window.partitionBy(test_id).orderBy(order or at)) - 1).cast("long")
    stamp = F.col(at).cast("double") if at else F.col("seq") * 10.0
    rows = wide.withColumn("seq", rank).select(F.col(test_id).alias("test_id"), "seq", stamp.alias("timestamp"), *[F.col(c).cast("double") for c in channels])
    return rows.unpivot(["test_id", "seq", "timestamp"], channels, "channel", "value").select("test_id", "channel", "seq", "timestamp", "value")


def map_channels(readings: DataFrame, mapping: DataFrame) -> DataFrame:
    """Acquisition ids to sensor names by ``mapping(channel, sensor)``; unmapped ids stay."""
    names = mapping.groupBy("channel").agg(F.min("sensor").alias("sensor"))
    return readings.join(names, "channel", "left").withColumn("channel", F.coalesce("sensor", "channel")).drop("sensor").select(*readings.columns)


def normalise_time(raw: DataFrame, unit: str = "ms") -> DataFrame:
    """From ``(test_id, channel, seq, timestamp, value)``: the first row of each timestamp, seconds from the test's start."""
    first = Window.partitionBy(*KEYS, "timestamp").orderBy("seq")
    kept = raw.where("timestamp is not null").withColumn("rank", F.row_number().over(first)).where("rank = 1")
    start = kept.groupBy("test_id").agg(F.min("timestamp").alias("start"))
    timed = kept.join(start, "test_id").withColumn("time_s", (F.col("timestamp") - F.col("start")) * TIME_UNITS[unit])
    order = Window.partitionBy(*KEYS).orderBy("timestamp")
    return timed.select(*KEYS, (F.row_number().over(order) - 1).cast("long").alias("seq"), "time_s", (F.col("time_s") * 1000).alias("time_ms"), "value")


def neighbours(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds the last and next known value of each sample and their positions.

    Looking ahead is looking back in reverse order: a frame that only grows costs one step per row.
    """
    back = by_series().rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*KEYS).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    known_at = F.when(F.col(value).isNotNull(), F.col("seq"))
    return df.withColumns(
        {
            "prev": F.last(value, ignorenulls=True).over(back),
            "prev_seq": F.last(known_at, ignorenulls=True).over(back),
            "next": F.last(value, ignorenulls=True).over(ahead),
            "next_seq": F.last(known_at, ignorenulls=True).over(ahead),
        }
    )


def between(at: Column) -> Column:
    span = F.col("next_seq") - F.col("prev_seq")
    return F.col("prev") + (F.col("next") - F.col("prev")) * (at - F.col("prev_seq")) / span


def fill_gaps(readings: DataFrame, limit: int = 5) -> DataFrame:
    """Linear by position, forward, at most ``limit`` samples a gap, in series that have a gap of at most ``limit``.

    The head of a longer gap is filled too; a trailing gap repeats the last value; a leading gap stays.
    """
    series = Window.partitionBy(*KEYS)
    near = neighbours(readings).withColumn("top", F.max("seq").over(series))
    gap = F.coalesce("next_seq", F.col("top") + 1) - F.coalesce("prev_seq", F.lit(-1)) - 1
    near = near.withColumn("short", F.max(F.when(F.col("value").isNull() & (gap <= limit), 1).otherwise(0)).over(series))
    inside = F.col("value").isNull() & F.col("prev").isNotNull() & (F.col("seq") - F.col("prev_seq") <= limit) & (F.col("short") == 1)
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(inside, F.when(F.col("next").isNull(), F.col("prev")).otherwise(between(F.col("seq"))))
    return near.withColumn("value", filled).select(*readings.columns)


def fill_all(readings: DataFrame) -> DataFrame:
    """Linear by position without a limit, ends held; series without any value are left out."""
    near = neighbours(readings)
    value = F.coalesce("value", between(F.col("seq")), "prev", "next")
    return near.withColumn("value", value).where("value is not null").select(*readings.columns)


def carry(readings: DataFrame) -> DataFrame:
    """The last known value, else the next one."""
    return neighbours(readings).withColumn("value", F.coalesce("prev", "next")).select(*readings.columns)


def drop_incomplete(readings: DataFrame) -> DataFrame:
    """Without the samples of a test at which any channel is missing."""
    bad = readings.where("value is null").select("test_id", "seq").distinct()
    return readings.join(bad, ["test_id", "seq"], "left_anti").select(*readings.columns)


def resample(readings: DataFrame, rate_hz: float) -> DataFrame:
    """Uniform samples over [first, last) of each series, linear between the two samples around each instant."""
    known = readings.where("value is not null").select(*KEYS, "time_s", "value")
    ends = known.groupBy(*KEYS).agg(F.min("time_s").alias("t0"), F.max("time_s").alias("t1"))
    steps = ends.withColumn("steps", F.ceil((F.col("t1") - F.col("t0")) * rate_hz)).where("steps > 0")
    grid = steps.select(*KEYS, F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps") - 1)).alias("seq"), "t0")
    grid = grid.select(*KEYS, "seq", (F.col("t0") + F.col("seq") / rate_hz).alias("time_s"), F.lit(None).cast("double").alias("value"))
    every = grid.unionByName(known.withColumn("seq", F.lit(None).cast("long")))
    on_grid = F.col("seq").isNotNull()
    back = Window.partitionBy(*KEYS).orderBy("time_s", on_grid).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*KEYS).orderBy(F.desc("time_s"), on_grid.desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("value").isNotNull(), F.col("time_s"))
    around = every.withColumns(
        {
            "a": F.last("value", ignorenulls=True).over(back),
            "ta": F.last(at, ignorenulls=True).over(back),
            "b": F.last("value", ignorenulls=True).over(ahead),
            "tb": F.last(at, ignorenulls=True).over(ahead),
        }
    )
    value = F.when(F.col("tb").isNull() | (F.col("ta") == F.col("time_s")), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("time_s") - F.col("ta")) / (F.col("tb") - F.col("ta")))
    return around.where("seq is not null").select(*KEYS, "seq", "time_s", value.alias("value"))


def resolve_roles(configs: DataFrame) -> DataFrame:
    """``(test_id, role, channel)`` from ``(test_id, sensor_roles, columns)`` maps, the first map winning whole."""
    chosen = F.coalesce("sensor_roles", "columns")
    pairs = configs.select("test_id", F.explode(chosen).alias("role", "channel"))
    alias = F.create_map(*[F.lit(x) for x in ("inlet_pressure", "upstream_pressure", "mf", "mass_flow")])
    return pairs.select("test_id", F.coalesce(alias[F.col("role")], F.col("role")).alias("role"), "channel").where("channel is not null")


def steady_slice(readings: DataFrame, windows: DataFrame) -> DataFrame:
    """Readings inside each test's window ``(test_id, start_s, end_s)``, both ends included; other window columns stay."""
    return readings.join(windows, "test_id").where(F.col("time_s").between(F.col("start_s"), F.col("end_s")))


def channel_means(sliced: DataFrame, *more: str) -> DataFrame:
    """Mean of every channel of every test (and of other keys, such as a window's id); channels without values drop out."""
    return sliced.groupBy("test_id", *more, "channel").agg(F.avg("value").alias("mean"), F.count("value").alias("n")).where("mean is not null")


def fluid_state(sliced: DataFrame, roles: DataFrame) -> DataFrame:
    """Mean temperature in K (below 200 it was in C) and pressure in Pa (from bar) of each test, with defaults."""
    known = sliced.select("test_id").distinct()
    by_role = sliced.join(roles.where(F.col("role").isin("temperature", "upstream_pressure")), ["test_id", "channel"])
    means = by_role.groupBy("test_id").agg(F.avg(F.when(F.col("role") == "temperature", F.col("value"))).alias("t"), F.avg(F.when(F.col("role") == "upstream_pressure", F.col("value"))).alias("p"))
    t = F.when(F.col("t") < 200, F.col("t") + 273.15).otherwise(F.col("t"))
    return known.join(means, "test_id", "left").select("test_id", F.coalesce(t, F.lit(293.15)).alias("temperature_k"), F.coalesce(F.col("p") * 1e5, F.lit(101325.0)).alias("pressure_pa"))


def metric_columns(results: DataFrame, prefix: str = "avg_") -> list[str]:
    """Numeric columns of campaign results whose name starts with ``prefix``."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
    return [c for c, t in results.dtypes if c.startswith(prefix) and t.startswith(numeric)]


def results_long(results: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(campaign_name, test_id, test_timestamp, parameter, value)`` of the metric columns."""
    columns = columns or metric_columns(results)
    ids = [c for c in ("campaign_name", "test_id", "test_timestamp") if c in results.columns]
    return results.select(*ids, *[F.col(c).cast("double") for c in columns]).unpivot(ids, columns, "parameter", "value")
