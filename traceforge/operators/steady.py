"""Steady-window detection. Every detector gives ``(test_id, start_s, end_s, method)``, no row where it finds none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceforge.functions.blocks import percentiles
from traceforge.functions.series import KEYS, by_series, interval_sums, longest, ratio, rolling, runs

#: Trees of the isolation forest, and rows that each tree is grown on.
TREES, TREE_ROWS = 100, 256
#: Samples of a test that are scored together.
BLOCK_ROWS = 8192
#: Roles of the channel that shows whether a test is steady, the first that a test has.
STEADY_ROLES = ("upstream_pressure", "chamber_pressure", "pressure")


def as_window(run_rows: DataFrame, method: str) -> DataFrame:
    return run_rows.select("test_id", "start_s", "end_s", F.lit(method).alias("method"))


def steady_cv(readings: DataFrame, channel: str, width: int = 50, threshold: float = 0.02) -> DataFrame:
    """The longest run whose rolling coefficient of variation stays under the threshold."""
    own = readings.where(F.col("channel") == channel)
    v = F.col("value")
    cv = F.coalesce(ratio(rolling(F.stddev_samp(v), v, width), F.abs(rolling(F.avg(v), v, width))), F.lit(1.0))
    return as_window(longest(runs(own.withColumn("cv", cv), F.col("cv") < threshold)), "cv")


def steady_derivative(readings: DataFrame, channel: str, width: int = 20, threshold: float = 0.1, least: int = 10) -> DataFrame:
    """The longest run of a small smoothed slope, relative to the signal's range; it ends one sample later."""
    own = readings.where((F.col("channel") == channel) & F.col("value").isNotNull())
    span = own.groupBy(*KEYS).agg((F.max("value") - F.min("value")).alias("span"))
    w = by_series()
    dt = F.lead("time_s").over(w) - F.col("time_s")
    slope = F.abs((F.lead("value").over(w) - F.col("value")) / F.when(dt == 0, 1e-10).otherwise(dt))
    steps = own.join(span, list(KEYS)).withColumns({"slope": ratio(slope, F.col("span")), "after_s": F.lead("time_s").over(w)}).where("after_s is not null")
    smooth = steps.withColumn("s", F.coalesce(rolling(F.avg("slope"), F.col("slope"), width), F.lit(1.0)))
    best = longest(runs(smooth, F.col("s") < threshold)).where(F.col("n") >= least)
    ends = steps.select("test_id", "channel", F.col("seq").alias("end_seq"), "after_s")
    return best.join(ends, ["test_id", "channel", "end_seq"]).select("test_id", "start_s", F.col("after_s").alias("end_s"), F.lit("derivative").alias("method"))


def steady_middle(readings: DataFrame, channel: str, share: float = 0.5) -> DataFrame:
    """The middle of the samples by position."""
    own = readings.where(F.col("channel") == channel)
    low, high = F.floor(F.col("n") * (1 - share) / 2), F.least(F.floor(F.col("n") * (1 + share) / 2), F.col("n") - 1)
    j = own.withColumn("at", F.row_number().over(by_series()) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*KEYS)))
    return j.groupBy("test_id").agg(F.max(F.when(F.col("at") == low, F.col("time_s"))).alias("start_s"), F.max(F.when(F.col("at") == high, F.col("time_s"))).alias("end_s"), F.lit("simple").alias("method"))


def steady_auto(readings: DataFrame, channel: str, preferred: DataFrame | None = None, width: int = 50, threshold: float = 0.02) -> DataFrame:
    """The first detector that succeeds for each test: the preferred one, variation, slope, middle."""
    found = [d for d in (preferred, steady_cv(readings, channel, width, threshold), steady_derivative(readings, channel), steady_middle(readings, channel)) if d is not None]
    ranked = None
    for rank, d in enumerate(found):
        own = d.where("start_s is not null").withColumn("rank", F.lit(rank))
        ranked = own if ranked is None else ranked.unionByName(own)
    return ranked.groupBy("test_id").agg(F.min_by(F.struct("start_s", "end_s", "method"), "rank").alias("w")).select("test_id", "w.*")


def steady_channel(readings: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """``(test_id, channel)``: by role of ``roles(channel, role[, test_id])``, else the first channel with ``pressure`` in its name."""
    have = readings.select("test_id", "channel").distinct()
    rank = F.when(F.lower("channel").contains("pressure"), len(STEADY_ROLES))
    if roles is not None:
        on = ["test_id", "channel"] if "test_id" in roles.columns else ["channel"]
        have = have.join(roles.select(*on, "role"), on, "left")
        by_role = [F.when(F.col("role") == r, k) for k, r in enumerate(STEADY_ROLES)]
        rank = F.coalesce(*by_role, rank)
    ranked = have.withColumn("rank", rank).where("rank is not null")
    return ranked.groupBy("test_id").agg(F.min(F.struct("rank", "channel"))["channel"].alias("channel"))


def steady_auto_by_role(readings: DataFrame, roles: DataFrame | None = None, preferred: DataFrame | None = None, width: int = 50, threshold: float = 0.02) -> DataFrame:
    """:func:`steady_auto` on each test's own channel."""
    own = readings.join(steady_channel(readings, roles), ["test_id", "channel"], "left_semi").withColumn("channel", F.lit("signal"))
    return steady_auto(own, "signal", preferred, width, threshold)


def validate(readings: DataFrame, windows: DataFrame, channel: str, least: int = 10, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Whether each window is usable, with the reason if not."""
    own = readings.where(F.col("channel") == channel)
    inside = F.count_if(F.col("time_s").between(F.col("start_s"), F.col("end_s")))
    g = own.join(windows, "test_id").groupBy("test_id", "start_s", "end_s").agg(F.count("*").alias("n"), inside.alias("inside"))
    share = F.col("inside") / F.col("n")
    reason = F.when(F.col("start_s") >= F.col("end_s"), "start not before end").when(F.col("inside") < least, "too few samples").when(share < low, "too short").when(share > high, "too long").otherwise("ok")
    return g.select("test_id", "inside", reason.alias("reason"), (reason == "ok").alias("valid"))


def sweep(readings: DataFrame, windows: DataFrame) -> DataFrame:
    """Channel means for many candidate windows ``(test_id, window_id, start_s, end_s)`` of each test.

    Each window's bounds are two rows in a channel's order of time; no sample meets a window.
    """
    own = readings.select("test_id", "channel").distinct().join(windows, "test_id")
    return interval_sums(readings, own, "value", "time_s", "start_s", "end_s").select("test_id", "window_id", "channel", "mean", "std", "n")


def path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of ``n`` rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


#: Rows of a node that are taken as a list.
FEW = 8
#: Mean depths of searches by the rows of a leaf.
PATHS = path_length(np.arange(TREE_ROWS + 1)).tolist()


def grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple[int, float, int, int, float]]:
    """An isolation tree as rows ``(feature, cut, left, right, length)``; a leaf has feature -1 and its path's mean length."""
    nodes, waiting = [], [(x, 0, -1, 0)]
    while waiting:
        own, level, above, side = waiting.pop()
        at = len(nodes)
        if above >= 0:
            nodes[above][side] = at
        split = level < depth and len(own) > 1
        if split and len(own) > FEW:
            low, high = np.minimum.reduce(own), np.maximum.reduce(own)
            varied = (high > low).nonzero()[0]
            split = len(varied) > 0
        elif split:  # few rows are faster as a list
            own = own if isinstance(own, list) else own.tolist()
            columns = list(zip(*own))
            low, high = list(map(min, columns)), list(map(max, columns))
            varied = [i for i, a in enumerate(low) if a < high[i]]
            split = len(varied) > 0
        if not split:
            nodes.append([-1, 0.0, at, at, level + PATHS[len(own)]])
            continue
        f = int(varied[rng.integers(len(varied))])
        least, most = float(low[f]), float(high[f])
        cut = least + (most - least) * rng.random()
        nodes.append([f, cut, -1, -1, 0.0])
        if isinstance(own, list):
            parts = [row for row in own if row[f] >= cut], [row for row in own if row[f] < cut]
        else:
            left = own[:, f] < cut
            parts = own[~left], own[left]
        waiting += [(parts[0], level + 1, at, 3), (parts[1], level + 1, at, 2)]
    return [tuple(n) for n in nodes]


def forest_of(x: np.ndarray, seed: int) -> np.ndarray:
    """The nodes of all trees end to end, each row led by its tree's number."""
    rng, size = np.random.default_rng(seed), min(TREE_ROWS, len(x))
    trees = [grow(x[rng.choice(len(x), size, replace=False)], rng, 8) for _ in range(TREES)]
    return np.array([(k, *node) for k, tree in enumerate(trees) for node in tree], float)


def forest_scores(forest: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of rows by the mean of their path lengths, all rows down all trees a level at a time; a leaf leads to itself."""
    first = np.flatnonzero(np.diff(forest[:, 0], prepend=-1))
    start = first[np.searchsorted(first, np.arange(len(forest)), "right") - 1]
    feature, cut, left, right = forest[:, 1].astype(int), forest[:, 2], forest[:, 3].astype(int) + start, forest[:, 4].astype(int) + start
    at, rows = np.repeat(first[:, None], len(x), 1), np.arange(len(x))
    while True:
        to = np.where(x[rows, feature[at]] < cut[at], left[at], right[at])
        if (to == at).all():
            break
        at = to
    return 2.0 ** (-np.mean(forest[at, 5], 0) / path_length(np.array(TREE_ROWS)))


def steady_forest(readings: DataFrame, channels: list[str], contamination: float = 0.3, gap: int = 5, width: int = 20, seed: int = 7) -> DataFrame:
    """The longest run of isolation-forest inliers on value, rolling mean and rolling deviation of all given channels.

    A forest is grown per test from a bounded sample of its rows (``TREES * TREE_ROWS``), then all rows are scored
    where they lie; the threshold is the contamination quantile of the scores of the test.
    """
    v = F.col("value")
    own = readings.where(F.col("channel").isin(channels))
    features = own.withColumns({"m": rolling(F.avg(v), v, width), "s": rolling(F.stddev_samp(v), v, width)})
    wide = features.groupBy("test_id", "seq").agg(F.min("time_s").alias("time_s"), *[F.max(F.when(F.col("channel") == c, F.col(k))).alias(f"{k}_{i}") for i, c in enumerate(channels) for k in ("value", "m", "s")])
    names = [f"{k}_{i}" for i in range(len(channels)) for k in ("value", "m", "s")]
    # a forest costs more than its rows, so tests are dealt by number, not put together by their bytes
    full = wide.dropna(subset=names).repartition(8 * readings.sparkSession.sparkContext.defaultParallelism, "test_id")
    sizes = full.groupBy("test_id").agg(F.count("*").alias("n")).where("n >= 50")
    # rows with the smallest hashes: only those under a bound that leaves a fifth more than wanted are put in order
    wanted = TREES * TREE_ROWS
    full = full.join(sizes, "test_id").withColumn("hash", F.xxhash64("test_id", "seq"))
    bound = F.when(F.col("n") > 2 * wanted, (F.lit(1.2 * wanted) / F.col("n") * 2.0**64 - 2.0**63).cast("long")).otherwise(F.lit(2**63 - 1))
    order = Window.partitionBy("test_id").orderBy("hash", "seq")
    sample = full.where(F.col("hash") <= bound).withColumn("k", F.row_number().over(order)).where(F.col("k") <= wanted)
    grouped = sample.groupBy("test_id").agg(F.flatten(F.collect_list(F.array(*names))).alias("grown_on"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, forest = None, np.empty((0, 6))
        for batch in batches:
            for test, seq, time, rows, grown_on in batch.itertuples(index=False):
                if test != known:  # a test's blocks come one after another
                    known, forest = test, forest_of(grown_on.reshape(-1, len(names)), seed)
                yield pd.DataFrame({"test_id": test, "seq": seq, "time_s": time, "score": forest_scores(forest, rows.reshape(-1, len(names)))})

    # the rows that a forest is grown on go with a block: they are smaller than the forest, of which a batch would hold thousands
    row = F.struct("seq", "time_s", F.array(*names).alias("x"))
    blocks = full.groupBy("test_id", F.floor(F.col("seq") / BLOCK_ROWS).alias("block")).agg(F.collect_list(row).alias("rows")).join(grouped, "test_id")
    scored = blocks.select("test_id", "rows.seq", "rows.time_s", F.flatten("rows.x").alias("x"), "grown_on").sortWithinPartitions("test_id").mapInPandas(score, "test_id string, seq long, time_s double, score double")
    scored = scored.persist()  # read three times, and a forest is to be grown once
    cut = percentiles(scored, "score", {"cut": 1 - contamination}, ("test_id",)).select("test_id", "cut")
    keyed = scored.join(cut, "test_id").withColumn("channel", F.lit("all"))
    return as_window(longest(runs(keyed, F.col("score") <= F.col("cut"), gap=gap)), "ml")
