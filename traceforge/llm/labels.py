"""What the two classifiers share: labelled rows, the held-out fold, and a calibrated cut."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labels up to this number (about 60 MB as a hash table) are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
BINS = 4000


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 5: fold 0 is held out, fold 4 calibrates, the others fit."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def known_labels(labels: DataFrame, label: str, key: str) -> DataFrame:
    """``(key, label)`` outside the held-out fold: one row per id, the highest label where an id has several."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    return known.where(fold(F.col(key)) != 0)


def labelled(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(text, label, fold)`` of all rows with a label outside the held-out fold."""
    known = known_labels(labels, label, key)
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.where(F.col(key).isNotNull()).select(key, F.col(text).alias("text")).join(known, key).select("text", "label", fold(F.col(key)).alias("fold"))


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: int, lines: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(text, label)`` of at most ``most`` labelled rows of the fitting folds with at most ``lines`` lines in all.

    Ids are taken in the order of their hashes before any text is read. An id that repeats gives one row, with
    its smallest text. Texts with over a tenth of ``lines`` are not sampled.
    """
    known = known_labels(labels, label, key).where(fold(F.col(key)) != 4).orderBy(F.xxhash64(key), key).limit(most)
    found = docs.where(F.col(key).isNotNull()).select(key, F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(known), key)
    size = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1
    one = found.where(10 * size <= lines).groupBy(key, "label").agg(F.min("text").alias("text"))
    order = Window.orderBy(F.xxhash64(key), key)  # at most ``most`` rows
    return one.withColumn("lines", F.sum(size).over(order)).where(F.col("lines") <= lines).select("text", "label")


def histogram(scored: DataFrame, low: float, high: float) -> np.ndarray:
    """Counts of ``s`` by bin (rows) and label (columns); one row per bin comes to the driver."""
    at = F.least(F.greatest(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(0)), F.lit(BINS - 1))
    out = np.zeros((BINS, 2))
    for r in scored.groupBy(at.cast("int").alias("bin"), "label").agg(F.count("*").alias("n")).collect():
        out[r["bin"], int(r["label"] > 0)] += r["n"]
    return out


def cut(counts: np.ndarray, low: float, high: float, balanced: bool = False) -> tuple[float, float]:
    """The threshold with the fewest wrong rows (the middle of the best stretch) and a logistic slope at it.

    ``balanced`` weighs both labels alike.
    """
    edges = low + (high - low) * np.arange(BINS + 1) / BINS
    n0, n1 = counts.sum(0)
    if not n0 or not n1:
        return (edges[-1], 1.0) if not n1 else (edges[0], 1.0)
    weight = np.array([1 / n0, 1 / n1]) if balanced else np.ones(2)
    below = np.vstack([np.zeros(2), counts.cumsum(0)]) * weight
    wrong = below[:, 1] + (below[-1, 0] - below[:, 0])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    first = best[0]
    last = first
    while last + 1 in best:
        last += 1
    threshold = (edges[first] + edges[last]) / 2
    middle = (edges[:-1] + edges[1:]) / 2 - threshold
    slopes = 2.0 ** np.arange(-2, 8)
    loss = [(counts * np.logaddexp(0, np.outer(middle * k, [1, -1]))).sum() for k in slopes]
    return float(threshold), float(slopes[int(np.argmin(loss))])
