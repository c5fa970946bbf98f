"""Importance resampling towards a target distribution (DSIR), drawn by a distributed radix sort.

Hashed runs of one to three words are counted in ``BUCKETS`` buckets over the source and over the target; each
bucket's gain is the scaled logarithm of the ratio of its smoothed shares, and a document's weight is the sum of the
gains of its features, looked up in one array. A Gumbel term from the id's digest makes the largest scores a sample
without replacement.

The draw sorts ``(score, id)`` by its digits, least significant first. A pass is a stable counting sort: rows
lie in stretches of the order so far; the rows of each digit in each stretch are counted, running sums over digits and
stretches give where each of these groups begins, and a row goes to its group's begin plus its place in the group. The
last pass's places are the ranks. A group never exceeds a stretch, so a digit that all rows share is split like any other.

Cases: a null text has no words and no features (weight 0); a null id hashes as an empty one and comes last among
equal scores; rows equal in id and score are ranked in the order in which they were read; very long texts are counted
whole; an empty source or target has only the smoothing; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceforge.llm.shared import stored, worked

BUCKETS, LONGEST, SEED = 10_000, 3, 42
#: Bits of a digit and rows of a stretch.
DIGIT_BITS, STRETCH = 8, 1 << 16

#: Lower case for A-Z; all other ASCII characters but letters and digits become spaces.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b not in range(0x7B, 0x80) else 32) for b in range(256))


def buckets_of(text: bytes | None) -> tuple[int, np.ndarray]:
    """A text's words and the buckets of its features; a longer run's checksum goes on from the shorter one's."""
    words = (text or b"").translate(WORD_BYTES).split()
    found, one, two = [], None, None
    for w in words:
        tail = b" " + w
        three = crc32(tail, two) if two is not None else None
        two = crc32(tail, one) if one is not None else None
        one = crc32(w)
        found.append(one)
        if two is not None:
            found.append(two)
            if three is not None:
                found.append(three)
    return len(words), np.array(found, np.int64) % BUCKETS


def bucket_counts(df: DataFrame, text: str) -> np.ndarray:
    """Features in each bucket over the whole table, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += np.bincount(buckets_of(t.as_py())[1], minlength=BUCKETS)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["bucket", "n"])

    sums = df.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, as a whole number of thousandths."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    ratio = (target + 1.0) * s_all / ((source + 1.0) * t_all)
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str) -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``n_features`` and ``weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def setup() -> Callable[[list], tuple]:
        gain = shared.value

        def work(texts: list) -> tuple[list, list, list]:
            made = [(n, len(b), int(gain[b].sum())) for n, b in map(buckets_of, texts)]
            return [m[0] for m in made], [m[1] for m in made], [m[2] for m in made]

        return work

    return worked(docs.withColumn(text, F.col(text).cast("binary")), [text], {"n_words": "long", "n_features": "long", "weight": "long"}, setup)


def ranked(rows: DataFrame, keys: dict[str, int]) -> DataFrame:
    """``rows`` with their ``rank`` from 1 in the order of the whole, non-negative columns ``keys``, the most significant first.

    ``keys`` gives the bits of each column. Each pass is one stable counting sort of the order so far, written out.
    """
    start = rows.withColumn("place", F.monotonically_increasing_id())
    # the order at the beginning is that of the partitions: places become gapless by the partitions' counts
    part = F.shiftright("place", 33)
    counts = start.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", before.alias("before"))
    placed = stored(start.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "before"), "radix")
    for name in reversed(keys):
        for low in range(0, keys[name], DIGIT_BITS):
            digit = F.shiftright(name, low).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int")
            dealt = placed.withColumns({"digit": digit, "stretch": F.floor(F.col("place") / STRETCH).cast("long")})
            groups = dealt.groupBy("digit", "stretch").agg(F.count("*").alias("n"))
            totals = groups.groupBy("digit").agg(F.sum("n").alias("all"))
            smaller = F.coalesce(F.sum("all").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            within = F.coalesce(F.sum("n").over(Window.partitionBy("digit").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            begins = groups.withColumn("within", within).join(F.broadcast(totals.select("digit", smaller.alias("smaller"))), "digit").select("digit", "stretch", (F.col("smaller") + F.col("within")).alias("begin"))
            rank = F.row_number().over(Window.partitionBy("digit", "stretch").orderBy("place"))
            moved = dealt.withColumn("own", rank).join(begins, ["digit", "stretch"]).withColumn("place", F.col("begin") + F.col("own") - 1)
            placed = stored(moved.drop("digit", "stretch", "own", "begin"), "radix")
    return placed.withColumn("rank", F.col("place") + 1).drop("place")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``(key, n_features, weight, score, rank)`` of every document; ``rank`` is null where it was not drawn."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    rows = weighed(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), gain, "text")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(rows.withColumn("score", (F.col("weight") + gumbel).cast("long")).withColumn("row", F.monotonically_increasing_id()), "scores")
    fit = F.col("n_words") >= least_words
    able = scored.where(fit)
    r = able.agg(F.count("*").alias("n"), F.max("score").alias("top"), F.min("score").alias("low"), F.max("key").alias("most"), F.min("key").alias("least")).first()
    n_drawn = percent * r["n"] // 100
    least, most, top, low = (r["least"] or 0), (r["most"] or 0), (r["top"] or 0), (r["low"] or 0)
    by = able.select("row", (F.lit(top) - F.col("score")).alias("down"), F.coalesce(F.col("key") - F.lit(least), F.lit(most - least + 1)).alias("up"))
    order = ranked(by, {"down": max(1, (top - low).bit_length()), "up": (most - least + 1).bit_length()})
    drawn = order.where(F.col("rank") <= n_drawn).select("row", "rank")
    return scored.join(drawn, "row", "left").select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
