"""Vector codes by product quantisation in whole numbers, with pivot distances (LAESA) in place of full searches.

A vector is cut into ``PARTS`` equal consecutive parts; each part position has a codebook of at most ``ENTRIES``
entries, refined by Lloyd rounds in integers. The distances of every part to a few fixed pivots are computed once
and stored beside it. In each round the distances of pivots to entries give, by the triangle inequality, a lower bound
of each part's distance to each entry; entries are tried in the order of their bounds, and only those whose bound does
not exceed the best exact distance so far are evaluated, exactly and in integers. A round's sums are added up in each
task, then over tasks; only codebooks (entries times components, whatever the rows) come to the driver.

Cases: rows whose vector is null or holds null or non-finite components are left out; the length of the vectors is that
of the first kept row by id, and a kept vector of another length, or with a component beyond ``LIMIT``, has a null code
and error; a length that the parts do not divide leaves the last parts shorter, an empty one gives code zero; rows
are ordered by id, nulls last, then by vector, so repeated rows count as often as they occur; no kept rows: no result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceforge.llm.shared import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Pivots of each part position, entries tried first, and vectors assigned at a time.
PIVOTS, FIRST, STRIP = 8, 4, 1024
#: Largest whole component, so that squares of any length in use stay whole.
LIMIT = 1 << 24


def part_bounds(length: int) -> list[tuple[int, int]]:
    step = -(-length // PARTS)
    return [(min(length, k * step), min(length, (k + 1) * step)) for k in range(PARTS)]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``."""
    return ((a[:, None, :] - b[None]) ** 2).sum(2)


def nearest(x: np.ndarray, book: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry, the lower index on ties, and its squared distance."""
    from_pivots = np.sqrt(squared(pivots, book).astype(float))
    bound = np.zeros((len(x), len(book)))
    for k in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, k, None] - from_pivots[k]), out=bound)
    # the roots are rounded, and pivot distances are kept in single precision: a bound is lowered by more than both errors
    bound = np.maximum(bound - 1e-5 - 1e-6 * (to_pivots.max(1, initial=0)[:, None] + from_pivots.max(0, initial=0)[None]), 0) ** 2
    first = min(FIRST, len(book))
    tried = np.argpartition(bound, first - 1, axis=1)[:, :first]
    rows = np.arange(len(x))
    best = ((x[:, None, :] - book[tried]) ** 2).sum(2)
    least = best.min(1)
    at = np.where(best == least[:, None], tried, len(book)).min(1)
    open_ = bound <= least[:, None]
    open_[rows[:, None], tried] = False
    r, e = np.nonzero(open_)
    if len(r):
        order = np.lexsort((bound[r, e], r))
        r, e = r[order], e[order]
        gap = ((x[r] - book[e]) ** 2).sum(1)
        order = np.lexsort((e, gap, r))
        r, e, gap = r[order], e[order], gap[order]
        head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        r, e, gap = r[head], e[head], gap[head]
        nearer = (gap < least[r]) | ((gap == least[r]) & (e < at[r]))
        least[r[nearer]], at[r[nearer]] = gap[nearer], e[nearer]
    return at, least


def whole(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``(key, label, whole)``: kept rows with components as integers, null where one is beyond the limit."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    near = ~F.exists("v", lambda x: F.abs(x) > LIMIT / SCALE)
    return rows.where(~F.coalesce(bad, F.lit(True))).select("key", "label", F.when(near, F.transform("v", lambda x: F.floor(x * SCALE).cast("int"))).alias("whole"))


def codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(key, code, error, label, label_error, codebooks_sha256)`` of every kept row."""
    spark = df.sparkSession
    rows = stored(whole(df, key, vector, label), "whole-vectors")
    first = rows.orderBy(F.col("key").asc_nulls_last(), "whole").limit(1).collect()
    length = len(first[0]["whole"] or []) if first else 0
    fits = F.coalesce(F.size("whole") == length, F.lit(False)) & F.col("whole").isNotNull()
    start = rows.where(fits).orderBy(F.col("key").asc_nulls_last(), "whole").limit(ENTRIES).collect()
    begin = np.array([r["whole"] for r in start], np.int64).reshape(len(start), length)
    bounds = part_bounds(length)
    books = [begin[:, a:b].copy() for a, b in bounds]
    step = max(1, len(begin) // PIVOTS)
    pivots = [np.unique(b[::step][:PIVOTS], axis=0) for b in books]

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), STRIP):
                part = batch.iloc[s : s + STRIP]
                x = np.stack(part["whole"]).astype(np.int64).reshape(len(part), length)
                far = [np.sqrt(squared(x[:, a:b], p).astype(float)).astype(np.float32) for (a, b), p in zip(bounds, pivots)]
                yield part.assign(far=list(np.concatenate(far, 1)))

    kind = rows.schema["label"].dataType.simpleString()
    known = stored(rows.where(fits).mapInPandas(measured, f"key long, label {kind}, whole array<int>, far array<float>"), "pivot-distances")
    cuts = np.cumsum([len(p) for p in pivots])[:-1]

    def assigned(batch: pd.DataFrame, books: list[np.ndarray]) -> Iterator[tuple[pd.DataFrame, np.ndarray, list, list]]:
        for s in range(0, len(batch), STRIP):
            part = batch.iloc[s : s + STRIP]
            x = np.stack(part["whole"]).astype(np.int64).reshape(len(part), length)
            far = np.split(np.stack(part["far"]).astype(float).reshape(len(part), -1), cuts, axis=1)
            found = [nearest(x[:, a:b], book, f, p) for (a, b), book, f, p in zip(bounds, books, far, pivots)]
            yield part, x, [f[0] for f in found], [f[1] for f in found]

    for _ in range(ROUNDS if start else 0):
        shared = spark.sparkContext.broadcast(books)

        def summed(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            books = shared.value
            sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
            for batch in batches:
                for _, x, at, _ in assigned(batch, books):
                    for k, (a, b) in enumerate(bounds):
                        np.add.at(sums[k], at[k], x[:, a:b])
                        np.add.at(counts[k], at[k], 1)
            for k in range(PARTS):
                on = np.flatnonzero(counts[k])
                yield pd.DataFrame({"part": k, "entry": on, "n": counts[k][on], "sums": list(sums[k][on])})

        parts = known.mapInPandas(summed, "part int, entry long, n long, sums array<long>")
        entries = parts.select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        books = [b.copy() for b in books]
        for r in entries.where("at is not null").collect():
            books[r["part"]][r["entry"], r["at"]] = r["x"] // r["n"]
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    final = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, _, at, error in assigned(batch, final.value):
                code = ["".join(f"{v:02x}" for v in row) for row in zip(*[a.tolist() for a in at])]
                yield part[["key", "label"]].assign(code=code, error=sum(error))

    done = known.mapInPandas(coded, f"key long, label {kind}, code string, error long")
    other = rows.where(~fits).select("key", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    out = stored(done.unionByName(other), "codes")
    totals = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    met = out.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return met.select(F.col("key").alias(key), "code", "error", "label", "label_error", F.lit(digest).alias("codebooks_sha256"))
