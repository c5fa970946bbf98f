"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items are cut into windows (13 consecutive words, or the whole of a shorter item). The shingles
of the windows are ordered by how many rows of the corpus hold them, counted over all rows. A row can
contain a window only if it holds every shingle of it, so for exact containment the necessary prefix is the
rarest shingle alone: rows are joined to windows on it. A hit on that shingle fixes where the window would
start; it must then fit inside the row (length and positional bounds), and the words in place are compared
one by one.

Items with equal texts become one text with several ids, in Spark. The texts are taken in blocks of bounded
size, ids included. Each block is broadcast and the rows are joined to it where they lie, so no row is
shuffled, however often a shingle occurs; a benchmark of any size takes more blocks, one after another over
the same rows.

Cases: null and empty texts have no words and are clean; items without words or without an id are ignored;
items that repeat count under each of their different ids; an empty table gives an empty result, an empty
benchmark clean rows; repeated rows are judged alike. Extra columns are carried through; of those whose names
the result adds, the result's stay (the pipeline renames its columns first).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceforge.llm.shared import worked

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
SHINGLE = 3
#: Bytes of benchmark text and ids in one broadcast block (its index takes about 50 times as many).
BLOCK_BYTES = 4_000_000

#: An item: its words and its ids. A window of it is known by the item's number, its start and its length.
Item = tuple[list[bytes], list[str]]


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8").lower())


def shingles(words: list[bytes], width: int) -> list[bytes]:
    return words if width == 1 else [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[Item]]:
    """The items, a block of bounded bytes at a time."""
    ids = F.array_sort(F.collect_set(F.col(item).cast("string")))
    grouped = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(ids.alias("ids"))
    size = F.octet_length("text") + F.aggregate("ids", F.lit(64), lambda a, x: a + F.octet_length(x))
    total = grouped.agg(F.sum(size.cast("long"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for k in range(n):
        part = grouped if n == 1 else grouped.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        items = [(words_of(r["text"]), r["ids"]) for r in part.toLocalIterator()]
        yield [x for x in items if x[0]]


def corpus_counts(df: DataFrame, text: str, wanted: set[bytes], width: int) -> dict[bytes, int]:
    """In how many rows each wanted shingle occurs, over all rows; at most one number per wanted shingle comes back."""
    known = df.sparkSession.sparkContext.broadcast({s: i for i, s in enumerate(wanted)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = known.value
        total = np.zeros(len(index), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = words_of(t)
                hits = index.keys() & set(shingles(words, width)) if len(words) >= width else ()
                total[[index[s] for s in hits]] += 1
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["k", "n"])

    counts = df.select(F.col(text).alias("text")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    names = list(known.value)
    return {names[r["k"]]: r["n"] for r in counts}


def prefix_index(items: list[Item], window: int, rows: dict[int, dict[bytes, int]]) -> dict[int, dict[bytes, list]]:
    """By shingle width and shingle: ``(offset, item, start)`` of the windows whose rarest shingle it is."""
    index: dict[int, dict[bytes, list]] = {}
    for number, (words, _) in enumerate(items):
        size = min(window, len(words))
        width = min(SHINGLE, size)
        own, counts = shingles(words, width), rows[width]
        order = [(counts.get(s, 0), s) for s in own]
        for start in range(len(words) - size + 1):
            at = min(range(start, start + size - width + 1), key=order.__getitem__)
            if order[at][0]:  # a shingle that no row holds rules its window out
                index.setdefault(width, {}).setdefault(own[at], []).append((at - start, number, start))
    return index


def hits_in(words: list[bytes], items: list[Item], window: int, index: dict[int, dict[bytes, list]]) -> tuple[list[int], set[str]]:
    """Positions of hit words and the ids of the items that have occurring windows."""
    hit, found = set(), set()
    n = len(words)
    for width, probes in index.items():
        if n < width:
            continue
        for p, s in enumerate(shingles(words, width)):
            for offset, number, begin in probes.get(s, ()):
                own, ids = items[number]
                size, start = min(window, len(own)), p - offset
                if start >= 0 and start + size <= n and words[start : start + size] == own[begin : begin + size]:
                    hit.update(range(start, start + size))
                    found.update(ids)
    return sorted(hit), found


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with ``n_words, n_hit, n_items, items_sha256, contaminated`` and the hit items and spans."""
    spark = df.sparkSession
    added = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hits")
    out = df.drop(*(c for c in added if c in df.columns))
    out = out.selectExpr("*", "0L as n_words", "cast(array() as array<string>) as items", "cast(array() as array<int>) as hits")
    found = False
    for block in blocks(benchmark, item, item_text):
        wanted: dict[int, set[bytes]] = {}
        for words, _ in block:
            width = min(SHINGLE, window, len(words))
            wanted.setdefault(width, set()).update(shingles(words, width))
        rows = {width: corpus_counts(df, text, s, width) for width, s in wanted.items()}
        known = spark.sparkContext.broadcast((block, prefix_index(block, window, rows)))
        out, found = with_hits(out, text, lambda known=known: known.value, window), True
    if not found:
        out = with_hits(out, text, lambda: ([], {}), window)
    n_hit = F.size("hits").cast("long")
    return out.withColumn("n_hit", n_hit).withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256),
            "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
        }
    )


def with_hits(out: DataFrame, text: str, known: Callable[[], tuple], window: int) -> DataFrame:
    """``out`` with its words counted and the hits of one block added to those that it has."""

    def setup() -> Callable:
        items, index = known()

        def work(texts: list, had: list, was: list) -> tuple[list, list, list]:
            n_words, ids, hits = [], [], []
            for t, h, w in zip(texts, had, was):
                words = words_of(t)
                hit, found = hits_in(words, items, window, index)
                n_words.append(len(words))
                ids.append(sorted({*h, *found}))
                hits.append(sorted({*w, *hit}))
            return n_words, ids, hits

        return work

    return worked(out.drop("n_words"), [text, "items", "hits"], {"n_words": "long", "items": "array<string>", "hits": "array<int>"}, setup, drop=["items", "hits"])
