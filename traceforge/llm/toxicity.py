"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of its words, a word's count being the number of documents of the class that hold it.
Counts are lowered by a discount, estimated for each class from its counts of counts (one for counts of one, two,
and three or more, each less than the count, so every word keeps a part of its own), and the mass so
freed goes to a backoff distribution that both classes share: how many different words stand before a word,
over all fitting documents. Rare expressions thus get their probability from the shared counts in both models.

Two log-likelihoods of a text are compared, both over all its words and normalised by its length. An ordinary
text draws every word from the ordinary model. A toxic text draws a word from the toxic model with the
probability ``RATE`` and else from the ordinary one, since few words make a document toxic. Words of no labelled row
have one and the same ratio; no word is left out of the score.

Counts are taken over every labelled row outside the held-out fold, merged within a task and then by a shuffle
on the word and the upper bits of the word before it, which deals a frequent word over several tasks. Words are
known by 64-bit hashes, the words before them by 40 of these bits, and the different ones are counted one by one;
the start of a text counts as one of them. Counts are kept apart for the calibration fold,
so that the cut is set with a model that has not seen the rows it is set on; the final model uses all of them.
A model of ``BROADCAST_BYTES`` at most is broadcast; a larger one is joined to the words of the texts by a
shuffle, with the same scores.

Cases: null, empty and wordless texts have the lowest score; labels that are null, repeated or belong to no
document are ignored or merged (the higher wins); without labels of both classes every score is 0; an empty
table gives an empty result; repeated rows are scored alike; other columns are ignored by ``scored`` and
returned as they were by ``kept``, whatever their names; texts of any length are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceforge.llm.labels import cut, fold, histogram, labelled
from traceforge.llm.shared import stored, worked

WORD = re.compile(r"\w+")
#: The share of toxic words in a toxic text.
RATE = 0.005
#: Discounts are at least this, and this far under the count.
LEAST = 0.05
#: Words added to a text's length, so that a few words alone do not make an extreme score.
SMOOTH = 20
#: A model of up to this size is broadcast, at ``WORD_BYTES`` a word (a hash and a value).
BROADCAST_BYTES = 96_000_000
WORD_BYTES = 16
#: Words that a scoring task remembers, and rows of one batch of a text's words.
FLUSH = 200_000
#: Counts that a counting task merges before it hands them on.
MERGE = 2_000_000
LOW, HIGH = -9.5, 2.0
COUNTS = ["n0", "n1", "c0", "c1"]
#: A word before another is a number over ``START``, which is the start of a text; smaller ones are the ``COUNTS``.
START, CONTEXT = len(COUNTS), 2**40 - 1
#: The contexts of one word are dealt over 2 ** (40 - DEAL) tasks by their upper bits.
DEAL = 37


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def hashed(word: str) -> int:
    """A 64-bit hash without its sign."""
    return xxhash.xxh64_intdigest(word) >> 1


def counted(rows: DataFrame) -> DataFrame:
    """``(word, n0, n1, c0, c1, contexts)`` over all rows of ``(text, label, fold)``: documents of each class that
    hold the word, outside and inside the calibration fold, and how many different words stand before it."""
    names = ["word", "what", "n"]

    def merged(parts: list[tuple]) -> tuple[np.ndarray, ...]:
        """One entry for each word and ``what``, in their order, so that neighbours in the shuffle are alike."""
        word, what, n = map(np.concatenate, zip(*parts))
        order = np.lexsort((what, word))
        word, what, n = word[order], what[order], n[order]
        first = np.flatnonzero(np.r_[True, (np.diff(word) != 0) | (np.diff(what) != 0)])
        return word[first], what[first], np.add.reduceat(n, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for text, label, part in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                own = np.fromiter(map(hashed, words_of(text)), np.int64)
                if not len(own):
                    continue
                once = np.unique(own)
                # an entry for each word of the document, then one for each pair, which counts no document
                parts.append((once, np.full(len(once), (label > 0) + 2 * (part == 4)), np.ones(len(once), np.int64)))
                parts.append((own, np.r_[np.int64(START), (own[:-1] & CONTEXT) + START + 1], np.zeros(len(own), np.int64)))
                held += len(once) + len(own)
                if held >= MERGE:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if 2 * held > MERGE:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names)
                        parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)], names)

    found = rows.select("text", "label", "fold").mapInArrow(run, "word long, what long, n long")
    deal = F.shiftright("what", DEAL)
    pairs = found.repartition("word", deal).groupBy("word", deal, "what").agg(F.sum("n").alias("n"))
    sums = [F.sum(F.when(F.col("what") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(COUNTS)]
    return pairs.groupBy("word").agg(*sums, F.sum((F.col("what") >= START).cast("long")).alias("contexts"))


class WordValues:
    """What a word adds to the difference of the two log-likelihoods: ``words`` by hash, ``rest`` for any other."""

    def __init__(self, words: DataFrame, rest: float, most: int):
        self.rest, self.table, self.packed = rest, words, None
        if words.count() * WORD_BYTES <= most:
            found = words.toArrow()
            word, value = (found.column(c).to_numpy() for c in ("word", "value"))
            order = np.argsort(word)
            self.packed = word[order], value[order]

    def sums(self) -> Callable[[], Callable]:
        """For :func:`worked`: a function from texts to the sums of their words' values and their lengths."""
        known = self.table.sparkSession.sparkContext.broadcast(self.packed)
        rest = self.rest

        def setup() -> Callable:
            keys, values = known.value
            memory: dict[str, float] = {}

            def value(word: str) -> float:
                h = hashed(word)
                k = np.searchsorted(keys, h)
                v = memory[word] = float(values[k]) if k < len(keys) and keys[k] == h else rest
                return v

            def work(texts: list) -> tuple[list, list]:
                total, size = [], []
                for text in texts:
                    if len(memory) > FLUSH:
                        memory.clear()
                    words = words_of(text)
                    total.append(math.fsum(memory[w] if w in memory else value(w) for w in words))
                    size.append(len(words))
                return total, size

            return work

        return setup


def discounts(found: list[int]) -> list[float]:
    """Discounts of counts of one, two, and three or more from how many words have counts of one to four (Chen and Goodman)."""
    y = found[0] / (found[0] + 2 * found[1]) if found[0] else 0.0
    made = [k - (k + 1) * y * found[k] / found[k - 1] if found[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return [min(max(d, LEAST), k - LEAST) for k, d in enumerate(made, 1)]


def fitted(counts: DataFrame, most: int = BROADCAST_BYTES) -> WordValues | None:
    """The model of ``(word, n0, n1, contexts)``; none without words of both classes."""
    known = [F.count_if(F.col(n) == k).alias(f"{n}_{k}") for n in ("n0", "n1") for k in (1, 2, 3)]
    many = [F.count_if(F.col(n) > 3).alias(f"{n}_more") for n in ("n0", "n1")]
    fours = [F.count_if(F.col(n) == 4).alias(f"{n}_4") for n in ("n0", "n1")]
    sums = counts.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.sum("contexts").alias("c"), F.count("*").alias("v"), *known, *many, *fours).first()
    if not sums["t0"] or not sums["t1"]:
        return None
    by = {n: discounts([sums[f"{n}_{k}"] for k in (1, 2, 3, 4)]) for n in ("n0", "n1")}
    freed = {n: by[n][0] * sums[f"{n}_1"] + by[n][1] * sums[f"{n}_2"] + by[n][2] * (sums[f"{n}_3"] + sums[f"{n}_more"]) for n in by}

    def discount(n: str) -> Column:
        first, second, more = by[n]
        return F.when(F.col(n) == 0, 0.0).when(F.col(n) == 1, first).when(F.col(n) == 2, second).otherwise(more)

    shared = (F.col("contexts") + 0.5) / (sums["c"] + 0.5 * (sums["v"] + 1))

    def p(n: str, k: str) -> Column:
        return (F.col(n) - discount(n)) / sums[f"t{k}"] + freed[n] / sums[f"t{k}"] * shared

    # toxic against ordinary text, for one word: (1 - RATE) p0 + RATE p1 over p0
    value = F.log(1 - RATE + RATE * p("n1", "1") / p("n0", "0"))
    rest = math.log(1 - RATE + RATE * (freed["n1"] / sums["t1"]) / (freed["n0"] / sums["t0"]))
    own = (F.col("n0") > 0) | (F.col("n1") > 0)
    return WordValues(stored(counts.where(own).select("word", value.alias("value")), "toxic-words"), rest, most)


def joined(df: DataFrame, model: WordValues, text: str) -> DataFrame:
    """``df`` with ``total`` and ``size`` of its texts, the model joined to the words by a shuffle.

    Texts are known by their digests, so equal ones are scored once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(body)
                rows += [(digest, hashed(w), n, len(words)) for w, n in Counter(words).items()]
                if len(rows) >= FLUSH:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["digest", "word", "n", "size"])

    def digest(column: str) -> Column:
        return F.unhex(F.md5(F.col(column).cast("binary")))

    texts = df.where(F.col(text).isNotNull()).select(digest(text).alias("digest"), F.col(text).alias("text"))
    words = texts.mapInArrow(run, "digest binary, word long, n long, size long").distinct()
    found = words.join(model.table, "word", "left").groupBy("digest").agg(F.sum(F.col("n") * F.coalesce("value", F.lit(model.rest))).alias("total"), F.first("size").alias("size"))
    names = [f"c{i}" for i in range(len(df.columns))]
    keyed = df.toDF(*names).withColumn("digest", digest(names[df.columns.index(text)]))
    full = keyed.join(found, "digest", "left").select(*names, F.coalesce("total", F.lit(0.0)), F.coalesce("size", F.lit(0)))
    return full.toDF(*df.columns, "total", "size")


def with_evidence(df: DataFrame, model: WordValues, text: str = "text") -> DataFrame:
    """``df`` with ``s``: the logarithm of the length-normalised difference over its least possible value."""
    names = [f"c{i}" for i in range(len(df.columns))]
    own, column = df.toDF(*names), names[df.columns.index(text)]
    full = joined(own, model, column) if model.packed is None else worked(own, [column], {"total": "double", "size": "long"}, model.sums(), drop=[])
    mean = F.col("total") / (F.col("size") + SMOOTH)
    s = F.when(F.col("size") == 0, LOW).otherwise(F.log(F.greatest(mean - math.log(1 - RATE), F.lit(0.0)) + 1e-4))
    return full.select(*names, s).toDF(*df.columns, "s")


class ToxicityModel:
    """Word values with the cut and slope that turn evidence into a probability."""

    def __init__(self, words: WordValues | None, threshold: float, slope: float):
        self.words, self.threshold, self.slope = words, threshold, slope

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = BROADCAST_BYTES) -> ToxicityModel:
        rows = labelled(docs, labels, label)
        counts = stored(counted(rows), "word-counts")
        words = fitted(counts.select("word", (F.col("n0") + F.col("c0")).alias("n0"), (F.col("n1") + F.col("c1")).alias("n1"), "contexts"), most)
        unseen = fitted(counts, most)
        if words is None or unseen is None:
            return cls(words, -4.9, 16.0)  # too few rows to calibrate on: the cut stands just over no evidence
        tested = histogram(with_evidence(rows.where("fold = 4").select("text", "label"), unseen), LOW, HIGH)
        return cls(words, *cut(tested, LOW, HIGH)) if tested.sum(0).all() else cls(words, -4.9, 16.0)

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.slope * (F.col("s") - self.threshold)))

    def scored(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """``(key, held_out, score, predicted)`` of every row."""
        rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
        if self.words is None:
            found = rows.select("key", F.lit(0.0).alias("score"))
        else:
            found = with_evidence(rows, self.words).select("key", self.probability().alias("score"))
        return found.select(F.col("key").alias(key), (fold(F.col("key")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

    def kept(self, df: DataFrame, text: str = "text") -> DataFrame:
        """The rows of ``df`` that are not toxic, with their columns as they were."""
        if self.words is None:
            return df
        names = [f"c{i}" for i in range(len(df.columns))]
        found = with_evidence(df.toDF(*names), self.words, names[df.columns.index(text)])
        return found.where(F.col("s") < self.threshold).select(*names).toDF(*df.columns)
