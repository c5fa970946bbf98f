"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its own and its neighbours': length, letter case, digits,
symbols, runs of symbols, repeated words, whether the line was seen before. Training takes the document's
label for each of its lines; scoring runs forward-backward over the whole document and averages the lines'
marginal probabilities of being good, weighted by length. A one-dimensional calibration maps the average so
that ``CUT`` separates the classes best.

The field is fitted on a bounded sample of labelled rows: one for each of the ``TRAIN_DOCS`` ids of the fitting
folds that hash lowest, as many in that order as have ``TRAIN_LINES`` lines together. Every line of theirs is
used; texts are cut into chains of ``CHAIN`` lines, for training alone. Everything else reads all rows.

Cases: null, empty and blank texts are one empty line; one very long line is one line; a document of any
number of lines is scored whole; repeated and null labels are merged or ignored; of rows that share an id, the
sample takes the smallest text; without labels of both classes every score is 1 (nothing is rejected on no
evidence); an empty table gives an empty result; repeated rows are scored alike; other columns are ignored
by ``scored`` and returned as they were by ``kept``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceforge.llm.labels import cut, fold, histogram, labelled, sampled
from traceforge.llm.shared import worked

TRAIN_DOCS = 4000
TRAIN_LINES = 100_000
CHAIN = 32
CUT = 0.3
OWN = 14
FEATURES = 3 * OWN + 2
LOW, HIGH = -12.0, 12.0

def byte_table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


UPPER = byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = byte_table(b"0123456789")
#: Letters by their first byte: ASCII letters and the first bytes of longer characters.
LETTER = byte_table(bytes([*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]))
#: First bytes of any character.
FIRST = byte_table(bytes([*range(128), *range(0xC2, 0xF5)]))
SPACE = byte_table(b" \t\n\r\v\f")
PROSE = byte_table(b".,;:'\"?()-_ \t\n\r\v\f")
SYMBOL = ~(LETTER | DIGIT | PROSE) & byte_table(bytes(range(33, 127)))
MARK = ~(LETTER | DIGIT | SPACE) & byte_table(bytes(range(33, 127)))
CLOSING = byte_table(b".!?:\"")


def word_shares(line: str) -> tuple[int, int, int]:
    """Words, different words, and words that repeat the one before."""
    words = line.split()
    return len(words), len(set(words)), sum(map(str.__eq__, words, words[1:]))


def in_groups(texts: list) -> Iterator[list[str]]:
    """Texts, some megabytes at a time: bytes are classed for many short texts at once."""
    group, held = [], 0
    for text in texts:
        group.append(text or "")
        held += len(group[-1])
        if held > 4_000_000:
            yield group
            group, held = [], 0
    if group:
        yield group


def features(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the features of every line and its neighbours, and the lines' lengths."""
    return [x for group in in_groups(texts) for x in group_features(group)]


def group_features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    split = [t.split("\n") for t in texts]
    counts = np.array(list(map(len, split)))
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "replace"), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]

    def count(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int64)

    run = np.zeros(len(data), bool)
    run[1:] = MARK[data[1:]] & (data[1:] == data[:-1])
    begins = run.copy()
    begins[1:] &= ~run[:-1]
    size = count(FIRST[data]) - 1  # without the line's end
    # a capital of two bytes has 0xC3 first and then 0x80 to 0x9E
    capital = UPPER[data]
    capital[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)
    words, different, again = np.array([word_shares(line) for lines in split for line in lines], float).T
    repeated = np.zeros(len(starts))
    at = 0
    for lines in split:
        seen: set[str] = set()
        for k, line in enumerate(lines, at):
            if line in seen:
                repeated[k] = bool(line)
            seen.add(line)
        at += len(lines)
    n, chars = np.maximum(1, words), np.maximum(1, size)
    last, first = data[np.maximum(ends - 1, starts)], data[starts]
    own = np.stack(
        [
            np.minimum(1, np.log1p(size) / 8),
            np.minimum(1, np.log1p(words) / 7),
            count(capital) / np.maximum(1, count(LETTER[data])),
            np.minimum(1, 4 * count(DIGIT[data]) / chars),
            np.minimum(1, 4 * count(SYMBOL[data]) / chars),
            np.minimum(1, count(begins) / n),
            np.minimum(1, 3 * count(data == 124) / n),
            different / n,
            again / n,
            np.minimum(1, size / n / 16),
            repeated,
            CLOSING[last].astype(float),
            capital[starts].astype(float) * (first != 10),
            (words == 0).astype(float),
        ],
        1,
    )
    tops = np.r_[0, np.cumsum(counts)]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[tops[:-1]] = 0
    after[tops[1:] - 1] = 0
    edge = np.zeros((len(own), 2))
    edge[:, 0] = 1
    edge[tops[:-1], 1] = 1
    x, chars = np.hstack([own, before, after, edge]), chars.astype(float)
    return [(x[a:b], chars[a:b]) for a, b in zip(tops[:-1], tops[1:])]


def padded(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as one array, and a mask of the places that are filled."""
    longest = max(map(len, items))
    out = np.zeros((len(items), longest, *items[0].shape[1:]))
    mask = np.zeros((len(items), longest), bool)
    for k, x in enumerate(items):
        out[k, : len(x)] = x
        mask[k, : len(x)] = True
    return out, mask


def forward_backward(node: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1, pair marginals summed by sequence, and log partition of every padded sequence.

    ``node`` has the score of state 1 against state 0 of each place.
    """
    n, t = node.shape
    score = np.stack([np.zeros_like(node), node], 2)
    alpha, beta = np.empty((n, t, 2)), np.zeros((n, t, 2))
    alpha[:, 0] = score[:, 0]
    for i in range(1, t):
        m = alpha[:, i - 1, :, None] + trans
        alpha[:, i] = np.where(mask[:, i, None], np.logaddexp(m[:, 0], m[:, 1]) + score[:, i], alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        m = trans + (score[:, i + 1] + beta[:, i + 1])[:, None, :]
        beta[:, i] = np.where(mask[:, i + 1, None], np.logaddexp(m[:, :, 0], m[:, :, 1]), 0)
    log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    # a padded place copies the alpha of the last one, so marginals there are not used
    marginal = np.exp(np.minimum(0, alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None]))
    pairs = np.zeros((n, 2, 2))
    if t > 1:
        p = alpha[:, :-1, :, None] + trans + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - log_z[:, None, None, None]
        pairs = (np.exp(np.minimum(0, p)) * mask[:, 1:, None, None]).sum(1)
    return marginal, pairs, log_z


def fit_field(sequences: list[np.ndarray], labels: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the line features and of the transitions, by Adam on the penalised likelihood."""
    x, mask = padded(sequences)
    y = labels.astype(float)
    n = len(y)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # both classes alike
    w, trans = np.zeros(x.shape[2]), np.zeros((2, 2))
    lengths = mask.sum(1)
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    flat = x[mask]
    scale = weight / lengths  # every chain counts alike
    for step in range(1, rounds + 1):
        node = np.zeros(mask.shape)
        node[mask] = flat @ w
        marginal, pairs, _ = forward_backward(node, mask, trans)
        gap = ((y[:, None] - marginal) * scale[:, None])[mask]
        g = flat.T @ gap - ridge * w
        eps_pairs = np.zeros((2, 2))
        for state in (0, 1):  # weighted pair counts, class by class
            own = y == state
            if own.any():
                observed = np.zeros((2, 2))
                observed[state, state] = max(0, (lengths[own] - 1).sum())
                eps_pairs += (observed - pairs[own].sum(0)) * (0.5 / max(1, lengths[own].sum()))
        g = np.r_[g, (eps_pairs - 0.02 * trans).ravel()]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
        w, trans = w + move[:-4], trans + move[-4:].reshape(2, 2)
    return w, trans


def chains(x: np.ndarray) -> list[np.ndarray]:
    """All lines of a text, as chains of like length."""
    return np.array_split(x, -(-len(x) // CHAIN))


def averages(texts: list, w: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginals as log odds."""
    out = np.empty(len(texts))
    made = [(x @ w, size) for group in in_groups(texts) for x, size in group_features(group)]
    order = np.argsort([len(x) for x, _ in made], kind="stable")
    at = 0
    while at < len(order):  # sequences of like length together, a bounded number of places at a time
        most = len(made[order[at]][0])
        end = at + 1
        while end < len(order) and len(made[order[end]][0]) <= max(8, 2 * most) and (end - at) * len(made[order[end]][0]) < 100_000:
            end += 1
        own = order[at:end]
        node, mask = padded([made[k][0] for k in own])
        marginal, _, _ = forward_backward(node, mask, trans)
        for r, k in enumerate(own):
            size = made[k][1]
            p = np.clip(marginal[r, : len(size)] @ size / size.sum(), 1e-6, 1 - 1e-6)
            out[k] = np.log(p / (1 - p))
        at = end
    return out


class QualityModel:
    def __init__(self, w: np.ndarray | None, trans: np.ndarray | None, threshold: float = 0.0, slope: float = 1.0):
        self.w, self.trans, self.threshold, self.slope = w, trans, threshold, slope

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
        rows = labelled(docs, labels, label)
        sample = sampled(docs, labels, label, TRAIN_DOCS, TRAIN_LINES)

        def work(texts: list) -> tuple[list]:
            return ([x.astype(np.float32).ravel().tolist() for x, _ in features(texts)],)

        got = [(np.array(r["x"]).reshape(-1, FEATURES), r["label"] > 0) for r in worked(sample, ["text"], {"x": "array<double>"}, lambda: work).toLocalIterator()]
        y = np.array([label for x, label in got for _ in chains(x)])
        if y.all() or not y.any():  # also without rows
            return cls(None, None)
        w, trans = fit_field([c for x, _ in got for c in chains(x)], y)
        model = cls(w, trans)
        counts = histogram(model.averaged(rows.where("fold = 4").select("text", "label")), LOW, HIGH)
        if counts.sum(0).all():
            model.threshold, model.slope = cut(counts, LOW, HIGH)
        return model

    def averaged(self, df: DataFrame, text: str = "text", drop: list[str] | None = None) -> DataFrame:
        """``df`` with ``s``, the log odds of the averaged marginals, and without its text unless ``drop`` is empty."""
        w, trans = self.w, self.trans

        def setup() -> Callable:
            return lambda texts: (averages(texts, w, trans),)

        return worked(df, [text], {"s": "double"}, setup, drop)

    def score(self) -> Column:
        """A probability that is ``CUT`` at the threshold."""
        at_cut = float(np.log(CUT / (1 - CUT)))
        return 1 / (1 + F.exp(-(self.slope * (F.col("s") - self.threshold) + at_cut)))

    def scored(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """``(key, held_out, score, predicted)`` of every row."""
        rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
        found = rows.withColumn("score", F.lit(1.0)) if self.w is None else self.averaged(rows).withColumn("score", self.score())
        return found.select(F.col("key").alias(key), (fold(F.col("key")) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

    def kept(self, df: DataFrame, text: str = "text") -> DataFrame:
        """The rows of ``df`` that are good enough, with their columns as they were."""
        if self.w is None:
            return df
        names = [f"c{i}" for i in range(len(df.columns))]
        found = self.averaged(df.toDF(*names), names[df.columns.index(text)], drop=[])
        return found.where(F.col("s") >= self.threshold).select(*names).toDF(*df.columns)
