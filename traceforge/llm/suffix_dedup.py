"""Removal of repeated byte strings by suffixes, in blocks, with a difference cover.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. The
suffixes that can tie over ``LENGTH`` bytes are found and named bucket by bucket:

1. Texts are cut where their content says so. A cut piece with the bytes of one suffix prefix behind it is one
   key; of equal pieces only one, of the smallest id, goes on (so copies cost a key a piece, not a key a byte).
2. Cover sample: of two suffixes, some offset under ``COVER`` leads both to positions of the difference cover.
   The strings of ``LENGTH - COVER + 1`` bytes at cover positions are ranked once: alone, or shared.
3. A suffix none of whose cover samples is shared ties with nothing and needs no sort. The others, a few in a
   hundred, are named by 96 bits of two hashes, and each name's smallest id decides.

Keys of every step fall into buckets by their leading bits, whose number follows from the number of keys, so that
one task sorts one bucket of bounded size. A key occurs at most once for each block of texts. Blocks are written
once; what a bucket decides comes back as bits for each block.

Cases: a null text is empty; a null id is larger than all ids; documents of one id do not remove each other's bytes,
so repeated rows are treated alike; texts of any length are hashed in stretches; an empty table gives an empty
result; columns beside the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceforge.llm.shared import stored

LENGTH = 50
#: A perfect difference set: every difference modulo 13 is one of two members.
COVER, MEMBERS = 13, (0, 1, 3, 9)
#: A piece ends on average after so many bytes, told by the eight bytes before its end.
PIECE, MARK = 64, 8
#: Bytes of text in a block (more only if one text is longer), hashed at a time, and keys in a bucket.
BLOCK_BYTES, STRETCH, BUCKET_KEYS = 1 << 21, 1 << 19, 1 << 21
NO_ID = np.iinfo(np.int64).max

ONE = np.uint64(1)
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of a product's upper half reaches the leading bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Polynomial hashes modulo 2**64 of a text's substrings, from prefix sums over stretches of it."""

    def __init__(self, which: int):
        base = ODD[which]
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        self.up, self.down = powers(base, STRETCH + LENGTH), powers(pow(base, -1, 1 << 64), STRETCH + LENGTH)

    def sums(self, stretch: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[stretch] * self.up[: len(stretch)])])


@lru_cache
def hasher(which: int) -> Hasher:
    return Hasher(which)


def digests(body: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each piece, as two arrays."""
    view = memoryview(body)
    raw = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts.tolist(), stops.tolist())])
    both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Block:
    """Texts of one block end to end: whose they are, where they start, and how they are cut into pieces."""

    def __init__(self, ids: bytes, sizes: bytes, body: bytes):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.body = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
        self.stops = np.cumsum(self.sizes)
        self.known: dict[tuple[int, int], np.ndarray] = {}

    def sums(self, which: int, start: int) -> np.ndarray:
        """Prefix sums of the stretch from ``start`` on, kept while the block is of the usual size."""
        if (which, start) in self.known:
            return self.known[which, start]
        found = hasher(which).sums(self.body[start : start + STRETCH + LENGTH - 1])
        if len(self.body) <= 2 * BLOCK_BYTES:
            self.known[which, start] = found
        return found

    def hashes(self, which: int, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """The hash of the ``length`` bytes from each position ``at`` on, or from every position."""
        n, down = max(0, len(self.body) - length + 1), hasher(which).down
        out = np.empty(n if at is None else len(at), np.uint64)
        for s in range(0, n, STRETCH):
            sums, m = self.sums(which, s), min(STRETCH, n - s)
            if at is None:
                out[s : s + m] = (sums[length : length + m] - sums[:m]) * down[:m]
            else:
                own = np.flatnonzero((at >= s) & (at < s + STRETCH)) if n > STRETCH else slice(None)
                p = at[own] - s
                out[own] = (sums[p + length] - sums[p]) * down[p]
        return mixed(out)

    def cut(self) -> None:
        """Pieces ``starts`` to ``ends`` with the document of each, ``reach``: up to where their suffixes' prefixes go, and
        ``stop``: where their suffixes with a whole prefix stop."""
        ends = np.flatnonzero(self.hashes(0, MARK) % np.uint64(PIECE) == 0) + MARK
        filled = self.sizes > 0
        cuts = np.unique(np.concatenate([ends[ends < len(self.body)], (self.stops - self.sizes)[filled]]))
        self.starts, self.ends = cuts, np.append(cuts[1:], len(self.body))[: len(cuts)]
        self.doc = np.flatnonzero(filled)[np.searchsorted(self.stops[filled], self.starts, side="right")]
        self.reach = np.minimum(self.ends + LENGTH - 1, self.stops[self.doc])
        self.stop = np.maximum(self.starts, self.reach - LENGTH + 1)

    def piece_keys(self) -> tuple[np.ndarray, ...]:
        """``(key, key2, owner, row)``: every piece with its digest."""
        self.cut()
        key, key2 = digests(self.body, self.starts, self.reach)
        return key >> ONE, key2 >> ONE, self.ids[self.doc], np.arange(len(key))

    def sample_keys(self, kept: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
        """Every cover sample of the pieces ``kept``, by the leading ``bits`` of its hash; ``at`` and ``of`` say where and whose it is."""
        size, lengths = LENGTH - COVER + 1, (self.reach - self.starts)[kept]
        offsets = np.flatnonzero(np.isin(np.arange(COVER), MEMBERS)[np.arange(lengths.max(initial=0)) % COVER])
        counts = np.searchsorted(offsets, lengths - size, side="right")
        nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        self.of = np.repeat(kept, counts)
        self.at = self.starts[self.of] + offsets[nth]
        return self.hashes(0, size, self.at) >> np.uint64(64 - bits), np.zeros(len(nth), np.uint64), self.ids[self.doc[self.of]], np.arange(len(nth))

    def suffix_keys(self, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """Suffixes, by position, with a shared cover sample among their first positions; ``shared`` are rows of :meth:`sample_keys`."""
        at, of = self.at[shared], self.of[shared]
        low, high = np.maximum(self.starts[of], at - COVER + 1), np.minimum(at + 1, self.stop[of])
        on = np.zeros(len(self.body) + 1, np.int32)
        np.add.at(on, low[low < high], 1)
        np.add.at(on, high[low < high], -1)
        rows = np.flatnonzero(np.cumsum(on)[:-1] > 0)
        owner = self.ids[self.doc[np.searchsorted(self.starts, rows, side="right") - 1]]
        return self.hashes(0, LENGTH, rows) >> ONE, self.hashes(1, LENGTH, rows) >> np.uint64(32), owner, rows


def planes(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unplaned(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<i8").ravel()


def changes(key: np.ndarray, key2: np.ndarray) -> np.ndarray:
    """Whether a sorted row's key differs from that of the row before."""
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])
    return fresh


class Keys:
    """A block's different keys in order, each with its smallest owner and the first ``row`` that has it.

    ``plain`` keys (one hash, owners told apart only in the block) are sent without their owners.
    """

    def __init__(self, key: np.ndarray, key2: np.ndarray, owner: np.ndarray, rows: np.ndarray, plain: bool = False):
        order = np.argsort(key) if plain else np.lexsort((owner, key2, key))
        fresh = changes(key[order], key2[order])
        start = np.flatnonzero(fresh)
        self.group = np.empty(len(key), np.int64)
        self.group[order] = np.cumsum(fresh) - 1
        self.head, self.rows, self.owner, self.plain = order[start], rows, owner, plain
        self.key, self.key2, self.least = key[self.head].astype(np.int64), key2[self.head].astype(np.int64), owner[self.head]
        self.two = np.maximum.reduceat(owner[order], start) != np.minimum.reduceat(owner[order], start) if len(key) else np.zeros(0, bool)

    def sent(self, block: int, bits: int, buckets: int) -> pd.DataFrame:
        """The keys packed for every bucket, by their leading bits."""
        bucket = (self.key / 2.0**bits * buckets).astype(np.int64)
        rows = []
        for b in np.unique(bucket):
            s, e = np.searchsorted(bucket, [b, b + 1])
            key2 = whose = names = b""
            if not self.plain:
                owners, at = np.unique(self.least[s:e], return_inverse=True)
                key2, whose, names = planes(self.key2[s:e]), planes(at), planes(np.diff(owners, prepend=0))
            rows.append((int(b), block, e - s, planes(np.diff(self.key[s:e], prepend=0)), key2, np.packbits(self.two[s:e]).tobytes(), whose, names))
        return pd.DataFrame(rows, columns=["bucket", "block", "n", "keys", "keys2", "two", "whose", "names"])

    def told(self, found: list) -> tuple[np.ndarray, np.ndarray]:
        """``(shared, least)`` of every row by what the buckets decided; plain keys have no ``least``."""
        found = sorted(found, key=lambda r: r["bucket"])
        shared = [np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=r["n"]) for r in found]
        gaps = [np.zeros(r["n"], np.int64) if self.plain else unplaned(r["gap"]) for r in found]
        least = self.least - np.concatenate([np.zeros(0, np.int64), *gaps])
        return np.concatenate([np.zeros(0, np.uint8), *shared]).astype(bool)[self.group], least[self.group]


SENT = "bucket long, block long, n long, keys binary, keys2 binary, two binary, whose binary, names binary"
DECIDED = "block long, bucket long, n long, shared binary, gap binary"


def decided(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """One bucket, sorted: for each block's keys whether owners differ, and how far its owner is above the smallest.

    Plain keys of two blocks count as of two owners.
    """
    k = np.concatenate([np.cumsum(unplaned(x)) for x in part["keys"]])
    two = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(part["two"], part["n"])])
    plain = not part["names"].iloc[0]
    if plain:
        order, k2 = np.argsort(k), np.zeros(len(k), np.int8)
    else:
        k2 = np.concatenate([unplaned(x) for x in part["keys2"]])
        owner = np.concatenate([np.cumsum(unplaned(names))[unplaned(w)] for names, w in zip(part["names"], part["whose"])])
        order = np.lexsort((owner, k2, k))
    fresh = changes(k[order], k2[order])
    start = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    last = np.append(start[1:], len(k)) - 1
    differ = np.maximum.reduceat(two[order], start).astype(bool)
    shared, gap = np.empty(len(k), bool), np.empty(len(k), np.int64)
    if plain:
        differ |= last > start
    else:
        least = owner[order[start]]
        differ |= owner[order[last]] != least
        gap[order] = owner[order] - least[group]
    shared[order] = differ[group]
    ends = np.cumsum(part["n"].to_numpy())
    rows = [(b, key[0], n, np.packbits(shared[e - n : e]).tobytes(), b"" if plain else planes(gap[e - n : e])) for b, n, e in zip(part["block"], part["n"], ends)]
    return pd.DataFrame(rows, columns=["block", "bucket", "n", "shared", "gap"])


def packed(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(block, n_bytes, ids, sizes, body)``: the table's texts in compressed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, bodies, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block() -> pa.RecordBatch:
            sizes = np.array([len(b) for b in bodies], np.int64)
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))
            values = [(part << 32) + number, size, np.array(ids, np.int64).tobytes(), sizes.tobytes(), body]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["block", "n_bytes", "ids", "sizes", "body"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py() or b""
                if ids and size + len(t) > BLOCK_BYTES:
                    yield block()
                    number, ids, bodies, size = number + 1, [], [], 0
                ids.append(NO_ID if i is None else i)
                bodies.append(t)
                size += len(t)
        if ids:
            yield block()

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "block long, n_bytes long, ids binary, sizes binary, body binary")


def pieces_taken(block: Block, told: dict[int, list]) -> tuple[Keys, np.ndarray, np.ndarray]:
    """The block's pieces, the smallest id of each, and those that go on: whose id is the smallest, one of equal ones."""
    pieces = Keys(*block.piece_keys())
    least = pieces.told(told[0])[1]
    return pieces, least, np.sort(pieces.head[least[pieces.head] == pieces.least])


def keys_of(block: Block, step: int, told: dict[int, list], bits: int) -> Keys:
    """The keys of a step (0 pieces, 1 cover samples, 2 suffixes) from the answers to the steps before."""
    if not step:
        return Keys(*block.piece_keys())
    if step == 1:
        return Keys(*block.sample_keys(pieces_taken(block, told)[2], bits), plain=True)
    return suffixes(block, told, bits)[0]


def suffixes(block: Block, told: dict[int, list], bits: int) -> tuple[Keys, Keys, np.ndarray]:
    """Suffixes that may tie, the block's pieces, and the smallest id of each piece."""
    pieces, least, kept = pieces_taken(block, told)
    samples = Keys(*block.sample_keys(kept, bits), plain=True)
    return Keys(*block.suffix_keys(samples.rows[samples.told(told[1])[0]])), pieces, least


def gone(block: Block, told: dict[int, list], bits: int) -> np.ndarray:
    """Which bytes of the block go."""
    keys, pieces, least = suffixes(block, told, bits)
    owner = block.ids[block.doc]
    starts = np.zeros(len(block.body), bool)  # suffixes that start with what starts in a smaller id too
    starts[keys.rows[keys.told(told[2])[1] < keys.owner]] = True
    head = pieces.head[pieces.group]
    for k in np.flatnonzero((least == owner) & (head != np.arange(len(head)))):  # its equal of the same id went on for it
        starts[block.starts[k] : block.stop[k]] = starts[block.starts[head[k]] : block.stop[head[k]]]
    edge = np.zeros(len(block.body) + LENGTH + 1, np.int32)
    whole = np.flatnonzero((least < owner) & (block.starts < block.stop))
    edge[block.starts[whole]] += 1
    edge[block.stop[whole] + LENGTH - 1] -= 1
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + LENGTH] -= 1
    return np.cumsum(edge)[: len(block.body)] > 0


def told_of(rows: list | None) -> dict[int, list]:
    out: dict[int, list] = {0: [], 1: [], 2: []}
    for r in rows if rows is not None else ():
        out[r["step"]].append(r)
    return out


def with_answers(blocks: DataFrame, answers: DataFrame | None) -> DataFrame:
    if answers is None:
        return blocks.withColumn("told", F.lit(None).cast("array<struct<step:int,bucket:bigint,n:bigint,shared:binary,gap:binary>>"))
    told = answers.groupBy("block").agg(F.collect_list(F.struct("step", "bucket", "n", "shared", "gap")).alias("told"))
    return blocks.join(told, "block", "left")


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, spans, kept, kept_sha256)`` of every row.

    ``spans`` are the removed runs as packed pairs of offsets (little-endian longs), ``kept`` the remaining bytes.
    """
    blocks = stored(packed(df, key, text), "suffix-blocks")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(63, 12 + max(1, total).bit_length())  # few samples that are not equal meet by chance, whatever their number
    answers = None
    for step, (share, width) in enumerate([(1 / PIECE, 63), (len(MEMBERS) / COVER, bits), (1, 63)]):
        buckets = 1 + int(total * share) // BUCKET_KEYS

        def run(batches: Iterator[pd.DataFrame], step=step, width=width, buckets=buckets) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for name, ids, sizes, body, told in batch.itertuples(index=False):
                    yield keys_of(Block(ids, sizes, body), step, told_of(told), bits).sent(name, width, buckets)

        sent = with_answers(blocks, answers).select("block", "ids", "sizes", "body", "told").mapInPandas(run, SENT)
        made = stored(sent.groupBy("bucket").applyInPandas(decided, DECIDED).withColumn("step", F.lit(step)), "suffix-answers")
        answers = made if answers is None else answers.unionByName(made)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, sizes, body, told in batch.itertuples(index=False):
                block = Block(ids, sizes, body)
                out, start = gone(block, told_of(told), bits), 0
                rows = []
                for i, size in zip(block.ids.tolist(), block.sizes.tolist()):
                    own, text = out[start : start + size], block.body[start : start + size]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    kept = text[~own].tobytes()
                    rows.append((None if i == NO_ID else i, size, int(own.sum()), len(edges) // 2, edges.astype("<i8").tobytes(), kept, hashlib.sha256(kept).hexdigest()))
                    start += size
                ids_of = pd.array([r[0] for r in rows], dtype="Int64")
                yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"]).assign(id=ids_of)

    spec = "id long, n_bytes long, n_removed long, n_spans long, spans binary, kept binary, kept_sha256 string"
    out = with_answers(blocks, answers).select("ids", "sizes", "body", "told").mapInPandas(cut, spec)
    return out.select(F.col("id").alias(key), "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")
