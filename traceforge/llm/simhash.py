"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit for each of 64 positions: 1 where over half of the text's word-shingle hashes have
it set. Distinct fingerprints are sorted by population count and dealt into tiles of bounded size. Two
fingerprints that differ in at most r bits have population counts that differ by at most r, so tile pairs
whose counts lie further apart are skipped; inside a pair the same bound holds for the counts of the
four quarters of the bits together, and what is left is compared by exclusive-or and bit counts. A tile pair
gives back a spanning forest of its links, never the pairs, so a large group of near copies stays linear; the
work of the comparison itself grows with the square of the distinct fingerprints.

``near_duplicates`` has fingerprints of 64 bits. ``groups_of`` has wider ones, for a similarity that is to be
met with few misses: a bit differs as often as the angle between two texts' shingle vectors says, and the
spread of the share falls with the number of bits. At 512 bits ``WIDE_RADIUS`` finds nearly all texts that share
0.8 of their shingles of five words and unrelated ones stay far away (the README has figures). Wide fingerprints
link at ``WIDE_RADIUS`` bits of all, of which ``SIFT`` at most among the first 128. These links are candidates: those
whose shingle sets are less alike than ``SIMILAR`` are dropped (``checked_groups``), so a group never rests on one.

Cases: null, empty and blank texts have fingerprint zero and link like any other; fewer words than a
shingle hash as one sequence; repeated rows and equal fingerprints collapse before the comparison; rows
with a null id carry a fingerprint and component but are never a component's name unless nothing else is
in it; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceforge.llm.shared import components, hooked, stored, worked

#: Fingerprints in one tile, and pairs that are compared, or held, at a time.
TILE = 32_768
STEP = 4_000_000
#: Words of 64 bits of a wide fingerprint, the bits that may differ, and how many of them in the first two words.
WIDE_WORDS, WIDE_RADIUS, SIFT = 8, 90, 34
#: Least Jaccard similarity of the texts that ``groups_of`` links (4/5), and bytes of text in one block of its check.
SIMILAR = (4, 5)
BLOCK = 4_000_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def wide_fingerprint(text: str | None, width: int = 4, seed: int = 42, words: int = 1) -> np.ndarray:
    """``words`` times 64 bits: the first from the shingles' hashes, the others from those mixed again."""
    own = WORD.findall((text or "").encode("utf-8").lower())
    if not own:
        return np.zeros(words, "<u8")
    n = max(1, len(own) - width + 1)
    digest = xxhash.xxh64_intdigest
    total, most = np.zeros(64 * words, np.int64), 65_536 // words
    for at in range(0, n, most):
        part = [b" ".join(own[k : k + width]) for k in range(at, min(n, at + most))]
        h = np.fromiter((digest(s, seed) for s in part), "<u8", len(part))
        bits = np.stack([h, *(mixed(h + np.uint64(k)) for k in range(1, words))], 1)
        total += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * total > n, bitorder="little").view("<u8")


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes turned into others by the finishing steps of a 64-bit mixer (fixed values)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    return int(wide_fingerprint(text, width, seed)[0])


def fingerprinted(df: DataFrame, text: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """``df`` without its text, with a signed 64-bit ``fp``."""

    def work(texts: list) -> tuple[np.ndarray]:
        return (np.fromiter((fingerprint(t, width, seed) for t in texts), np.uint64, len(texts)).view(np.int64),)

    return worked(df, [text], {"fp": "long"}, lambda: work)


Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Pairs:
    """Indices of all pairs of 64-bit fingerprints at most ``radius`` bits apart, a bounded number at a time.

    Both sides are cut into cells of equal counts in the four quarters of the bits. Cells whose counts differ
    by more than the radius in sum hold no pair. Each cell of ``a`` meets its surviving cells in one numpy call.
    """

    def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)  # the counts of the four quarters
        key = ((q[:, 0] * 17 + q[:, 1]) * 17 + q[:, 2]) * 17 + q[:, 3].astype(np.int32)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        return order, np.r_[starts, len(x)], q[order[starts]]

    if not len(a) or not len(b):
        return
    (oa, sa, qa), (ob, sb, qb) = cells(a), cells(b)
    xa, xb = a[oa], b[ob]
    for i, q in enumerate(qa):
        near = np.flatnonzero(np.abs(qb - q).sum(1) <= radius)
        if not len(near):
            continue
        lengths = sb[near + 1] - sb[near]
        at = np.repeat(sb[near] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        other = xb[at]
        step = max(1, STEP // len(other))
        for s in range(sa[i], sa[i + 1], step):
            e = min(sa[i + 1], s + step)
            r, c = np.nonzero(np.bitwise_count(xa[s:e, None] ^ other[None]) <= radius)
            if len(r):
                yield oa[s + r], ob[at[c]]


def close_wide_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Pairs:
    """The same for fingerprints of several words, one row each: two words sift, the others decide."""
    step = max(1, STEP // 8 // max(1, len(b)))  # few enough to stay in a processor's cache
    first, second = np.ascontiguousarray(b[:, 0]), np.ascontiguousarray(b[:, 1])
    for s in range(0, len(a), step):
        part = a[s : s + step]
        apart = np.bitwise_count(part[:, :1] ^ first) + np.bitwise_count(part[:, 1:2] ^ second)
        r, c = np.nonzero(apart <= SIFT)
        if len(r):
            rest = np.bitwise_count(part[r, 2:] ^ b[c, 2:]).sum(1, dtype=np.int64) + apart[r, c]
            on = rest <= radius
            yield s + r[on], c[on]


def forest(pairs: Pairs, root: np.ndarray, shift: int) -> np.ndarray:
    """``root`` with the sets of all pairs joined; the right side's indices begin at ``shift``."""
    left, right, held = [], [], 0
    for a, b in pairs:
        left.append(a)
        right.append(b + shift)
        held += len(a)
        if held > STEP:
            root = hooked(root, np.concatenate(left), np.concatenate(right))
            left, right, held = [], [], 0
    return hooked(root, np.concatenate(left), np.concatenate(right)) if held else root


def packed(fps: list) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints as numbers, and the nodes that stand for them: 64 bits themselves, wider ones by their hash."""
    if isinstance(fps[0], bytes):
        nodes = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in fps), np.uint64, len(fps)).view(np.int64)
        return np.frombuffer(b"".join(fps), "<u8").reshape(len(fps), -1), nodes
    nodes = np.asarray(fps, np.int64)
    return nodes.view(np.uint64), nodes


def tile_links(counted: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct fingerprints ``(fp, ones)`` exactly as all pairs within ``radius``
    do. Wider ones than 64 bits are binary, and linked by Spark's ``xxhash64`` of them."""
    spark = counted.sparkSession
    sizes = {r["ones"]: r["n"] for r in counted.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    runs, of, n = [[]], {}, 0  # runs of counts that make one tile, or one count that makes several
    for ones in sorted(sizes):
        if runs[-1] and n + sizes[ones] > tile:
            runs.append([])
            n = 0
        runs[-1].append(ones)
        n += sizes[ones]
    runs = [r for r in runs if r]
    first, parts = [], []
    for r in runs:
        first.append(sum(parts))
        parts.append(max(1, -(-sum(sizes[o] for o in r) // tile)))
        of |= {o: (first[-1], parts[-1]) for o in r}
    if not of:
        return spark.createDataFrame([], "a long, b long")
    lookup = F.create_map(*[F.lit(x) for o, (f, p) in of.items() for x in (o, F.struct(F.lit(f).alias("f"), F.lit(p).alias("p")))])
    tiled = counted.withColumn("t", lookup[F.col("ones")]).select("fp", (F.col("t.f") + F.pmod(F.xxhash64("fp"), F.col("t.p"))).cast("int").alias("tile"))
    blobs = stored(tiled.groupBy("tile").agg(F.collect_list("fp").alias("fps")), "tiles")  # at most about TILE numbers each
    total = sum(parts)
    span = [(runs[k][0], runs[k][-1]) for k, p in enumerate(parts) for _ in range(p)]
    # tiles stand in the order of their counts, so the partners of a tile are it and the next ones within the radius
    last = [bisect_right([low for low, _ in span], high + radius) - 1 for _, high in span]
    ranges = spark.createDataFrame(list(enumerate(last)), "tile int, last int")
    partners = ranges.select("tile", F.explode(F.sequence("tile", "last")).alias("tile2"))
    pairs = partners.repartition(max(1, min(4096, sum(j - i + 1 for i, j in enumerate(last)))), "tile", "tile2")
    met = pairs.join(blobs, "tile").join(blobs.select(F.col("tile").alias("tile2"), F.col("fps").alias("fps2")), "tile2").select("tile", "tile2", "fps", "fps2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, t2, fps, fps2 in batch.itertuples(index=False):
                x, nodes = packed(fps)
                y, every = (x, nodes) if t == t2 else packed(fps2)
                every = nodes if t == t2 else np.r_[nodes, every]
                close = close_pairs if x.ndim == 1 else close_wide_pairs
                root = forest(close(x, y, radius), np.arange(len(every)), 0 if t == t2 else len(x))
                on = np.flatnonzero(root != np.arange(len(every)))
                yield pd.DataFrame({"a": every[on], "b": every[root[on]]})

    return met.mapInPandas(run, "a long, b long")


def shingle_set(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending."""
    own = WORD.findall((text or "").encode("utf-8").lower())
    n = max(1, len(own) - width + 1) if own else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(own[k : k + width]), seed) for k in range(n)), "<u8", n))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of ``SIMILAR`` or more, in whole numbers; two empty sets are alike."""
    top, whole = SIMILAR
    low, high = sorted((len(a), len(b)))
    if whole * low < top * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return whole * both >= top * (low + high - both)


def exact_links(x: list[dict], y: list[dict] | None, radius: int, one: bool) -> list[tuple]:
    """Names of alike texts among ``x``, and between ``x`` and ``y``, that join what was not joined yet.

    Rows have ``name``, ``fp`` and ``shingles``. All of ``y`` is one group already where ``one`` is set.
    """
    rows = x + (y or [])
    sets = [np.frombuffer(r["shingles"], "<u8") for r in rows]
    fps = np.frombuffer(b"".join(r["fp"] for r in rows), "<u8").reshape(len(rows), -1)
    root = np.arange(len(rows))
    if one:
        root[len(x) :] = len(x)
    found = []
    shift = len(x) if y else 0
    for left, right in close_wide_pairs(fps[: len(x)], fps[shift:], radius):
        right = right + shift
        apart = root[left] != root[right]
        for a, b in zip(left[apart].tolist(), right[apart].tolist()):
            if root[a] != root[b] and alike(sets[a], sets[b]):
                found.append((rows[a]["name"], rows[b]["name"]))
                root[root == root[b]] = root[a]
    return found


def checked_groups(found: DataFrame, texts: DataFrame, radius: int, width: int, seed: int) -> DataFrame:
    """``(name, group)`` of the groups that links of exact similarity leave of the candidate groups in ``found``.

    ``found`` has ``(name, fp, size, group)``, one row a name (a string), ``texts`` ``(name, text)`` with repeats. Every member is
    compared with its group's smallest name first; members that are not like it are then compared with each other and
    with those that are, in blocks of about ``BLOCK`` bytes of text. Tasks give back links that join, never all pairs.
    """
    sums = found.groupBy("group").agg(F.count("*").alias("members"), F.min("name").alias("hub"), F.sum("size").alias("size"))
    several = sums.where("members > 1").withColumn("salts", F.greatest(F.ceil(F.col("size") / BLOCK), F.lit(1))).drop("size")
    several = stored(several, "candidate-groups")
    members = found.join(several, "group").withColumn("salt", F.pmod(F.xxhash64("name"), "salts"))
    own = texts.join(members, "name").groupBy("name").agg(F.first("text").alias("text"), *[F.first(c).alias(c) for c in ("group", "hub", "members", "size", "salt", "salts", "fp")])
    sets = stored(worked(own, ["text"], {"shingles": "binary"}, lambda: lambda t: ([shingle_set(x, width, seed).tobytes() for x in t],)), "shingle-sets")

    hubs = sets.where("name = hub").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("fp").alias("hub_fp"), F.col("shingles").alias("hub_set"))

    def near_hub(fps: list, shingles: list, hub_fps: list, hub_sets: list) -> tuple[list]:
        def one(f: bytes, s: bytes, g: bytes, t: bytes) -> bool:
            f, s, g, t = (np.frombuffer(v, "<u8") for v in (f, s, g, t))
            return any(len(r) for r, _ in close_wide_pairs(f[None], g[None], radius)) and alike(s, t)

        return ([int(one(*row)) for row in zip(fps, shingles, hub_fps, hub_sets)],)

    met = worked(sets.join(hubs, ["group", "salt"]), ["fp", "shingles", "hub_fp", "hub_set"], {"on": "int"}, lambda: near_hub, drop=["hub_fp", "hub_set"])
    marked = stored(met, "hub-links")

    # only groups of three and more with members that are unlike the hub need blocks
    rest = marked.groupBy("group", "members").agg(F.sum(1 - F.col("on")).alias("open"), *[F.greatest(F.ceil(F.sum(F.when(F.col("on") == s, F.col("size")).otherwise(0)) / BLOCK), F.lit(1)).alias(f"k{s}") for s in (0, 1)])
    rest = stored(rest.where("open > 0 and members > 2").drop("members"), "open-groups")
    dealt = marked.join(rest, "group").withColumn("block", F.pmod(F.xxhash64("name"), F.when(F.col("on") == 1, F.col("k1")).otherwise(F.col("k0"))))
    blobs = stored(dealt.groupBy("group", "on", "block").agg(F.collect_list(F.struct("name", "fp", "shingles")).alias("rows")), "shingle-blocks")
    zero = F.lit(0).cast("long")
    first = rest.withColumn("block", F.explode(F.sequence(zero, F.col("k0") - 1)))
    other = F.concat(
        F.transform(F.sequence(F.col("block"), F.col("k0") - 1), lambda b: F.struct(F.lit(0).alias("on2"), b.alias("block2"))),
        F.transform(F.sequence(zero, F.col("k1") - 1), lambda b: F.struct(F.lit(1).alias("on2"), b.alias("block2"))),
    )
    pairs = first.select("group", "block", F.explode(other).alias("o")).select("group", "block", "o.*")
    left = blobs.where("on = 0").drop("on")
    right = blobs.select("group", F.col("on").alias("on2"), F.col("block").alias("block2"), F.col("rows").alias("rows2"))
    both = pairs.join(left, ["group", "block"]).join(right, ["group", "on2", "block2"]).select("block", "block2", "on2", "rows", "rows2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, block2, on, x, y = (batch.column(c)[k].as_py() for c in range(5))
                links = exact_links(x, None if on == 0 and block == block2 else y, radius, on == 1)
                yield pa.RecordBatch.from_arrays([pa.array([p[s] for p in links], pa.string()) for s in (0, 1)], ["a", "b"])

    links = both.mapInArrow(run, "a string, b string").unionByName(marked.where("on = 1 and name != hub").select(F.col("name").alias("a"), F.col("hub").alias("b")))
    return components(links).select(F.col("node").alias("name"), F.col("component").alias("group"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """``(key, fp, fingerprint, component_id)`` for every row: equal component, equal group."""
    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = stored(fingerprinted(own, "text", width, seed), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("key").alias("least"))
    counted = stored(prints.select("fp", F.bit_count("fp").alias("ones")), "prints")
    groups = components(tile_links(counted, radius)).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    named = stored(prints.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp")), "groups")
    # written, so that both sides of the join below are plain shuffles, which Spark splits where a group is large
    least = stored(named.groupBy("group").agg(F.min("least").alias("component_id")), "group-names")
    by_print = named.select("fp", "group").join(least, "group").select("fp", "component_id")
    return rows.join(by_print, "fp").select(F.col("key").alias(key), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def groups_of(df: DataFrame, name: str, text: str = "text", radius: int = WIDE_RADIUS, width: int = 5, seed: int = 42, words: int = WIDE_WORDS) -> DataFrame:
    """``(name, group)``, one row for each distinct name (a string): rows of equal names hold equal texts. Texts link
    where their fingerprints do and their sets of shingles have a similarity of ``SIMILAR``; linked ones share a group."""

    def work(texts: list) -> tuple[list, list]:
        made = [wide_fingerprint(t, width, seed, words) for t in texts]
        return [x.tobytes() for x in made], [int(np.bitwise_count(x).sum()) for x in made]

    own = df.select(F.col(name).alias("name"), F.col(text).alias("text"))
    sized = own.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    rows = stored(worked(sized, ["text"], {"fp": "binary", "ones": "int"}, lambda: work).distinct(), "wide-fingerprints")
    counted = stored(rows.select("fp", "ones").distinct(), "prints")
    groups = components(tile_links(counted, radius)).select(F.col("node").alias("at"), F.col("component").alias("group"))
    found = rows.withColumn("at", F.xxhash64("fp")).join(groups, "at", "left")
    found = stored(found.select("name", "fp", "size", F.coalesce("group", "at").alias("group")), "candidates")
    exact = checked_groups(found, own, radius, width, seed)
    return found.select("name").join(exact, "name", "left").select(F.col("name").alias(name), F.coalesce("group", "name").alias("group"))
