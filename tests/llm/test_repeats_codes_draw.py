"""Suffix dedup, vector codes and the weighted draw against brute force, and the mended cases of older operators."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from traceforge.llm import bpe, chat, code_compression, html_extract, queries, resampling, sharding, suffix_dedup

SF = "/root/testdata/sf0.001"
LENGTH = 50


def slow_repeats(rows):
    """Every string of fifty bytes with the smallest id it starts in, then the bytes that are covered."""
    least, bodies = {}, [(suffix_dedup.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in bodies:
        for p in range(len(b) - LENGTH + 1):
            s = b[p : p + LENGTH]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - LENGTH + 1):
            if least[b[p : p + LENGTH]] < i:
                gone[p : p + LENGTH] = b"\1" * LENGTH
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((None if i == suffix_dedup.NO_ID else i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found_repeats(df):
    return sorted((tuple(r) for r in suffix_dedup.without_repeats(df).drop("spans", "kept").collect()), key=str)


@pytest.mark.parametrize("block", [3000, 1 << 21])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghij klmnop") for _ in range(400)) for _ in range(6)]
    rows = []
    for _ in range(100):
        a = rng.randrange(300)
        noise = ["".join(rng.choice("xyzé 123") for _ in range(rng.randrange(60))) for _ in range(2)]
        rows.append((rng.choice([None, *range(50)]), noise[0] + rng.choice(base)[a : a + rng.randrange(30, 200)] + noise[1]))
    rows += [(500 + k, "a" * k) for k in (0, 10, 49, 50, 51, 120, 3000)] + [(600, None), (601, ""), (700, "é" * 200), (701, "xé" * 200)]
    rows += [(602, base[0]), (602, base[0]), (603, base[0]), (5, base[0] * 3), (5, base[0] * 3)]  # repeated rows, one id with equal stretches
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int").repartition(5)
    assert found_repeats(df) == slow_repeats(rows)


def test_suffix_dedup_of_a_table_and_of_none(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op11_suffix_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_repeats([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert found_repeats(docs.limit(0)) == []


def test_suffix_dedup_gives_spans_and_bytes(spark):
    body = "".join(random.Random(1).choice("abcdef") for _ in range(120))
    r = suffix_dedup.without_repeats(spark.createDataFrame([(1, body), (2, "<<" + body[:60] + ">>")], "doc_id long, text string")).where("doc_id = 2").first()
    assert bytes(r["kept"]) == b"<<>>" and np.frombuffer(r["spans"], "<i8").tolist() == [2, 62]


def test_a_difference_cover_has_every_difference():
    gaps = {(a - b) % suffix_dedup.COVER for a in suffix_dedup.MEMBERS for b in suffix_dedup.MEMBERS}
    assert gaps == set(range(suffix_dedup.COVER))


def slow_codes(rows):
    """Lloyd rounds with every part measured against every entry, in whole numbers."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(1024 * v) for v in r[1]] for r in kept], np.int64)
    size = x.shape[1] // 4
    parts = [x[:, k * size : (k + 1) * size] for k in range(4)]
    books = [p[:256].copy() for p in parts]
    for step in range(5):
        gaps = [((p[:, None] - b[None]) ** 2).sum(2) for p, b in zip(parts, books)]
        at = [g.argmin(1) for g in gaps]
        for k in range(4) if step < 4 else ():
            for e in set(at[k].tolist()):
                own = parts[k][at[k] == e]
                books[k][e] = own.sum(0) // len(own)
    error = sum(g.min(1) for g in gaps)
    by_label = Counter()
    for r, e in zip(kept, error):
        by_label[r[2]] += int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{a[i]:02x}" for a in at), int(error[i]), by_label[r[2]], digest) for i, r in enumerate(kept)), key=str)


def test_codes_against_full_searches(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.1 * rng.normal(size=16)).tolist(), [None, 1, 2][i % 3]) for i in range(900)]
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (None, rows[6][1], 2), (2000, None, 1), (2001, [math.nan] * 16, 1), (2002, [math.inf] + [0.0] * 15, 1), (2003, [None] + [0.0] * 15, 1), (2004, [0.0] * 16, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(6)
    got = code_compression.codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_codes(rows)


def test_codes_of_few_odd_and_no_vectors(spark):
    spec = "vec_id long, embedding array<double>, label int"
    assert code_compression.codes(spark.createDataFrame([], spec)).count() == 0
    rows = [(1, [0.5, -0.5, 0.25, 1.0], 1), (2, [0.5, -0.5, 0.25, 1.0], 1), (3, [0.5], 1), (4, [], 1), (5, [1e9, 0.0, 0.0, 0.0], 2)]
    got = {r["vec_id"]: r for r in code_compression.codes(spark.createDataFrame(rows, spec)).collect()}
    assert got[1]["code"] == got[2]["code"] == "00000000" and got[1]["error"] == 0
    assert all(got[k]["code"] is None and got[k]["error"] is None for k in (3, 4, 5)) and got[3]["label_error"] == 0 and got[5]["label_error"] is None
    assert {r["code"] for r in code_compression.codes(spark.createDataFrame([(1, [], 1)], spec)).collect()} == {"00000000"}


def test_pivot_bounds_leave_out_no_nearer_entry():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-3, 4, (500, 6)), rng.integers(-3, 4, (64, 6))  # many ties
    pivots = book[::16]
    far = np.sqrt(code_compression.squared(x, pivots).astype(float)).astype(np.float32).astype(float)
    at, gap = code_compression.nearest(x, book, far, pivots)
    full = code_compression.squared(x, book)
    assert (at == full.argmin(1)).all() and (gap == full.min(1)).all()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_draw(docs, bench):
    def features(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % 10_000

    made = [(i, *features(t)) for i, t in docs]
    source, target = Counter(bucket(f) for _, _, fs in made for f in fs), Counter(bucket(f) for t in bench for f in features(t)[1])
    s_all, t_all = sum(source.values()), sum(target.values())
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000)))) for b in range(10_000)}
    rows = []
    for i, words, fs in made:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_draw_against_brute_force(spark):
    rng = random.Random(9)
    words = ["Der", "hund", "läuft", "x1", "Ω", "B-C", "q", "zz"]
    docs = [(i * 37 - 4000, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(20_000, None), (20_001, ""), (None, "q " * 30), (20_002, "zz x1 " * 40_000), (docs[7][0], docs[7][1])]
    bench = ["hund läuft q", None, "zz zz zz"]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, weight int").repartition(5)
    got = resampling.resampled(df, spark.createDataFrame([(t,) for t in bench], "text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_draw(docs, bench)
    none = resampling.resampled(df.limit(0), df.limit(0))
    assert none.collect() == [] and none.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_draw_from_a_table(spark):
    docs, bench = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()] for t, c in (("documents", ["doc_id", "text"]), ("benchmark", ["text"])))
    assert sorted((tuple(r) for r in queries.op13_resampling(spark, SF).collect()), key=str) == slow_draw(docs, [b[0] for b in bench])


def test_radix_ranks_are_stable(spark, monkeypatch):
    monkeypatch.setattr(resampling, "STRETCH", 64)
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 5, 300, 70_000]), rng.randrange(3)) for i in range(1000)]
    df = spark.createDataFrame(rows, "row long, a long, b long").coalesce(1)
    got = {r["row"]: r["rank"] for r in resampling.ranked(df, {"a": 17, "b": 2}).collect()}
    want = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    assert [got[r[0]] for r in want] == list(range(1, 1001))


def test_sharding_spreads_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(1, "y" * 500)] * 4000 + [(i, "x" * rng.randrange(1000)) for i in range(2, 4002)]
    for parts in (1, 7):
        got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), "doc_id", "text", 16).groupBy("shard").agg(F.sum("size").alias("n")).collect()
        load = [r["n"] for r in got]
        assert len(load) == 16 and min(load) > 0.9 * max(load)


LONG = " ".join(["word"] * 40)


def test_html_keeps_articles_with_misleading_words():
    for attribute in ('data-title="The hidden valley"', 'class="post hentry comments-open"', 'class="story-social"', 'class="entry newsletter-2024"'):
        assert html_extract.main_text(f"<article {attribute}><p>{LONG}</p></article>") == LONG
    inside = f'<article><p>{LONG}</p><div class="social-history"><p>a {LONG}</p></div><section id="related-work"><p>b</p></section><div class="related-links"><p>no</p></div></article>'
    assert html_extract.main_text(inside) == f"{LONG}\n\na {LONG}\n\nb"
    for hidden in ("hidden", "hidden=''", "HIDDEN", "class=a hidden"):
        assert html_extract.main_text(f"<div {hidden}><p>no {LONG}</p></div><p>{LONG}</p>") == LONG


def test_html_of_short_pages_and_unmarked_menus():
    assert html_extract.main_text("<body><p>Only a short one.</p></body>") == "Only a short one."
    assert html_extract.main_text(f"<ul><li><a>Home</a></li><li><a>News</a></li></ul><p>{LONG}</p><ul><li><a>Next</a></li></ul>") == LONG
    assert html_extract.main_text("a < b and c > d") == "a < b and c > d" and html_extract.main_text("<p>one <b") == "one <b"


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<!--", "<![CDATA[", "</x>", "<div>", "<p><div>", "<script>", "<a href='x' "])
def test_html_is_scanned_in_linear_time(piece):
    for tail in ("", ">"):
        start = time.process_time()
        html_extract.main_text(piece * (1_000_000 // len(piece)) + tail)
        assert time.process_time() - start < 20


def test_html_of_an_empty_table(spark):
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, html string, text string")).collect() == []


def test_replies_in_circles_end(spark):
    rows = [("a", 1, 3, 1.0), ("a", 2, 1, 1.0), ("a", 3, 2, 1.0), ("a", 4, 1, 5.0), ("b", 1, 1, 1.0), ("c", 1, None, 1.0), ("c", 2, 1, 2.0), ("c", 3, 99, 0.5), (None, 1, 2, 1.0), (None, 2, 1, 2.0)]
    tree = spark.createDataFrame(rows, "conv string, node long, parent long, score double")
    got = {}
    for r in chat.chosen_paths(tree, top=9).collect():
        got.setdefault((r["conv"], r["branch"]), []).append((r["depth"], r["node"]))
    paths = sorted((str(c), [n for _, n in sorted(v)]) for (c, _), v in got.items())
    assert [p for p in paths if p[0] == "a"] == [("a", [1]), ("a", [2]), ("a", [3]), ("a", [4])] and ("b", [1]) in paths and ("c", [1, 2]) in paths
    assert [p for p in paths if p[0] == "None"] == [("None", [1]), ("None", [2])]


def test_pipeline_near_duplicates_carry_maps(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(1, body, {"a": 1, "b": 2}, [{"k": "v"}]), (2, body, {"b": 2}, None), (3, "another text of a few words", None, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, n array<map<string,string>>")
    got = {r["doc_id"]: r for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert set(got) == {1, 3} and got[1]["m"] == {"a": 1, "b": 2} and got[1]["n"] == [{"k": "v"}]


def test_every_code_point_is_encoded_as_the_library_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.RankArrayBPE(bpe.tokenizer_spec(path))
    library.no_padding(), library.no_truncation()
    points = [chr(c) for c in range(0x34000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3D000, 0x110000, 97)]
    rng = random.Random(4)
    texts = [x for c in points[:0x3000] + rng.sample(points, 20_000) for x in (c, f"a{c}b")] + ["".join(rng.choice(points) for _ in range(40)) for _ in range(2000)]
    texts += [f"a{chr(c)}b {chr(c)}" for a, b, _, _ in bpe.NEW_CAPITALS for c in range(a, b + 1)] + [f"x{c}y" for r in (bpe.NEW_LETTERS + " " + bpe.NEW_NUMBERS).split() for c in (chr(int(r.split("-")[0], 16)), chr(int(r.split("-")[-1], 16)))]
    want = library.encode_batch(texts, add_special_tokens=False)
    wrong = [(t, w.ids, own.encode(t)) for t, w in zip(texts, want) if own.encode(t) != w.ids]
    assert not wrong, wrong[:3]
