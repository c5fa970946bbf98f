import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from traceforge.llm import bpe, chat, cover_tree, crf_quality, decontam, html_extract, labels, sharding, simhash, toxicity, warc
from traceforge.llm.queries import tokenizer_path
from traceforge.llm.shared import components, new_path

WORDS = [f"w{i}" for i in range(300)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    base = text(rng, 60)
    return [None, "", "  \n ", "One", "two Words", base, base, base + " tail", text(rng, 30_000), "Größe ΑΣ <|endoftext|> it's 12", "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark, odd_texts):
    rows = [(i, t, "en", "s", "clash", "clash") for i, t in enumerate(odd_texts)] + [(3, "One", "en", "s", "clash", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string, fp string")


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 900 + i) for i in range(50)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: find(n) for n in parent}
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_sharding_by_bytes(spark, docs, odd_texts):
    rows = sharding.shard_by_bytes(docs, "doc_id", "text", 4, slots=64).collect()
    assert len(rows) == len(odd_texts) + 1
    for r in rows:
        body = (odd_texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(body) + 1 and r["text_crc32"] == zlib.crc32(body) and r["law"] == "bytes"
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_sharding_is_even_and_versions_are_kept(spark):
    rng = random.Random(2)
    many = spark.createDataFrame([(i, "x" * rng.randrange(2000)) for i in range(3000)], "doc_id long, text string")
    path = new_path(spark, "map")
    sums = sharding.slot_bytes(sharding.measured(many, "doc_id", "text", 512), 512)
    sharding.store_map(sharding.initial_map(sums, 8), path)
    sharding.store_map(sharding.rebalanced(sharding.load_map(spark, path, 0), 8), path)
    first, second = ({r["slot"]: r for r in sharding.load_map(spark, path, v).collect()} for v in (0, 1))
    load = [sum(r["slot_bytes"] for r in second.values() if r["shard"] == s) for s in range(8)]
    assert max(load) - min(load) < 0.01 * sum(load) / 8
    sharding.store_map(sharding.rebalanced(sharding.load_map(spark, path), 9), path)
    third = {r["slot"]: r for r in sharding.load_map(spark, path).collect()}
    assert {r["version"] for r in third.values()} == {2} and len(third) == len(second) == len(first) == 512
    stay = sum(third[s]["shard"] == second[s]["shard"] for s in third)
    assert stay > 0.7 * 512 and {r["shard"] for r in third.values()} == set(range(9))


def test_html_extraction():
    page = "<html><body><div class=menu><a href=x>A</a></div><article><h1>T &amp; U</h1><p>one\n  two<br>three<p>four<aside>no</aside><form><p>no</p></form><section class='comments'><p>no</p></section></article><footer>no</footer><script>var a='<p>no</p>'</script></body></html>"
    assert html_extract.main_text(page) == "T & U\n\none two three\n\nfour"
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    plain = "<div id=nav><a>home</a></div><div><h2>Title</h2><p>" + "word " * 40 + "</p><p>End.</p></div><div class='cookie-notice'>We use them</div>"
    assert html_extract.main_text(plain) == "Title\n\n" + " ".join(["word"] * 40) + "\n\nEnd."
    beside = "<div class='content with-sidebar'><p>" + "word " * 40 + "</p></div><div class=sidebar><p>" + "no " * 60 + "</p></div><p style='display: none'>hidden text</p>"
    assert html_extract.main_text(beside) == " ".join(["word"] * 40)
    for only in ("class=menu", "class='site-notice'", "id=comments", "role=navigation", "style='display: none'"):
        assert html_extract.main_text(f"<div {only}><p>" + "word " * 400 + "</p></div>") == ""
    assert html_extract.main_text("<ul><li><a>x</a><li><a>y</a></ul>") == ""


def test_html_windows_decide_beside_a_teaser():
    long = " ".join(["word"] * 40)
    teaser = f"<body><div id=content><p>{long}</p></div><article class=card>Next: read on</article></body>"
    assert html_extract.main_text(teaser).startswith(long)
    most = f"<body><p>Elsewhere</p><article><p>{long}</p><aside>no</aside><p>End.</p></article></body>"
    assert html_extract.main_text(most) == long + "\n\nEnd."


def test_html_keeps_short_blocks_after_furniture():
    long = " ".join(["word"] * 40)
    page = f"<body><div id=a><p>{long}</p><aside>no</aside><p>Short.</p><aside>no</aside>End.</div><nav>no</nav><div><div><p>Imprint</p></div></div></body>"
    assert html_extract.main_text(page) == f"{long}\n\nShort.\n\nEnd."
    assert html_extract.main_text(f"<div>{long}<button>no</button> tail</div>") == f"{long}\n\ntail"


def slow_main_text(page):
    """Surges and dives line by line, and the lines near them, written out."""
    lines = html_extract.lines_of(page)
    inside = sum(len(x.text) for x in lines if x.article)
    outside = sum(len(x.text) - x.links for x in lines if not x.article)
    share = inside / (inside + outside) if inside else 0

    def weight(k):
        x = lines[k] if k < len(lines) else html_extract.BLANK
        if not inside:
            return len(x.text) - x.links
        return 3 * share * len(x.text) if x.article else 1.5 * (1 - share) * (len(x.text) - x.links)

    def window(k):
        return sum(weight(i) for i in range(k, k + 3))

    surge = min(80, max(map(window, range(len(lines))), default=0) / 2)
    text, k = set(), 0
    while k < len(lines):
        stop = k
        while stop < len(lines) and window(stop) > 0:
            stop += 1
        if any(window(i) >= surge for i in range(k, stop)):
            heavy = [i for i in range(k, stop) if weight(i) > 0]
            text.update(range(heavy[0], heavy[-1] + 1) if heavy else ())
        k = stop + 1
    places = {p for k in text if lines[k].text for p in lines[k].places}
    near = {k for k, x in enumerate(lines) if weight(k) > 0 and places & x.places and (x.article or any(t < k for t in text))}
    return "\n\n".join(lines[k].text for k in sorted(text | near) if lines[k].text)


def test_html_windows_against_a_slow_version():
    rng = random.Random(12)
    changed = 0
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 25)):
            words = " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 2, 5, 30])))
            shape = rng.choice(["<p>{}</p>", "<div>{}</div>", "<p><a>{}</a></p>", "<aside>{}</aside>", "<div class=promo>{}</div>", "<article><p>{}</p></article>", "<div><p>{}</p>", "</div>{}"])
            parts.append(shape.format(words))
        page = "".join(parts)
        got = html_extract.main_text(page)
        assert got == slow_main_text(page)
        changed += got != "\n\n".join(x.text for x in html_extract.lines_of(page) if x.text)
    assert changed > 100


def test_html_density_decides_inside_and_outside_articles():
    long = " ".join(["word"] * 60)
    story = f"<div id=content><p>{long}</p><p>{long}</p></div>"
    assert html_extract.main_text(f"<body>{story}<article class=card>Next: read on</article></body>") == f"{long}\n\n{long}"
    assert html_extract.main_text(f"<body><div>A line outside</div><aside>x</aside><article><h1>T</h1><p>{long}</p></article></body>") == f"T\n\n{long}"
    many = "".join(f"<p>{long} {k}</p>" for k in range(3000))
    assert html_extract.main_text(f"<article>{many}</article>").count("\n\n") == 2999


def test_html_columns(spark):
    df = spark.createDataFrame([(1, "u", None, "old"), (1, "u", "<article><p>hi</p></article>", "old")], "page_id long, url string, html string, text string")
    rows = html_extract.extracted(df).collect()
    assert sorted((r["text"], r["n_chars"]) for r in rows) == [("", 0), ("hi", 2)]
    assert html_extract.extracted(df.limit(0)).count() == 0


def slow_fingerprint(t):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if grams and 2 * bits[b] > len(grams))


def test_fingerprints(odd_texts):
    for t in odd_texts:
        if t is None or len(t) < 10_000:
            assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_close_pairs_are_exact():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 700, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    x = np.r_[x, x[:300] ^ flips, np.uint64([0, 1, 3, 2**63])]
    got = {p for a, b in simhash.close_pairs(x, x, 4) for p in zip(a.tolist(), b.tolist())}
    assert got == {*map(tuple, np.argwhere(np.bitwise_count(x[:, None] ^ x[None]) <= 4).tolist())}


def test_close_wide_pairs_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, (500, 8), dtype=np.uint64)
    for k in range(200):
        x[300 + k] = x[k]
        for bit in rng.integers(0, 512, 75 + k % 60):
            x[300 + k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    got = {p for a, b in simhash.close_wide_pairs(x, x[50:], 90) for p in zip(a.tolist(), b.tolist())}
    apart = np.bitwise_count(x[:, None] ^ x[None, 50:])
    want = np.argwhere((apart.sum(2) <= 90) & (apart[:, :, :2].sum(2) <= simhash.SIFT))
    assert got == {*map(tuple, want.tolist())} and len(got) > 500


def test_wide_fingerprints_bit_by_bit(odd_texts):
    for t in odd_texts[:8]:
        words = (t or "").lower().split()
        grams = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        bits = np.zeros(512)
        for g in grams:
            h = np.uint64(xxhash.xxh64_intdigest(g, 42))
            row = np.array([h, *(simhash.mixed(np.array([h + np.uint64(k)]))[0] for k in range(1, 8))])
            bits += np.unpackbits(row.view(np.uint8), bitorder="little")
        assert np.array_equal(np.unpackbits(simhash.wide_fingerprint(t, 5, 42, 8).view(np.uint8), bitorder="little"), 2 * bits > len(grams))


def test_simhash_groups(spark, docs, odd_texts, monkeypatch):
    monkeypatch.setattr(simhash, "tile_links", lambda p, r, real=simhash.tile_links: real(p, r, 3))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(odd_texts) + 1
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    parent = {i: i for i in prints}
    for _ in range(len(prints)):
        for i in prints:
            for j in prints:
                if bin(prints[i] ^ prints[j]).count("1") <= 4:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    assert {r["doc_id"]: r["component_id"] for r in rows} == parent
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_cover_tree_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8))
    near = x[rng.integers(0, 900, 500)] + 0.08 * rng.normal(size=(500, 8))
    dense = x[:1] + 0.05 * rng.normal(size=(300, 8))
    x = np.vstack([x, near, dense, x[:60], 3 * x[60:90]]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [1.0, None] + [0.0] * 6, 0), (n + 3, [float("nan")] * 8, 0), (n + 4, [], 0), (n + 5, [1.0, 2.0], 0), (n + 6, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    old = cover_tree.BLOCK_NUMBERS
    cover_tree.BLOCK_NUMBERS = 2000
    try:
        got = {r["vec_id"]: r for r in cover_tree.near_vectors(df).collect()}
    finally:
        cover_tree.BLOCK_NUMBERS = old
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    link = y @ y.T >= 0.95
    parent = np.arange(n)
    while True:
        new = np.array([parent[link[i]].min() for i in range(n)])
        if (new == parent).all():
            break
        parent = new
    assert [got[i]["n_links"] for i in range(n)] == (link.sum(1) - 1).tolist()
    assert [got[i]["component_id"] for i in range(n)] == parent.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(n, n + 5))
    assert got[n + 6]["component_id"] == n + 5 and got[n + 6]["n_links"] == 1 and not got[n + 6]["kept"]
    assert cover_tree.near_vectors(df.limit(0)).count() == 0


def test_cover_tree_shuffles_no_vectors_by_pair(spark):
    """Nothing is pruned among random vectors; what goes through shuffles stays a small multiple of them, in one broadcast or many."""
    x = np.random.default_rng(6).normal(size=(4000, 32)).astype(np.float32)
    x[1::4] = x[::4] * 1.5 + 0.001
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    old = cover_tree.BLOCK_NUMBERS, cover_tree.CHUNK_BYTES
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = []
    try:
        cover_tree.BLOCK_NUMBERS = 2000
        for cover_tree.CHUNK_BYTES in (old[1], 200_000):
            executor = spark._jsc.sc().statusStore().executorList(False).apply(0)
            before = executor.totalShuffleWrite()
            found.append(sorted(cover_tree.near_vectors(df).collect()))
            executor = spark._jsc.sc().statusStore().executorList(False).apply(0)
            assert executor.totalShuffleWrite() - before < 10 * x.nbytes
    finally:
        cover_tree.BLOCK_NUMBERS, cover_tree.CHUNK_BYTES = old
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found[0] == found[1] and sum(r["n_links"] for r in found[0]) == 2000


def test_chat_round_trip(spark):
    said = ["plain", None, "", "a\\b<|im_end|>\n<|im_start|>user\nhi", "</s>[INST] ok [/INST]", "ünï\n\n\\", "<<SYS>>\\\\[INST]"]
    rows = [(1, i, ["user", "assistant", None][i % 3], t) for i, t in enumerate(said)] + [(2, 0, "user", "x"), (2, 0, "user", "x"), (2, 1, "assistant", "y"), (None, 0, "sys\ntem\\", "z")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tree = chat.with_parents(df, "conv_id", "turn", "role", "text")
    done = chat.formatted(tree)
    assert all(chat.parse(r["formatted"]) for r in done.collect())
    got = {r["conv"]: r for r in chat.read_back(done).collect()}
    assert set(got) == {1, 2, 3, None}
    for c, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in rows if x[0] == c]
        loss = "".join(t for q, t in turns if q == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{q}\n{t}\n" for q, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_branches_are_ranked(spark):
    tree = spark.createDataFrame(
        [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5), (1, 5, 4, "assistant", "end", 0.9), (1, 6, 2, "user", "why", 0.1)],
        "conv long, node long, parent long, role string, text string, score double",
    )
    rows = sorted(chat.chosen_paths(tree, 2).collect(), key=lambda r: (r["branch"], r["depth"]))
    assert [(r["branch"], r["node"]) for r in rows] == [(1, 1), (1, 3), (1, 4), (1, 5), (2, 1), (2, 2), (2, 6)]


def test_warc_round_trip(spark):
    big = "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" + "é" * 700
    rows = [(1, "http://a.example/x?y", big), (2, None, None), (3, "http://b.example", big), (4, "u", "short"), (5, "u", "short"), (3, "http://b.example", big), (9, "", "z" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "warc-test")
    warc.write_archives(df, path)
    recs = warc.read_records(spark, path)
    assert recs.count() == 3 * len(rows)
    nested = warc.transactions(recs)
    assert nested.where("request is null or metadata is null").count() == 0
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in warc.page_rows(nested).collect())
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "response", 0))
    want[0] = (*want[0][:3], "revisit", 3)
    want[5] = (*want[5][:3], "revisit", 3)
    assert got == sorted(want)
    path = new_path(spark, "warc-empty")
    warc.write_archives(df.limit(0), path)
    assert warc.page_rows(warc.transactions(warc.read_records(spark, path))).count() == 0


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, text(rng, rng.choice([1, 2, 5, 12, 13, 14, 40]))) for i in range(25)] + [(90, ""), (91, None), (92, "Ünï CODE 7")]
    items.append((93, items[20][1]))
    texts = [None, "", text(rng, 500)] + [text(rng, 20) + " " + (items[k][1] or "").upper() + "!" + text(rng, 5) for k in range(25)] + ["ünï code 7", "xünï code 7"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, hits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    def brute_force(t, items, window=13):
        words, hit, found = decontam.words_of(t), set(), set()
        for item, item_text in items:
            own = decontam.words_of(item_text)
            for i in range(max(1, len(own) - window + 1) if own else 0):
                w = own[i : i + window]
                for p in range(len(words) - len(w) + 1):
                    if words[p : p + len(w)] == w:
                        hit.update(range(p, p + len(w)))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)

    for size in (decontam.BLOCK_BYTES, 600):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.contamination(df, bench).collect()}
        assert got == {i: brute_force(t, items) for i, t in enumerate(texts)}
    empty = decontam.contamination(df, bench.limit(0)).collect()
    assert [r["n_words"] for r in empty] == [brute_force(t, [])[0] for t in texts] and not any(r["contaminated"] for r in empty)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    node, trans = rng.normal(size=(1, 4)), rng.normal(size=(2, 2))
    marginal, pairs, log_z = crf_quality.forward_backward(node, np.ones((1, 4), bool), trans)
    total, ones, seen = 0.0, np.zeros(4), np.zeros((2, 2))
    for k in range(16):
        y = [k >> i & 1 for i in range(4)]
        p = np.exp(sum(node[0, i] * y[i] for i in range(4)) + sum(trans[y[i], y[i + 1]] for i in range(3)))
        total += p
        ones += p * np.array(y)
        for i in range(3):
            seen[y[i], y[i + 1]] += p
    assert np.allclose(marginal[0], ones / total) and np.allclose(pairs[0], seen / total) and np.isclose(log_z[0], np.log(total))


def training(spark, n=400):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 1
        lines = [text(rng, 12).capitalize() + "." for _ in range(4)]
        if toxic:
            lines[1] += " " + " ".join(rng.choice(["vile", "awful"]) for _ in range(2))
        if bad:
            lines = [" | ".join(s.upper().split()) + " $$$" for s in lines]
        rows.append((i, "\n".join(lines)))
        marks.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows + [(n, None), (n + 1, ""), (None, "no id")], "doc_id long, text string")
    return docs, spark.createDataFrame(marks + [(0, None, None), (5, 1, 0), (10**6, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"), marks


def test_classifiers_on_held_out_rows(spark):
    docs, marks, rows = training(spark)
    quality = {r["doc_id"]: r for r in crf_quality.QualityModel.fit(docs, marks).scored(docs).collect()}
    toxic = {r["doc_id"]: r for r in toxicity.ToxicityModel.fit(docs, marks).scored(docs).collect()}
    assert len(quality) == len(toxic) == len(rows) + 3
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(quality[i]["held_out"] == toxic[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert np.mean([quality[i]["predicted"] == q for i, q, _ in held]) > 0.95
    assert np.mean([toxic[i]["predicted"] == t for i, _, t in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for x in (quality, toxic) for r in x.values())
    none = marks.limit(0)
    assert {r["predicted"] for r in crf_quality.QualityModel.fit(docs, none).scored(docs).collect()} == {1}
    assert {r["predicted"] for r in toxicity.ToxicityModel.fit(docs, none).scored(docs).collect()} == {0}


def toxic_words(rows):
    """Contexts and document counts of every word of (text, label, fold) rows, by brute force."""
    contexts, documents = {}, {}
    for t, label, part in rows:
        words = (t or "").lower().split()
        for before, word in zip(["", *words], words):
            contexts.setdefault(word, set()).add(before)
        for word in set(words):
            documents.setdefault(word, [0] * 4)[label + 2 * (part == 4)] += 1
    return contexts, documents


def test_toxicity_counts_every_context(spark):
    rows = [(" ".join(f"p{i}x{j} common" for j in range(200)), i % 2, 4 * (i == 2)) for i in range(5)] + [("common common p0x0", 0, 1), (None, 1, 1), ("", 0, 1)]
    got = {r["word"]: r for r in toxicity.counted(spark.createDataFrame(rows, "text string, label int, fold int").repartition(3)).collect()}
    contexts, documents = toxic_words(rows)
    assert len(contexts["common"]) == 1002
    assert {w: r["contexts"] for w, r in got.items()} == {toxicity.hashed(w): len(x) for w, x in contexts.items()}
    assert {w: [r["n0"], r["n1"], r["c0"], r["c1"]] for w, r in got.items()} == {toxicity.hashed(w): x for w, x in documents.items()}


def test_toxicity_compares_two_models(spark):
    """The score of every text from the two Kneser-Ney models written out, over all its words."""
    rng = random.Random(8)
    fit = [(text(rng, 30) + (" vile" if i % 3 == 0 else "") + (" rare" if i == 3 else ""), int(i % 3 == 0), 1) for i in range(60)]
    contexts, documents = toxic_words(fit)
    total = [sum(n[k] for n in documents.values()) for k in (0, 1)]
    found = [[sum(n[k] == m for n in documents.values()) for m in (1, 2, 3, 4)] for k in (0, 1)]
    y = [f[0] / (f[0] + 2 * f[1]) for f in found]
    discount = [{0: 0} | {m: min(max(m - (m + 1) * y[k] * found[k][m] / found[k][m - 1] if found[k][m - 1] else m / 2, 0.05), m - 0.05) for m in (1, 2, 3)} for k in (0, 1)]
    freed = [sum(discount[k][min(n[k], 3)] for n in documents.values()) / total[k] for k in (0, 1)]
    assert all(discount[k][min(n[k], 3)] < n[k] for n in documents.values() for k in (0, 1) if n[k])  # every word keeps a part of its counts
    pairs = sum(map(len, contexts.values()))

    def p(word, k):
        n = documents.get(word, [0, 0])[k]
        shared = (len(contexts.get(word, ())) + 0.5) / (pairs + 0.5 * (len(contexts) + 1))
        return (n - discount[k][min(n, 3)]) / total[k] + freed[k] * shared

    texts = [None, "", "vile", "rare unseen", "vile and vile " + text(rng, 40), text(rng, 50), "W1 w2\nVILE unseen"]
    model = toxicity.fitted(toxicity.counted(spark.createDataFrame(fit, "text string, label int, fold int")))
    broad = {r["i"]: r["s"] for r in toxicity.with_evidence(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).collect()}
    model.packed = None
    shuffled = {r["i"]: r["s"] for r in toxicity.with_evidence(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).collect()}
    for i, t in enumerate(texts):
        words = (t or "").lower().split()
        mean = sum(np.log((1 - toxicity.RATE) * p(w, 0) + toxicity.RATE * p(w, 1)) - np.log(p(w, 0)) for w in words) / (len(words) + toxicity.SMOOTH)
        want = np.log(max(0, mean - np.log(1 - toxicity.RATE)) + 1e-4) if words else toxicity.LOW
        assert broad[i] == pytest.approx(want, abs=1e-9) and shuffled[i] == pytest.approx(want, abs=1e-9)


def test_toxicity_joins_a_model_too_large_to_broadcast(spark):
    docs, marks, _ = training(spark)
    docs = docs.unionByName(docs.where("doc_id in (1, 2, 6)"))
    small, large = toxicity.ToxicityModel.fit(docs, marks), toxicity.ToxicityModel.fit(docs, marks, most=0)
    assert small.words.packed is not None and large.words.packed is None
    assert small.threshold == large.threshold

    def rows(model):
        return sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["predicted"], round(r["score"], 9)) for r in model.scored(docs).collect()))

    assert rows(small) == rows(large) and sum(p for _, p, _ in rows(small)) > 0
    assert sorted(small.kept(docs).collect(), key=str) == sorted(large.kept(docs).collect(), key=str)


BIG = [2**60 + 1, None, 2**60 + 3, 2**60 + 3, -(2**61) - 5]


def test_ids_of_any_size_come_back(spark):
    """Every operator that carries ids through Python, with large ids and a null in one batch, and clashing columns."""
    rng = random.Random(6)
    fit_docs, marks, _ = training(spark)
    texts = [text(rng, 40) for _ in BIG]
    docs = spark.createDataFrame([(i, t, 2**60 + 7 if k else None, "old") for k, (i, t) in enumerate(zip(BIG, texts))], "doc_id long, text string, n_hit long, s string").coalesce(1)
    want = sorted(BIG, key=str)

    def ids(df, key="doc_id"):
        return sorted((r[key] for r in df.collect()), key=str)

    quality, toxic = crf_quality.QualityModel.fit(fit_docs, marks), toxicity.ToxicityModel.fit(fit_docs, marks)
    for made in (quality.scored(docs), toxic.scored(docs)):
        assert ids(made) == want
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in made.collect() if r["doc_id"] is not None)
    quality.threshold, toxic.threshold = -99.0, 99.0
    for made in (quality.kept(docs), toxic.kept(docs)):
        assert made.columns == docs.columns and sorted(made.collect(), key=str) == sorted(docs.collect(), key=str)
    assert ids(simhash.near_duplicates(docs)) == want
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {*BIG}
    assert ids(bpe.encoded(docs, tokenizer_path())) == want
    assert ids(sharding.shard_by_bytes(docs, "doc_id", "text", 2)) == want
    pages = docs.select(docs.doc_id.alias("page_id"), docs.s.alias("url"), docs.text.alias("html"), docs.s.alias("text"))
    assert ids(html_extract.extracted(pages), "page_id") == want
    bench = spark.createDataFrame([(2**60 + 1, texts[0]), (None, texts[2])], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontam.contamination(docs.dropDuplicates(["doc_id"]), bench).collect()}
    assert set(found) == {*BIG} and found[2**60 + 1]["items"] == [str(2**60 + 1)] and not found[2**60 + 3]["items"]
    conv = docs.select(docs.doc_id.alias("conv_id"), docs.n_hit.alias("turn"), docs.s.alias("role"), "text")
    assert {r["conv"] for r in chat.read_back(chat.formatted(chat.with_parents(conv, "conv_id", "turn", "role", "text"))).collect()} == {*BIG}
    path = new_path(spark, "warc-ids")
    warc.write_archives(pages, path)
    assert ids(warc.page_rows(warc.transactions(warc.read_records(spark, path))), "page_id") == want
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in BIG], "vec_id long, embedding array<double>")
    assert ids(cover_tree.near_vectors(vectors), "vec_id") == want


def test_empty_tables(spark):
    fit_docs, marks, _ = training(spark)
    docs = spark.createDataFrame([], "doc_id long, text string, size string")
    assert crf_quality.QualityModel.fit(docs, marks).scored(docs).count() == toxicity.ToxicityModel.fit(docs, marks).scored(docs).count() == 0
    assert crf_quality.QualityModel.fit(fit_docs, marks).scored(docs).count() == toxicity.ToxicityModel.fit(fit_docs, marks).scored(docs).count() == 0
    assert sharding.shard_by_bytes(docs, "doc_id", "text", 4).count() == 0
    assert bpe.encoded(docs, tokenizer_path()).count() == 0
    assert decontam.contamination(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(chat.with_parents(conv, "conv_id", "turn", "role", "text"))).count() == 0


def test_sharding_splits_one_id(spark):
    """One id, null ids and equal rows: positions are gapless and different texts spread over the shards."""
    rows = [(7, f"text {i} " + "x" * (i % 50)) for i in range(2000)] + [(None, f"t{i}") for i in range(500)] + [(8, "same")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = sharding.shard_by_bytes(docs, "doc_id", "text", 4).collect()
    assert len(out) == len(rows) and all(r["size"] > 0 for r in out)
    load = [sum(r["size"] for r in out if r["shard"] == k) for k in range(4)]
    assert max(load) < 1.1 * min(load)
    for k in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))


def test_quality_samples_rows_not_parts_of_texts(spark):
    docs, marks, _ = training(spark)
    again = docs.unionByName(spark.range(3000).selectExpr("cast(1 as bigint) as doc_id", "concat('line ', id) as text"))
    sample = labels.sampled(again, marks, "quality", 50, 10_000).collect()
    assert len(sample) == 50 and sum(r["text"].startswith("line ") for r in sample) <= 1
    few = labels.sampled(again, marks, "quality", 50, 60).collect()
    assert 0 < len(few) and sum(r["text"].count("\n") + 1 for r in few) <= 60
    x = np.arange(100)[:, None]
    assert np.array_equal(np.concatenate(crf_quality.chains(x)), x) and max(map(len, crf_quality.chains(x))) <= crf_quality.CHAIN


def test_quality_average_against_enumeration():
    """Length-weighted marginals of whole texts, by summing over all labellings."""
    rng = np.random.default_rng(7)
    w, trans = rng.normal(size=crf_quality.FEATURES), rng.normal(size=(2, 2))
    texts = ["One line.", "Two\nLINES 12 here", None, "a b\n\nc | d | e\n$$$ $$$\nEnd."]
    got = crf_quality.averages(texts, w, trans)
    for t, odds in zip(texts, got):
        ((x, size),) = crf_quality.features([t])
        total, good = 0.0, np.zeros(len(x))
        for k in range(2 ** len(x)):
            y = [k >> i & 1 for i in range(len(x))]
            p = np.exp(sum(x[i] @ w * y[i] for i in range(len(x))) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += p
            good += p * np.array(y)
        mean = (good / total) @ size / size.sum()
        assert np.isclose(1 / (1 + np.exp(-odds)), np.clip(mean, 1e-6, 1 - 1e-6))


def test_bpe_long_words_equal_the_library():
    from time import time

    from tokenizers import Tokenizer

    path = tokenizer_path()
    library, mine = Tokenizer.from_file(path), bpe.RankArrayBPE(bpe.tokenizer_spec(path))
    rng = random.Random(3)
    for n in (bpe.SHORT, bpe.SHORT + 1, 5000):
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(n)) + "x" * n
        assert mine.encode(word) == library.encode(word, add_special_tokens=False).ids
    begin = time()
    assert len(mine.encode("".join(rng.choice("etaoin") for _ in range(300_000)))) > 50_000 and time() - begin < 30


def test_warc_reads_members_and_plain_files(spark):
    """One member per record, several records in one member, and no compression give the same records."""
    import gzip

    made = [f"WARC/1.0\r\nWARC-Type: {k}\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, (k, b) in enumerate([("response", b"HTTP/1.1 200 OK\r\n\r\nbody"), ("metadata", b"pageId: 5\r\n"), ("request", b"GET /"), ("response", b"HTTP/1.1 200 OK\r\n\r\n")])]
    want = [r[1:] for r in warc.parse_records(b"".join(made))]
    assert len(want) == 4 and want[0][-1] == b"body"
    assert [r[1:] for r in warc.parse_records(b"".join(map(gzip.compress, made)))] == want
    assert [r[1:] for r in warc.parse_records(gzip.compress(b"".join(made[:3])) + gzip.compress(made[3]))] == want


def test_warc_repeats_in_many_partitions_and_long_payloads(spark):
    rows = [(5, "u", "z" * 2000)] * 60 + [(6, "v", "z" * 2000)] * 3 + [(None, None, "y" * 3000)] + [(1, "w", "é" * 9_000_000)] + [(2, "s", "short")] * 5
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    path = new_path(spark, "warc-hot-source")
    df.write.parquet(path)
    df, path = spark.read.parquet(path), new_path(spark, "warc-hot")
    warc.write_archives(df, path)
    got = warc.page_rows(warc.transactions(warc.read_records(spark, path))).collect()
    assert len(got) == len(rows)
    assert [(r["page_id"], r["payload_bytes"]) for r in got if r["record_type"] == "response" and r["payload_bytes"] == 2000] == [(6, 2000)]
    assert sum(r["record_type"] == "revisit" and r["refers_to"] == 6 for r in got) == 62
    assert {(r["page_id"], r["record_type"]) for r in got if r["payload_bytes"] != 2000} == {(None, "response"), (1, "response"), (2, "response")}


def test_cut_takes_the_middle():
    counts = np.zeros((labels.BINS, 2))
    counts[100, 0] = 50
    counts[300, 1] = 9
    threshold, _ = labels.cut(counts, 0.0, float(labels.BINS))
    assert 190 < threshold < 210


def test_bpe_equals_the_library(spark, docs, odd_texts):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    library = Tokenizer.from_file(path)
    mine = bpe.RankArrayBPE(bpe.tokenizer_spec(path))
    strange = ["İi ẞ ǅ", "é ́x", "½²3 a\x00b\x85c", "日本語 👍🏽", "'S'll'd", "<|startoftext|><|STARTOFTEXT|>", "ΟΔΟΣ ΑΣ.", "​﻿z"]
    for t in [t or "" for t in odd_texts] + strange:
        ids = library.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids and mine.decode(ids) == library.decode(ids, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in bpe.encoded(docs, path).collect()}
    for i, t in enumerate(odd_texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
