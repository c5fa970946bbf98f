import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from traceforge.llm import crf_quality, decontam, simhash
from traceforge.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, count = docs.columns, docs.count()
    counts = [count]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == names, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.4 * count
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == counts[-1]


def kept_by_brute_force(rows):
    """Of (id, text) rows, one of each group of texts with close wide fingerprints and 0.8 of their shingles in common:
    that with the smallest id, none last."""
    fps = [simhash.wide_fingerprint(t, 5, 42, simhash.WIDE_WORDS) for _, t in rows]
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            apart = np.bitwise_count(fps[a] ^ fps[b])
            if apart.sum() <= simhash.WIDE_RADIUS and apart[:2].sum() <= simhash.SIFT and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    members = defaultdict(list)
    for row, g in zip(rows, group):
        members[g].append(row)
    return [min(m, key=lambda r: (r[0] is None, r[0] or 0)) for m in members.values()]


def test_near_duplicates_leave_one_row_of_each_group_where_ids_repeat(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(80)) for _ in range(12)]
    rows = [(i % 5, t) for i, t in enumerate(texts)] + [(i + 3, t) for i, t in enumerate(texts[:6])] + [(0, texts[0]), (1, None), (2, ""), (2, texts[3] + " a")]
    rows += [(None, texts[7]), (None, "an own text " * 9), (None, "an own text " * 9), (2**60 + 1, "large"), (2**60 + 3, "larger still")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    want = kept_by_brute_force(rows)
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted((i for i, _ in want), key=str)
    assert len(want) > len({i for i, _ in rows}) and {r["digest"] for r in kept} == {"x"}


def test_links_under_the_similarity_are_dropped(spark, monkeypatch):
    """Chains of texts that drift apart, with shares around 0.8: candidates that the shingles decide, in one block and in many."""
    rng = random.Random(17)
    rows = []
    for k in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice((60, 150, 400)))]
        for step in range(14):
            rows.append((100 * k + step, " ".join(words)))
            for at in rng.sample(range(len(words)), rng.choice((1, 2, len(words) // 40, len(words) // 30))):
                words[at] = f"w{rng.randrange(500)}"
    want = {i for i, _ in kept_by_brute_force(rows)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = simhash.groups_of(df.withColumn("name", F.md5("text")), "name").select("group").distinct().count()
    assert found == len(want) and 12 < found < len(rows)
    for block in (simhash.BLOCK, 3000):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == want, block


def test_near_copies_go_and_others_stay(spark):
    """Texts that share 0.85 of their five-word shingles are grouped, texts that share under 0.5 are not."""
    rng = random.Random(11)
    rows, kept = [], set()
    for k in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        near, far = list(words), list(words)
        for at in range(10, 300, 60):  # five words: each breaks five shingles
            near[at] = "new"
        for at in range(5, 300, 10):
            far[at] = "other"
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
        kept |= {3 * k, 3 * k + 2}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert kept <= got and len(got - kept) <= 2


def test_run_against_brute_force(spark, tmp_path):
    """All five stages on a small corpus, each decided row by row from what the stage before it kept."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(8)).capitalize() for _ in range(n)) + "."
    rows, marks = [], []
    for i in range(300):
        t = prose(6)
        bad, toxic = i % 6 == 0, i % 7 == 1
        t = (" | ".join(t.upper().split()) + " $$$ ###") if bad else t
        t += " vile awful" if toxic else ""
        rows.append((2**60 + 2 * i, t, "en"))
        marks.append((2**60 + 2 * i, int(not bad), int(toxic)))
    item = prose(4)
    rows += [(7, item + " " + prose(1), "hit"), (8, rows[2][1], "copy"), (8, rows[3][1] + " tail", "near"), (None, prose(6), None), (9, None, "x"), (10, "", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, n_hit string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    marked = spark.read.parquet(f"{tmp_path}/labels.parquet")

    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = crf_quality.QualityModel.fit(docs, marked)
    left = [r for r in left if crf_quality.averages([r[1]], model.w, model.trans)[0] >= model.threshold]
    good = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in good.collect()), key=str) == sorted(left, key=str) and 200 < len(left) < 300
    calm = corpus_pipeline.toxicity(spark, good, str(tmp_path))
    was, left = left, [(r["doc_id"], r["text"]) for r in calm.collect()]
    assert set(left) <= set(was) and not any("vile" in (t or "") for _, t in left) and sum("vile" not in (t or "") for _, t in was) - len(left) <= 3
    left = kept_by_brute_force(left)
    own = decontam.words_of(item)
    windows = {tuple(own[i : i + 13]) for i in range(len(own) - 12)}

    def hit(t):
        found, at = decontam.words_of(t), set()
        for p in range(len(found) - 12):
            if tuple(found[p : p + 13]) in windows:
                at.update(range(p, p + 13))
        return at and 20 * len(at) >= len(found)

    left = [r for r in left if not hit(r[1])]
    library = Tokenizer.from_file(tokenizer_path())
    want = sorted(((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in left), key=str)
    assert 7 not in {i for i, _ in left}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == want


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
