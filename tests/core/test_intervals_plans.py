"""Interval joins by boundary events, forests, prominence, callers' functions, hot-fire rows and the store's upsert."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceforge.functions.series import in_intervals, interval_sums
from traceforge.operators import qc, spectral, steady, uncertainty
from traceforge.plans import analysis
from traceforge.sources import campaigns

SPEC = "test_id string, channel string, seq long, time_s double, value double"


def many(spark, tests):
    rows = [(t, c, i, i * 0.01, None if v is None else float(v)) for (t, c), x in tests.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SPEC)


def test_samples_find_their_interval(spark):
    rng = random.Random(1)
    samples = [("t", c, i, i / 10, None if rng.random() < 0.1 else rng.random()) for c in "ab" for i in range(200)]
    spans = []
    for c in "ab":
        at = 0
        while at < 190:
            a = at + rng.randrange(5)
            spans.append(("t", c, len(spans), a, a + rng.randrange(12)))
            at = spans[-1][4] + 1
    got = in_intervals(spark.createDataFrame(samples, SPEC), spark.createDataFrame(spans, "test_id string, channel string, no int, start_seq long, end_seq long"))
    want = sorted((s[1], s[2], k[2]) for s in samples for k in spans if s[1] == k[1] and k[3] <= s[2] <= k[4])
    assert sorted((r["channel"], r["seq"], r["no"]) for r in got.collect()) == want
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_overlapping_windows_by_boundary_events(spark):
    rng = np.random.default_rng(2)
    x = {("t", c): np.where(rng.random(300) < 0.1, np.nan, 1e5 + rng.normal(size=300)) for c in "ab"} | {("t", "none"): [np.nan] * 300}
    df = many(spark, {k: [None if np.isnan(v) else v for v in xs] for k, xs in x.items()})
    windows = [("t", k, float(a), float(a + w)) for k, (a, w) in enumerate(zip(rng.uniform(-0.5, 3, 60), rng.uniform(-0.2, 2, 60)))] + [("t", 99, 0.5, 0.5), ("t", 100, 0.505, 0.506)]
    got = {(r["channel"], r["window_id"]): r for r in steady.sweep(df, spark.createDataFrame(windows, "test_id string, window_id long, start_s double, end_s double")).collect()}
    time, seen = np.arange(300) * 0.01, 0
    for (_, c), xs in x.items():
        for _, k, a, b in windows:
            inside = (time >= a) & (time <= b)
            own = np.asarray(xs)[inside]
            own = own[~np.isnan(own)]
            r = got.get((c, k))
            assert (r is None) == (not inside.any()), (c, k)
            if r is not None:
                seen += 1
                assert r["n"] == len(own) and (r["mean"] is None if not len(own) else r["mean"] == pytest.approx(own.mean(), rel=1e-12))
                assert r["std"] is None if len(own) < 2 else r["std"] == pytest.approx(own.std(ddof=1), rel=1e-6)
    assert seen == len(got)
    assert interval_sums(df.limit(0), spark.createDataFrame([], "test_id string, channel string, a double, b double"), "value", "time_s", "a", "b").count() == 0


def walked(nodes, row, k=0, depth=0):
    feature, cut, left, right, length = nodes[k]
    if feature < 0:
        return length
    return walked(nodes, row, int(left if row[int(feature)] < cut else right), depth + 1)


def test_flat_trees_score_like_a_walk_by_hand(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(400, 3)), [[9, 9, 9]], np.zeros((5, 3))]
    forest = steady.forest_of(x, 7)
    trees = [forest[forest[:, 0] == k, 1:] for k in range(steady.TREES)]
    scores = steady.forest_scores(forest, x)
    norm = float(steady.path_length(np.array(steady.TREE_ROWS)))
    for i in (0, 17, 400, 401):
        assert scores[i] == pytest.approx(2 ** (-np.mean([walked(t, x[i]) for t in trees]) / norm))
    assert scores.argmax() == 400
    for t in trees[:5]:  # a leaf's length is its depth and the mean depth of the rows that ended in it
        assert all(n[4] >= 0 for n in t) and sum(n[0] >= 0 for n in t) + 1 == sum(n[0] < 0 for n in t)


def test_forest_takes_the_rows_of_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(steady, "TREES", 3)
    monkeypatch.setattr(steady, "TREE_ROWS", 20)
    rng = np.random.default_rng(4)
    v = np.r_[rng.uniform(0, 9, 200), 5 + 0.01 * rng.normal(size=600), rng.uniform(0, 9, 200)]
    r = many(spark, {("t", "p"): v})
    frames = np.lib.stride_tricks.sliding_window_view(v, 20)
    seq = np.arange(10, 10 + len(frames))
    x = np.c_[v[seq], frames.mean(1), frames.std(1, ddof=1)]
    hashes = np.array([h for (h,) in spark.createDataFrame([("t", int(q)) for q in seq], "test_id string, seq long").select(F.xxhash64("test_id", "seq")).collect()])
    scores = steady.forest_scores(steady.forest_of(x[np.sort(np.argsort(hashes)[:60])], 7), x)
    sampled = steady.forest_scores(steady.forest_of(x[np.argsort(hashes)[:60]], 7), x)
    found = []
    for s in (scores, sampled):  # the rows of the sample come in either order
        on = seq[s <= np.percentile(s, 60)]
        runs = np.split(on, np.flatnonzero(np.diff(on) > 6) + 1)
        best = max(runs, key=len)
        found.append((round(best[0] * 0.01, 9), round(best[-1] * 0.01, 9)))
    got = steady.steady_forest(r, ["p"], contamination=0.4).first()
    assert (round(got["start_s"], 9), round(got["end_s"], 9)) in found


def test_prominence_by_a_stack_equals_the_slow_rule(spark):
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=300), rng.integers(0, 4, 300).astype(float), np.zeros(20), np.arange(50.0)):
        left = spectral.bases(x)
        for i, v in enumerate(x):
            higher = np.flatnonzero(x[:i] > v)
            assert left[i] == x[(higher[-1] + 1 if len(higher) else 0) : i + 1].min()
    p = np.exp(rng.normal(size=(1, 400)))[0]
    rows = [("t", "c", k, float(k), float(v)) for k, v in enumerate(p)]
    got = {r["peak_k"]: r["prominence_db"] for r in spectral.resonances(spark.createDataFrame(rows, "test_id string, channel string, k long, freq_hz double, psd double")).collect()}
    db, want = 10 * np.log10(p), {}
    for i in range(1, 399):
        if db[i - 1] < db[i] > db[i + 1]:
            a, b = np.flatnonzero(db[:i] > db[i]), np.flatnonzero(db[i + 1 :] > db[i])
            low = max(db[(a[-1] if len(a) else 0) : i + 1].min(), db[i : (i + 1 + b[0] if len(b) else 400)].min())
            if db[i] - low >= 3:
                want[i] = db[i] - low
    assert got == pytest.approx(want)


def test_a_callers_functions_fail_by_test(spark):
    r = many(spark, {(t, c): np.arange(50) + k for k, t in enumerate("ABCD") for c in ("p", "q")})

    def measure(part, test):
        assert list(part["channel"].unique()) == ["p", "q"]
        if test == "B":
            raise KeyError("no such sensor")
        return {} if test == "C" else {"mean": part["value"].mean(), "top": (part["value"].max(), 0.5)}

    rows = analysis.user_batch(r, measure).collect()
    assert sorted((x["test_id"], x["name"], x["value"], x["u"]) for x in rows if x["name"]) == [("A", "mean", 24.5, None), ("A", "top", 49.0, 0.5), ("D", "mean", 27.5, None), ("D", "top", 52.0, 0.5)]
    failed = {x["test_id"]: x for x in rows if not x["success"]}
    assert set(failed) == {"B"} and failed["B"]["error"] == "KeyError: 'no such sensor'" and "measure" in failed["B"]["trace"]
    assert [x["success"] for x in rows if x["test_id"] == "C"] == [True]

    def detect(part):
        if part["test_id"].iloc[0] == "D":
            raise ValueError("odd")
        return None if part["test_id"].iloc[0] == "C" else (0.1, 0.3)

    roles = spark.createDataFrame([("p", "upstream_pressure"), ("q", "mass_flow")], "channel string, role string")
    specs = spark.createDataFrame([(c, "rel", 0.01, None) for c in "pq"], "channel string, u_type string, u_value double, full_scale double")
    out = {x["test_id"]: x for x in analysis.batch(r, roles, specs, uncertainty.COLD_FLOW, detect).collect()}
    assert out["A"]["success"] and out["B"]["success"] and out["A"]["avg_p_up_bar"] == pytest.approx(20.0)
    assert out["C"]["error"] == "detector: no steady window" and out["D"]["error"] == "detector: ValueError: odd" and not out["D"]["success"]


def test_a_detector_takes_each_tests_own_channel(spark):
    calm, ramp = [5.0] * 200, list(range(200))
    r = many(spark, {("A", "P1"): ramp[:100] + calm, ("A", "tank pressure"): calm + ramp[:100], ("B", "inlet pressure"): calm + ramp[:100], ("B", "flow"): ramp})
    roles = spark.createDataFrame([("A", "P1", "upstream_pressure")], "test_id string, channel string, role string")
    got = {x["test_id"]: (x["start_s"], x["end_s"]) for x in analysis.windows_of(r, "cv", None, roles).collect()}
    assert got["A"][0] > 0.9 and got["B"][1] < 2.1


def test_hot_fire_rows_say_whether_it_fired(spark):
    n = np.arange(400)
    run = np.clip(n - 50, 0, 100) / 100.0
    tests = {}
    for t, (top, late) in {"fired": (20.0, 0), "cold": (1.0, 0), "late": (20.0, 120)}.items():
        tests |= {(t, "pc"): top * run, (t, "f"): 250 * run, (t, "ox"): 100 * run, (t, "fu"): np.clip(n - 50 - late, 0, 100) / 100.0 * 40}
    r = many(spark, tests)
    roles = spark.createDataFrame([("pc", "chamber_pressure"), ("f", "thrust"), ("ox", "mass_flow_ox"), ("fu", "mass_flow_fuel")], "channel string, role string")
    specs = spark.createDataFrame([(c, "rel", 0.01, None) for c in ("pc", "f", "ox", "fu")], "channel string, u_type string, u_value double, full_scale double")
    out = {x["test_id"]: x for x in analysis.batch(r, roles, specs, uncertainty.HOT_FIRE, "simple", "pc").collect()}
    assert out["fired"]["success"] and out["fired"]["ignition_successful"] == 1 and out["late"]["ignition_successful"] == 1
    assert out["cold"]["error"] == "quality: ignition" and out["cold"]["ignition_successful"] == 0
    assert all(out["fired"][c] is None for c in ("avg_cf", "eta_c_star_pct", "eta_isp_pct", "total_impulse_ns"))
    lag = {x["test_id"]: (x["status"], round(x["metric"])) for x in uncertainty.HOT_FIRE.role_checks(analysis.by_role(r, roles))[2].collect()}
    assert lag == {"fired": ("PASS", 0), "cold": ("PASS", 0), "late": ("FAIL", 1200)}
    whole = qc.full_run(r, spark.createDataFrame([], "channel string, min double, max double, allow_negative boolean"), ["pc"], "pc", "ox", "pc", "f", "ox", "fu")
    assert {x["status"] for x in whole.where("check = 'propellant_lead_lag'").collect()} == {"PASS", "FAIL"}


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_an_upsert_leaves_other_campaigns_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(c, k * 10 + i, float(i), "old") for k, c in enumerate("ABC") for i in range(5)]
    campaigns.write_campaigns(spark.createDataFrame(rows, "campaign_name string, test_id long, avg_x double, part string"), path)
    before = files(path)
    changes = [(3, 1, {"part": "mid", "avg_x": "7.5"}), (3, 2, {"part": "new"}), (4, 1, {"avg_x": None, "campaign_name": "C", "unknown": "1"}), (99, 1, {"campaign_name": "D", "part": "new"})]
    df = spark.createDataFrame(changes, "test_id long, written_at int, values map<string,string>")
    for _ in range(2):  # a repeat gives the same store
        campaigns.upsert_store(spark, path, df)
        got = {r["test_id"]: (r["campaign_name"], r["avg_x"], r["part"]) for r in spark.read.parquet(path).collect()}
        want = {t: (c, x, p) for c, t, x, p in rows} | {3: ("A", 7.5, "new"), 4: ("A", None, "old"), 99: ("D", None, "new")}
        assert got == want
        after = files(path)
        assert {f: t for f, t in after.items() if "=B" in f} == {f: t for f, t in before.items() if "=B" in f}
    assert [f for f in os.listdir(tmp_path) if "staged" in f] == []
    campaigns.upsert_store(spark, path, df.limit(0))
    assert {r["test_id"]: (r["campaign_name"], r["avg_x"], r["part"]) for r in spark.read.parquet(path).collect()} == want
