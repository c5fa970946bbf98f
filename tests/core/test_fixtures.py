"""Hand-made cases: planted events, properties and edge cases."""

import gzip
import hashlib
import math
import random
from collections import Counter
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceforge.operators import anomaly, audit, compare, phases, prep, qc, spc, spectral, steady, uncertainty
from traceforge.queries import anomaly as anomaly_queries
from traceforge.queries import queries
from traceforge.sources import campaigns, recordings


def series(spark, values, channel="P", test="t", step=0.01):
    rows = [(test, channel, i, i * step, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "test_id string, channel string, seq long, time_s double, value double")


def values(df):
    return [r["value"] for r in df.orderBy("seq").collect()]


def test_gap_fill_follows_the_limit(spark):
    x = [None, 1, None, None, 4, None, None, None, None, None, None, None, 12, None]
    assert values(prep.fill_gaps(series(spark, x), 5)) == [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, None, None, 12, 12]
    long_only = [1, None, None, None, 5]
    assert values(prep.fill_gaps(series(spark, long_only), 2)) == [1, None, None, None, 5]
    assert values(prep.fill_all(series(spark, [None, 1, None, 3, None]))) == [1, 1, 2, 3, 3]
    assert values(prep.carry(series(spark, [None, 1, None, 3]))) == [1, 1, 1, 3]


def test_resample_is_linear(spark):
    out = prep.resample(series(spark, [0, 10, 20], step=1.0), 4.0)
    assert values(out) == [0, 2.5, 5, 7.5, 10, 12.5, 15, 17.5]


def test_time_normalisation_keeps_the_first(spark):
    raw = spark.createDataFrame([("t", "P", 0, 20, 1.0), ("t", "P", 1, 10, 2.0), ("t", "P", 2, 20, 3.0)], "test_id string, channel string, seq long, timestamp long, value double")
    assert [(r["seq"], r["time_s"], r["value"]) for r in prep.normalise_time(raw).orderBy("seq").collect()] == [(0, 0.0, 2.0), (1, 0.01, 1.0)]


def status(df):
    return df.first()["status"]


def test_quality_checks(spark):
    rng = np.random.default_rng(0)
    good = series(spark, 25 + 0.2 * rng.normal(size=300))
    assert status(qc.timestamps_increase(good)) == "PASS" and status(qc.flatline(good)) == "PASS" and status(qc.missing(good)) == "PASS"
    assert status(qc.flatline(series(spark, [5.0] * 200))) == "FAIL"
    assert status(qc.missing(series(spark, [1.0, None, None]))) == "FAIL"
    assert status(qc.rate_stability(series(spark, [1, 2, 3]))) == "SKIP"
    back = good.withColumn("time_s", F.when(F.col("seq") == 9, 0.0).otherwise(F.col("time_s")))
    assert status(qc.timestamps_increase(back)) == "FAIL" and qc.violations(back).first()["first"] == [9]
    assert status(qc.saturation(series(spark, list(range(20)) + [30] * 20))) == "FAIL"
    assert status(qc.ignition(series(spark, [0, 1, 3]), "P")) == "PASS" and status(qc.ignition(series(spark, [0, 1]), "P")) == "FAIL"
    assert status(qc.combustion_stability(series(spark, [20.0, 20.5] * 100), "P")) == "PASS"
    specs = spark.createDataFrame([("P", 0.0, 24.0, True)], "channel string, min double, max double, allow_negative boolean")
    checks = qc.sensor_range(good, specs)
    assert status(checks) == "FAIL" and qc.gate(good, checks).count() == 0
    assert qc.summary(checks).first()["passed"] is False


def test_full_run_equals_the_single_checks(spark):
    rng = np.random.default_rng(8)
    x = [None if i % 11 == 3 else float(v) for i, v in enumerate(rng.normal(size=140))]
    r = series(spark, x, "A").unionByName(series(spark, [4.0] * 120, "B")).unionByName(series(spark, [None] * 5, "C"))
    specs = spark.createDataFrame([("A", -1.0, 1.0, True), ("C", 0.0, None, False)], "channel string, min double, max double, allow_negative boolean")
    own = r.where("channel in ('A', 'C')")
    parts = [qc.timestamps_increase(r), qc.timestamp_gaps(r), qc.rate_stability(r), qc.sensor_range(r, specs), qc.flatline(own), qc.saturation(own), qc.missing(own), qc.correlated(r, "A", "B")]
    key = lambda df: sorted((x["check"], x["channel"], x["status"], x["blocking"], x["metric"] is None or round(x["metric"], 9)) for x in df.collect())
    assert key(qc.full_run(r, specs, ["A", "C"], "A", "B")) == sorted(k for p in parts for k in key(p))


def test_steady_windows(spark):
    rng = np.random.default_rng(1)
    x = np.r_[np.linspace(0, 25, 200), 25 + 0.1 * rng.normal(size=600), np.linspace(25, 0, 200)]
    r = series(spark, x)
    w = steady.steady_cv(r, "P").first()
    assert 1.9 < w["start_s"] < 2.4 and 7.6 < w["end_s"] < 8.2
    assert steady.steady_auto(r, "P").first()["method"] == "cv"
    assert steady.validate(r, steady.steady_cv(r, "P"), "P").first()["valid"]
    m = steady.steady_middle(r, "P").first()
    assert (m["start_s"], m["end_s"]) == (2.5, 7.5)
    assert steady.steady_cv(series(spark, 25 + 10 * np.sin(np.arange(500) / 30)), "P").count() == 0
    f = steady.steady_forest(r, ["P"]).first()
    assert 0 <= f["start_s"] < f["end_s"] <= 9.99


def test_planted_anomalies(spark):
    rng = np.random.default_rng(2)
    x = 100 + 2 * rng.normal(size=1000)
    x[200], x[500:510], x[700:750] = 150, 0.0, 99.0
    r = series(spark, x)
    spike = anomaly.spikes(r).where("start_seq = 200").first()
    assert spike["n"] == 1 and anomaly.dropouts(r).first()["start_seq"] == 500
    flat = anomaly.flatlines(r).where("n = 50").first()
    assert (flat["start_seq"], flat["end_seq"]) == (700, 749)
    t = np.arange(1000) * 0.01
    assert anomaly.oscillation(series(spark, 100 + 5 * np.sin(2 * np.pi * 2 * t))).first()["score"] > 0.9
    assert anomaly.drift(series(spark, 100 + np.linspace(0, 20, 500) + rng.normal(size=500))).count() == 1
    assert anomaly.spikes(series(spark, [1.0] * 50)).count() == 0
    found = anomaly.detect_all(r, [])
    assert 0 <= anomaly.sensor_health(r, found).first()["health"] < 1


def test_steady_forest_sees_a_sixth_channel(spark):
    rng = np.random.default_rng(9)
    calm = {c: 10 + 0.1 * rng.normal(size=400) for c in "ABCDE"}
    last = np.r_[np.linspace(500, 10, 100), 10 + 0.1 * rng.normal(size=300)]
    r = reduce(DataFrame.unionByName, [series(spark, x, c) for c, x in (calm | {"F": last}).items()])
    five, six = (steady.steady_forest(r, list(c)).collect() for c in ("ABCDE", "ABCDEF"))
    assert six != five


def test_health_and_report_take_every_detector(spark, monkeypatch):
    rng = np.random.default_rng(8)
    t = np.arange(600)
    planted = {
        "click": 100 + 5 * np.sin(2 * np.pi * t / 50),
        "error": np.r_[100 + rng.normal(size=300), np.full(300, 103.0)],
        "purchase": 100 + t / 20 + 0.1 * rng.normal(size=600),
        "signup": np.minimum(100 + 2 * rng.normal(size=600), 101.0),
        "view": 100 + rng.normal(size=600),
    }
    r = reduce(DataFrame.unionByName, [series(spark, x, c) for c, x in planted.items()]).cache()
    monkeypatch.setattr(anomaly_queries, "readings", lambda *_: r)
    known = queries()
    found = anomaly.detect_all(r, [(a, b) for a in planted for b in planted if a < b]).collect()
    health = {x["channel"]: x["health"] for x in known["a9_sensor_health_all"](spark, "").collect()}

    def size(channel, *kinds):
        return sum(x["n"] for x in found if x["channel"] == channel and x["kind"] in kinds) / 600

    for c in planted:
        spikes = 100 * sum(x["channel"] == c and x["kind"] == "spike" for x in found) / 600
        flat = size(c, "flatline")
        wave = max((x["score"] for x in found if x["channel"] == c and x["kind"] == "oscillation"), default=0)
        lost = (min(0.1 * spikes, 0.2) if spikes > 0.1 else 0) + min(3 * size(c, "dropout"), 0.4) + (min(0.5 * flat, 0.3) if flat > 0.1 else 0)
        lost += min(2 * size(c, "saturation_high", "saturation_low"), 0.3) + 0.1 * (size(c, "drift") > 0) + 0.1 * (wave > 0.5)
        assert health[c] == pytest.approx(1 - min(lost, 1), abs=1e-7), c
    assert max(health[c] for c in ("click", "error", "purchase", "signup")) < 1
    counts = Counter((x["channel"], x["kind"], x["severity"]) for x in found)
    assert {(x["channel"], x["kind"], x["severity"]): x["n_intervals"] for x in known["a11_r12_report_all"](spark, "").collect()} == counts
    assert Counter((x["channel"], x["kind"], x["severity"]) for x in known["a10_severity_all"](spark, "").collect()) == counts
    assert {"flatline", "saturation_high", "drift", "oscillation"} <= {k for _, k, _ in counts}


def test_statistical_takes_the_t_table_for_small_dof(spark):
    rng = np.random.default_rng(7)
    known = {1: 12.706, 4: 2.776, 28: 2.048, 29: 2.045, 30: 1.96}
    samples = {d: rng.normal(size=d + 1) for d in known} | {0: np.ones(1)}
    rows = [(str(d), float(x)) for d, xs in samples.items() for x in xs]
    got = {int(r["channel"]): r for r in uncertainty.statistical(spark.createDataFrame(rows, "channel string, value double"), "value", "channel").collect()}
    assert math.isinf(got[0]["u_stat"])
    for d, k in known.items():
        assert got[d]["n"] == d + 1 and got[d]["u_stat"] == pytest.approx(k * np.std(samples[d], ddof=1) / math.sqrt(d + 1), rel=1e-3)


def test_whole_table_queries_leave_no_row_out(spark):
    sf, known = "/root/testdata/sf0.001", queries()
    orders, events = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("orders", "events"))
    assert known["u10_statistical"](spark, sf).agg(F.sum("n")).first()[0] == events
    assert known["s8_campaign_read"](spark, sf).count() == orders
    assert known["u11_u12_combined_expanded"](spark, sf).agg(F.sum(F.col("dof") + 1)).first()[0] == orders
    assert {r[0] for r in known["m9_deviation_tracking"](spark, sf).select("parameter").distinct().collect()} > {"avg_price"}


def test_phases_of_a_run(spark):
    rng = np.random.default_rng(3)
    x = np.r_[np.zeros(200), np.linspace(0, 30, 200), 30 + 0.1 * rng.normal(size=1000), np.linspace(30, 0, 200), np.zeros(400)]
    found = phases.phases(phases.segment(series(spark, x)))
    assert [r["phase"] for r in found.orderBy("phase_no").collect()] == ["PRETEST", "STARTUP", "STEADY", "SHUTDOWN", "COOLDOWN"]
    steady_row = phases.phase_metrics(series(spark, x), found).where("phase = 'STEADY'").first()
    assert abs(steady_row["mean"] - 30) < 0.5 and steady_row["within_2_pct"] > 90
    assert {r["phase"] for r in phases.segment(series(spark, [5.0] * 30)).collect()} == {"STEADY"}
    assert {r["phase"] for r in phases.segment(series(spark, [None] * 30)).collect()} == {"PRETEST"}
    up = phases.startup(series(spark, np.r_[np.zeros(50), np.linspace(0, 10, 101), 10 * np.ones(100)])).first()
    assert abs(up["rise_s"] - 0.8) < 0.02 and up["overshoot_pct"] == 0


def test_spectra(spark):
    t = np.arange(2048) / 1000
    r = series(spark, 5 * np.sin(2 * np.pi * 125 * t) + 2 * np.sin(2 * np.pi * 250 * t), step=0.001)
    s = spectral.psd(r, 1000.0)
    top = spectral.spectrum_summary(s).first()
    assert abs(top["dominant_hz"] - 125) < 2 and abs(top["total_power"] - (12.5 + 2)) < 1
    h = {x["harmonic"]: x["freq_hz"] for x in spectral.harmonics(s, spectral.spectrum_summary(s)).collect()}
    assert h[1] == 125 and h[2] == 250
    assert spectral.resonances(s).orderBy(F.desc("psd")).first()["freq_hz"] == 125
    noise = np.random.default_rng(0).normal(size=4096)
    area = spectral.spectrum_summary(spectral.psd(series(spark, noise, step=0.001), 1000.0)).first()["total_power"]
    assert abs(area - noise.var()) < 0.1  # Parseval
    phase = math.pi / 4
    two = series(spark, np.sin(2 * np.pi * 125 * t), "A").unionByName(series(spark, np.sin(2 * np.pi * 125 * t + phase), "B"))
    line = spectral.cross_spectrum(two, "A", "B", 1000.0).where("freq_hz = 125").first()
    assert line["coherence"] > 0.99 and abs(line["phase"] - phase) < 0.05
    gram = spectral.spectrogram(r, 1000.0).groupBy("segment").agg(F.max_by("freq_hz", "power").alias("f"))
    assert {x["f"] for x in gram.where("segment between 2 and 12").collect()} == {125.0}


def points(spark, x):
    rows = [("c", "p", f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", i, float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "campaign_name string, parameter string, ts string, test_id long, value double").select("campaign_name", "parameter", F.to_timestamp("ts").alias("test_timestamp"), "test_id", "value")


def test_control_charts(spark):
    rng = random.Random(5)
    x = [rng.gauss(50, 1) for _ in range(25)] + [rng.gauss(52, 1) for _ in range(25)]
    p = points(spark, x)
    lim = spc.imr_limits(p).first()
    mr = [abs(a - b) for a, b in zip(x, x[1:])]
    sigma = sum(mr) / len(mr) / 1.128
    assert math.isclose(lim["sigma"], sigma) and math.isclose(lim["ucl"], sum(x) / 50 + 3 * sigma)
    up = down = 0.0
    want = []
    for v in x:
        up, down = max(0.0, up + v - sum(x) / 50 - 0.5 * sigma), max(0.0, down - v + sum(x) / 50 - 0.5 * sigma)
        want.append((up, down))
    got = [(r["c_plus"], r["c_minus"]) for r in spc.cusum(p).orderBy("i").collect()]
    assert np.allclose(got, want)
    z, ew = sum(x) / 50, []
    for v in x:
        z = 0.2 * v + 0.8 * z
        ew.append(z)
    assert np.allclose([r["ewma"] for r in spc.ewma(p).orderBy("i").collect()], ew)
    flat = [10.0, 10.1] * 6
    rules = {r["i"]: r["rules"] for r in spc.run_rules(points(spark, flat + [10.0, 10.1, 10.0, 12.0])).collect()}
    assert "14_alternating" in rules[14] and "beyond_3_sigma" in rules[15]
    trend = {r["i"]: r["rules"] for r in spc.run_rules(points(spark, [5, 1, 2, 3, 4, 5, 6])).collect()}
    assert "6_trend" in trend[6] and "6_trend" not in trend[5]
    cap = spc.capability(p, spc.spec_table(spark, [("p", 40.0, 60.0, None)])).first()
    assert math.isclose(cap["cp"], 20 / (6 * sigma)) and cap["verdict"] is not None


def test_uncertainty(spark):
    assert abs(uncertainty.t_quantile(0.975, 1) - 12.7062) < 1e-3 and abs(uncertainty.t_quantile(0.975, 10) - 2.22814) < 1e-4 and abs(uncertainty.t_quantile(0.995, 5) - 4.03214) < 1e-4
    rows = [("t", n, 1.0, u) for n, u in (("a", 3.0), ("b", 4.0))]
    inputs = spark.createDataFrame(rows, "test_id string, name string, sensitivity double, u double")
    assert uncertainty.propagate(inputs).first()["u"] == 5.0
    full = spark.createDataFrame([("a", "b", 1.0)], "a string, b string, r double")
    assert uncertainty.propagate(inputs, full).first()["u"] == 7.0
    mc = spark.createDataFrame([("t", 10.0, 0.1, 2.0, 0.02)], "test_id string, x double, u_x double, y double, u_y double")
    got = uncertainty.monte_carlo(mc, ["x", "y"], F.col("x") / F.col("y"), 20_000).first()
    assert abs(got["mean"] - 5) < 0.01 and abs(got["std"] - 5 * math.hypot(0.01, 0.01)) < 0.003 and abs(got["k95"] - 1.96) < 0.08
    shown = spark.createDataFrame([(1234.5678, 0.0456), (10.0, 12.0)], "v double, u double").select(uncertainty.shown(F.col("v"), F.col("u")).alias("s")).collect()
    assert [r["s"] for r in shown] == ["1234.568 ± 0.046", "10 ± 12"]


def test_regression_and_golden(spark):
    df = spark.createDataFrame([("c", float(i), 2.0 * i + 1) for i in range(10)], "campaign_name string, x double, y double")
    fit = compare.regression(df, "x", "y", "campaign_name").first()
    assert math.isclose(fit["slope"], 2) and math.isclose(fit["intercept"], 1) and math.isclose(fit["r2"], 1) and fit["slope_se"] < 1e-7
    long = points(spark, [10, 10.1, 9.9, 10.05, 9.95])
    golden = compare.golden_from_campaign(long).first()
    assert math.isclose(golden["value"], 10) and golden["tol_pct"] > 1
    assert compare.golden_from_campaign(points(spark, [1, 2, 3])).count() == 0


def test_recordings_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('timestamp,P,"T,1"\n0,1.5,20\n10,,21\n\n20,x,"22"\n')
    (tmp_path / "b.csv").write_text("F\n7\n8\n")
    rows = {(r["test_id"], r["channel"], r["seq"]): (r["timestamp"], r["value"]) for r in recordings.read_recordings(spark, str(tmp_path)).collect()}
    assert rows[("a", "P", 0)] == (0.0, 1.5) and rows[("a", "P", 1)] == (10.0, None) and rows[("a", "P", 2)] == (20.0, None)
    assert rows[("a", "T,1", 2)] == (20.0, 22.0) and rows[("b", "F", 1)] == (10.0, 8.0) and len(rows) == 8
    assert [r["path"].rsplit("/", 1)[1] for r in recordings.discover(spark, str(tmp_path)).collect()] == ["a.csv", "b.csv"]


def test_a_recording_of_many_splits_keeps_its_order(spark, tmp_path):
    (tmp_path / "long.csv").write_text("\ufefftimestamp,P\r\n" + "".join(f"{10 * i},{i}\r\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = recordings.read_recordings(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["seq"], r["timestamp"], r["value"], r["channel"]) for r in rows] == [(i, 10.0 * i, float(i), "P") for i in range(5000)]


def test_metadata_scan(spark, tmp_path):
    (tmp_path / "T-1").mkdir()
    (tmp_path / "T-1" / "metadata.json").write_text('{"system": "S", "extra": 1, "geometry": {"d_mm": 2.5}}')
    r = recordings.read_metadata(spark, str(tmp_path)).first()
    assert r["test_id"] == "T-1" and r["status"] == "pending" and r["geometry"] == {"d_mm": 2.5} and '"extra"' in r["raw"]


def test_metadata_scan_writes_a_file_a_row(spark, tmp_path):
    """Customers that share a key have a file each; the whole text comes back, with letters and breaks of any kind."""
    rows = [(3, "A", 1.0), (3, "B", 2.0), (4, "Ü\n\"", 3.0), (4, "Ü\n\"", 3.0), (5, None, None)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = [tuple(r) for r in queries()["s4_metadata_scan"](spark, str(tmp_path)).collect()]
    want = [("folder=F3", "pending", "A", 1.0), ("folder=F3", "pending", "B", 2.0), ("C4", "complete", "Ü\n\"", 3.0), ("C4", "complete", "Ü\n\"", 3.0), ("C5", "pending", None, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    spark.createDataFrame([], "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "none" / "customer.parquet"))
    assert queries()["s4_metadata_scan"](spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("glob", ["*", "*.json.gz"])
def test_metadata_scan_decompresses(spark, tmp_path, glob):
    (tmp_path / "T-1").mkdir()
    (tmp_path / "T-1" / "metadata.json.gz").write_bytes(gzip.compress(b'{"system": "S"}'))
    r = recordings.read_metadata(spark, str(tmp_path), glob).first()
    assert (r["test_id"], r["system"]) == ("T-1", "S")


def test_campaign_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("A", 1, "2024-01-02", 1.0, True), ("A", 2, "2024-01-03", 2.0, False), ("B", 3, "2024-01-01", 3.0, True)]
    df = spark.createDataFrame(rows, "campaign_name string, test_id long, d string, avg_x double, qc_passed boolean").withColumn("test_timestamp", F.to_timestamp("d")).drop("d")
    campaigns.write_campaigns(df, path)
    campaigns.write_campaigns(df.where("campaign_name = 'A'").withColumn("avg_x", F.col("avg_x") * 10), path)
    assert [r["avg_x"] for r in campaigns.read_campaign(spark, path, "A").collect()] == [20.0, 10.0]
    assert campaigns.read_campaign(spark, path, "B").count() == 1
    manifest = campaigns.qualification_package(df, str(tmp_path / "package"))
    assert {r["name"]: r["rows"] for r in manifest.collect()} == {"summary": 3, "full": 3, "provenance": 3}
    campaigns.export_parquet(df, str(tmp_path / "out"), "gzip")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    hashes = audit.file_hashes(spark, path, "*.parquet")
    assert all(r["hash"].startswith("sha256:") for r in hashes.collect())


def test_hashes_of_large_files(spark, tmp_path):
    """Files over the size of one value are hashed as they are: breaks of all kinds, compressed ones, names with signs, no ending."""
    rng = np.random.default_rng(7)
    noise = rng.integers(0, 256, 300_000, np.uint8).tobytes()
    contents = {
        "a.parquet": noise, "b.parquet": noise + b"\n", "c.csv": b"\xef\xbb\xbft,p\r\n1,2\r\n" * 900, "d.csv": b"\xef\xbb\xbf" + noise, "e.gz": gzip.compress(noise),
        "f": noise[::-1], "g": b"\n" * 9000, "h+ %41.txt": b"x\n\n" * 900, "i. odd": noise[:5000] + b"\n\n", "j.zst": noise, "small.txt": b"s",
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        hashes = audit.file_hashes(spark, str(tmp_path), whole=1000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["path"].rpartition("/")[2]: r["hash"] for r in hashes} == {n: "sha256:" + hashlib.sha256(c).hexdigest() for n, c in contents.items()}
    assert len(hashes) == len(contents)
    plain = audit.file_hashes(spark, str(tmp_path)).collect()
    assert sorted(plain) == sorted(hashes)


@pytest.mark.parametrize("given", [None, {"part": "x"}])
def test_upsert_partial_columns(spark, given):
    store = spark.createDataFrame([("t1", 1.0, "a")], "test_id string, v double, part string")
    change = spark.createDataFrame([("t1", 1, given)], "test_id string, written_at int, values map<string,string>")
    row = campaigns.upsert(store, change).first()
    assert (row["v"], row["part"]) == (1.0, "x" if given else "a")


def test_batch_export_and_saved_analysis(spark, tmp_path):
    rows = [("t1", True, None, "cd", 0.6, 0.01), ("t1", True, None, "dp", 5.0, 0.1), ("t2", False, "quality", None, None, None)]
    out = spark.createDataFrame(rows, "test_id string, success boolean, error string, name string, value double, u double")
    for fmt in ("csv", "json"):
        campaigns.export_batch(out, ["cd", "dp"], str(tmp_path / fmt), fmt)
    back = {r["test_id"]: r for r in spark.read.json(str(tmp_path / "json")).collect()}
    assert back["t1"]["cd"] == 0.6 and back["t1"]["dp_u"] == 0.1 and back["t2"]["error"] == "quality"
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    r = series(spark, [1, 2, 3])
    campaigns.save_analysis(r, r.groupBy("test_id").agg(F.avg("value").alias("avg_x")), str(tmp_path / "saved"))
    assert spark.read.parquet(str(tmp_path / "saved" / "processed")).count() == 3
    assert spark.read.parquet(str(tmp_path / "saved" / "results")).first()["avg_x"] == 2.0


def test_wide_recordings_become_long(spark):
    wide = spark.createDataFrame([("t", 10.0, 1, "x"), ("t", 0.0, 2, "y")], "test_id string, time double, P int, note string")
    assert prep.time_column(wide) == "time" and prep.numeric_columns(wide) == ["P"]
    assert [(r["channel"], r["seq"], r["timestamp"], r["value"]) for r in prep.wide_to_long(wide).orderBy("seq").collect()] == [("P", 0, 0.0, 2.0), ("P", 1, 10.0, 1.0)]


def test_flatlines_against_windows_taken_one_by_one(spark):
    """The greedy rule with each variance taken around its own mean, on a level where sums of squares would lose it."""
    rng = np.random.default_rng(3)
    x = 1e6 + 3000 * rng.normal(size=400)
    x[50:90], x[120:150], x[300:312] = 1e6, 1e6 + np.arange(30) * 1e-4, 5.0
    x[130] = np.nan
    found, i = [], 0
    while i + 10 <= len(x):
        if not (np.isfinite(x[i : i + 10]).all() and x[i : i + 10].var() < 1e-6):
            i += 1
            continue
        j = i + 10
        while j < len(x) and np.isfinite(x[j]) and x[i : j + 1].var() < 1e-6:
            j += 1
        found.append((i, j - 1))
        i = j
    got = anomaly.flatlines(series(spark, [None if np.isnan(v) else float(v) for v in x])).orderBy("start_seq").collect()
    assert [(r["start_seq"], r["end_seq"]) for r in got] == found and (50, 89) in found


def test_steady_channel_by_role_then_by_name(spark):
    rows = [(t, c, i, i * 0.01, 1.0) for t, c in (("A", "P1"), ("A", "tank pressure"), ("B", "Pressure 2"), ("B", "flow"), ("C", "flow")) for i in range(3)]
    r = spark.createDataFrame(rows, "test_id string, channel string, seq long, time_s double, value double")
    roles = spark.createDataFrame([("P1", "upstream_pressure")], "channel string, role string")
    assert {x["test_id"]: x["channel"] for x in steady.steady_channel(r, roles).collect()} == {"A": "P1", "B": "Pressure 2"}
    assert {x["test_id"]: x["channel"] for x in steady.steady_channel(r).collect()} == {"A": "tank pressure", "B": "Pressure 2"}


def test_a_familys_own_checks_stop_a_test(spark):
    from dataclasses import replace

    from traceforge.operators import uncertainty
    from traceforge.plans import analysis

    rows = [(t, c, i, i * 0.01, v + 0.001 * i) for t, top in (("A", 1.0), ("B", 9.0)) for c, v in (("p", 20.0 + top), ("q", 10.0), ("f", 12.0)) for i in range(100)]
    r = spark.createDataFrame(rows, "test_id string, channel string, seq long, time_s double, value double")
    roles = spark.createDataFrame([("p", "upstream_pressure"), ("q", "downstream_pressure"), ("f", "mass_flow")], "channel string, role string")
    specs = spark.createDataFrame([(c, "rel", 0.01, None) for c in "pqf"], "channel string, u_type string, u_value double, full_scale double")
    limits = spark.createDataFrame([("p", None, 25.0, True)], "channel string, min double, max double, allow_negative boolean")
    family = replace(uncertainty.COLD_FLOW, checks=lambda x: [qc.sensor_range(x, limits)])
    out = {x["test_id"]: (x["success"], x["error"]) for x in analysis.batch(r, roles, specs, family, "simple", "p").collect()}
    assert out == {"A": (True, None), "B": (False, "quality: sensor_range")}
    assert all(x["success"] for x in analysis.batch(r, roles, specs, uncertainty.COLD_FLOW, "cv", "p").collect())
