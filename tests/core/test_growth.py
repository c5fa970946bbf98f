"""Steps whose cost grew faster than their input."""

from pyspark.sql import functions as F

from traceforge.operators import anomaly, spectral, steady, uncertainty
from traceforge.functions.blocks import percentiles
from traceforge.plans import analysis
from traceforge.queries import base, plans
from traceforge.sources import campaigns


def writers(path):
    return {f.name.split("-")[1] for f in path.rglob("part-*.parquet")}


def test_folders_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 40).cast("string").alias("campaign_name"), F.col("id").cast("string").alias("test_id"))
    campaigns.write_campaigns(rows, str(tmp_path / "store"))
    campaigns.save_analysis(rows, rows, str(tmp_path / "analysis"))
    assert len(writers(tmp_path / "store")) > 4
    assert len(writers(tmp_path / "analysis" / "results")) > 4
    campaigns.upsert_store(spark, str(tmp_path / "store"), rows.select("test_id", F.lit(1).alias("written_at"), F.create_map(F.lit("campaign_name"), F.lit("0")).alias("values")))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 400


def test_series_are_dealt_over_tasks_by_their_samples(spark, monkeypatch):
    monkeypatch.setattr(base, "TASK_ROWS", 20)
    sf = "/root/testdata/sf0.001"
    many = -(-base.table(spark, sf, "events").count() // 20)
    r = base.readings(spark, sf)
    assert r.rdd.getNumPartitions() == many
    assert percentiles(r, "value", {"mid": 0.5}).rdd.getNumPartitions() == many


def test_a_forest_is_grown_once_and_by_many_tasks(spark, tmp_path, monkeypatch):
    grow_one = steady.forest_of

    def counted(x, seed):
        from pyspark import TaskContext

        with open(tmp_path / "grown", "a") as f:
            f.write(f"{TaskContext.get().partitionId()}\n")
        return grow_one(x, seed)

    monkeypatch.setattr(steady, "TREES", 3)
    monkeypatch.setattr(steady, "forest_of", counted)
    r = spark.range(640).select(F.concat(F.lit("T"), (F.col("id") % 8).cast("string")).alias("test_id"), F.lit("p").alias("channel"), F.floor(F.col("id") / 8).alias("seq"), F.col("id").cast("double").alias("time_s"), F.sin("id").alias("value"))
    assert steady.steady_forest(r, ["p"], width=4).count() == 8
    grown = (tmp_path / "grown").read_text().split()
    assert len(grown) == 8 and len(set(grown)) > 1


def reads(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_detectors_share_one_chain_of_statistics(spark):
    r = base.readings(spark, "/root/testdata/sf0.001", True)
    assert reads(r) == 1
    assert reads(anomaly.spikes_and_dropouts(r)) == 1
    pairs = [("view", "click"), ("view", "error"), ("click", "error")]
    few, many = (reads(anomaly.detect_all(r, p, native_only=True)) for p in (pairs[:1], pairs))
    assert few == many <= 4


def test_spectra_and_flatlines_do_not_read_a_series_again_for_each_statistic(spark):
    r = base.readings(spark, "/root/testdata/sf0.001", True)
    assert reads(anomaly.oscillation(r)) == 1
    assert reads(anomaly.flatlines(r)) <= 3


def test_resonances_compute_a_spectrum_once(spark):
    lines = spectral.psd(base.readings(spark, "/root/testdata/sf0.001"), 1.0, 32)
    assert reads(lines) == 1
    found = spectral.resonances(lines)
    assert reads(found) == 1
    wide = spectral.bandwidth(lines, found.select("test_id", "channel", "peak_k"))
    differ = found.alias("f").join(wide.alias("w"), ["test_id", "channel", "peak_k"]).where("abs(f.left_hz - w.left_hz) > 1e-12 or abs(f.right_hz - w.right_hz) > 1e-12 or abs(f.bandwidth_hz - w.bandwidth_hz) > 1e-12")
    assert found.count() == wide.count() > 0 and differ.count() == 0


def test_a_batch_reads_the_samples_for_windows_means_checks_and_tests_only(spark):
    _, done = plans.run(spark, "/root/testdata/sf0.001")
    assert reads(done) == 4
    # no task holds the sorts and hash tables of more than one of them
    held = [0]

    def walk(node, at):
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            at = len(held)
            held.append(0)
        held[at] += name in ("SortExec", "HashAggregateExec", "ObjectHashAggregateExec", "SortAggregateExec")
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k), at)

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        walk(plans.run(spark, "/root/testdata/sf0.001")[1]._jdf.queryExecution().executedPlan(), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(held) > 4 and max(held) <= 8


def test_a_batch_counts_samples_once_under_any_roles(spark):
    rows = [(t, c, i, i * 0.01, v + 0.001 * i) for t in ("A", "B") for c, v in (("p", 20.0), ("q", 10.0), ("f", 12.0), ("other", 1.0)) for i in range(20) if (t, c) != ("B", "p")]
    r = spark.createDataFrame(rows, "test_id string, channel string, seq long, time_s double, value double")
    roles = spark.createDataFrame([("p", "upstream_pressure"), ("p", "tank_pressure"), ("q", "downstream_pressure"), ("f", "mass_flow")], "channel string, role string")
    specs = spark.createDataFrame([("p", "rel", 0.01, None)], "channel string, u_type string, u_value double, full_scale double")
    constants = spark.createDataFrame([(t, n, v, v / 50, 0.02) for t in ("A", "B", "C") for n, v in (("area_m2", 2e-6), ("density", 998.2))], "test_id string, role string, value double, u double, rel double")
    out = {x["test_id"]: x for x in analysis.batch(r, roles, specs, uncertainty.COLD_FLOW, "simple", "p", constants).collect()}
    assert set(out) == {"A", "B"} and out["A"]["n_samples"] == 80 and out["A"]["avg_cd"] > 0 and out["A"]["success"]
    assert out["B"]["error"] == "no metrics" and out["B"]["n_samples"] is None and out["B"]["qc_status"] == "PASS"
