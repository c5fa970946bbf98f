"""Source, campaign-store and pipeline queries."""

from pyspark.sql import functions as F

from traceforge.operators import prep, qc, uncertainty
from traceforge.plans import analysis
from traceforge.queries.base import GAPPED, RAW, RESULTS, a_file_a_row, query, readings, results, rounded, scratch, table
from traceforge.queries.uncertainty import AREA, COLD_ROLES, RHO, SPEC_SQL, U_AREA, U_RHO, specs
from traceforge.sources import campaigns, recordings


@query("s3_test_id_from_path", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'run' || o_orderkey ELSE 'file' || o_orderkey END AS test_id FROM orders")
def s3(spark, sf):
    i = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(i, F.when(i % 2 == 0, F.concat(F.lit("/data/run"), i, F.lit("/raw.csv"))).otherwise(F.concat(F.lit("/data/x/file"), i, F.lit(".csv"))).alias("path"))
    return o.select("o_orderkey", recordings.test_id_of(F.col("path"), r"/(run\d+)/").alias("test_id"))


def files(spark, sf):
    """Three files per order: system = status, campaign = priority, test = order key."""
    o = table(spark, sf, "orders")
    folder = F.concat_ws("/", F.lit("root"), "o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string"))
    names = F.array(F.when(F.col("o_orderkey") % 3 != 0, F.lit("metadata.json")), F.lit("b_raw.csv"), F.lit("a.csv"))
    return o.select(F.col("o_orderkey").alias("test_id"), folder.alias("folder"), F.explode(F.array_compact(names)).alias("file")).select("test_id", F.concat_ws("/", "folder", "file").alias("path"))


@query("s5_pick_raw_file", "SELECT o_orderkey AS test_id, 'root/' || o_orderstatus || '/' || o_orderpriority || '/' || o_orderkey || '/b_raw.csv' AS path FROM orders")
def s5(spark, sf):
    return recordings.pick_raw_file(files(spark, sf).where("path like '%.csv'"))


@query("s6_catalog", "SELECT o_orderstatus AS system, count(DISTINCT o_orderpriority) AS n_campaigns, count(*) AS n_tests, CAST(count_if(o_orderkey % 3 <> 0) AS BIGINT) AS n_with_metadata FROM orders GROUP BY 1")
def s6(spark, sf):
    return recordings.catalog_counts(recordings.catalog(files(spark, sf).select("path")))


@query("s7_next_run", "SELECT o_orderstatus AS system, o_orderpriority AS campaign, 'CF' AS kind, lpad(CAST(coalesce(max(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 900 END), 0) + 1 AS VARCHAR), 3, '0') AS next_run FROM orders GROUP BY ALL")
def s7(spark, sf):
    i = F.col("o_orderkey")
    t = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("system"), F.col("o_orderpriority").alias("campaign"), F.lit("CF").alias("kind"), F.when(i % 5 != 0, (i % 900).cast("string")).otherwise("draft").alias("run"))
    return recordings.next_run(t)


@query("s8_campaign_read", f"WITH {RESULTS} SELECT campaign_name, row_number() OVER (PARTITION BY campaign_name ORDER BY test_timestamp DESC, test_id) AS position, test_id, avg_price FROM results")
def s8(spark, sf):
    return campaigns.positions(results(spark, sf)).select("campaign_name", "position", "test_id", "avg_price")


@query("s9_campaign_listing", f"WITH {RESULTS}, c AS (SELECT DISTINCT c_mktsegment || '-' || (c_custkey // 100) AS campaign_name FROM customer UNION ALL SELECT 'EMPTY-0') SELECT campaign_name, count(test_id) AS n_tests FROM c LEFT JOIN results USING (campaign_name) GROUP BY ALL")
def s9(spark, sf):
    c = table(spark, sf, "customer").select(F.concat("c_mktsegment", F.lit("-"), F.floor(F.col("c_custkey") / 100)).alias("campaign_name")).distinct()
    return campaigns.list_campaigns(c.unionByName(spark.createDataFrame([("EMPTY-0",)], "campaign_name string")), results(spark, sf)).select("campaign_name", "n_tests")


@query("s10_system_union", f"WITH {RESULTS} SELECT test_id, 'cold_flow' AS campaign_type, avg_price, NULL::DOUBLE AS avg_balance FROM results WHERE status = 'F' AND qc_passed UNION ALL SELECT test_id, 'hot_fire', NULL, avg_balance FROM results WHERE status = 'O' AND qc_passed")
def s10(spark, sf):
    r = results(spark, sf)
    a, b = r.where("status = 'F'").select("test_id", "qc_passed", "avg_price"), r.where("status = 'O'").select("test_id", "qc_passed", "avg_balance")
    return campaigns.system_union([(a, "cold_flow"), (b, "hot_fire")], True).select("test_id", "campaign_type", "avg_price", "avg_balance")


@query("s11_upsert", """SELECT coalesce(a.o_orderkey, b.o_orderkey + 100000000) AS test_id, CASE WHEN b.o_orderkey % 4 = 0 AND a.o_orderkey IS NOT NULL THEN NULL WHEN a.o_orderkey IS NULL THEN '7.5' ELSE CAST(a.o_totalprice AS VARCHAR) END IS NULL AS price_null, CASE WHEN a.o_orderkey IS NULL OR a.o_orderkey % 2 = 0 THEN 'new' ELSE a.o_orderpriority END AS part
  FROM orders a FULL JOIN (SELECT o_orderkey, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0) b ON a.o_orderkey = b.k UNION ALL SELECT o_orderkey + 100000000, false, 'new' FROM orders WHERE o_orderkey % 50 = 0""")
def s11(spark, sf):
    i = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    store = o.select(i.alias("test_id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("part"))
    old = o.where(i % 2 == 0).select(i.alias("test_id"), F.lit(1).alias("written_at"), F.create_map(F.lit("part"), F.lit("older"), F.lit("unknown"), F.lit("x")).alias("values"))
    new = o.where(i % 2 == 0).select(i.alias("test_id"), F.lit(2).alias("written_at"), F.when(i % 4 == 0, F.create_map(F.lit("part"), F.lit("new"), F.lit("price"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("part"), F.lit("new"))).alias("values"))
    added = o.where(i % 50 == 0).select((i + 100000000).alias("test_id"), F.lit(1).alias("written_at"), F.create_map(F.lit("part"), F.lit("new"), F.lit("price"), F.lit("7.5")).alias("values"))
    done = campaigns.upsert(store, old.unionByName(new).unionByName(added))
    return done.select("test_id", F.col("price").isNull().alias("price_null"), "part")


@query("s12_schema_evolution", f"""WITH {RESULTS} SELECT campaign_name, CAST(test_id AS VARCHAR) AS test_id, test_timestamp, part, status, avg_price, avg_balance, u_price, qc_passed, """ + ", ".join(f"CAST(NULL AS {t}) AS {c}" for t, names in (("VARCHAR", "serial_num raw_data_hash config_hash detection_method analyst_username processing_version"), ("DOUBLE", "steady_start_s steady_end_s avg_p_up_bar u_p_up_bar avg_mf_g_s u_mf_g_s avg_dp_bar u_dp_bar avg_cd u_cd")) for c in names.split()) + " FROM results")
def s12(spark, sf):
    return campaigns.migrated(results(spark, sf).withColumn("test_id", F.col("test_id").cast("string")), campaigns.schema_of("cold_flow"))


def outcomes(spark, sf):
    r = results(spark, sf)
    ok = F.col("test_id") % 6 != 0
    rows = [r.select("test_id", ok.alias("success"), F.lit(n).alias("name"), F.col(v).alias("value"), F.col("u_price").alias("u")) for n, v in (("price", "avg_price"), ("balance", "avg_balance"))]
    return rows[0].unionByName(rows[1])


@query("s13_batch_to_campaign", f"WITH {RESULTS} SELECT test_id, avg_price, u_price, avg_balance, u_price AS u_balance FROM results WHERE test_id % 6 <> 0")
def s13(spark, sf):
    return campaigns.batch_to_campaign(outcomes(spark, sf), ["price", "balance"])


@query("s13_batch_counts", "SELECT o_orderkey % 6 <> 0 AS success, count(*) AS n FROM orders GROUP BY 1")
def s13b(spark, sf):
    return campaigns.batch_counts(outcomes(spark, sf))


@query("s14_export_columns", f"WITH {RESULTS} SELECT campaign_name, test_id, part, status, avg_price, avg_balance, qc_passed FROM results")
def s14(spark, sf):
    return campaigns.export_columns(results(spark, sf), uncertainties=False, traceability=False).drop("test_timestamp")


@query("s15_export_statistics", f"WITH {RESULTS} SELECT parameter, count(v) AS count, round(avg(v), 7) AS mean, round(stddev_samp(v), 7) AS std, min(v) AS min, max(v) AS max FROM (SELECT 'avg_price' AS parameter, avg_price AS v FROM results UNION ALL SELECT 'avg_balance', avg_balance FROM results UNION ALL SELECT 'u_price', u_price FROM results) GROUP BY parameter")
def s15(spark, sf):
    df = campaigns.export_statistics(results(spark, sf).drop("test_id"))
    return df.select("parameter", "count", F.round("mean", 7).alias("mean"), F.round("std", 7).alias("std"), "min", "max")


@query("s17_export_with_context")
def s17(spark, sf):
    r = results(spark, sf)
    measured = outcomes(spark, sf).select("test_id", "name", "value", "u")
    return campaigns.with_context(measured, r.select("test_id", "part", "status"), r.select("test_id", F.create_map(F.lit("rate"), F.lit("100")).alias("config")))


@query("s18_traceability_report", f"WITH {RESULTS} SELECT campaign_name, string_agg(DISTINCT status, ',' ORDER BY status) AS analysts, string_agg(DISTINCT part, ',' ORDER BY part) AS versions, CAST(count_if(qc_passed) AS BIGINT) AS n_passed, CAST(count_if(NOT qc_passed) AS BIGINT) AS n_failed, CAST(count_if(test_id % 4 <> 0) AS BIGINT) AS n_hashed FROM results GROUP BY ALL")
def s18(spark, sf):
    r = results(spark, sf).withColumns({"analyst_username": F.col("status"), "processing_version": F.col("part"), "raw_data_hash": F.when(F.col("test_id") % 4 != 0, F.lit("h"))})
    df = campaigns.traceability_report(r)
    return df.withColumns({"analysts": F.array_join("analysts", ","), "versions": F.array_join("versions", ",")})


CHECKED = f"""{GAPPED}, share AS (SELECT test_id, channel, avg((value IS NULL)::INT) AS s FROM readings GROUP BY ALL), bad AS (SELECT DISTINCT test_id FROM share WHERE s > 0.09),
  own AS (SELECT * FROM readings WHERE channel = 'view'), n AS (SELECT test_id, count(*) AS n FROM own GROUP BY ALL), w AS (SELECT test_id, max(time_s) FILTER (seq = floor(n * 0.5 / 2)) AS s0, max(time_s) FILTER (seq = least(floor(n * 1.5 / 2), n - 1)) AS s1 FROM own JOIN n USING (test_id) GROUP BY test_id),
  mean AS (SELECT test_id, channel, avg(value) AS m FROM readings JOIN w USING (test_id) WHERE time_s BETWEEN s0 AND s1 AND test_id NOT IN (SELECT test_id FROM bad) GROUP BY ALL), {SPEC_SQL},
  meas AS (SELECT test_id, channel, m, CASE WHEN u_type = 'abs' THEN amount WHEN u_type = 'pct_fs' THEN amount * fs ELSE abs(m) * coalesce(amount, 0.01::DOUBLE) END AS u FROM mean LEFT JOIN spec USING (channel)),
  v AS (SELECT test_id, max(m) FILTER (channel = 'view') AS p1, max(u) FILTER (channel = 'view') AS u1, max(m) FILTER (channel = 'error') AS p2, max(u) FILTER (channel = 'error') AS u2, max(m) FILTER (channel = 'click') AS f, max(u) FILTER (channel = 'click') AS uf FROM meas GROUP BY test_id),
  k AS (SELECT *, CASE WHEN p1 > p2 THEN f / 1000 / ({AREA!r}::DOUBLE * sqrt(2 * {RHO}::DOUBLE * (p1 - p2) * 1e5)) END AS cd FROM v)"""


def run(spark, sf):
    r = readings(spark, sf, True)
    roles = spark.createDataFrame(COLD_ROLES, "channel string, role string")
    known = [F.struct(F.lit(name).alias("role"), F.lit(value).alias("value"), F.lit(u).alias("u"), F.lit(u / value).alias("rel")) for name, value, u in (("area_m2", AREA, U_AREA), ("density", RHO, U_RHO))]
    fixed = r.select("test_id").distinct().select("test_id", F.inline(F.array(*known)))
    return r, analysis.batch(r, roles, specs(spark), uncertainty.COLD_FLOW, "simple", "view", fixed, qc.missing(r, 0.05, 0.09))


@query("b1_analyse_tests", f"WITH {CHECKED} SELECT test_id, round(p1, 9) AS avg_p_up_bar, round(u1, 9) AS u_p_up_bar, round(f, 9) AS avg_mf_g_s, round(p1 - p2, 9) AS avg_dp_bar, round(cd, 9) AS avg_cd FROM k")
def b1(spark, sf):
    _, done = run(spark, sf)
    return rounded(done.where("success").select("test_id", "avg_p_up_bar", "u_p_up_bar", "avg_mf_g_s", "avg_dp_bar", "avg_cd"), 9)


@query("b2_b3_batch", f"WITH {CHECKED} SELECT t.test_id, b.test_id IS NULL AS success, CASE WHEN b.test_id IS NOT NULL THEN 'quality: nan_ratio' END AS error, CASE WHEN b.test_id IS NULL THEN 'PASS' ELSE 'FAIL' END AS qc_status FROM (SELECT DISTINCT test_id FROM readings) t LEFT JOIN bad b USING (test_id)")
def b2(spark, sf):
    return run(spark, sf)[1].select("test_id", "success", "error", "qc_status")


@query("b2_rates", f"WITH {CHECKED}, t AS (SELECT DISTINCT r.test_id, b.test_id IS NULL AS ok FROM readings r LEFT JOIN bad b USING (test_id)) SELECT ok AS success, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS qc_status, count(*) AS n, round(count(*) / (SELECT count(*) FROM t), 8) AS share FROM t GROUP BY ALL")
def b2b(spark, sf):
    return rounded(analysis.batch_rates(run(spark, sf)[1]), 8)


@query("j7_j8_slice_pairs", f"WITH {GAPPED}, w AS (SELECT test_id, max(time_s) * 0.25 AS s0, max(time_s) * 0.75 AS s1 FROM readings GROUP BY test_id) SELECT r.test_id, seq, max(value) FILTER (channel = 'view') AS a, max(value) FILTER (channel = 'click') AS b FROM readings r JOIN w USING (test_id) WHERE time_s BETWEEN s0 AND s1 AND channel IN ('view', 'click') GROUP BY ALL")
def j7(spark, sf):
    r = readings(spark, sf, True)
    w = r.groupBy("test_id").agg((F.max("time_s") * 0.25).alias("start_s"), (F.max("time_s") * 0.75).alias("end_s"))
    return qc.paired(prep.steady_slice(r, w).drop("start_s", "end_s"), "view", "click").select("test_id", "seq", "a", "b")


CHANNELS = ("click", "error", "purchase", "signup", "view")


def recorded(spark, sf):
    """The readings as one CSV file a test: a folder by test, a row a sample, a column a channel; returns the folder."""
    path = scratch(spark, "recordings")
    wide = readings(spark, sf, True).groupBy("test_id", "seq").pivot("channel", list(CHANNELS)).agg(F.max("value"))
    rows = wide.select("test_id", (F.col("seq") * 10.0).alias("timestamp"), *CHANNELS)
    campaigns.dealt(rows, "test_id").sortWithinPartitions("test_id", "timestamp").write.partitionBy("test_id").option("header", "true").csv(path)
    return path


@query("s1_recording_scan", f"WITH {GAPPED}, g AS (SELECT DISTINCT test_id, seq FROM readings), c AS (SELECT unnest({list(CHANNELS)}) AS channel) SELECT g.test_id, c.channel, g.seq, g.seq * 10.0::DOUBLE AS timestamp, value FROM g CROSS JOIN c LEFT JOIN readings r ON r.test_id = g.test_id AND r.channel = c.channel AND r.seq = g.seq")
def s1(spark, sf):
    return recordings.read_recordings(spark, recorded(spark, sf), "part-*.csv", "test_id=([^/]+)/")


@query("s2_discovery", "SELECT DISTINCT 'T' || (user_id // 10) AS test_id, true AS has_bytes FROM events")
def s2(spark, sf):
    found = recordings.discover(spark, recorded(spark, sf), "part-*.csv")
    return found.select(recordings.test_id_of(F.col("path"), "test_id=([^/]+)/").alias("test_id"), (F.col("bytes") > 0).alias("has_bytes"))


@query("s4_metadata_scan", "SELECT CASE WHEN c_custkey % 3 <> 0 THEN 'C' || c_custkey ELSE 'folder=F' || c_custkey END AS test_id, CASE WHEN c_custkey % 2 = 0 THEN 'complete' ELSE 'pending' END AS status, c_mktsegment AS system, c_acctbal AS area FROM customer")
def s4(spark, sf):
    i = F.col("c_custkey")
    fields = F.struct(F.when(i % 3 != 0, F.concat(F.lit("C"), i)).alias("test_id"), F.when(i % 2 == 0, "complete").alias("status"), F.col("c_mktsegment").alias("system"), F.create_map(F.lit("area"), "c_acctbal").alias("geometry"))
    path = scratch(spark, "metadata")
    customers = table(spark, sf, "customer").select(F.concat(F.lit("F"), i).alias("folder"), F.to_json(fields).alias("value"))
    a_file_a_row(campaigns.dealt(customers, "folder"), path)
    found = recordings.read_metadata(spark, path, "part-*.txt")
    return found.select("test_id", "status", "system", F.col("geometry")["area"].alias("area"))


@query("s5_test_folders", "SELECT o_orderkey AS test_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'r/' || o_orderkey || '/metadata.json' END AS metadata_path, CASE WHEN o_orderkey % 2 = 0 THEN 'r/' || o_orderkey || '/config/a_config.json' WHEN o_orderkey % 5 = 0 THEN 'r/' || o_orderkey || '/my_config.json' END AS config_path, CASE WHEN o_orderkey % 7 <> 0 THEN 'r/' || o_orderkey || '/raw_data/raw.csv' ELSE 'r/' || o_orderkey || '/a.csv' END AS raw_path FROM orders")
def s5_folders(spark, sf):
    i = F.col("o_orderkey")
    names = [(i % 3 != 0, "metadata.json"), (i % 2 == 0, "config/z.json"), (i % 2 == 0, "config/a_config.json"), (i % 5 == 0, "my_config.json"), (F.lit(True), "other.json"), (i % 7 != 0, "raw_data/raw.csv"), (F.lit(True), "a.csv")]
    listed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in names]))
    found = table(spark, sf, "orders").select(i.alias("test_id"), F.explode(listed).alias("file"))
    return recordings.test_folders(found.select("test_id", F.concat(F.lit("r/"), F.col("test_id"), F.lit("/"), F.col("file")).alias("path")))


@query("s6_catalog_types", "SELECT o_orderstatus AS system, o_orderpriority AS campaign, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' WHEN o_orderkey % 2 = 0 THEN 'cold_flow' ELSE 'hot_fire' END AS test_type, count(*) AS n_tests FROM orders GROUP BY ALL")
def s6_types(spark, sf):
    i = F.col("o_orderkey")
    kind = F.when(i % 4 == 0, F.lit(None)).when(i % 2 == 0, "cold_flow").otherwise("hot_fire")
    return recordings.catalog_types(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("system"), F.col("o_orderpriority").alias("campaign"), kind.alias("test_type")))


@query("s11_upsert_values", """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderpriority AS part FROM orders)
  SELECT k AS test_id, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 6 = 0 THEN k / 8 ELSE price END AS price, CASE WHEN k % 2 = 0 THEN 'new' ELSE part END AS part FROM o UNION ALL SELECT k + 100000000, 7.5, 'new' FROM o WHERE k % 50 = 0""")
def s11_values(spark, sf):
    i = F.col("test_id")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("test_id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("part"))
    price = F.when(i % 4 == 0, F.create_map(F.lit("price"), F.lit(None).cast("string"))).when(i % 6 == 0, F.create_map(F.lit("price"), (i / 8).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    new = o.where(i % 2 == 0).select("test_id", F.lit(2).alias("written_at"), F.map_concat(F.create_map(F.lit("part"), F.lit("new")), price).alias("values"))
    added = o.where(i % 50 == 0).select((i + 100000000).alias("test_id"), F.lit(1).alias("written_at"), F.create_map(F.lit("part"), F.lit("new"), F.lit("price"), F.lit("7.5")).alias("values"))
    return campaigns.upsert(o, new.unionByName(added)).select("test_id", "price", "part")


RESULT_COLUMNS = "campaign_name, test_id, part, status, avg_price, avg_balance, u_price, qc_passed"


@query("s14_csv_round_trip", f"WITH {RESULTS} SELECT {RESULT_COLUMNS} FROM results")
def s14_csv(spark, sf):
    path, r = scratch(spark, "csv"), results(spark, sf)
    campaigns.export_csv(r, path, ["all campaigns"])
    return spark.read.schema(r.schema).option("header", "true").csv(path).select(*RESULT_COLUMNS.split(", "))


@query("s15_json_round_trip", f"WITH {RESULTS} SELECT {RESULT_COLUMNS} FROM results")
def s15_json(spark, sf):
    path, r = scratch(spark, "json"), results(spark, sf)
    campaigns.export_json(r, path)
    return spark.read.schema(r.schema).json(path).select(*RESULT_COLUMNS.split(", "))


@query("s16_parquet_round_trip", f"WITH {RESULTS} SELECT {RESULT_COLUMNS} FROM results")
def s16(spark, sf):
    path = scratch(spark, "parquet")
    campaigns.export_parquet(results(spark, sf), path, "zstd")
    return spark.read.parquet(path).select(*RESULT_COLUMNS.split(", "))


@query("s17_context_fields", f"WITH {RESULTS} SELECT test_id, round(avg_balance, 6) AS balance, round(avg_price, 6) AS price, round(u_price, 6) AS u, part, status, '100' AS rate FROM results")
def s17_fields(spark, sf):
    document = F.from_json("document", "measurements array<struct<name:string,value:double,u:double>>, provenance struct<part:string,status:string>, config map<string,string>")
    d = s17(spark, sf).select("test_id", document.alias("d"))
    return d.select("test_id", F.round(F.col("d.measurements")[0]["value"], 6).alias("balance"), F.round(F.col("d.measurements")[1]["value"], 6).alias("price"), F.round(F.col("d.measurements")[1]["u"], 6).alias("u"), "d.provenance.part", "d.provenance.status", F.col("d.config")["rate"].alias("rate"))


@query("s19_qualification_package", f"WITH {RESULTS} SELECT name, (SELECT count(*) FROM results) AS rows FROM (SELECT unnest(['summary', 'full', 'provenance']) AS name)")
def s19(spark, sf):
    return campaigns.qualification_package(results(spark, sf), scratch(spark, "package"))


@query("s20_batch_export", f"WITH {RESULTS} SELECT test_id, test_id % 6 <> 0 AS success, CASE WHEN test_id % 6 = 0 THEN 'no metrics' END AS error, round(avg_price, 6) AS price, round(u_price, 6) AS price_u, round(avg_balance, 6) AS balance, round(u_price, 6) AS balance_u FROM results")
def s20(spark, sf):
    path, rows = scratch(spark, "batch"), outcomes(spark, sf).withColumn("error", F.when(~F.col("success"), "no metrics"))
    campaigns.export_batch(rows, ["price", "balance"], path)
    return rounded(spark.read.schema("test_id long, success boolean, error string, price double, price_u double, balance double, balance_u double").option("header", "true").csv(path), 6)


@query("s21_save_analysis", f"WITH {GAPPED} SELECT test_id, count(*) AS n_samples, count(value) AS n_known, round(avg(value), 6) AS mean FROM readings GROUP BY test_id")
def s21(spark, sf):
    path, r = scratch(spark, "analysis"), readings(spark, sf, True)
    campaigns.save_analysis(r, r.groupBy("test_id").agg(F.avg("value").alias("mean")), path)
    saved = spark.read.parquet(f"{path}/processed").groupBy("test_id").agg(F.count("*").alias("n_samples"), F.count("value").alias("n_known"))
    return rounded(saved.join(spark.read.parquet(f"{path}/results"), "test_id"), 6)


@query("p6_columns_of_a_recording", f"WITH {RAW} SELECT test_id, 'view' AS channel, row_number() OVER (PARTITION BY test_id ORDER BY event_id) - 1 AS seq, ts_us / 1e6 AS timestamp, v AS value FROM raw WHERE channel = 'view' UNION ALL SELECT test_id, 'twice', row_number() OVER (PARTITION BY test_id ORDER BY event_id) - 1, ts_us / 1e6, 2 * v FROM raw WHERE channel = 'view'")
def p6(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'view'")
    wide = e.select(F.concat(F.lit("T"), F.floor(F.col("user_id") / 10)).alias("test_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("Time"), F.col("value").alias("view"), (2 * F.col("value")).alias("twice"), F.col("event_type").alias("note"))
    return prep.wide_to_long(wide, "test_id", "event_id")


@query("b3_batch_by_detector")
def b3_detectors(spark, sf):
    r = readings(spark, sf)
    roles = spark.createDataFrame(COLD_ROLES, "channel string, role string")
    found = None
    for name in analysis.DETECTORS:
        own = analysis.batch(r, roles, specs(spark), uncertainty.COLD_FLOW, name, "view").select("test_id", F.lit(name).alias("detector"), "success", "error", "avg_p_up_bar")
        found = own if found is None else found.unionByName(own)
    return rounded(found, 9)


REGULAR = f"""{RAW}, readings AS (SELECT test_id, channel, seq, seq * 0.01::DOUBLE AS time_s, CASE WHEN event_id % 17 <> 0 THEN v END AS value FROM raw)"""
COMPLETE = f"""WITH {REGULAR}, invalid AS (SELECT DISTINCT test_id FROM readings WHERE CAST(substr(test_id, 2) AS INT) % 9 = 0),
  e AS (SELECT test_id, channel, avg((value IS NULL)::INT) AS s, max(value) AS top, count(value) AS n FROM readings WHERE channel IN ('view', 'click') GROUP BY ALL),
  f AS (SELECT test_id, 'nan_ratio' AS c FROM e WHERE s > 0.2 UNION SELECT test_id, 'sensor_range' FROM e WHERE channel = 'view' AND (n = 0 OR top > 250)),
  stopped AS (SELECT test_id, string_agg(DISTINCT c, ', ' ORDER BY c) AS c FROM f WHERE test_id NOT IN (SELECT test_id FROM invalid) GROUP BY test_id),
  bad AS (SELECT test_id FROM stopped UNION SELECT test_id FROM invalid), """ + CHECKED[CHECKED.index("own AS (") :] + """
  SELECT t.test_id, CASE WHEN i.test_id IS NOT NULL THEN 'configuration: density missing' WHEN s.test_id IS NOT NULL THEN 'quality: ' || s.c WHEN p1 IS NULL AND f IS NULL THEN 'no metrics' END AS error,
    i.test_id IS NULL AND s.test_id IS NULL AND (p1 IS NOT NULL OR f IS NOT NULL) AS success, round(cd, 9) AS avg_cd, round(p1, 9) AS avg_p_up_bar, CASE WHEN i.test_id IS NULL THEN 'simple' END AS detection_method, 'analyst' AS analyst_username
  FROM (SELECT DISTINCT test_id FROM readings) t LEFT JOIN k USING (test_id) LEFT JOIN invalid i USING (test_id) LEFT JOIN stopped s USING (test_id)"""


@query("b1_complete_analysis", COMPLETE)
def b1_complete(spark, sf):
    r = readings(spark, sf, True).withColumn("time_s", F.col("seq") * 0.01)
    number = F.substring("test_id", 2, 20).cast("int")
    empty = F.create_map().cast("map<string,string>")
    tests = r.select("test_id").distinct()
    roles = F.create_map(*[F.lit(x) for channel, role in COLD_ROLES for x in (role, channel)])
    configs = tests.select(
        "test_id", F.lit("bench").alias("config_name"), F.lit("cold_flow").alias("test_type"), F.create_map(F.lit("view"), F.lit("rel")).alias("u_types"), F.when(number % 9 != 0, F.lit(RHO)).alias("density"),
        F.create_map(F.lit("orifice_area_mm2"), F.lit(9.0)).alias("geometry"), F.lit("water").alias("fluid_name"), empty.alias("sensor_roles"), F.create_map(F.lit("rate"), F.lit("50")).alias("conditions"),
    )
    metadata = tests.select("test_id", F.create_map(F.lit("orifice_area_mm2"), F.lit(AREA * 1e6)).alias("geometry"), F.lit(None).cast("string").alias("fluid_name"), roles.alias("sensor_roles"), F.create_map(F.lit("rate"), F.lit("100")).alias("conditions"))
    ranges = spark.createDataFrame([("view", None, 250.0, True)], "channel string, min double, max double, allow_negative boolean")
    done = analysis.complete(r, configs, metadata, specs(spark), ranges, uncertainty.COLD_FLOW, "simple", "view", ["view", "click"], "view", "click", "analyst", "1.0")
    return rounded(done.select("test_id", "error", "success", "avg_cd", "avg_p_up_bar", "detection_method", "analyst_username"), 9)


def measured(part, test):
    if int(test[1:]) % 7 == 0:
        raise ValueError("an odd test")
    known = part["value"].dropna()
    return {"mean": (known.mean(), known.std()), "top": known.max()}


@query("b2_user_analysis", f"""WITH {GAPPED}, g AS (SELECT test_id, CAST(substr(test_id, 2) AS INT) % 7 <> 0 AS success, avg(value) AS mean, stddev_samp(value) AS sd, max(value) AS top FROM readings GROUP BY test_id)
  SELECT test_id, success, NULL AS error, 'mean' AS name, round(mean, 8) AS value, round(sd, 8) AS u FROM g WHERE success UNION ALL SELECT test_id, success, NULL, 'top', round(top, 8), NULL FROM g WHERE success
  UNION ALL SELECT test_id, success, 'ValueError: an odd test', NULL, NULL, NULL FROM g WHERE NOT success""")
def b2_user(spark, sf):
    return rounded(analysis.user_batch(readings(spark, sf, True), measured).drop("trace"), 8)


def middle(part):
    number, t = int(part["test_id"].iloc[0][1:]), part["time_s"]
    if number % 7 == 0:
        raise ValueError("an odd test")
    return None if number % 5 == 0 else (t.min() + 0.25 * (t.max() - t.min()), t.min() + 0.75 * (t.max() - t.min()))


@query("d5_user_detector", f"""WITH {GAPPED}, g AS (SELECT test_id, CAST(substr(test_id, 2) AS INT) AS k, min(time_s) AS a, max(time_s) AS b FROM readings WHERE channel = 'view' GROUP BY test_id)
  SELECT test_id, round(CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN a + 0.25::DOUBLE * (b - a) END, 6) AS start_s, round(CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN a + 0.75::DOUBLE * (b - a) END, 6) AS end_s,
    'custom' AS method, CASE WHEN k % 7 = 0 THEN 'ValueError: an odd test' WHEN k % 5 = 0 THEN 'no steady window' END AS error FROM g""")
def d5_user(spark, sf):
    return rounded(analysis.windows_of(readings(spark, sf, True), middle, "view"), 6)


@query("s11_upsert_store", f"""WITH {RESULTS} SELECT campaign_name, test_id, CASE WHEN campaign_name LIKE '%-3' THEN 'new' ELSE part END AS part, CASE WHEN campaign_name LIKE '%-3' AND test_id % 2 = 0 THEN NULL ELSE round(avg_price, 8) END AS avg_price FROM results
  UNION ALL SELECT 'ADDED', test_id + 100000000, 'new', 7.5 FROM results WHERE campaign_name LIKE '%-3'""")
def s11_store(spark, sf):
    path, r = scratch(spark, "store"), results(spark, sf)
    campaigns.write_campaigns(r, path)
    some, i = r.where(F.col("campaign_name").endswith("-3")), F.col("test_id")
    new = F.create_map(F.lit("part"), F.lit("new"))
    changed = some.select(i, F.lit(1).alias("written_at"), F.when(i % 2 == 0, F.map_concat(new, F.create_map(F.lit("avg_price"), F.lit(None).cast("string")))).otherwise(new).alias("values"))
    added = some.select((i + 100000000).alias("test_id"), F.lit(1).alias("written_at"), F.create_map(*[F.lit(x) for x in ("campaign_name", "ADDED", "part", "new", "avg_price", "7.5")]).alias("values"))
    campaigns.upsert_store(spark, path, changed.unionByName(added))
    return rounded(spark.read.schema(r.schema).parquet(path).select("campaign_name", "test_id", "part", "avg_price"), 8)
