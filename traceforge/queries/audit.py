"""Provenance and audit queries. Customers, orders and parts stand for configurations, tests and their metadata."""

from pyspark.sql import functions as F

from traceforge.operators import audit
from traceforge.queries.base import GAPPED, READINGS, RESULTS, query, readings, results, table


#: The SQL names the files of the tables that queries are compared on.
HASHES = "SELECT parse_filename(filename) AS file, 'sha256:' || sha256(content) AS hash FROM read_blob('/root/testdata/sf0.01/{}.parquet')"


@query("i1_file_hashes", HASHES.format("nation"))
def i1(spark, sf):
    return audit.file_hashes(spark, sf, "nation.parquet").select(F.substring_index("path", "/", -1).alias("file"), "hash")


@query("i1_all_file_hashes", HASHES.format("*"))
def i1_all(spark, sf):
    return audit.file_hashes(spark, sf, "*.parquet").select(F.substring_index("path", "/", -1).alias("file"), "hash")


@query("i2_content_hash", f"""WITH {GAPPED}, l AS (SELECT test_id, concat_ws('|', channel, CAST(seq AS VARCHAR), coalesce(printf('%.6f', time_s), ''), coalesce(printf('%.6f', value), '')) AS line FROM readings),
  h AS (SELECT test_id, count(*) AS n, sum(CAST('0x' || substr(sha256(line), 1, 15) AS BIGINT)::HUGEINT) AS s FROM l GROUP BY test_id)
  SELECT test_id, n, 'sha256:' || sha256(CAST(n AS VARCHAR) || ':' || CAST(s AS VARCHAR)) AS hash FROM h""")
def i2(spark, sf):
    return audit.content_hash(readings(spark, sf, True))


@query("i3_config_hash", "SELECT c_custkey, 'sha256:' || sha256('balance=' || CAST(c_nationkey AS VARCHAR) || ';segment=' || c_mktsegment) AS hash FROM customer")
def i3(spark, sf):
    config = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("balance"), F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", audit.config_hash(config).alias("hash"))


@query("i4_integrity", "SELECT o_orderkey AS test_id, CASE WHEN o_orderkey % 7 = 0 THEN 'no_hash' WHEN o_orderkey % 11 = 0 THEN 'no_path' WHEN o_orderkey % 3 = 0 THEN 'file_missing' WHEN o_orderkey % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS integrity FROM orders")
def i4(spark, sf):
    i = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(i.alias("test_id"), F.when(i % 11 != 0, F.concat(F.lit("f"), i)).alias("raw_data_path"), F.when(i % 7 != 0, F.sha2(i.cast("string"), 256)).alias("raw_data_hash"))
    files = table(spark, sf, "orders").where(i % 3 != 0).select(F.concat(F.lit("f"), i).alias("path"), F.sha2(F.when(i % 5 == 0, F.lit("changed")).otherwise(i.cast("string")), 256).alias("hash"))
    return audit.verify_integrity(o, files)


def recorded(spark, sf):
    r = readings(spark, sf)
    tests = r.groupBy("test_id").agg(F.count("*").alias("n_samples"))
    configs = tests.select("test_id", F.create_map(F.lit("rate"), F.lit("100")).alias("config"))
    windows = r.groupBy("test_id").agg(F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s"), F.lit("simple").alias("method"))
    return audit.provenance(tests, audit.content_hash(r), configs, windows, "analyst", "1.0")


@query("i5_provenance", f"""WITH {READINGS}, l AS (SELECT test_id, concat_ws('|', channel, CAST(seq AS VARCHAR), coalesce(printf('%.6f', time_s), ''), coalesce(printf('%.6f', value), '')) AS line FROM readings),
  h AS (SELECT test_id, count(*) AS n, sum(CAST('0x' || substr(sha256(line), 1, 15) AS BIGINT)::HUGEINT) AS s FROM l GROUP BY test_id)
  SELECT test_id, n AS n_samples, 'sha256:' || sha256(CAST(n AS VARCHAR) || ':' || CAST(s AS VARCHAR)) AS raw_data_hash, 'sha256:' || sha256('rate=100') AS config_hash, min(time_s) AS steady_start_s, max(time_s) AS steady_end_s, 'simple' AS detection_method, 'analyst' AS analyst_username, '1.0' AS processing_version
  FROM h JOIN readings USING (test_id) GROUP BY test_id, n, s""")
def i5(spark, sf):
    return recorded(spark, sf)


@query("i6_provenance_lookup", f"WITH {READINGS} SELECT test_id, 'sha256:' || sha256('rate=100') AS config_hash, round(min(time_s), 6) AS steady_start_s, round(max(time_s), 6) AS steady_end_s, 'simple' AS detection_method, 'analyst' AS analyst_username, '1.0' AS processing_version FROM readings WHERE test_id = 'T1' GROUP BY test_id")
def i6(spark, sf):
    df = audit.provenance_of(recorded(spark, sf), "T1").drop("raw_data_hash")
    return df.withColumns({c: F.round(c, 6) for c in ("steady_start_s", "steady_end_s")})


@query("i7_metadata_audit", """SELECT o_orderkey AS test_id, concat_ws(', ', CASE WHEN o_orderstatus = 'P' THEN 'unknown test type' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown status' END, CASE WHEN o_totalprice > 400000 THEN 'temperature out of range' END,
    CASE WHEN o_custkey % 10 = 0 THEN 'pressure out of range' END, CASE WHEN o_orderkey % 9 = 0 THEN 'negative geometry' END, CASE WHEN o_orderkey % 8 = 0 THEN 'date not ISO' END) AS warnings,
  NOT (o_orderstatus = 'P' OR o_orderpriority = '5-LOW' OR o_totalprice > 400000 OR o_custkey % 10 = 0 OR o_orderkey % 9 = 0 OR o_orderkey % 8 = 0) AS valid FROM orders""")
def i7(spark, sf):
    i = F.col("o_orderkey")
    m = table(spark, sf, "orders").select(
        i.alias("test_id"), F.when(F.col("o_orderstatus") == "P", "other").otherwise("cold_flow").alias("test_type"), F.when(F.col("o_orderpriority") == "5-LOW", "?").otherwise("complete").alias("status"),
        (F.col("o_totalprice") / 40).alias("temperature_k"), F.when(F.col("o_custkey") % 10 != 0, 1e5).otherwise(0.0).alias("pressure_pa"), F.create_map(F.lit("d_mm"), F.when(i % 9 == 0, -1.0).otherwise(1.0)).alias("geometry"),
        F.when(i % 8 == 0, "soon").otherwise("2024-05-01").alias("test_date"),
    )
    return audit.audit_metadata(m).withColumn("warnings", F.concat_ws(", ", "warnings"))


def configs(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        k, F.when(k % 13 != 0, F.col("c_name")).alias("config_name"), F.when(k % 2 == 0, "cold_flow").when(k % 5 == 0, "flow").otherwise("hot_fire").alias("test_type"),
        F.create_map(F.lit("PT-01"), F.when(k % 6 == 0, "guess").otherwise("rel")).alias("u_types"), F.when(k % 4 != 0, F.col("c_acctbal")).alias("density"),
        F.when(k % 3 == 0, F.create_map(F.lit("orifice_area_mm2"), F.lit(1.0))).otherwise(F.create_map(F.lit("throat_area_mm2"), F.lit(2.0))).alias("geometry"),
        F.when(k % 7 == 0, "water").alias("fluid_name"), F.create_map(F.lit("rate"), F.lit("1")).alias("settings"), F.when(k % 8 != 0, F.col("c_name")).alias("serial_num"),
    )


TYPE = "CASE WHEN c_custkey % 2 = 0 THEN 'cold_flow' WHEN c_custkey % 5 = 0 THEN 'flow' ELSE 'hot_fire' END"


@query("i8_config_audit", f"""WITH c AS (SELECT *, {TYPE} AS t FROM customer), w AS (SELECT c_custkey, concat_ws(', ', CASE WHEN c_custkey % 13 = 0 THEN 'name missing' END, CASE WHEN t = 'flow' THEN 'unknown test type' END, CASE WHEN c_custkey % 6 = 0 THEN 'unknown uncertainty type' END, CASE WHEN c_custkey % 4 = 0 THEN 'density missing' END,
    CASE WHEN c_custkey % 4 <> 0 AND c_acctbal <= 0 THEN 'density not positive' END, CASE WHEN t = 'cold_flow' AND c_custkey % 3 <> 0 THEN 'orifice area missing' END, CASE WHEN t = 'hot_fire' AND c_custkey % 3 = 0 THEN 'throat area missing' END) AS warnings, CASE WHEN c_custkey % 13 <> 0 THEN c_name END AS config_name FROM c)
  SELECT config_name, warnings, warnings = '' AS valid FROM w""")
def i8(spark, sf):
    return audit.audit_configs(configs(spark, sf)).withColumn("warnings", F.concat_ws(", ", "warnings"))


@query("i9_missing_columns", f"WITH {READINGS} SELECT DISTINCT test_id, 'thrust' AS role, 'LC-01' AS channel FROM readings")
def i9(spark, sf):
    r = readings(spark, sf)
    roles = r.select("test_id").distinct().select("test_id", F.explode(F.create_map(F.lit("pressure"), F.lit("view"), F.lit("thrust"), F.lit("LC-01"))).alias("role", "channel"))
    return audit.missing_columns(roles, r)


@query("i10_readiness", "SELECT c_custkey AS test_id, concat_ws(', ', CASE WHEN c_custkey % 8 = 0 THEN 'identifier' END, CASE WHEN c_custkey % 7 <> 0 THEN 'fluid' END) AS missing, c_custkey % 8 <> 0 AND c_custkey % 7 = 0 AS ready FROM customer")
def i10(spark, sf):
    return audit.readiness(configs(spark, sf).withColumnRenamed("c_custkey", "test_id")).withColumn("missing", F.concat_ws(", ", "missing"))


@query("i11_config_format", "SELECT c_name AS config_name, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 7 = 0 THEN 'old' ELSE 'new' END AS format FROM customer")
def i11(spark, sf):
    c = configs(spark, sf).withColumns({"config_name": F.concat(F.lit("Customer#"), F.lpad("c_custkey", 9, "0")), "geometry": F.when(F.col("c_custkey") % 3 == 0, F.col("geometry"))})
    return audit.classify_config(c).select("config_name", "format")


@query("i12_parse_test_id", f"WITH {RESULTS} SELECT test_id, split_part(campaign_name, '-', 1) AS system, split_part(campaign_name, '-', 2) AS campaign, 'CF' AS kind, CAST(test_id AS VARCHAR) AS run, split_part(campaign_name, '-', 1) || '-CF-' || split_part(campaign_name, '-', 2) AS suggested FROM results")
def i12(spark, sf):
    named = results(spark, sf).select("test_id", F.concat_ws("-", "campaign_name", F.lit("CF"), F.col("test_id").cast("string")).alias("name"))
    return named.select("test_id", *[c.alias(n) for n, c in audit.parse_test_id(F.col("name")).items()])


@query("i13_template", f"SELECT CASE WHEN c_custkey % 13 <> 0 THEN c_name END AS config_name, {TYPE} = 'cold_flow' AS type_matches, 'FM-01,window' AS missing FROM customer")
def i13(spark, sf):
    df = audit.against_template(configs(spark, sf), {"test_type": "cold_flow", "uncertainties": ["PT-01", "FM-01"], "settings": ["rate", "window"]})
    return df.withColumn("missing", F.array_join("missing", ","))


@query("i14_overlay", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'OVERRIDE' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def i14(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    o = c.where(F.col("c_custkey") % 2 == 0).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "OVERRIDE").alias("c_mktsegment"))
    odd = c.where(F.col("c_custkey") % 2 == 1).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "OVERRIDE").alias("c_mktsegment"))
    return audit.overlay(c, o.unionByName(odd), ["c_custkey"])


@query("j1_merge_config", "SELECT c_custkey AS test_id, CASE WHEN c_custkey % 2 = 0 THEN 'nitrogen' ELSE c_mktsegment END AS fluid_name, CASE WHEN c_custkey % 2 = 0 THEN 'a=1,b=3,c=4' ELSE 'a=1,b=2' END AS conditions FROM customer")
def j1(spark, sf):
    text = "map<string,string>"
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("test_id"), F.create_map().cast("map<string,double>").alias("geometry"), F.col("c_mktsegment").alias("fluid_name"), F.create_map().cast(text).alias("sensor_roles"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")).alias("conditions"))
    m = c.where("test_id % 2 = 0").select("test_id", "geometry", F.lit("nitrogen").alias("fluid_name"), F.lit(None).cast(text).alias("sensor_roles"), F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit("4")).alias("conditions"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("conditions")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return audit.merge_config(c, m).select("test_id", "fluid_name", shown.alias("conditions"))
