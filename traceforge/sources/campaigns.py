"""The campaign store: results by campaign in Parquet, with upserts, schema versions and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType, TimestampType
from pyspark.sql.window import Window

from traceforge.operators.prep import metric_columns

BASE = [("campaign_name", StringType()), ("test_id", StringType()), ("test_timestamp", TimestampType()), ("part", StringType()), ("serial_num", StringType()), ("qc_passed", BooleanType())]
PROVENANCE = ["raw_data_hash", "config_hash", "steady_start_s", "steady_end_s", "detection_method", "analyst_username", "processing_version"]
BY_TYPE = {
    "cold_flow": ["p_up_bar", "mf_g_s", "dp_bar", "cd"],
    "hot_fire": ["pc_bar", "thrust_n", "mf_total_g_s", "of_ratio", "isp_s", "c_star_m_s"],
}


def schema_of(test_type: str) -> StructType:
    """The columns of a test type's results."""
    numbers = [StructField(f"{p}_{c}", DoubleType()) for c in BY_TYPE[test_type] for p in ("avg", "u")]
    text = [StructField(c, DoubleType() if c.startswith("steady") else StringType()) for c in PROVENANCE]
    return StructType([StructField(n, t) for n, t in BASE] + numbers + text)


def migrated(results: DataFrame, schema: StructType) -> DataFrame:
    """``results`` with every column of the schema, typed nulls where it had none, and its own further columns."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in results.columns}
    return results.withColumns(missing) if missing else results


def read_campaign(spark: SparkSession, path: str, campaign: str) -> DataFrame:
    """One campaign's results, newest first; only its partition is read."""
    return newest_first(spark.read.option("mergeSchema", "true").parquet(path).where(F.col("campaign_name") == campaign))


def newest_first(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("test_timestamp"), "test_id")


def positions(results: DataFrame) -> DataFrame:
    """Every campaign's results with their ``position`` from the newest on."""
    order = Window.partitionBy("campaign_name").orderBy(F.desc("test_timestamp"), "test_id")
    return results.withColumn("position", F.row_number().over(order).cast("long"))


def list_campaigns(campaigns: DataFrame, results: DataFrame) -> DataFrame:
    """Campaigns with their information and number of tests, those without tests included."""
    n = results.groupBy("campaign_name").agg(F.count("*").alias("n_tests"), F.max("test_timestamp").alias("last_test"))
    return campaigns.join(n, "campaign_name", "left").withColumn("n_tests", F.coalesce("n_tests", F.lit(0)))


def system_union(parts: list[tuple[DataFrame, str]], qc_only: bool = False) -> DataFrame:
    """Results of several test types in one table, absent columns null, with ``campaign_type``."""
    tagged = [df.withColumn("campaign_type", F.lit(kind)) for df, kind in parts]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.where("qc_passed") if qc_only else out


def upsert(stored: DataFrame, changes: DataFrame, key: str = "test_id", order: str = "written_at") -> DataFrame:
    """``stored`` after ``changes(key, order, values map<string,string>)``.

    Only columns that a change names are overwritten, with null too where it says null; names that the store
    does not have are dropped; later changes of a test come after earlier ones.
    """
    # changes of one test folded into one map in order, so that later ones win name by name
    entries = changes.select(key, order, F.explode("values").alias("name", "value"))
    last = entries.groupBy(key, "name").agg(F.max_by(F.struct("value"), order).alias("v"))
    folded = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("v.value").alias("value")))).alias("values"))
    j = stored.join(folded, key, "full_outer")
    out = []
    for f in stored.schema:
        supplied = F.coalesce(F.map_contains_key("values", F.lit(f.name)), F.lit(False))
        out.append(F.col(key) if f.name == key else F.when(supplied, F.try_element_at("values", F.lit(f.name)).try_cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name))
    return j.select(*out)


def upsert_store(spark: SparkSession, path: str, changes: DataFrame, key: str = "test_id", order: str = "written_at") -> None:
    """:func:`upsert` on the store at ``path``, which rewrites only the campaigns of changed tests.

    The new partitions are written beside the store first, then put in place, so a job that fails before that leaves
    the store as it was, and doing it again gives the same store. A stored test stays in its campaign; a new one goes
    to that which its changes name.
    """
    store = spark.read.option("mergeSchema", "true").parquet(path)
    fields = {f.name: f.dataType for f in store.schema}
    changed = changes.select(F.col(key).cast(fields[key]).alias(key)).distinct()
    named = changes.select(F.try_element_at("values", F.lit("campaign_name")).alias("campaign_name")).where("campaign_name is not null")
    found = store.select("campaign_name", key).join(changed, key, "left_semi").select(F.col("campaign_name").cast("string"))
    touched = found.unionByName(named).distinct().withColumnRenamed("campaign_name", "touched")
    part = store.join(touched, F.col("campaign_name").cast("string") == F.col("touched"), "left_semi")
    kept = part.withColumn("_campaign", F.col("campaign_name"))
    made = upsert(kept, changes, key, order).withColumn("campaign_name", F.coalesce("_campaign", "campaign_name")).drop("_campaign")
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    dealt(made.where("campaign_name is not null"), "campaign_name").write.partitionBy("campaign_name").parquet(staged)
    write_campaigns(spark.read.schema(made.schema).parquet(staged), path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` by ``key`` over a fixed number of tasks, before a write of a folder for each key.

    Opening files costs more than the rows in them. Without a number, Spark puts small partitions together by their bytes, and
    one task writes the files of thousands of keys.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def write_campaigns(results: DataFrame, path: str) -> None:
    """Replace the partitions of the campaigns in ``results`` and leave the others."""
    dealt(results, "campaign_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("campaign_name").parquet(path)


def batch_to_campaign(outcomes: DataFrame, names: list[str]) -> DataFrame:
    """Long batch outcomes ``(test_id, success, name, value, u)`` as one row per successful test."""
    ok = outcomes.where("success")
    picks = [F.max(F.when(F.col("name") == n, F.col(k))).alias(p + n) for n in names for k, p in (("value", "avg_"), ("u", "u_"))]
    return ok.groupBy("test_id").agg(*picks)


def batch_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("test_id", "success").distinct().groupBy("success").agg(F.count("*").alias("n"))


def export_columns(results: DataFrame, uncertainties: bool = True, traceability: bool = True) -> DataFrame:
    """The columns of an export, without ``u_*`` or provenance ones where those are not wanted."""
    return results.select(*[c for c in results.columns if (uncertainties or not c.startswith("u_")) and (traceability or c not in PROVENANCE)])


def export_csv(results: DataFrame, path: str, header_lines: list[str] | None = None, **columns: bool) -> None:
    export_columns(results, **columns).write.mode("overwrite").option("header", "true").csv(path)
    if header_lines:
        results.sparkSession.createDataFrame([(f"# {x}",) for x in header_lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_header")


def export_statistics(results: DataFrame) -> DataFrame:
    """Mean, deviation, extremes and count of every metric column."""
    names = metric_columns(results, "")
    return results.select(*[F.col(c).cast("double") for c in names]).unpivot([], names, "parameter", "value").groupBy("parameter").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("count"))


def export_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
    export_statistics(results).coalesce(1).write.mode("overwrite").json(f"{path}_statistics")


def export_parquet(results: DataFrame, path: str, codec: str = "snappy") -> None:
    results.write.mode("overwrite").option("compression", codec).parquet(path)


def with_context(measurements: DataFrame, provenance: DataFrame, configs: DataFrame) -> DataFrame:
    """One JSON document per test: its measurements by name, provenance and configuration."""
    m = measurements.groupBy("test_id").agg(F.array_sort(F.collect_list(F.struct("name", "value", "u"))).alias("measurements"))
    j = m.join(provenance.select("test_id", F.struct(*[c for c in provenance.columns if c != "test_id"]).alias("provenance")), "test_id", "left").join(configs.select("test_id", "config"), "test_id", "left")
    return j.select("test_id", F.to_json(F.struct("test_id", "measurements", "provenance", "config")).alias("document"))


def traceability_report(results: DataFrame) -> DataFrame:
    """Who and what made a campaign's results, and how many passed."""
    return results.groupBy("campaign_name").agg(
        F.array_sort(F.collect_set("analyst_username")).alias("analysts"), F.array_sort(F.collect_set("processing_version")).alias("versions"),
        F.count_if("qc_passed").alias("n_passed"), F.count_if(~F.col("qc_passed")).alias("n_failed"), F.count("raw_data_hash").alias("n_hashed"))


def qualification_package(results: DataFrame, path: str) -> DataFrame:
    """Summary, full data, provenance and JSON under ``path``; returns the manifest ``(name, rows)``."""
    summary = ["test_id", *[c for c in metric_columns(results) if not c.startswith("avg_rho")], "qc_passed"]
    parts = {"summary": results.select(*[c for c in summary if c in results.columns]), "full": results, "provenance": results.select("test_id", *[c for c in PROVENANCE if c in results.columns])}
    for name, df in parts.items():
        export_csv(df, f"{path}/{name}")
    export_json(results, f"{path}/data")
    spark = results.sparkSession
    manifest = spark.createDataFrame([(n, spark.read.option("header", "true").csv(f"{path}/{n}").count()) for n in parts], "name string, rows long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def save_analysis(processed: DataFrame, metrics: DataFrame, path: str) -> None:
    """Processed readings and results of tests, each in the test's own partition."""
    for name, df in (("processed", processed), ("results", metrics)):
        dealt(df, "test_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("test_id").parquet(f"{path}/{name}")


def export_batch(outcomes: DataFrame, names: list[str], path: str, fmt: str = "csv") -> None:
    """Batch outcomes ``(test_id, success, error, name, value, u)`` as one flat row per test, in CSV or JSON."""
    picks = [F.max(F.when(F.col("name") == n, F.col(k))).alias(n + p) for n in names for k, p in (("value", ""), ("u", "_u"))]
    flat = outcomes.groupBy("test_id").agg(F.bool_and("success").alias("success"), F.first("error", ignorenulls=True).alias("error"), *picks)
    writer = flat.write.mode("overwrite")
    writer.json(path) if fmt == "json" else writer.option("header", "true").csv(path)
