"""Provenance, integrity and configuration audits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

TEST_TYPES = ("cold_flow", "hot_fire")
STATUSES = ("pending", "complete", "failed", "aborted")
U_TYPES = ("abs", "rel", "pct_fs", "pct_rd")


#: Bytes up to which a file is hashed as one value; Hadoop's codec that changes nothing, the names of its option in Hadoop
#: and in Spark's shaded copy, and the mark that Hadoop's line reader leaves out.
WHOLE = 32 << 20
AS_IT_IS = "org.apache.hadoop.io.compress.PassthroughCodec"
ENDING = ("io.compress.passthrough.extension", "org.apache.hadoop.shaded.io.compress.passthrough.extension")
BOM = b"\xef\xbb\xbf"


def file_hashes(spark: SparkSession, path: str, glob: str = "*", whole: int = WHOLE) -> DataFrame:
    """``(path, hash)``: SHA-256 of every file, with its prefix; Spark lists no empty ones.

    A file of more than ``whole`` bytes passes through its task line by line, so it may be of any size, in any store that
    Spark reads. Under a codec that changes nothing Spark neither decompresses nor splits files of an ending; files
    without a plain ending are read in splits, and put in order before they are hashed.
    """

    def reader(kind: str) -> DataFrameReader:
        return spark.read.format(kind).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")

    def ending(name: Column) -> Column:
        return F.regexp_extract(name, r"\.[A-Za-z0-9_-]+$", 0)

    def lines(end: str) -> DataFrame:
        text = reader("text").option("lineSep", "\n")
        if end:
            text = text.options(**{"io.compression.codecs": AS_IT_IS} | dict.fromkeys(ENDING, end))
        name, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
        large = text.load(path).where((size > whole) & (name.endswith(end) if end else ending(name) == ""))
        rows = large.select(name.alias("path"), size.alias("size"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
        return rows if end else rows.withColumn("at", F.monotonically_increasing_id()).repartition("path").sortWithinPartitions("path", "start", "at").drop("at")

    files = reader("binaryFile").load(path)
    found = files.where(F.col("length") <= whole).select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"))
    for (end,) in files.where(F.col("length") > whole).select(ending(F.col("path"))).distinct().collect():
        hashes = lines(end).mapInArrow(hashed_lines, "path string, hash string")
        found = found.unionByName(hashes.withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))))
    return found


def hashed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(path, hash)`` of files whose lines come in order, without their breaks.

    The bytes that are missing at the end tell whether the file ended with a break and began with a byte order mark.
    """
    path, size, seen, hashes = None, 0, 0, ()

    def done() -> pa.RecordBatch:
        rest = size - seen
        if rest not in (0, 1, len(BOM), len(BOM) + 1):
            raise ValueError(f"{path}: {seen} bytes of lines in a file of {size}")
        own = hashes[rest >= len(BOM)]
        own.update(b"\n" * (rest % len(BOM)))
        return pa.RecordBatch.from_pydict({"path": [path], "hash": ["sha256:" + own.hexdigest()]})

    for batch in batches:
        runs = pc.run_end_encode(batch["path"])
        a = 0
        for name, b in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            part = b"\n".join(batch["line"].slice(a, b - a).to_pylist())
            if name != path:
                if path is not None:
                    yield done()
                path, size, seen, hashes = name, batch["size"][a].as_py(), 0, (hashlib.sha256(), hashlib.sha256(BOM))
            else:
                part = b"\n" + part
            a = b
            seen += len(part)
            for h in hashes:
                h.update(part)
    if path is not None:
        yield done()


def content_hash(readings: DataFrame) -> DataFrame:
    """``(test_id, hash)`` of a test's readings, whatever their order: row hashes are summed before the last hash.

    A row is hashed as channel, sample, time and value joined by bars, with a null as an empty place.
    """

    def shown(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.format_string("%.6f", name)).otherwise("")

    line = F.concat_ws("|", "channel", F.col("seq").cast("string"), shown("time_s"), shown("value"))
    part = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    g = readings.select("test_id", part.alias("h")).groupBy("test_id").agg(F.sum("h").cast("string").alias("s"), F.count("*").alias("n"))
    return g.select("test_id", "n", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(":", F.col("n").cast("string"), "s"), 256)).alias("hash"))


def config_hash(config: Column) -> Column:
    """SHA-256 of a map, keys sorted."""
    pairs = F.transform(F.array_sort(F.map_entries(config)), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(pairs, ";"), 256))


def verify_integrity(results: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(test_id, integrity)`` by comparing ``raw_data_hash`` with the hash of the file at ``raw_data_path``."""
    h = hashes.select(F.col("path").alias("raw_data_path"), F.col("hash").alias("now"))
    j = results.join(h, "raw_data_path", "left")
    state = (
        F.when(F.col("raw_data_hash").isNull(), "no_hash").when(F.col("raw_data_path").isNull(), "no_path").when(F.col("now").isNull(), "file_missing").when(F.col("now") == F.col("raw_data_hash"), "ok").otherwise("mismatch")
    )
    return j.select("test_id", state.alias("integrity"))


def provenance(results: DataFrame, hashes: DataFrame, configs: DataFrame, windows: DataFrame, analyst: str, version: str) -> DataFrame:
    """Results with hashes, window, detection method and processing context beside."""
    j = results.join(hashes.select("test_id", F.col("hash").alias("raw_data_hash")), "test_id", "left").join(configs.select("test_id", config_hash(F.col("config")).alias("config_hash")), "test_id", "left")
    j = j.join(windows.select("test_id", F.col("start_s").alias("steady_start_s"), F.col("end_s").alias("steady_end_s"), F.col("method").alias("detection_method")), "test_id", "left")
    return j.withColumns({"analyst_username": F.lit(analyst), "processing_version": F.lit(version)})


def provenance_of(results: DataFrame, test_id) -> DataFrame:
    names = ("campaign_name", "test_id", "raw_data_hash", "config_hash", "steady_start_s", "steady_end_s", "detection_method", "analyst_username", "processing_version")
    return results.where(F.col("test_id") == test_id).select(*[c for c in names if c in results.columns])


def warnings(rules: list[tuple[Column, str]]) -> Column:
    """The texts of the rules that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in rules]))


def audit_metadata(metadata: DataFrame) -> DataFrame:
    """Warnings about ``(test_id, test_type, status, temperature_k, pressure_pa, geometry, test_date)``."""
    t, p = F.col("temperature_k"), F.col("pressure_pa")
    rules = [
        (F.col("test_id").isNull(), "test_id missing"),
        (~F.col("test_type").isin(*TEST_TYPES), "unknown test type"),
        (~F.col("status").isin(*STATUSES), "unknown status"),
        ((t <= 0) | (t > 1e4), "temperature out of range"),
        ((p <= 0) | (p > 1e9), "pressure out of range"),
        (F.exists(F.map_values("geometry"), lambda x: x < 0), "negative geometry"),
        (F.col("test_date").isNotNull() & F.try_to_timestamp("test_date").isNull(), "date not ISO"),
    ]
    w = metadata.select("test_id", warnings(rules).alias("warnings"))
    return w.withColumn("valid", F.size("warnings") == 0)


def audit_configs(configs: DataFrame, key: str = "config_name") -> DataFrame:
    """Warnings about ``(config_name, test_type, u_types, density, geometry)``, by ``key``."""
    rules = [
        (F.col("config_name").isNull() | (F.trim("config_name") == ""), "name missing"),
        (F.col("test_type").isNull() | ~F.col("test_type").isin(*TEST_TYPES), "unknown test type"),
        (F.exists(F.map_values("u_types"), lambda x: ~x.isin(*U_TYPES)), "unknown uncertainty type"),
        (F.col("density").isNull(), "density missing"),
        (F.col("density") <= 0, "density not positive"),
        ((F.col("test_type") == "cold_flow") & ~F.map_contains_key("geometry", "orifice_area_mm2"), "orifice area missing"),
        ((F.col("test_type") == "hot_fire") & ~F.map_contains_key("geometry", "throat_area_mm2"), "throat area missing"),
    ]
    w = configs.select(key, warnings(rules).alias("warnings"))
    return w.withColumn("valid", F.size("warnings") == 0)


def missing_columns(roles: DataFrame, readings: DataFrame) -> DataFrame:
    """Roles whose channel is not in the test's recording."""
    have = readings.select("test_id", "channel").distinct()
    return roles.join(have, ["test_id", "channel"], "left_anti")


def readiness(tests: DataFrame) -> DataFrame:
    """Whether ``(test_id, serial_num, geometry, fluid_name)`` suffice for a campaign, and what is missing."""
    rules = [(F.col("serial_num").isNull(), "identifier"), (F.col("geometry").isNull() | (F.size("geometry") == 0), "geometry"), (F.col("fluid_name").isNull(), "fluid")]
    w = tests.select("test_id", warnings(rules).alias("missing"))
    return w.withColumn("ready", F.size("missing") == 0)


def classify_config(configs: DataFrame) -> DataFrame:
    """Old configurations hold geometry or fluid; they split into a bench part and a test-article part."""
    old = (F.size("geometry") > 0) | F.col("fluid_name").isNotNull()
    return configs.select("config_name", F.when(F.coalesce(old, F.lit(False)), "old").otherwise("new").alias("format"), F.struct("config_name", "test_type", "u_types").alias("bench"), F.struct("geometry", "fluid_name").alias("article"))


def parse_test_id(test_id: Column) -> dict[str, Column]:
    """Parts of ``SYSTEM-CAMPAIGN-TYPE-RUN`` and the campaign name that they suggest."""
    parts = F.split(test_id, "-")
    whole = F.size(parts) >= 4
    kind = F.when(whole, F.element_at(parts, -2))
    system = F.element_at(parts, 1)
    campaign = F.when(whole, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 3, F.lit(1))), "-"))
    return {"system": system, "campaign": campaign, "kind": kind, "run": F.when(whole, F.element_at(parts, -1)), "suggested": F.when(whole, F.concat_ws("-", system, kind, campaign))}


def against_template(configs: DataFrame, template: dict) -> DataFrame:
    """Keys of a template (``test_type``, ``uncertainties``, ``settings``) that configurations lack."""
    lacks = F.concat(F.array_except(F.array(*map(F.lit, template["uncertainties"])), F.map_keys("u_types")), F.array_except(F.array(*map(F.lit, template["settings"])), F.map_keys("settings")))
    return configs.select("config_name", (F.col("test_type") == template["test_type"]).alias("type_matches"), F.array_sort(lacks).alias("missing"))


def overlay(base: DataFrame, override: DataFrame, keys: list[str], fill_only: bool = False) -> DataFrame:
    """``base`` with columns of ``override``: its known values win, or only fill what is missing."""
    columns = [c for c in override.columns if c not in keys]
    o = override.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    j = base.join(o, keys, "left")
    merged = [F.coalesce(*([F.col(c), F.col(f"_{c}")] if fill_only else [F.col(f"_{c}"), F.col(c)])).alias(c) if c in columns else F.col(c) for c in base.columns]
    return j.select(*merged)


def merge_config(config: DataFrame, metadata: DataFrame) -> DataFrame:
    """Configuration and metadata by test: metadata's geometry, fluid and roles replace, test conditions merge."""
    m = metadata.select("test_id", *[F.col(c).alias(f"_{c}") for c in ("geometry", "fluid_name", "sensor_roles", "conditions")])
    j = config.join(m, "test_id", "left")
    merged = {c: F.coalesce(f"_{c}", c) for c in ("geometry", "fluid_name", "sensor_roles")}
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce("conditions", empty), lambda k, v: ~F.coalesce(F.map_contains_key(F.col("_conditions"), k), F.lit(False)))
    return j.withColumns(merged | {"conditions": F.map_concat(kept, F.coalesce("_conditions", empty))}).drop("_geometry", "_fluid_name", "_sensor_roles", "_conditions")
