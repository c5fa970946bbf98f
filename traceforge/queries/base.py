"""The registry, and the views that present the given tables as recordings and campaign results.

A test is ten users' events, a channel an event type, a sample an event; a campaign is a hundred customers'
orders. Tests and campaigns therefore grow in number with the data, and keep their size.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``, with its DuckDB SQL."""

    def add(fn):
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for files that a query writes and reads again: in the shared folder, or a local one on a local master.

    It is deleted when the driver ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}"
    path = f"{folder.rstrip('/')}/traceforge-{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def a_file_a_row(rows: DataFrame, path: str) -> None:
    """Writes ``(folder, value)``, already dealt by folder, as a file for each row below ``path/folder=...``.

    Below a ``file:`` path, local or shared, tasks write the files themselves: Hadoop starts a process for the permissions of
    each. Other stores are written by Spark.
    """
    hadoop_path = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop_path.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
    if store.getScheme() != "file":
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("maxRecordsPerFile", 1).partitionBy("folder").text(path)
        return
    store.mkdirs(hadoop_path)
    top = hadoop_path.toUri().getPath()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies: Counter = Counter()  # a retried task writes the same names again
        for batch in batches:
            for folder, value in zip(batch["folder"].to_pylist(), batch["value"].to_pylist()):
                own = f"{top}/folder={'__HIVE_DEFAULT_PARTITION__' if folder is None else folder}"
                os.makedirs(own, exist_ok=True)
                with open(made := f"{own}/.{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
                    f.write(f"{value or ''}\n")
                os.replace(made, f"{own}/part-{copies[folder]}.txt")
                copies[folder] += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([copies.total()], pa.int64())})

    rows.mapInArrow(run, "files long").collect()


#: Samples in a task.
TASK_ROWS = 50_000


def tasks_for(events: DataFrame) -> int:
    return max(events.sparkSession.sparkContext.defaultParallelism, -(-events.count() // TASK_ROWS))


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(test_id, channel, seq, timestamp, value)``, timestamps in microseconds."""
    events = table(spark, sf_dir, "events")
    e = events.select(
        F.concat(F.lit("T"), F.floor(F.col("user_id") / 10)).alias("test_id"),
        F.col("event_type").alias("channel"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"),
        "value",
        "event_id",
    ).repartition(tasks_for(events), "test_id")
    order = Window.partitionBy("test_id", "channel").orderBy("timestamp", "event_id")
    return e.select("test_id", "channel", (F.row_number().over(order) - 1).cast("long").alias("seq"), "timestamp", "value", "event_id")


def readings(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """``(test_id, channel, seq, time_s, value)``; with ``gaps``, one value in seventeen or so is missing.

    Tests are dealt once, over tasks whose number grows with the samples; a test's first time comes from the sort that
    numbers its samples, and the windows, aggregates and joins by test or series that follow need no other shuffle. A
    task's memory stays as the data grow. Without a number, Spark puts partitions together up to 64 MB, which many sorts
    of one task then hold.
    """
    raw = raw_readings(spark, sf_dir).withColumn("t0", F.min("timestamp").over(Window.partitionBy("test_id")))
    value = F.when(F.col("event_id") % 17 != 0, F.col("value")) if gaps else F.col("value")
    return raw.select("test_id", "channel", "seq", ((F.col("timestamp") - F.col("t0")) / 1e6).alias("time_s"), value.alias("value"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign results, one row per test: ``campaign_name, test_id, test_timestamp, part, avg_price, avg_balance, u_price, qc_passed``."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.select(
        F.concat("c_mktsegment", F.lit("-"), F.floor(F.col("c_custkey") / 100)).alias("campaign_name"),
        F.col("o_orderkey").alias("test_id"),
        F.col("o_orderdate").alias("test_timestamp"),
        F.col("o_orderpriority").alias("part"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_totalprice") / 1000).alias("avg_price"),
        F.col("c_acctbal").alias("avg_balance"),
        (F.col("o_totalprice") / 50000).alias("u_price"),
        (F.col("o_orderkey") % 10 != 0).alias("qc_passed"),
    )


RAW = """raw AS (
  SELECT 'T' || (user_id // 10) AS test_id, event_type AS channel,
         row_number() OVER (PARTITION BY user_id // 10, event_type ORDER BY ts, event_id) - 1 AS seq,
         epoch_us(ts) AS ts_us, value AS v, event_id
  FROM events)"""
READINGS = f"""{RAW}, readings AS (
  SELECT test_id, channel, seq, (ts_us - min(ts_us) OVER (PARTITION BY test_id)) / 1e6 AS time_s, v AS value FROM raw)"""
GAPPED = f"""{RAW}, readings AS (
  SELECT test_id, channel, seq, (ts_us - min(ts_us) OVER (PARTITION BY test_id)) / 1e6 AS time_s,
         CASE WHEN event_id % 17 <> 0 THEN v END AS value FROM raw)"""
RESULTS = """results AS (
  SELECT c_mktsegment || '-' || (c_custkey // 100) AS campaign_name, o_orderkey AS test_id, o_orderdate AS test_timestamp,
         o_orderpriority AS part, o_orderstatus AS status, o_totalprice / 1000 AS avg_price, c_acctbal AS avg_balance,
         o_totalprice / 50000 AS u_price, o_orderkey % 10 <> 0 AS qc_passed
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums taken in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
