"""Helpers that several training-data operators use: shared tables, work on texts, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Types of the columns that :func:`worked` can add, to Spark and to Arrow.
TYPES = {
    "int": (IntegerType(), pa.int32()),
    "long": (LongType(), pa.int64()),
    "double": (DoubleType(), pa.float64()),
    "string": (StringType(), pa.string()),
    "binary": (BinaryType(), pa.binary()),
    "array<double>": (ArrayType(DoubleType()), pa.list_(pa.float64())),
    "array<int>": (ArrayType(IntegerType()), pa.list_(pa.int32())),
    "array<string>": (ArrayType(StringType()), pa.list_(pa.string())),
}


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master (tests) may go without the setting; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='traceforge-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends there, so a lost executor costs a reread.

    The shuffle files of the write go when it is done; the session's setting for that is put back.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def worked(df: DataFrame, inputs: list[str], added: dict[str, str], setup: Callable[[], Callable[..., Sequence[Sequence]]], drop: list[str] | None = None) -> DataFrame:
    """``df`` with the columns ``added`` (name to type), computed in Arrow batches from the columns ``inputs``.

    ``setup`` runs once a task and returns a function from lists of input values to one list for each added
    column. All other columns pass through as Arrow values, so ids of any size, nulls and types stay as they
    are. ``drop`` names the columns that the result leaves out, which are all ``inputs`` unless given.
    """
    rest = [i for i, c in enumerate(df.columns) if c not in (inputs if drop is None else drop)]
    where = [df.columns.index(c) for c in inputs]
    names = [f"c{i}" for i in range(len(rest) + len(added))]
    kinds = [df.schema[i].dataType for i in rest] + [TYPES[kind][0] for kind in added.values()]
    schema = StructType([StructField(n, k, True) for n, k in zip(names, kinds)])
    types = [TYPES[kind][1] for kind in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            made = work(*[batch.column(i).to_pylist() for i in where])
            arrays = [batch.column(i) for i in rest] + [pa.array(x, t) for x, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    positions = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return positions.mapInArrow(run, schema).toDF(*[df.columns[i] for i in rest], *added)


def hooked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (of every node, the smallest index known in its set) after joining the sets of edges ``a``-``b``."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        on = low != high
        if not on.any():
            break
        a, b = a[on], b[on]
        np.minimum.at(root, high[on], low[on])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph as ``(node, component)``, component = smallest node.

    ``edges`` has two columns of one orderable type without nulls; self-loops and repeats are fine.
    Nodes without a non-loop edge are not returned. Alternating large-star and small-star steps
    (Kiveris et al. 2014): every step is one partial-aggregated minimum and one equi join, and the
    edge set is written to the shared folder between rounds.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "links")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    links, path = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())

    def fingerprint(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = fingerprint(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: every smaller neighbour and the node itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, new = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        drop_path(spark, path)  # the round before is not needed any more
        now, before_was = fingerprint(after), before
        links, path, before = after, new, now
        if now == before_was:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node")).distinct()
    return (
        links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(roots.withColumn("component", F.col("node")))
    )
