"""The corpus pipeline: five stages, each one operator over all that the stage before it kept.

Quality, toxicity, near duplicates and benchmark contamination take documents away; the last stage encodes
what is left. Every stage's result is written as Parquet to the shared folder and read again by the next.

Cases: null and empty texts are judged like any others, and equal ones are one document to the third stage; null
ids are carried along; rows that share an id are judged by their own texts; rows equal in all columns are one after
the third stage; columns beside ``doc_id`` and ``text`` come back as they were, whatever their names; an empty
table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceforge.llm import bpe, decontam, simhash
from traceforge.llm.crf_quality import QualityModel
from traceforge.llm.queries import table, tokenizer_path
from traceforge.llm.shared import stored
from traceforge.llm.toxicity import ToxicityModel


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, fitted on the labelled rows among them, does not reject."""
    return QualityModel.fit(docs, table(spark, sf_dir, "labels")).kept(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic to the models fitted on the labelled rows among them."""
    return ToxicityModel.fit(docs, table(spark, sf_dir, "labels")).kept(docs)


def hashable(name: str, kind: str) -> Column:
    """A column that ``xxhash64`` takes: maps as their entries in order, types that hold maps as JSON."""
    if kind.startswith("map<"):
        return F.array_sort(F.transform(F.map_entries(name), lambda e: F.to_json(F.struct(e))))
    return F.to_json(F.struct(name)) if "map<" in kind else F.col(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share 0.8 of their five-word shingles: wide fingerprints find the links,
    the shingles decide them.

    It is the row with the smallest id; rows without an id come last, and equal ids are told apart by a hash of
    their columns, then by the text's digest. Rows equal in all columns are one. Only ids and digests travel to the
    decision; texts move once, to meet it.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    told = [hashable(c, kind) for c, (_, kind) in zip(names, docs.dtypes) if c != text]
    rows = docs.toDF(*names).withColumns({"digest": F.md5(F.coalesce(text, F.lit("")).cast("binary")), "row": F.xxhash64(*told, F.col(text).isNull())})
    groups = simhash.groups_of(rows, "digest", text)
    least = rows.groupBy("digest").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "row")).alias("least"))
    chosen = groups.join(least, "digest").groupBy("group").agg(F.min(F.struct("least.*", "digest")).alias("one")).select("one.*")
    same = (rows["digest"] == chosen["digest"]) & (rows["row"] == chosen["row"]) & rows[key].eqNullSafe(chosen["key"])
    return rows.join(chosen, same, "left_semi").dropDuplicates(["digest"]).select(*names).toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = decontam.contamination(docs.toDF(*names), table(spark, sf_dir, "benchmark"), names[docs.columns.index("text")])
    return found.where(~F.col("contaminated")).select(*names).toDF(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    return bpe.encoded(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: SQL cannot express the classifiers; the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
