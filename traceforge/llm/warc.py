"""WARC archives: writing captures, reading records, assembling transactions.

Every page becomes one capture of three records that name each other: a request, a response (or a revisit
of an equal earlier payload) and a metadata record, both others pointing at the response through
``WARC-Concurrent-To``. Spark's text sink writes the records, so each output file is a WARC file in whatever
store the path names, every record a gzip member of its own. Files are read back as binary rows, member by
member, and the records are joined through the concurrent-to identifiers into one nested row per capture.

Of captures with equal payloads of at least ``min_bytes``, the one with the largest page id is the
response, the others are revisits that refer to it and hold no payload of their own. Smaller payloads are
always responses. Rows that repeat are dealt by where they were read, so many of them are many groups.

Cases: null html is an empty payload; a null url is written as an empty one; a null page id comes back null;
rows that repeat an id and payload get identifiers of their own, one of them the response; a payload may hold
header-like lines and record separators, since lengths alone delimit records; payloads of any length below
Spark's limit of 2 GB a row; an empty table writes and reads no records; other columns are ignored. The reader
takes plain files and gzip members that hold one or many records; a file must be under 2 GB.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_BYTES = 1000
#: Groups that rows of one page id and payload are dealt into, by the partition that they were read in.
DEALT = 64
#: Payload bytes to aim for in one file; a file is one row when read back.
FILE_BYTES = 16_000_000
RECORDS = "type string, id string, concurrent_to string, refers_to string, uri string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"


def record_id(*parts: Column) -> Column:
    h = F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """For every distinct (page id, payload, part) of a payload that has several: the page id and part of its response."""
    keys = pages.select("page_id", "key", "payload_digest", "payload_bytes", "part").where(F.col("payload_bytes") >= min_bytes).distinct()
    best = keys.groupBy("payload_digest").agg(F.max(F.struct("page_id", (-F.col("part")).alias("part"))).alias("best"), F.count("*").alias("n")).where("n > 1")
    return keys.join(best, "payload_digest").select("key", "payload_digest", "part", F.col("best.page_id").alias("best"), (-F.col("best.part")).alias("best_part"))


def captures(pages: DataFrame, page_id: str, url: str, html: str, min_bytes: int, files: int) -> DataFrame:
    """Rows with everything that the three records of a capture need; html moves once, by page id, digest and part."""
    body = F.coalesce(F.col(html), F.lit(""))
    base = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("html"), F.pmod(F.spark_partition_id(), F.lit(DEALT)).alias("part"))
    base = base.withColumns({"payload_digest": F.sha1(F.encode("html", "utf-8")), "payload_bytes": F.octet_length("html").cast("long"), "key": F.coalesce(F.col("page_id").cast("string"), F.lit(""))})
    best = roles(base, min_bytes)
    group = ["key", "payload_digest", "part"]
    # the join, the count of copies and the files all use this one partitioning
    rows = base.repartition(files, *group).join(best, group, "left")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*group).orderBy("url")))
    chosen = F.col("best_part").isNull() | (F.col("best").eqNullSafe(F.col("page_id")) & (F.col("best_part") == F.col("part")))
    is_revisit = (F.col("payload_bytes") >= min_bytes) & ~((F.col("copy") == 1) & chosen)
    of, of_part = F.when(F.col("best_part").isNull(), F.col("page_id")).otherwise(F.col("best")), F.coalesce("best_part", "part")
    return rows.withColumns(
        {
            "is_revisit": is_revisit,
            "id": record_id(F.lit("response"), F.col("page_id"), F.col("payload_digest"), F.col("part"), F.col("copy")),
            "refers_to": F.when(is_revisit, record_id(F.lit("response"), of, F.col("payload_digest"), of_part, F.lit(1))),
        }
    )


def header(kind: str | Column, rid: Column, length: Column, *lines: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    top = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit("WARC-Date: 2024-01-01T00:00:00Z")]
    return F.concat(F.concat_ws("\r\n", *top, *lines, F.concat(F.lit("Content-Length: "), length)), F.lit("\r\n\r\n"))


def field(name: str, value: Column) -> Column:
    """A header line, or null (and so no line) where the value is null."""
    return F.concat(F.lit(f"{name}: "), value)


def records(rows: DataFrame) -> DataFrame:
    """The captures' records as text, one row each."""
    uri = field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " "))
    response_head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n"))
    block = F.when(F.col("is_revisit"), response_head).otherwise(F.concat(response_head, F.col("html")))
    digest = field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))
    profile = F.when(F.col("is_revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    kind = F.when(F.col("is_revisit"), "revisit").otherwise("response")
    http = F.lit("Content-Type: application/http;msgtype=response")
    response = F.concat(header(kind, F.col("id"), F.octet_length(block), uri, http, digest, profile, field("WARC-Refers-To", F.col("refers_to"))), block)
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^\s#]*)", 1), F.lit("")), F.lit("/"))
    asked = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#\s]*)", 1), F.lit("\r\n\r\n"))
    concurrent = field("WARC-Concurrent-To", F.col("id"))
    request = F.concat(header("request", record_id(F.lit("request"), F.col("id")), F.octet_length(asked), uri, F.lit("Content-Type: application/http;msgtype=request"), concurrent), asked)
    facts = F.concat_ws("\r\n", field("pageId", F.col("page_id").cast("string")), field("payloadBytes", F.col("payload_bytes").cast("string")), F.lit(""))
    metadata = F.concat(header("metadata", record_id(F.lit("metadata"), F.col("id")), F.octet_length(facts), uri, F.lit("Content-Type: application/warc-fields"), concurrent), facts)
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member without its last byte, which is zero and written by the sink between rows.

    A member ends with the length of its content in four bytes, the highest last. Where this is not zero (16 MB
    and more) an empty member follows, which ends in zeros.
    """
    empty = gzip.compress(b"", mtime=0)
    for batch in batches:
        packed = (gzip.compress(record.encode() + b"\r\n\r\n", 6, mtime=0) for record in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([(m if m[-1] == 0 else m + empty)[:-1] for m in packed], pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Write the captures of ``pages`` as WARC files under ``path``."""
    total = pages.agg(F.sum(F.octet_length(html).cast("long"))).first()[0] or 0
    files = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    rows = captures(pages, page_id, url, html, min_bytes, files)
    packed = records(rows).mapInArrow(members, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def parse_records(content: bytes) -> Iterator[tuple]:
    """The records of one archive file, gzipped or plain, read one after another."""
    raw = io.BytesIO(content)
    source = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if content[:2] == b"\x1f\x8b" else raw
    while True:
        line = source.readline()
        while line in (b"\r\n", b"\n"):
            line = source.readline()
        if not line:
            return
        head = {}
        while (line := source.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(":")
            head[name.lower()] = value.strip()
        size = int(head["content-length"])
        block = source.read(size)
        if len(block) != size:
            raise ValueError("an archive ends inside a record")
        kind, payload, fields = head["warc-type"], None, {}
        if kind in ("response", "revisit"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif kind == "metadata":
            fields = dict(f.split(": ", 1) for f in block.decode("utf-8").split("\r\n") if ": " in f)
        yield kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-payload-digest"), fields, payload


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives under ``path``; the digest is computed again from each payload that is there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for kind, rid, concurrent, refers, uri, digest, fields, payload in parse_records(content):
                    size = None if payload is None else len(payload)
                    if kind == "response":
                        digest = hashlib.sha1(payload).hexdigest()
                    elif digest:
                        digest = digest.removeprefix("sha1:")
                    rows.append((kind, rid, concurrent, refers, uri, digest, size, fields, payload if with_payload else None))
                    held += size or 0
                    if held > 8_000_000:
                        yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})

    columns = [c.split()[0] for c in RECORDS.replace("string,string", "s").split(", ")]
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, RECORDS)


def transactions(recs: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, request and metadata, joined by identifiers.

    A revisit's length comes from the record that it refers to.
    """
    main = recs.where(F.col("type").isin("response", "revisit"))
    request = recs.where("type = 'request'").select(F.col("concurrent_to").alias("id"), F.struct("id", "uri").alias("request"))
    metadata = recs.where("type = 'metadata'").select(F.col("concurrent_to").alias("id"), F.struct("id", "fields").alias("metadata"))
    nested = main.select("id", F.struct("type", "id", "refers_to", "uri", "payload_digest", "payload_bytes", "payload").alias("response"))
    joined = nested.join(request, "id", "left").join(metadata, "id", "left")
    target = joined.where("response.type = 'response'").select(
        F.col("id").alias("target_id"), F.struct(F.col("metadata.fields")["pageId"].alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest")).alias("target")
    )
    # only revisits look for a target; the others keep their own facts
    revisits = joined.where("response.type = 'revisit'").withColumn("target_id", F.col("response.refers_to")).join(target, "target_id", "left").drop("target_id")
    plain = joined.where("response.type = 'response'").withColumn("target", F.lit(None).cast(target.schema["target"].dataType))
    return plain.unionByName(revisits)


def page_rows(captured: DataFrame, kind: str = "bigint") -> DataFrame:
    full = F.when(F.col("response.type") == "revisit", F.col("target.payload_bytes")).otherwise(F.col("response.payload_bytes"))
    return captured.select(
        F.col("metadata.fields")["pageId"].cast(kind).alias("page_id"),
        full.alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.type") == "revisit", F.col("target.page_id").cast(kind)).alias("refers_to"),
    )
