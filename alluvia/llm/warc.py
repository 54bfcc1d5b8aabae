"""Content-addressed WARC archives.

Records are written as WARC/1.1 files, read back by content length, and kept as two tables: ``payloads`` holds the bytes
of each distinct payload once under its verified SHA-256, ``headers`` holds the exact header bytes of every record.
The original records come back by joining the two on the digest.

Defined results: a null payload is an empty one; a null page_id is never the smallest and is written as ``none``; rows that
share the smallest page_id of a payload are all responses; line breaks in a URL are percent-encoded, a null URL is empty;
an empty table gives no archives; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alluvia.llm import bloom
from alluvia.storage import Fs, Scratch

CRLF = "\r\n"
ID = "urn:warc:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY = 20
RECORDS = "page_id long, record_type string, payload_digest string, refers_to long, header binary, payload binary"


def classify(pages: DataFrame, least: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """Each page with its payload, digest, size and, for all but the first of equal payloads of at least ``least`` bytes, the page that it repeats.

    Only pages whose digest has a revisit are exchanged with their payloads, where adaptive execution splits a digest shared by many rows; the others are
    kept back by a Bloom filter of 2 MB. A revisit has no payload from there on, so the exchanges here, in write_store and in reconstruct together move at
    most two payloads for each page, on average over its group and whatever the table repeats, and three for a page that the filter passes wrongly."""
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", F.col("url"), html.alias("html")).withColumns({"payload_digest": F.sha2(F.col("html").cast("binary"), 256), "payload_bytes": F.octet_length("html").cast("long")})
    ids = p.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count("page_id").alias("n_ids"), F.count("*").alias("n"))
    again = scratch.save(ids.filter("first_id < last_id OR (n_ids > 0 AND n_ids < n)").select("payload_digest", "first_id"), "again")
    marked = bloom.flagged(p, scratch.save(bloom.of(again, "payload_digest"), "filter"), "payload_digest")
    alone = marked.filter(~F.col("__maybe")).drop("__maybe").withColumn("refers_to", F.lit(None).cast(p.schema["page_id"].dataType))
    met = marked.filter("__maybe").drop("__maybe").join(again, "payload_digest", "left")
    return alone.unionByName(met.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id"))).drop("first_id"))


def write_archives(classified: DataFrame, path: str, records_per_file: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write gzipped WARC files; a revisit has no block. The records' end is the line separator of Spark's text writer.
    Spark's first task writes a file even if it has no rows; such files (EMPTY is what gzip makes of nothing) are removed."""
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    url = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    again = F.col("refers_to").isNotNull()
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")), F.lit(f"{CRLF}WARC-Profile: {PROFILE}"))).otherwise(F.lit("Content-Type: text/html; charset=utf-8")),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.when(again, F.lit(CRLF)).otherwise(F.concat(F.lit(CRLF), F.col("html"))),
    ]
    head = F.concat_ws(CRLF, *lines[:-1])
    value = F.concat(head, F.lit(CRLF), F.when(again, F.lit(CRLF)).otherwise(lines[-1]))
    classified.select(value.alias("value")).write.mode("overwrite").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    fs = Fs(classified.sparkSession)
    for p, size, _ in fs.list(path):
        if p.endswith(".gz") and size <= EMPTY:
            fs.delete(p)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """The records of one archive: fields, exact header bytes (with the empty line that ends them), block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        header = data[at:end]
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in header[:-4].decode("utf-8").split(CRLF)[1:])
        size = int(fields["Content-Length"])
        if data[end + size : end + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('WARC-Record-ID')} does not end where its length says")
        yield fields, header, data[end : end + size]
        at = end + size + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below a path; a response whose block does not have its digest fails the read."""

    def number(x: str | None) -> int | None:
        return None if x is None or (v := x[1:-1].removeprefix(ID)) == "none" else int(v)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("header", pa.binary()), ("payload", pa.binary())])
        for b in batches:
            for content in b.column(0):
                out, held = [], 0
                for f, header, block in parse(zlib.decompress(content.as_py(), 31)):
                    kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"record {f['WARC-Record-ID']}: the block does not have digest {digest}")
                    out.append((number(f["WARC-Record-ID"]), kind, digest, number(f.get("WARC-Refers-To")), header, block if kind == "response" else None))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content").mapInArrow(rows, RECORDS)


def write_store(records: DataFrame, path: str) -> None:
    """Split records into ``headers`` and, once for each digest, ``payloads``."""
    records.drop("payload").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")
    once = records.filter(F.col("payload").isNotNull()).groupBy("payload_digest").agg(F.first("payload").alias("payload"))
    once.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    headers = spark.read.schema("page_id long, record_type string, payload_digest string, refers_to long, header binary").parquet(f"{path}/headers")
    return headers, spark.read.schema("payload_digest string, payload binary").parquet(f"{path}/payloads")


def reconstruct(spark: SparkSession, path: str, how: str = "inner") -> DataFrame:
    """Each record as it stood in its archive (``record``: header, block and end) and its full payload, also for revisits."""
    headers, payloads = store(spark, path)
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return headers.join(payloads, "payload_digest", how).withColumn("record", F.concat("header", block, F.lit(b"\r\n\r\n")))


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """What each record says once it is rebuilt: digest and size computed from its full payload, its bytes held against header and block."""
    size = F.octet_length("payload").cast("long")
    start = F.octet_length("header") + 1
    block = F.when(F.col("record_type") == "response", size).otherwise(F.lit(0).cast("long")).cast("int")
    stands = F.when(F.col("record_type") == "response", F.sha2(F.substring("record", start, block), 256) == F.col("payload_digest")).otherwise(F.lit(True))
    whole = (F.sha2("payload", 256) == F.col("payload_digest")) & (F.octet_length("record") == start + block + 3) & stands
    digest = F.when(whole, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("wrong record under "), F.col("payload_digest"))).cast("string"))
    return reconstruct(spark, path, "left").select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """What a store says of each record, the digest and size computed anew from the payload's bytes before the join, which so moves none of them."""
    headers, payloads = store(spark, path)
    p = payloads.select("payload_digest", F.sha2("payload", 256).alias("found"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    digest = F.when(F.col("found") == F.col("payload_digest"), F.col("found")).otherwise(F.raise_error(F.concat(F.lit("wrong payload under "), F.col("payload_digest"))).cast("string"))
    return headers.join(p, "payload_digest", "left").select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
