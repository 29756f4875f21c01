"""Content-addressed WARC archive (operator 4).

Two tables make the archive: `payloads` holds each distinct payload once, under its SHA-256 and
length, and `headers` holds the exact header bytes of every record with the address of its payload.
Original records are reconstructed by joining them. Equal digests are verified: if payloads of one
address differ (by a second digest of another family), writing fails rather than merging them.

A record is a `response`, with the payload as its block, or, where a payload of at least
`least` bytes occurs again, a `revisit` of the record with the largest id, with an empty block.
The archive is exported as WARC/1.1 files by Spark's text writer, whose line separator is the blank
line that ends a record, and read back with `Content-Length` framing.

Null payloads are empty, ties in id (repeated rows) get revisits of the one response chosen by
(id, url), an empty table gives an archive without records, and other columns are ignored. A null id
is written as `null` and is read back as null; a group of equal payloads prefers any id to null.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.llm.kernels import cut, shared, sized, tidy

LEAST = 1000
TIME = "2024-01-01T00:00:00Z"


#: Rows of one address that meet in a task at most; an address with more is dealt to several.
SALTED = 20_000
#: Classes of payload sizes (bytes up to) and records to a file, so that a file holds 128 MB or one record.
CLASSES = [(64 << 10, 2_000), (4 << 20, 32), (None, 1)]


def archive_tables(pages: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The `payloads` and `headers` tables of pages (page_id, url, html)."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    # row numbers are given once: a plan that runs again may give others
    slim = cut(rows.select("page_id", "url", "address", "sha1", "bytes", F.monotonically_increasing_id().alias("n")))
    lead = slim.groupBy("address").agg(F.max(F.struct("page_id", "url", "n")).alias("lead"), F.max("sha1").alias("most"), F.min("sha1").alias("other"), F.count(F.lit(1)).alias("many"))
    same = F.when(F.col("most") == F.col("other"), F.col("most")).otherwise(F.raise_error(F.concat(F.lit("two payloads share the address "), F.col("address"))))
    # a hot address has a row for each of its salts, and so have its payloads later
    salts = F.greatest(F.lit(1), F.ceil(F.col("many") / SALTED)).cast("int")
    lead = lead.select("address", "lead", same.alias("sha1"), salts.alias("salts"))
    # once per address: partial aggregation leaves one payload a map task and address
    payloads = rows.groupBy("address").agg(F.first("bytes").alias("bytes"), F.first("payload").alias("payload"))
    payloads = payloads.join(lead.select("address", "sha1", "salts"), "address").select("address", "bytes", "sha1", "salts", "payload")
    dealt = lead.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("address", "salt", "lead")
    # what only small, common payloads share is joined by salt too: their number is known from one aggregate of slim rows
    hot = sized(lead.where("salts > 1").select(F.col("address").alias("h_address"), F.col("salts").alias("h_salts")))
    slim = slim.join(hot, F.col("address") == F.col("h_address"), "left").withColumn("salt", F.pmod("n", F.coalesce("h_salts", F.lit(1)).cast("long")).cast("int"))
    headed = slim.join(dealt, ["address", "salt"])
    # the leader is one row: of repeated rows only the last one
    response = (F.col("bytes") < least) | ((F.col("n") == F.col("lead.n")) & F.col("page_id").eqNullSafe(F.col("lead.page_id")))
    # repeated rows have one page_id, so a record's name has the row's number too
    name = lambda c, n: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit("#"), n.cast("string"), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    kind = F.when(F.col("response"), "response").otherwise("revisit")
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", name(F.col("page_id"), F.col("n"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A")), line("WARC-Date", F.lit(TIME)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Payload-Address", F.concat(F.lit("sha256:"), F.col("address"))),
        F.when(F.col("response"), F.lit("")).otherwise(F.concat(line("WARC-Refers-To", name(F.col("lead.page_id"), F.col("lead.n"))), line("WARC-Profile", profile))),
        line("Content-Type", F.lit("text/html")), line("Content-Length", F.when(F.col("response"), F.col("bytes")).otherwise(0).cast("string")), F.lit("\r\n"),
    )
    headed = headed.withColumn("response", response)
    return payloads, headed.select("page_id", "address", "salt", F.when(F.col("response"), F.col("bytes")).otherwise(0).alias("bytes"), kind.alias("record_type"), header.cast("binary").alias("header"))


def reconstructed(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """The original record of each header (and its `bytes`): exact header bytes and, for responses, the payload.

    Payloads of common addresses go to as many tasks as those have salts; the others stay where their bucket is.
    """
    responses = headers.where("record_type = 'response'")
    one, several = payloads.where("salts = 1"), payloads.where("salts > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    common = sized(payloads.where("salts > 1").select("address"))
    rare = responses.join(common, "address", "left_anti").join(one.select("address", "payload"), "address").select("header", "payload", "bytes")
    often = responses.join(several.select("address", "salt", "payload"), ["address", "salt"]).select("header", "payload", "bytes")
    return rare.unionByName(often).unionByName(headers.where("record_type = 'revisit'").select("header", F.lit(b"").alias("payload"), "bytes"))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files of records (header, payload, bytes), cut by size: a folder for each class of payload sizes that occurs.

    Casting bytes to a string keeps them as they are, and the writer adds the blank line that ends a record.
    """
    value = F.concat("header", "payload").cast("string").alias("value")
    low = -1
    for high, per_file in CLASSES:
        own = records.where((F.col("bytes") > low) & (F.lit(True) if high is None else F.col("bytes") <= high))
        own.select(value).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).option("compression", "gzip").text(f"{path}/upto-{high or 'any'}")
        low = high


FIELD = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


OWN = re.compile(r"<urn:page:(-?\d+)(?:#\d+)?>")


def records_of(data: bytes | BinaryIO) -> Iterator[tuple[dict, bytes, bytes]]:
    """(fields, header bytes, block) of each record of a WARC file, one at a time."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    while line := stream.readline():
        if not line.strip():  # more blank lines between records than there should be
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        head = [line]
        while (line := stream.readline()) and line.strip():
            head.append(line)
        fields = {k.decode("utf-8", "replace").lower(): v.decode("utf-8", "replace") for k, v in FIELD.findall(b"".join(head[1:]))}
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) < n or stream.read(2) != b"\r\n" or stream.read(2) != b"\r\n":
            raise ValueError(f"the record {fields.get('warc-record-id')} is cut short")
        yield fields, b"".join(head) + line, block


def opened(data: bytes) -> BinaryIO:
    """A file's bytes as a stream, unpacked as it is read if they are gzip members."""
    stream = io.BytesIO(data)
    return gzip.GzipFile(fileobj=stream) if data[:2] == b"\x1f\x8b" else stream


def plain_digest(value: str | None) -> str | None:
    """A SHA-1 digest as bare lower-case hex, from hex or base32; of another kind as it stands."""
    kind, _, text = (value or "").rpartition(":")
    if kind.lower() not in ("", "sha1"):
        return value
    if len(text) == 32:
        return base64.b32decode(text.upper()).hex()
    return text.lower() or None


def checked_payload(fields: dict, block: bytes) -> bytes:
    """The payload of a record: its block, or what follows the HTTP header in it. A digest that the bytes don't have is an error.

    Payload digests of HTTP messages may be of the decoded body and aren't checked; block digests always are.
    """
    sha1 = hashlib.sha1(block).hexdigest()
    http = fields.get("content-type", "").replace(" ", "").lower().startswith("application/http")
    for name in ("warc-block-digest", *(() if http else ("warc-payload-digest",))):
        digest = plain_digest(fields.get(name))
        if digest and ":" not in digest and digest != sha1:
            raise ValueError(f"the record {fields.get('warc-record-id')} doesn't have its digest")
    return block.partition(b"\r\n\r\n")[2] if http else block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files below `path`, packed or not, ours or others': record_id, page_id, url, record_type, refers_to, digest, address, header, payload.

    page_id and refers_to are null for names that archive_tables didn't give, url where a record has none (warcinfo), digest is
    bare hex of SHA-1, the payload null in revisits. A file that isn't WARC is an error; a packed file is held whole, its
    records are unpacked one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lambda x: int(m[1]) if (m := OWN.fullmatch(x or "")) else None
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for f, head, block in records_of(opened(data.as_py())):
                    kind = f.get("warc-type")
                    payload = checked_payload(f, block) if kind != "revisit" else None
                    digest = plain_digest(f.get("warc-payload-digest"))
                    rows.append((f.get("warc-record-id"), own(f.get("warc-record-id")), f.get("warc-target-uri"), kind, own(f.get("warc-refers-to")), digest, f.get("warc-payload-address", digest or "").removeprefix("sha256:"), head, payload))
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(tidy(run), "record_id string, page_id long, url string, record_type string, refers_to long, digest string, address string, header binary, payload binary")


NAMES = ["record_id", "page_id", "url", "record_type", "refers_to", "digest", "address", "header", "payload"]
TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archive of `pages`, reads it back and gives each page's full payload digest and record."""
    spark = pages.sparkSession
    at = f"{shared(spark)}/warc-{uuid.uuid4().hex}"
    payloads, headers = archive_tables(pages)
    # bucketed by address, so that joining headers to payloads moves no payload again
    name, n = f"payloads_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    payloads.repartition(n, "address").write.bucketBy(n, "address").option("path", f"{at}/payloads").option("compression", "zstd").saveAsTable(name)
    try:
        headers.write.parquet(f"{at}/headers")
        write_warc(reconstructed(spark.table(name), spark.read.parquet(f"{at}/headers")), f"{at}/files")
    finally:
        spark.sql(f"drop table {name}")  # an external table: its files stay
    back = read_warc(spark, f"{at}/files")
    # what a payload says of itself, once per address; a response has it in its own record
    said = back.select("page_id", "record_type", "refers_to", "address", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    said = cut(said)
    found = said.where("record_type = 'response'").groupBy("address").agg(F.max("payload_bytes").alias("b"), F.max("payload_digest").alias("d"))
    revisits = said.where("record_type = 'revisit'").join(found, "address").select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to")
    return said.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(revisits)
