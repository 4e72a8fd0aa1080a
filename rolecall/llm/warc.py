"""WARC archives whose repeated payloads are revisit records.

``write_archives`` digests every payload, shuffles only the headers by digest to choose
one response per payload, and writes records with fresh headers as gzip'd WARC files
through Spark's own text writer (its line end is the blank lines that end a record), so
that a lost task is simply written again. ``read_archives`` parses the files by their
Content-Length and joins revisit records to the responses they refer to.

Defined results: a null payload is empty; of equal payloads of at least ``least`` bytes
the record with the largest page id is the response (of repeated ids one of the rows, a
null id comes last), the others revisit it; smaller payloads are all responses; an empty
table gives an empty archive; extra columns have no influence.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.llm import rows
from rolecall.session import fresh_dir, staged

END = "\r\n\r\n"
#: Bytes of records meant for one file; files are parsed whole.
FILE_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def headers(pages: DataFrame) -> DataFrame:
    """``_key``, ``_id``, payload bytes and digest of each page; no payload leaves its task."""

    def digest(batches):
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(x) for x in raw], pa.int64()),
                    pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in raw], pa.string()),
                ],
                ["_key", "_id", "payload_bytes", "payload_digest"],
            )

    return pages.select("_key", "_id", "html").mapInArrow(digest, "_key bigint, _id bigint, payload_bytes bigint, payload_digest string")


def decide(heads: DataFrame, least: int) -> DataFrame:
    """The heads with ``response_key`` and ``response_id``, null for responses."""
    # max of (id, key) per payload combines within tasks before the shuffle, so a common payload is no hot key
    chosen = (
        heads.filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max(F.struct(F.col("_id").isNotNull().alias("named"), F.col("_id").alias("id"), F.col("_key").alias("key"))).alias("top"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("payload_digest", "payload_bytes", "top")
    )
    first = F.col("top").isNull() | (F.col("top.key") == F.col("_key"))
    return heads.join(chosen, ["payload_digest", "payload_bytes"], "left").select(
        "_key",
        "_id",
        "payload_bytes",
        "payload_digest",
        F.when(~first, F.col("top.key")).alias("response_key"),
        F.when(~first, F.col("top.id")).alias("response_id"),
    )


def record_id(key: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page-row/{key}')}>"


def record(key: int, page_id, url, digest: str, size: int, html: str | None, response_key, date: str) -> str:
    """One WARC record without the blank lines that end it."""
    lines = ["WARC/1.1", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else "%20" for c in url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    head = HTTP.format(size)
    if response_key is None:
        body = head + (html or "")
        lines += ["WARC-Type: response", "Content-Type: application/http; msgtype=response"]
    else:
        body = head
        lines += ["WARC-Type: revisit", f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(response_key)}"]
        lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(body.encode())}")
    return "\r\n".join(lines) + END + body


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "2001-09-01T00:00:00Z"
) -> None:
    """Write every row of ``pages`` as a record of the archives below ``path``."""
    source = rows.keyed(
        pages.select(F.col(id_col).try_cast("long").alias("_row"), F.col(url_col).alias("url"), F.col(payload_col).alias("html")), "_row", "url", "html"
    )
    heads = staged(decide(headers(source), least), "warc-heads")
    total = heads.agg(F.sum(F.when(F.col("response_key").isNull(), F.col("payload_bytes")).otherwise(0) + F.lit(600)).alias("n")).first().n or 0
    # dealt by key into as many parts as files; the join keeps that dealing, so payloads move once
    dealt = source.select("_key", "url", "html").repartition(rows.shards(total, FILE_BYTES), "_key").join(heads, "_key")

    def build(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(
                        [
                            record(r["_key"], r["_id"], r["url"], r["payload_digest"], r["payload_bytes"], r["html"], r["response_key"], date)
                            for r in batch.to_pylist()
                        ],
                        pa.string(),
                    )
                ],
                ["value"],
            )

    dealt.mapInArrow(build, "value string").write.option("lineSep", END).option("compression", "gzip").text(path)


def parse(raw: bytes):
    """(headers, body) of each record; bodies may hold anything, as their length is given."""
    at = 0
    while at < len(raw):
        cut = raw.index(b"\r\n\r\n", at)
        lines = raw[at:cut].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        yield head, raw[cut + 4 : cut + 4 + size]
        if raw[cut + 4 + size : cut + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end where it says")
        at = cut + 8 + size


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record below ``path``; revisit records have the payload facts of the response they refer to."""
    import gzip

    def records(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                out: list[dict] = []
                for head, body in parse(gzip.GzipFile(fileobj=io.BytesIO(raw)).read()):
                    payload = body[body.index(b"\r\n\r\n") + 4 :]
                    kind = head["WARC-Type"]
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest != told:
                        raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
                    out.append(
                        {
                            "record_id": head["WARC-Record-ID"],
                            "page_id": int(head["X-Page-Id"]) if "X-Page-Id" in head else None,
                            "record_type": kind,
                            "payload_digest": told,
                            "payload_bytes": len(payload) if kind == "response" else None,
                            "refers_to_record": head.get("WARC-Refers-To"),
                            "payload": payload.decode("utf-8", "replace") if payloads and kind == "response" else None,
                        }
                    )
                    if len(out) == 500:
                        yield pa.RecordBatch.from_pylist(out, schema=kind_of)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema=kind_of)

    fields = "record_id string, page_id bigint, record_type string, payload_digest string, payload_bytes bigint, refers_to_record string, payload string"
    types = {"string": pa.string(), "bigint": pa.int64()}
    kind_of = pa.schema([(name, types[kind]) for name, kind in (f.split() for f in fields.split(", "))])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = files.mapInArrow(records, fields)
    return found


def resolve(records: DataFrame) -> DataFrame:
    """Revisit records joined to the responses they refer to."""
    answers = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_full")
    )
    visits = records.filter("record_type = 'revisit'").join(answers, "refers_to_record", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        records.filter("record_type = 'response'")
        .withColumn("refers_to", F.lit(None).cast("long"))
        .select(*columns)
        .unionByName(visits.withColumn("payload_bytes", F.col("_full")).select(*columns))
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as deduplicated archives and read them back."""
    path = fresh_dir(spark, "warc")
    write_archives(rows.table(spark, sf_dir, "pages"), path)
    return resolve(staged(read_archives(spark, path).drop("payload"), "warc-records"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex,
    max(page_id) OVER (PARTITION BY sha1(payload)) AS top FROM p
), chars AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      list_sum(list_transform(range(5), lambda b: ((CAST('0x' || substr(hex, 1 + (5 * k + b) // 4, 1) AS INTEGER)
        >> CAST(3 - (5 * k + b) % 4 AS INTEGER)) & 1) << CAST(4 - b AS INTEGER))) AS INTEGER), 1), '' ORDER BY k) AS payload_digest
  FROM d, range(32) AS r(k) GROUP BY page_id
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM d JOIN chars USING (page_id)
"""
