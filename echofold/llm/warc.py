"""WARC archives of pages: written as record text by Spark's own committed writer, read back by content length, and
assembled into one nested row per capture.

A capture is three records: a request, then a response (or, where an earlier page has the same payload, a revisit that
refers to it), then metadata. The request and the metadata name the response through WARC-Concurrent-To.
Records end in two line breaks, which is the separator of the text writer; each part file is a WARC file of its own
(gzip-compressed as a whole, as Spark's writers take text, not members). Files are bounded by bytes: FILE_BYTES of payload,
or one capture that is larger; a reader holds one compressed file and one record. A revisit carries the target URI and
date of the record it refers to, and that page's key in a header of its own, as URIs may repeat.

Defined results: null html is an empty payload; null url is an empty target; rows with the same page_id are captures of
their own, told apart by a row number inside their writing task; rows with a null page_id are written, read and returned with a
null page_id, and are never referred to; an empty table gives an empty archive, which reads as no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm.batches import lean
from echofold.llm.storage import settled

FILE_BYTES = 32 << 20
CLASSES = (32 << 10, 1 << 20)  # payloads up to these sizes share files; larger ones have a file each
BROADCAST_DIGESTS = 100_000
VERSION = "WARC/1.1"
BREAK = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: The digits of base 32 as numbers are written, and as RFC 4648 writes them.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "kind string, id string, concurrent_to string, refers_to string, uri string, key string, payload_digest string, payload_bytes long, payload binary"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS, BASE32)


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows key, url, payload binary, payload_bytes, payload_digest, record_type, refers_to (the response's key, or null)
    and its URL.

    Of equal payloads of least_bytes or more the smallest key is the response. The digest's groups are counted before
    the shuffle; only digests that occur again are joined back, broadcast while there are BROADCAST_DIGESTS or fewer, so
    payloads are not shuffled; beyond that by a join whose hot digests Spark may split.
    """
    payload = F.coalesce(pages[html].cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(pages[key].alias("key"), F.coalesce(pages[url], F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": payload_digest(F.col("payload"))})
    again = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min("key").alias("first"), F.min_by("url", "key").alias("first_url"), F.count("*").alias("n")).where("n > 1")
    again = settled(again.select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "first", "first_url"), "warc-again")
    few = again.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    out = rows.join(F.broadcast(again) if few else again, (rows.payload_digest == again.d) & (rows.payload_bytes == again.b), "left")
    revisit = F.coalesce(F.col("first") != F.col("key"), F.col("first").isNotNull() & F.col("key").isNull())
    return out.select("key", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_to_url"))


def _record(fields: list[tuple[str, Column | None]], body: Column) -> Column:
    """One record without its end; a field that is null is left out."""
    lines = [F.lit(VERSION + BREAK)]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit("")) for name, value in fields]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(BREAK + BREAK)))
    return F.concat(F.concat(*lines).cast("binary"), body)


def write(found: DataFrame, path: str, largest: int | None = None) -> None:
    """Writes captures() rows as WARC files below path. largest: a bound of payload_bytes, where it is known."""
    uid = {k: F.concat(F.lit(f"<urn:capture:{k}:"), F.col("cid"), F.lit(">")) for k in ("request", "response", "metadata")}
    url = F.regexp_replace("url", "[\r\n]", "")
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", url)]
    host = F.regexp_extract("url", r"^\w+://([^/?#\r\n]*)", 1)
    path_of = F.regexp_extract("url", r"^\w+://[^/?#]*([^#\r\n]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(path_of == "", "/").otherwise(path_of), F.lit(f" HTTP/1.1{BREAK}Host: "), host, F.lit(BREAK + BREAK)).cast("binary")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(BREAK + BREAK)).cast("binary")
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    note = F.concat(F.lit("page-id: "), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(f"{BREAK}payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(BREAK)).cast("binary")
    profile = F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    records = F.array(
        _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", uid["request"]), ("WARC-Concurrent-To", uid["response"]), *common, ("Content-Type", F.lit("application/http; msgtype=request"))], ask),
        _record([("WARC-Type", F.col("record_type")), ("WARC-Record-ID", uid["response"]), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), ("WARC-Profile", profile), ("WARC-Refers-To-Target-URI", F.regexp_replace("refers_to_url", "[\r\n]", "")), ("WARC-Refers-To-Date", F.when(revisit, DATE)), ("X-Refers-To-Page", F.col("refers_to").cast("string")), ("Content-Type", F.lit("application/http; msgtype=response"))], body),
        _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", uid["metadata"]), ("WARC-Concurrent-To", uid["response"]), *common, ("Content-Type", F.lit("application/warc-fields"))], note),
    )
    most = largest if largest is not None else found.agg(F.max("payload_bytes")).first()[0] or 0
    for low, high in zip((-1, *CLASSES), (*CLASSES, None), strict=True):
        if low >= 0 and most <= low:
            break
        own = found.where(F.col("payload_bytes") > low) if high is None else found.where(F.col("payload_bytes").between(low + 1, high))
        own = own.withColumn("cid", F.concat_ws(".", F.coalesce(F.col("key").cast("string"), F.lit("none")), F.lit(low + 1), F.monotonically_increasing_id()))
        captures_a_file = 1 if high is None else max(1, FILE_BYTES // high)
        texts = own.select(F.explode(records).alias("record")).select(F.col("record").cast("string").alias("value"))
        texts.write.mode("append").option("lineSep", BREAK + BREAK).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures_a_file).text(path)


def parse(content: bytes | io.BufferedIOBase) -> Iterator[dict]:
    """The records of an uncompressed WARC file, each bounded by its Content-Length; of a stream one is held at a time."""
    stream = io.BytesIO(content) if isinstance(content, bytes) else content
    while first := stream.readline():
        line = first.decode("utf-8").rstrip(BREAK)
        if not line.startswith("WARC/"):
            raise ValueError(f"no record begins here: {line[:40]!r}")
        fields = {}
        while line := stream.readline().decode("utf-8").rstrip(BREAK):
            name, _, value = line.partition(": ")
            fields[name.lower()] = value
        size = int(fields["content-length"])
        body = stream.read(size)
        if len(body) < size:
            raise ValueError(f"the record {fields['warc-record-id']} is cut off")
        stream.read(4)
        yield {"fields": fields, "body": body}


def _rows(content: bytes | io.BufferedIOBase) -> Iterator[tuple]:
    for record in parse(content):
        fields, body = record["fields"], record["body"]
        kind = fields["warc-type"]
        key = digest = payload = size = None
        if kind in ("response", "revisit"):
            digest = fields["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response":
                payload = body[body.index(b"\r\n\r\n") + 4 :]
                size = len(payload)
                read = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if read != digest:
                    raise ValueError(f"the payload of {fields['warc-record-id']} has digest {read}, its record says {digest}")
        elif kind == "metadata":
            note = dict(x.partition(": ")[::2] for x in body.decode().split(BREAK) if x)
            key, size = note["page-id"] or None, int(note["payload-bytes"])
        yield kind, fields["warc-record-id"], fields.get("warc-concurrent-to"), fields.get("x-refers-to-page"), fields["warc-target-uri"], key, digest, size, payload


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row of RECORD for each record below path; without payloads that column is null."""
    schema = spark.createDataFrame([], RECORD).schema
    kinds = [pa.string()] * 7 + [pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for row in _rows(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    size += len(row[8] or b"") if payloads else 0
                    held.append(row if payloads else (*row[:8], None))
                    if size > 4 << 20 or len(held) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], schema.names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], schema.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(lean(run), schema)


def transactions(records: DataFrame) -> DataFrame:
    """One row per capture: id, uri, and structs request, response, metadata, joined through concurrent-to identifiers.

    Every record's capture is the id that it is concurrent to, or its own; ids are unique, so no key is hot.
    """
    own = F.struct("kind", "id", "refers_to", "key", "payload_digest", "payload_bytes", "payload")
    main = F.col("kind").isin("response", "revisit")
    capture = F.when(main, F.col("id")).otherwise(F.col("concurrent_to"))
    pick = lambda when, name: F.first(F.when(when, own), ignorenulls=True).alias(name)
    return records.where(capture.isNotNull()).groupBy(capture.alias("id")).agg(
        F.first(F.when(main, F.col("uri")), ignorenulls=True).alias("uri"), pick(F.col("kind") == "request", "request"), pick(main, "response"), pick(F.col("kind") == "metadata", "metadata")
    )


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS hex FROM p),
w AS (SELECT *, list_transform(range(0, 4), lambda k: list_reduce(list_transform(range(1, 11), lambda i: CAST(strpos('0123456789abcdef', substr(hex, 10 * k + i, 1)) - 1 AS BIGINT)), lambda a, x: a * 16 + x)) AS words FROM d),
s AS (SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda j: substr('{BASE32}', CAST((words[j // 8 + 1] >> (5 * (7 - j % 8))) & 31 AS INT) + 1, 1)), '') AS payload_digest FROM w)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM s)
"""
