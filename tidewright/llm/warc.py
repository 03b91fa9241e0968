"""WARC archives with revisit resolution.

Only headers - id, URL, digest and length - are shuffled: the least page of a
digest is found by an aggregation that combines before its shuffle, and the
others are joined to it as revisits.  Responses are written from the pages as
they are stored, without a shuffle of payloads: what says that a row is a
revisit is joined by page id, broadcast if a count shows that it is small.
Archives are written by Spark's own writer, so any store that Spark reaches will
do, and read back as streams, a record at a time.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._spark import Scratch, hot_join, map_stream

#: Fixed values of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
END = CRLF + CRLF

#: Records of one archive file at most, so that a file stays a task's worth of reading.
RECORDS = 20_000
#: Keys of revisits that are broadcast at most; more are joined by page id.
BROADCAST_KEYS = 200_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: five hex digits give four letters."""
    digits = F.sha1(payload.cast("binary"))
    letters = []
    for k in range(8):
        n = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(n, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record_id(page: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page.cast("string"), url, digest).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str | None = None, compression: str = "gzip") -> None:
    """Writes one record per row of ``pages`` under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with
    the smallest id is a response with its payload, the others are revisits
    that refer to it; shorter payloads are all responses.  A null payload is
    empty; a null URL leaves the target header out; line breaks in a URL become
    spaces; a row with a null id is always a response.  Rows that repeat the id
    of a response are responses too.  Files are gzipped as wholes, or plain
    with compression="none".
    """
    scratch = Scratch(pages.sparkSession)
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.regexp_replace(F.col(url_col).cast("string"), "[\r\n]", " ").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("n", F.octet_length("payload"))
    headers = scratch.write(rows.select("page", "url", "digest", "n"), "headers")
    named = headers.where(F.col("page").isNotNull() & (F.col("n") >= least_bytes))
    originals = named.groupBy("digest", "n").agg(F.min(F.struct("page", "url")).alias("o"), F.count("*").alias("copies")).where("copies > 1")
    originals = scratch.write(originals.select("digest", "n", F.col("o.page").alias("original"), F.col("o.url").alias("original_url")), "originals")
    revisits = scratch.write(hot_join(named, originals, ["digest", "n"]).where("page > original"), "revisits")
    keys = revisits.select("page", "digest").distinct()
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    responses = rows.join(keys, ["page", "digest"], "left_anti")
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("n").cast("string"), F.lit(END))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    def record(kind: str, block: Column, *more: Column) -> Column:
        return F.concat(
            F.lit("WARC/1.1" + CRLF),
            line("WARC-Type", F.lit(kind)),
            line("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("page"), F.col("url"), F.col("digest")), F.lit(">"))),
            line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", F.col("url")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            *more,
            line("X-Page-Id", F.col("page").cast("string")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length(block).cast("string")),
            F.lit(CRLF),
            block,
        )

    refers = F.concat(F.lit("<"), _record_id(F.col("original"), F.col("original_url"), F.col("digest")), F.lit(">"))
    texts = [responses.select(record("response", F.concat(head, F.col("payload"))).alias("value"))]
    texts.append(revisits.select(record("revisit", F.lit(""), line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", refers)).alias("value")))
    for df, mode in zip(texts, ("errorifexists", "append"), strict=True):
        df.write.mode(mode).option("lineSep", END).option("maxRecordsPerFile", RECORDS).option("compression", compression).text(path)
    scratch.drop(headers, originals, revisits)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive that comes in chunks."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while need(2) and held[:2] == b"\r\n":  # a reader of lines ends the last one, ended or not
            del held[:2]
        searched = 0
        while (at := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not need(len(held) + 1):
                if held.strip():
                    raise ValueError("an archive ends within a record's header")
                return
        lines = bytes(held[:at]).decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        if not need(at + 4 + size + 4):
            raise ValueError("an archive ends within a record")
        yield headers, bytes(held[at + 4 : at + 4 + size])
        del held[: at + 4 + size + 4]


def read_archives(spark: SparkSession, path: str, payloads: bool = False, compression: str = "gzip") -> DataFrame:
    """One row per record under ``path``: record_id, record_type, page_id, url, payload_digest, refers_to, payload_bytes and, if asked for, payload.

    Digests of responses are checked against their payloads.  payload_bytes and
    payload are null for revisits; resolve() fills them in.  Gzipped archives are
    streams, of which a worker holds a record at a time; plain ones
    (compression="none") could be split within a record, so each is read whole.
    """
    schema = "record_id string, record_type string, page_id long, url string, payload_digest string, refers_to string, payload_bytes long" + ", payload string" * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(records: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for headers, block in records:
            payload = block.partition(b"\r\n\r\n")[2] if headers["warc-type"] == "response" else None
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"the payload of {headers.get('warc-record-id')} doesn't have its digest")
            page = headers.get("x-page-id")
            row = (headers["warc-record-id"], headers["warc-type"], int(page) if page else None, headers.get("warc-target-uri"), digest, headers.get("warc-refers-to"), None if payload is None else len(payload))
            out.append(row + ((None if payload is None else payload.decode("utf-8"),) if payloads else ()))
            size += len(block) if payloads else 0
            if len(out) >= 5000 or size > 1 << 22:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], _arrow(payloads))
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], _arrow(payloads))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ((f, x) for batch in batches for f, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for _, own in groupby(lines, lambda x: x[0]):
            yield from rows(parse(x.encode() + b"\r\n\r\n" for _, x in own))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = memoryview(content.as_buffer())
                yield from rows(parse(bytes(raw[k : k + (1 << 20)]) for k in range(0, len(raw), 1 << 20)))

    if compression == "none":
        return map_stream(spark.read.format("binaryFile").load(path).select("content"), whole, schema)
    # A gzipped file is read by one task from its start; its pieces come in order.
    return map_stream(spark.read.option("lineSep", END).text(path).select(F.xxhash64(F.input_file_name()).alias("file"), "value"), streamed, schema)


def _arrow(payloads: bool) -> pa.Schema:
    kinds = {"record_id": pa.string(), "record_type": pa.string(), "page_id": pa.int64(), "url": pa.string(), "payload_digest": pa.string(), "refers_to": pa.string(), "payload_bytes": pa.int64()}
    return pa.schema([*kinds.items(), *([("payload", pa.string())] if payloads else [])])


def resolve(records: DataFrame) -> DataFrame:
    """Revisits joined to the responses that they refer to: page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id).

    A revisit whose response isn't among the records has nulls for what it would tell.
    """
    out = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses = records.where("record_type = 'response'")
    # Rows that repeat a record are one record.
    named = responses.groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(F.min("page_id").alias("page"), F.min("payload_bytes").alias("bytes"))
    revisits = hot_join(records.where("record_type = 'revisit'"), named, ["refers_to", "payload_digest"], "left")
    revisits = revisits.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("page").alias("refers_to"))
    return responses.select(*out, F.lit(None).cast("long").alias("refers_to")).union(revisits)


def archive_and_resolve(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes archives of ``pages``, reads them back and resolves their revisits.

    Without a path the archives stand in the shared folder.  An empty table
    writes an archive without records and gives an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    path = path or scratch.path("archives")
    write_archives(pages, path, **options)
    return resolve(scratch.write(read_archives(spark, path, compression=options.get("compression", "gzip")), "records"))
