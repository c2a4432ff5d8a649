"""WARC archives: pages written as records with deduplicated payloads, read back, and assembled into
one nested row for each capture."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import scratch_path

#: Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least this many bytes are looked up for revisits; records of one archive file, three for
#: a page, so that with pages of 100 kB an archive holds 50 MB before it is packed.
LEAST_BYTES, FILE_RECORDS = 1000, 1_500
#: Bytes that are unpacked at once, and bytes of records that a reading task hands on at once.
STEP, ROWS_BYTES = 1 << 20, 8 << 20
DATE = "2024-01-01T00:00:00Z"


def _record(kind: str | Column, rid: Column, uri: Column, fields: list[tuple[str, Column]], content_type: str, block: Column, length: Column | None = None) -> Column:
    """One record without its two closing line ends, which the text writer adds."""
    head = [
        F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), rid),
        F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(uri, r"[\r\n]+", " ")),
        *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in fields],
        F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *head), F.lit(END), block)


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, bytes, refers_to, copy): among equal payloads of at least
    ``least_bytes`` the largest page_id is the response that the others revisit. copy numbers the rows
    that share page_id and payload, from 1.

    Only digests and ids are grouped, by partial aggregates; rows are dealt once, by page and digest, for
    the join back and the numbers. A null payload is empty; a row without an id refers to none, is referred
    to by none, and is dealt by a hash of its own."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
    )
    large = rows.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.min("page_id").alias("last")).where("first <> last").select(F.col("digest").alias("d"), "first")
    again = large.join(groups, F.col("digest") == F.col("d")).where("page_id <> first").select(F.col("page_id").alias("p"), "d", "first").distinct()
    rows = rows.withColumn("lone", F.when(F.col("page_id").isNull(), F.monotonically_increasing_id()))
    rows = rows.withColumn("deal", F.coalesce("page_id", F.xxhash64("lone")))
    joined = rows.join(again, (F.col("deal") == F.col("p")) & (F.col("digest") == F.col("d")) & F.col("page_id").isNotNull(), "left")
    copy = F.row_number().over(Window.partitionBy("deal", "digest").orderBy("url"))
    return joined.withColumn("copy", copy).select("page_id", "url", "payload", "digest", "bytes", F.col("first").alias("refers_to"), "copy", "lone")


def write_warc(pages: DataFrame, path: str, **names) -> None:
    """Writes request, response or revisit, and metadata records of each page row as gzipped WARC files.

    Records of a capture point to its response or revisit by WARC-Concurrent-To, a revisit to the record
    of its response by WARC-Refers-To. Ids are derived from page id, payload digest and the number of the
    copy, so every row is a capture, also where rows repeat."""
    p = planned(pages, **names)
    named = lambda page, copy: F.concat_ws(":", page.cast("string"), "digest", copy)
    key = F.when(F.col("page_id").isNotNull(), named(F.col("page_id"), F.col("copy").cast("string"))).otherwise(F.concat_ws(":", F.lit("none"), "digest", F.hex("lone"), F.col("copy").cast("string")))
    rid = lambda kind, k=key: F.concat(F.lit(f"<urn:capture:{kind}:"), k, F.lit(">"))
    main, uri = rid("main"), F.col("url")
    host, target = F.regexp_extract(uri, r"^[a-z]+://([^/\r\n]+)", 1), F.regexp_extract(uri, r"^[a-z]+://[^/]+(/[^#]*)", 1)
    request = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(F.regexp_replace(target, r"[\r\n]+", " ")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    facts = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\npayloadLength: "), F.col("bytes").cast("string"), F.lit("\r\n"))
    facts = F.concat(facts, F.when(again, F.concat(F.lit("refersToPageId: "), F.col("refers_to").cast("string"), F.lit("\r\n"))).otherwise(""))
    records = [
        _record("request", rid("request"), uri, [("WARC-Concurrent-To", main)], "application/http; msgtype=request", request),
        _record(F.when(again, "revisit").otherwise("response"), main, uri, [
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("WARC-Profile", F.when(again, IDENTICAL)),
            ("WARC-Refers-To", F.when(again, rid("main", named(F.col("refers_to"), F.lit("1"))))),
        ], "application/http; msgtype=response", block),
        _record("metadata", rid("metadata"), uri, [("WARC-Concurrent-To", main)], "application/warc-fields", facts),
    ]
    out = p.select(F.explode(F.array(*records)).alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


RECORD = "kind string, id string, uri string, concurrent string, refers string, digest string, content_type string, body_at int, block binary"
FIELDS = (b"warc-type", b"warc-record-id", b"warc-target-uri", b"warc-concurrent-to", b"warc-refers-to", b"warc-payload-digest", b"content-type")


def _unpacked(data: bytes):
    """The bytes of an archive in steps: gzip, one member or many, or plain. A cut-off end is left out."""
    view, at = memoryview(data), 0
    if view[:2] != b"\x1f\x8b":
        yield view
        return
    while view[at : at + 2] == b"\x1f\x8b":
        member, tail = zlib.decompressobj(wbits=31), b""
        while not member.eof:
            piece = tail or view[at : at + STEP]
            at += 0 if tail else len(piece)
            try:
                out = member.decompress(piece, STEP)
            except zlib.error:
                return
            tail = member.unconsumed_tail
            if out:
                yield out
            elif not piece:
                return
        at -= len(member.unused_data)


def parse_archive(data: bytes):
    """Records (head, block) of one archive, by their Content-Length, so that payloads may hold anything.
    No more is unpacked at once than a record and a step. A cut-off last record is left out."""
    steps, held, done = _unpacked(data), bytearray(), False

    def more() -> bool:
        nonlocal done
        step = next(steps, None)
        done = step is None
        held.extend(step or b"")
        return not done

    def sought(sign: bytes, at: int) -> int:
        """Where a sign begins, unpacking until it is there; -1 for nowhere."""
        while (found := held.find(sign, at)) < 0:
            at = max(at, len(held) - len(sign) + 1)
            if not more():
                return -1
        return found

    while (start := sought(b"WARC/", 0)) >= 0:
        del held[:start]
        if (end := sought(b"\r\n\r\n", 0)) < 0:
            return
        head = {}
        for line in bytes(held[:end]).split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            head[k.strip().lower()] = v.strip().decode("utf-8", "replace")
        n = head.get(b"content-length") or "0"
        stop = end + 4 + (int(n) if n.isdecimal() else 0)
        while len(held) < stop and more():
            pass
        if len(held) < stop:
            return
        yield head, bytes(held[end + 4 : stop])
        del held[:stop]


def body_at(head: dict, block: bytes) -> int:
    """Where the payload of a record begins: after the first empty line of an HTTP message, however long
    its head; else at the start."""
    if not (head.get(b"content-type") or "").startswith("application/http"):
        return 0
    return block.find(b"\r\n\r\n") + 4 if b"\r\n\r\n" in block else 0


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder; Spark reads the files, each task parses its own."""
    ship(spark)
    names = [f.name for f in spark.createDataFrame([], RECORD).schema]

    def parsed(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block in parse_archive(content.as_py()):
                    rows.append(([head.get(f) for f in FIELDS], body_at(head, block), block))
                    size += len(block)
                    if size > ROWS_BYTES:
                        yield _records(rows)
                        rows, size = [], 0
                yield _records(rows)

    def _records(rows):
        cols = [pa.array([r[0][i] for r in rows], pa.string()) for i in range(len(FIELDS))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parsed, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit, with the request and metadata
    records that are concurrent to it (null where there are none).

    Length and digest of the payload are taken from the record before the joins, so that a reader who
    asks for no payload deals none. Ids are unique, so the joins have no hot key. Of records with one id,
    any one counts."""
    payload = F.expr("substring(block, body_at + 1)")
    main = records.where("kind in ('response', 'revisit')").select(
        "id", "kind", "uri", "refers", "digest", payload.alias("payload"), F.octet_length(payload).cast("long").alias("held_bytes"), F.sha1(payload).alias("held_digest")
    ).dropDuplicates(["id"])
    side = lambda kind, *cols: records.where(F.col("kind") == kind).where("concurrent is not null").select(F.col("concurrent").alias("to"), F.struct("id", *cols).alias(kind)).dropDuplicates(["to"])
    out = main.join(side("request", "uri", "block"), F.col("id") == F.col("to"), "left").drop("to")
    out = out.join(side("metadata", "block"), F.col("id") == F.col("to"), "left").drop("to")
    fact = lambda k: F.regexp_extract(F.col("metadata.block").cast("string"), rf"(?:^|\n){k}: *([^\r\n]*)", 1).try_cast("long")
    return out.select(
        F.col("id").alias("capture_id"), "uri", "request", F.struct("id", "kind", "refers", "digest", "payload", "held_bytes", "held_digest").alias("response"), "metadata",
        fact("pageId").alias("page_id"), fact("payloadLength").alias("payload_length"), fact("refersToPageId").alias("refers_to_page"),
    )


def digest(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes pages to archives in the shared folder, reads them back and gives a row for each capture."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, id_col=id_col, url_col=url_col, payload_col=payload_col)
    rows = assemble(read_warc(spark, path))
    first = F.col("response.kind") == "response"
    return rows.select(
        F.col("page_id").alias(id_col),
        F.when(first, F.col("response.held_bytes")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(first, F.col("response.held_digest")).otherwise(F.regexp_replace("response.digest", "^sha1:", "")).alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.col("refers_to_page").alias("refers_to"),
    )


__all__ = ["assemble", "digest", "parse_archive", "planned", "read_warc", "write_warc"]
