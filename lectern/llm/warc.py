"""WARC: write captures as archives, read archives back, assemble each transaction into one nested row.

The writer makes three records a capture: a request, a response (or a revisit, where an earlier page has
the same payload) and metadata; request and metadata name the response by WARC-Concurrent-To. Spark's text
sink writes them gzipped, a record's closing blank lines being the line separator. Captures are written by
size class, each with as many to a file as keep its payloads below FILE_BYTES, so that an archive fits a
reader's memory. The reader parses whole files by Content-Length, plain or gzipped in any number of members, so payloads may hold anything. The
transaction of a record is the record it is concurrent to, itself for responses and revisits; one
aggregation by that id makes the nested row, and revisits take length and digest from what they refer to.

Edge cases: null html is an empty payload; payloads below ``least`` bytes are never revisits; of equal
payloads the smallest page_id is the response, also if it comes twice; null ids and urls are written as
empty fields and read as null; repeated rows are captures of their own; records without a
partner still make a row, with nulls; a file that ends within a record is an error; empty tables give no
archives and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
import zlib

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, shared_dir, small_batches, spool

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = "\r\n"
GAP = END + END
#: Tables of first pages up to this size are broadcast to the writer; beyond, the pages are shuffled once.
MOST_BROADCAST = 100_000
#: Payload bytes of an archive at most, but for single larger pages; size classes of pages, by the bytes of their largest.
FILE_BYTES = 1 << 26
CLASSES = (1 << 12, 1 << 16, 1 << 20)
DATE = "2024-01-01T00:00:00Z"  # pages carry no capture time; a fixed one keeps the archives repeatable
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(kind: str, *of: Column) -> Column:
    """Record id from kind and content."""
    h = F.md5(F.concat_ws("\n", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("")) for c in of]))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column, record: Column, block: Column, content: str, fields: list[tuple[str, Column]]) -> Column:
    """One record without its closing blank lines; a field whose value is null is left out."""
    lines = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record), F.lit(f"WARC-Date: {DATE}"), F.lit(f"Content-Type: {content}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    head = F.concat_ws(END, F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(GAP), block)


def write_archives(pages: DataFrame, path: str, least: int = 100) -> None:
    """Archives of all pages (page_id, url, html) under ``path``, gzipped, a folder a size class."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload"), "digest": F.sha2("payload", 256)})
    kind = F.lit(len(CLASSES))
    for k in range(len(CLASSES) - 1, -1, -1):
        kind = F.when(F.col("size") <= CLASSES[k], k).otherwise(kind)
    first = rows.groupBy("digest", kind.alias("kind"), F.col("size")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = spool(first, "op8-first")
    kinds = [r["kind"] for r in first.select("kind").distinct().collect()]  # at most one row a class
    twice = first.where((F.col("size") >= least) & (F.col("n") > 1))
    few = twice.count() <= MOST_BROADCAST
    for k in kinds:
        at_most = max(1, FILE_BYTES // CLASSES[k]) if k < len(CLASSES) else 1
        met, some = rows.where(kind == k), twice.where(F.col("kind") == k)
        low = some.select("digest", "first")
        met = met.join(F.broadcast(low), "digest", "left") if few else join_hot(met, low, "digest", "left", some.select("digest", "n"))
        _write(met, f"{path}/class-{k}", least, at_most)


def _write(rows: DataFrame, path: str, least: int, at_most: int) -> None:
    rows = rows.withColumn("again", F.coalesce((F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)))
    # line breaks cannot stand in a header; the exact url is in the metadata block
    url = F.regexp_replace("url", r"[\x00-\x20]+", "%20")
    # a task numbers its rows, so that repeated rows do not share ids; all records of a capture are made in one row
    rows = rows.withColumn("nth", F.monotonically_increasing_id())
    own = _urn("response", F.col("page_id"), F.col("url"), F.col("digest"), F.col("nth"))
    held = _urn("held", F.col("first"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(GAP))
    target = ("WARC-Target-URI", url)
    main = _record(
        F.when(F.col("again"), "revisit").otherwise("response"), own, F.when(F.col("again"), http).otherwise(F.concat(http, "payload")), "application/http;msgtype=response",
        [target, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), ("WARC-Profile", F.when(F.col("again"), PROFILE)), ("WARC-Refers-To", F.when(F.col("again"), held))],
    )
    ask = F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(f" HTTP/1.1{GAP}"))
    request = _record(F.lit("request"), _urn("request", F.col("page_id"), F.col("url"), F.col("digest"), F.col("nth")), ask, "application/http;msgtype=request", [target, ("WARC-Concurrent-To", own)])
    # the id under which revisits find this page: of equal payloads only the first one's is used
    note = F.to_json(F.struct("page_id", "url", _urn("held", F.col("page_id"), F.col("digest")).alias("held")))
    meta = _record(F.lit("metadata"), _urn("metadata", F.col("page_id"), F.col("url"), F.col("digest"), F.col("nth")), note, "application/json", [target, ("WARC-Concurrent-To", own)])
    text = F.concat_ws(GAP, request, main, meta)
    rows.select(text.alias("value")).write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", at_most).text(path)


def _plain(data: bytes):
    """Bytes of an archive file in pieces; gzip members follow each other."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        d = zlib.decompressobj(31)
        while not d.eof and data:
            yield d.decompress(data, 1 << 20)
            data = d.unconsumed_tail
        if not d.eof:
            raise ValueError("an archive ends within a gzip member")
        data = d.unused_data.lstrip(b"\0")


class _Stream:
    def __init__(self, pieces):
        self.pieces, self.held, self.at = pieces, bytearray(), 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        if self.at > 1 << 16:
            del self.held[: self.at]
            self.at = 0
        self.held += piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the next mark, which is passed; None at the end."""
        seen = self.at
        while (k := self.held.find(mark, seen)) < 0:
            before = self.at
            seen = max(self.at, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
            seen -= before - self.at
        out = bytes(self.held[self.at : k])
        self.at = k + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self.more():
                raise ValueError("an archive ends within a record")
        out = bytes(self.held[self.at : self.at + n])
        self.at += n
        return out


def parse(data: bytes):
    """(headers with lower-case names, block) of each record of an archive file."""
    s = _Stream(_plain(data))
    while (head := s.until(b"\r\n\r\n")) is not None:
        if not (head := head.strip(b"\r\n")):
            continue  # the blank lines that close the record before
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields: dict[str, str] = {}
        for x in lines[1:]:
            if x[:1] in (" ", "\t") and fields:  # a folded line goes on with the field before
                fields[last] += " " + x.strip()  # noqa: F821
                continue
            name, _, value = x.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
        yield fields, s.take(int(fields["content-length"]))


RECORDS = "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, declared_digest string, http_head string, payload_bytes long, payload_digest string, payload binary, note string"


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One row a record of all archive files under ``path``; without payloads only their length and digest."""

    def run(batches):
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        types = [kinds[x.split()[1]] for x in RECORDS.split(", ")]
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for f, block in parse(content.as_py()):
                    head, note, body = None, None, block
                    if f.get("content-type", "").startswith("application/http"):
                        h, _, body = block.partition(b"\r\n\r\n")
                        head = h.decode("utf-8", "replace")
                    elif f["warc-type"] == "metadata":
                        note = block.decode("utf-8", "replace")
                    rows.append((f.get("warc-record-id"), f["warc-type"], f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-payload-digest"), head, len(body), hashlib.sha256(body).hexdigest(), body if payloads else None, note))
                    size += len(body) * payloads
                    if len(rows) >= 2000 or size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content").mapInArrow(run, RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row a capture: its id, and structs request, response (or revisit) and metadata."""
    main = F.col("type").isin("response", "revisit")
    key = F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    fields = [c for c in records.columns]
    part = lambda cond: F.max_by(F.when(cond, F.struct(*fields)), F.when(cond, F.col("record_id")))
    return records.groupBy(key.alias("capture_id")).agg(part(F.col("type") == "request").alias("request"), part(main).alias("response"), part(F.col("type") == "metadata").alias("metadata"))


def captures(nested: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to; revisits take theirs from the response."""
    note = F.from_json("metadata.note", "page_id long, url string, held string")
    c = nested.select(note.alias("n"), F.col("response").alias("r")).select("n.page_id", "n.url", "n.held", F.col("r.type").alias("record_type"), F.col("r.refers_to").alias("ref"), F.col("r.payload_bytes").alias("b"), F.col("r.payload_digest").alias("d"))
    kept = c.where("record_type = 'response'").select(F.col("held").alias("ref"), F.col("page_id").alias("first"), F.col("b").alias("fb"), F.col("d").alias("fd")).groupBy("ref").agg(F.max("first").alias("first"), F.max("fb").alias("fb"), F.max("fd").alias("fd"))
    again = join_hot(c.where("record_type = 'revisit'").select("page_id", "url", "ref", "record_type"), kept, "ref", "left").select("page_id", "url", F.col("fb").alias("payload_bytes"), F.col("fd").alias("payload_digest"), "record_type", F.col("first").alias("refers_to"))
    return c.where("record_type = 'response'").select("page_id", "url", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).union(again)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: write all pages, read the archives back, one row a capture."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    with small_batches(spark, 1):
        records = spool(read_archives(spark, path, payloads=False).drop("payload", "http_head"), "op8-records")
    return captures(transactions(records)).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
