"""WARC archives: a writer with one gzip member per record and a strictly sequential reader.

Each archive holds at most about ``archive_bytes`` and is written by one task to a ``.part``
name, then renamed, so a repeated or lost task leaves no torn archive: the retry
writes the same bytes to the same name. The reader opens an archive as a stream, inflates
it ``read_size`` bytes at a time (one gzip member after another, never the whole file),
frames each record by its Content-Length and verifies block and payload digests.

Records follow WARC/1.1. A ``response`` record's block is an HTTP response head and the
payload; a ``revisit`` record (profile identical-payload-digest) has the head only and
names the record it refers to.

Defined results: a null html is the empty payload; payloads below ``min_revisit`` bytes
are always response records; of equal larger ones the smallest ``page_id`` is the response
and the others revisit it; a null url gives an empty target URI; line breaks in a url are
percent-encoded so they cannot break the header; an empty table gives no archive and an
empty result; every row gives one record and one row of the result. Rows that repeat the
smallest ``page_id`` of a payload are all response records; rows that share a ``page_id`` but
not the html are told apart by their digests. A row without ``page_id`` has a record without a
number; it revisits an equal payload that has one, and is a response otherwise. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.sources import materialize, scratch_path, table

_CRLF = b"\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}") if not uri.startswith("file:/") else (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/"))


def digest_of(payload: bytes) -> str:
    """SHA-256 in bare lower-case hex."""
    return hashlib.sha256(payload).hexdigest()


def write_record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as one gzip member."""
    block = _HEAD % len(payload) + (payload if kind == "response" else b"")
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha256:{digest_of(block)}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


class _Members:
    """Bytes of a gzip file, inflated a piece at a time; knows where members end."""

    def __init__(self, stream, read_size: int) -> None:
        self.stream, self.read_size = stream, read_size
        self.raw, self.data, self.ended, self.inflate = b"", bytearray(), True, None

    def more(self) -> bool:
        """Inflate one more piece of the current member into ``data``; False at its end."""
        while True:
            if self.ended:
                return False
            if not self.raw:
                self.raw = self.stream.read(self.read_size)
                if not self.raw:
                    raise ValueError("archive ends inside a gzip member")
            out = self.inflate.decompress(self.raw, self.read_size)
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.raw, self.ended = self.inflate.unused_data, True
            if out:
                self.data += out
                return True

    def start(self) -> bool:
        """Begin the next member; False at the end of the file."""
        if not self.raw:
            self.raw = self.stream.read(self.read_size)
        if not self.raw:
            return False
        self.inflate, self.ended, self.data = zlib.decompressobj(31), False, bytearray()
        return True


def read_records(stream, read_size: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of each record of a gzip-per-record archive, in order.

    Raises ValueError for a torn member, a false length or a digest that does not match.
    """
    members = _Members(stream, read_size)
    while members.start():
        while (at := members.data.find(_CRLF * 2)) < 0:
            if not members.more():
                raise ValueError("record without a complete header")
        lines = members.data[:at].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin, length = at + 4, int(headers["content-length"])
        while len(members.data) < begin + length + 4:
            if not members.more():
                raise ValueError("record shorter than its Content-Length")
        while members.more():
            pass
        if bytes(members.data[begin + length :]) != _CRLF * 2:
            raise ValueError("record longer than its Content-Length")
        block = bytes(members.data[begin : begin + length])
        if (told := headers.get("warc-block-digest")) and told != f"sha256:{digest_of(block)}":
            raise ValueError(f"block digest of {headers.get('warc-record-id')} does not match")
        yield headers, block


def plan_records(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """``page_id, url, html, refers_to``, a row per row: which record revisits which.

    Digests meet without the html; the html moves once, by ``page_id`` and digest, which spread evenly.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256))
    slim = base.filter(F.octet_length("html") >= min_revisit).select("page_id", "digest")
    first = (
        slim.groupBy("digest")
        .agg(F.min("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND response_id IS NOT NULL")
        .select(F.concat(F.lit("#"), "digest").alias("first_digest"), "response_id")
    )
    revisits = (
        slim.select("page_id", F.concat(F.lit("#"), "digest").alias("slim_digest"))
        .join(first, F.col("slim_digest") == F.col("first_digest"))
        .filter(~F.col("page_id").eqNullSafe(F.col("response_id")))
        .select(F.col("page_id").alias("r_page_id"), F.substring("slim_digest", 2, 64).alias("r_digest"), F.col("response_id").alias("refers_to"))
        .distinct()
    )
    same = base["page_id"].eqNullSafe(revisits["r_page_id"]) & (base["digest"] == revisits["r_digest"])
    return base.join(revisits, same, "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 100, archive_bytes: int = 1 << 30) -> DataFrame:
    """Write a record per page into ``folder``; returns the archives: ``path, records, bytes``.

    Each task writes its own rows, to a new archive after every ``archive_bytes``: the html
    isn't dealt out once more for it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = _open(folder)
        task, made = TaskContext.get(), []
        out, names, records, size = None, None, 0, 0

        def close() -> None:
            out.close()
            system.move(*names)
            made.append((names[1], records, size))

        for batch in batches:
            for row in zip(*batch.columns):  # one page at a time leaves Arrow's memory
                page_id, url, html, refers = (x.as_py() for x in row)
                payload = html.encode("utf-8", "surrogatepass")
                digest = digest_of(payload)
                if out is None:
                    system.create_dir(base, recursive=True)
                    name = f"{base}/pages-{task.partitionId():06d}-{len(made):04d}.warc.gz"
                    names, records, size = (f"{name}.{task.taskAttemptId()}.part", name), 0, 0
                    out = system.open_output_stream(names[0], compression=None)
                raw = write_record("response" if refers is None else "revisit", page_id, url, payload, digest, refers)
                out.write(raw)
                records, size = records + 1, size + len(raw)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "records", "bytes"), map(list, zip(*made)))))

    written = plan_records(pages, min_revisit).mapInArrow(write, "path string, records long, bytes long")
    return materialize(written, "archives")


def read_archives(spark: SparkSession, folder: str, archives: DataFrame, read_size: int = 1 << 16) -> DataFrame:
    """The records of ``archives`` (column ``path``), each archive read by one task in order.

    ``page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload``: payload
    and its length are null for revisit records, whose block has none.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(folder)
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(path, compression=None) as stream:
                    for headers, block in read_records(stream, read_size):
                        kind, told = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                        payload = block.partition(_CRLF * 2)[2] if kind == "response" else None
                        if payload is not None and digest_of(payload) != told:
                            raise ValueError(f"payload digest of {headers['warc-record-id']} does not match")
                        refers = headers.get("warc-refers-to")
                        number = lambda x: int(digits) if (digits := x.rpartition(":")[2].rstrip(">")) else None
                        rows.append((number(headers["warc-record-id"]), headers["warc-target-uri"], kind, refers and number(refers), told, None if payload is None else len(payload), payload))
                        held += len(block)
                        if held > 8 << 20:
                            yield pack(rows)
                            rows, held = [], 0
        if rows:
            yield pack(rows)

    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def pack(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

    parts = max(1, archives.count())
    return archives.select("path").repartitionByRange(parts, "path").mapInArrow(
        read, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give each revisit record the length of the payload that it refers to; digests must agree."""
    slim = records.select("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes")
    sources = slim.filter("record_type = 'response' AND page_id IS NOT NULL").select(
        F.col("page_id").alias("s_id"), F.col("payload_digest").alias("s_digest"), F.col("payload_bytes").alias("s_bytes")
    )
    same = (F.col("refers_to") == F.col("s_id")) & (F.col("payload_digest") == F.col("s_digest"))
    revisits = slim.filter("record_type = 'revisit'").join(sources.distinct(), same, "left")
    checked = F.when(F.col("s_digest").isNotNull(), F.col("s_bytes")).otherwise(
        F.raise_error(F.concat(F.lit("revisit without an equal response: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("long")
    )
    return slim.filter("record_type = 'response'").unionByName(revisits.withColumn("payload_bytes", checked).drop("s_id", "s_digest", "s_bytes"))


def round_trip(pages: DataFrame, folder: str | None = None, min_revisit: int = 100) -> DataFrame:
    """Write the archives, read them back, resolve revisits: one row per record."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    archives = write_archives(pages, folder, min_revisit)
    records = read_archives(spark, folder, archives).drop("payload")
    return resolve_revisits(materialize(records, "records"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, min(page_id) AS first_id FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT q.page_id, q.payload_bytes, q.payload_digest,
  CASE WHEN m.first_id IS NULL OR m.first_id = q.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m.first_id IS DISTINCT FROM q.page_id THEN m.first_id END AS refers_to
FROM q LEFT JOIN m ON m.payload_digest = q.payload_digest AND q.payload_bytes >= 100
"""
