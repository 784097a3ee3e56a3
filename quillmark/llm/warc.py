"""Deduplicated WARC archives: revisit resolution by payload digest.

Writing.  Only headers (id, digest, length) are shuffled to find each digest's
original: a partial aggregation keeps the smallest id per digest, so a digest
that a third of all pages share arrives as one row per task.  The originals of
repeated digests go back to the pages.  While they are ``MAX_SENT`` or fewer they
are sent to the tasks, so payloads stay where they are read; beyond that they are
joined on the digest, which shuffles the payloads once, with the commonest digests
split over many tasks.
Revisit records lose their payload, and fresh headers are made for every record.
Files are written by Spark's text writer, through its commit protocol: each
record is a gzip member of its own, and the line separator is an empty member.

Reading.  ``read_archives`` streams each (compressed) file through a parser that
trusts nothing but ``Content-Length``, so payloads may hold anything, even other
records.  ``resolve_revisits`` joins revisit records to their originals.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.shared import lean, materialize, split_join

#: Originals of repeated digests that are sent to all tasks: 100 bytes each at most, 50 MB in all.
MAX_SENT = 500_000
#: Uses from which on a digest may count as common.
_LEAST = 1000
#: Bytes of payload a file is meant for, so that readers can hold one.
FILE_BYTES = 256 << 20
#: A gzip member of nothing.
_NOTHING = b"\x1f\x8b\x08\0\0\0\0\0\0\xff\x03\0\0\0\0\0\0\0\0\0"
CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "page_id long, record_type string, refers_to long, url string, payload_digest string, "
    "payload_bytes long, payload binary"
)


def _with_originals(rows: DataFrame, key: str, originals: DataFrame, value: str, sent: int) -> DataFrame:
    """``rows`` left-joined to ``originals`` (of, uses, value) on ``key``: up to ``sent`` originals go to all
    tasks; beyond that both sides are shuffled, common keys over many tasks."""
    if originals.count() <= sent:
        return rows.join(F.broadcast(originals.select("of", value)), F.col(key) == F.col("of"), "left").drop("of")
    return split_join(rows, key, originals.select("of", "uses", value), "page_id", _LEAST)


def archive_records(pages: DataFrame, min_bytes: int = 100, sent: int = MAX_SENT) -> DataFrame:
    """Decide per page: ``response``, or ``revisit`` of the page with the same payload.

    Input columns ``page_id, url, html``; others are ignored.  Returns
    ``page_id, url, html, payload_digest, payload_bytes, record_type, refers_to``.

    * A null html is the empty payload; payloads under ``min_bytes`` are always
      responses.  A null url gives a record without one.
    * Of equal payloads the smallest page_id is the response; rows that repeat
      that smallest id are all responses.  Null ids never win against an id;
      where a payload has null ids only, all its rows are responses.
    * An empty table gives an empty table.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    headed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.sha2(body, 256).alias("payload_digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
    )
    originals = (
        headed.where(F.col("payload_bytes") >= min_bytes)
        .groupBy(F.col("payload_digest").alias("of"))
        .agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("uses"))
        .where((F.col("uses") > 1) & F.col("original").isNotNull())
    )
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return _with_originals(headed, "payload_digest", materialize(originals, "originals"), "original", sent).select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
    )


def _urn(column):
    return F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("null")), F.lit(">"))


def _header(name: str, value):
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record and the line breaks that end it as one gzip member."""
    for batch in batches:
        out = []
        for record in batch.column(0):
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append(packer.compress(record.as_py()) + packer.compress(RECORD_END.encode()) + packer.flush())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write_archives(
    records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", compressed: bool = True, records_per_file: int = 0
) -> None:
    """Write the records of ``archive_records`` as WARC/1.1 files under ``path``.

    ``compressed`` files hold one gzip member per record, so a record can be read from
    its offset.  ``records_per_file`` bounds the files (0: as Spark's tasks make them).

    A response's block is an HTTP response message around the payload; a revisit
    has an empty block.  ``date`` stands in for the crawl date, which the table
    lacks.  Line breaks inside a url are percent-encoded so that no url can
    forge a header.
    """
    is_response = F.col("record_type") == "response"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(RECORD_END),
    )
    block = F.when(is_response, F.concat(http, F.col("html"))).otherwise("")
    length = F.when(is_response, F.octet_length(http) + F.col("payload_bytes")).otherwise(F.lit(0))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"), F.lit(CRLF),
        _header("WARC-Record-ID", _urn(F.col("page_id"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(is_response, "").otherwise(F.concat(
            _header("WARC-Profile", F.lit(PROFILE)), _header("WARC-Refers-To", _urn(F.col("refers_to"))),
        )),
        F.when(is_response, f"Content-Type: application/http; msgtype=response{CRLF}").otherwise(""),
        _header("Content-Length", length.cast("string")),
        F.lit(CRLF), block,
    )
    rows = records.select(record.alias("value"))
    options = {"lineSep": RECORD_END, "maxRecordsPerFile": records_per_file}
    if compressed:
        # The text writer passes the bytes of a value and of the separator on as they are.
        rows = rows.select(F.col("value").cast("binary")).mapInArrow(lean(_members), "member binary").select(F.col("member").cast("string").alias("value"))
        options |= {"lineSep": _NOTHING.decode("latin-1"), "encoding": "ISO-8859-1"}
    rows.write.options(**options).text(path)


def records_for(pages: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """Records that make up about ``file_bytes`` of payload."""
    found = pages.agg(F.avg(F.octet_length("html"))).first()[0]
    return max(1, int(file_bytes / max(1.0, found or 1.0)))


def _inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The file's bytes in pieces; gzip members, one or many, are unpacked.

    The file is passed over once: no more than a step of it is copied at a time.
    """
    packed = content[:2] == b"\x1f\x8b"
    unzip = None
    for at in range(0, len(content), step):
        rest = content[at : at + step]
        if not packed:
            yield rest
            continue
        while rest:
            if unzip is None:
                unzip = zlib.decompressobj(wbits=31)
            piece = unzip.decompress(rest, step)
            if piece:
                yield piece
            rest = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
            if unzip.eof:
                unzip = None
    if unzip is not None:
        yield unzip.flush()


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of one file."""
    pieces, held, at = _inflated(content), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        if at > max(1 << 20, len(held) // 2):
            del held[:at]
            at = 0
        look = at
        while (body := held.find(b"\r\n\r\n", look)) < 0:
            look = max(at, len(held) - 3)
            if not more():
                if held[at:].strip():
                    raise ValueError("archive ends inside a header")
                return
        first, *lines = held[at:body].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:60]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        body += 4
        end = body + int(fields["content-length"])
        while len(held) < end + 4 and more():
            pass
        if len(held) < end:
            raise ValueError("archive ends inside a block")
        yield fields, bytes(held[body:end])
        at = end + 4


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name not in ("", "null") else None


def _read_batches(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "refers_to", "url", "payload_digest", "payload_bytes", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        schema = pa.schema(list(zip(names, types, strict=True)))
        rows, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                for fields, block in parse_warc(content.as_py()):
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    payload = None
                    if fields["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    rows.append((
                        _page(fields["warc-record-id"]), fields["warc-type"], _page(fields.get("warc-refers-to")),
                        fields.get("warc-target-uri"), digest,
                        None if payload is None else len(payload), payload if with_payload else None,
                    ))
                    held += len(payload or b"") if with_payload else 0
                    if len(rows) >= 10_000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)

    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all WARC files under ``path``, plain or gzip, as RECORD_SCHEMA.

    Each response's payload is checked against its digest.  A revisit has no
    payload and no length of its own.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lean(_read_batches(with_payload)), RECORD_SCHEMA)


def resolve_revisits(records: DataFrame, sent: int = 0) -> DataFrame:
    """Give every revisit its original's length (and payload, if read).

    Revisits are joined to responses on digest and original id.  A revisit whose
    original is missing from the archives keeps null there.  Rows that repeat an
    original collapse before the join.  Only responses that some revisit names take
    part, and digests with many revisits are split over tasks.  Without payloads,
    up to ``sent`` originals may go to all tasks instead.
    """
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "payload").withColumn(
        "named", F.concat_ws(" ", "payload_digest", F.col("refers_to").cast("string")))
    uses = materialize(revisits.where("refers_to is not null").groupBy("named").agg(F.count(F.lit(1)).alias("uses")), "revisit-names")
    original = (
        records.where("record_type = 'response' and page_id is not null")
        .groupBy(F.concat_ws(" ", "payload_digest", F.col("page_id").cast("string")).alias("of"))
        .agg(F.min_by(F.struct("payload_bytes", "payload"), "payload_bytes").alias("found"))
        .join(uses, F.col("of") == F.col("named")).select("of", "uses", "found")
    )
    resolved = _with_originals(revisits, "named", original, "found", sent).select(
        "page_id", "record_type", "refers_to", "url", "payload_digest", "found.payload_bytes", "found.payload")
    return records.where("record_type = 'response'").unionByName(resolved)
