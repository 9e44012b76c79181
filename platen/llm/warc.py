"""WARC archives: a Spark writer, and a reader that reassembles segmented records.

Records are rows of a text table whose line separator is the record separator CRLF CRLF, so Spark's own
writer and reader move the bytes and any store Spark can reach will do. Archives are gzip files: Spark never
splits those, so the pieces of a record follow each other within one task, and memory is bounded by one record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm.common import shared_path, small, written

CRLF = b"\r\n"
SEP = b"\r\n\r\n"

WRITTEN = "value binary"
PARSED = (
    "origin string, segment int, total_length long, warc_type string, target_uri string, page_id long, "
    "refers_to long, declared_digest string, declared_length long, payload_length long, payload_digest string, block binary"
)
RECORDS = (
    "record_id string, page_id long, record_type string, target_uri string, refers_to long, segments int, "
    "complete boolean, digest_ok boolean, payload_bytes long, payload_digest string, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int) -> bytes:
    """Chunked transfer framing of a body."""
    parts = []
    for i in range(0, len(data), size):
        piece = data[i : i + size]
        parts += [b"%x\r\n" % len(piece), piece, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(data: bytes) -> bytes | None:
    """The body in chunked framing (extensions and trailers are skipped); None if it is broken off or malformed."""
    parts, at = [], 0
    while True:
        end = data.find(CRLF, at)
        if end < 0:
            return None
        try:
            size = int(data[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or data[at + size : at + size + 2] != CRLF:
            return None
        parts.append(data[at : at + size])
        at += size + 2


def body_of(block: bytes) -> bytes | None:
    """The payload of an HTTP block: what follows the header, without its chunked framing."""
    head, sep, body = block.partition(SEP)
    if not sep:
        return None
    for line in head.split(CRLF)[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding" and value.strip().lower() == b"chunked":
            return dechunked(body)
    return body


def _header(fields: list[tuple[str, object]]) -> bytes:
    clean = ((k, str(v).replace("\r", "%0D").replace("\n", "%0A")) for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean).encode() + CRLF


def _urn(*parts: object) -> str:
    h = hashlib.md5("\0".join(map(str, parts)).encode("utf-8", "replace")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def records_of(page_id: int | None, url: str | None, payload: bytes, first: int | None, length: int | None, hex_digest: str, date: str, segment_bytes: int, chunk_bytes: int, place: str = "") -> Iterator[bytes]:
    """The WARC records of one page: a revisit, a response, or a response with its continuations. place tells equal pages apart."""
    digest = base64.b32encode(bytes.fromhex(hex_digest)).decode()
    urn = _urn(digest, page_id, url, place)
    same = [("WARC-Date", date), ("WARC-Target-URI", url if url is not None else f"urn:page:{page_id}"), ("X-Page-Id", page_id)]
    if first is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        yield _header([("WARC-Type", "revisit"), ("WARC-Record-ID", urn), *same, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", first), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", length), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    whole = len(block) <= segment_bytes
    for n, at in enumerate(range(0, len(block), segment_bytes), 1):
        piece = block[at : at + segment_bytes]
        last = at + segment_bytes >= len(block)
        fields = [("WARC-Type", "response" if n == 1 else "continuation"), ("WARC-Record-ID", urn if n == 1 else _urn(digest, page_id, url, place, n)), *same]
        if n == 1:
            fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
        else:
            fields += [("WARC-Segment-Origin-ID", urn)]
        fields += [("WARC-Segment-Number", None if whole else n), ("WARC-Segment-Total-Length", len(block) if last and not whole else None), ("Content-Length", len(piece))]
        yield _header(fields) + piece


def write_warc(
    pages: DataFrame, path: str, *, segment_bytes: int = 16 * 1024, chunk_bytes: int = 8 * 1024, min_revisit_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z", records_per_file: int = 200_000, broadcast_rows: int = 2_000_000,
) -> None:
    """Write a record for each row of pages (page_id, url, html) to gzip archives under path.

    Of equal payloads of at least min_revisit_bytes the smallest page_id is the response, the others are
    revisits without a body. Blocks over segment_bytes are cut into segments. Null html is an empty payload; a
    null page_id is always a response, and so is each row that has the smallest page_id; repeated rows are records of their own,
    for an identifier comes from page, url, payload and the place at which a task writes it. Other columns are ignored.

    Only digests with page_ids are shuffled to find the revisits, never payloads, and they are summed up before: the smallest page_id of each
    digest that several have. That list is broadcast if it has at most broadcast_rows rows, beyond that it is joined by a shuffle.
    """
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    src = pages.select("page_id", "url", raw.alias("payload")).withColumn("digest", F.sha1("payload"))
    keys = src.where(F.length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("least"), F.max("page_id").alias("last"))
    firsts = small(written(keys.where("least < last").select("digest", "least"), "warc-firsts"), broadcast_rows)
    first = F.when(F.col("page_id") > F.col("least"), F.col("least"))
    joined = src.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", first.alias("first"))
    lean = joined.select("page_id", "url", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"), "digest", "first", F.length("payload").cast("long").alias("length"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        for batch in batches:
            out, size = [], 0
            for page_id, url, payload, digest, first, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                for record in records_of(page_id, url, payload or b"", first, length, digest, date, segment_bytes, chunk_bytes, f"{task.partitionId() if task else 0}-{n}"):
                    out.append(record)
                    size += len(record)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = lean.mapInArrow(build, WRITTEN).select(F.col("value").cast("string").alias("value"))
    # CRLF CRLF after each row is the separator that the format wants between records
    records.write.option("lineSep", SEP.decode()).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


def _parse_fields(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def _number(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


class _Stream:
    """Cuts the bytes of one archive into records by their Content-Length."""

    def __init__(self) -> None:
        self.buffer, self.fields, self.end = bytearray(), None, 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.buffer += piece
        self.buffer += SEP
        while True:
            if self.fields is None:
                skip = 0
                while skip < len(self.buffer) and self.buffer[skip] in b"\r\n":
                    skip += 1
                del self.buffer[:skip]
                at = self.buffer.find(SEP)
                if at < 0:
                    return
                head = bytes(self.buffer[:at])
                if not head.startswith(b"WARC/"):
                    del self.buffer[: at + 4]
                    continue
                self.fields, self.start = _parse_fields(head), at + 4
                self.end = self.start + (_number(self.fields.get("content-length")) or 0)
            if len(self.buffer) < self.end:
                return
            yield self.fields, bytes(self.buffer[self.start : self.end])
            del self.buffer[: self.end]
            self.fields = None

    def rest(self) -> Iterator[tuple[dict[str, str], None]]:
        """At the end of an archive: the record that it breaks off in, without a block."""
        if self.fields is not None:
            yield self.fields, None


def read_warc(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """The logical records of gzip archives, one row each; columns RECORDS.

    Continuations are grouped by origin identifier, ordered by segment number and put together only if the
    numbers run from 1 without a gap and the length is the stated total; then chunked framing is decoded. A
    record that fails, or that its archive breaks off in, is kept with complete = false and no payload. Records with one WARC-Record-ID count
    once. A group holds the segments of one record, so it is as large as that record and no larger. Without
    with_payload the payload column is null and unsegmented payloads don't leave the task that parsed them.
    """
    pieces = spark.read.option("lineSep", SEP.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("declared_digest", pa.string()), ("declared_length", pa.int64()), ("payload_length", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())])
        now, stream = None, _Stream()
        rows: list[tuple] = []

        def take(found: Iterator[tuple[dict[str, str], bytes | None]]) -> int:
            size = 0
            for f, block in found:
                kind = f.get("warc-type")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                # a cut-off revisit says all that it has to in its header; other cut-off records count as segments without a block
                segment = _number(f.get("warc-segment-number")) or (1 if block is None and kind != "revisit" else None)
                body = body_of(block) if segment is None and kind == "response" else None
                keep = segment is not None or (with_payload and kind == "response")
                rows.append((f.get("warc-segment-origin-id") or f.get("warc-record-id"), segment, _number(f.get("warc-segment-total-length")), kind, f.get("warc-target-uri"), _number(f.get("x-page-id")), _number(f.get("x-refers-to-page-id")), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, _number(f.get("x-payload-length")), len(body) if body is not None else None, base32_sha1(body) if body is not None else None, block if keep else None))
                size += len(block or b"") if keep else 100
            return size

        for batch in batches:
            size = 0
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != now:
                    if not file.endswith(".gz"):
                        raise ValueError(f"only gzip archives are read, since Spark may split others between records: {file}")
                    size += take(stream.rest())
                    now, stream = file, _Stream()
                size += take(stream.feed(piece))
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                    rows.clear()
                    size = 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                rows.clear()
        take(stream.rest())
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    parsed = pieces.mapInArrow(parse, PARSED)
    names = [c for c in parsed.columns if c != "origin"]
    groups = parsed.groupBy("origin").agg(F.collect_list(F.struct(*names)).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("segments", pa.int32()), ("complete", pa.bool_()), ("digest_ok", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            rows = []
            for origin, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append(dict(zip(schema.names, _reassemble(origin, parts, with_payload), strict=True)))
            yield pa.RecordBatch.from_pylist(rows, schema)

    return groups.mapInArrow(join, RECORDS)


def _reassemble(origin: str | None, parts: list[dict], with_payload: bool) -> tuple:
    by_number = {p["segment"] or 1: p for p in sorted(parts, key=lambda p: (p["segment"] or 1, p["warc_type"] or ""), reverse=True)}
    order = sorted(by_number)
    head, last = by_number[order[0]], by_number[order[-1]]
    declared = head["declared_digest"]
    if head["warc_type"] == "revisit":
        return origin, head["page_id"], "revisit", head["target_uri"], head["refers_to"], 1, True, True, head["declared_length"], declared, None
    if head["segment"] is None:
        length, digest = head["payload_length"], head["payload_digest"]
        body = body_of(head["block"]) if with_payload and head["block"] is not None else None
        ok = digest is not None
    else:
        whole = order == list(range(1, len(order) + 1)) and head["warc_type"] == "response" and last["total_length"] is not None and all(by_number[n]["block"] is not None for n in order)
        block = b"".join(by_number[n]["block"] or b"" for n in order) if whole else b""
        whole = whole and len(block) == last["total_length"]
        body = body_of(block) if whole else None
        ok = body is not None
        length, digest = (len(body), base32_sha1(body)) if ok else (None, None)
    return origin, head["page_id"], head["warc_type"], head["target_uri"], None, len(order), ok, ok and (declared is None or declared == digest), length, digest, body if with_payload else None


def round_trip(pages: DataFrame, **options: int) -> DataFrame:
    """Write pages to archives in the shared folder, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, segments, complete."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path, **options)
    return read_warc(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments", "complete")
