"""WARC archives written by Spark, and a reader that salvages damaged ones (operator 1).

Archives are UTF-8 text but for their line ends, so Spark's text sink writes them
and its commit protocol guards them: a record is one row, and the blank line that
ends a record is the line separator.  The reader checks every record (version
line, headers, length, closing blank line, payload digest).  Where a check fails
it looks for the next gzip member or version line whose record passes, goes on
there, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkwell.llm.common import scratch, stored, table

#: Smallest payload that may be replaced by a reference to an equal one.
LEAST_SHARED_BYTES = 100
#: Bytes of payload an archive is meant to hold.
ARCHIVE_BYTES = 32 << 20

END = b"\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def mark_revisits(pages: DataFrame, id_col: str = "page_id", least: int = LEAST_SHARED_BYTES) -> DataFrame:
    """Add payload (null: empty), n_bytes, digest and refers_to to pages with an html column.

    Of rows with one payload of at least ``least`` bytes, those with the smallest id
    have no refers_to and the others name that id.  Null ids are never the smallest;
    if all are null, none refers to another.  Payloads that repeat are found from
    digests alone; Catalyst broadcasts that table where its size allows it.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digest = F.sha2(payload.cast("binary"), 256)
    narrow = pages.select(F.col(id_col).alias("id"), digest.alias("digest"), F.octet_length(payload).alias("n_bytes"))
    groups = narrow.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    shared = stored(groups.where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"), "shared-payloads")
    rows = pages.select(
        F.col(id_col).alias("id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n_bytes"), digest.alias("digest"),
    )
    first = F.when(F.col("id").eqNullSafe(F.col("first_id")), None).otherwise(F.col("first_id"))
    return rows.join(shared, "digest", "left").withColumn("refers_to", first).drop("first_id")


def write_warc(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write rows of ``mark_revisits``: responses with their payload, revisits without."""
    line = "\r\n"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "),
        F.col("n_bytes").cast("string"), F.lit(line * 2),
    )
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("about:blank"))
    name = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    head = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{line}WARC-Record-ID: <urn:page:"), name, F.lit(f">{line}WARC-Target-URI: "), uri,
        F.lit(f"{line}WARC-Date: {date}{line}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(
            F.lit(f"{line}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{line}WARC-Refers-To: <urn:page:"),
            F.col("refers_to").cast("string"), F.lit(">"),
        )).otherwise(""),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(line * 2),
    )
    size = records.agg(F.avg("n_bytes")).first()[0] or 0.0
    (
        records.select(F.concat(head, block).alias("value")).write.option("lineSep", line * 2)
        .option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / (size + 500)))).text(path)
    )


class Damage(Exception):
    """A record that fails a check."""


def _headers(text: bytes) -> dict[str, str]:
    found = {}
    for line in text.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line without a colon")
        found[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return found


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at a byte of uncompressed data, and where the next one begins."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        raise Damage("no version line")
    start = data.index(b"\r\n", at) + 2
    stop = data.find(END, start)
    if stop < 0:
        raise Damage("headers do not end")
    headers = _headers(data[start:stop])
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damage("no content length")
    body, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != END:
        raise Damage("block does not end where its length says")
    kind, block = headers.get("warc-type"), data[body:end]
    record = {"type": kind, "id": headers.get("warc-record-id"), "uri": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to")}
    if headers.get("content-type", "").startswith("application/http"):
        split = block.find(END)
        if split < 0:
            raise Damage("http headers do not end")
        http, payload = _headers(block[block.index(b"\r\n") + 2 : split]), block[split + 4 :]
    else:
        http, payload = {}, block
    method, _, stated = headers.get("warc-payload-digest", "").partition(":")
    if kind == "revisit":
        record |= {"payload": None, "n_bytes": int(http.get("content-length", 0)), "digest": stated or None}
    else:
        digest = hashlib.sha256(payload).hexdigest()
        if method == "sha256" and stated != digest:
            raise Damage("payload digest differs")
        record |= {"payload": payload, "n_bytes": len(payload), "digest": digest}
    return record, end + 4


#: Bytes of a gzip member that are decompressed at a time.
PIECE = 1 << 16


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What a gzip member holds, the byte after it, and what is wrong with it: then the data reach up to there."""
    unzip, out, place, size, view = zlib.decompressobj(31), [], at, PIECE, memoryview(data)
    while place < len(data) and not unzip.eof:
        before = unzip.copy()
        try:
            out.append(unzip.decompress(view[place : place + size]))
        except zlib.error as error:
            if size == 1:
                return b"".join(out), place, f"gzip member: {error}"
            unzip, size = before, max(1, size // 16)  # what precedes the error is kept
            continue
        place += size
    if not unzip.eof:
        return b"".join(out), len(data), "gzip member is cut off"
    return b"".join(out), min(place, len(data)) - len(unzip.unused_data), None


def _inside(inner: bytes, broken: str | None) -> tuple[list[dict], list[str], int]:
    """The records of a member that pass, the gaps between them, and where the last record ends.

    In a broken member a record that reaches the end of its data does not pass.
    """
    found, gaps, place, last, why = [], [], 0, 0, None
    while place < len(inner):
        try:
            record, end = parse_record(inner, place)
            if broken and end == len(inner):
                raise Damage(broken)
        except Damage as error:
            why = why or str(error)
            after = VERSION.search(inner, place + 1)
            place = after.start() if after else len(inner)
            continue
        if why:
            gaps.append(f"{why} (bytes {last} to {place} of the member)")
        found.append(record)
        place, last, why = end, end, None
    if why:
        gaps.append(f"{why} (bytes {last} to {len(inner)} of the member)")
    return found, gaps, last


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", start, end, record) and ("gap", start, end, reason) for all bytes of an archive.

    Records and gaps inside a gzip member have the place of the member; the reason of
    such a gap names the bytes of the uncompressed member.
    """
    at, lost, why = 0, None, ""
    while at < len(data):
        gaps, broken = [], None
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                inner, end, broken = _member(data, at)
                found, gaps, last = _inside(inner, broken)
                if not found and (broken or gaps):
                    raise Damage(broken or gaps[0])
                if broken:  # the bytes after those of the last record that passes are searched
                    unzip = zlib.decompressobj(31)
                    unzip.decompress(memoryview(data)[at:], last)
                    end = max(at + 1, len(data) - len(unzip.unconsumed_tail) - 8)  # zlib reads a few bytes ahead
            else:
                record, end = parse_record(data, at)
                found = [record]
        except Damage as error:
            if lost is None:
                lost, why = at, str(error)
            after = NEXT.search(data, at + 1)
            at = after.start() if after else len(data)
            continue
        if lost is not None:
            yield "gap", lost, at, why
            lost = None
        for record in found:
            yield "record", at, end, record
        for reason in gaps:
            yield "gap", at, end, reason
        at = end
        if broken and at < len(data):
            lost, why = at, f"{broken} (after byte {last} of the member)"
            after = NEXT.search(data, at)
            at = after.start() if after else len(data)
        elif broken:
            yield "gap", end, end, f"{broken} (after byte {last} of the member)"
    if lost is not None and lost < len(data):
        yield "gap", lost, len(data), why


READ_SCHEMA = (
    "path string, kind string, start long, end long, reason string, type string, id string, uri string, "
    "refers_to string, n_bytes long, digest string, payload binary"
)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, pattern: str = "part-*") -> DataFrame:
    """Records and gaps of all archives below a path.

    ``kind`` is record or gap; start and end are byte positions in the archive (of the
    gzip member, where there is one), ``reason`` says which check failed first.
    An archive is read whole by one task, so it must be smaller than 2 GB.
    """

    def read(batches):
        names = [part.split()[0] for part in READ_SCHEMA.split(", ")]
        schema = pa.schema([(n, {"start": pa.int64(), "end": pa.int64(), "n_bytes": pa.int64(), "payload": pa.binary()}.get(n, pa.string())) for n in names])
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for kind, start, end, what in salvage((content.as_buffer() or pa.py_buffer(b"")).to_pybytes()):
                    row = {"path": file, "kind": kind, "start": start, "end": end}
                    if kind == "gap":
                        row["reason"] = what
                    else:
                        row |= what
                        if not with_payload:
                            row["payload"] = None
                    rows.append(row)
                    held += 200 + len(row.get("payload") or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(read, READ_SCHEMA)


def _page(column: str):
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(mark_revisits(table(spark, sf_dir, "pages")), path)
    return read_warc(spark, path, with_payload=False).where("kind = 'record'").select(
        _page("id").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), _page("refers_to").alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
g AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN g USING (payload_digest)
"""
