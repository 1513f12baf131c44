"""Legacy ARC archives to WARC, and both read by their declared lengths.

``arc_files`` makes ARC bytes (version 1 or 2) of pages; ``convert`` parses ARC bytes into
records; ``plan_revisits`` decides which record keeps a payload; ``write`` stores WARC files
and ``read`` parses those.  An archive is never cut at separators: the version block of an ARC
names the fields of its header lines, and every record is as long as its header declares.

Null html or url count as empty; a null id writes no id field and reads back as null.  Spaces
and line breaks in a url are percent-encoded.  Repeated rows give a record each.  Empty tables
give no archive and no record.  An archive whose header line or length makes no sense gives
one row with ``error`` for the rest of it, and keeps what was read before.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, maybe_broadcast, shared_folder
from .words import freeing

# Header fields of ARC version blocks, and names WARC prescribes.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARC_BYTES = 8 << 20
ID_FIELD = "X-Source-Id"
RECORDS = (
    "archive string, position long, url string, ip string, archive_date string, mime string, source_id long, http boolean, "
    "head binary, payload binary, payload_bytes long, payload_digest string, block_digest string, head_digest string, error string"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def arc_files(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int | None = None) -> DataFrame:
    """(name, content): ARC archives of near ``ARC_BYTES``, one HTTP response record a page.

    ``version`` None writes both, archives taking turns.  Archives do not cross partitions.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(url_col, F.lit("")).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("html"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            kind = version or 1 + (part + number) % 2
            name = f"part-{part:06d}-{number:06d}.arc"
            said = f"{kind} 0 tidemark\n{ARC_FIELDS[kind]}\n".encode()
            out = [_arc_line(kind, f"filedesc://{name}", "0.0.0.0", "20240101000000", "text/plain", len(said)), said, b"\n"]
            for url, body in held:
                out += [_arc_line(kind, url, "0.0.0.0", "20240101000000", "text/html", len(body)), body, b"\n"]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary())], ["name", "content"])

        for batch in batches:
            for key, url, html in zip(*(batch[c].to_pylist() for c in ("id", "url", "html")), strict=True):
                own = "" if key is None else f"{ID_FIELD}: {key}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(html)}\r\n\r\n"
                held.append((_bare(url), head.encode() + html))
                size += len(html) + len(head) + len(url)
                if size >= ARC_BYTES:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()

    return rows.mapInArrow(freeing(run), "name string, content binary")


def _bare(url: str) -> str:
    for sign in " \n\r\t":
        url = url.replace(sign, f"%{ord(sign):02X}")
    return url or "-"


def _arc_line(kind: int, url: str, ip: str, date: str, mime: str, length: int) -> bytes:
    more = f" 200 - - 0 {url.rsplit('/', 1)[-1] or '-'}" if kind == 2 else ""
    return f"{url} {ip} {date} {mime}{more} {length}\n".encode()


def arc_records(content: bytes) -> Iterator[tuple[int, dict | None, bytes, str | None]]:
    """(position, header fields, block, error) of an ARC's records after its version block."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at, names, told = 0, None, None
    while at < len(content):
        if content[at : at + 1] == b"\n":  # the separator between records
            at += 1
            continue
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].decode("utf-8", "replace").rstrip("\r")
        fields = line.rsplit(" ", len(names) - 1 if names else 4 if " 200 " not in line else 9)
        if names is None and not line.startswith("filedesc://"):
            told = "no version block"
        elif end < 0 or not fields[-1].isdigit() or names and len(fields) != len(names):
            told = f"not a header line: {line[:80]}"
        elif end + 1 + int(fields[-1]) > len(content):
            told = f"declared length {fields[-1]} passes the end"
        if told:
            yield at, None, b"", told
            return
        block = content[end + 1 : end + 1 + int(fields[-1])]
        if names is None:
            kind = block.split(b" ", 1)[0]
            if kind not in (b"1", b"2"):
                yield at, None, b"", f"unknown version {kind[:8]!r}"
                return
            names = [x.lower() for x in ARC_FIELDS[int(kind)].split(" ")]
        else:
            yield at, dict(zip(names, fields, strict=True)), block, None
        at = end + 1 + len(block)


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its empty line) and payload of an HTTP response; no head if it is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (block, b"")


def fields_of(head: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _number(x: str | None) -> int | None:
    return int(x) if x and x.lstrip("-").isdigit() else None


def convert(archives: DataFrame) -> DataFrame:
    """The records of ARC archives (columns name, content), with what WARC needs computed.

    Digests are base32 SHA-1.  ``source_id`` comes from the ``X-Source-Id`` line of the HTTP
    head.  Blocks that are no HTTP response count as payload whole (a WARC resource).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in RECORDS.split(",")]
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist(), strict=True):
                rows = []
                for at, said, block, error in arc_records(content or b""):
                    if said is None:
                        rows.append((name, at, *[None] * 12, error))
                        continue
                    head, payload = http_parts(block)
                    more = fields_of(head)
                    date = said["archive-date"].ljust(14, "0")
                    rows.append(
                        (name, at, said["url"], said["ip-address"], date, said["content-type"], _number(more.get(ID_FIELD.lower())), bool(head),
                         head, payload, len(payload), base32_sha1(payload), base32_sha1(block), base32_sha1(head), None)
                    )
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)

    return archives.select("name", "content").mapInArrow(freeing(run), RECORDS)


_TYPES = [
    {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[x.strip().split(" ")[1]] for x in RECORDS.split(",")
]


def record_id(archive, position):
    """A urn:uuid that follows from an archive's name and a position in it."""
    h = F.sha1(F.concat_ws(":", archive, position.cast("string")).cast("binary"))
    cut = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3))]
    cut += [F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def plan_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``first``: for a record whose payload an earlier one has, that one's id, place and date; else null.

    Earlier means smaller source_id (null last), then archive and position.  Payloads are
    equal if digest and length are; those under ``min_bytes`` are left alone.  Only the first
    of each repeated payload travels to the records.
    """
    order = F.struct(F.col("source_id").isNull().alias("no_id"), "source_id", "archive", "position", "archive_date", "url")
    large = records.where(F.col("error").isNull() & (F.col("payload_bytes") >= min_bytes))
    firsts = large.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").drop("n")
    out = records.join(maybe_broadcast(cut_lineage(firsts, "firsts")), ["payload_digest", "payload_bytes"], "left")
    itself = (F.col("first.archive") == F.col("archive")) & (F.col("first.position") == F.col("position"))
    return out.withColumn("first", F.when(~itself, F.col("first")))


def write(records: DataFrame, path: str, records_per_file: int = 5000) -> None:
    """WARC 1.1 files under ``path``, each compressed as one gzip member.

    Header, block and the two line breaks after it are one line of a text sink whose line
    separator are those line breaks, so that Spark's committer guards the files.
    """
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("first").isNotNull()
    part = lambda column, *at: F.substring(column, *at)
    moment = lambda c: F.concat(
        part(c, 1, 4), F.lit("-"), part(c, 5, 2), F.lit("-"), part(c, 7, 2), F.lit("T"),
        part(c, 9, 2), F.lit(":"), part(c, 11, 2), F.lit(":"), part(c, 13, 2), F.lit("Z"),
    )
    kind = F.when(revisit, "revisit").when(F.col("http"), "response").otherwise("resource")
    length = F.octet_length("head") + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    own_id = F.when(F.col("source_id").isNotNull(), line(ID_FIELD, F.col("source_id").cast("string")))
    its_id = F.when(F.col("first.source_id").isNotNull(), line(f"X-Refers-To-{ID_FIELD[2:]}", F.col("first.source_id").cast("string")))
    back = F.concat(
        line("WARC-Profile", F.lit(REVISIT_PROFILE)),
        line("WARC-Refers-To", record_id(F.col("first.archive"), F.col("first.position"))),
        line("WARC-Refers-To-Target-URI", F.col("first.url")),
        line("WARC-Refers-To-Date", moment(F.col("first.archive_date"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.coalesce(its_id, F.lit("")),
    )
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id(F.col("archive"), F.col("position"))),
        line("WARC-Date", moment(F.col("archive_date"))),
        line("WARC-Target-URI", F.col("url")),
        F.when(F.col("ip") != "0.0.0.0", line("WARC-IP-Address", F.col("ip"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, F.col("head_digest")).otherwise(F.col("block_digest")))),
        F.coalesce(own_id, F.lit("")),
        F.when(revisit, back).otherwise(F.lit("")),
        line("Content-Type", F.when(F.col("http"), "application/http; msgtype=response").otherwise(F.col("mime"))),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    whole = F.concat(header.cast("binary"), block).cast("string").alias("value")
    good = records.where("error is null").select(whole)
    good.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of a WARC file's records."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        said = fields_of(content[at:end])
        block = content[end + 4 : end + 4 + int(said["content-length"])]
        yield said, block
        at = end + 4 + len(block) + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under ``path``, payload included (null for revisits)."""
    schema = (
        "record_id string, record_type string, url string, warc_date string, source_id long, payload_bytes long, "
        "payload_digest string, refers_to long, refers_to_record string, payload binary"
    )
    types = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in schema.split(",")]
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for said, block in warc_records(batch["content"][i].as_py()):
                    payload = None if said["warc-type"] == "revisit" else http_parts(block)[1]
                    digest = said["warc-payload-digest"].split(":", 1)[1]
                    if payload is not None and base32_sha1(payload) != digest:
                        raise ValueError(f"payload of {said['warc-record-id']} does not have its digest")
                    size = int(said["x-payload-length"]) if payload is None else len(payload)
                    rows.append(
                        (said["warc-record-id"], said["warc-type"], said["warc-target-uri"], said["warc-date"], _number(said.get(ID_FIELD.lower())),
                         size, digest, _number(said.get(f"x-refers-to-{ID_FIELD[2:].lower()}")), said.get("warc-refers-to"), payload)
                    )
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(freeing(run), schema)


def archive(pages: DataFrame, min_bytes: int = 0, **columns) -> str:
    """Pages to ARC to WARC files at a new place in the shared folder; returns that place."""
    path = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    records = cut_lineage(convert(arc_files(pages, **columns)), "arc-records")
    write(plan_revisits(records, min_bytes), path)
    return path
