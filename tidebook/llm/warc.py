"""WARC archives: a writer that revisits repeated payloads and a reader that salvages.

Writer. Every page becomes one record, each in a gzip member of its own. Of pages with
equal payloads of at least `least` bytes the one with the smallest id carries the
payload as a response; the others are revisit records that refer to it and carry
HTTP headers alone. Spark's text sink writes the members, about `file_bytes` of them a row and
a row a file; its line separator is an empty gzip member, so a part file is a valid .warc.gz.

Reader. An archive is read record by record, plain or in gzip members of one or more
records, of any type and id. A record counts if its version line, headers and lengths
hold, its block or payload digest does where it names one, and the length of its HTTP
payload where it does not. After a failed check the reader looks for the next version
line, within the member if it inflates, else for the next gzip member that starts a record,
goes on from there, and logs the bytes between as a quarantined gap.

Scale: payload digests are grouped by partial aggregation on (digest, smallest id,
count) only, and joined back as slim rows with the digests of repeated payloads, rows
of a common payload staying where they are; pages move once, by (id, digest), which also
numbers repeated rows. Files are bounded by bytes, and so is what a reader task holds.
Archives of others are read whole, at most 2 GB each (Spark's bound on a binary cell), and
take that and one inflated member in memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.common import durable, join_counted, read_table, shared_dir
from tidebook.runtime import ship_package

LEAST_REVISIT_BYTES, FILE_BYTES, DATE = 100, 32 << 20, "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_STARTS = re.compile(re.escape(GZIP_MAGIC) + b"|" + re.escape(VERSION))
_OWN_ID = re.compile(r"<urn:page:(-?\d+|null)(?::\d+)?>")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
FIELDS = (
    "path string, offset long, length long, record_type string, record_id string, page_id string, refers_to string, "
    "target_uri string, payload_bytes long, payload_digest string, payload binary, fault string"
)
CHUNK = 1 << 16


def _member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


EMPTY_MEMBER = _member(b"")


def build_record(
    record_type: str, page_id: str, copy: int, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None
) -> bytes:
    """One WARC/1.1 record, uncompressed; revisits leave the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    uri = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "urn:unknown")
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:page:{page_id}{f':{copy}' if copy > 1 else ''}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if record_type == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Found:
    """A record, or a gap if fault is set."""

    offset: int
    length: int
    record_type: str | None = None
    record_id: str | None = None
    page_id: str | None = None
    refers_to: str | None = None
    target_uri: str | None = None
    payload_bytes: int | None = None
    payload_digest: str | None = None
    payload: bytes | None = None
    fault: str | None = None


class Broken(ValueError):
    pass


def _unzip(view: memoryview, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at `at`, and where it ends."""
    inflate, out, here = zlib.decompressobj(31), [], at
    while not inflate.eof:
        if here >= len(view):
            raise Broken("member is cut off")
        try:
            out.append(inflate.decompress(view[here : here + CHUNK]))
        except zlib.error as e:
            raise Broken(f"member does not inflate: {e}") from e
        here += CHUNK
    return b"".join(out), min(here, len(view)) - len(inflate.unused_data)


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, sep, v in (line.partition(":") for line in lines) if sep}


def _number(headers: dict[str, str], name: str) -> int:
    if not headers.get(name, "").isdigit():
        raise Broken(f"no valid {name}")
    return int(headers[name])


def _holds(named: str, data: bytes) -> bool | None:
    """Whether data has the digest that a header names, `algorithm:value` in hex or base 32; None where it cannot tell."""
    algorithm, _, value = named.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha256", "sha512") or not value:
        return None
    found = hashlib.new(algorithm, data, usedforsecurity=False)
    value = value.strip()
    if len(value) == 2 * found.digest_size:
        return value.lower() == found.hexdigest()
    return value.rstrip("=").upper() == base64.b32encode(found.digest()).decode().rstrip("=")


def _parse(data: bytes, at: int) -> tuple[Found, int]:
    """The record that starts at data[at:], checked, and where it ends."""
    if data[at : at + len(VERSION)] != VERSION:
        raise Broken("no version line")
    split = data.find(b"\r\n\r\n", at)
    if split < 0:
        raise Broken("headers do not end")
    head = _headers(data[at:split])
    start = split + 4
    end = start + _number(head, "content-length")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Broken("content length does not lead to the record's end")
    block, end = data[start:end], end + 4
    kind, record_id = head.get("warc-type"), head.get("warc-record-id")
    if not kind or not record_id:
        raise Broken("no type or no record id")
    if _holds(head.get("warc-block-digest", ""), block) is False:
        raise Broken("block does not match its digest")
    http = "application/http" in head.get("content-type", "").lower()
    top, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    stated = _headers(top)
    digest = head.get("warc-payload-digest", "")
    size: int | None = len(payload)
    if kind == "revisit":
        # the payload is the record's that it refers to
        size = int(stated["content-length"]) if stated.get("content-length", "").isdigit() else None
    elif "warc-truncated" not in head:
        matched = _holds(digest, payload) if digest else None
        if matched is False:
            raise Broken("payload does not match its digest")
        if matched is None and stated.get("content-length", str(size)) != str(size) and "transfer-encoding" not in stated:
            raise Broken("payload does not match its length")
    own, refers = _OWN_ID.fullmatch(record_id), head.get("warc-refers-to")
    own_refers = _OWN_ID.fullmatch(refers or "")
    return (
        Found(at, end - at, kind, record_id, own[1] if own else None, own_refers[1] if own_refers else refers, head.get("warc-target-uri"), size,
              digest.removeprefix("sha256:") or None, payload if kind != "revisit" else None),
        end,
    )


def _plain(data: bytes, at: int = 0, only_first: bool = False) -> Iterator[Found]:
    """Records of uncompressed data and the gaps between them, or the record at `at` alone."""
    while at < len(data):
        try:
            found, end = _parse(data, at)
        except Broken as e:
            if only_first:
                raise
            end = _next_record(data, at + 1)
            found = Found(at, end - at, fault=str(e))
        yield found
        if only_first:
            return
        at = end


def _next_record(data: bytes, at: int) -> int:
    """First offset from `at` on where a version line starts a valid record."""
    while (at := data.find(VERSION, at)) >= 0:
        try:
            _parse(data, at)
            return at
        except Broken:
            at += 1
    return len(data)


def _at(view: memoryview, at: int) -> tuple[list[Found], int]:
    """What starts at `at` and where it ends: the records and gaps of a member, or one plain record."""
    if view[at : at + 3] == GZIP_MAGIC:
        content, end = _unzip(view, at)
        inside = list(_plain(content))
        if inside and all(f.fault for f in inside):
            raise Broken(inside[0].fault)
        if len(inside) == 1:
            inside[0].offset, inside[0].length = at, end - at
        for k, found in enumerate(inside if len(inside) > 1 else []):
            # records that share a member have its place in the file; the first has its length
            found.offset, found.length = at, end - at if k == 0 else 0
        return inside, end
    # a record that is not compressed is cut out of the file before it is parsed
    split = _find(view, b"\r\n\r\n", at)
    if view[at : at + len(VERSION)] != VERSION or split < 0:
        raise Broken("no version line" if split >= 0 else "headers do not end")
    end = min(split + 8 + _number(_headers(bytes(view[at:split])), "content-length"), len(view))
    found = next(_plain(bytes(view[at:end]), only_first=True))
    found.offset = at
    return [found], at + found.length


def _find(view: memoryview, wanted: bytes, at: int) -> int:
    hit = re.compile(re.escape(wanted)).search(view, at)
    return hit.start() if hit else -1


def salvage(data: bytes | memoryview) -> Iterator[Found]:
    """Records of an archive, plain or gzip by member, and the gaps that hold none."""
    view, at, n = memoryview(data).cast("B"), 0, len(data)
    while at < n:
        try:
            found, end = _at(view, at)
        except Broken as e:
            end = _next_start(view, at + 1)
            found = [Found(at, end - at, fault=str(e))]
        yield from found
        at = end


def _next_start(view: memoryview, at: int) -> int:
    """First offset from `at` on where a member or version line starts a valid record."""
    for hit in _STARTS.finditer(view, at):
        try:
            if _at(view, hit.start())[0]:
                return hit.start()
        except Broken:
            pass
    return len(view)


def classify(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Pages with _tw_digest, _tw_size, _tw_copy, record_type and refers_to; html null is empty.

    Rows that repeat both id and payload are numbered; only the first of them can be
    the response. A null id comes after all others.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    full = pages.select("page_id", "url", html.alias("html")).select(
        "page_id",
        "url",
        "html",
        F.sha2(F.col("html").cast("binary"), 256).alias("_tw_digest"),
        F.octet_length("html").cast("long").alias("_tw_size"),
    )
    key = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("/"), F.col("_tw_digest"))
    slim = full.groupBy("page_id", "_tw_digest", "_tw_size").agg(F.count(F.lit(1)).alias("n"))
    winners = (
        slim.where(F.col("_tw_size") >= least)
        .groupBy("_tw_digest")
        .agg(F.sum("n").alias("_tw_n"), F.min("page_id").alias("_tw_first"))
        .where("_tw_n > 1")
        .withColumn("_tw_known", F.lit(True))
    )
    # rows of a payload that many pages share stay where they are
    plan = join_counted(durable(slim), winners, "_tw_digest", "_tw_n", "left").select(
        key.alias("_tw_key"), F.col("_tw_known"), "_tw_first", F.col("page_id").eqNullSafe(F.col("_tw_first")).alias("_tw_wins")
    )
    copies = Window.partitionBy("_tw_key").orderBy("url")
    revisit = F.col("_tw_known").isNotNull() & ~(F.col("_tw_wins") & (F.col("_tw_copy") == 1))
    return (
        full.withColumn("_tw_key", key)
        .withColumn("_tw_copy", F.row_number().over(copies))
        .join(plan, "_tw_key")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.coalesce(F.col("_tw_first").cast("string"), F.lit("null"))))
        .drop("_tw_key", "_tw_known", "_tw_wins", "_tw_first")
    )


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Writes columns page_id, url and html as gzip WARC part files under `path`, each of about `file_bytes` at most, or one record."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                for r in batch.slice(start, 500).to_pylist():
                    record = build_record(
                        r["record_type"], r["id"], r["_tw_copy"], r["url"], r["html"], r["_tw_size"], r["_tw_digest"], r["refers_to"]
                    )
                    held.append(_member(record))
                    size += len(held[-1])
                    if size >= file_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])

    ship_package()
    rows = classify(pages, least).select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("id"),
        "url",
        F.when(F.col("record_type") == "response", F.col("html")).otherwise(F.lit("")).cast("binary").alias("html"),
        "_tw_copy",
        "_tw_size",
        "_tw_digest",
        "record_type",
        "refers_to",
    )
    (
        rows.mapInArrow(members, "members binary")
        .select(F.col("members").cast("string").alias("value"))
        .write.option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps (fault is set) of all archives under `path`, with the columns FIELDS."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out: list[dict] = []
                held = 0
                for found in salvage(memoryview(content.as_buffer())):
                    out.append({"path": name, **found.__dict__})
                    held += len(found.payload or b"")
                    if len(out) >= 1000 or held > 1 << 23:
                        yield pa.RecordBatch.from_pylist(out, schema or _schema())
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema or _schema())

    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(records, FIELDS)


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in FIELDS.split(", "))])


def recover(spark: SparkSession, path: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Records and gaps of all archives under `path`, read once, without payloads.

    Both are kept under `out`; its folder `quarantine` holds a JSON line (path, offset,
    length, fault) for every gap.
    """
    read_archives(spark, path).drop("payload").write.parquet(f"{out}/read")
    read = spark.read.parquet(f"{out}/read")
    gaps = read.where(F.col("fault").isNotNull()).select("path", "offset", "length", "fault")
    gaps.write.json(f"{out}/quarantine")
    return read.where(F.col("fault").isNull()).drop("fault"), gaps


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives in the shared folder and read back.

    Bytes that hold no valid record are logged in the folder `recovered/quarantine` beside the
    archives; a page without a record is an error that names it.
    """
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = read_table(spark, sf_dir, "pages")
    write_archives(pages, f"{folder}/archives")
    records, _ = recover(spark, f"{folder}/archives", f"{folder}/recovered")
    lost = pages.count() - records.count()
    if lost:
        raise ValueError(f"{lost} pages have no valid record; see {folder}/recovered/quarantine")
    return records.select(
        F.expr("try_cast(page_id AS BIGINT)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.expr("try_cast(refers_to AS BIGINT)").alias("refers_to"),
    )
