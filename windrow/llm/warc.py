"""WARC archives of pages, compressed record by record with a dictionary of their own.

An archive is a sequence of Zstandard frames: first a skippable frame that holds a dictionary
built from the archive's records, then one frame for each record, so that a reader needs the
first frame and any other to read a record. Of pages with equal payloads one is a response and
the others are revisits that name it and carry no payload. Archives are bounded in size and are
rows of a table that Spark writes, whole or not at all; `export` makes files of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import cut, given_back, shared_folder, slim

#: Bytes of records in an archive (a longer record has one of its own), of its dictionary, and of the records it is built from.
ARCHIVE, DICTIONARY, TRAINED = 8 << 20, 32 << 10, 2 << 20
LEVEL = 3
# Fixed values of the formats: the skippable frame of a WARC dictionary, Zstandard frames and dictionaries, and the revisit profile.
DICTIONARY_FRAME, FRAME, DICTIONARY_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def with_types(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html (null for revisits), kind, sha1 (hex), size, record and refers (record ids), one row for each page.

    Of payloads of at least `least` bytes that are equal, by SHA-256, the page with the largest page_id is the response (null is
    smallest; then the larger url); of rows that are equal in all three, one. html crosses one shuffle, to the table of payloads.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("payload"), F.sha1(html).alias("sha1"), F.octet_length(html).cast("long").alias("size"))
    record = lambda page, url, copy: F.sha2(F.to_json(F.struct(page.alias("p"), url.alias("u"), F.col("payload"), copy.alias("c"))), 256)
    each = keyed.where(F.col("size") >= least).groupBy("payload", "sha1", "size", "page_id", "url").agg(F.count("*").alias("n"))
    top = each.groupBy("payload", "sha1", "size").agg(F.max(F.struct("page_id", "url", "n")).alias("top"))
    first = F.col("top.page_id").eqNullSafe(F.col("page_id")) & F.col("top.url").eqNullSafe(F.col("url"))
    held = record(F.col("top.page_id"), F.col("top.url"), F.lit(0).cast("long"))
    columns = ["page_id", "url", "html", "kind", "sha1", "size", "record", "refers"]

    def typed(rows: DataFrame) -> DataFrame:
        revisit = F.col("top").isNotNull() & ~first
        # only a response that others may name needs an id that follows from its row
        copy = F.when(F.col("top").isNotNull() & first, F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id() + 1)
        return rows.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), F.when(revisit, "revisit").otherwise("response").alias("kind"), "sha1", "size", record(F.col("page_id"), F.col("url"), copy).alias("record"), F.when(revisit, held).alias("refers"))

    many = cut(top.where("top.n > 1"))  # equal rows at the top: one is the response, the others are written from their count
    joined = keyed.join(top.select("payload", "top").hint("shuffle_hash"), "payload", "left")
    if many.isEmpty():
        return typed(joined)
    one = keyed.join(many.select("payload", "top"), "payload").where(first).dropDuplicates(["payload"])
    blocks = many.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top.n") - 1, F.lit(4096).cast("long"))))
    again = blocks.withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("top.n"), F.col("_from") + 4096) - 1)))
    again = again.select(F.col("top.page_id").alias("page_id"), F.col("top.url").alias("url"), F.lit(None).cast("string").alias("html"), F.lit("revisit").alias("kind"), "sha1", "size", record(F.col("top.page_id"), F.col("top.url"), F.col("_copy")).alias("record"), held.alias("refers"))
    rest = typed(joined.where(F.col("top").isNull() | ~first | (F.col("top.n") == 1)))
    return rest.select(columns).union(typed(one).select(columns)).union(again.select(columns))


def _urn(record: str) -> str:
    return f"<urn:uuid:{uuid.UUID(record[:32])}>"


def record_bytes(page_id: int | None, url: str | None, html: bytes | None, kind: str, sha1: str, size: int, record: str, refers: str | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header of the page it names."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (html or b"") if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", _urn(record)), ("WARC-Date", date)]
    if url:
        head.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        head.append(("Page-ID", str(page_id)))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    block = f"format: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_urn(hashlib.sha256(name.encode()).hexdigest())}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes], size: int = DICTIONARY, trained: int = TRAINED) -> zstandard.ZstdCompressionDict | None:
    """A dictionary built from records spread evenly over the archive, `trained` bytes of them; None where they are too few or too short."""
    some = [r for r in records if len(r) <= trained // 8]
    step = max(1, -(-sum(map(len, some)) // trained))
    try:
        return zstandard.train_dictionary(size, some[::step], k=512, d=8, f=18, accel=4) if len(some) >= 8 else None
    except zstandard.ZstdError:
        return None


def archive_bytes(records: list[bytes]) -> bytes:
    """The dictionary in a skippable frame (none, if none can be built), then a frame for each record."""
    words = dictionary_of(records)
    out = []
    if words is not None:
        raw = words.as_bytes()
        small = min(raw, zstandard.ZstdCompressor(level=19).compress(raw), key=len)
        out += [DICTIONARY_FRAME.to_bytes(4, "little"), len(small).to_bytes(4, "little"), small]
    writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True, write_content_size=True)
    out += map(writer.compress, records)
    return b"".join(out)


def frames(content: bytes) -> Iterator[tuple[int, memoryview]]:
    """(magic, frame) of each frame of an archive; a skippable frame without its header."""
    view, at = memoryview(content), 0
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic in SKIPPABLE:
            end = at + 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            yield magic, view[at + 8 : end]
        elif magic == FRAME:
            end, last = at + zstandard.frame_header_size(view[at : at + 18]), 0
            while not last:
                block = int.from_bytes(view[end : end + 3], "little")
                last, kind = block & 1, block >> 1 & 3
                end += 3 + (1 if kind == 1 else block >> 3)
            end += 4 * (view[at + 4] >> 2 & 1)
            yield magic, view[at:end]
        else:
            raise ValueError(f"no frame at byte {at} of an archive")
        if end > len(view):
            raise ValueError("an archive ends within a frame")
        at = end


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of an archive."""
    reader = zstandard.ZstdDecompressor()
    for magic, frame in frames(content):
        if magic == DICTIONARY_FRAME:
            raw = bytes(frame)
            if int.from_bytes(raw[:4], "little") == FRAME:
                raw = zstandard.ZstdDecompressor().decompress(raw)
            if int.from_bytes(raw[:4], "little") != DICTIONARY_MAGIC:
                raise ValueError("the dictionary frame holds no dictionary")
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic == FRAME:
            record = reader.decompress(frame)
            head, _, rest = record.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            block = rest[: int(fields["content-length"])]
            if not version.startswith("WARC/") or len(rest) != len(block) + 4:
                raise ValueError("a frame holds no whole record")
            yield fields, block


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", size: int = ARCHIVE) -> None:
    """Writes the pages' records to a table of archives (name, records, content) in a folder that all executors share.

    Each task fills archives of about `size` bytes of records; a page of any length is one record. An empty table writes no archive.
    Other columns of pages are not read; a null or empty url has no WARC-Target-URI, control characters in one are percent-encoded;
    see with_types for equal payloads, null ids and repeated rows.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, held, made = [], 0, 0

        def done() -> pa.RecordBatch:
            name = f"pages-{TaskContext.get().partitionId():06d}-{made:06d}.warc.zst"
            content = archive_bytes([_info(name, date), *records])
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)]), pa.array([content], pa.binary())], names=["name", "records", "content"])

        for batch in batches:
            columns = [batch.column(i).cast(pa.binary()).to_pylist() if i == 2 else batch.column(i).to_pylist() for i in range(8)]
            for row in zip(*columns, strict=True):
                record = record_bytes(*row, date)
                if records and held + len(record) > size:
                    yield done()
                    records, held, made = [], 0, made + 1
                records.append(record)
                held += len(record)
        if records:
            yield done()

    slim(with_types(pages, least)).mapInArrow(given_back(fill), "name string, records long, content binary").write.parquet(folder)


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row for each response and revisit: page_id, url, record_type, record, refers, payload_bytes and payload_digest (and payload).

    A response's digest is compared with its payload, and a difference is an error. A revisit has no payload of its own: its digest
    is the record's, its payload_bytes null; `resolved` fills them.
    """
    schema = "page_id long, url string, record_type string, record string, refers string, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(content: bytes) -> list[tuple]:
        out = []
        for fields, block in read_records(content):
            if (kind := fields["warc-type"]) not in ("response", "revisit"):
                continue
            digest, payload = fields["warc-payload-digest"].removeprefix("sha1:"), None
            if kind == "response":
                payload = block.partition(b"\r\n\r\n")[2]
                if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"the payload of {fields['warc-record-id']} is not that of its digest")
            page = fields.get("page-id")
            out.append((int(page) if page is not None else None, fields.get("warc-target-uri"), kind, fields["warc-record-id"], fields.get("warc-refers-to"), None if payload is None else len(payload), digest, payload))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = list(zip(*rows(batch.column(0)[i].as_py()), strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)][: len(names)], names=names)

    return slim(archives.select("content")).mapInArrow(given_back(run), schema)


def resolved(records: DataFrame) -> DataFrame:
    """The records of read_archives with payload_bytes of the full payload everywhere, and refers_to, the page_id of a revisit's response."""
    held = records.where("record_type = 'response'").select(F.col("record").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"))
    return records.join(held.hint("shuffle_hash"), "refers", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes")).drop("_bytes")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """(name, bytes) of the .warc.zst files made of the archives in a folder, a URI that pyarrow can open on every executor.

    A file is written under a name of its own and then moved, so that a task run twice leaves the same whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                own = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(content)
                store.move(own, f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)])], names=["name", "bytes"])

    return archives.select("name", "content").mapInArrow(run, "name string, bytes long")


def op13_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    records = cut(read_archives(spark.read.parquet(folder)))
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM p
"""
