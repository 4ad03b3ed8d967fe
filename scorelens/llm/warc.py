"""WARC archives as seekable Zstandard bundles.

A bundle is one ``.warc.zst`` file.  Records are grouped into independent
Zstandard frames of about ``frame_bytes``; after the last frame comes a
skippable frame with the seek table (sizes of every frame) and its footer, so a
reader finds any frame from the end of the file and plain decompressors still
read the whole bundle.  The index maps each record identifier to its bundle,
frame and offset inside the decompressed frame.

Every task writes bundles under names of its own attempt and returns index rows;
a bundle counts once the index names it, so a lost executor or a repeated
attempt leaves files that no index row names, never half an archive.  Bundles
are written and read through ``pyarrow.fs`` (local or shared POSIX folders,
``hdfs://``, ``s3://``, ``gs://``).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scorelens.llm.common import shuffle_partitions

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 28
SPAN_FRAMES = 64
ROWS_OUT = 4096
BYTES_OUT = 1 << 24

# Fixed values of the Zstandard seekable format and of WARC/1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER_BYTES = 9
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

INDEX_COLUMNS = "record_id string, record_type string, bundle string, frame int, offset long, length long"


# ---------------------------------------------------------------- storage

def open_store(uri: str):
    """(file system, path in it) of a folder: a plain path, ``file:`` or any scheme pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


# ---------------------------------------------------------------- frames

def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame with (compressed, decompressed) sizes of every frame and the footer."""
    body = b"".join(struct.pack("<II", *sizes) for sizes in frames)
    body += struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(position, compressed size, decompressed size) of every frame, read from the end of an open bundle."""
    source.seek(size - FOOTER_BYTES)
    n, flags, magic = struct.unpack("<IBI", source.read(FOOTER_BYTES))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("bundle without a seek table")
    entry = 12 if flags & 0x80 else 8
    source.seek(size - FOOTER_BYTES - n * entry)
    table = source.read(n * entry)
    frames, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * entry)
        frames.append((at, packed, plain))
        at += packed
    return frames


class BundleWriter:
    """Writes records into bundles of one task attempt; ``add`` says where the record will lie."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int, level: int, preamble: bytes):
        import zstandard

        self.store, self.path = open_store(folder)
        self.frame_bytes, self.bundle_bytes, self.preamble = frame_bytes, bundle_bytes, preamble
        self.squeeze = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.out = None

    def _open(self) -> None:
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.store.create_dir(self.path, recursive=True)
        self.out = self.store.open_output_stream(f"{self.path}/{self.name}", compression=None)
        self.frames: list[tuple[int, int]] = []
        self.part, self.fill, self.total = [self.preamble], len(self.preamble), 0

    def add(self, record: bytes) -> tuple[str, int, int]:
        if self.out is not None and self.total >= self.bundle_bytes:
            self.close()
        if self.out is None:
            self._open()
        if self.fill and self.fill + len(record) > self.frame_bytes:
            self._flush()
        place = self.name, len(self.frames), self.fill
        self.part.append(record)
        self.fill += len(record)
        return place

    def _flush(self) -> None:
        if self.fill:
            plain = b"".join(self.part)
            packed = self.squeeze(plain)
            self.out.write(packed)
            self.frames.append((len(packed), len(plain)))
            self.total += len(plain)
            self.part, self.fill = [], 0

    def close(self) -> None:
        if self.out is not None:
            self._flush()
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None


# ---------------------------------------------------------------- records

def record_id(page) -> str:
    """``<urn:x-page:ID>``; a null id has no last part."""
    return "<urn:x-page>" if page is None else f"<urn:x-page:{quote(str(page), safe='')}>"


def page_of(identifier: str | None) -> str | None:
    """The id, as text, of ``record_id``."""
    if identifier is None or ":x-page:" not in identifier:
        return None
    return unquote(identifier.split(":x-page:", 1)[1][:-1])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page, url: str | None, payload: bytes, size: int, digest: str, first, revisit: bool, date: str) -> bytes:
    """A response record with its payload, or a revisit record with the HTTP head of the payload it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page)),
               ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first))]
    block = http if revisit else http + payload
    headers += [("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
                ("Content-Type", "application/http; msgtype=response")]
    return warc_record(headers, block)


def split_record(data: memoryview | bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at`` of a decompressed frame."""
    end = data.find(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no record at offset {at}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError(f"record at offset {at} has no end mark")
    return headers, data[start:stop], stop + 4


def described(headers: dict[str, str], block: bytes) -> tuple:
    """(record_id, type, target, refers_to, payload size, payload digest, payload or None) of a page record.

    The block digest of every record and the payload digest of a response are
    computed anew; a difference raises.
    """
    if f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"block of {headers['WARC-Record-ID']} was changed")
    cut = block.find(b"\r\n\r\n") + 4
    http = dict(line.split(": ", 1) for line in block[:cut - 4].decode().split("\r\n")[1:])
    size, digest = int(http["Content-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None
    if headers["WARC-Type"] == "response":
        payload = block[cut:]
        if len(payload) != size or base32_sha1(payload) != digest:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} was changed")
    target = headers.get("WARC-Target-URI")
    return (headers["WARC-Record-ID"], headers["WARC-Type"], target, headers.get("WARC-Refers-To"), size, digest, payload)


# ---------------------------------------------------------------- operator

def _base32(hex_digest):
    """Upper-case base32 of a 160-bit digest in hex: 20 bits (5 hex digits, 4 letters) at a time."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE32_DIGITS, BASE32_LETTERS)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = 0, salts: int | None = None) -> DataFrame:
    """(page, url, payload, size, digest, first, revisit) for every row.

    Payloads are equal when both their SHA-1 and their SHA-256 are.  Groups
    are merged per salt, then over salts, so a payload that a third of all rows
    share is never one task's; rows meet the smallest id of their group by
    (payload, salt) again.  ``salts`` follows the shuffle partitions.
    """
    salts = salts or max(32, shuffle_partitions(pages.sparkSession))
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = (pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
            .withColumn("size", F.octet_length("payload").cast("long"))
            .withColumn("sha1", F.sha1("payload")).withColumn("sha256", F.sha2("payload", 256))
            .withColumn("salt", F.pmod(F.xxhash64("page", "url"), F.lit(salts)).cast("int")))
    key = ["sha1", "sha256"]
    parts = (rows.where(F.col("size") >= min_bytes).groupBy(*key, "salt")
             .agg(F.min("page").alias("least"), F.count(F.lit(1)).alias("n")))
    firsts = parts.groupBy(*key).agg(F.min("least").alias("first"), F.sum("n").alias("copies")).where("copies > 1")
    told = parts.select(*key, "salt").join(firsts.drop("copies"), key)
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    return (rows.join(told, [*key, "salt"], "left")
            .select("page", "url", "payload", "size", _base32(F.col("sha1")).alias("digest"), "first",
                    revisit.alias("revisit")))


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_bytes: int = 0, salts: int | None = None,
                  frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3,
                  date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row into bundles under ``folder`` and return the index.

    Null payloads count as empty.  Of rows with equal payloads of at least
    ``min_bytes`` bytes, those with the smallest id are responses and all others
    revisits of it; a null id is larger than any id, so it becomes a response
    only in a group without ids.  Rows that repeat an id are records of their own
    under one identifier.  A null url leaves out the target; other columns are
    ignored whatever their names.  An empty table gives an empty index and no
    bundle.  A record larger than a frame has a frame of its own; a payload is
    one record's and so bounded by what one row can hold.
    """
    spark = pages.sparkSession
    data = f"{folder.rstrip('/')}/data"
    preamble = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x-page-bundle>"), ("WARC-Date", date),
                            ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")

    def run(batches):
        writer = BundleWriter(data, frame_bytes, bundle_bytes, level, preamble)
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                page, url, payload, size, digest, first, revisit = (c[row].as_py() for c in batch.columns)
                record = page_record(page, url, payload, size, digest, first, revisit, date)
                out.append((record_id(page), "revisit" if revisit else "response", *writer.add(record), len(record)))
            if out:
                ids, kinds, names, frames, offsets, lengths = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(kinds), pa.array(names), pa.array(frames, pa.int32()),
                     pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    names=["record_id", "record_type", "bundle", "frame", "offset", "length"])
        writer.close()

    marked = mark_revisits(pages, id_col, url_col, payload_col, min_bytes, salts)
    marked.mapInArrow(run, INDEX_COLUMNS).write.parquet(f"{folder.rstrip('/')}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX_COLUMNS).parquet(f"{folder.rstrip('/')}/index")


RECORD_COLUMNS = ("record_id string, record_type string, target string, refers_to string, "
                  "payload_bytes long, payload_digest string")


def _record_reader(data: str, payloads: bool):
    """Task function over rows (bundle, frames, [offsets]): yields the records as batches of bounded size."""
    names = [c.split()[0] for c in RECORD_COLUMNS.split(", ")] + ["payload"] * payloads
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string()] + [pa.binary()] * payloads

    def batch_of(found):
        columns = zip(*[r if payloads else r[:6] for r in found])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def frames_of(batches):
        import zstandard

        opened = zstandard.ZstdDecompressor()
        store, path = open_store(data)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{path}/{row['bundle']}") as source:
                    table = read_seek_table(source, source.size())
                    for number in sorted(row["frames"]) if row["frames"] else range(len(table)):
                        at, packed, plain = table[number]
                        source.seek(at)
                        yield opened.decompress(source.read(packed), max_output_size=plain), (row.get("offsets") or {}), number

    def run(batches) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for frame, offsets, number in frames_of(batches):
            wanted = dict(offsets).get(number) if offsets else None
            at = 0
            for start in sorted(wanted) if wanted is not None else iter(lambda: at, len(frame)):
                headers, block, at = split_record(frame, start)
                if headers["WARC-Type"] == "warcinfo":
                    continue
                found.append(described(headers, block))
                size += len(found[-1][6] or b"") if payloads else 0
                if len(found) >= ROWS_OUT or size >= BYTES_OUT:
                    yield batch_of(found)
                    found, size = [], 0
        if found:
            yield batch_of(found)

    return run


def read_bundles(spark: SparkSession, folder: str, payloads: bool = False, span: int = SPAN_FRAMES) -> DataFrame:
    """All records of the bundles the index names, from the archives themselves, verified by their digests.

    Tasks get spans of ``span`` neighbouring frames and seek to them; with
    ``payloads`` the payload comes along (null for a revisit).
    """
    index = read_index(spark, folder)
    spans = (index.select("bundle", "frame").groupBy("bundle", F.floor(F.col("frame") / span).alias("span"))
             .agg(F.collect_set("frame").alias("frames"))  # at most ``span`` numbers
             .select("bundle", "frames").repartition(shuffle_partitions(spark)))
    return spans.mapInArrow(_record_reader(f"{folder.rstrip('/')}/data", payloads),
                            RECORD_COLUMNS + ", payload binary" * payloads)


def fetch_records(spark: SparkSession, folder: str, wanted: DataFrame, span: int = SPAN_FRAMES) -> DataFrame:
    """The records of the identifiers in ``wanted.record_id``, with payloads, reading only the frames that hold them."""
    hits = read_index(spark, folder).join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    frames = hits.groupBy("bundle", "frame").agg(F.collect_set("offset").alias("at"))
    spans = (frames.groupBy("bundle", F.floor(F.col("frame") / span).alias("span"))
             .agg(F.collect_list("frame").alias("frames"),
                  F.map_from_entries(F.collect_list(F.struct("frame", "at"))).alias("offsets"))
             .select("bundle", "frames", "offsets").repartition(shuffle_partitions(spark)))
    return spans.mapInArrow(_record_reader(f"{folder.rstrip('/')}/data", True), RECORD_COLUMNS + ", payload binary")


def page_summary(records: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``read_bundles``.

    Identifiers are decoded by native expressions: what follows ``x-page:``, percent signs undone.
    """
    def page(col):
        part = F.regexp_extract(col, "^<urn:x-page:(.*)>$", 1)
        return F.when(F.col(col).contains("<urn:x-page:"), F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))).cast(id_type)

    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          page("refers_to").alias("refers_to"))
